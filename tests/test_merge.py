import datetime
import json

import pytest
from pyspark.sql import functions as F

from saleflow.operators import estimate, joins, merge, windows
from saleflow.sources import commits, scan

STATE = "id long, price long, status string, note string, last_seen string, deleted_at string"
SCAN = "id long, n long, price long, status string"


def merged(spark, state, rows):
    return merge.apply_scan(spark.createDataFrame(state, STATE), spark.createDataFrame(rows, SCAN), "id", ["price", "status"], ["n"], F.lit("t2"))


def test_merge_rules(spark):
    state = [(1, 10, "a", "n1", "t1", None), (2, 20, "a", "n2", "t1", None), (3, 30, "a", "n3", "t1", "gone"), (4, 40, "a", "n4", "t1", None)]
    rows = [(1, 1, 99, "z"), (1, 2, 11, None), (2, 1, 20, "a"), (3, 1, None, "a"), (5, 1, 50, "b")]
    new, history = merged(spark, state, rows)
    got = {r.id: tuple(r)[1:] for r in new.collect()}
    assert got == {1: (11, "a", "n1", "t2", None), 2: (20, "a", "n2", "t2", None), 3: (30, "a", "n3", "t2", None), 4: (40, "a", "n4", "t1", None), 5: (50, "b", None, "t2", None)}
    assert [(r.id, r.changed, json.loads(r.previous)["price"]) for r in history.collect()] == [(1, ["price"], 10)]
    again, none = merged(spark, [tuple(r) for r in new.collect()], rows)
    assert none.count() == 0 and {r.id: tuple(r)[1:] for r in again.collect()} == got


def test_closing_needs_a_complete_scan(spark):
    state = spark.createDataFrame([(1, 1, "a", "n", "t1", None), (2, 1, "a", "n", "t3", None)], STATE)
    for run, want in ((("search", True, "t2"), {1: "t9", 2: None}), (("search", False, "t2"), {1: None, 2: None}), (("search", True, "t1"), {1: None, 2: None}), (("photos", True, "t3"), {1: None, 2: None})):
        runs = spark.createDataFrame([run], "kind string, complete boolean, started_at string")
        assert {r.id: r.deleted_at for r in merge.close_aged(state, runs, F.lit("t2"), F.lit("t9")).collect()} == want
        assert [r.id for r in merge.close_aged(state, runs, F.lit("t2"), F.lit("t9"), dry_run=True).collect()] == [k for k, v in want.items() if v]


def test_returning_rows_lose_what_deletion_gave(spark):
    schema = STATE.replace("status", "status_cd") + ", sold boolean, sold_amount long, finalized_at string, last_synced string, refresh boolean"
    state = spark.createDataFrame([(1, 10, "a", "n", "t1", "gone", True, 5, "t1", "t0", None), (2, 10, "a", "n", "t1", None, None, None, None, "t0", None), (3, 10, "a", "n", "t1", None, True, 7, "t1", "t0", None)], schema)
    rows = spark.createDataFrame([(1, 1, 10, "a"), (2, 1, 10, "b"), (3, 1, 11, "a")], SCAN.replace("status", "status_cd"))
    new, _ = merge.apply_scan(state, rows, "id", ["price", "status_cd"], ["n"], F.lit("t2"))
    got = {r.id: (r.deleted_at, r.sold, r.sold_amount, r.finalized_at, r.last_synced, r.refresh) for r in new.collect()}
    assert new.columns == state.columns and got == {1: (None, None, None, None, "t0", None), 2: (None, None, None, None, "t2", True), 3: (None, True, 7, "t1", "t2", None)}


def test_a_version_is_seen_once_it_is_whole(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    for n in (1, 2):
        scan.write_snapshot(spark.range(n), root, "v")
    number = commits.latest(spark, root)[0]
    scan.write_snapshot(spark.range(5), root, "w", from_commit=number)
    with pytest.raises(commits.Conflict):
        scan.write_snapshot(spark.range(6), root, "x", from_commit=number)
    assert scan.read_snapshot(spark, root, "v").count() == 2 and scan.read_snapshot(spark, root).count() == 5


def test_masters(spark):
    rows = [
        {"type": "court", "code": "1", "name": "a", "prefix": "00079B"}, {"type": "court", "code": "2", "name": "b", "prefix": "X"}, {"type": "court", "code": "3", "name": "c"},
        {"type": "usage_scl", "code": "u3", "name": "x", "mcl_code": "u2", "lcl_code": "u1"}, {"type": "usage_mcl", "code": "u2", "name": "y", "lcl_code": "u1"}, {"type": "usage_lcl", "code": "u1", "name": "z"},
        {"type": "sgg", "code": "650", "name": "서초구", "sd_code": "11"}, {"type": "sgg", "code": "650", "name": "포천시", "sd_code": "41"}, {"type": "sgg", "code": "650", "name": "new", "sd_code": "41"}, {"type": "sido", "code": "11"},
    ]
    got = scan.load_masters(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "n int, value string"), "n")
    assert {(r.code, r.prefix) for r in got["court"].collect()} == {("1", "B"), ("2", "X")} and got["sd"].count() == 0
    assert {(r.code, r.level, r.parent_code) for r in got["usage"].collect()} == {("u3", 3, "u2"), ("u2", 2, "u1"), ("u1", 1, None)}
    assert {(r.sd_code, r.name) for r in got["sgg"].collect()} == {("11", "서초구"), ("41", "new")}

def test_current_round(spark):
    d = datetime.date
    props = spark.createDataFrame([("x", d(2026, 8, 10), None)], "docid string, sale_date date, deleted_on date")
    rounds = [("x", 1, d(2026, 7, 6), 11_500_000, "failed", "01"), ("x", 2, d(2026, 7, 6), 8_050_000, "failed", None), ("x", 3, d(2026, 8, 10), 5_635_000, None, None), ("x", 4, d(2026, 8, 10), 3_945_000, None, "01")]
    df = spark.createDataFrame(rounds, "docid string, seq int, round_date date, round_price long, result_cd string, kind_cd string")
    assert windows.current_round(props, df).first().current_price == 5_635_000


def test_envelopes_rows_and_rounds(spark, tmp_path):
    page = {"status": "200", "data": {"dlt_srchResult": [{"boCd": "B1", "srnSaNo": "2020타경1", "maemulSer": "0", "gamevalAmt": "1,000", "maeGiil": "20260102", "yuchalCnt": "12.5"}, {"boCd": "", "srnSaNo": "x"}]}}
    texts = [json.dumps(page), "not json", '{"status": "500", "data": {}}', '{"status": "200", "data": {}}']
    good, dead = scan.split_envelopes(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert good.count() == 1 and sorted(r.note for r in dead.collect()) == ["no dlt_srchResult", "not json", "status 500"]
    coded = spark.createDataFrame([(texts[0], 200), (texts[0], 503)], "value string, code int")
    assert [r.note for r in scan.split_envelopes(coded, expect=("dlt_srchResult",), http_status="code")[1].collect()] == ["http 503"]
    assert scan.split_envelopes(coded, expect=("dlt_srchResult", "dma_pageInfo"))[0].count() == 0
    (tmp_path / "p1.json").write_text(json.dumps(page))
    rows = scan.read_scan(spark, str(tmp_path))
    props = scan.to_properties(rows, ["place"]).collect()
    assert [(p.case_no, p.item_no, p.appraisal_amount, p.fail_count, str(p.sale_date)) for p in props] == [("2020타경1", 1, 1000, None, "2026-01-02")]
    assert scan.to_cases(rows, ["place"]).count() == 1
    detail = json.dumps({"gdsDspslDxdyLst": [{"dxdyYmd": "20260102", "tsLwsDspslPrc": "5"}, {"seq": "7"}], "csPicLst": [{"picFile": "data:image/png;base64," + "A" * 400}, {"picFile": "AA=="}]})
    details = spark.createDataFrame([("d", "B000210", "2023타경6292", 1, detail)], "docid string, court_code string, case_no string, item_no int, detail string")
    assert [r.seq for r in scan.to_sale_rounds(details).collect()] == [1, 7]
    photos = scan.photo_manifest(details).collect()
    assert [(r.seq, r.ok, r.storage_path) for r in photos] == [(1, True, "B000210/2023-6292/1/01.jpg"), (2, False, "B000210/2023-6292/1/02.jpg")]
    assert scan.photo_manifest(details, first=1).count() == 1 and photos[0].raw == "{}"


def test_clamp_and_opposability(spark):
    c = [F.lit(x) for x in (1000, 0.649, 0.5, 0.9)]
    clamp = lambda floor, ceiling: spark.range(1).select(estimate.clamp_estimate(*c, F.lit(floor).cast("long"), F.lit(ceiling).cast("long")).alias("e")).first().e
    assert tuple(clamp(None, 634))[:3] == (634, 500, 634)
    assert tuple(clamp(700, 634))[:3] == (700, 700, 900) and tuple(clamp(None, None))[:3] == (649, 500, 900)
    day = F.lit("2020-01-02").cast("date")
    same = spark.range(1).select(estimate.has_opposability(day, day).alias("a"), estimate.has_opposability(F.date_sub(day, 1), day).alias("b")).first()
    assert tuple(same) == (False, True)


def test_replacing_also_by_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    out = merge.replace_partitions(old, old.where("k = 'a'").withColumn("v", F.lit(9)), old.where("k <> 'c'"), ["k"])
    assert sorted(map(tuple, out.collect())) == [("a", 9), ("c", 3)]


def test_a_listing_with_half_of_all_rounds(spark):
    """The hot listing meets the join with a row for each day, and the ceiling is the same."""
    days = F.expr("date_add(date '2020-01-01', cast(id % 400 as int))")
    rounds = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 500)).alias("docid"), days.alias("round_date"), (F.pmod(F.xxhash64("id"), F.lit(9999)) - 5).alias("round_price"))
    props = rounds.groupBy("docid").agg(F.expr("date_add(min(round_date), 150)").alias("sale_date"))
    got = {r.docid: r.ceiling for r in joins.prior_round_ceiling(props, rounds).collect()}
    want: dict = {}
    sale = {r.docid: r.sale_date for r in props.collect()}
    for r in rounds.collect():
        if r.round_price > 0 and r.round_date < sale[r.docid]:
            want[r.docid] = min(r.round_price, want.get(r.docid, r.round_price))
    assert got == want and len(got) == 251
    plan = joins.prior_round_ceiling(props, rounds)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min(round_price" in plan
