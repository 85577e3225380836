"""Tables with a commit log: merged on read, streamed into, and swapped by partition."""

import pytest
from pyspark.sql import functions as F

from saleflow.operators import merge
from saleflow.sources import commits, keyed_table, partition_table
from saleflow.streaming.scan_stream import scan_stream

STATE = "id long, price long, status_cd string, region string, last_seen string, deleted_at string, refresh boolean"
SCAN = "id long, n long, price long, status_cd string, region string"
SIGNALS = ["price", "status_cd"]


def state(spark, n=2000):
    rows = spark.range(n).select("id", (F.col("id") * 10).alias("price"), F.lit("a").alias("status_cd"), F.concat(F.lit("r"), F.col("id") % 3).alias("region"), F.lit("t0").alias("last_seen"))
    return rows.select("*", F.when(F.col("id") % 50 == 7, "gone").alias("deleted_at"), F.lit(None).cast("boolean").alias("refresh"))


def batch(spark, k, first, last):
    rows = spark.range(first, last).select("id", F.lit(k).cast("long").alias("n"), (F.col("id") * 10 + F.col("id") % 2 * k).alias("price"), F.when(F.col("id") % 5 == 0, f"s{k}").alias("status_cd"))
    return rows.select("*", F.concat(F.lit("r"), F.col("id") % 3).alias("region"))


def table_of(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_merge_on_read_equals_the_full_rewrite(spark, tmp_path):
    root, whole = f"file://{tmp_path}/t", state(spark)
    keyed_table.create(whole, root, "id", buckets=8)
    full, told, old = whole, [], commits.latest(spark, root)[0]
    for k, (first, last) in enumerate([(0, 40), (20, 60), (1990, 2020), (0, 20)], 1):
        scan = batch(spark, k, first, last).unionByName(batch(spark, 9, first, first + 5).withColumn("n", F.lit(0).cast("long")))
        full, history = merge.apply_scan(full, scan, "id", SIGNALS, ["n"], F.lit(f"t{k}"))
        told += [(r.id, k, tuple(r.changed), r.previous, r.now) for r in history.collect()]
        version, counts = keyed_table.merge_scan(root, scan, SIGNALS, ["n"], F.lit(f"t{k}"), regions={"region": ["r0", "r1", "r2"]})
        assert version == old + k and counts["rows"] == last - first == counts["new"] + counts["changed"] + counts["unchanged"]
        assert sum(counts[f"region=r{i}"] for i in range(3)) == last - first
        if k == 2:
            assert keyed_table.compact(spark, root) == version + 1
            old += 1
            assert table_of(keyed_table.read(spark, root)) == table_of(keyed_table.read(spark, root, version))
    assert table_of(keyed_table.read(spark, root)) == table_of(full) and counts["new"] == 0
    got = [(r.id, r.version - (r.version > 3), tuple(r.changed), r.previous, r.now) for r in keyed_table.changes(spark, root).collect()]
    assert sorted(got) == sorted(told) and told
    assert table_of(keyed_table.read(spark, root, 0)) == table_of(whole)
    back = keyed_table.runs(spark, root).where("kind = 'search'").select(F.sum(F.col("metrics")["resurrected"])).first()[0]
    assert back == 2  # 7 and 57, once each


def test_a_small_batch_writes_a_small_delta(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    keyed_table.create(state(spark, 400_000).repartition(4), root, "id", buckets=4)
    whole = commits.size(spark, f"{root}/data")
    keyed_table.merge_scan(root, batch(spark, 1, 1000, 5000), SIGNALS, ["n"], F.lit("t1"))
    assert commits.latest(spark, root)[1]["bytes"] < 0.03 * whole


def test_of_two_writers_one_loses(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    keyed_table.create(state(spark, 20), root, "id", buckets=2)
    version, table = commits.latest(spark, root)
    keyed_table.merge_scan(root, batch(spark, 1, 0, 3), SIGNALS, ["n"], F.lit("t1"), from_version=version)
    with pytest.raises(commits.Conflict):
        keyed_table.merge_scan(root, batch(spark, 2, 0, 3), SIGNALS, ["n"], F.lit("t2"), from_version=version)
    with pytest.raises(commits.Conflict):  # a writer that was at work while the other committed
        commits.commit(spark, root, version + 1, table)
    assert commits.versions(spark, root) == [0, 1] and {r.last_seen for r in keyed_table.read(spark, root).where("id < 3").collect()} == {"t1"}


def test_the_guard_of_closing_is_a_complete_scan(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    keyed_table.create(state(spark, 100), root, "id", buckets=3)
    keyed_table.merge_scan(root, batch(spark, 1, 0, 60), SIGNALS, ["n"], F.lit("t1"), complete=False, started_at="t1")
    assert keyed_table.close_aged(spark, root, F.lit("t1"), F.lit("t9"))[1]["rows"] == 0
    keyed_table.merge_scan(root, batch(spark, 1, 60, 70), SIGNALS, ["n"], F.lit("t1"), complete=True, started_at="t1")
    _version, counts = keyed_table.close_aged(spark, root, F.lit("t1"), F.lit("t9"))
    closed = keyed_table.read(spark, root).where("deleted_at = 't9'")
    assert counts["rows"] == closed.count() == 30 and closed.agg(F.min("id")).first()[0] == 70
    assert keyed_table.runs(spark, root).where("complete").count() == 1


def test_stream_of_five_files_with_a_batch_replayed(spark, tmp_path):
    root = f"file://{tmp_path}"
    keyed_table.create(state(spark, 300), f"{root}/t", "id", buckets=4)
    full = state(spark, 300)
    for k in range(5):
        rows = batch(spark, k, 50 * k, 50 * k + 90)
        rows.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCAN).parquet(f"{root}/in")
        run = scan_stream(stream, f"{root}/t", SIGNALS, ["n"], f"{root}/checkpoint", lambda b: f"batch {b}", compact_after=3)
        run.awaitTermination(120)
        full = merge.apply_scan(full, rows, "id", SIGNALS, ["n"], F.lit(f"batch {k}"))[0]
    want = table_of(full)
    assert table_of(keyed_table.read(spark, f"{root}/t")) == want
    before = commits.versions(spark, f"{root}/t")
    keyed_table.merge_scan(f"{root}/t", batch(spark, 77, 0, 90), SIGNALS, ["n"], F.lit("again"), stream="scan", batch=3)
    assert commits.versions(spark, f"{root}/t") == before and table_of(keyed_table.read(spark, f"{root}/t")) == want
    kinds = [r.kind for r in keyed_table.runs(spark, f"{root}/t").orderBy("version").collect()]
    assert kinds == ["create", "search", "search", "search", "compact", "search", "search"]


def files(df):
    return {(r.k, r.p) for r in df.select("k", F.col("_metadata.file_path").alias("p")).distinct().collect()}


def test_fetched_partitions_are_swapped_and_the_others_stay(spark, tmp_path):
    root, keys = f"file://{tmp_path}/p", ["k", "m"]
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long, m int")
    first = rows(("a", 1, 1), ("a", 2, 1), ("b", 3, 1), ("c", 4, 2), ("d", 5, 2))
    assert partition_table.replace(first, first, root, keys) == 0
    read = lambda *v: sorted(map(tuple, partition_table.read(spark, root, *v).collect()))
    assert read() == [("a", 1, 1), ("a", 2, 1), ("b", 3, 1), ("c", 4, 2), ("d", 5, 2)]
    kept = {x for x in files(spark.read.parquet(f"{root}/data")) if x[0] in "ad"}
    fetched = rows(("b", 0, 1), ("c", 0, 2), ("e", 0, 3), ("c", 0, 2))
    assert partition_table.replace(rows(("b", 30, 1), ("b", 31, 1)), fetched, root, keys, from_version=0) == 1
    assert read() == [("a", 1, 1), ("a", 2, 1), ("b", 30, 1), ("b", 31, 1), ("d", 5, 2)] and len(read(0)) == 5
    assert {x for x in files(spark.read.parquet(f"{root}/data")) if x[0] in "ad"} == kept
    with pytest.raises(commits.Conflict):
        partition_table.replace(first, first, root, keys, from_version=0)
    with pytest.raises(ValueError):
        partition_table.replace(rows(("z", 1, 1)), fetched, root, keys)
    partition_table.replace(rows(), first.unionByName(fetched), root, keys)
    assert read() == [] and partition_table.read(spark, root).columns == ["k", "v", "m"]
