import datetime
import json
import math

import numpy as np
from pyspark.sql import functions as F

from saleflow.functions import katec
from saleflow.operators import details
from saleflow.sources import cards

DAY = datetime.date


def project(lon, lat):
    """Forward transverse Mercator on Bessel, degrees, by the meridian arc and the usual series."""
    a, f = katec.BESSEL
    e2 = 2 * f - f * f
    ep = e2 / (1 - e2)
    lon, lat = math.radians(lon), math.radians(lat)
    n = a / math.sqrt(1 - e2 * math.sin(lat) ** 2)
    t, c, A = math.tan(lat) ** 2, ep * math.cos(lat) ** 2, (lon - katec.LON0) * math.cos(lat)
    m = float(katec._meridian(np.float64(lat), a, e2) - katec._meridian(katec.LAT0, a, e2))
    x = katec.SCALE * n * (A + (1 - t + c) * A**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * A**5 / 120)
    y = katec.SCALE * (m + n * math.tan(lat) * (A * A / 2 + (5 - t + 9 * c + 4 * c * c) * A**4 / 24 + (61 - 58 * t + t * t) * A**6 / 720))
    return float(x + katec.X0), float(y + katec.Y0)


def test_grid_round_trip():
    for lon, lat in ((127.0, 37.5), (126.2, 34.0), (129.3, 35.2), (128.0, 38.0)):
        x, y = project(lon, lat)
        got = np.degrees(katec.unproject(np.array([x]), np.array([y])))
        assert abs(got[0][0] - lon) < 1e-8 and abs(got[1][0] - lat) < 1e-8
        wgs = katec.to_wgs84(np.array([x]), np.array([y]))
        assert 0 < abs(wgs[0][0] - lon) < 0.01 and abs(wgs[1][0] - lat) < 0.01


def test_lnglat_falls_back(spark):
    x, y = project(127.0, 37.5)
    rows = spark.createDataFrame([(x, y, 0.0, 0.0), (0.0, 0.0, 127.0, 37.0), (0.0, 0.0, 0.0, 0.0), (None, None, None, None)], "x double, y double, a double, b double")
    got = [r.p for r in rows.coalesce(1).select(katec.lnglat(F.col("x"), F.col("y"), F.col("a"), F.col("b")).alias("p")).collect()]
    assert abs(got[0].lng - 127.0) < 0.01 and tuple(got[1]) == (127.0, 37.0) and got[2] is None and got[3] is None


PAGE = """<div class="bit__searchResult"><p class="my-2">期間入札</p><img class="bit__image" src="/data/image/x.jpg"><a onclick="tranPropertyDetail('U1','C9')">x</a>
<p>売却基準価額 494万5,000円</p><p>保証金 100,000円</p><div class="bit__multiHeadTable_th">閲覧開始日</div><div class="bit__multiHeadTable_td">令和08年04月17日</div>
<div class="bit__multiHeadTable_th">入札期間</div><div class="bit__multiHeadTable_td">令和08年05月01日〜令和08年05月08日</div></div>
<div class="bit__searchResult"><a onclick="tranPropertyDetail('U1','C9')">again</a><a onclick="tranPropertyDetail('U2','C9')">y</a></div>"""
DETAIL = """<div class="bit__syousai_text_kakaku_container"><p>売却基準価額</p><p>note</p><p>4,940,000円</p><p>買受申出保証金</p><p>買受可能価額</p><p>395万2,000円</p></div>
<div class="bit__paragraphBreaksTable"><div class="bit__paragraphBreaksTable_th">床面積（登記）</div><div class="bit__paragraphBreaksTable_td">104.94m 2</div></div>
<img class="bit__image" src="/data/image/a.jpg"><img class="bit__image" src="/other.jpg"><input id="latitude" value="35.5"><input id="longitude" value="139.5"><a id="threeSetPDF">pdf</a>"""


def test_cards_and_details(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = {r.sale_unit_id: r for r in cards.with_typed(cards.parse_listing_cards(pages)).collect()}
    assert set(rows) == {"U1", "U2"} and rows["U1"].status == "period_bid" and rows["U1"].photo_url == "/data/image/x.jpg"
    assert (rows["U1"].standard_price, rows["U1"].deposit) == (4_945_000, 100_000)
    assert (rows["U1"].view_start, rows["U1"].bid_start, rows["U1"].bid_end) == (DAY(2026, 4, 17), DAY(2026, 5, 1), DAY(2026, 5, 8))
    df = cards.parse_detail_pages(spark.createDataFrame([(1, DETAIL)], "page_id long, html string"))
    d = df.select("*", details.jp_area_text(F.col("fields")).alias("area"), details.jp_area_m2(F.col("fields")).alias("m2")).first()
    assert d.prices == {"standard_price": "4,940,000円", "purchase_price": "395万2,000円"} and d.photos == ["/data/image/a.jpg"]
    assert (d.latitude, d.longitude, d.has_pdf, d.area, d.m2) == (35.5, 139.5, True, "104.94㎡", 104.94)


def one(spark, column, value, kind="map<string,string>"):
    return spark.createDataFrame([(value,)], f"r {kind}").select(column(F.col("r")).alias("x")).first().x


def test_normalised_rows(spark):
    deal = one(spark, details.normalize_deal, {"offiNm": "O", "excluUseAr": "0", "dealArea": "59.9", "dealAmount": "12,300", "dealYear": "2024", "dealMonth": "3", "dealDay": "7", "floor": "x"})
    assert (deal.name, deal.area, deal.amount, deal.deal_date, deal.floor) == ("O", 59.9, 12300.0, DAY(2024, 3, 7), None)
    assert one(spark, details.normalize_deal, {"dealYear": "20x4"}).deal_date is None
    reg = one(spark, details.normalize_register, {"useAprDay": "19991231", "totArea": "1,000.5", "grndFlrCnt": "3"})
    assert (reg.approved_on, reg.total_area, reg.floors) == (DAY(1999, 12, 31), 1000.5, 3)
    params = lambda lot, addr, sgg="650": spark.range(1).select(details.register_params(F.lit("11"), F.lit(sgg), F.lit("101"), F.lit(lot), F.lit(addr)).alias("x")).first().x
    assert tuple(params("12-3", "a")) == ("11650", "10100", "0012", "0003", "0") and tuple(params("산 7", "b"))[2:] == ("0007", "0000", "1")
    assert params("12", "산 12")[4] == "1" and params("x", "a") is None and params("12", "a", "65") is None


def test_detail_json(spark):
    detail = json.dumps({"csBaseInfo": {"clmAmt": "1,000", "rcptYmd": "", "csRcptYmd": "20200102", "auctnSuspStatCd": "01"}, "csPicLst": [{"picFile": "AAAA"}], "aeeWevlMnpntLst": [], "gdsDspslDxdyLst": [{"seq": "1"}], "picDvsIndvdCnt": 3})
    case = one(spark, details.detail_case, detail, "string")
    assert (case.claim, case.received, case.started, case.suspension) == (1000, DAY(2020, 1, 2), None, "01")
    assert set(json.loads(one(spark, details.slim_detail, detail, "string"))) == {"csBaseInfo", "picDvsIndvdCnt"}


def test_upkeep(spark):
    props = spark.createDataFrame([("a", 10, 5, None, "open", "t1"), ("b", None, 7, 1.0, "aborted", "t1"), ("c", 3, 3, None, None, "t9")], "k string, p long, q long, lat double, status string, fetched_at string")
    found = spark.createDataFrame([("a", 11, None, 2.0), ("b", 9, 7, None)], "k string, p long, q long, lat double")
    new, history = details.jp_apply_detail(props, found, "k", ["p", "q"], ["lat"])
    assert {r.k: (r.p, r.q, r.lat) for r in new.collect()} == {"a": (11, 5, 2.0), "b": (9, 7, 1.0), "c": (3, 3, None)}
    assert [(r.k, r.p, r.prev_p) for r in history.collect()] == [("a", 11, 10)]
    assert {r.k: r.status for r in details.jp_close_aged(props, F.lit("t5")).collect()} == {"a": "closed", "b": "aborted", "c": None}
    assert {r.k: r.outcome for r in details.refill(props, found, "k", ["p"]).collect()} == {"a": "updated", "b": "updated", "c": "skipped"}
    tags = spark.createDataFrame([(["b", "a"],), (None,), ([],)], "t array<string>")
    fixed = F.array(F.lit("a"), F.lit("b"))
    assert [r.changed for r in details.refill_arrays(tags.coalesce(1), "t", fixed, True).collect()] == [False, True, True]
    roads = spark.createDataFrame([("a", "old", 1.0, 1.0), ("b", None, 1.0, 1.0)], "k string, road_addr string, lng double, lat double")
    assert [r.k for r in details.geocode_candidates(roads).collect()] == ["b"]
    put = details.apply_geocodes(roads, spark.createDataFrame([("a", "new"), ("b", "new")], "k string, road_addr string"), "k")
    assert {r.k: r.road_addr for r in put.collect()} == {"a": "old", "b": "new"}


def test_queue_and_masters(spark):
    rows = [("a", None, None, False, DAY(2020, 1, 2)), ("b", None, "t", True, None), ("c", None, "t", False, DAY(2020, 1, 1)), ("d", DAY(2020, 1, 1), None, True, DAY(2020, 1, 1))]
    df = spark.createDataFrame(rows, "docid string, deleted_on date, synced_on string, refresh boolean, sale_date date")
    assert [r.docid for r in details.detail_queue(df, 5).collect()] == ["a", "b"]
    m = lambda *r: spark.createDataFrame(list(r), "code string, name string")
    assert {r.code: r.name for r in details.union_masters(m(("1", "x")), m(("1", "y"), ("2", "z")), "code").collect()} == {"1": "x", "2": "z"}
    none = F.lit(None).cast("int")
    assert spark.range(1).select(details.estimate_caveats(F.lit("model"), F.lit(5), {"area": none, "age": F.lit(3)}).alias("x")).first().x == ["low_confidence", "area"]
