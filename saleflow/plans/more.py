"""Further registered queries over the shaped listing tables, each with its DuckDB SQL written on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleflow.functions import katec, rules
from saleflow.functions import scalars as sc
from saleflow.operators import details, filters, joins, merge, reports, stats
from saleflow.shared import once, shared_folder
from saleflow.sources import cards, scan

from .listing import ORACLES, QUERIES, REGION, VISIBLE, query, text
from .shaping import AS_OF, oracle, shape

c, lit = F.col, F.lit


_folder = shared_folder


# --- sources
def _pages(t):
    """Response pages of 40 listings each; some are broken."""
    page = F.floor(c("o_orderkey") / 40).alias("page")
    row = F.struct("docid", c("court_code").alias("boCd"), c("case_no").alias("srnSaNo"), c("min_sale_price").cast("string").alias("minmaePrice"))
    body = t("props").groupBy(page).agg(F.to_json(F.struct(lit("200").alias("status"), F.struct(F.collect_list(row).alias("dlt_srchResult")).alias("data"))).alias("value"))
    broken = F.when(c("page") % 17 == 0, "<html>").when(c("page") % 13 == 0, '{"status":"200","data":{}}').when(c("page") % 11 == 0, '{"status":"500","data":{"dlt_srchResult":[]}}')
    return body.withColumn("value", F.coalesce(broken, "value"))


NOTE = "case when page % 17 = 0 then 'not json' when page % 13 = 0 then 'no dlt_srchResult' when page % 11 = 0 then 'status 500' end"


@query("a1_read_rows", f"select docid, min_sale_price from (select *, o_orderkey // 40 as page from props) where {NOTE} is null", "props")
def _(t):
    rows = scan.split_envelopes(_pages(t))[0].select(F.explode("rows").alias("row"))
    return rows.select(c("row.docid"), sc.to_int(c("row.minmaePrice")).alias("min_sale_price"))


@query("a2_dead_letters", f"select distinct page, {NOTE} as note from (select o_orderkey // 40 as page from props) where {NOTE} is not null", "props")
def _(t):
    return scan.split_envelopes(_pages(t))[1].select("page", "note")


@query(
    "a3_masters",
    """, u as (select 'sgg' as kind, sgg_code as code, sgg_name || '!' as name, sd_code as parent, cast(null as int) as level from sgg
 union all select 'court', court_code, court_name, case when substr(court_code, 7, 1) in ('1', '2') then 'B' else 'X' end, null from courts where substr(court_code, 7, 1) <> '9'
 union all select 'usage', code, name, case when length(code) = 5 and code like '20%01' and code <> '20000' then '20000' end, case when code like '%0000' then 1 else 2 end from usage) select * from u""",
    "sgg", "courts", "usage",
)
def _(t):
    line = lambda df, n, **v: df.select(F.to_json(F.struct(*(x.alias(k) for k, x in v.items()))).alias("value"), lit(n).alias("n"))
    district = {"type": lit("sgg"), "code": c("sgg_code"), "sd_code": c("sd_code")}
    last = F.substring("court_code", 7, 1)
    prefix = F.when(last.isin("1", "2"), "00079B").when(last != "9", "X").otherwise("")
    large = c("code").endswith("0000")
    lines = line(t("sgg"), 1, name=c("sgg_name"), **district).unionByName(line(t("sgg"), 2, name=F.concat("sgg_name", lit("!")), **district))
    lines = lines.unionByName(line(t("courts"), 1, type=lit("court"), code=c("court_code"), name=c("court_name"), prefix=prefix))
    kind = F.when(large, "usage_lcl").otherwise("usage_mcl")
    parent = F.when(c("code").startswith("20"), "20000")
    lines = lines.unionByName(line(t("usage"), 1, type=kind, code=c("code"), name=c("name"), lcl_code=parent))
    got = scan.load_masters(lines, "n")
    none = lit(None).cast("int").alias("level")
    out = got["sgg"].select(lit("sgg").alias("kind"), "code", "name", c("sd_code").alias("parent"), none)
    out = out.unionByName(got["court"].select(lit("court").alias("kind"), "code", "name", c("prefix").alias("parent"), none))
    return out.unionByName(got["usage"].select(lit("usage").alias("kind"), "code", "name", c("parent_code").alias("parent"), "level"))


def a4_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings written as two versions and read as the newest one."""
    props, root = shape(spark, sf_dir, "props"), _folder(spark, "snapshot")
    for version, rows in (("1", props.where("deleted_on is null")), ("2", props)):
        scan.write_snapshot(rows.select("docid", "usage_lcl_cd", "min_sale_price"), root, version)
    return scan.read_snapshot(spark, root).groupBy("usage_lcl_cd").agg(F.count(lit(1)).alias("n"), F.sum("min_sale_price").alias("total"))


QUERIES["a4_snapshot"] = a4_snapshot
ORACLES["a4_snapshot"] = oracle("select usage_lcl_cd, count(*) as n, cast(sum(min_sale_price) as bigint) as total from props group by 1", "props")


@query(
    "a5_fetch_log",
    ", log as (select lawd_cd, deal_type, strftime(deal_date, '%Y%m') as month, count(*) as n from deals group by 1, 2, 3) "
    "select lawd_cd, deal_type, month, case when deal_type = 'apt' and month >= '2001' then cast(0 as bigint) else n end as n from log",
    "deals",
)
def _(t):
    log = t("deals").groupBy("lawd_cd", "deal_type", F.date_format("deal_date", "yyyyMM").alias("month")).agg(F.count(lit(1)).alias("n"))
    fetched = log.where("deal_type = 'apt' and month >= '2001'").withColumn("n", lit(0).cast("bigint"))
    return merge.upsert_log(log, fetched, ["lawd_cd", "deal_type", "month"])


@query(
    "a6_photo_manifest",
    """select docid, cast(i as int) as place, case when i = 2 then cast(7 as bigint) else cast(i as bigint) end as seq, case i when 1 then 'K1' end as kind, case i when 1 then 'front' else 'b.PNG' end as description,
 cast(case when i = 1 then 3 * (o_orderkey % 90 + 1) else 3 end as int) as n_bytes, i = 1 and 3 * (o_orderkey % 90 + 1) >= 100 as ok,
 court_code || '/' || regexp_replace(case_no, '[^0-9]+', '-') || '/1/' || case when i = 2 then '07.png' else '01.jpg' end as storage_path from props, range(1, 3) r(i)""",
    "props",
)
def _(t):
    photo = lambda **v: F.struct(*(v[k].alias(k) for k in v))
    one = photo(picFile=F.concat(lit("data:image/jpeg;base64,"), F.repeat(lit("QUJD"), (c("o_orderkey") % 90 + 1).cast("int"))), cortAuctnPicDvsCd=lit("K1"), picDesc=lit("front"), picTitlNm=lit("no ending"), picSeq=lit("0"))
    two = photo(picFile=lit("QUJD"), cortAuctnPicDvsCd=lit(None).cast("string"), picDesc=lit(""), picTitlNm=lit("b.PNG"), picSeq=lit("7"))
    rows = t("props").select("docid", "court_code", "case_no", lit(1).alias("item_no"), F.to_json(F.struct(F.array(one, two).alias("csPicLst"))).alias("detail"))
    got = scan.photo_manifest(rows).withColumn("docid", F.concat(lit("D"), F.regexp_extract("case_no", "타경(.*)", 1)))
    return got.select("docid", F.when(c("seq") == 7, 2).otherwise(1).alias("place"), "seq", "kind", "description", "n_bytes", "ok", "storage_path")


CARD_HTML = """<div class="bit__searchResult"><p class="my-2">%s</p><span class="badge"> %s</span><p>東京地方裁判所立川支部 %s</p><img class="bit__searchResult_img" src="%s"><a onclick="tranPropertyDetail('%s','%s')">x</a>
<p>売却基準価額</p><p>note</p><p>%s円</p><div>買受申出保証金 %s円</div><div><i class="bit__icon_access"></i>%s</div><div class="bit__result_kakakuContainer"><div class="bit__text_small">線 %s駅</div></div>
<div class="bit__multiHeadTable_th">公示開始日</div><div class="bit__multiHeadTable_th">閲覧開始日 *</div><div class="bit__multiHeadTable_td">%s</div><div class="bit__multiHeadTable_th">入札期間</div><div class="bit__multiHeadTable_td">%s〜%s</div>
<div class="bit__multiHeadTable_th">開札期日</div><p>-</p><div class="bit__multiHeadTable_td">%s</div></div>"""


def _era(day):
    return F.concat(lit("平成"), (F.year(day) - 1988).cast("string"), lit("年"), F.month(day).cast("string"), lit("月"), F.dayofmonth(day).cast("string"), lit("日"))


@query(
    "a9_listing_cards",
    """select sale_unit_id, court_id, case_no, cast(regexp_extract(case_no, '第([0-9]+)号', 1) as int) as number, case when case_no is not null then '東京地方裁判所立川支部' end as court_name, trim(sale_cls_label) as sale_cls_label,
 case status_text when '期間入札' then 'period_bid' when '特別売却' then 'special_sale' when '売却中止' then 'aborted' end as status, photo_url, replace(address, '　', ' ') as address, '線 ' || (o_orderkey % 70) || '駅' as transit, standard_price, deposit,
 cast(null as string) as notice_start, cast(fetched_on as string) as view_start, cast(fetched_on as string) as bid_start, cast(fetched_on + 7 as string) as bid_end, cast(null as string) as open_date from jp where standard_price is not null""",
    "jp",
)
def _(t):
    text_of = lambda x: F.coalesce(c(x), lit(""))
    day, end = _era(c("fetched_on")), _era(F.date_add("fetched_on", 7))
    values = ["status_text", text_of("sale_cls_label"), text_of("case_no"), text_of("photo_url"), "sale_unit_id", "court_id", F.format_number("standard_price", 0), F.format_number("deposit", 0), "address", (c("o_orderkey") % 70).cast("string")]
    html = F.format_string(CARD_HTML, *values, day, day, end, end)
    both = t("jp").where("standard_price is not null").select(c("o_orderkey").alias("page_id"), F.concat(html, html).alias("html"))  # a listing twice on its page counts once
    got = cards.with_typed(cards.parse_listing_cards(both))
    dates = [text(x) for x in ("notice_start", "view_start", "bid_start", "bid_end", "open_date")]
    return got.select("sale_unit_id", "court_id", "case_no", "case_parts.number", "court_name", "sale_cls_label", "status", "photo_url", "address", "transit", "standard_price", "deposit", *dates)


DETAIL_HTML = """<p class="bit__text_big col-12 d-sm-inline">東京地方裁判所 %s</p><div class="bit__syousai_text_kakaku_container"><p>売却基準価額</p><p>%s円</p><p>買受可能価額</p><p>買受申出保証金</p><p>%s円</p></div>
<div class="bit__multiHeadTable_th">公示開始日</div><div class="bit__multiHeadTable_th">閲覧開始日</div><div class="bit__multiHeadTable_td">%s</div><div class="bit__multiHeadTable_th">特別売却期間</div><div class="bit__multiHeadTable_td">%s～</div>
<p class="bit__text_big">1．土地</p><div class="bit__paragraphBreaksTable"><div class="bit__paragraphBreaksTable_th">床面積（登記）</div>
<div class="bit__paragraphBreaksTable_td">%s.5m 2</div></div><input id="latitude" value="35.5"><input id="longitude" value="%s"><img class="bit__image" src="%s">"""


@query(
    "a10_detail_pages",
    """select o_orderkey as page_id, case_no, case when case_no is not null then '東京地方裁判所' end as court_name, standard_price as price, cast(null as bigint) as purchase_price, deposit, cast(null as string) as notice_start,
 cast(fetched_on as string) as view_start, cast(fetched_on as string) as special_start, cast(null as string) as special_end, '1．土地' as head, cast(o_orderkey % 90 as double) + 0.5 as area, cast(130 + o_orderkey % 10 as double) as longitude,
 case when photo_url like '/data/image/%' then 1 else 0 end as photos from jp where standard_price is not null""",
    "jp",
)
def _(t):
    k, day = c("o_orderkey"), _era(c("fetched_on"))
    html = F.format_string(DETAIL_HTML, F.coalesce("case_no", lit("")), F.format_number("standard_price", 0), F.format_number("deposit", 0), day, day, (k % 90).cast("string"), (130 + k % 10).cast("string"), F.coalesce("photo_url", lit("")))
    got = cards.detail_typed(cards.parse_detail_pages(t("jp").where("standard_price is not null").select(k.alias("page_id"), html.alias("html"))))
    dates = [text(x) for x in ("notice_start", "view_start", "special_start", "special_end")]
    return got.select(
        "page_id", "case_no", "court_name", c("standard_price").alias("price"), "purchase_price", "deposit", *dates, F.get("heads", lit(0)).alias("head"), details.jp_area_m2(c("fields")).alias("area"), "longitude",
        F.size("photos").alias("photos"),
    )


# --- rows and scalars
#: The grid by another way than the library: Krueger's series in the third flattening, and Bowring's latitude.
GRID = """, g as (select docid, 250000.0 + o_custkey % 300 * 1000 as x, 300000.0 + o_custkey % 500 * 800 as y from props),
 c as (select 6377397.155 as a, 1 / 299.1528128 as f, radians(38.0) as lat0),
 k as (select *, f / (2 - f) as n, sqrt(2 * f - f * f) as e from c),
 s as (select *, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as r, asin(tanh(atanh(sin(lat0)) - e * atanh(e * sin(lat0)))) as chi0 from k),
 m as (select *, chi0 + (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180) * sin(2 * chi0) + (13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440) * sin(4 * chi0)
  + (61 * n ** 3 / 240 - 103 * n ** 4 / 140) * sin(6 * chi0) as xi0 from s),
 t as (select docid, n, e, xi0 + (y - 600000) / (0.9999 * r) as xi, (x - 400000) / (0.9999 * r) as eta, x, y, n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360 as b1, n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440 as b2, 17 * n ** 3 / 480 - 37 * n ** 4 / 840 as b3 from g, m),
 u as (select *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) as xi1, eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) as eta1 from t),
 v as (select *, asin(sin(xi1) / cosh(eta1)) as chi, radians(128.0) + atan2(sinh(eta1), cos(xi1)) as lon from u),
 w as (select docid, lon, chi + (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45) * sin(2 * chi) + (7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45) * sin(4 * chi) + (56 * n ** 3 / 15 - 136 * n ** 4 / 35) * sin(6 * chi) + 4279 * n ** 4 / 630 * sin(8 * chi) as lat, e from v),
 q as (select docid, lon, lat, 6377397.155 / sqrt(1 - e * e * sin(lat) ** 2) as nn, e from w),
 z as (select docid, nn * cos(lat) * cos(lon) - 146.43 as gx, nn * cos(lat) * sin(lon) + 507.89 as gy, nn * (1 - e * e) * sin(lat) + 681.46 as gz, 6378137.0 as wa, 6378137.0 * (1 - 1 / 298.257223563) as wb from q),
 th as (select *, sqrt(gx * gx + gy * gy) as p, atan2(gz * wa, sqrt(gx * gx + gy * gy) * wb) as theta, 1 - (wb / wa) ** 2 as e2 from z),
 b as (select docid, degrees(atan2(gy, gx)) as lng, degrees(atan2(gz + e2 / (1 - e2) * wb * sin(theta) ** 3, p - e2 * wa * cos(theta) ** 3)) as lat from th)
 select docid, case when ok then round(lng, 5) end as lng, case when ok then round(lat, 5) end as lat from (select *, lng between 124 and 132.5 and lat between 33 and 39 as ok from b)"""


@query("b7_grid_coordinates", GRID, "props")
def _(t):
    k = c("o_custkey")
    p = katec.katec_to_wgs84(250_000.0 + k % 300 * 1000, 300_000.0 + k % 500 * 800)
    return t("props").select("docid", p.alias("p")).select("docid", F.round("p.lng", 5).alias("lng"), F.round("p.lat", 5).alias("lat"))


@query(
    "b8_grid_first",
    GRID.rpartition(" select docid, case when ok")[0]
    + """, x as (select p.docid, p.lng, p.lat, case when o_custkey % 3 <> 0 and b.lng between 124 and 132.5 and b.lat between 33 and 39 then b.lng end as glng, b.lat as glat from props p join b using (docid))
 select docid, round(coalesce(glng, case when lng between 124 and 132 and lat between 33 and 39 then lng end), 5) as lng, round(case when glng is not null then glat when lng between 124 and 132 and lat between 33 and 39 then lat end, 5) as lat from x""",
    "props",
)
def _(t):
    k = c("o_custkey")
    grid = lambda v: F.when(k % 3 != 0, v).otherwise(0.0)
    p = katec.lnglat(grid(250_000.0 + k % 300 * 1000), grid(300_000.0 + k % 500 * 800), c("lng"), c("lat"))
    return t("props").select("docid", p.alias("p")).select("docid", F.round("p.lng", 5).alias("lng"), F.round("p.lat", 5).alias("lat"))


@query(
    "b8_fallback_coordinates",
    "select docid, case when ok then lng end as lng, case when ok then lat end as lat from (select *, coalesce(lng between 124 and 132 and lat between 33 and 39 and o_orderkey % 3 <> 0, false) as ok from props)",
    "props",
)
def _(t):
    away = F.when(c("o_orderkey") % 3 == 0, 0.0)
    p = katec.lnglat(lit(0.0), lit(0.0), F.coalesce(away, "lng"), c("lat"))
    return t("props").select("docid", p.alias("p")).select("docid", "p.lng", "p.lat")


def _raw(t, **more):
    """The listings as raw rows of the scan, some twice with an older amount."""
    first = t("props").select(
        F.create_map(lit("boCd"), c("court_code"), lit("srnSaNo"), c("case_no"), lit("docid"), c("docid"), lit("gamevalAmt"), F.format_number("appraisal_amount", 0), lit("maeAmt"), F.format_number("min_sale_price", 0),
                     lit("jpDeptNm"), lit(""), lit("jdbnNm"), F.when(c("o_orderkey") % 2 == 0, c("usage_nm")), lit("tel"), lit(" 02 "), lit("lclsUtilCd"), F.coalesce("usage_lcl_cd", lit("0")),
                     lit("maeGiil"), F.date_format("sale_date", "yyyyMMdd"), lit("inqCnt"), c("fail_count").cast("string")).alias("row"), lit(2).alias("n"),
    )
    old = first.select(F.map_concat(F.map_filter("row", lambda k, v: k != "maeAmt"), F.create_map(lit("maeAmt"), lit("1"))).alias("row"), lit(1).alias("n"))
    return first.unionByName(old)


@query("b9_to_cases", "select court_code, case_no, case when o_orderkey % 2 = 0 then usage_nm end as dept_name, '02' as tel from props", "props")
def _(t):
    return scan.to_cases(_raw(t), ["n"]).select("court_code", "case_no", "dept_name", "tel")


@query(
    "b11_to_sale_results",
    "select docid, court_code, appraisal_amount, min_sale_price as sale_amount, cast(fail_count as bigint) as bidder_count, usage_lcl_cd, cast(sale_date as string) as sale_date from props",
    "props",
)
def _(t):
    return details.to_sale_results(_raw(t), ["n"]).select("docid", "court_code", "appraisal_amount", "sale_amount", "bidder_count", "usage_lcl_cd", text("sale_date"))


def _details(t):
    k = c("o_orderkey")
    base = F.struct(
        F.format_number("appraisal_amount", 0).alias("clmAmt"), F.when(k % 2 == 0, "").otherwise(F.date_format("sale_date", "yyyyMMdd")).alias("rcptYmd"), F.date_format("sale_date", "yyyy-MM-dd").alias("csRcptYmd"),
        lit("01").alias("auctnSuspStatCd"), F.when(k % 3 == 0, "비고").alias("rmk"), F.when(k % 5 == 0, "위").alias("topRmk"),
    )
    notes = F.when(k % 4 == 0, F.array(F.struct(lit("맹지").alias("aeeWevlMnpntCtt")), F.struct(lit(" ").alias("aeeWevlMnpntCtt"))))
    terms = F.struct(F.when(k % 2 == 0, "지분").alias("gdsSpcfcRmk"), lit("10").alias("prchDposRate"))
    whole = F.struct(base.alias("csBaseInfo"), terms.alias("dspslGdsDxdyInfo"), notes.alias("aeeWevlMnpntLst"), F.array(lit(1)).alias("gdsDspslDxdyLst"), F.array().cast("array<int>").alias("rgltLandLstAll"), lit("AAAA").alias("csPicLst"))
    return t("props").select("docid", F.to_json(whole).alias("detail"))


@query(
    "b12_detail",
    """select docid, appraisal_amount as claim, cast(sale_date as string) as received, '01' as suspension, concat_ws(',', case when o_orderkey % 4 = 0 then 'aeeWevlMnpntLst' end, 'csBaseInfo', 'dspslGdsDxdyInfo') as kept,
 concat_ws('|', case when o_orderkey % 2 = 0 then '지분' end, case when o_orderkey % 4 = 0 then '맹지' end, case when o_orderkey % 3 = 0 then '비고' end, case when o_orderkey % 5 = 0 then '위' end) as remarks from props""",
    "props",
)
def _(t):
    case, kept = details.detail_case(c("detail")), F.json_object_keys(details.slim_detail(c("detail")))
    out = _details(t).select("docid", case.alias("case"), kept.alias("kept"), rules.detail_texts(c("detail")).alias("t"))
    return out.select("docid", "case.claim", text("case.received").alias("received"), "case.suspension", F.array_join(F.array_sort("kept"), ",").alias("kept"), F.replace("t.text", lit("\n"), lit("|")).alias("remarks"))


@query(
    "b15_deals",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 2 = 0 then 'O' || l_suppkey end as name, case when l_quantity = 0 then null when l_partkey % 3 = 0 then l_quantity else l_quantity + 1 end as area,
 cast(floor(l_extendedprice) as double) as amount, case when l_suppkey % 5 <> 0 then strftime(l_shipdate, '%Y-%m-%d') end as deal_date from lineitem_rows""",
    "lineitem_rows",
)
def _(t):
    k = c("l_partkey")
    row = F.create_map(
        lit("aptNm"), lit(""), lit("offiNm"), F.when(k % 2 == 0, F.concat(lit("O"), c("l_suppkey"))), lit("excluUseAr"), F.when(k % 3 == 0, c("l_quantity").cast("string")).otherwise("0"), lit("dealArea"), (c("l_quantity") + 1).cast("string"),
        lit("dealAmount"), F.format_number(F.floor("l_extendedprice"), 0), lit("dealYear"), F.year("l_shipdate").cast("string"), lit("dealMonth"), F.month("l_shipdate").cast("string"),
        lit("dealDay"), F.when(c("l_suppkey") % 5 == 0, "3일").otherwise(F.dayofmonth("l_shipdate").cast("string")),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    deals = once(t("lineitem_rows").select(*keys, row.alias("row")), "row")
    return deals.select(*keys, details.normalize_deal(c("row")).alias("d")).select(*keys, "d.name", "d.area", "d.amount", text("d.deal_date").alias("deal_date"))


@query(
    "b16_registers",
    """select docid, cast(sale_date as string) as approved_on, cast(o_orderkey % 500 as double) + 0.5 as total_area, cast(o_orderkey % 30 as bigint) as floors,
 case when o_orderkey % 7 <> 0 then sd_code || sgg_code || emd_code || '00' || lpad(cast(o_custkey % 9999 as string), 4, '0') || case when o_orderkey % 2 = 0 then '0012' else '0000' end || case when o_orderkey % 3 = 0 then '1' else '0' end end as lot from props""",
    "props",
)
def _(t):
    k = c("o_orderkey")
    row = F.create_map(lit("useAprDay"), F.date_format("sale_date", "yyyyMMdd"), lit("totArea"), F.concat((k % 500).cast("string"), lit(".5")), lit("grndFlrCnt"), (k % 30).cast("string"))
    lot = F.concat(F.when(k % 3 == 0, "산 ").otherwise(""), (c("o_custkey") % 9999).cast("string"), F.when(k % 2 == 0, "-12").otherwise(""))
    p = details.register_params(c("sd_code"), c("sgg_code"), c("emd_code"), F.when(k % 7 == 0, "없음").otherwise(lot), lit(None).cast("string"))
    out = t("props").select("docid", details.normalize_register(row).alias("r"), p.alias("p"))
    return out.select("docid", text("r.approved_on").alias("approved_on"), "r.total_area", "r.floors", F.concat("p.sigungu", "p.bjdong", "p.bun", "p.ji", "p.mountain").alias("lot"))


@query(
    "b_formats",
    f"""select docid, case when usage_lcl_cd in ('10000', '30000') then 'land' when building_summary like '%빌라%' then 'rh' when substr(usage_mcl_cd, 1, 3) = '201' then 'apt' when substr(usage_mcl_cd, 1, 3) = '202' then 'rh'
 when substr(usage_mcl_cd, 1, 3) = '204' then 'offi' when substr(usage_mcl_cd, 1, 3) = '206' then 'indu' else 'apt' end as market,
 case when state = 'F' then '정지/연기/취하' when o_orderkey % 5 = 0 then '진행 중' when o_orderkey % 5 = 1 then '변경' when o_orderkey % 5 = 2 then '상태 미상' end as status, case when state = 'F' then '사유' end as reason,
 case when o_orderkey % 3 = 0 then cast(10 as double) when o_orderkey % 3 = 1 then cast(20 as double) end as deposit, case when o_orderkey % 3 = 0 then false when o_orderkey % 3 = 1 then true end as special,
 case when sale_date is not null then '근저당권 ' || strftime(sale_date, '%Y-%m-%d') || ' ' || cast(o_orderkey % 3 as string) end as lien, greatest(cast(0 as bigint), 30 - datediff('day', deleted_on, date '{AS_OF}')) as days_left,
 case when min_sale_price is null then '-' when min_sale_price >= 1000000000 then format('{{:.0f}}억', round(min_sale_price / 1e8)) when min_sale_price >= 100000000 then format('{{:.1f}}억', round(min_sale_price / 1e8, 1))
 when min_sale_price >= 10000 then format('{{:,}}만', min_sale_price // 10000) else format('{{:,}}', min_sale_price) end as short from props""",
    "props",
)
def _(t):
    k = c("o_orderkey")
    progress = F.when(k % 5 == 0, "0002100001").when(k % 5 == 1, "x0002").when(k % 5 == 2, "77").when(k % 5 == 3, "")
    stopped = F.when(c("state") == "F", "01").otherwise("00")
    rate = F.when(k % 3 == 0, "10").when(k % 3 == 1, "20").otherwise("x")
    item = F.concat(lit("1. "), F.date_format("sale_date", "yyyy.MM.dd"), lit(" 근저당권"))
    lien = sc.primary_lien(F.concat(item, F.repeat(lit(" / 2. 2020.04.10 가압류"), (k % 3).cast("int"))))
    out = t("props").select(
        "docid", sc.market_type(c("usage_lcl_cd"), c("usage_mcl_cd"), c("building_summary")).alias("market"), sc.case_status(progress, stopped).alias("status"), sc.suspension_reason(stopped, lit(" 사유 ")).alias("reason"),
        sc.deposit_rate(rate).alias("deposit"), sc.special_deposit(rate).alias("special"), lien.alias("l"), sc.sold_days_left(c("deleted_on").cast("timestamp"), lit(AS_OF).cast("timestamp")).cast("bigint").alias("days_left"),
        sc.money_short(c("min_sale_price")).alias("short"),
    )
    told = F.concat("l.kind", lit(" "), c("l.date").cast("string"), lit(" "), F.size("l.others").cast("string"))
    return out.withColumn("lien", told).withColumn("days_left", F.when(c("days_left").isNotNull(), c("days_left"))).drop("l")


@query("b22_pyeong", "select docid, case when conv_addr like '%㎡%' then regexp_extract(conv_addr, '^(.*?)[0-9.]+㎡', 1) || format('{:,.2f}', try_cast(regexp_extract(conv_addr, '([0-9.]+)㎡', 1) as double) / 3.305785) || '평]' else conv_addr end as area from props", "props")
def _(t):
    return t("props").select("docid", sc.area_to_pyeong(c("conv_addr")).alias("area"))


@query(
    "b33_jp_properties",
    """select sale_unit_id, court_id as court_code, case_no, cast(regexp_extract(case_no, '第([0-9]+)号', 1) as int) as number, case when photo_url like '/data/image/%' then greatest(1, cast(o_orderkey % 6 as int)) else 1 end as property_seq,
 case trim(sale_cls_label) when '土地' then '1' when '戸建て' then '2' when 'マンション' then '3' when 'その他' then '4' end as sale_cls,
 case status_text when '期間入札' then 'period_bid' when '特別売却' then 'special_sale' when '売却中止' then 'aborted' when '停止' then 'aborted' end as status,
 replace(replace(replace(replace(replace(address, '　', ' '), '１', '1'), '２', '2'), '３', '3'), '０', '0') as address, coalesce(standard_price <= 100000, false) as trap from jp where case_no is not null""",
    "jp",
)
def _(t):
    out = cards.to_jp_properties(t("jp"))
    return out.select("sale_unit_id", "court_code", "case_no", "case_parts.number", "property_seq", "sale_cls", "status", c("address_normalized").alias("address"), c("yen_10k_trap").alias("trap"))


@query("b33_courts", "select court_id as code, 'court ' || court_id as name from jp group by 1 union all select 'X' || s_suppkey, s_name from courts_x", "jp", "courts_x")
def _(t):
    old = t("courts_x").select(F.concat(lit("X"), c("s_suppkey")).alias("code"), c("s_name").alias("name"))
    return cards.register_courts(old, t("jp").withColumn("court_name", F.concat(lit("court "), "court_id")))


@query(
    "b34_jp_areas",
    "select sale_unit_id, (o_orderkey % 300) || '.25㎡ / ' || (o_orderkey % 7 + 1) || '㎡' as area, cast(o_orderkey % 300 as double) + 0.25 as m2, case when o_orderkey % 2 = 0 then '101' end as unit from jp",
    "jp",
)
def _(t):
    k = c("o_orderkey")
    one = F.create_map(lit("土地面積（登記）"), lit(""), lit("床面積（登記）"), F.concat((k % 300).cast("string"), lit(".25m 2")), lit("号室"), F.when(k % 2 == 0, " 101 "))
    two = F.create_map(lit("専有面積（登記）"), F.concat((k % 7 + 1).cast("string"), lit("㎡")), lit("x"), lit("y"), lit("号室"), lit(None).cast("string"))
    fields = F.array(one, two)
    return t("jp").select("sale_unit_id", details.jp_area_text(fields).alias("area"), details.jp_area_m2(fields).alias("m2"), details.jp_unit_no(fields).alias("unit"))


# --- filters, joins, pages
@query(
    "c4_status_modes",
    f"select 'active' as mode, count(*) as n from props where deleted_on is null union all select 'with_sold', count(*) from props where {VISIBLE} union all select 'sold_only', count(*) from props where sold",
    "props",
)
def _(t):
    count = lambda m: t("props").where(filters.status_mode(m, AS_OF)).agg(lit(m).alias("mode"), F.count(lit(1)).alias("n"))
    return count("active").unionByName(count("with_sold")).unionByName(count("sold_only"))


@query("c6_territory", "select docid from props where lng between 124 and 132 and lat between 33 and 39 and usage_nm in ('아파트', '전답')", "props")
def _(t):
    return t("props").where(filters.in_territory() & filters.in_usage(["아파트", "전답"])).select("docid")


@query("c8_jp_filter", "select sale_unit_id from jp where status = 'period_bid' and standard_price >= 100000 and standard_price <= 900000 and o_orderkey % 2 = 0 and detail like '%true%' and case_no like '%令和04年%'", "jp")
def _(t):
    tags = F.when(c("o_orderkey") % 2 == 0, F.array(lit("bessou"), lit("akiya"))).otherwise(F.array(lit("tousho")))
    given = {"status": "period_bid", "min_price": 10, "max_price": 90, "categories": ["akiya", "rizoto"], "has_pdf": True, "keyword": "令和04年"}
    return details.jp_filter(t("jp").withColumn("categories", tags), given).select("sale_unit_id")


@query("c9_flags", "select docid, o_orderkey % 3 <> 0 as excluded, o_orderkey % 3 = 1 as any from props", "props")
def _(t):
    k = c("o_orderkey")
    rows = t("props").withColumn("f", F.when(k % 3 == 0, F.array(lit("a"), lit("b"))).when(k % 3 == 1, F.array(lit("c"))))
    return rows.select("docid", filters.exclude_flags("f", ["a"]).alias("excluded"), filters.has_any("f", ["c", "d"]).alias("any"))


@query("c10_markers", "select docid, case when sold then 'sold' else usage_lcl_cd end as marker from props where case when sold then true else usage_lcl_cd in ('20000', '10000') end", "props")
def _(t):
    return filters.markers(t("props"), ("20000", "10000", "sold")).select("docid", "marker")


@query("d1_finalizable", "select count(*) as n from props where deleted_on is not null and sold is null and docid in (select docid from results)", "props", "results")
def _(t):
    return joins.count_finalizable(t("props"), t("results"))


@query("d4_masters", "select sd_code, max(sgg_code) as sgg_code, sgg_name from sgg group by sd_code, sgg_name", "sgg")
def _(t):
    return joins.canonical_masters(t("sgg")).select("sd_code", "sgg_code", "sgg_name")


@query(
    "d5_training_rows",
    "select r.docid, r.sale_amount, conv_addr, p.usage_nm as prop_usage from results r left join props p using (docid) where r.sale_amount > 0 and r.appraisal_amount > 0",
    "results", "props",
)
def _(t):
    return details.training_rows(t("results"), t("props")).select("docid", "sale_amount", "conv_addr", "prop_usage")


@query("d8_attach", "select props.docid, building_year, fetch_status from props left join register using (docid)", "props", "register")
def _(t):
    return details.attach(t("props"), t("register"), ["building_year", "fetch_status"]).select("docid", "building_year", "fetch_status")


@query(
    "d9_listing_view",
    "select docid, 'T' || o_orderkey as title, court_name, false as jp from props left join courts using (court_code) where o_orderkey % 3 <> 0 union all "
    "select docid, 'T' || o_orderkey, court_name, true from props join courts using (court_code) where o_orderkey % 3 <> 0 and court_code < 'B000005'",
    "props", "courts",
)
def _(t):
    props = t("props").select("docid", "court_code", "case_no", "o_orderkey")
    cases = props.where("o_orderkey % 3 <> 0").select("court_code", "case_no", F.concat(lit("T"), c("o_orderkey")).alias("title"))
    kr = details.listing_view(props, cases, t("courts")).select("docid", "title", "court_name", lit(False).alias("jp"))
    jp = details.jp_listing_view(props, cases, t("courts").where("court_code < 'B000005'"))
    return kr.unionByName(jp.select("docid", "title", "court_name", lit(True).alias("jp")))


@query("e11_suspects", "select docid from props where deleted_on is null and usage_lcl_cd = '20000' and (usage_mcl_cd like '301%' or usage_mcl_cd like '311%' or building_summary like '%차량%' or o_orderkey % 14 = 3)", "props")
def _(t):
    noted = t("props").withColumn("building_summary", F.when(c("o_orderkey") % 14 == 3, "자동차 관련시설").otherwise(c("building_summary")))
    return stats.suspect_vehicles(noted).select("docid")


@query("g1_total", "select count(*) as total from props where deleted_on is null and usage_lcl_cd = '20000'", "props")
def _(t):
    return filters.page_total(filters.filter_listings(t("props"), {"usage_lcl_cd": "20000"}, AS_OF))


JP_SORTED = {"sale_unit_id": "sale_unit_id", "sale_cls": "sale_cls_label", "price": "standard_price", "bid_period": "fetched_on", "status": "status", "address": "address", "none": "fetched_on"}


@query(
    "g1_jp_page",
    ", z as ("
    + " union all ".join(
        f"(select '{m} {d}' as page, sale_unit_id from jp order by {x} {'asc' if m == 'none' else d} nulls last, sale_unit_id offset 50 limit 50)" for m, x in JP_SORTED.items() for d in ("asc", "desc")
    )
    + ") select * from z",
    "jp",
)
def _(t):
    rows = t("jp").select("sale_unit_id", c("sale_cls_label").alias("sale_cls"), "standard_price", c("fetched_on").alias("bid_start"), "status", c("address").alias("address_text"))
    out = None
    for m in JP_SORTED:
        for d in ("asc", "desc"):
            page = filters.jp_page(rows, m, d == "asc", 2, 50).select(lit(f"{m} {d}").alias("page"), "sale_unit_id")
            out = page if out is None else out.unionByName(page)
    return out


@query("g2_detail_queue", "select docid from props where deleted_on is null and (o_orderkey % 3 = 0 or o_orderkey % 5 = 0) order by sale_date nulls last, docid limit 200", "props")
def _(t):
    k = c("o_orderkey")
    rows = t("props").withColumn("synced_on", F.when(k % 3 != 0, lit(AS_OF))).withColumn("refresh", F.when(k % 5 == 0, True))
    return details.detail_queue(rows, 200).select("docid")


# --- sets and state
@query(
    "h1_merge_categories",
    """select docid, case when o_orderkey % 4 = 3 then 'whole_building' when o_orderkey % 4 = 0 then 'farm_house,whole_building' when o_orderkey % 4 = 1 and house then 'townhouse' else '' end as tags
 from (select *, o_orderkey % 2 = 0 or o_orderkey % 3 = 0 as house from props)""",
    "props",
)
def _(t):
    k = c("o_orderkey")
    some = lambda *x: F.array(*map(lit, x)).cast("array<string>")
    rule = F.when(k % 4 == 0, some("whole_building")).when(k % 4 == 3, some("whole_building")).otherwise(some())
    house, banned, force = (k % 2 == 0) | (k % 3 == 0), k % 4 >= 2, k % 4 == 0
    tags = rules.merge_categories(rule, some("farm_house", "junk"), some("townhouse", "other"), house, banned, force)
    return t("props").select("docid", F.array_join(tags, ",").alias("tags"))


@query(
    "h2_jp_merge_categories",
    """select sale_unit_id, concat_ws(',', case when l = '2' then 'akiya' end, case when o_orderkey % 3 = 0 then 'bessou' end, case when o_orderkey % 3 = 0 and (prefecture = '47' or address like '%島%') then 'tousho' end) as tags
 from (select *, case when trim(sale_cls_label) = '戸建て' then '2' else '1' end as l from jp)""",
    "jp",
)
def _(t):
    some = lambda *x: F.array(*map(lit, x)).cast("array<string>")
    kind = F.when(F.trim("sale_cls_label") == "戸建て", "2").otherwise("1")
    tags = rules.jp_merge_categories(some(), some("bessou", "tousho"), some("akiya"), kind, c("prefecture"), c("address"), c("o_orderkey") % 3 == 0)
    return t("jp").select("sale_unit_id", F.array_join(tags, ",").alias("tags"))


@query("h3_union_masters", "select court_code as code, court_name as name from courts union all select 'O' || s_suppkey, s_name from courts_x", "courts", "courts_x")
def _(t):
    b = t("courts").select(c("court_code").alias("code"), c("court_name").alias("name"))
    o = b.withColumn("name", lit("loses")).unionByName(t("courts_x").select(F.concat(lit("O"), c("s_suppkey")).alias("code"), c("s_name").alias("name")))
    return details.union_masters(b, o, "code")


@query("i4_jp_close_aged", f"select sale_unit_id, case when coalesce(status, '') not in ('closed', 'aborted') and fetched_on < date '{AS_OF}' - 300 then 'closed' else status end as status from jp", "jp")
def _(t):
    return details.jp_close_aged(t("jp").withColumn("fetched_at", c("fetched_on")), F.date_sub(lit(AS_OF).cast("date"), 300)).select("sale_unit_id", "status")


JP_DETAIL = ", d as (select sale_unit_id, case when o_orderkey % 3 = 0 then standard_price + 1 when o_orderkey % 3 = 1 then standard_price end as p from jp where o_orderkey % 2 = 0)"


def _jp_detail(t):
    k, rows = c("o_orderkey"), t("jp").select("sale_unit_id", "standard_price", "o_orderkey")
    found = rows.where("o_orderkey % 2 = 0").select("sale_unit_id", F.when(k % 3 == 0, c("standard_price") + 1).when(k % 3 == 1, c("standard_price")).alias("standard_price"))
    return details.jp_apply_detail(rows, found, "sale_unit_id", ["standard_price"], [])


@query("i5_jp_apply_detail", JP_DETAIL + " select jp.sale_unit_id, coalesce(p, standard_price) as standard_price from jp left join d using (sale_unit_id)", "jp")
def _(t):
    return _jp_detail(t)[0].select("sale_unit_id", "standard_price")


@query("i5_jp_history", JP_DETAIL + " select sale_unit_id, p as standard_price, standard_price as prev_standard_price from jp join d using (sale_unit_id) where p <> standard_price", "jp")
def _(t):
    return _jp_detail(t)[1]


@query("i7_sync_score", "select docid, coalesce(building_year % 101, safety) as safety, building_year % 101 is not null and building_year % 101 <> safety as synced from props left join register using (docid)", "props", "register")
def _(t):
    scores = t("register").select("docid", (c("building_year") % 101).alias("score"))
    return merge.sync_where_distinct(t("props"), scores, "docid", "safety", "score").select("docid", "safety", "synced")


@query(
    "i8_refill_coordinates",
    """select outcome, count(*) as n, round(sum(case when outcome = 'updated' then lng + 0.01 else lng end), 4) as total from (select *, case when lng is null then 'skipped' when o_orderkey % 2 = 0 then 'updated' else 'noop' end as outcome from props) group by 1""",
    "props",
)
def _(t):
    moved = F.when(c("o_orderkey") % 2 == 0, 0.01).otherwise(0.00001)
    found = t("props").select("docid", (c("lng") + moved).alias("lng"), c("lat"))
    out = details.refill(t("props").select("docid", "lng", "lat"), found, "docid", ["lng", "lat"], tolerance=1e-4)
    return out.groupBy("outcome").agg(F.count(lit(1)).alias("n"), F.round(F.sum("lng"), 4).alias("total"))


@query("i9_refill_flags", "select docid, case when o_orderkey % 3 = 0 then 'a,b' when o_orderkey % 3 = 1 then 'a,b' else 'old' end as flags, o_orderkey % 3 = 1 as changed from props", "props")
def _(t):
    k = c("o_orderkey")
    some = lambda *x: F.array(*map(lit, x)).cast("array<string>")
    rows = t("props").select("docid", F.when(k % 3 == 0, some("b", "a")).when(k % 3 == 2, some("old")).alias("flags"), "o_orderkey")
    empty = details.refill_arrays(rows.where("o_orderkey % 3 <> 0"), "flags", some("b", "a"), False)
    every = details.refill_arrays(rows.where("o_orderkey % 3 = 0"), "flags", some("b", "a"), True)
    return empty.unionByName(every).select("docid", F.array_join("flags", ",").alias("flags"), F.coalesce("changed", lit(False)).alias("changed"))


@query("i11_geocodes", "select docid, case when o_orderkey % 2 = 0 and lng is not null and o_orderkey % 3 = 0 then 'new ' || docid when o_orderkey % 2 = 1 then road_addr end as road_addr from props", "props")
def _(t):
    rows = t("props").withColumn("road_addr", F.when(c("o_orderkey") % 2 == 1, c("road_addr")))
    found = details.geocode_candidates(rows).where("o_orderkey % 3 = 0").select("docid", F.concat(lit("new "), "docid").alias("road_addr"))
    return details.apply_geocodes(rows, found, "docid").select("docid", "road_addr")


@query(
    "k7_caveats",
    REGION + " select docid, concat_ws(',', case when total_count < 30 or avg_rate is null then 'low_confidence' end, case when avg_rate is null then 'region' end, case when usage_nm is null then 'usage' end) as caveats from rs join props using (docid)",
    "props", "results",
)
def _(t):
    region = joins.region_stat_for(t("props"), stats.stats_by_region(t("results"), AS_OF))
    method = F.when(c("avg_rate").isNull(), "region_avg").otherwise("model")
    found = details.estimate_caveats(method, c("total_count"), {"region": c("avg_rate"), "usage": c("usage_nm")})
    return region.join(t("props").select("docid", "usage_nm"), "docid").select("docid", F.array_join(found, ",").alias("caveats"))


# --- operations
OPS_DAY = "2024-01-31"


@query(
    "e10_run_summary",
    f"select kind, count(*) as runs, count(*) filter (where status = 'done') as ok, count(*) filter (where status = 'failed') as failed, count(*) filter (where status = 'running') as still_running, cast(sum(n_rows) as bigint) as total_rows, "
    f"strftime(min(started_at), '%Y-%m-%d %H:%M:%S') as first_started, strftime(max(coalesce(finished_at, started_at)), '%Y-%m-%d %H:%M:%S') as last_active from runs where cast(started_at + interval 9 hour as date) = date '{OPS_DAY}' - 1 group by 1",
    "runs",
)
def _(t):
    stamp = lambda n: F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n)
    return reports.run_summary(t("runs"), OPS_DAY).withColumn("first_started", stamp("first_started")).withColumn("last_active", stamp("last_active"))


@query(
    "e10_week_summary",
    f"select strftime(started_at + interval 9 hour, '%Y-%m-%d') as run_date, kind like 'jp!_%' escape '!' as is_jp, count(*) as runs, count(*) filter (where status = 'done') as ok, count(*) filter (where status = 'failed') as failed from runs where started_at > timestamp '{OPS_DAY}' - interval 7 day group by 1, 2",
    "runs",
)
def _(t):
    return reports.week_summary(t("runs"), OPS_DAY).withColumn("run_date", text("run_date"))


@query(
    "e10_recent_failures",
    f"select run_id, kind, strftime(started_at + interval 9 hour, '%Y-%m-%d %H:%M:%S') as kst, error from runs where status = 'failed' and started_at > timestamp '{OPS_DAY}' - interval 3 day order by started_at desc, run_id limit 20",
    "runs",
)
def _(t):
    return reports.recent_failures(t("runs"), OPS_DAY).withColumn("kst", F.date_format("kst", "yyyy-MM-dd HH:mm:ss"))


@query(
    "e10_dead_letters",
    f"select endpoint, count(*) as n, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') as latest from dead where occurred_at > timestamp '{OPS_DAY}' - interval 7 day and resolved_at is null group by 1 order by n desc, endpoint limit 20",
    "dead",
)
def _(t):
    return reports.dead_letter_summary(t("dead"), OPS_DAY).withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


@query("e10_jp_freshness", "select prefecture, count(*) as n, count(detail) as with_detail, strftime(max(fetched_on) + interval 9 hour, '%Y-%m-%d %H') as latest_jst from jp group by 1", "jp")
def _(t):
    rows = t("jp").withColumn("updated_at", c("fetched_on").cast("timestamp"))
    return reports.jp_freshness(rows).withColumn("latest_jst", F.date_format("latest_jst", "yyyy-MM-dd HH"))


YEN = "coalesce(format('{{:,}}円', {v}), '—')"


@query(
    "a8_jp_report",
    "select sale_unit_id, coalesce(case_no, sale_unit_id) || '.md' as filename, concat_ws(chr(10), '# 🇯🇵 ' || coalesce('地裁 ' || case_no, 'BIT ' || sale_unit_id), '', '> Generated from /jp/p/' || sale_unit_id, '', '## 메타', "
    "'- **사건번호**: `' || coalesce(case_no, sale_unit_id) || '`', '- **법원**: 地裁 (courtId=' || court_id || ')', '- **종별**: ' || coalesce(sale_cls_label, '—'), '- **상태**: ' || case status when 'closed' then '終結' when 'period_bid' then '期間入札' end, "
    "case when standard_price <= 100000 then '- ⚠ **1万円 함정 의심** (売却基準価額 ≤ 100,000円)' end, '- **BIT saleUnitId**: `' || sale_unit_id || '`', '', '## 3종 가격', '| 항목 | 금액 | 비고 |', '|---|---:|---|', "
    "'| 売却基準価額 | ' || " + YEN.format(v="standard_price") + " || ' | 법원이 정한 기준가 |', '| 買受可能価額 | — | 매수 가능 최저가 (= 기준 × 80%) |', '| 買受申出保証金 | ' || " + YEN.format(v="deposit")
    + " || ' | 입찰 보증금 (= 기준 × 20%) |', '| 鑑定評価額 | (미수집) | 상세 페이지 추가 정찰 필요 |', '', '## 매각 일정', '- **公示開始日**: —', '- **閲覧開始日**: ' || strftime(fetched_on, '%Y-%m-%d'), '- **入札期間**: ' || strftime(fetched_on, '%Y-%m-%d') || ' ~ ?', "
    "'- **開札期日**: —', '- **売却決定期日**: —', '- **特別売却期間**: —', '', '## 위치', '- **所在地**: ' || address, '', '## 物件 명세', '### 1', '| 항목 | 값 |', '|---|---|', '| 地積 | ' || (o_orderkey % 90) || ' |', '', "
    "case when photo_url is not null then concat_ws(chr(10), '## 사진', '- ' || photo_url, '') end, '## 원본', '- **BIT 사이트**: <https://www.bit.courts.go.jp/>', '  - 상세 페이지: /jp/p/' || sale_unit_id, '') as markdown from jp",
    "jp",
)
def _(t):
    day = F.date_format("fetched_on", "yyyy-MM-dd")
    item = F.struct(lit("1").alias("head"), F.create_map(lit("地積"), (c("o_orderkey") % 90).cast("string")).alias("fields"))
    empty = F.struct(lit("2").alias("head"), F.create_map().cast("map<string,string>").alias("fields"))
    rows = t("jp").select(
        "sale_unit_id", "case_no", lit("地裁").alias("court_name"), c("court_id").alias("court_code"), "sale_cls_label", "status", cards.card_price_trap(c("standard_price")).alias("yen_10k_trap"), "standard_price", "deposit",
        day.alias("view_start"), day.alias("bid_start"), c("address").alias("address_text"), F.array(item, empty).alias("items"),
    )
    photos = t("jp").where("photo_url is not null").select("sale_unit_id", lit(1).alias("seq"), "photo_url")
    return reports.jp_report(rows, photos)


@query(
    "a8_jp_sections",
    "select sale_unit_id, coalesce(case_no, sale_unit_id) || '.md' as filename, concat_ws(chr(10), '# 🇯🇵 ' || coalesce(case_no, 'BIT ' || sale_unit_id), '', '> Generated from https://listings.example/jp/p/' || sale_unit_id, '', '## 메타', "
    "'- **사건번호**: `' || coalesce(case_no, sale_unit_id) || '`', '- **법원**: —', '- **사건 종류**: ' || case o_orderkey % 3 when 0 then 'ケ (担保不動産競売)' when 1 then 'ヌ (強制競売)' when 2 then 'リ ' end, '- **종별**: —', "
    "'- **상태**: ' || case o_orderkey % 4 when 0 then '評価再調整' when 1 then '再入札' when 2 then '中止' else 'unknown' end, "
    "case when detail like '%true%' then '- 📑 **三点セット PDF 제공** — `https://listings.example/api/jp/pdf/' || sale_unit_id || '`' end, '- **BIT saleUnitId**: `' || sale_unit_id || '`', '', '## 3종 가격', '| 항목 | 금액 | 비고 |', '|---|---:|---|', "
    "'| 売却基準価額 | — | 법원이 정한 기준가 |', '| 買受可能価額 | ' || " + YEN.format(v="standard_price") + " || ' | 매수 가능 최저가 (= 기준 × 80%) |', '| 買受申出保証金 | — | 입찰 보증금 (= 기준 × 20%) |', '| 鑑定評価額 | (미수집) | 상세 페이지 추가 정찰 필요 |', '', "
    "'## 매각 일정', '- **公示開始日**: ' || strftime(fetched_on, '%Y-%m-%d'), '- **閲覧開始日**: —', '- **入札期間**: —', '- **開札期日**: ' || strftime(fetched_on, '%Y-%m-%d'), '- **売却決定期日**: ' || strftime(fetched_on, '%Y-%m-%d'), '- **特別売却期間**: ? ~ ' || strftime(fetched_on, '%Y-%m-%d'), '', "
    "case when o_orderkey % 6 <> 5 or o_orderkey % 5 <> 4 then concat_ws(chr(10), '## 위치', case when o_orderkey % 6 <> 5 then concat_ws(chr(10), '- **좌표**: `35.5, 139.25` (WGS84)', '  - [Google 지도](https://www.google.com/maps?q=35.5,139.25&z=18)', "
    "'  - [OpenStreetMap](https://www.openstreetmap.org/?mlat=35.5&mlon=139.25&zoom=18)') end, case when o_orderkey % 5 <> 4 then concat_ws(chr(10), '- **교통**:', '  - 駅 ' || o_orderkey, '  - バス') end, '') end, "
    "'## 원본', '- **BIT 사이트**: <https://www.bit.courts.go.jp/>', '  - 매물 상세는 form POST 기반이라 직접 링크 불가. 본 사이트 상세 페이지 (https://listings.example/jp/p/' || sale_unit_id || ') 사용 권장', '', "
    "'---', 'Exported from listings.example · 데이터는 BIT 사이트 정보를 우선 확인하세요') as markdown from jp",
    "jp",
)
def _(t):
    k, day = c("o_orderkey"), F.date_format("fetched_on", "yyyy-MM-dd")
    rows = t("jp").select(
        "sale_unit_id", "case_no", F.when(k % 3 == 0, "ケ").when(k % 3 == 1, "ヌ").otherwise("リ").alias("case_kind"), F.when(k % 4 == 0, "reval_pending").when(k % 4 == 1, "re_bid").when(k % 4 == 2, "aborted").otherwise("unknown").alias("status"),
        (F.get_json_object("detail", "$.has_three_set_pdf") == "true").alias("has_three_set_pdf"), c("standard_price").alias("purchase_price"), day.alias("koji_start"), day.alias("open_date"), day.alias("decision_date"), day.alias("special_end"),
        lit(None).cast("string").alias("special_start"), F.when(k % 6 != 5, 35.5).alias("lat"), lit(139.25).alias("lng"), F.when(k % 5 != 4, F.concat(lit(" 駅 "), k, lit("\n\nバス"))).alias("transit_info"),
    )
    return reports.jp_report(rows, site="https://listings.example", source="BIT 사이트")
