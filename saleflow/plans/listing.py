"""Registered queries over the shaped listing tables, each with its DuckDB SQL written on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleflow.functions import rules
from saleflow.functions import scalars as sc
from saleflow.operators import details, estimate, filters, joins, merge, model, reports, stats, windows
from saleflow.sources import scan

from .shaping import AS_OF, AS_OF_YEAR, oracle, shape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *shapes: str):
    """Register the decorated function of a table getter; `sql` may use the named shapes."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: shape(spark, sf_dir, n))
        if sql:
            ORACLES[name] = oracle(sql, *shapes)
        return f

    return add


def text(c: str):
    return F.col(c).cast("string").alias(c)


STATS = """count(*) as total_count, count(*) filter (where sale_amount > 0) as sold_count,
 count(*) filter (where coalesce(sale_amount, 0) <= 0) as unsold_count,
 cast(round(avg(case when sale_amount > 0 and appraisal_amount > 0 then cast(sale_amount as double) / appraisal_amount * 100 end), 1) as double) as avg_rate,
 cast(round(avg(case when sale_amount > 0 then fail_count end), 1) as double) as avg_fails,
 cast(round(avg(case when sale_amount > 0 then bidder_count end), 1) as double) as avg_bidders, cast(max(sale_date) as string) as latest_sale_date"""


@query(
    "e1_stats_by_region",
    f"select sd_code, sgg_code, usage_lcl_cd, {STATS}, count(*) filter (where sale_amount > 0 and sale_date >= date '{AS_OF}' - interval 90 day) as sold_90_days "
    "from results where sgg_code is not null group by 1, 2, 3",
    "results",
)
def _(t):
    return stats.stats_by_region(t("results"), AS_OF).withColumn("latest_sale_date", text("latest_sale_date"))


@query("e2_stats_by_court", f"select court_code, usage_lcl_cd, {STATS} from results group by 1, 2", "results")
def _(t):
    return stats.stats_by_court(t("results")).withColumn("latest_sale_date", text("latest_sale_date"))


PRICES = """, prices as (select lawd_cd, deal_type, date_trunc('quarter', deal_date) as quarter_start, count(*) as n_deals,
 round(quantile_cont(amount / area, 0.5), 1) as median_price from deals where area > 0 and amount > 0 group by 1, 2, 3)"""


@query(
    "e3_price_by_quarter",
    PRICES + " select lawd_cd, deal_type, strftime(quarter_start, '%Y-%m-%d') as quarter_start, n_deals, median_price, "
    "concat(cast(year(quarter_start) as string), 'Q', cast(quarter(quarter_start) as string)) as label from prices",
    "deals",
)
def _(t):
    return stats.price_by_quarter(t("deals")).withColumn("quarter_start", text("quarter_start"))


@query(
    "e4_latest_price",
    PRICES + " select lawd_cd, deal_type, arg_max(median_price, quarter_start) as latest_price from prices where n_deals >= 3 and median_price is not null group by 1, 2",
    "deals",
)
def _(t):
    return stats.latest_price(stats.price_by_quarter(t("deals")))


@query("e5_segment_counts", "select coalesce(sgg_code, '') as sgg_code, coalesce(usage_lcl_cd, '') as usage_lcl_cd, count(*) as n from results group by 1, 2", "results")
def _(t):
    return stats.segment_counts(t("results"))


@query(
    "e7_matrix_report",
    "select feature, avg(case when v is null then 1.0 else 0.0 end) as missing, count(*) as rows, avg(y) as target_mean, quantile_cont(y, 0.1) as target_p10, quantile_cont(y, 0.9) as target_p90 from "
    "(select unnest(['usage_nm', 'fail_count', 'min_sale_price', 'lot_addr']) as feature, unnest([usage_nm, cast(fail_count as string), cast(min_sale_price as string), lot_addr]) as v, "
    "cast(safety as double) as y from props) group by 1",
    "props",
)
def _(t):
    return stats.matrix_report(t("props").withColumn("y", F.col("safety").cast("double")), ["usage_nm", "fail_count", "min_sale_price", "lot_addr"], "y")


OPS = f""", p as (select *, date '{AS_OF}' - cast(o_orderkey % 40 as int) as first_seen, date '{AS_OF}' - cast(o_custkey % 5 as int) as last_seen,
 case when o_orderkey % 4 = 0 then null else date '{AS_OF}' end as synced_on, case when o_orderkey % 9 = 0 then true end as refresh, case when o_orderkey % 6 = 0 then null else safety end as score,
 case when o_orderkey % 8 = 0 then 'low' else 'high' end as confidence, case when o_orderkey % 3 = 0 then date '{AS_OF}' + cast(o_orderkey % 11 - 3 as int) else sale_date end as day from props)"""


def _ops(t):
    k, as_of = F.col("o_orderkey"), F.lit(AS_OF).cast("date")
    days = lambda c: c.cast("int")
    return t("props").select(
        "*", F.date_sub(as_of, days(k % 40)).alias("first_seen"), F.date_sub(as_of, days(F.col("o_custkey") % 5)).alias("last_seen"), F.when(k % 4 != 0, as_of).alias("synced_on"),
        F.when(k % 9 == 0, True).alias("refresh"), F.when(k % 8 == 0, "low").otherwise("high").alias("confidence"),
        F.when(k % 2 == 0, F.array(F.lit("townhouse"))).otherwise(F.array().cast("array<string>")).alias("categories"),
        F.when(k % 5 == 1, F.array(F.lit("share_sale"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    ).withColumn("safety", F.when(k % 6 != 0, F.col("safety"))).withColumn("sale_date", F.when(k % 3 == 0, F.date_add(as_of, days(k % 11 - 3))).otherwise(F.col("sale_date")))


@query(
    "e9_health_report",
    OPS + f""", c as (select count(*) filter (where a) as active, count(*) filter (where deleted_on >= date '{AS_OF}' - 1) as closed_24h, count(*) filter (where a and day < date '{AS_OF}' - 2) as past_active,
 count(*) filter (where first_seen >= date '{AS_OF}' - 1) as new_24h, count(*) filter (where a and synced_on is null) as backlog,
 count(*) filter (where a and synced_on is null and day between date '{AS_OF}' and date '{AS_OF}' + 7) as backlog_d7, count(*) filter (where a and refresh) as refresh_pending,
 count(*) filter (where a and last_seen < date '{AS_OF}' - 2) as stale, count(*) filter (where a and lng is null) as no_coordinates, count(*) filter (where a and road_addr is null and lot_addr is null) as no_address,
 count(*) filter (where a and usage_nm in ('단독주택', '다가구주택') and o_orderkey % 2 = 1 and conv_addr like '[건물%' and o_orderkey % 5 <> 1) as uncategorised,
 count(*) filter (where a and score is not null) as scored, count(*) filter (where confidence = 'low') as scored_low from (select *, deleted_on is null as a from p)),
 r as (select coalesce(sum(ok) / cast(count(distinct cast(started_at as date)) as double), 0.0) as per_day from runs where kind = 'backfill_details' and started_at - interval 8187 day >= timestamp '{AS_OF}' - interval 7 day)
 select *, case when per_day > 0 then backlog / per_day else cast('infinity' as double) end as drain_days,
 concat_ws(',', case when backlog_d7 > 300 then 'd7_detail_missing' end, case when per_day = 0 or backlog / per_day > 10 then 'slow_drain' end, case when past_active > 300 then 'past_sale_active' end,
 case when stale > 0.1 * active then 'not_seen' end) as warnings from c, r""",
    "props", "runs",
)
def _(t):
    runs = t("runs").withColumn("started_at", F.col("started_at") - F.expr("interval 8187 days"))  # to the listings' years
    return stats.health_report(_ops(t), runs, AS_OF).withColumn("warnings", F.array_join("warnings", ","))


@query("e11_usage_audit", "select usage_lcl_cd, usage_nm, count(*) as n, count(*) filter (where deleted_on is null) as active from props group by 1, 2", "props")
def _(t):
    return stats.usage_audit(t("props"))


@query(
    "e13_group_by_coord",
    "select point, count(*) as n, array_to_string(list_sort(list(docid order by docid)[1:25]), ',') as members from "
    "(select printf('%.6f,%.6f', lng, lat) as point, docid from props where lng is not null) group by 1",
    "props",
)
def _(t):
    return stats.group_by_coord(t("props"))


KIND = """case when usage_lcl_cd = '10000' then 'land' when usage_lcl_cd in ('30000', '40000') then null when regexp_matches(usage_nm, '공장|창고') then 'indu'
 when regexp_matches(usage_nm, '근린|상가') then 'nrg' when usage_nm like '%오피스텔%' then 'offi' when regexp_matches(usage_nm, '단독|다가구') then 'sh'
 when regexp_matches(usage_nm, '연립|다세대|빌라') then 'rh' when usage_nm like '%아파트%' then 'apt' when regexp_matches(usage_nm, '대지|전답|임야') then 'land' end"""


@query(
    "e14_active_region_types",
    f"select distinct * from (select sd_code || sgg_code as lawd_cd, {KIND} as deal_type from props where deleted_on is null union all "
    "select sd_code || sgg_code, 'apt' from props where deleted_on is null) where deal_type is not null and length(lawd_cd) = 5",
    "props",
)
def _(t):
    return stats.active_region_types(t("props"), sc.deal_type(F.col("usage_nm"), F.col("usage_lcl_cd")))


@query("e15_scan_totals", "select coalesce(status, 'all') as status, count(*) as rows, count(distinct user_id) as listings from scan group by rollup (status)", "scan")
def _(t):
    return stats.scan_totals(t("scan"))


@query(
    "b_scalars",
    f"""select docid, trim(regexp_replace(regexp_replace(regexp_replace(road_addr, '\\b0+([0-9]+)', '\\1', 'g'), '-0+\\b', '', 'g'), '\\s+', ' ', 'g')) as road,
 case when appraisal_amount > 0 and min_sale_price is not null then round(cast(min_sale_price as double) / appraisal_amount * 100, 2) end as rate, {KIND} as deal_type,
 try_cast(regexp_extract(conv_addr, '([0-9.]+)㎡', 1) as double) as area, cast(datediff('day', date '{AS_OF}', sale_date) as int) as d_day,
 case when safety >= 80 then '안전' when safety >= 65 then '양호' when safety >= 45 then '주의' else '위험' end as grade,
 case when coalesce(min_sale_price, 0) = 0 or appraisal_amount = 0 then '-' else concat(cast(cast(floor(cast(min_sale_price as double) / appraisal_amount * 100 + 0.5) as bigint) as string), '%') end as share,
 case when sold then 'sold' when usage_lcl_cd is not null then usage_lcl_cd else 'unknown' end as marker from props""",
    "props",
)
def _(t):
    c = F.col
    return t("props").select(
        "docid", sc.clean_addr(c("road_addr")).alias("road"), sc.sale_rate_pct(c("min_sale_price"), c("appraisal_amount")).alias("rate"),
        sc.deal_type(c("usage_nm"), c("usage_lcl_cd")).alias("deal_type"), sc.max_area(c("conv_addr")).alias("area"), sc.d_day(c("sale_date"), AS_OF).alias("d_day"),
        sc.score_grade(c("safety")).alias("grade"), sc.percent(c("min_sale_price"), c("appraisal_amount")).alias("share"), filters.marker_key().alias("marker"),
    )


@query(
    "b23_money",
    """select docid, case when v is null then '-' when v >= 100000000 and (v % 100000000) // 10000 > 0 then concat(cast(v // 100000000 as string), '억 ', format('{:,}', (v % 100000000) // 10000), '만원')
 when v >= 100000000 then concat(cast(v // 100000000 as string), '억원') when v >= 10000 then concat(format('{:,}', v // 10000), '만원') else concat(format('{:,}', v), '원') end as price
 from (select docid, min_sale_price as v from props)""",
    "props",
)
def _(t):
    return t("props").select("docid", sc.money(F.col("min_sale_price")).alias("price"))


VISIBLE = f"(deleted_on is null or (sold and deleted_on >= date '{AS_OF}' - interval 30 day))"


@query(
    "c1_filter_listings",
    "select docid, appraisal_amount, fail_count from props where usage_lcl_cd = '20000' and appraisal_amount >= 50000000 and appraisal_amount <= 300000000 and fail_count >= 2 and safety >= 40 and deleted_on is null",
    "props",
)
def _(t):
    given = {"usage_lcl_cd": "20000", "min_appraisal": 5000, "max_appraisal": 30000, "min_fails": 2, "min_safety": 40, "max_price": 0}
    return filters.filter_listings(t("props"), given, AS_OF).select("docid", "appraisal_amount", "fail_count")


#: Sets of filters, and what they mean in SQL.
FILTER_SETS = [
    ({"court_code": "B000003", "sd_code": "12", "mode": "with_sold"}, f"court_code = 'B000003' and sd_code = '12' and {VISIBLE}"),
    ({"sd_code": "11", "sgg_code": "002", "usage_mcl_cd": "20201"}, "sd_code = '11' and sgg_code = '002' and usage_mcl_cd = '20201' and deleted_on is null"),
    ({"usage_scl_cd": "S3", "max_appraisal": 9000, "min_price": 100, "max_price": 20000}, "o_orderkey % 9 = 3 and appraisal_amount <= 90000000 and min_sale_price >= 1000000 and min_sale_price <= 200000000 and deleted_on is null"),
    ({"max_fails": 1, "min_rate": 70, "max_rate": 85, "mode": "active"}, "fail_count <= 1 and rate >= 70 and rate <= 85 and deleted_on is null"),
    ({"date_from": "1995-03-01", "date_to": "1995-09-30", "has_road": True, "mode": "sold_only", "upcoming": True}, "sale_date between date '1995-03-01' and date '1995-09-30' and o_orderkey % 4 <> 0 and sold"),
    ({"has_road": False, "upcoming": True, "min_safety": 90}, f"o_orderkey % 4 = 0 and sale_date >= date '{AS_OF}' and safety >= 90 and deleted_on is null"),
    ({"has_road": False, "min_fails": 0, "mode": "sold_only"}, "o_orderkey % 4 = 0 and sold"),
]


@query(
    "c1_filter_sets",
    ", r as (select *, round(cast(min_sale_price as double) / appraisal_amount * 100, 2) as rate from props) "
    + " union all ".join(f"select {i} as filters, docid from r where {sql}" for i, (_, sql) in enumerate(FILTER_SETS)),
    "props",
)
def _(t):
    k = F.col("o_orderkey")
    rows = t("props").withColumn("usage_scl_cd", F.concat(F.lit("S"), k % 9)).withColumn("road_addr", F.when(k % 4 != 0, F.col("road_addr")))
    rows = rows.withColumn("sale_rate", sc.sale_rate_pct(F.col("min_sale_price"), F.col("appraisal_amount")))
    out = None
    for i, (given, _sql) in enumerate(FILTER_SETS):
        some = filters.filter_listings(rows, given, AS_OF).select(F.lit(i).alias("filters"), "docid")
        out = some if out is None else out.unionByName(some)
    return out


@query("c2_keyword", "select docid, lot_addr from props where lot_addr ilike '%lot 12%' or road_addr ilike '%lot 12%' or conv_addr ilike '%lot 12%'", "props")
def _(t):
    return t("props").where(filters.keyword("LOT 12%")).select("docid", "lot_addr")


@query("c3_visible", f"select docid, sold from props where {VISIBLE}", "props")
def _(t):
    return t("props").where(filters.visible(AS_OF)).select("docid", "sold")


@query("c5_visible_rounds", f"select docid, count(*) as n from rounds where docid in (select docid from props where {VISIBLE}) group by 1", "props", "rounds")
def _(t):
    return filters.visible_children(t("rounds"), t("props"), AS_OF).groupBy("docid").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c7_within_radius",
    "select docid from props where 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(36.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(36.5)) * pow(sin(radians(127.5 - lng) / 2), 2)))) <= 30000",
    "props",
)
def _(t):
    return t("props").where(filters.within_radius(127.5, 36.5, 30_000)).select("docid")


@query("d1_finalize_sold", """, r as (select docid, arg_max(sale_amount, sale_date) as a, count(*) as k from results group by 1)
 select docid, case when deleted_on is not null and sold is null and k is not null then coalesce(a > 0, false) else sold end as sold,
 case when deleted_on is not null and sold is null and k is not null and a > 0 then a end as sold_amount from props left join r using (docid)""", "props", "results")
def _(t):
    return joins.finalize_sold(t("props"), t("results")).select("docid", "sold", "sold_amount")


@query(
    "d2_sale_archive",
    """select r.docid, r.sd_code, r.sgg_code, r.emd_code, cast(r.sale_date as string) as sale_date, r.sale_amount, round(cast(r.sale_amount as double) / r.appraisal_amount * 100, 1) as rate,
 coalesce(r.usage_nm, p.usage_nm) as usage, lot_addr from results r left join props p on r.docid = p.docid where r.sale_amount > 0""",
    "results", "props",
)
def _(t):
    return joins.sale_archive(t("results"), t("props")).withColumn("sale_date", text("sale_date"))


@query(
    "d3_code_names",
    "select docid, court_name, sgg_name, sd_name, nullif(concat_ws(' › ', u.name, v.name), '') as usage_label from props left join courts using (court_code) left join sgg using (sd_code, sgg_code) "
    "left join sd using (sd_code) left join usage u on u.code = usage_lcl_cd left join usage v on v.code = usage_mcl_cd",
    "props", "courts", "sgg", "sd", "usage",
)
def _(t):
    named = joins.resolve_code_names(t("props"), t("courts"), t("sgg")).join(t("sd"), "sd_code", "left")
    return joins.usage_label(named, t("usage")).select("docid", "court_name", "sgg_name", "sd_name", "usage_label")


@query(
    "d4_canonical_sgg",
    ", m as (select sd_code, sgg_code, max(sgg_code) over (partition by sd_code, sgg_name) as c from sgg) "
    "select docid, coalesce(c, p.sgg_code) as sgg_code from props p left join m on p.sd_code = m.sd_code and p.sgg_code = m.sgg_code",
    "props", "sgg",
)
def _(t):
    return joins.canonicalize_sgg(t("props"), t("sgg")).select("docid", "sgg_code")


@query(
    "d6_register_candidates",
    f""", p as (select * exclude (emd_code), case when o_orderkey % 14 <> 0 then emd_code end as emd_code, case when o_orderkey % 9 <> 0 then (o_custkey % 900) || '-' || (o_orderkey % 4) end as lot_no from props)
 select docid, sd_code, sgg_code, emd_code, lot_no from p where deleted_on is null and usage_lcl_cd = '20000' and emd_code is not null and lot_no is not null and not exists
 (select 1 from register r where r.docid = p.docid and (fetch_status in ('ok', 'not_found') or fetched_on > date '{AS_OF}' - interval 30 day)) order by docid limit 500""",
    "props", "register",
)
def _(t):
    k = F.col("o_orderkey")
    lot = F.concat((F.col("o_custkey") % 900).cast("string"), F.lit("-"), (k % 4).cast("string"))
    rows = t("props").withColumn("emd_code", F.when(k % 14 != 0, F.col("emd_code"))).withColumn("lot_no", F.when(k % 9 != 0, lot))
    return joins.register_candidates(rows, t("register"), AS_OF, 500)


@query("d7_backlog", "select docid from props where lng is not null and docid not in (select docid from register)", "props", "register")
def _(t):
    return joins.anti_backlog(t("props"), t("register"), F.col("lng").isNotNull()).select("docid")


@query("d7_photo_backlog", "select docid, seq from rounds_seq where path is null order by docid, seq limit 400".replace("rounds_seq", "(select docid, seq, case when (l_partkey + l_suppkey) % 3 = 0 then docid end as path from (select * from rounds qualify row_number() over (partition by docid, seq order by l_partkey desc, l_suppkey desc, round_price desc, round_date desc) = 1))"), "rounds")
def _(t):
    photos = windows.dedupe_last(t("rounds"), ["docid", "seq"], ["l_partkey", "l_suppkey", "round_price", "round_date"])
    return joins.photo_backlog(photos.withColumn("storage_path", F.when((F.col("l_partkey") + F.col("l_suppkey")) % 3 == 0, F.col("docid"))), 400)


@query("d7_jp_photo_backlog", "select sale_unit_id, photo_url from jp where photo_url <> '' and o_orderkey % 5 <> 0 order by sale_unit_id limit 300", "jp")
def _(t):
    return joins.jp_photo_backlog(t("jp"), t("jp").where("o_orderkey % 5 = 0"), 300)


@query(
    "d10_prior_round_ceiling",
    "select docid, min(round_price) as ceiling from props join rounds using (docid) where round_price > 0 and round_date < sale_date group by 1",
    "props", "rounds",
)
def _(t):
    return joins.prior_round_ceiling(t("props"), t("rounds"))


REGION = """, s as (select sd_code, sgg_code, usage_lcl_cd, count(*) as total_count, round(avg(case when sale_amount > 0 and appraisal_amount > 0
 then cast(sale_amount as double) / appraisal_amount * 100 end), 1) as avg_rate from results where sgg_code is not null group by 1, 2, 3),
 big as (select * from s qualify row_number() over (partition by sd_code, sgg_code order by total_count desc, coalesce(usage_lcl_cd, '') desc) = 1),
 rs as (select docid, avg_rate, total_count from props left join s using (sd_code, sgg_code, usage_lcl_cd) where usage_lcl_cd is not null union all
 select docid, avg_rate, total_count from props left join big using (sd_code, sgg_code) where props.usage_lcl_cd is null)"""


@query(
    "d11_region_stat",
    REGION + """, n as (select rs.*, case when o_orderkey % 7 = 0 then avg_rate else round(cast(min_sale_price as double) / appraisal_amount * 100, 2) end as rate from rs join props using (docid))
 select docid, avg_rate, total_count, case when rate < avg_rate then '현재 최저가는 평균 매각가율보다 ' || cast(round(avg_rate - rate) as bigint) || '%p 낮음 — 잠재 할인'
 when rate > avg_rate then '현재 최저가는 평균 매각가율보다 ' || cast(round(rate - avg_rate) as bigint) || '%p 높음 — 가격 매력 약함' when rate = avg_rate then '평균 수준' end as note from n""",
    "props", "results",
)
def _(t):
    region = joins.region_stat_for(t("props"), stats.stats_by_region(t("results"), AS_OF))
    own = t("props").select("docid", "o_orderkey", sc.sale_rate_pct(F.col("min_sale_price"), F.col("appraisal_amount")).alias("own"))
    rate = F.when(F.col("o_orderkey") % 7 == 0, F.col("avg_rate")).otherwise(F.col("own"))
    return region.join(own, "docid").select("docid", "avg_rate", "total_count", joins.rate_note(rate, F.col("avg_rate")).alias("note"))


@query(
    "f1_dedupe_last",
    "select user_id, status, price, event_id from scan qualify row_number() over (partition by user_id order by seen_at desc, event_id desc) = 1",
    "scan",
)
def _(t):
    rows = t("scan").select("user_id", "seen_at", "event_id", "status", "price")
    return windows.dedupe_last(rows, ["user_id"], ["seen_at", "event_id"]).select("user_id", "status", "price", "event_id")


ROUNDS = ", one as (select * from rounds qualify row_number() over (partition by docid, seq order by l_partkey desc, l_suppkey desc, round_price desc, round_date desc) = 1)"
CURRENT = """, cur as (select docid, arg_min(round_price, seq) as current_price from props join one using (docid) where deleted_on is null and result_cd is null
 and round_price > 0 and kind_cd = '01' and round_date = sale_date group by 1)"""


def _rounds(t):
    return windows.dedupe_last(t("rounds"), ["docid", "seq"], ["l_partkey", "l_suppkey", "round_price", "round_date"])


@query("f2_current_round", ROUNDS + CURRENT + " select * from cur", "props", "rounds")
def _(t):
    return windows.current_round(t("props"), _rounds(t))


@query(
    "i6_sync_min_price",
    ROUNDS + CURRENT + " select docid, coalesce(current_price, min_sale_price) as min_sale_price, current_price is not null and current_price is distinct from min_sale_price as synced from props left join cur using (docid)",
    "props", "rounds",
)
def _(t):
    props = t("props")
    return merge.sync_where_distinct(props, windows.current_round(props, _rounds(t)), "docid", "min_sale_price", "current_price").select("docid", "min_sale_price", "synced")


@query("f3_first_round", "select docid, arg_min(seq, (seq, l_partkey, l_suppkey)) as seq, arg_min(l_partkey, (seq, l_partkey, l_suppkey)) as l_partkey from rounds where result_cd is null group by 1", "rounds")
def _(t):
    rows = t("rounds").withColumn("r", F.struct("seq", "l_partkey", "l_suppkey"))
    return windows.first_by(rows, "docid", "r", "r", F.col("result_cd").isNull()).select("docid", "r.seq", "r.l_partkey")


@query(
    "f4_regional_cases",
    """, sold as (select * from results where sale_amount > 0), near as (select *, row_number() over (partition by sd_code, sgg_code, emd_code order by sale_date desc, docid) as rank,
 count(*) over (partition by sd_code, sgg_code, emd_code) as k from sold), wide as (select *, row_number() over (partition by sd_code, sgg_code order by sale_date desc, docid) as rank from sold)
 select p.docid, n.docid as case_docid, n.sale_amount, cast(n.rank as int) as rank, 'emd' as scope from props p join near n using (sd_code, sgg_code, emd_code) where k >= 3 and rank <= 8
 union all select p.docid, w.docid, w.sale_amount, cast(w.rank as int), 'sgg' from props p join wide w using (sd_code, sgg_code) where rank <= 8 and not exists
 (select 1 from near n where n.sd_code = p.sd_code and n.sgg_code = p.sgg_code and n.emd_code = p.emd_code and k >= 3)""",
    "props", "results",
)
def _(t):
    return windows.regional_cases(t("props"), t("results"))


@query(
    "f4_cases_by_usage",
    """, sold as (select * from results where sale_amount > 0), x as (select p.docid, p.emd_code, r.docid as case_docid, r.sale_amount, r.sale_date, r.emd_code as other from props p join sold r using (sd_code, sgg_code) where p.usage_lcl_cd is null or p.usage_lcl_cd = r.usage_lcl_cd),
 k as (select docid, count(*) filter (emd_code = other) as k from x group by 1), y as (select x.*, k >= 3 as close from x join k using (docid) where k < 3 or emd_code = other),
 z as (select docid, case_docid, sale_amount, cast(row_number() over (partition by docid order by sale_date desc, case_docid) as int) as rank, case when close then 'emd' else 'sgg' end as scope from y)
 select docid, case_docid, sale_amount, rank, scope from props left join (select * from z where rank <= 8) using (docid)""".replace("from props p join sold", "from (select docid, sd_code, sgg_code, emd_code, usage_lcl_cd from props) p join sold"),
    "props", "results",
)
def _(t):
    return windows.regional_cases(t("props"), t("results"), by_usage=True, keep_missing=True)


@query(
    "f5_change_runs",
    "select event_id, user_id, status, prev_status from (select *, lag(status) over (partition by user_id order by seen_at, event_id) as prev_status, row_number() over (partition by user_id order by seen_at, event_id) as n from scan) where n > 1 and status is distinct from prev_status",
    "scan",
)
def _(t):
    return windows.change_runs(t("scan"), "user_id", ["seen_at", "event_id"], ["status"]).select("event_id", "user_id", "status", "prev_status")


@query("g1_list_page", "select docid, min_sale_price from props where deleted_on is null order by min_sale_price desc nulls last, docid offset 40 limit 20", "props")
def _(t):
    return filters.list_page(t("props").where("deleted_on is null"), "price_desc", 3, 20).select("docid", "min_sale_price")


@query("g3_plan_fetch", f""", regions as (select distinct lawd_cd, deal_type from deals), log as (select lawd_cd, deal_type, strftime(deal_date, '%Y%m') as month, max(deal_date) as fetched_on from deals group by 1, 2, 3),
 jobs as (select lawd_cd, deal_type, i as back, strftime(date '{AS_OF}' - to_months(cast(i as int)), '%Y%m') as month from regions, range(24) r(i))
 select lawd_cd, deal_type, month from jobs left join log using (lawd_cd, deal_type, month) where fetched_on is null or (back < 2 and fetched_on < date '{AS_OF}' - interval 7 day)
 order by case when back < 2 then 0 else 1 end, case when back < 2 then lawd_cd end, case when back < 2 then deal_type end, case when back < 2 then back end, month, lawd_cd, deal_type limit 300""", "deals")
def _(t):
    deals = t("deals")
    log = deals.groupBy("lawd_cd", "deal_type", F.date_format("deal_date", "yyyyMM").alias("month")).agg(F.max("deal_date").alias("fetched_on"))
    return merge.plan_fetch(deals.select("lawd_cd", "deal_type").distinct(), log, AS_OF, 24, 300)


@query("g4_map_rows", f"select docid, lng, lat from props where {VISIBLE} and lng between 126.5 and 127.5 and lat between 35 and 37 order by sale_date nulls last, docid limit 700", "props")
def _(t):
    return filters.map_rows(t("props"), (126.5, 35.0, 127.5, 37.0), 700, AS_OF).select("docid", "lng", "lat")


@query(
    "a5_replace_partitions",
    """, batch as (select lawd_cd, deal_type, deal_date, area, amount + 1 as amount from deals where deal_type = 'apt' and lawd_cd < '11005'), fetched as (select distinct lawd_cd, deal_type from deals where deal_type in ('apt', 'rh') and lawd_cd < '11005')
 select lawd_cd, deal_type, count(*) as n, sum(amount) as total from (select * from deals where (lawd_cd, deal_type) not in (select lawd_cd, deal_type from fetched) union all select * from batch) group by 1, 2""",
    "deals",
)
def _(t):
    deals = t("deals").select("lawd_cd", "deal_type", "deal_date", "area", "amount")
    batch = deals.where("deal_type = 'apt' and lawd_cd < '11005'").withColumn("amount", F.col("amount") + 1)
    fetched = deals.where("deal_type in ('apt', 'rh') and lawd_cd < '11005'")
    out = merge.replace_partitions(deals, batch, fetched, ["lawd_cd", "deal_type"])
    return out.groupBy("lawd_cd", "deal_type").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


def _scan_state(t):
    rows = t("scan").select("user_id", "seen_at", "event_id", "status", "price")
    before = F.datediff("seen_at", F.lit("2024-01-01")) < F.col("user_id") % 31  # each listing has a day of its own
    old = windows.dedupe_last(rows.where(before), ["user_id"], ["seen_at", "event_id"])
    last_seen = F.date_format("seen_at", "yyyy-MM-dd").alias("last_seen")
    state = old.select("user_id", "status", "price", last_seen, F.when(F.col("user_id") % 7 == 0, "2024-01-31").alias("deleted_at"))
    return state, rows.where(~before)


SCAN = """, old as (select user_id, status, price, strftime(seen_at, '%Y-%m-%d') as last_seen, case when user_id % 7 = 0 then '2024-01-31' end as deleted_at from scan
 where cast(seen_at as date) < date '2024-01-01' + cast(user_id % 31 as int) qualify row_number() over (partition by user_id order by seen_at desc, event_id desc) = 1),
 new as (select user_id, status, price from scan where cast(seen_at as date) >= date '2024-01-01' + cast(user_id % 31 as int)
 qualify row_number() over (partition by user_id order by seen_at desc, event_id desc) = 1)"""


@query(
    "i2_scan_history",
    SCAN + " select o.user_id, concat_ws(',', case when n.status <> o.status then 'status' end, case when n.price <> o.price then 'price' end) as changed from old o join new n on o.user_id = n.user_id where n.status <> o.status or n.price <> o.price",
    "scan",
)
def _(t):
    state, scan = _scan_state(t)
    history = merge.apply_scan(state, scan, "user_id", ["status", "price"], ["seen_at", "event_id"], F.lit("2024-02-01"))[1]
    return history.select("user_id", F.array_join("changed", ",").alias("changed"))


@query(
    "i3_close_aged",
    SCAN + " select user_id, case when deleted_at is null and last_seen < '2024-01-15' and exists (select 1 from runs where kind = 'search' and complete and started_at >= timestamp '2024-01-15') then '2024-02-01' else deleted_at end as deleted_at from old",
    "scan", "runs",
)
def _(t):
    state, _scan = _scan_state(t)
    return merge.close_aged(state, t("runs"), F.lit("2024-01-15"), F.lit("2024-02-01")).select("user_id", "deleted_at")


@query(
    "i2_scan_counts",
    SCAN + " select count(*) filter (where o.user_id is null) as new, count(*) filter (where o.user_id is not null and (n.status <> o.status or n.price <> o.price)) as changed, "
    "count(*) filter (where o.user_id is not null and not (n.status <> o.status or n.price <> o.price)) as unchanged, count(*) filter (where deleted_at is not null) as resurrected from new n left join old o on o.user_id = n.user_id",
    "scan",
)
def _(t):
    state, scan = _scan_state(t)
    return merge.scan_counts(state, scan, "user_id", ["status", "price"], ["seen_at", "event_id"])


def _flagged(t):
    """Listings with a detail JSON made of the remarks; some have none, and one in seventeen isn't JSON."""
    c = F.col
    known = F.to_json(F.struct(
        F.struct(c("min_sale_price").cast("string").alias("clmAmt"), c("suspension").alias("auctnSuspStatCd"), F.lit(7).alias("rmk")).alias("csBaseInfo"),
        F.struct(c("remark").alias("dspslGdsRmk"), c("terms").alias("gdsSpcfcCtt"), F.lit(20).alias("prchDposRate")).alias("dspslGdsDxdyInfo"),
        F.array(F.struct(F.concat(F.lit("준공 "), "built").alias("bldDtlDts")), F.struct(F.lit(None).cast("string").alias("bldDtlDts"))).alias("gdsDspslObjctLst"),
    ))
    detail = F.when(c("doc_id") % 13 == 12, None).when(c("doc_id") % 17 == 16, "{").otherwise(known)
    rows = details.flag_inputs(t("props").join(t("remarks"), "docid").withColumn("detail", detail).drop("suspension", "built"))
    flags = rules.risk_flags(
        c("detail_text"), c("fail_count"), c("special"), c("claim"), c("appraisal_amount"), c("suspension"), c("usage_nm"), c("conv_addr"), c("usage_mcl_cd"), c("building_summary"), c("built"), AS_OF_YEAR,
    )
    return rows.withColumn("flags", flags)


FLAGS = f""", f as (select p.docid, conv_addr, usage_lcl_cd, has_detail, list_sort(list_filter([
 case when regexp_matches(remark, '지분|[0-9]+분의\\s*[0-9]+') then 'share_sale' end, case when remark like '%맹지%' then 'maeng_ji' end, case when remark like '%유치권%' then 'yuchi' end,
 case when regexp_matches(remark, '법정\\s*지상권') then 'legal_ground' end, case when regexp_matches(remark, '선순위.{{0,8}}임차|대항력[^\\n]{{0,4}}(있|존재|인정|발생)') then 'senior_tenant' end,
 case when regexp_matches(remark, '(임대관계|점유관계).{{0,6}}미상') then 'rent_unknown' end, case when regexp_matches(remark, '위반건축물|위반 건축물') then 'illegal_bld' end,
 case when remark like '%보전산지%' then 'reserve_forest' end, case when remark like '%임업용%' then 'forestry_land' end, case when remark like '%농림지역%' then 'agri_zone' end,
 case when remark like '%자연보전권역%' then 'nat_protect' end, case when regexp_matches(remark, '사도법|(^|[\\s,(])사도($|[\\s,)])') then 'private_road' end, case when remark like '%포락%' then 'pollak' end, case when regexp_matches(remark, '파묘|분묘') then 'pamyo' end, case when regexp_matches(remark, '송전선|구분지상권') then 'power_line' end,
 case when remark like '%제시외%' then 'show_only' end, case when fail_count >= 5 then 'many_fails' end,
 case when regexp_matches(terms, '특별매각|보증금.{{0,4}}20\\s*%') then 'special_20' end, case when suspension = '01' then 'stopped' end,
 case when has_detail and min_sale_price <> 0 and cast(min_sale_price as double) / appraisal_amount >= 0.9 then 'claim_90' end, case when usage_nm like '%전답%' then 'farm_land' end,
 case when usage_nm = '임야' then 'forest_only' end, case when try_cast(regexp_extract(conv_addr, '([0-9.]+)㎡', 1) as double) <= 30 then 'tiny_area' end,
 case when (usage_mcl_cd = '10103' or building_summary like '%빌라%') and (building_summary like '%신축%' or greatest(try_cast(regexp_extract(building_summary, '(19[6-9][0-9]|20[0-9][0-9])\\s*년', 1) as int), try_cast(built as int)) >= {AS_OF_YEAR} - 5) then 'new_villa' end,
 case when regexp_matches(remark, '지분|[0-9]+분의\\s*[0-9]+') and remark like '%맹지%' then 'share_maeng' end], lambda x : x is not null)) as flags
 from props p join (select docid, doc_id, has_detail, case when has_detail then remark end as remark, case when has_detail then terms end as terms, case when has_detail then suspension end as suspension,
 case when has_detail then built end as built from (select *, doc_id % 13 <> 12 and doc_id % 17 <> 16 as has_detail from remarks)) r on p.docid = r.docid)"""


@query("j1_risk_flags", FLAGS + " select docid, array_to_string(flags, ',') as flags from f", "props", "remarks")
def _(t):
    return _flagged(t).select("docid", F.array_join("flags", ",").alias("flags"))


@query(
    "j5_safety_score",
    FLAGS + """, g as (select f.docid, flags, has_detail, building_year, case when conv_addr like '%집합건물%' then 'collective' when conv_addr like '%건물%' then 'building' when conv_addr like '%토지%' then 'land'
 when usage_lcl_cd = '10000' then 'land' when usage_lcl_cd = '20000' then 'building' when usage_lcl_cd is not null then 'other' else 'unknown' end as kind,
 coalesce(list_sum(list_transform(flags, lambda x : case x """
    + " ".join(f"when '{k}' then {v}" for k, v in rules.PENALTIES.items())
    + f""" else 0 end)), 0) as penalty from f left join register using (docid)), h as (select *, case kind when 'building' then -3 when 'land' then -5 when 'other' then -6 when 'unknown' then -2 else 0 end as adj,
 case when kind in ('collective', 'building') and {AS_OF_YEAR} - building_year > 40 then -4 when kind in ('collective', 'building') and {AS_OF_YEAR} - building_year > 30 then -2 else 0 end as age from g)
 select docid, cast(case when has_detail then greatest(0, least(100, 100 - penalty + adj + age)) else least(65, greatest(0, least(100, 100 - penalty + adj + age))) end as int) as score,
 case when not has_detail then 'low' when kind in ('collective', 'building') and building_year is null then 'medium' else 'high' end as confidence, kind,
 array_to_string(list_transform(list_sort(list_transform(flags, lambda x : {{'p': -(case x """
    + " ".join(f"when '{k}' then {v}" for k, v in rules.PENALTIES.items())
    + """ end), 'f': x}))[1:6], lambda y : y.f || ':' || (-y.p)), ',') as factors from h""",
    "props", "remarks", "register",
)
def _(t):
    rows = _flagged(t).join(t("register").select("docid", "building_year"), "docid", "left")
    scored = rows.select("docid", rules.safety_score(F.col("flags"), F.col("conv_addr"), F.col("usage_lcl_cd"), F.col("building_year"), F.col("has_detail"), AS_OF_YEAR).alias("s"))
    factors = F.array_join(F.transform("s.factors", lambda x: F.concat(x["flag"], F.lit(":"), x["penalty"].cast("string"))), ",")
    return scored.select("docid", F.col("s.score").cast("int").alias("score"), "s.confidence", "s.kind", factors.alias("factors"))


@query(
    "j2_places_and_shares",
    """, p as (select *, case o_orderkey % 5 when 0 then '애월읍' when 1 then '화도면' when 2 then '신림동' end as emd, case when o_orderkey % 3 = 0 then '가평군' else '서초구' end as sgg, o_orderkey % 7 = 0 as share, concat_ws(' ', conv_addr, road_addr, building_summary) as one from props),
 q as (select *, coalesce(regexp_matches(emd, '[읍면]$'), false) or sgg like '%군' or coalesce(lot_addr, '') like '%애월읍' as rural,
 coalesce(usage_nm in ('단독주택', '다가구주택') and not share and concat_ws(' ', conv_addr, building_summary) not like '%집합건물%' and not (coalesce(conv_addr, '') like '%[토지%' and concat_ws(' ', conv_addr, building_summary) not like '%건물%'), false) as h from p)
 select docid, array_to_string(list_sort(list_filter([case when usage_nm in ('단독주택', '다가구주택', '근린시설') and conv_addr like '%[건물%' and not share then 'whole_building' end,
 case when h and regexp_matches(one, '별장|펜션|산장|리조트') then 'vacation_home' end, case when h and regexp_matches(one, '농가|축사|농장|농어촌') then 'farm_house' end,
 case when h and (rural or regexp_matches(one, '전원|농가|농어촌')) then 'country_house' end, case when h and not (rural or regexp_matches(one, '전원|농가|농어촌')) then 'townhouse' end], lambda x : x is not null)), ',') as categories from q""",
    "props",
)
def _(t):
    c, k = F.col, F.col("o_orderkey")
    emd, sgg = F.when(k % 5 == 0, "애월읍").when(k % 5 == 1, "화도면").when(k % 5 == 2, "신림동"), F.when(k % 3 == 0, "가평군").otherwise("서초구")
    cats = rules.kr_categories(c("usage_nm"), c("conv_addr"), c("road_addr"), c("lot_addr"), c("building_summary"), emd, sgg, k % 7 == 0)
    return t("props").select("docid", F.array_join(cats, ",").alias("categories"))


@query(
    "j2_kr_categories",
    """select docid, array_to_string(list_sort(list_filter([case when usage_nm in ('단독주택', '다가구주택', '근린시설') and conv_addr like '%[건물%' then 'whole_building' end,
 case when h and regexp_matches(one, '별장|펜션|산장|리조트') then 'vacation_home' end, case when h and regexp_matches(one, '농가|축사|농장|농어촌') then 'farm_house' end,
 case when h and (rural or regexp_matches(one, '전원|농가|농어촌')) then 'country_house' end, case when h and not (rural or regexp_matches(one, '전원|농가|농어촌')) then 'townhouse' end], lambda x : x is not null)), ',') as categories
 from (select *, concat_ws(' ', conv_addr, road_addr, building_summary) as one, coalesce(lot_addr, '') like '%애월읍' as rural,
 coalesce(usage_nm in ('단독주택', '다가구주택') and concat_ws(' ', conv_addr, building_summary) not like '%집합건물%' and not (coalesce(conv_addr, '') like '%[토지%' and concat_ws(' ', conv_addr, building_summary) not like '%건물%'), false) as h from props)""",
    "props",
)
def _(t):
    c = F.col
    none = F.lit(None).cast("string")
    cats = rules.kr_categories(c("usage_nm"), c("conv_addr"), c("road_addr"), c("lot_addr"), c("building_summary"), none, none, F.lit(False))
    return t("props").select("docid", F.array_join(cats, ",").alias("categories"))


@query("b29_remark_badges", """select docid, array_to_string(list_filter([case when remark like '%유치권%' then 'danger:유치권' end, case when remark like '%법정지상권%' then 'danger:법정지상권' end,
 case when remark like '%토지별도등기%' then 'danger:토지별도등기' end, case when remark like '%위반건축물%' then 'danger:위반건축물' end, case when regexp_matches(remark, '제시외\\s*건물') then 'warn:제시외 건물 포함' end,
 case when remark like '%일괄매각%' then 'info:일괄매각' end, case when remark like '%공실%' then 'info:공실' end, case when regexp_matches(remark, '점유자\\s*없음') then 'info:점유자 없음' end], lambda x : x is not null), ',') as badges from remarks""", "remarks")
def _(t):
    badges = F.transform(sc.remark_badges(F.col("remark")), lambda x: F.concat(x["level"], F.lit(":"), x["label"]))
    return t("remarks").select("docid", F.array_join(badges, ",").alias("badges"))


@query(
    "k5_fallback_estimate",
    REGION + """, c as (select docid, min(round_price) as ceiling from props join rounds using (docid) where round_price > 0 and round_date < sale_date group by 1),
 a as (select p.docid, cast(appraisal_amount as double) as a, case when min_sale_price > 0 then cast(min_sale_price as double) end as f, cast(ceiling * 4000 as double) as c0, least(2.0, greatest(0.1, avg_rate / 100)) as r,
 least(2.0, greatest(0.1, avg_rate / 100 * 0.85)) as lr, least(2.0, greatest(0.1, avg_rate / 100 * 1.15)) as hr from props p join rs using (docid) left join c using (docid)
 where p.deleted_on is null and avg_rate is not null), b as (select *, case when f is null or c0 >= f then c0 end as c from a),
 d as (select *, case when c is null then a * r else least(a * r, c) end as e1, case when c is null then a * hr else least(a * hr, c) end as h1 from b), e as (select *, case when c is null then a * lr else least(a * lr, e1) end as l1 from d),
 g as (select *, case when f is null then e1 else greatest(e1, f) end as e2, case when f is null then l1 else greatest(l1, f) end as l2 from e)
 select docid, cast(round_even(e2, 0) as bigint) as est, cast(round_even(l2, 0) as bigint) as low, cast(round_even(case when f is null then h1 else greatest(h1, e2) end, 0) as bigint) as high from g""",
    "props", "results", "rounds",
)
def _(t):
    props = t("props")
    region = joins.region_stat_for(props, stats.stats_by_region(t("results"), AS_OF)).where("avg_rate is not null")
    rows = props.where("deleted_on is null").join(region, "docid").join(joins.prior_round_ceiling(props, t("rounds")), "docid", "left")
    rows = rows.select("docid", "appraisal_amount", "min_sale_price", (F.col("ceiling") * 4000).alias("ceiling"), *estimate.fallback_rates(F.col("avg_rate")))
    e = estimate.clamp_estimate(*(F.col(c) for c in ("appraisal_amount", "rate", "low_rate", "high_rate", "min_sale_price", "ceiling")))
    return rows.select("docid", e.alias("e")).select("docid", "e.est", "e.low", "e.high")


@query("k2_target", "select docid, case when cast(sale_amount as double) / appraisal_amount between 0.1 and 3.0 then cast(sale_amount as double) / appraisal_amount end as target from results", "results")
def _(t):
    return t("results").select("docid", estimate.target(F.col("sale_amount"), F.col("appraisal_amount")).alias("target"))


@query(
    "l2_scenario_bids",
    """select docid, list_aggregate(list_distinct(list_transform([0, 1, 2, 3, 4], lambda i : cast(floor((m + (greatest(cast(appraisal_amount as double), 1.3 * m) - m) * i / 4) / 1000000 + 0.5) * 1000000 as bigint))), 'sum') as total
 from (select *, min_sale_price as m from props where min_sale_price > 0)""",
    "props",
)
def _(t):
    bids = estimate.scenario_bids(F.col("min_sale_price"), F.col("appraisal_amount"))
    return t("props").where("min_sale_price > 0").select("docid", F.aggregate(bids, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(
    "l3_simulate",
    """, a as (select *, move_in + interval 1 day <= lien_date as opp, greatest(0.0, cast(bid as double) - (2000000 + cast(bid as double) * 0.005)) as r0 from tenants), b as (select *, r0 - least(r0, greatest(0.0, cast(tax as double))) as r1 from a),
 c as (select *, case when demanded and small_claim > 0 then least(r1, cast(small_claim as double), cast(deposit as double)) else 0.0 end as small, case when move_in is null then fixed_date else greatest(move_in + interval 1 day, fixed_date) end as rk from b),
 d as (select *, r1 - small as r2, coalesce(lien_date is not null and rk < lien_date, false) as first from c), e as (select *, case when first then r2 else r2 - least(r2, greatest(0.0, cast(senior as double))) end as r3 from d),
 f as (select *, small + case when demanded and fixed_date is not null then least(r3, greatest(0.0, deposit - small)) else 0.0 end as dividend from e)
 select tenant, opp as opposable, cast(dividend as double) as dividend, cast(case when not opp then 0.0 else greatest(0.0, deposit - dividend) end as double) as assumed from f""",
    "tenants",
)
def _(t):
    return estimate.simulate(t("tenants")).select("tenant", "opposable", "dividend", "assumed")


@query("e12_flag_audit", "select json_extract_string(props, '$.k') as value, count(*) as n, count(*) / cast(sum(count(*)) over () as double) as share from scan where props is not null group by 1", "scan")
def _(t):
    return reports.flag_audit(t("scan"), "props", "$.k")


MONEY = """case when {v} is null then '-' when {v} >= 100000000 and ({v} % 100000000) // 10000 > 0 then concat(cast({v} // 100000000 as string), '억 ', format('{{:,}}', ({v} % 100000000) // 10000), '만원')
 when {v} >= 100000000 then concat(cast({v} // 100000000 as string), '억원') when {v} >= 10000 then concat(format('{{:,}}', {v} // 10000), '만원') else concat(format('{{:,}}', {v}), '원') end"""
DATE = "coalesce(strftime({v}, '%Y.%m.%d'), '-')"
PART = """coalesce(' (감정가의 ' || cast(cast(floor(cast({v} as double) / appraisal_amount * 100 + 0.5) as bigint) as string) || '%)', '')"""


@query(
    "a7_kr_report",
    ", one as (select * from rounds qualify row_number() over (partition by docid, seq order by l_partkey desc, l_suppkey desc, round_price desc, round_date desc) = 1), "
    "r as (select docid, string_agg('| ' || seq || ' | ' || " + DATE.format(v="round_date") + " || '  | — | ' || " + MONEY.format(v="round_price")
    + " || ' | ' || coalesce(result_cd, '—') || ' |', chr(10) order by seq) as lines from one group by 1), "
    "b as (select *, cast(datediff('day', date '2001-09-01', sale_date) as int) as d, nullif(min_sale_price, 0) as m from props) "
    "select docid, case_no || '.md' as filename, concat_ws(chr(10), '# 🇰🇷 ' || case_no, '', '> Generated from /p/' || docid, '', '## 메타', '- **사건번호**: `' || case_no || '`', '- **사건명**: —', "
    "'- **법원·경매계**: ' || coalesce(court_name, '—'), '- **접수일**: -', '- **용도**: ' || coalesce(usage_nm, '—'), '', "
    "case when sold then concat_ws(chr(10), '## 낙찰 완료', '- **낙찰가**: -', '') end, "
    "case when d is not null then concat_ws(chr(10), '## 입찰 전 핵심 정보', '- **매각기일까지**: ' || case when d = 0 then 'D-day' when d > 0 then 'D-' || d else 'D+' || -d end || ' (' || "
    + DATE.format(v="sale_date")
    + " || ')', '- ※ 자동 추출 — 정확한 권리분석은 매각물건명세서·등기부등본 직접 확인', '') end, '## 주소', '- **도로명**: ' || road_addr, '- **지번**: ' || lot_addr, '- **표시 주소**: ' || conv_addr, '', "
    "'## 가격', '| 항목 | 값 |', '|---|---:|', '| 감정가 | ' || " + MONEY.format(v="appraisal_amount") + " || ' |', '| 최저매각가 | ' || " + MONEY.format(v="min_sale_price") + " || " + PART.format(v="m")
    + " || ' |', '| 매각가율 | ' || coalesce(cast(cast(floor(cast(m as double) / appraisal_amount * 100 + 0.5) as bigint) as string) || '%', '-') || ' |', "
    "'| 할인율 | ' || coalesce(case when m < appraisal_amount then '▼' || cast(cast(floor((1 - cast(m as double) / appraisal_amount) * 100 + 0.5) as bigint) as string) || '%' end, '-') || ' |', "
    "'| 유찰횟수 | ' || coalesce(fail_count || '회', '—') || ' |', '| 매각기일 | ' || " + DATE.format(v="sale_date") + " || ' |', '| 매각결정기일 | - |', '', "
    "case when building_summary is not null then concat_ws(chr(10), '## 건물·면적', '- **건물 요약**: ' || building_summary, '') end, "
    "case when lines is not null then concat_ws(chr(10), '## 매각기일 이력', '| 회차 | 기일 | 장소 | 최저가 | 결과 |', '|---:|---|---|---:|---|', lines, '') end, "
    "'## 원본', '- **법원경매정보**: 사건번호 `' || case_no || '`, 법원 `' || court_code || '`', '- **본 사이트 상세**: /p/' || docid, '') as markdown from b left join r using (docid) left join courts using (court_code)",
    "props", "rounds", "courts",
)
def _(t):
    rounds = windows.dedupe_last(t("rounds"), ["docid", "seq"], ["l_partkey", "l_suppkey", "round_price", "round_date"])
    props = t("props").join(t("courts").select("court_code", "court_name"), "court_code", "left").drop("lng", "lat")
    return reports.kr_report(props, rounds, as_of=AS_OF)


SITE, SOURCE = "https://listings.example", "courts.example"


@query(
    "a7_kr_sections",
    """, k as (select *, o_orderkey as k, o_orderkey % 101 as score, cast(floor(appraisal_amount * 0.5) as bigint) as est, o_orderkey % 4 = 0 as won from props)
 select docid, case_no || '.md' as filename, concat_ws(chr(10), '# 🇰🇷 ' || case_no, '', '> Generated from https://listings.example/p/' || docid, '', '## 메타', '- **사건번호**: `' || case_no || '`', '- **사건명**: —', '- **법원·경매계**: —', '- **접수일**: -', '- **용도**: —', '',
 case when won then concat_ws(chr(10), '## 낙찰 완료', '- **낙찰가**: ' || """ + MONEY.format(v="est") + """ || ' (감정가의 50%)', '- **낙찰일**: 2001.05.06', '') end,
 '## 주소', '- **행정 구역**: 서울 ' || sgg_code, case when lng is not null then concat_ws(chr(10), '- **좌표**: `' || (k % 30) || '.5, 127.25`', '  - [Naver 지도](https://map.naver.com/v5/?c=127.25,' || (k % 30) || '.5,18,0,0,0,dh)',
 '  - [Google 지도](https://www.google.com/maps?q=' || (k % 30) || '.5,127.25&z=18)') end, '', '## 가격', '| 항목 | 값 |', '|---|---:|', '| 감정가 | ' || """ + MONEY.format(v="appraisal_amount") + """ || ' |', '| 최저매각가 | - |', '| 매각가율 | - |', '| 할인율 | - |', '| 유찰횟수 | — |', '| 매각기일 | - |', '| 매각결정기일 | - |', '',
 '## 매수 안전도 (참고)', '- **점수**: ' || score || '/100 — ' || case when score >= 80 then '안전' when score >= 65 then '양호' when score >= 45 then '주의' else '위험' end || case k % 3 when 0 then ' (⚠ 상세정보 미확보, 잠정치)' when 1 then ' (건물 연식 정보 일부 부족)' else '' end,
 case when k % 2 = 0 then '- **감점 요인**: 선순위 임차인(대항력) (−25점) · 초소형(30㎡ 이하) (−3점)' end, '- ※ 법적 위험 기반 점수 (가격 매력도 제외) — 입찰 판단은 권리분석 직접 확인 필수', '',
 case when not won then concat_ws(chr(10), '## 낙찰 예상가 (베타)', '- **예상가**: ' || """ + MONEY.format(v="est") + """ || ' (감정가의 50.5%)', case when k % 5 <> 0 then '- **범위**: ' || """ + MONEY.format(v="est") + """ || ' ~ ' || """ + MONEY.format(v="appraisal_amount") + """ end,
 '- **방법**: ' || case when k % 2 = 0 then '자체 낙찰 데이터 예측 모델' || case when k % 3 = 0 then ' (v20010901)' else '' end || ' · 학습 표본 ' || (k % 90) || '건' else '지역 평균 매각가율 추정 (모델 표본 부족 — 참고용)' end, '- ※ 통계 모델의 추정치이며 실제 낙찰가와 다를 수 있음. 입찰 판단 책임은 이용자에게 있음', '') end,
 '## 감정평가 요항', '### 교통', '> 버스 ' || k, '> 지하철', '', '### 항목 00089999', '> 기타', '', '### 항목 4', '> 무', '', '## 임차인현황', '1. **소재지**: 주소 ' || k || ' · **other**: 7', '', '## 매각대상물', '1. **건물명**: 동 · **면적**: ' || (k % 70) || '㎡', '2. **지목**: 대', '',
 case when k % 3 <> 0 then concat_ws(chr(10), '## 사진', '- a/1.jpg', '- a/2.jpg', '') end, '## 원본', '- **법원경매정보 (courts.example)**: 사건번호 `' || case_no || '`, 법원 `' || court_code || '`', '- **본 사이트 상세**: https://listings.example/p/' || docid, '',
 '---', 'Exported from listings.example · 데이터는 공식 사이트(courts.example)를 우선 확인하세요') as markdown from k""",
    "props",
)
def _(t):
    c, k = F.col, F.col("o_orderkey")
    part = lambda **v: F.struct(*(x.alias(n) for n, x in v.items()))
    factor = lambda flag, n: part(flag=F.lit(flag), penalty=F.lit(n))
    note = lambda code, text: part(aeeWevlMnpntItmCd=F.lit(code), aeeWevlMnpntCtt=text)
    est = F.floor(c("appraisal_amount") * 0.5).cast("bigint")
    detail = part(
        aeeWevlMnpntLst=F.array(note("00083002", F.concat(F.lit(" 버스 "), k, F.lit("\n\n 지하철 "))), note("00089999", F.lit("기타")), note("00083001", F.lit("-.")), note(None, F.lit("무"))),
        gdsRletStLtnoLstAll=F.array(part(rletStLtnoAddr=F.concat(F.lit("주소 "), k), other=F.lit("7"), inner=part(x=F.lit(1)))),
        rgltLandLstAll=F.array(part(landArDts=F.lit(""))),
        gdsDspslObjctLst=F.array(part(bldNm=F.lit("동"), objctArDts=F.concat(k % 70, F.lit("㎡")), ldcgDts=F.lit(None).cast("string")), part(bldNm=F.lit(None).cast("string"), objctArDts=F.lit(""), ldcgDts=F.lit("대"))),
    )
    score = part(
        score=(k % 101).cast("int"), confidence=F.when(k % 3 == 0, "low").when(k % 3 == 1, "medium").otherwise("high"),
        factors=F.when(k % 2 == 0, F.array(factor("senior_tenant", 25), factor("tiny_area", 3))).otherwise(F.array().cast("array<struct<flag:string,penalty:int>>")),
    )
    estimate_of = part(
        est=est, low=F.when(k % 5 != 0, est), high=c("appraisal_amount"), rate_pct=F.lit(50.5), method=F.when(k % 2 == 0, "model").otherwise("region_avg"), samples=(k % 90).cast("int"),
        model_version=F.when(k % 3 == 0, "v20010901"),
    )
    rows = t("props").select(
        "docid", "case_no", "court_code", "appraisal_amount", F.concat(F.lit("서울 "), "sgg_code").alias("region"), F.when(c("lng").isNotNull(), 127.25).alias("lng"), ((k % 30) + 0.5).alias("lat"), (k % 4 == 0).alias("sold"), est.alias("sold_amount"),
        F.lit("2001-05-06").cast("date").alias("sold_date"), score.alias("score"), estimate_of.alias("estimate"), F.to_json(detail).alias("detail"), "o_orderkey",
    )
    photos = rows.where("o_orderkey % 3 <> 0").select("docid", F.explode(F.array(*(part(seq=F.lit(n), storage_path=F.lit(p)) for n, p in ((2, "a/2.jpg"), (1, "a/1.jpg"), (3, None))))).alias("p")).select("docid", "p.*")
    none = t("rounds").limit(0)
    return reports.kr_report(rows.drop("o_orderkey"), none, photos, site=SITE, source=SOURCE)


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace({v}, '\\b0+([0-9]+)', '\\1', 'g'), '-0+\\b', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    "b10_to_properties",
    f"""select court_code, case_no, case when o_orderkey % 5 = 0 then cast(3 as bigint) else cast(1 as bigint) end as item_no, docid, appraisal_amount, min_sale_price, min_sale_price + 1 as current_sale_price, cast(fail_count as bigint) as fail_count, cast(sale_date as string) as sale_date,
 cast(sale_date + 7 as string) as sale_decision_date, case when o_orderkey % 3 = 0 then '02' else 'S' end as status_cd, usage_lcl_cd, usage_mcl_cd, cast(null as string) as usage_scl_cd, usage_nm, sd_code, sgg_code, emd_code, 'R' || o_orderkey % 9 as rd_code, (o_custkey % 90) || '-1' as lot_no,
 coalesce(conv_addr, 'D ' || docid) as conv_addr, building_summary, (o_orderkey % 700) || '㎡' as area_summary, case when o_orderkey % 4 <> 1 then o_orderkey % 7 end as mokmul_ser, round(cast(min_sale_price as double) / appraisal_amount * 100, 2) as sale_rate_pct,
 {CLEAN.format(v="road_addr")} || ' (A, B)' as road_addr, nullif({CLEAN.format(v="lot_addr")}, '') as lot_addr, case when lng between 124 and 132 and lat between 33 and 39 then lng end as lng, case when lng between 124 and 132 and lat between 33 and 39 then lat end as lat,
 docid as raw_docid from props""",
    "props",
)
def _(t):
    c, k = F.col, F.col("o_orderkey")
    raw = t("props").select(
        F.to_json(F.struct(
            c("court_code").alias("boCd"), c("case_no").alias("srnSaNo"), F.when(k % 5 == 0, "3").otherwise("0").alias("maemulSer"), c("docid"), F.format_number("appraisal_amount", 0).alias("gamevalAmt"),
            c("min_sale_price").cast("string").alias("minmaePrice"), (c("min_sale_price") + 1).alias("maemaePrice"), c("fail_count").cast("string").alias("yuchalCnt"), F.date_format("sale_date", "yyyyMMdd").alias("maeGiil"),
            F.date_format(F.date_add("sale_date", 7), "yyyy-MM-dd").alias("maegyuljGiil"), F.when(k % 3 == 0, " 02 ").alias("maemulStatCd"), F.lit("S").alias("statCd"), F.coalesce("usage_lcl_cd", F.lit("00000")).alias("lclsUtilCd"),
            c("usage_mcl_cd").alias("mclsUtilCd"), F.lit("0").alias("sclsUtilCd"), c("usage_nm").alias("dspslUsgNm"), c("sd_code").alias("daepyoSidoCd"), F.lit("").alias("daepyoSiguCd"), c("sgg_code").alias("daepyoSggCd"),
            c("emd_code").alias("daepyoEmdCd"), F.concat(F.lit("R"), k % 9).alias("daepyoRdCd"), F.concat(c("o_custkey") % 90, F.lit("-1")).alias("daepyoLotno"), c("conv_addr").alias("convAddr"), F.concat(F.lit("D "), "docid").alias("daepyoAddr"),
            c("road_addr").alias("bgPlaceRdAllAddr"), F.lit("(A,B)").alias("rdAddrSub"), c("lot_addr").alias("lotAllAddr"), c("building_summary").alias("buldList"), F.concat(k % 700, F.lit("㎡")).alias("areaList"),
            F.when(k % 4 == 1, "7.5").otherwise((k % 7).cast("string")).alias("mokmulSer"), F.lit("0").alias("xCordi"), F.lit(0).alias("yCordi"), c("lng").alias("wgs84Xcordi"), c("lat").cast("string").alias("wgs84Ycordi"), F.repeat(F.lit("x"), 200).alias("unused"),
        )).alias("row"), "o_orderkey",
    )
    props = scan.to_properties(raw, ["o_orderkey"]).withColumn("sale_date", text("sale_date")).withColumn("sale_decision_date", text("sale_decision_date"))
    return props.withColumn("raw_docid", F.get_json_object("search_row", "$.docid")).drop("search_row")


@query(
    "b14_to_sale_rounds",
    "select docid, cast(seq as bigint) as seq, cast(round_date as string) as round_date, round_price, result_cd, kind_cd from (select * from rounds qualify row_number() over (partition by docid, seq order by l_partkey desc, l_suppkey desc, round_price desc, round_date desc) = 1)",
    "rounds",
)
def _(t):
    one = windows.dedupe_last(t("rounds"), ["docid", "seq"], ["l_partkey", "l_suppkey", "round_price", "round_date"])
    item = F.struct(
        F.col("seq").cast("string").alias("seq"), F.date_format("round_date", "yyyyMMdd").alias("dxdyYmd"), F.format_number("round_price", 0).alias("tsLwsDspslPrc"),
        F.col("result_cd").alias("auctnDxdyRsltCd"), F.col("kind_cd").alias("auctnDxdyKndCd"),
    )
    details = one.groupBy("docid").agg(F.to_json(F.struct(F.collect_list(item).alias("gdsDspslDxdyLst"))).alias("detail"))
    return scan.to_sale_rounds(details).select("docid", "seq", text("round_date"), "round_price", "result_cd", "kind_cd")


@query("e6_score_distribution", "select cast(least(90, safety // 10 * 10) as int) as bucket, case when usage_nm is null then 'low' else 'high' end as confidence, count(*) as n from props group by 1, 2", "props")
def _(t):
    rows = t("props").select(F.col("safety").alias("score"), F.when(F.col("usage_nm").isNull(), "low").otherwise("high").alias("confidence"))
    return stats.score_distribution(rows)


JP = """, jp as (select docid, cast(o_orderkey % 4 + 1 as string) as sale_cls, lpad(cast(o_orderkey % 50 as string), 2, '0') as prefecture,
 case o_orderkey % 5 when 0 then '軽井沢 別荘地' when 1 then '古民家 島' when 2 then 'リゾート' else '八王子市' end as address, concat('令和0', cast(o_orderkey % 9 + 1 as string), '年04月17日') as day,
 concat(cast(o_orderkey % 900 + 1 as string), '万', case when o_orderkey % 2 = 0 then '5,000' else '' end, '円') as price, o_orderkey from props)"""


@query(
    "jp_listing",
    JP + """ select docid, concat_ws(',', case when sale_cls = '2' and regexp_matches(address, '別荘|山荘|リゾート|別邸|リゾ') then 'bessou' end, case when sale_cls = '2' and address like '%古民家%' then 'akiya' end,
 case when sale_cls = '2' and prefecture = '47' then 'rizoto' end, case when prefecture = '47' then 'tousho' end) as categories,
 case when prefecture between '02' and '07' then '02' when prefecture between '08' and '14' then '03' when prefecture between '15' and '20' then '04' when prefecture between '21' and '24' then '05'
 when prefecture between '25' and '30' then '06' when prefecture between '31' and '35' then '07' when prefecture between '36' and '39' then '08' when prefecture between '40' and '47' then '09' end as block,
 concat(cast(2018 + o_orderkey % 9 + 1 as string), '-04-17') as day, cast((o_orderkey % 900 + 1) * 10000 + case when o_orderkey % 2 = 0 then 5000 else 0 end as bigint) as price from jp""",
    "props",
)
def _(t):
    c = F.col
    k = c("o_orderkey")
    jp = t("props").select(
        "docid", (k % 4 + 1).cast("string").alias("sale_cls"), F.lpad((k % 50).cast("string"), 2, "0").alias("prefecture"),
        F.when(k % 5 == 0, "軽井沢 別荘地").when(k % 5 == 1, "古民家 島").when(k % 5 == 2, "リゾート").otherwise("八王子市").alias("address"),
        F.concat(F.lit("令和0"), (k % 9 + 1).cast("string"), F.lit("年04月17日")).alias("day"),
        F.concat((k % 900 + 1).cast("string"), F.lit("万"), F.when(k % 2 == 0, "5,000").otherwise(""), F.lit("円")).alias("price"),
    )
    cats = rules.jp_categories(c("sale_cls"), c("prefecture"), c("address"))
    return jp.select("docid", F.array_join(cats, ",").alias("categories"), sc.jp_block(c("prefecture")).alias("block"), sc.jp_date(c("day")).cast("string").alias("day"), sc.jp_price(c("price")).alias("price"))


def _model_rows(t):
    """Closed sales with the listing's columns; the sale rate falls with failed rounds and differs by district, so the model has a signal."""
    results = t("results").select("docid", "sale_amount", "appraisal_amount", "sd_code", "sgg_code", "usage_lcl_cd", "sale_date", "court_code", "fail_count", "bidder_count")
    props = t("props").select("docid", "usage_mcl_cd", "usage_nm", "min_sale_price", F.col("conv_addr").alias("area_text"))
    rows = results.join(props, "docid", "left")
    rate = 1.1 - 0.08 * F.col("fail_count") + F.pmod(F.xxhash64("sgg_code"), F.lit(7)) / 50 + F.pmod(F.xxhash64("docid"), F.lit(11)) / 200
    rows = rows.withColumn("sale_amount", F.when(F.col("sale_amount") > 0, (F.col("appraisal_amount") * rate).cast("bigint")))
    rows = rows.withColumn("target", estimate.target(F.col("sale_amount"), F.col("appraisal_amount")))
    return rows, _features(t, rows, rows)


def _features(t, sold, rows):
    prices = stats.latest_price(stats.price_by_quarter(t("deals")))
    return model.features(rows, t("register").where("fetch_status = 'ok'"), prices, stats.stats_by_region(sold, AS_OF), AS_OF)


RATES = ["docid", "rate", "low_rate", "high_rate"]


@query("k3_quantile_model")
def _(t):
    _sold, rows = _model_rows(t)
    fitted = model.fit(rows)
    return model.predict(fitted, rows) if fitted else rows.select("docid", *(F.lit(0.0).alias(c) for c in RATES[1:])).limit(0)


@query("k3_coverage")
def _(t):
    """A fifth of the sales held out: how many lie between the 0.1 and 0.9 quantiles of trees fitted to the others, by SQL."""
    rows = _model_rows(t)[1].where("target is not null").withColumn("held", F.pmod(F.xxhash64("docid"), F.lit(5)) == 0)
    fitted = model.fit(rows.where("not held"))
    if not fitted:
        return rows.limit(0).selectExpr("count(*) as n", "cast(null as double) as inside", "cast(null as double) as below")
    both = model.predict(fitted, rows.where("held")).join(rows.select("docid", "target"), "docid")
    return both.sparkSession.sql(
        "select count(*) as n, avg(case when target between low_rate and high_rate then 1.0D else 0.0D end) as inside, avg(case when target < low_rate then 1.0D else 0.0D end) as below from {rows}", rows=both
    )


@query("k4_estimates")
def _(t):
    sold, rows = _model_rows(t)
    active = t("props").where("deleted_on is null").withColumn("area_text", F.col("conv_addr"))
    out = model.estimates(model.fit(rows), _features(t, sold, active), stats.segment_counts(sold))
    return out.select("docid", "method", "samples", "rate", "low_rate", "high_rate", F.to_json("features_used").alias("features_used"))


@query(
    "k4_region_estimates",
    REGION.split(" big as")[0].rstrip(", \n") + PRICES + f""", lp as (select lawd_cd, deal_type from prices where n_deals >= 3 and median_price is not null group by 1, 2),
 n as (select coalesce(sgg_code, '') as g, coalesce(usage_lcl_cd, '') as u, count(*) as n from results group by 1, 2), f as (select *, coalesce({KIND}, 'apt') as dt, sd_code || coalesce(sgg_code, '') as lawd from props where deleted_on is null),
 r as (select f.docid, coalesce(n.n, 0) as samples, avg_rate / 100 as r, conv_addr like '%㎡%' as area, building_year is not null as age, lp.lawd_cd is not null as price from f left join register g on g.docid = f.docid and fetch_status = 'ok'
 left join lp on lp.lawd_cd = lawd and lp.deal_type = dt join s on s.sd_code || s.sgg_code = lawd and coalesce(s.usage_lcl_cd, '') = coalesce(f.usage_lcl_cd, '') left join n on n.g = f.sgg_code and n.u = coalesce(f.usage_lcl_cd, '') where avg_rate is not null)
 select docid, 'region_avg' as method, samples, greatest(0.1, least(2.0, r)) as rate, greatest(0.1, least(2.0, r * 0.85)) as low_rate, greatest(0.1, least(2.0, r * 1.15)) as high_rate,
 '{{"area_m2":' || coalesce(area, false) || ',"building_age":' || age || ',"region_price_m2":' || price || ',"region_avg_rate":true}}' as features_used from r""",
    "props", "results", "deals", "register",
)
def _(t):
    active = t("props").where("deleted_on is null").withColumn("area_text", F.col("conv_addr"))
    out = model.estimates(None, _features(t, t("results"), active), stats.segment_counts(t("results")))
    return out.select("docid", "method", "samples", "rate", "low_rate", "high_rate", F.to_json("features_used").alias("features_used"))


@query(
    "e8_backtest_metrics",
    """, x as (select cast(sale_amount as double) / appraisal_amount as y, 1.0 - 0.04 * fail_count as r, case when o_orderkey % 4 <> 0 then 70.0 + fail_count end as g from results where sale_amount > 0)
 select count(*) as n, round(avg(abs(r - y)), 9) as mae, round(avg(abs(r / y - 1)), 9) as mape, round(avg(abs(g / 100 - y)), 9) as baseline_mae from x where y between 0.1 and 3.0""",
    "results",
)
def _(t):
    rows = t("results").withColumn("target", estimate.target(F.col("sale_amount"), F.col("appraisal_amount")))
    predicted = rows.select("docid", (1.0 - 0.04 * F.col("fail_count")).alias("rate"), F.when(F.col("o_orderkey") % 4 != 0, 70.0 + F.col("fail_count")).alias("region_avg_rate"))
    out = model.metrics(predicted, rows.where("sale_amount > 0").select("docid", "target"))
    return out.select("n", *(F.round(c, 9).alias(c) for c in ("mae", "mape", "baseline_mae")))


@query(
    "k1_features",
    REGION.split(" big as")[0].rstrip(", \n") + PRICES + f""", lp as (select lawd_cd, deal_type, arg_max(median_price, quarter_start) as region_price_m2 from prices where n_deals >= 3 and median_price is not null group by 1, 2),
 f as (select *, coalesce({KIND}, 'apt') as dt, sd_code || coalesce(sgg_code, '') as lawd from props)
 select f.docid, cast(appraisal_amount as double) as appraisal_amount, cast(min_sale_price as double) / appraisal_amount as min_rate, cast(fail_count as double) as fail_count, cast(month(sale_date) as double) as sale_month,
 try_cast(regexp_extract(conv_addr, '([0-9.]+)㎡', 1) as double) as area_m2, cast({AS_OF_YEAR} - building_year as double) as building_age, region_price_m2, avg_rate as region_avg_rate,
 coalesce(f.usage_lcl_cd, '') as usage_lcl_cd, coalesce(usage_mcl_cd, '') as usage_mcl_cd, f.sd_code, lawd as lawd_cd, court_code
 from f left join register g on g.docid = f.docid and fetch_status = 'ok' left join lp on lp.lawd_cd = lawd and lp.deal_type = dt
 left join s on s.sd_code || s.sgg_code = lawd and coalesce(s.usage_lcl_cd, '') = coalesce(f.usage_lcl_cd, '')""",
    "props", "results", "deals", "register",
)
def _(t):
    rows = _features(t, t("results"), t("props").withColumn("area_text", F.col("conv_addr")))
    return rows.select("docid", *model.NUMBERS, *model.LEVELS)


@query("k6_evaluate")
def _(t):
    return model.evaluate(_model_rows(t)[1], AS_OF, 200)
