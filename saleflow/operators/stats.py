"""Aggregates over results, deals, scores and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sold_stats() -> list[Column]:
    sold = F.col("sale_amount") > 0
    rate = F.when(sold & (F.col("appraisal_amount") > 0), F.col("sale_amount") / F.col("appraisal_amount").cast("double") * 100)
    return [
        F.count(F.lit(1)).alias("total_count"), F.count(F.when(sold, 1)).alias("sold_count"), F.count(F.when(~F.coalesce(sold, F.lit(False)), 1)).alias("unsold_count"),
        F.round(F.avg(rate), 1).alias("avg_rate"), F.round(F.avg(F.when(sold, F.col("fail_count"))), 1).alias("avg_fails"),
        F.round(F.avg(F.when(sold, F.col("bidder_count"))), 1).alias("avg_bidders"), F.max("sale_date").alias("latest_sale_date"),
    ]


def stats_by_region(results: DataFrame, as_of: str) -> DataFrame:
    recent = F.count(F.when((F.col("sale_amount") > 0) & (F.col("sale_date") >= F.date_sub(F.lit(as_of).cast("date"), 90)), 1))
    rows = results.where("sd_code is not null and sgg_code is not null")
    return rows.groupBy("sd_code", "sgg_code", "usage_lcl_cd").agg(*_sold_stats(), recent.alias("sold_90_days"))


def stats_by_court(results: DataFrame) -> DataFrame:
    return results.groupBy("court_code", "usage_lcl_cd").agg(*_sold_stats())


def price_by_quarter(deals: DataFrame, exact: bool = True) -> DataFrame:
    """Deals, median price per square metre and quarter label. `exact=False` takes a sketch, for very large groups."""
    per = F.col("amount") / F.col("area")
    median = F.percentile(per, F.lit(0.5)) if exact else F.percentile_approx(per, F.lit(0.5), F.lit(10_000))
    quarter = F.trunc("deal_date", "quarter").alias("quarter_start")
    rows = deals.where("area > 0 and amount > 0 and deal_date is not null").groupBy("lawd_cd", "deal_type", quarter)
    out = rows.agg(F.count(F.lit(1)).alias("n_deals"), F.round(median, 1).alias("median_price"))
    label = F.concat(F.year("quarter_start").cast("string"), F.lit("Q"), F.quarter("quarter_start").cast("string"))
    return out.withColumn("label", label)


#: Size of a price sketch, and its rank error (DataSketches' KLL at 99 percent for that size); it is exact up to that many deals.
SKETCH, SKETCH_ERROR = 400, 0.0075


def price_sketches(deals: DataFrame, period: str = "month", k: int = SKETCH) -> DataFrame:
    """Deals and a KLL sketch of the price per square metre for each district, type and period.

    A sketch has a bounded size however many deals it takes in, and sketches merge, so a hot group is combined before
    the shuffle and months add up to quarters without the deals.
    """
    rows = deals.where("area > 0 and amount > 0 and deal_date is not null").groupBy("lawd_cd", "deal_type", F.trunc("deal_date", period).alias("start"))
    per = (F.col("amount") / F.col("area")).cast("double")
    return rows.agg(F.count(F.lit(1)).alias("n_deals"), F.kll_sketch_agg_double(per, F.lit(k)).alias("sketch"))


def quarter_prices(sketches: DataFrame, share: float = 0.5) -> DataFrame:
    """Deals and the quantile of the price by quarter, from the sketches of shorter periods."""
    rows = sketches.groupBy("lawd_cd", "deal_type", F.trunc("start", "quarter").alias("quarter_start"))
    merged = rows.agg(F.sum("n_deals").alias("n_deals"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.withColumn("price", F.kll_sketch_get_quantile_double("sketch", F.lit(share))).drop("sketch")


def latest_price(prices: DataFrame, least: int = 3) -> DataFrame:
    some = prices.where((F.col("n_deals") >= least) & F.col("median_price").isNotNull())
    return some.groupBy("lawd_cd", "deal_type").agg(F.max_by("median_price", "quarter_start").alias("latest_price"))


def segment_counts(training: DataFrame) -> DataFrame:
    keys = [F.coalesce(c, F.lit("")).alias(c) for c in ("sgg_code", "usage_lcl_cd")]
    return training.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def score_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.least(F.lit(90), (F.floor(F.col("score") / 10) * 10)).cast("int").alias("bucket"), "confidence").agg(F.count(F.lit(1)).alias("n"))


def matrix_report(features: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Per feature its missing share, with rows, target mean, p10 and p90; one aggregate over the table, turned on its side."""
    shares = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    y = F.col(target)
    about = [F.count(F.lit(1)).alias("_rows"), F.avg(y).alias("_mean"), F.percentile(y, F.lit(0.1)).alias("_p10"), F.percentile(y, F.lit(0.9)).alias("_p90")]
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    out = features.agg(*shares, *about).selectExpr(
        f"stack({len(columns)}, {pairs}) as (feature, missing)", "_rows as rows", "_mean as target_mean", "_p10 as target_p10", "_p90 as target_p90"
    )
    return out.orderBy(F.col("missing").desc(), "feature")


#: Limits of the health report: D-7 listings without detail, days to drain the backlog, past-date listings, share not seen.
WARN_D7, WARN_DRAIN, WARN_PAST, WARN_STALE = 300, 10, 300, 0.1


def health_report(props: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """One row: counters of the listings and scores in one pass, detail throughput of seven days, drain days, warnings.

    props: deleted_on, first_seen, last_seen, synced_on, refresh (dates and a flag), sale_date, lng, addresses, usage_nm,
    conv_addr, categories and flags (arrays), safety, confidence. runs: kind, started_at, ok.
    """
    day = F.lit(as_of).cast("date")
    active = F.col("deleted_on").isNull()
    count = lambda c: F.count(F.when(c, 1))
    behind = active & F.col("synced_on").isNull()
    houses = F.col("usage_nm").isin("단독주택", "단독주택다가구", "다가구주택")
    share = F.col("conv_addr").contains("지분") | F.col("conv_addr").contains("분의") | F.coalesce(F.array_contains("flags", "share_sale"), F.lit(False))
    counts = props.agg(
        count(active).alias("active"), count(F.col("deleted_on") >= F.date_sub(day, 1)).alias("closed_24h"),
        count(active & (F.col("sale_date") < F.date_sub(day, 2))).alias("past_active"), count(F.col("first_seen") >= F.date_sub(day, 1)).alias("new_24h"),
        count(behind).alias("backlog"), count(behind & F.col("sale_date").between(day, F.date_add(day, 7))).alias("backlog_d7"),
        count(active & F.col("refresh")).alias("refresh_pending"), count(active & (F.col("last_seen") < F.date_sub(day, 2))).alias("stale"),
        count(active & F.col("lng").isNull()).alias("no_coordinates"), count(active & F.col("road_addr").isNull() & F.col("lot_addr").isNull()).alias("no_address"),
        count(active & houses & (F.size("categories") == 0) & F.col("conv_addr").startswith("[건물") & ~share).alias("uncategorised"),
        count(active & F.col("safety").isNotNull()).alias("scored"), count(F.col("confidence") == "low").alias("scored_low"),
    )
    week = runs.where((F.col("kind") == "backfill_details") & (F.col("started_at") >= F.date_sub(day, 7)))
    rate = week.agg(F.coalesce(F.sum("ok") / F.count_distinct(F.to_date("started_at")), F.lit(0.0)).alias("per_day"))
    one = counts.withColumn("_", F.lit(1)).join(rate.withColumn("_", F.lit(1)), "_").drop("_")  # a row each
    one = one.withColumn("drain_days", F.when(F.col("per_day") > 0, F.col("backlog") / F.col("per_day")).otherwise(F.lit(float("inf"))))
    warnings = F.array(
        F.when(F.col("backlog_d7") > WARN_D7, "d7_detail_missing"), F.when(F.col("drain_days") > WARN_DRAIN, "slow_drain"),
        F.when(F.col("past_active") > WARN_PAST, "past_sale_active"), F.when(F.col("stale") > WARN_STALE * F.col("active"), "not_seen"),
    )
    return one.withColumn("warnings", F.filter(warnings, lambda x: x.isNotNull()))


def usage_audit(props: DataFrame) -> DataFrame:
    return props.groupBy("usage_lcl_cd", "usage_nm").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("deleted_on").isNull(), 1)).alias("active"))


def suspect_vehicles(props: DataFrame) -> DataFrame:
    """Active building rows that carry vehicle codes or words."""
    summary = F.col("building_summary")
    vehicle = F.col("usage_mcl_cd").startswith("301") | F.col("usage_mcl_cd").startswith("311") | summary.contains("차량") | summary.contains("자동차")
    return props.where(F.col("deleted_on").isNull() & (F.col("usage_lcl_cd") == "20000") & vehicle)


def group_by_coord(rows: DataFrame, most: int = 25) -> DataFrame:
    """Points at six decimals with their count and first `most` members.

    Members are cut by rank before they are gathered, so a crowded point doesn't gather all of its rows.
    """
    from pyspark.sql import Window

    point = rows.where("lng is not null and lat is not null").select(
        F.format_string("%.6f,%.6f", F.col("lng"), F.col("lat")).alias("point"), "docid"
    )
    counts = point.groupBy("point").agg(F.count(F.lit(1)).alias("n"))
    ranked = point.withColumn("rank", F.row_number().over(Window.partitionBy("point").orderBy("docid"))).where(F.col("rank") <= most)
    members = ranked.groupBy("point").agg(F.array_join(F.array_sort(F.collect_list("docid")), ",").alias("members"))
    return counts.join(members, "point")


def active_region_types(props: DataFrame, kind: Column) -> DataFrame:
    """lawd_cd, deal_type of active listings; every region has apt."""
    lawd = F.concat("sd_code", "sgg_code").alias("lawd_cd")
    rows = props.where("deleted_on is null").select(lawd, kind.alias("deal_type")).where(F.length("lawd_cd") == 5)
    both = rows.where("deal_type is not null").unionByName(rows.select("lawd_cd", F.lit("apt").alias("deal_type")))
    return both.distinct()


def scan_totals(scan: DataFrame) -> DataFrame:
    """Rows and listings per status, and the grand total, by one rollup."""
    out = scan.rollup("status").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("listings"), F.grouping("status").alias("all"))
    return out.select(F.when(F.col("all") == 1, "all").otherwise(F.col("status")).alias("status"), "rows", "listings")
