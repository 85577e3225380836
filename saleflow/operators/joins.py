"""Confirmation of sales, archives, code names and enrichments.

Masters carry no broadcast hint: Spark broadcasts them by their known size, and shuffles them when they are large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finalize_sold(props: DataFrame, results: DataFrame) -> DataFrame:
    """Deleted, open listings with a result become sold (amount above 0) or not sold; the others stay open."""
    amounts = results.groupBy("docid").agg(F.max(F.struct("sale_date", "sale_amount")).alias("r"))
    joined = props.join(amounts, "docid", "left")
    open_ = F.col("deleted_on").isNotNull() & F.col("sold").isNull() & F.col("r").isNotNull()
    won = F.coalesce(F.col("r.sale_amount") > 0, F.lit(False))
    out = joined.withColumn("sold", F.when(open_, won).otherwise(F.col("sold")))
    return out.withColumn("sold_amount", F.when(open_ & won, F.col("r.sale_amount"))).drop("r")


def count_finalizable(props: DataFrame, results: DataFrame) -> DataFrame:
    """How many deleted, open listings have a result."""
    open_ = props.where("deleted_on is not null and sold is null").select("docid")
    return open_.join(results.select("docid"), "docid", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def sale_archive(results: DataFrame, props: DataFrame) -> DataFrame:
    extra = props.select("docid", F.col("usage_nm").alias("prop_usage"), "lot_addr")
    rate = F.round(F.col("sale_amount") / F.col("appraisal_amount").cast("double") * 100, 1)
    sold = results.where("sale_amount > 0").join(extra, "docid", "left")
    return sold.select("docid", "sd_code", "sgg_code", "emd_code", "sale_date", "sale_amount", rate.alias("rate"), F.coalesce("usage_nm", "prop_usage").alias("usage"), "lot_addr")


def resolve_code_names(props: DataFrame, courts: DataFrame, sgg: DataFrame) -> DataFrame:
    """Court and district names; a district code counts only with its province."""
    return props.join(courts.select("court_code", "court_name"), "court_code", "left").join(sgg, ["sd_code", "sgg_code"], "left")


def usage_label(props: DataFrame, usage: DataFrame, levels: tuple[str, ...] = ("usage_lcl_cd", "usage_mcl_cd", "usage_scl_cd")) -> DataFrame:
    """The names of a listing's usage codes, joined by ` › `; null where none is known."""
    out, names = props, []
    for i, c in enumerate(levels):
        if c in props.columns:
            out = out.join(usage.select(F.col("code").alias(c), F.col("name").alias(f"_u{i}")), c, "left")
            names.append(f"_u{i}")
    label = F.concat_ws(" › ", *names)
    return out.withColumn("usage_label", F.when(label != "", label)).drop(*names)


def canonical_masters(sgg: DataFrame) -> DataFrame:
    """District rows without those of another code than the canonical one."""
    return sgg.join(canonical_sgg(sgg).where("sgg_code = canonical").drop("canonical"), ["sd_code", "sgg_code"], "left_semi")


def canonical_sgg(sgg: DataFrame) -> DataFrame:
    """sd_code, sgg_code, canonical: the greatest code among districts of one name in a province."""
    top = sgg.groupBy("sd_code", "sgg_name").agg(F.max("sgg_code").alias("canonical"))
    return sgg.join(top, ["sd_code", "sgg_name"]).select("sd_code", "sgg_code", "canonical")


def canonicalize_sgg(df: DataFrame, sgg: DataFrame) -> DataFrame:
    moved = canonical_sgg(sgg)
    return df.join(moved, ["sd_code", "sgg_code"], "left").withColumn("sgg_code", F.coalesce("canonical", "sgg_code")).drop("canonical")


#: What a register is looked up by.
LOT_KEYS = ["sd_code", "sgg_code", "emd_code", "lot_no"]


def register_candidates(props: DataFrame, register: DataFrame, as_of: str, limit: int) -> DataFrame:
    """Active buildings with a whole lot key to look up, by docid: none with a final answer, none with an error younger than 30 days."""
    young = F.col("fetched_on") > F.date_sub(F.lit(as_of).cast("date"), 30)
    done = register.where(F.col("fetch_status").isin("ok", "not_found") | ((F.col("fetch_status") == "error") & young)).select("docid")
    keyed = props.where("deleted_on is null and usage_lcl_cd = '20000'").dropna(subset=LOT_KEYS)
    return keyed.join(done, "docid", "left_anti").orderBy("docid").limit(limit).select("docid", *LOT_KEYS)


def prior_round_ceiling(props: DataFrame, rounds: DataFrame) -> DataFrame:
    """docid, ceiling: least price of rounds before the listing's sale date.

    Rounds are first one for each listing and day, combined before the shuffle, so a listing with very many rounds comes
    to the join with no more rows than the calendar has days.
    """
    daily = rounds.where("round_price > 0").groupBy("docid", "round_date").agg(F.min("round_price").alias("round_price"))
    earlier = props.select("docid", "sale_date").join(daily, "docid").where("round_date < sale_date")
    return earlier.groupBy("docid").agg(F.min("round_price").alias("ceiling"))


def region_stat_for(props: DataFrame, stats: DataFrame) -> DataFrame:
    """docid, avg_rate, total_count: the exact usage row, or without a usage the largest of the district."""
    keys = ["sd_code", "sgg_code"]
    exact = stats.where("usage_lcl_cd is not null").select(*keys, "usage_lcl_cd", "avg_rate", "total_count")
    order = F.struct("total_count", F.coalesce("usage_lcl_cd", F.lit("")))
    largest = stats.groupBy(*keys).agg(F.max_by(F.struct("avg_rate", "total_count"), order).alias("s")).select(*keys, "s.*")
    with_usage = props.where("usage_lcl_cd is not null").join(exact, [*keys, "usage_lcl_cd"], "left")
    without = props.where("usage_lcl_cd is null").join(largest, keys, "left")
    columns = ["docid", "avg_rate", "total_count"]
    return with_usage.select(*columns).unionByName(without.select(*columns))


def anti_backlog(props: DataFrame, children: DataFrame, only: Column) -> DataFrame:
    """Listings that qualify and have no child row."""
    return props.where(only).join(children.select("docid"), "docid", "left_anti")


def photo_backlog(photos: DataFrame, limit: int) -> DataFrame:
    """Photos that aren't stored yet (no storage_path)."""
    return photos.where("storage_path is null").orderBy("docid", "seq").limit(limit).select("docid", "seq")


def jp_photo_backlog(listings: DataFrame, photos: DataFrame, limit: int) -> DataFrame:
    """Japanese listings with a photo's address and no photo row, by sale_unit_id."""
    rows = listings.where("photo_url <> ''").join(photos.select("sale_unit_id"), "sale_unit_id", "left_anti")
    return rows.orderBy("sale_unit_id").limit(limit).select("sale_unit_id", "photo_url")


def rate_note(rate: Column, average: Column) -> Column:
    """How a listing's rate stands to the regional one: below, above or equal, with whole points; null if either is missing."""
    points = lambda x: F.round(x, 0).cast("bigint").cast("string")
    low = F.concat(F.lit("현재 최저가는 평균 매각가율보다 "), points(average - rate), F.lit("%p 낮음 — 잠재 할인"))
    high = F.concat(F.lit("현재 최저가는 평균 매각가율보다 "), points(rate - average), F.lit("%p 높음 — 가격 매력 약함"))
    return F.when(rate < average, low).when(rate > average, high).when(rate == average, "평균 수준")
