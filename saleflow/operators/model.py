"""Sale-rate model: boosted trees for the 0.1, 0.5 and 0.9 quantiles, by pinball loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleflow.functions.scalars import deal_type, max_area

from . import quantile_trees
from .estimate import fallback_rates

#: The features, numbers and codes.
NUMBERS = ["appraisal_amount", "min_rate", "fail_count", "sale_month", "area_m2", "building_age", "region_price_m2", "region_avg_rate"]
LEVELS = ["usage_lcl_cd", "usage_mcl_cd", "sd_code", "lawd_cd", "court_code"]
#: Rows of a segment from which on the model is used, rows that a fit needs, and rows that a test and a hold-out need.
SEGMENT, LEAST, LEAST_ALL, LEAST_HELD = 10, 100, 200, 30


def features(rows: DataFrame, register: DataFrame, prices: DataFrame, stats: DataFrame, as_of: str) -> DataFrame:
    """The 13 features of one row per listing, for training and prediction alike; missing numbers stay missing, missing codes are ''.

    register: docid, building_year. prices: lawd_cd, deal_type, latest_price. stats: sd_code, sgg_code, usage_lcl_cd, avg_rate.
    """
    c = F.col
    code = lambda n: F.coalesce(c(n), F.lit(""))
    keyed = rows.select(
        "docid", *(n for n in ("target", "sale_date", "sgg_code", "min_sale_price") if n in rows.columns), c("appraisal_amount").cast("double"),
        (c("min_sale_price") / c("appraisal_amount").cast("double")).alias("min_rate"), c("fail_count").cast("double"), F.month("sale_date").cast("double").alias("sale_month"),
        max_area(c("area_text")).alias("area_m2"), *(code(n).alias(n) for n in ("usage_lcl_cd", "usage_mcl_cd", "sd_code", "court_code")),
        F.concat(code("sd_code"), code("sgg_code")).alias("lawd_cd"), F.coalesce(deal_type(c("usage_nm"), c("usage_lcl_cd")), F.lit("apt")).alias("deal_type"),
    )
    age = register.select("docid", (F.year(F.lit(as_of).cast("date")) - c("building_year")).cast("double").alias("building_age"))
    rate = stats.select(F.concat(code("sd_code"), code("sgg_code")).alias("lawd_cd"), code("usage_lcl_cd").alias("usage_lcl_cd"), c("avg_rate").cast("double").alias("region_avg_rate"))
    price = prices.select("lawd_cd", "deal_type", c("latest_price").cast("double").alias("region_price_m2"))
    return keyed.join(age, "docid", "left").join(price, ["lawd_cd", "deal_type"], "left").join(rate, ["lawd_cd", "usage_lcl_cd"], "left")


def fit(rows: DataFrame, least: int = LEAST, **options) -> quantile_trees.Trees | None:
    """The fitted trees, or None with under `least` rows; `options` go to `quantile_trees.fit`."""
    known = rows.where("target is not null")
    if known.limit(least).count() < least:
        return None
    return quantile_trees.fit(known, NUMBERS, LEVELS, "target", **options)


def predict(fitted: quantile_trees.Trees, rows: DataFrame) -> DataFrame:
    """docid, rate, low_rate, high_rate, with low <= rate <= high, clipped to 0.1 and 2.0."""
    out = quantile_trees.predict(fitted, rows, "docid")
    clip = lambda c: F.least(F.lit(2.0), F.greatest(F.lit(0.1), c))
    low, rate, high = (F.get("values", F.lit(i)) for i in range(3))
    return out.select("docid", clip(rate).alias("rate"), clip(F.least(low, rate)).alias("low_rate"), clip(F.greatest(high, rate)).alias("high_rate"))


#: Features whose presence an estimate tells.
TOLD = ["area_m2", "building_age", "region_price_m2", "region_avg_rate"]


def estimates(fitted: quantile_trees.Trees | None, rows: DataFrame, segments: DataFrame) -> DataFrame:
    """docid, method, samples, rate, low_rate, high_rate, features_used: the model where the listing's segment (sgg_code,
    usage_lcl_cd) has SEGMENT training rows, else the regional mean and 15 percent either way, else no row.

    `segments` is `segment_counts` of the training rows; `rows` are `features` with sgg_code.
    """
    counts = segments.select(F.col("sgg_code").alias("_g"), F.col("usage_lcl_cd").alias("_u"), F.col("n").alias("samples"))
    known = rows.join(counts, (F.coalesce("sgg_code", F.lit("")) == F.col("_g")) & (F.col("usage_lcl_cd") == F.col("_u")), "left").drop("_g", "_u")
    known = known.withColumn("samples", F.coalesce("samples", F.lit(0).cast("long")))
    used = F.struct(*(F.col(c).isNotNull().alias(c) for c in TOLD)).alias("features_used")
    keep = ["docid", "method", "samples", "rate", "low_rate", "high_rate", "features_used"]
    by_model = known.where(F.lit(fitted is not None) & (F.col("samples") >= SEGMENT)).select("*", used)
    rest = known.where(F.col("region_avg_rate").isNotNull() & (F.lit(fitted is None) | (F.col("samples") < SEGMENT))).select("*", used)
    out = rest.select("*", F.lit("region_avg").alias("method"), *fallback_rates(F.col("region_avg_rate"))).select(*keep)
    if fitted is None:
        return out
    told = by_model.select("docid", F.lit("model").alias("method"), "samples", "features_used").join(predict(fitted, by_model), "docid")
    return told.select(*keep).unionByName(out)


def metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """n, mean absolute error of the rate, mean absolute percentage error, error of the regional mean."""
    rows = predicted.join(truth, "docid").where("target is not null")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("rate") - F.col("target"))).alias("mae"),
        F.avg(F.abs(F.col("rate") / F.col("target") - 1)).alias("mape"), F.avg(F.abs(F.col("region_avg_rate") / 100 - F.col("target"))).alias("baseline_mae"),
    )


def evaluate(rows: DataFrame, as_of: str, holdout_days: int = 60) -> DataFrame:
    """Metrics on the newest rows of a model fitted to the older ones; no row with under 200 rows, 30 held or 100 to fit."""
    cut = F.date_sub(F.lit(as_of).cast("date"), holdout_days)
    known = rows.where("target is not null and sale_date is not null")
    held = known.where(F.col("sale_date") >= cut)
    n = known.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("sale_date") >= cut, 1)).alias("held")).first()
    fitted = fit(known.where(F.col("sale_date") < cut)) if n.n >= LEAST_ALL and n.held >= LEAST_HELD else None
    if fitted is None:
        return rows.sparkSession.createDataFrame([], "n long, mae double, mape double, baseline_mae double")
    return metrics(predict(fitted, held), held.select("docid", "target", "region_avg_rate"))
