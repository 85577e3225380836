"""Features, regional fallback, procedural clamps, assumed deposits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target(sale: Column, appraisal: Column) -> Column:
    ratio = sale / appraisal.cast("double")
    return F.when((appraisal > 0) & ratio.between(0.1, 3.0), ratio)


def fallback_rates(rate: Column) -> list[Column]:
    """Regional mean (in percent) as estimate with a band of 15 percent, clipped to 0.1 and 2.0."""
    clip = lambda c: F.least(F.lit(2.0), F.greatest(F.lit(0.1), c))
    return [clip(rate / 100 * f).alias(n) for n, f in (("rate", 1.0), ("low_rate", 0.85), ("high_rate", 1.15))]


def clamp_estimate(appraisal: Column, rate: Column, low: Column, high: Column, floor: Column, ceiling: Column) -> Column:
    """Struct est, low, high, rate_pct, in the fixed order: ceiling (void under the floor), then floor, then rounding."""
    floor = F.when(floor > 0, floor.cast("double"))
    ceiling = F.when(floor.isNull() | (ceiling >= floor), ceiling.cast("double"))
    a = appraisal.cast("double")
    est, lo, hi = a * rate, a * low, a * high
    est = F.when(ceiling.isNotNull(), F.least(est, ceiling)).otherwise(est)
    hi = F.when(ceiling.isNotNull(), F.least(hi, ceiling)).otherwise(hi)
    lo = F.when(ceiling.isNotNull(), F.least(lo, est)).otherwise(lo)
    est = F.when(floor.isNotNull(), F.greatest(est, floor)).otherwise(est)
    lo = F.when(floor.isNotNull(), F.greatest(lo, floor)).otherwise(lo)
    hi = F.when(floor.isNotNull(), F.greatest(hi, est)).otherwise(hi)
    whole = lambda c: F.bround(c, 0).cast("bigint")
    return F.when(
        rate.isNotNull() & (a > 0),
        F.struct(whole(est).alias("est"), whole(lo).alias("low"), whole(hi).alias("high"), F.bround(est / a * 100, 1).alias("rate_pct")),
    )


def has_opposability(move_in: Column, lien: Column) -> Column:
    """Rights begin the day after moving in; null if a date is missing."""
    return F.date_add(move_in, 1) <= lien


def scenario_bids(minimum: Column, appraisal: Column) -> Column:
    """Up to five bids from the minimum to the greater of the appraisal and 1.3 times it, in whole millions."""
    top = F.greatest(appraisal.cast("double"), 1.3 * minimum)
    steps = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: (F.floor((minimum + (top - minimum) * i / 4) / 1_000_000 + 0.5) * 1_000_000).cast("bigint"))
    return F.when(minimum > 0, F.array_distinct(steps))


def simulate(tenants: DataFrame) -> DataFrame:
    """Deposit that a buyer takes over at `bid`, after costs, tax, small claims and ranked dividends."""
    cost = F.coalesce(F.col("cost") if "cost" in tenants.columns else F.lit(None).cast("double"), 2_000_000 + F.col("bid") * 0.005)
    out = tenants.withColumn("opposable", has_opposability(F.col("move_in"), F.col("lien_date")))
    out = out.withColumn("left0", F.greatest(F.lit(0.0), F.col("bid") - cost))
    out = out.withColumn("left1", F.col("left0") - F.least(F.col("left0"), F.greatest(F.lit(0.0), F.col("tax").cast("double"))))
    small = F.when(F.col("demanded") & (F.col("small_claim") > 0), F.least(F.col("left1"), F.col("small_claim").cast("double"), F.col("deposit").cast("double"))).otherwise(0.0)
    out = out.withColumn("small", small).withColumn("left2", F.col("left1") - F.col("small"))
    rank = F.when(F.col("move_in").isNull(), F.col("fixed_date")).otherwise(F.greatest(F.date_add("move_in", 1), F.col("fixed_date")))
    ranked = F.col("demanded") & F.col("fixed_date").isNotNull()
    first = F.coalesce(F.col("lien_date").isNotNull() & (rank < F.col("lien_date")), F.lit(False))
    after = F.when(first, F.col("left2")).otherwise(F.col("left2") - F.least(F.col("left2"), F.greatest(F.lit(0.0), F.col("senior").cast("double"))))
    share = F.when(ranked, F.least(after, F.greatest(F.lit(0.0), F.col("deposit") - F.col("small")))).otherwise(0.0)
    out = out.withColumn("dividend", F.col("small") + share)
    assumed = F.when(~F.col("opposable"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("deposit") - F.col("dividend")))
    return out.withColumn("assumed", assumed).withColumn("effective", F.col("bid") + F.col("assumed")).drop("left0", "left1", "left2", "small")
