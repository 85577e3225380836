"""Last-wins rows, current rounds, regional cases and change runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`. Spark cuts each task's rows to one per key before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*df.columns)


def current_round(props: DataFrame, rounds: DataFrame) -> DataFrame:
    """docid, current_price: earliest open regular round on the listing's own sale date."""
    open_ = rounds.where("result_cd is null and round_price > 0 and coalesce(kind_cd, '01') = '01'")
    here = props.where("deleted_on is null").select("docid", "sale_date").join(open_, "docid").where("round_date = sale_date")
    first = F.min(F.struct("seq", "round_price")).alias("r")
    return here.groupBy("docid").agg(first).select("docid", F.col("r.round_price").alias("current_price"))


def first_by(df: DataFrame, key: str, value: str, order: str, only: Column | None = None) -> DataFrame:
    rows = df if only is None else df.where(only)
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def regional_cases(props: DataFrame, archive: DataFrame, n: int = 8, enough: int = 3, by_usage: bool = False, keep_missing: bool = False) -> DataFrame:
    """Per listing the newest `n` sold cases of its neighbourhood, or of its district where there are under `enough`.

    With `by_usage` a listing that has a usage (usage_lcl_cd) meets cases of that usage alone. `keep_missing` gives
    listings without any case a row of nulls. The archive is ranked and cut per area first, so a listing never meets
    more than `n` rows of each scope.
    """
    sold = archive.where("sale_amount > 0")
    newest = [F.col("sale_date").desc(), F.col("docid")]

    def top(keys: list[str], scope: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        ranked = sold.withColumn("rank", F.row_number().over(w.orderBy(*newest))).where(F.col("rank") <= n)
        return ranked.select(*keys, F.col("docid").alias("case_docid"), "sale_amount", "rank", F.lit(scope).alias("scope"))

    def met(rows: DataFrame, more: list[str]) -> DataFrame:
        near, wide = ["sd_code", "sgg_code", "emd_code", *more], ["sd_code", "sgg_code", *more]
        close = top(near, "emd")
        full = close.groupBy(*near).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= enough).drop("k")
        keyed = rows.select("docid", *near)
        first = keyed.join(close.join(full, near), near).select("docid", "case_docid", "sale_amount", "rank", "scope")
        second = keyed.join(full, near, "left_anti").join(top(wide, "sgg"), wide).select("docid", "case_docid", "sale_amount", "rank", "scope")
        return first.unionByName(second)

    if by_usage:
        out = met(props.where("usage_lcl_cd is not null"), ["usage_lcl_cd"]).unionByName(met(props.where("usage_lcl_cd is null"), []))
    else:
        out = met(props, [])
    return props.select("docid").join(out, "docid", "left") if keep_missing else out


def change_runs(history: DataFrame, key: str, order: list[str], signals: list[str]) -> DataFrame:
    """Rows whose signals differ from the ones before, with the earlier values (prev_*)."""
    w = Window.partitionBy(key).orderBy(*order)
    for c in signals:
        history = history.withColumn(f"prev_{c}", F.lag(c).over(w))
    changed = F.lit(False)
    for c in signals:
        changed = changed | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"prev_{c}")))
    return history.withColumn("n", F.row_number().over(w)).where(changed & (F.col("n") > 1)).drop("n")
