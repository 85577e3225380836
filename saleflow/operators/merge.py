"""Snapshot merge: each scan against the stored state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import dedupe_last


#: Columns that a listing loses when it comes back from deletion, and signals whose change asks for a detail refresh.
BACK = ("sold", "sold_amount", "sold_date", "final_result", "finalized_at")
REFRESH_ON = ("fail_count", "sale_date", "sale_decision_date", "status_cd")


def changed_signals(signals: list[str], old: str = "o", new: str = "n") -> Column:
    """Names of signals with a new value that isn't null and differs."""
    found = [F.when(F.col(f"{new}.{c}").isNotNull() & ~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}")), c) for c in signals]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def merged_rows(state: DataFrame, last: DataFrame, key: str, signals: list[str], seen: Column, refresh_on: tuple[str, ...] = REFRESH_ON) -> DataFrame:
    """The new state after a scan with a row for each key, by one full outer join. Further columns: _new, _back (came back
    from deletion), and, for changed rows alone, _changed (signal names), _previous and _now (JSON of the signals)."""
    special = [c for c in (*BACK, "last_synced", "refresh") if c in state.columns]
    values = [c for c in state.columns if c not in (key, "last_seen", "deleted_at", *special)]
    o = state.select(F.col(key).alias("ok"), F.struct(*state.columns).alias("o"))
    n = last.select(F.col(key).alias("nk"), F.struct(*last.columns).alias("n"))
    both = o.join(n, F.col("ok") == F.col("nk"), "full_outer").withColumn("changed", changed_signals(signals))
    new, here = F.col("o").isNull(), F.col("n").isNotNull()
    told = ~new & here & (F.size("changed") > 0)
    take = here & (new | (F.size("changed") > 0))
    columns = {
        key: F.coalesce("ok", "nk"),
        **{c: F.when(take, F.coalesce(f"n.{c}", f"o.{c}")).otherwise(F.col(f"o.{c}")) if c in last.columns else F.col(f"o.{c}") for c in values},
        "last_seen": F.when(here, seen).otherwise(F.col("o.last_seen")),
        "deleted_at": F.when(here, F.lit(None)).otherwise(F.col("o.deleted_at")),
        **{c: F.when(~(here & F.col("o.deleted_at").isNotNull()), F.col(f"o.{c}")) for c in special if c in BACK},
        **{c: F.when(take, seen).otherwise(F.col("o.last_synced")) for c in special if c == "last_synced"},
        **{c: F.when(take & ~new & F.arrays_overlap("changed", F.array(*map(F.lit, refresh_on))), True).otherwise(F.col("o.refresh")) for c in special if c == "refresh"},
    }
    side = lambda x: F.when(told, F.to_json(F.struct(*(F.col(f"{x}.{c}").alias(c) for c in signals))))
    more = {"_new": new, "_back": F.when(here & F.col("o.deleted_at").isNotNull(), True), "_changed": F.when(told, F.col("changed")), "_previous": side("o"), "_now": side("n")}
    return both.select(*(columns[c].alias(c) for c in state.columns), *(v.alias(k) for k, v in more.items()))


def apply_scan(state: DataFrame, scan: DataFrame, key: str, signals: list[str], order: list[str], seen: Column, refresh_on: tuple[str, ...] = REFRESH_ON) -> tuple[DataFrame, DataFrame]:
    """(new state, history). The scan is last-wins per key; one full outer join on the key does the rest.

    New and changed rows take the scan's values where they aren't null; rows with unchanged signals keep all their columns;
    both get `last_seen`, the first also `last_synced` (if the state has it). Rows that come back from deletion lose
    deleted_at and the columns of BACK; changes of a signal in `refresh_on` set `refresh`. Changed rows alone write history.
    """
    merged = merged_rows(state, dedupe_last(scan, [key], order), key, signals, seen, refresh_on)
    history = merged.where("_changed is not null")
    history = history.select(key, seen.alias("observed_at"), F.col("_changed").alias("changed"), F.col("_previous").alias("previous"), F.col("_now").alias("now"))
    return merged.select(*state.columns), history


def close_aged(state: DataFrame, runs: DataFrame, since: Column, as_of: Column, dry_run: bool = False) -> DataFrame:
    """Rows not seen since then are deleted, if a complete search run (kind, complete, started_at) began since.

    A dry run gives the rows that would go and changes nothing.
    """
    complete = bool(runs.where((F.col("kind") == "search") & F.col("complete") & (F.col("started_at") >= since)).limit(1).count())
    gone = F.col("deleted_at").isNull() & (F.col("last_seen") < since) & F.lit(complete)
    if dry_run:
        return state.where(gone)
    return state.withColumn("deleted_at", F.when(gone, as_of).otherwise(F.col("deleted_at")))


def scan_counts(state: DataFrame, scan: DataFrame, key: str, signals: list[str], order: list[str]) -> DataFrame:
    """What `apply_scan` does, counted in one row: new, changed, unchanged and resurrected listings."""
    last = dedupe_last(scan, [key], order)
    o = state.select(F.col(key).alias("ok"), F.struct(*state.columns).alias("o"))
    n = last.select(F.col(key).alias("nk"), F.struct(*last.columns).alias("n"))
    both = n.join(o, F.col("ok") == F.col("nk"), "left").withColumn("changed", F.size(changed_signals(signals)) > 0)
    count = lambda c: F.count(F.when(c, 1))
    new = F.col("o").isNull()
    return both.agg(
        count(new).alias("new"), count(~new & F.col("changed")).alias("changed"), count(~new & ~F.col("changed")).alias("unchanged"),
        count(F.col("o.deleted_at").isNotNull()).alias("resurrected"),
    )


def upsert_log(log: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """The fetch log with the rows of every fetched key replaced, also where nothing was fetched."""
    return log.join(fetched.select(*keys), keys, "left_anti").unionByName(fetched)


def sync_where_distinct(df: DataFrame, other: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """`column` takes `value` of the other table where there is one; `synced` says whether it differed."""
    joined = df.join(other.select(key, F.col(value).alias("_value")), key, "left")
    differs = F.col("_value").isNotNull() & ~F.col("_value").eqNullSafe(F.col(column))
    return joined.withColumn("synced", differs).withColumn(column, F.coalesce("_value", column)).drop("_value")


def replace_partitions(stored: DataFrame, batch: DataFrame, fetched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of every fetched key are replaced, also by nothing."""
    return stored.join(fetched.select(*keys).distinct(), keys, "left_anti").unionByName(batch)


def plan_fetch(regions: DataFrame, log: DataFrame, as_of: str, months: int, budget: int) -> DataFrame:
    """lawd_cd, deal_type, month (yyyymm) to fetch: young months unlogged or older than 7 days, then the unlogged old ones."""
    day = F.lit(as_of).cast("date")
    month = F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.struct(i.alias("back"), F.date_format(F.add_months(day, -i), "yyyyMM").alias("month"))))
    jobs = regions.select("lawd_cd", "deal_type", month.alias("m")).select("lawd_cd", "deal_type", "m.*")
    fresh = log.select("lawd_cd", "deal_type", "month", F.col("fetched_on"))
    joined = jobs.join(fresh, ["lawd_cd", "deal_type", "month"], "left")
    young = F.col("back") < 2
    due = F.col("fetched_on").isNull() | (young & (F.col("fetched_on") < F.date_sub(day, 7)))
    order = [F.when(young, 0).otherwise(1), F.when(young, F.col("lawd_cd")), F.when(young, F.col("deal_type")), F.when(young, F.col("back")), F.col("month"), "lawd_cd", "deal_type"]
    return joined.where(due).orderBy(*order).limit(budget).select("lawd_cd", "deal_type", "month")
