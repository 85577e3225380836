"""A table with a row for each key that is merged on read: a base in buckets of the key, and deltas.

An upsert writes the rows of its batch alone, as a delta; a reader takes the newest row of each key. `compact` writes
new base folders for the buckets that have deltas and leaves the others. Every step ends in a commit (`commits`), so a
writer that has read an old version fails with a Conflict and changes nothing. Deltas stay as the table's history.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from saleflow.operators import merge
from saleflow.operators.windows import dedupe_last

from . import commits

#: Columns of a delta beside the table's own.
MORE = "_version long, _changed array<string>, _previous string, _now string"
PLACE = "_load string, _bucket int"
#: What commits tell as rows.
RUNS = "version long, kind string, stream string, batch long, complete boolean, started_at string, rows long, bytes long, metrics map<string,long>"


def _bucket(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("_bucket")


def _schema(table: dict, more: str = "") -> StructType:
    out = StructType.fromJson(json.loads(table["schema"]))
    for part in (more, PLACE):
        for field in StructType.fromDDL(part).fields if part else []:
            out = out.add(field)
    return out


def _write(rows: DataFrame, root: str) -> str:
    load = commits.new_load()
    rows.write.partitionBy("_bucket").parquet(f"{root.rstrip('/')}/data/_load={load}")
    return load


def _folders(spark: SparkSession, root: str, loads: list[str], schema: StructType) -> DataFrame:
    base = f"{root.rstrip('/')}/data"
    paths = [f"{base}/_load={x}" for x in loads]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create(rows: DataFrame, root: str, key: str, buckets: int = 64) -> int:
    """Commit 0: `rows` (one for each key) as the base."""
    spark = rows.sparkSession
    load = _write(rows.select("*", _bucket(key, buckets)).repartition("_bucket"), root)
    table = {"kind": "create", "key": key, "buckets": buckets, "schema": rows.schema.json(), "base": {str(b): load for b in range(buckets)}, "deltas": [], "batches": {}}
    return commits.commit(spark, root, 0, table)


def _read(spark: SparkSession, root: str, table: dict, buckets: list[int] | None) -> DataFrame:
    """The newest row of each key with its _bucket; other buckets' folders aren't opened."""
    wanted = sorted(map(int, table["base"])) if buckets is None else buckets
    loads: dict[str, list[int]] = {}
    for b in wanted:
        loads.setdefault(table["base"][str(b)], []).append(b)
    own = F.lit(False)
    for load, mine in loads.items():
        own = own | ((F.col("_load") == load) & F.col("_bucket").isin(mine))
    columns = StructType.fromJson(json.loads(table["schema"])).fieldNames()
    base = _folders(spark, root, list(loads), _schema(table)).where(own).select(*columns, "_bucket")
    deltas = [d["load"] for d in table["deltas"] if buckets is None or set(d["buckets"]) & set(buckets)]
    if not deltas:
        return base
    key = table["key"]
    rows = _folders(spark, root, deltas, _schema(table, MORE)).where(F.col("_bucket").isin(wanted))
    newest = dedupe_last(rows, [key], ["_version"]).select(*columns, "_bucket")
    return base.join(newest.select(key), key, "left_anti").unionByName(newest)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of a commit, or of the last one."""
    table = commits.latest(spark, root)[1] if version is None else commits.load(spark, root, version)
    return _read(spark, root, table, None).drop("_bucket")


def _upsert(spark: SparkSession, root: str, version: int, table: dict, rows: DataFrame, counted: dict[str, Column], told: dict) -> tuple[int, dict]:
    """Write `rows` (the table's columns, _bucket and those of MORE) as a delta and commit it with its counts, from one job."""
    seen = Observation()
    counts = {"rows": F.count(F.lit(1)), **counted}
    rows = rows.observe(seen, *(v.alias(k) for k, v in counts.items()), F.collect_set("_bucket").alias("_buckets"))
    load = _write(rows.drop("_new", "_back"), root)  # columns that are counted, not stored
    got = dict(seen.get)
    buckets = sorted(got.pop("_buckets") or [])
    delta = {"load": load, "buckets": buckets}
    content = table | told | {"deltas": [*table["deltas"], delta] if buckets else table["deltas"], "rows": got["rows"], "bytes": commits.size(spark, f"{root.rstrip('/')}/data/_load={load}"), "metrics": got, "load": load}
    return commits.commit(spark, root, version + 1, content), got


def merge_scan(
    root: str, scan: DataFrame, signals: list[str], order: list[str], seen: Column, *, stream: str = "", batch: int | None = None, complete: bool = False, started_at: str = "", regions: dict[str, list[str]] | None = None,
    from_version: int | None = None, refresh_on: tuple[str, ...] = merge.REFRESH_ON,
) -> tuple[int, dict]:
    """(version, counts): `merge.apply_scan` of a batch on the rows of its keys alone; bytes written follow the batch.

    A batch of a stream that was committed before changes nothing. Counts, from the writing job itself: rows, new,
    changed, unchanged, resurrected, and rows per value of a column for `regions` (column: its values). `complete` marks
    the end of a whole scan for `runs`. `from_version` is the version that the caller has read (else the last one).
    """
    spark = scan.sparkSession
    version, table = commits.latest(spark, root)
    if batch is not None and table["batches"].get(stream, -1) >= batch:
        return version, table["metrics"]
    if from_version is not None and from_version != version:
        raise commits.Conflict(f"{root}: read as {from_version}, now {version}")
    key = table["key"]
    last = dedupe_last(scan, [key], order)
    touched = [r._bucket for r in last.select(_bucket(key, table["buckets"])).distinct().collect()]  # at most the buckets' number
    old = _read(spark, root, table, touched).drop("_bucket").join(last.select(key), key, "left_semi")
    both = merge.merged_rows(old, last, key, signals, seen, refresh_on)
    count = lambda c: F.count(F.when(c, 1))
    changed = F.coalesce(F.size("_changed"), F.lit(0)) > 0
    counted = {"new": count(F.col("_new")), "changed": count(~F.col("_new") & changed), "unchanged": count(~F.col("_new") & ~changed), "resurrected": F.count("_back")}
    for column, values in (regions or {}).items():
        counted |= {f"{column}={v}": count(F.col(column) == v) for v in values}
    rows = both.select("*", _bucket(key, table["buckets"]), F.lit(version + 1).cast("long").alias("_version"))
    told = {"kind": "search", "stream": stream, "batch": batch, "complete": complete, "started_at": started_at}
    told["batches"] = table["batches"] | ({stream: batch} if batch is not None else {})
    columns = StructType.fromJson(json.loads(table["schema"])).fieldNames() + ["_version", "_changed", "_previous", "_now", "_bucket"]
    return _upsert(spark, root, version, table, rows.select(*dict.fromkeys([*columns, "_new", "_back"])), counted, told)


def close_aged(spark: SparkSession, root: str, since: Column, as_of: Column) -> tuple[int, dict]:
    """`merge.close_aged` as a delta of the rows that go; its guard is a complete scan among the table's own commits."""
    version, table = commits.latest(spark, root)
    gone = merge.close_aged(_read(spark, root, table, None), runs(spark, root), since, as_of, dry_run=True).withColumn("deleted_at", as_of)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("_changed", "array<string>"), ("_previous", "string"), ("_now", "string"))]
    rows = gone.select("*", F.lit(version + 1).cast("long").alias("_version"), *none)
    return _upsert(spark, root, version, table, rows, {}, {"kind": "close", "complete": False, "started_at": "", "batch": None})


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The commits: version, kind, stream, batch, complete, started_at, rows, bytes, metrics."""
    return commits.history(spark, root, RUNS)


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The change history of all scans: key, version, changed, previous, now."""
    table = commits.latest(spark, root)[1]
    loads = [r.load for r in commits.history(spark, root, "kind string, load string").where("kind = 'search'").collect()]  # a name for each commit
    rows = _folders(spark, root, loads, _schema(table, MORE)).where("_changed is not null")
    return rows.select(table["key"], *(F.col(f"_{c}").alias(c) for c in ("version", "changed", "previous", "now")))


def compact(spark: SparkSession, root: str) -> int:
    """Merge the deltas into new base folders of the buckets that they touch."""
    version, table = commits.latest(spark, root)
    touched = sorted({b for d in table["deltas"] for b in d["buckets"]})
    if not touched:
        return version
    load = _write(_read(spark, root, table, touched).repartition("_bucket"), root)
    base = table["base"] | {str(b): load for b in touched}
    content = table | {"kind": "compact", "base": base, "deltas": [], "complete": False, "rows": 0, "bytes": commits.size(spark, f"{root.rstrip('/')}/data/_load={load}"), "load": load}
    return commits.commit(spark, root, version + 1, content)
