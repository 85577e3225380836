"""A table of partitions that are swapped whole: fetched keys get new folders, all others keep theirs.

A manifest (a small Parquet table) names for each live partition the load that wrote it. A replacement writes the batch
into a load of its own and a new manifest without the fetched keys' old entries; a key that was fetched empty has no
entry. The stored rows are never read, and a reader opens the named folders alone, as both load and keys are partition
columns. Every step ends in a commit, so of two replacements from one version one fails.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import commits


def _manifest(spark: SparkSession, root: str, table: dict) -> DataFrame:
    schema = ", ".join(["_load string", *(f"`{k}` string" for k in table["keys"])])
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/manifests/{table['manifest']}")


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*(F.col(k).cast("string").alias(k) for k in keys)).distinct()


def replace(batch: DataFrame, fetched: DataFrame, root: str, keys: list[str], from_version: int | None = None) -> int:
    """Swap the partitions of `fetched` (key columns) for the rows of `batch`, also where the batch has none.

    Key columns must be set (a null key is an error); rows of `batch` outside the fetched keys are an error too.
    """
    spark = batch.sparkSession
    root = root.rstrip("/")
    version, table = commits.latest(spark, root)
    if from_version is not None and from_version != version:
        raise commits.Conflict(f"{root}: read as {from_version}, now {version}")
    load = commits.new_load()
    texts = [F.col(k).cast("string").alias(k) for k in keys]
    values = [c for c in batch.columns if c not in keys]
    batch.select(*values, *texts).repartition(*keys).write.partitionBy(*keys).parquet(f"{root}/data/_load={load}")
    written = _keyed(spark.read.schema(", ".join(f"`{k}` string" for k in keys)).parquet(f"{root}/data/_load={load}"), keys)
    wanted = _keyed(fetched, keys)
    stray = written.join(wanted, keys, "left_anti").limit(1).collect()
    if stray or wanted.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count():
        raise ValueError(f"keys that weren't fetched or are null: {stray}")
    live = written.select(F.lit(load).alias("_load"), *keys)
    if table:
        live = live.unionByName(_manifest(spark, root, table).join(wanted, keys, "left_anti").select("_load", *keys))
    name = commits.new_load()
    live.write.parquet(f"{root}/manifests/{name}")
    content = {"keys": keys, "manifest": name, "schema": batch.select(*values, *keys).schema.json(), "columns": batch.columns}
    return commits.commit(spark, root, version + 1, content)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The live partitions as of a commit, or of the last one."""
    root = root.rstrip("/")
    table = commits.latest(spark, root)[1] if version is None else commits.load(spark, root, version)
    schema = StructType.fromJson(json.loads(table["schema"]))
    keys, live = table["keys"], _manifest(spark, root, table)
    loads = [r._load for r in live.select("_load").distinct().collect()]  # at most one for each replacement
    stored = StructType([f for f in schema.fields if f.name not in keys])
    for name in [*keys, "_load"]:
        stored = stored.add(name, "string")
    if not loads:
        return spark.createDataFrame([], schema).select(*table["columns"])
    base = f"{root}/data"
    rows = spark.read.schema(stored).option("basePath", base).parquet(*(f"{base}/_load={x}" for x in loads))
    rows = rows.join(live, ["_load", *keys], "left_semi")  # prunes partitions while it runs
    return rows.select(*(F.col(c).cast(schema[c].dataType).alias(c) for c in table["columns"]))
