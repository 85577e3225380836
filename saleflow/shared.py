"""Names in the folder that the driver and all executors share, and rows dealt out over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in `spark.checkpoint.dir`; only a local session, as in tests, may lack that setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/saleflow-{name}-{uuid.uuid4().hex}"


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` dealt by `keys` over tasks enough for all cores, for work that costs far more than a shuffle of its input.

    A Parquet file is read by at most a task for each of its row groups, which may hold a million rows. A number that is
    given isn't coalesced by AQE, which looks at bytes and not at work.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *(F.col(k) for k in keys))


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """`rows` behind a generator of one row, so that what made `columns` is worked out once for each row and not for every later use."""
    kept = [c for c in rows.columns if c not in columns]
    made = F.inline(F.array(F.struct(*(F.col(c) for c in columns))))
    return rows.select(*kept, made).select(*rows.columns)
