"""Shared folder, written intermediate tables and column helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name inside the session's `spark.checkpoint.dir`.

    Without that setting only a local session, as in tests, gets a folder of its own; on a cluster it is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("saleflow.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-saleflow-")
        spark.conf.set("saleflow.shared.dir", root)
    return f"{root.rstrip('/')}/saleflow-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later stages don't depend on its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*written: DataFrame) -> None:
    """Delete tables of `saved` that nothing reads any more."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def swept(df: DataFrame, *written: DataFrame) -> DataFrame:
    """`df` (a table of `saved`), once tables that it was made of are deleted with the shuffle files of the jobs before it.

    Spark deletes shuffle files when the driver happens to collect the plans that made them; a driver with a large heap
    may not do so within a run, so that the files of all steps would lie on the disks together.
    """
    forget(*written)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


#: Rows to shuffle from which on a shuffle is made in rounds, and how many these are.
ROUND_ROWS, ROUNDS = 1_000_000, 4


def in_rounds(df: DataFrame, key: str, rows: int) -> list[DataFrame]:
    """`df` in parts by its (hashed, long) key, so that the shuffles of one after the other take a ROUNDS-th of the disk each."""
    n = ROUNDS if rows > ROUND_ROWS else 1
    return [df.where(F.pmod(F.col(key), F.lit(n)) == i) if n > 1 else df for i in range(n)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Places of a key filter for each key (a power of two near it), the largest filter that is broadcast, in bytes, and the
#: bits of one of its rows.
PLACES, FILTER_BYTES, ROW_BITS = 12, 64 << 20, 1 << 15


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame, other: Column) -> tuple[DataFrame, DataFrame | None]:
    """(rows of `df` whose key may be in `keys`, the others); only the first have to be shuffled to a join with `keys`.

    `keys` is a written table: it is counted, and its keys' hashes set bits of a map with PLACES places a key, so some six
    in seven of the other rows are told whatever the input. The map is broadcast; one beyond FILTER_BYTES isn't made, and
    all rows are in the first part (the second is None). Null keys are in the second part, if there is one.
    """
    bits = 1 << max(15, (keys.count() * PLACES - 1).bit_length())
    if bits > 8 * FILTER_BYTES:
        return df, None
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    at = keys.where(other.isNotNull()).select(place(other).alias("p")).select("p", F.floor(F.col("p") / ROW_BITS).cast("int").alias("_saleflow_row"))
    at = at.repartition("_saleflow_row")  # places are narrower than the maps of all tasks
    rows = at.groupBy("_saleflow_row").agg(F.bitmap_construct_agg(F.pmod("p", F.lit(ROW_BITS))).alias("_saleflow_bits"))
    marked = df.withColumn("_saleflow_place", F.when(key.isNotNull(), place(key)))
    marked = marked.withColumn("_saleflow_row", F.floor(F.col("_saleflow_place") / ROW_BITS).cast("int"))
    marked = marked.join(F.broadcast(rows), "_saleflow_row", "left")
    bit = F.pmod("_saleflow_place", F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("_saleflow_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))
    marked = marked.withColumn("_saleflow_hit", hit)
    return marked.where("_saleflow_hit").select(*_named(df)), marked.where("not _saleflow_hit").select(*_named(df))


def _named(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


#: A key is hot if it has more than this share of all rows (and of this count): there are fewer than 1 / share of them.
HOT_SHARE, HOT_ROWS = 0.001, 1000


def join_on_hot(rows: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join with a written table of one row for each key; `n` is how many of the `total` rows have it.

    The fewer than 1 / HOT_SHARE hot keys are broadcast, so their rows stay where they are; the others are shuffled.
    """
    hot = F.col(n) > max(HOT_ROWS, int(total * HOT_SHARE))
    few = one.where(hot).drop(n)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(one.where(~hot).drop(n).hint("merge"), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)
