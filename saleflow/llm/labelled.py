"""Labelled training rows for the scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int, limit_bytes: int | None = None) -> DataFrame:
    """doc_id, text, label of at most `limit` labelled documents, those of least id hash; `usable` is over doc_id.

    The limit bounds what is broadcast and trained on; with `limit_bytes` those documents are left out whose texts, in the
    same order, go beyond so many bytes together. Repeated labels of a document count once, by the lowest.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "of")
    texts = docs.select("doc_id", F.col("text").cast("string"))
    if limit_bytes is not None:
        sizes = texts.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
        total = F.sum("size").over(Window.orderBy(F.xxhash64("of"), "of", "size"))  # of some `limit` rows
        fits = sizes.withColumn("total", total).groupBy("of", "y").agg(F.max("total").alias("total")).where(F.col("total") <= limit_bytes)
        chosen = fits.drop("total")
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", "text", "y")
