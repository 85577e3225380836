"""The page-wise scan as a Structured Streaming job: each micro-batch is a delta of a table that is merged on read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from saleflow.sources import commits, keyed_table


def scan_stream(
    stream: DataFrame, root: str, signals: list[str], order: list[str], checkpoint: str, seen: Callable[[int], str | Column], *, name: str = "scan", compact_after: int = 16, **options
) -> StreamingQuery:
    """Merges each batch into the keyed table at `root` (made by `keyed_table.create`); `options` go to `merge_scan`.

    A batch writes the rows of its own keys. Its number is part of the commit, so a batch that runs again, after a lost
    driver as well, changes nothing. With `compact_after` deltas the buckets that have some are written anew.
    """

    def merge(batch: DataFrame, number: int) -> None:
        at = seen(number)
        _version, _counts = keyed_table.merge_scan(root, batch, signals, order, at if isinstance(at, Column) else F.lit(at), stream=name, batch=number, **options)
        if len(commits.latest(batch.sparkSession, root)[1]["deltas"]) >= compact_after:
            keyed_table.compact(batch.sparkSession, root)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
