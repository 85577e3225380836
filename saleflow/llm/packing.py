"""Packing of tokenized documents into fixed windows by best-fit decreasing.

`pieces` tokenizes: a document is its ids and an end id, cut into full windows and a remainder.
`pack` spreads the pieces evenly over groups of bounded size, whatever their keys, and packs each group: pieces by
falling length, each into the tightest open window that holds it. A segment tree over the remaining capacities finds
that window in log2(capacity) steps. A group of 20,000 pieces wastes well under a hundredth of its windows, so more
groups (more input) cost no density.

Very long texts are many full pieces, dealt like others. Ties of length go by doc_id, then start. Nulls: a null text counts as empty (one piece with the end id alone); a null doc_id stays null. Repeated rows are
packed each. Empty table: no rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long, padded_length long"
GROUP_PIECES = 20_000
#: UTF-8 bytes of text tokenized at once.
SLICE_BYTES = 7 << 20


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` ids; `with_ids` adds them (`ids`, little-endian uint32)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, slice_bytes=SLICE_BYTES)
        for batch in batches:
            flat, counts = encode(batch.column(1))
            keys, out, ids_out = batch.column(0).to_pylist(), [], []
            end = np.array([end_id], "<u4")
            at = 0
            for key, n in zip(keys, counts.tolist(), strict=True):
                data = np.concatenate([flat[at : at + n], end]).astype("<u4", copy=False).tobytes()
                at += n
                for start in range(0, n + 1, capacity):
                    part = data[4 * start : 4 * (start + capacity)]
                    out.append((key, start, len(part) // 4, zlib.crc32(part), n + 1))
                    if with_ids:
                        ids_out.append(part)
            columns = [pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids_out, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length; `lengths` fall and are from 1 to `capacity`."""
    leaves = 1 << capacity.bit_length()
    tree = [0] * (2 * leaves)  # tree[leaves + r]: open windows with r left; above: sums of both children
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    windows, offsets, opened = [], [], 0

    def add(room: int, step: int) -> None:
        node = leaves + room
        while node:
            tree[node] += step
            node >>= 1

    def tightest(room: int) -> int:
        """The least remaining capacity of at least `room` that a window has, or -1."""
        node = leaves + room
        if tree[node]:
            return room
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return -1

    for length in lengths:
        room = tightest(length)
        if room < 0:
            window, room, opened = opened, capacity, opened + 1
        else:
            window = stacks[room].pop()
            add(room, -1)
        windows.append(window)
        offsets.append(capacity - room)
        if room > length:
            stacks[room - length].append(window)
            add(room - length, 1)
    return windows, offsets


def pack(parts: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id, offset (gapless from 0 in each sequence) and padded_length to the pieces.

    A sequence is padded to `capacity` unless its length is a power of two. `parts` must be a written table: it is
    counted before it is dealt out.
    """
    groups = max(1, math.ceil(parts.count() / group_pieces))
    extra = [f for f in parts.schema.fields if f.name not in {x.split()[0] for x in PIECES.split(", ")}]
    schema = ", ".join([PACKED, *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        rows = pa.Table.from_batches(got)
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        lengths = rows["length"].to_numpy()
        windows, offsets = best_fit_decreasing(lengths.tolist(), capacity)
        windows = np.array(windows, np.int64)
        sums = np.bincount(windows, lengths).astype(np.int64)
        padded = np.where(sums & (sums - 1), capacity, sums)
        group = TaskContext.get().partitionId()
        rows = rows.append_column("sequence_id", pa.array(windows + (group << 32)))
        rows = rows.append_column("offset", pa.array(offsets, pa.int64()))
        rows = rows.append_column("padded_length", pa.array(padded[windows]))
        yield from rows.select([x.split()[0] for x in PACKED.split(", ")] + [f.name for f in extra]).to_batches()

    return parts.repartition(groups).mapInArrow(fill, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Documents to packed pieces, one row per piece."""
    return pack(saved(pieces(docs, tokenizer, capacity, with_ids=with_ids), "pieces"), capacity)
