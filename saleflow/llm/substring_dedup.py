"""Removal of passages that repeat across documents: paragraph MinHash banding, exact checks, components.

Two kinds of paragraphs, both of whole texts and both treated alike:

* Lines of at least LINE_WORDS words.
* Windows of WINDOW words, since a passage can stand inside a line or run over several. They start where a five-word
  shingle's hash is the least of some SPREAD neighbouring ones (winnowing), so the same words are cut alike wherever they
  stand, and every verbatim passage of WINDOW + SPREAD - 1 words holds a window.

1. The five-word shingles of a paragraph get a MinHash signature in bands: for lines as many bands of ROWS hashes as make a
   pair of similarity 0.8 collide with probability RECALL, for windows, which only have to meet their verbatim copies, one
   of WINDOW_ROWS hashes.
2. Bands that stand in one document only are dropped, by a grouped minimum and maximum.
3. Of the paragraphs that collide all those with an exact Jaccard similarity of 0.8 or more are connected (by a signature
   tree for each bucket); paragraphs of the same shingles are one from the start.
4. Components of these links are the clusters. In each the document with the least doc_id keeps its paragraph; the others
   lose theirs. Overlapping and adjacent removals are one span. Repeats inside one document stay. class_id is the least
   doc_id that a document reaches over such removals.

Paragraphs in very many documents are hot keys: they are counted before any shuffle of their rows, and met by broadcast
(`join_on_hot`). Very long texts give more paragraphs, each handled alone. Ties: the least doc_id keeps.
Nulls: a null text has no words and stays null; rows with a null doc_id take no part. Rows that share a doc_id count as
one document for the clusters; each loses the spans found in any of them. Empty table: no rows. Other columns pass,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_rounds, join_on_hot, saved, split_by_keys, swept
from .components import components
from .jaccard_join import BLOCK_SETS, BLOCK_SHINGLES, block_links
from .shingles import _mix, shingle_hashes, word_hashes
from .tokens import release, text_slices

K, PERCENT, LINE_WORDS, WINDOW, SPREAD, RECALL = 5, 80, 20, 20, 20, 0.99
#: UTF-8 bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 3 << 19
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tuned_bands(similarity: float, recall: float, rows: int) -> int:
    """Fewest bands of `rows` hashes with which a pair of that similarity collides with probability `recall`."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


ROWS, WINDOW_ROWS = 4, 8
BANDS = tuned_bands(PERCENT / 100, RECALL, ROWS)
UNITS = "doc_id long, first int, end int, key long, bands array<bigint>"


def _reduce(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """ufunc over values[first:end] of each (not empty) range."""
    if not len(first):
        return values[:0]
    padded = np.append(values, values[:1])
    return ufunc.reduceat(padded, np.column_stack([first, end]).ravel())[::2]


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word offsets of lines, line offsets of texts, word offsets of texts)."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    words, lines = word_hashes(lists.flatten())
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    return words, lines, at, lines[at]


def _signatures(windows: np.ndarray, first: np.ndarray, end: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    """MinHash bands of `rows` hashes of windows[first:end]."""
    out = np.zeros((len(first), n_bands), np.uint64)
    for b in range(n_bands):
        band = np.full(len(first), b + 1, np.uint64)
        for r in range(rows):
            seed = np.uint64(0x9E3779B97F4A7C15 * (2 * (b * rows + r) + 1) & 0xFFFFFFFFFFFFFFFF)
            band = _mix(band * np.uint64(31) + _reduce(np.minimum, (windows ^ seed) * (seed | np.uint64(1)), first, end))
        out[:, b] = band
    return out


def _sliding(ufunc: np.ufunc, values: np.ndarray, n: int) -> np.ndarray:
    """ufunc over values[i:i+n] for each i (fewer at the end)."""
    out, have = values.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[:-step] = ufunc(out[:-step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places at which a window starts: hashes[p] is the least of some SPREAD places of its document (of all, if it has fewer).

    `docs`: word offsets; a window at p ends in its document.
    """
    places = np.maximum(np.diff(docs) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(places)), places)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(places) - places, places) + docs[:-1][doc]
    if not len(at):
        return at
    h = hashes[at] >> np.uint64(1)
    gap = SPREAD  # places between documents, so that no range spans two
    spread = np.full(len(at) + gap * (len(places) + 1), np.uint64(0x7FFFFFFFFFFFFFFF))
    mine = np.arange(len(at)) + gap * (doc + 1)
    spread[mine] = h
    least = _sliding(np.minimum, spread, SPREAD)
    whole = np.zeros(len(spread), bool)  # ranges that lie in a document, and the first of those with fewer places
    start = np.cumsum(places) - places
    left = start[doc] + places[doc] - np.arange(len(at))
    whole[mine] = (left >= SPREAD) | (np.arange(len(at)) == start[doc])
    least[~whole] = 0
    best = _sliding(np.maximum, least[::-1], SPREAD)[::-1]  # over the ranges that hold a place
    return at[best[mine] == h]


def units(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines, then windows: (row of the text, first word, end word, key, bands); `key` tells the bag of shingles."""
    words, lines, at, docs = _lines(texts)
    windows = shingle_hashes(words, K)
    mixed = _mix(windows)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    long = np.flatnonzero(np.diff(lines) >= LINE_WORDS)
    first, end = lines[long], lines[long + 1] - K + 1
    yield row[long], first - docs[row[long]], lines[long + 1] - docs[row[long]], _mix(_reduce(np.add, mixed, first, end)), _signatures(windows, first, end, BANDS, ROWS)
    first = anchors(mixed, docs)
    end = first + WINDOW - K + 1
    doc = np.searchsorted(docs, first, "right") - 1
    yield doc, first - docs[doc], first + WINDOW - docs[doc], _mix(_reduce(np.add, mixed, first, end)), _signatures(windows, first, end, 1, WINDOW_ROWS)


def unit_table(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start, n in text_slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(start, n)
                with np.errstate(over="ignore"):
                    for row, first, end, keys, bands in units(batch.column(1).slice(start, n)):
                        offsets = pa.array(np.arange(len(row) + 1) * bands.shape[1], pa.int32())
                        lists = pa.ListArray.from_arrays(offsets, pa.array(bands.view(np.int64).ravel()))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(row)), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(keys.view(np.int64)), lists],
                            ["doc_id", "first", "end", "key", "bands"],
                        )

    narrow = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return saved(narrow.mapInArrow(cut, UNITS), "units")


def colliding(table: DataFrame) -> DataFrame:
    """Paragraphs by band (doc_id, first, end, key, band), but for most of the bands that stand in one document alone."""
    banded = table.select("doc_id", "first", "end", "key", F.explode("bands").alias("band"))
    steps = []
    for part in in_rounds(banded, "band", table.count()):
        seen = part.groupBy("band").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"))
        steps.append(swept(saved(seen.where("low < top").select(F.col("band").alias("of")), "bands")))
    shared = reduce(DataFrame.unionByName, steps)
    return swept(saved(split_by_keys(banded, F.col("band"), shared, F.col("of"))[0], "colliding"), *steps)


def _connected(sets: dict[int, tuple[np.ndarray, int]]) -> Iterator[tuple[int, int]]:
    """Links that connect all lines of one task (key: shingles, side) that have similarity 0.8 or more."""
    keys = list(sets)
    if len(keys) == 2:
        (x, _), (y, _) = sets.values()
        common = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * common >= PERCENT * (len(x) + len(y) - common):
            yield keys[0], keys[1]
    elif len(keys) > 2:
        side = np.array([x[1] for x in sets.values()])
        for a, b in block_links([x[0] for x in sets.values()], side, PERCENT):
            yield keys[a], keys[b]


def similar(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Links (a, b) between keys of `colliding` paragraphs; enough of them to connect every two that collide in a band and
    have similarity 0.8 or more.

    The paragraphs of a band's bucket are compared by a signature tree; buckets of the same paragraphs are one. Large
    buckets are cut in parts, and every pair of parts is a task.
    """
    banded = table.groupBy("band", "key").agg(F.max(F.col("end") - F.col("first")).alias("n"))  # copies combine before the shuffle
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("key")).alias("of")).where("lines > 1")
    parts = F.ceil(F.greatest(F.col("lines") / BLOCK_SETS, F.col("n") / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.select("band", F.xxhash64("of", "lines", parts).alias("block"), parts.alias("parts"))
    members = banded.join(buckets.hint("merge"), "band").groupBy("key").agg(F.collect_set(F.struct("block", "parts")).alias("blocks"))  # at most BANDS
    members = swept(saved(members, "members"))
    wanted, _ = split_by_keys(table.select("key", "doc_id", "first", "end"), F.col("key"), members.select(F.col("key").alias("of")), F.col("of"))
    places = wanted.groupBy("key").agg(F.min(F.struct("doc_id", "first", "end")).alias("u"))
    places = places.join(members.hint("merge"), "key").select("key", "u.doc_id", "u.first", "u.end", "blocks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each task of each line: the block and pair of parts, the line's side of the pair, its shingles."""
        names = ["block", "i", "j", "side", "key", "s"]

        def told() -> pa.RecordBatch:
            columns = [pa.array([x[c] for x in out], pa.int32() if 0 < c < 4 else pa.int64()) for c in range(5)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([x[5] for x in out], pa.list_(pa.int64()))], names)

        release()
        for batch in batches:
            for start, n in text_slices(batch.column(0), SLICE_BYTES):
                part = batch.slice(start, n)
                words, _, _, offsets = _lines(part.column(0))
                out, held = [], 0
                for at, end, mine in zip(offsets[:-1], offsets[1:], part.column(1), strict=True):
                    for x in mine.as_py():  # one document's at a time
                        if x["end"] > end - at:  # of another row with this doc_id
                            continue
                        windows = shingle_hashes(words[at + x["first"] : at + x["end"]], K)
                        with np.errstate(over="ignore"):
                            if _mix(_mix(windows).sum(keepdims=True)).view(np.int64)[0] != x["key"]:
                                continue
                        s = np.unique(windows).view(np.int64)
                        for block in x["blocks"]:
                            own = x["key"] % block["parts"]
                            for other in range(block["parts"]):
                                i, j = min(own, other), max(own, other)
                                out.append((block["block"], i, j, -1 if i == j else int(own == j), x["key"], s))
                                held += len(s)
                                if held > 1 << 20:
                                    yield told()
                                    out, held = [], 0
                yield told()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, mine, found = None, {}, []
        for batch in batches:
            shingles = batch.column(5)
            flat, ends = shingles.values.to_numpy().view(np.uint64), shingles.offsets.to_numpy()
            for k, (*now, side, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
                if now != task:
                    found += _connected(mine)
                    task, mine = now, {}
                mine[key] = (flat[ends[k] : ends[k + 1]], side)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])
            found = []
        found += _connected(mine)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    mine = places.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first", "end", "blocks")).alias("mine"))  # a document's own paragraphs
    mine = swept(saved(mine.withColumnRenamed("doc_id", "of"), "places"), members)
    near, _ = split_by_keys(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.col("doc_id"), mine, F.col("of"))
    texts = near.join(mine.hint("merge"), F.col("doc_id") == F.col("of")).select("text", "mine")
    tasks = texts.mapInArrow(sets, "block long, i int, j int, side int, key long, s array<bigint>")
    tasks = tasks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    return swept(saved(tasks.mapInArrow(compare, "a long, b long").distinct(), "links"), mine)


def removals(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Per paragraph of `unit_table` that goes: doc_id, first and end word, and the doc_id that keeps it (`source`).

    `table` is deleted on the way: only paragraphs whose key may stand among those that collide are read again.
    """
    collided = colliding(table)
    keys = saved(collided.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n")), "keys")
    again, _ = split_by_keys(table.select("doc_id", "first", "end", "key"), F.col("key"), keys.select(F.col("key").alias("of")), F.col("of"))
    again = saved(again, "again")
    swept(again, table)
    edges = similar(docs, collided)
    named = keys.join(components(edges).hint("merge"), F.col("key") == F.col("node"), "left")
    named = saved(named.select("key", "low", "top", "n", F.coalesce("component", "key").alias("cluster")), "clusters")
    swept(named, collided, keys, edges)
    sources = named.groupBy("cluster").agg(F.min("low").alias("source"), F.max("top").alias("last")).where("source < last")
    kept = saved(named.join(sources.drop("last").hint("merge"), "cluster").select("key", "source", "n"), "kept")
    swept(kept, named)
    rows, _ = split_by_keys(again, F.col("key"), kept.select(F.col("key").alias("of")), F.col("of"))
    total = kept.agg(F.sum("n").alias("n")).first().n or 0
    gone = join_on_hot(rows, kept, "key", "n", total).where("doc_id > source").select("doc_id", "first", "end", "source")
    return swept(saved(gone, "removals"), again, kept)


def _spans(parts: list[dict]) -> tuple[list[tuple[int, int]], set[int]]:
    spans: list[list] = []
    for x in sorted(parts, key=lambda x: (x["first"], x["end"])):
        if spans and x["first"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], x["end"])
            spans[-1][2].add(x["source"])
        else:
            spans.append([x["first"], x["end"], {x["source"]}])
    return [(a, b) for a, b, _ in spans], set().union(*(s for *_, s in spans))


def _without(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the words of the (rising, disjoint) spans, and how many these are."""
    out, last, gone = [], 0, 0
    words = enumerate(_WORD.finditer(text))
    for a, b in spans:
        for i, word in words:
            if i == a:
                out.append(text[last : word.start()])
            if i >= a:
                last, gone = word.end(), gone + 1
            if i == b - 1:
                break
    return "".join([*out, text[last:]]), gone


def dedup(docs: DataFrame, classes: bool = True) -> DataFrame:
    """Per document: `row` (its columns), text (what stays), n_words, n_removed (words), sources (doc_ids that keep them) and,
    if asked for, class_id (null for documents alone in theirs). Texts are shuffled once, those that lose or lend something."""
    gone = removals(docs, unit_table(docs))
    parts = gone.groupBy("doc_id").agg(F.collect_list(F.struct("first", "end", "source")).alias("parts"))
    parts = saved(parts.withColumnRenamed("doc_id", "of"), "parts")  # a document's own paragraphs
    swept(parts, gone)
    if classes:
        named = components(parts.select(F.col("of").alias("a"), F.explode("parts.source").alias("b")))
        both = parts.join(named.hint("merge"), F.col("of") == F.col("node"), "full_outer")
        parts = saved(both.select(F.coalesce("of", "node").alias("of"), "parts", F.col("component").alias("class_id")), "parts")
    else:
        parts = parts.withColumn("class_id", F.lit(None).cast("long"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    near, far = split_by_keys(whole, F.col("row.doc_id").cast("long"), parts, F.col("of"))  # documents that surely lose nothing aren't shuffled
    state = near.join(parts.hint("merge"), F.col("row.doc_id") == F.col("of"), "left").select("row", "parts", "class_id")
    if far is not None:
        state = state.unionByName(far.select("row", *(F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in ("parts", "class_id"))))
    row = state.schema["row"].dataType
    at = row.fieldNames().index("text")
    found = "text string, n_words long, n_removed long, sources array<bigint>, class_id long"
    schema = T.StructType([T.StructField("row", row), *T._parse_datatype_string(found).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start, n in text_slices(batch.column(0).field(at), SLICE_BYTES):
                part = batch.slice(start, n)
                before = part.column(0).field(at)
                texts, n_removed, sources = [], [], []
                for text, mine in zip(before.to_pylist(), part.column(1).to_pylist(), strict=True):
                    spans, from_ = _spans(mine or [])
                    text, gone = _without(text, spans) if spans and text else (text, 0)
                    texts.append(text)
                    n_removed.append(gone)
                    sources.append(sorted(from_) if gone else [])
                n_words = pc.count_substring_regex(pc.fill_null(before, ""), _WORD.pattern).cast(pa.int64())
                columns = [pa.array(texts, pa.string()), n_words, pa.array(n_removed, pa.int64()), pa.array(sources, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, part.column(2)], schema.fieldNames())

    return state.mapInArrow(cut, schema)


def report(found: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id, n_words, n_removed, sources and the text that stays."""
    doc_id = F.col("row.doc_id").alias("doc_id")
    return found.select(doc_id, F.coalesce("class_id", "row.doc_id").alias("class_id"), "n_words", "n_removed", "sources", "text")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what stays of their texts (and its length as n_chars); those of which no word stays go."""
    found = dedup(docs, classes=False).where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None}
    return found.select(*((new[c] if c in new else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
