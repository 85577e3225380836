"""Benchmark decontamination with suffix arrays over the training documents.

Each task turns its documents, a shard of about SHARD_BYTES at a time, into word ids and sorts the suffixes of the
shard by their leading words. Every benchmark suffix (a window of `window` words, or a whole shorter item) is then
binary-searched in that array; the range found gives all its verbatim places. Of places that follow each other the longest
matches are read off a suffix automaton of the item (built for items that a shard hits, in memory of some 500 bytes a
word): a match is kept if no match with the same item covers its words, at its first place in the item. So a passage of
n repeated words meets an item of n repeated words in n steps, not in n x n pairs. Suffixes whose leading words don't all occur in the benchmark match nothing,
so they are left out before the sort. Documents stay whole in one task: there is no shuffle, and hot passages cost one
range each.

The benchmark is used in blocks of at most BLOCK_BYTES; one block at a time is collected and broadcast. With more than one
block each pass reads the texts alone and writes the documents' hits, of documents that have any; they are put together
and joined to the documents once, so texts are never rewritten and no size is bounded by the driver.

Words: lower-cased A-Z, then runs of digits, a-z and characters from U+0080. Nulls and texts without words have no
words, no hits, no items. Very long texts are a shard of their own. Repeated rows are matched each. Windows that tie (in several
items) count for all of them. An empty benchmark leaves everything clean; an empty table
gives no rows. Other columns pass through, whatever their names; null item_ids take part as the string "null".
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, split_by_keys
from .tokens import ragged_gather

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
#: Letters to lower case, separators to blanks, bytes of other characters as they are.
_FOLD = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(128)).lower() + bytes(range(128, 256))
_END = b"|"


class Automaton:
    """The suffix automaton of a sequence: which stretches occur in it, and where each ends first."""

    def __init__(self, sequence: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for at, symbol in enumerate(sequence):
            last = self._add(last, symbol, at)

    def _state(self, follow: dict[int, int], link: int, length: int, end: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.link) - 1

    def _add(self, last: int, symbol: int, at: int) -> int:
        new = self._state({}, 0, self.length[last] + 1, at)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            to = self.next[state][symbol]
            if self.length[to] == self.length[state] + 1:
                self.link[new] = to
            else:
                twin = self._state(dict(self.next[to]), self.link[to], self.length[state] + 1, self.end[to])
                while state >= 0 and self.next[state].get(symbol) == to:
                    self.next[state][symbol] = twin
                    state = self.link[state]
                self.link[to] = self.link[new] = twin
        return new

    def longest(self, sequence: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, place in the automaton's sequence, length) of the matches that no other match covers."""
        state = length = 0
        for at, symbol in enumerate([*sequence, None]):
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
                continue
            if length:
                yield at - length, self.end[state] - length + 1, length
            while state and symbol not in self.next[state]:
                state = self.link[state]
            length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1


class BenchmarkSuffixes:
    """Windows of a block of benchmark items, as arrays of word ids."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.vocabulary = window, {_END: -1}
        self.item_ids = [x for x, _ in items]
        known: dict[tuple[int, ...], int] = {}
        self.rows: list[list[int]] = []  # the windows of each item in their order
        self.items_of: list[list[int]] = []  # the items of each window
        self.automata: dict[int, Automaton] = {}
        for k, (_, text) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text.encode().translate(_FOLD).split()]
            size = min(window, len(words))
            row = [known.setdefault(tuple(words[p : p + size]), len(known)) for p in range(len(words) - size + 1 if size else 0)]
            self.items_of.extend([] for _ in range(len(known) - len(self.items_of)))
            self.rows.append(row)
            for w in set(row):
                self.items_of[w].append(k)
        self.windows = list(known)
        self.least = min(map(len, self.windows), default=0)
        self.by_size = {n: [i for i, w in enumerate(self.windows) if len(w) == n] for n in {len(w) for w in self.windows}}

    def automaton(self, item: int) -> Automaton:
        if item not in self.automata:
            if len(self.automata) > 200:
                self.automata.clear()
            self.automata[item] = Automaton(self.rows[item])
        return self.automata[item]

    def keys(self, size: int, filler: int) -> np.ndarray:
        rows = np.full((len(self.by_size[size]), 4 * self.window), filler, np.uint8)
        rows[:, : 4 * size] = np.array([self.windows[i] for i in self.by_size[size]], ">i4").view(np.uint8).reshape(-1, 4 * size)
        return rows.view(f"S{4 * self.window}").ravel()

    def ranges(self, suffixes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(window, its length, first, end) in the sorted suffixes for each window that occurs."""
        for size, at in self.by_size.items():
            low = np.searchsorted(suffixes, self.keys(size, 0), "left")
            high = np.searchsorted(suffixes, self.keys(size, 255), "right")
            for i in np.flatnonzero(high > low):
                yield at[i], size, low[i], high[i]

    def search(self, texts: list[bytes]) -> list[tuple[int, list[int], set[int], list[tuple[int, int, int, int]]]]:
        """Per text: words, hit intervals [first, end, ...], items, longest matches (item, place in text, in item, words)."""
        words = (b" | ".join(t.translate(_FOLD) for t in texts) + b" |").split()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        ends = np.flatnonzero(ids == -1)
        firsts = np.concatenate([[0], ends[:-1] + 1])
        out: list = [(int(n), [], set(), []) for n in ends - firsts]
        if not self.windows:
            return out
        known, breaks = np.flatnonzero(ids > 0), np.flatnonzero(ids <= 0)
        begin = known[breaks[np.searchsorted(breaks, known)] - known >= self.least]
        padded = np.concatenate([np.maximum(ids, 0), np.zeros(self.window, np.int32)]).astype(">i4")
        suffixes = np.ascontiguousarray(padded[begin[:, None] + np.arange(self.window)]).view(f"S{4 * self.window}").ravel()
        order = np.argsort(suffixes, kind="stable")
        suffixes, begin = suffixes[order], begin[order]
        found = list(self.ranges(suffixes))
        if not found:
            return out
        window, size, low, high = (np.array(x) for x in zip(*found, strict=True))
        n = high - low
        at = ragged_gather(begin, low, n)
        size, window = np.repeat(size, n), np.repeat(window, n)
        marks = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + size, minlength=len(ids) + 1)
        mask = np.diff(np.concatenate([[0], marks.cumsum() > 0]).astype(np.int8))
        for first, end in zip(np.flatnonzero(mask > 0), np.flatnonzero(mask < 0), strict=True):
            d = np.searchsorted(ends, first)
            out[d][1].extend((int(first - firsts[d]), int(end - firsts[d])))
        # every place with each item of its window; places that follow each other are looked up together
        several = [self.items_of[w] for w in window]
        item = np.fromiter((k for ks in several for k in ks), np.int64)
        counts = np.fromiter(map(len, several), np.int64, len(several))
        at, size, window = np.repeat(at, counts), np.repeat(size, counts), np.repeat(window, counts)
        d = np.searchsorted(ends, at)
        order = np.lexsort((at, item, d))
        d, item, at, size, window = d[order], item[order], at[order], size[order], window[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        for h, t in zip(heads, np.append(heads[1:], len(d)), strict=True):
            k, which = d[h], int(item[h])
            out[k][2].add(which)
            for place, in_item, n in self.automaton(which).longest(window[h:t].tolist()):
                out[k][3].append((which, int(at[h] + place - firsts[k]), in_item, n + int(size[h]) - 1))
        return out


def _union(intervals: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(intervals[::2], intervals[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


MATCHES = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"
FOUND = f"n_words long, hits array<bigint>, items array<string>, matches {MATCHES}"


def _pass(state: DataFrame, items: list[tuple[str, str]], window: int, row: T.StructType) -> DataFrame:
    block = state.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([T.StructField("row", row), *T._parse_datatype_string(FOUND).fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = BenchmarkSuffixes(block.value, window)
        text = row.fieldNames().index("text")
        for batch in batches:
            rows = batch.column(0)
            texts = [t or b"" for t in rows.field(text).cast(pa.binary()).to_pylist()]
            hits, items, matches = (batch.column(k).to_pylist() for k in (2, 3, 4))
            words, first, held = [], 0, 0
            for i, t in enumerate([*texts, None]):
                if i > first and (t is None or held + len(t) > SHARD_BYTES):
                    for k, (n, got, where, longest) in enumerate(suffixes.search(texts[first:i]), first):
                        words.append(n)
                        if got or hits[k]:
                            hits[k] = _union(hits[k] + got)
                            items[k] = items[k] + [suffixes.item_ids[x] for x in where]
                            matches[k] = matches[k] + [dict(zip(_MATCH, (suffixes.item_ids[x[0]], *x[1:]), strict=True)) for x in longest]
                    first, held = i, 0
                held += len(t or b"")
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), _MATCHES)
            columns = [pa.array(x, kind) for x, kind in zip((words, hits, items, matches), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows, *columns], schema.fieldNames())

    return state.mapInArrow(search, schema)


_MATCH = ("item_id", "doc_word", "item_word", "n_words")
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), *((x, pa.int64()) for x in _MATCH[1:])]))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document `row` (all its columns), n_words, hits (word intervals), items and matches (longest, verbatim)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t"))
    items = items.where("t is not null")
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0
    blocks = max(1, math.ceil(size / block_bytes))
    nothing = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("hits"), F.array().cast("array<string>").alias("items"), F.array().cast(MATCHES).alias("matches")]
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    if blocks == 1:
        state = docs.select(every, *nothing)
        return _pass(state, [(r.i, r.t) for r in items.collect()], window, state.schema["row"].dataType)
    text = F.col("text").cast("string")
    keys = [F.xxhash64(F.lit(n), "doc_id", text).alias(f"k{n}") for n in (1, 2)]  # rows with the same keys have the same hits
    parts = []
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        state = docs.select(F.struct(text.alias("text"), *keys).alias("row"), *nothing)
        found = _pass(state, [(r.i, r.t) for r in mine.collect()], window, state.schema["row"].dataType).where(F.size("hits") > 0)
        parts.append(saved(found.select("row.k1", "row.k2", "hits", "items", "matches").dropDuplicates(["k1", "k2"]), f"block-{k}"))
    hits = reduce(DataFrame.unionByName, parts).groupBy(F.col("k1").alias("of"), F.col("k2").alias("of2"))
    hits = saved(hits.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "items", "matches"))), "hits")  # a document's own
    whole = docs.select(every, *keys)
    near, far = split_by_keys(whole, F.col("k1"), hits, F.col("of"))
    joined = near.join(hits.hint("merge"), (F.col("k1") == F.col("of")) & (F.col("k2") == F.col("of2")), "left")
    state = joined.select("row", nothing[0], *(F.coalesce(c, e).alias(c) for c, e in zip(("hits", "items", "matches"), nothing[1:], strict=True)))
    if far is not None:
        state = state.unionByName(far.select("row", *nothing))
    return _pass(state, [], window, state.schema["row"].dataType)  # counts words and joins intervals


def report(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: x - a)  # ends less starts, as there is an even number
    ids = F.array_sort(F.array_distinct("items"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any verbatim benchmark window, with their own columns."""
    return find(docs, benchmark, window).where(F.size("hits") == 0).select("row.*")
