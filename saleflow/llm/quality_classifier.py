"""Quality classifier: histogram gradient-boosted trees over document statistics.

`features` turns an Arrow text column into a matrix with numpy and Arrow kernels (no loop over words). `fit` grows
trees level by level from gradient histograms over at most BINS quantile bins, with logistic loss, on the driver from at
most TRAIN_ROWS labelled documents. `Forest` keeps all trees in flat arrays (feature, threshold, left, value), and scores
rows by walking all rows down a tree at once.

Very long texts are described whole, in a slice of their own. Ties: of equal gains the first feature and the lowest cut win;
training documents are taken by id hash, then id. Other columns, whatever their names, are ignored. Nulls and empty texts have the same statistics and score. Without labels, or with labels of one kind,
every score is the smoothed share of label 1. Repeated rows are scored each; empty tables give no rows; labels, lang,
source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_rows
from .tokens import text_slices

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, L2, LEAST = 20_000, 80, 5, 64, 0.15, 1.0, 10.0
CHARS = "#*$%&|!.,<>?:;-_/()\"'\n"
#: The last ten features are of words and lines.
N_FEATURES = len(CHARS) + 5 + 10


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct codes, and the count of the most frequent one."""
    n = len(offsets) - 1
    keys = np.sort((np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) << 32) | codes)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    doc = (keys[head] >> 32).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, np.diff(np.append(head, len(keys))))
    return np.bincount(doc, minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    parts = [_features(texts.slice(first, n)) for first, n in text_slices(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


def _features(texts: pa.Array) -> np.ndarray:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = pc.binary_length(texts).to_numpy().astype(np.float64)
    per = np.maximum(size, 1)
    data = np.frombuffer(pc.binary_join(pa.array([texts.to_pylist()]), "").to_pylist()[0].encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    classes = [(data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data >= 128, data <= 32]
    columns = [np.log1p(size), *(_per_doc(x, at) / per for x in classes)]
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    codes = words.indices.to_numpy().astype(np.int64)
    n = np.diff(ends)
    least = np.maximum(n, 1)
    columns += [pc.count_substring(texts, c).to_numpy() / least for c in CHARS]
    lengths = pc.binary_length(words.dictionary).to_numpy()[codes] if len(codes) else codes
    distinct, most = _distinct(codes, ends)
    doc = np.repeat(np.arange(len(n)), n)
    same = np.append(False, (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) if len(codes) else codes
    triples = np.zeros(len(codes), np.int64)
    if len(codes) > 2:  # of the words' own hashes, so that a text's score doesn't depend on its neighbours
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))[codes]
        with np.errstate(over="ignore"):
            mixed = (own[:-2] * np.uint64(0x9E3779B97F4A7C15) + own[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + own[2:]
        triples[:-2] = np.where(doc[2:] == doc[:-2], mixed >> np.uint64(32), np.uint64(0)).astype(np.int64)
    windows, _ = _distinct(triples, ends)
    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten().dictionary_encode()
    line_ends = lines.offsets.to_numpy().astype(np.int64)
    line_ends -= line_ends[0]
    n_lines = np.maximum(np.diff(line_ends), 1)
    line_kinds, _ = _distinct(line.indices.to_numpy().astype(np.int64), line_ends)
    columns += [
        np.log1p(n), _per_doc(lengths, ends) / least, _per_doc(lengths > 15, ends) / least, distinct / least, most / least,
        _per_doc(same, ends) / least, windows / least, line_kinds / n_lines, n / n_lines, size / least,
    ]
    return np.column_stack(columns).astype(np.float64)


@dataclass
class Forest:
    """Trees in flat arrays. Node i goes to left[i] if its feature is at most threshold[i], else to left[i] + 1; a leaf's
    left is itself, with threshold infinity."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    ones = float(y.sum())
    base = np.log((ones + 1) / (len(y) - ones + 1))
    feature, threshold, left, value, roots = [], [], [], [], []
    if 0 < ones < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
        margin = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(len(y), np.int64)  # node of each row, counted within the tree
            first = len(feature)
            roots.append(first)
            level = [0]
            for store in (feature, threshold, left, value):
                store.append(0)
            for depth in range(DEPTH + 1):
                local = np.full(len(feature) - first, -1)
                local[level] = np.arange(len(level))
                mine = local[at]
                rows = mine >= 0
                sums = np.array([np.bincount(mine[rows], w[rows], len(level)) for w in (g, h)])
                for k, node in enumerate(level):
                    feature[first + node], threshold[first + node], left[first + node] = 0, np.inf, first + node
                    value[first + node] = -RATE * sums[0, k] / (sums[1, k] + L2)
                if depth == DEPTH:
                    break
                best = np.zeros(len(level)), np.zeros(len(level), int), np.zeros(len(level), int)
                score = lambda a, b: a * a / (b + L2)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    key = mine[rows] * (BINS + 1) + binned[rows, f]
                    hist = [np.bincount(key, w[rows], len(level) * (BINS + 1)).reshape(len(level), -1).cumsum(1)[:, : len(cuts[f])] for w in (g, h)]
                    rest = sums[0][:, None] - hist[0], sums[1][:, None] - hist[1]
                    gain = score(*hist) + score(*rest) - score(*sums)[:, None]
                    gain[(hist[1] < LEAST * 0.05) | (rest[1] < LEAST * 0.05)] = -1
                    cut = gain.argmax(1)
                    top = gain[np.arange(len(level)), cut]
                    better = top > best[0]
                    best[0][better], best[1][better], best[2][better] = top[better], f, cut[better]
                below = []
                for k, node in enumerate(level):
                    if best[0][k] <= 1e-6:
                        continue
                    f, cut, child = best[1][k], best[2][k], len(feature) - first
                    feature[first + node], threshold[first + node], left[first + node] = f, cuts[f][cut], first + child
                    for store in (feature, threshold, left, value):
                        store += [0, 0]
                    mine_here = at == node
                    at[mine_here] = child + (binned[mine_here, f] > cut)
                    below += [child, child + 1]
                if not below:
                    break
                level = below
            margin += np.array(value[first:])[at]
    arrays = (np.array(v, t) for v, t in ((roots, np.int64), (feature, np.int64), (threshold, float), (left, np.int64), (value, float)))
    return Forest(base, *arrays)


def train(docs: DataFrame, labels: DataFrame, label: str, usable, limit: int = TRAIN_ROWS) -> Forest:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    rows = training_rows(docs, labels, label, usable, limit).select("text", "y").mapInArrow(describe, "x array<double>, y int").toArrow()
    x = np.array(rows["x"].to_pylist()).reshape(-1, N_FEATURES)
    return fit(x, rows["y"].to_numpy().astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, limit: int = TRAIN_ROWS) -> DataFrame:
    """Per document: doc_id, held_out (its fold is `held`; such labels aren't learnt from), score, predicted."""
    forest = train(docs, labels, label, fold(F.col("doc_id"), folds) != held, limit)
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = narrow.mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")
