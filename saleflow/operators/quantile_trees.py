"""Gradient-boosted trees for several quantiles at once, by pinball loss over binned features.

Rows are binned once and written: numbers by quantiles of the training rows, missing ones in bin 0; codes by the frozen
levels of the training rows, in the order of their mean target, with unseen and empty codes in bin 0 too (level -1).
For each level of a tree one job counts, per quantile, node, feature and bin, the rows and those below their prediction;
the rows' predictions are kept beside the bins and carried on by a tree at a time; the counts are whole numbers, summed over the partitions before the shuffle, so the trees don't depend on how rows are dealt.
The gradient of the pinball loss at q is q for a row at or above its prediction, q - 1 below. A split maximises the sum of
squared gradients over rows; a leaf's step is the q-quantile of its rows' residuals, from counts on a grid. All that comes to
the driver are these counts: quantiles x nodes x features x 256 bins at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleflow.shared import shared_folder, spread

QUANTILES = (0.1, 0.5, 0.9)
#: Trees, their depth, the share of a leaf's step that is taken, and rows that both sides of a split need.
ROUNDS, DEPTH, RATE, LEAST = 30, 3, 0.25, 30
#: Bins of a number (beside the one for missing), and at most of a code; cells of a residual on each side of zero, and their width.
NUMBER_BINS, CODE_BINS, CELLS, WIDTH = 63, 254, 4096, 1 / 1024


@dataclass
class Trees:
    """Features, how they are binned, and for each quantile a start and trees: split features and bins by node, leaf steps."""

    numbers: list[str]
    codes: list[str]
    edges: dict[str, list[float]] = field(default_factory=dict)
    levels: dict[str, dict[str, int]] = field(default_factory=dict)
    quantiles: tuple[float, ...] = QUANTILES
    start: list[float] = field(default_factory=list)
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """A row of bins for each row of the batch; the batch has the numbers, then the codes."""
        out = np.zeros((batch.num_rows, len(self.numbers) + len(self.codes)), np.uint8)
        for j, name in enumerate(self.numbers):
            x = batch.column(name).to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(x)
            out[known, j] = 1 + np.searchsorted(self.edges[name], x[known], side="right")
        for j, name in enumerate(self.codes, len(self.numbers)):
            levels = self.levels[name]
            out[:, j] = [1 + levels.get(v, -1) for v in batch.column(name).to_pylist()]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """A column for each quantile."""
        return self.add(np.tile(np.array(self.start), (len(bins), 1)), bins)

    def add(self, out: np.ndarray, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """`out` with the steps of the trees from `first` on, in their order."""
        for q, trees in enumerate(self.trees):
            for tree in trees[first:]:
                out[:, q] += tree[2][leaves(bins, tree[0], tree[1])]
        return out


def leaves(bins: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The leaf of each row: at a node, rows with a bin up to the threshold go left."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(len(feature).bit_length()):
        node = 2 * node + 1 + (bins[rows, feature[node]] > threshold[node])
    return node - len(feature)


def best_split(below: np.ndarray, n: np.ndarray, q: float, least: int) -> tuple[int, int]:
    """(feature, bin) of a node's best split; `below` and `n` count rows by feature and bin. (0, 255): none, all go left."""
    total, rows = q * n[0].sum() - below[0].sum(), n[0].sum()
    left_n, left = n.cumsum(axis=1), q * n.cumsum(axis=1) - below.cumsum(axis=1)
    right_n, right = rows - left_n, total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left**2 / left_n + right**2 / right_n - total**2 / max(rows, 1)
    gain[(left_n < least) | (right_n < least)] = -1.0
    at = int(gain.argmax())
    feature, cut = divmod(at, gain.shape[1])
    return (feature, cut) if gain.flat[at] > 1e-9 else (0, 255)


def _counted(rows: DataFrame, count, width: int) -> np.ndarray:
    """Sums over all partitions of `count(bins, target, predictions)`: arrays of (key, values...) per batch; `width` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width), np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            if len(y):
                sums += count(_packed(batch.column(1)), y, _packed(batch.column(2), np.float64) if batch.num_columns > 2 else None)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["key", "n", "below"])

    out = np.zeros((2, width), np.int64)
    summed = rows.mapInArrow(run, "key long, n long, below long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("below").alias("below"))
    for r in summed.collect():  # at most `width` rows
        out[:, r.key] = r.n, r.below
    return out


def _packed(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """A row of numbers for each binary of the column."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _quantile_of(counts: np.ndarray, q: float) -> float:
    """The q-quantile of residuals counted by cell, at the middle of its cell."""
    total = counts.sum()
    cell = int(np.searchsorted(counts.cumsum(), max(1, np.ceil(q * total))))
    return (cell - CELLS + 0.5) * WIDTH if total else 0.0


def _cells(residual: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(residual / WIDTH).astype(np.int64) + CELLS, 0, 2 * CELLS - 1)


def encoded(model: Trees, rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and `bins` (binary, a byte for each feature)."""
    names = [*model.numbers, *model.codes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([r.tobytes() for r in model.bins(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), packed], [*keep, "bins"])

    narrow = rows.select(*keep, *names)
    kinds = dict(narrow.dtypes)
    return narrow.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "bins binary"]))


def frozen(rows: DataFrame, numbers: list[str], codes: list[str], target: str) -> Trees:
    """The binning of the training rows: at most NUMBER_BINS edges of a number; a code's levels in the order of their mean
    target (ties by the code), neighbours sharing a bin beyond CODE_BINS levels."""
    model = Trees(numbers, codes)
    shares = [i / (NUMBER_BINS + 1) for i in range(1, NUMBER_BINS + 1)]
    found = rows.agg(*(F.percentile_approx(c, shares, 10_000).alias(c) for c in numbers)).first()
    model.edges = {c: sorted(set(found[c] or [])) for c in numbers}
    for c in codes:
        known = rows.where(f"`{c}` <> ''").groupBy(c).agg(F.avg(target).alias("m")).orderBy("m", c).collect()  # masters: a bounded list
        size = max(1, -(-len(known) // CODE_BINS))
        model.levels[c] = {r[c]: i // size for i, r in enumerate(known)}
    return model


def fit(rows: DataFrame, numbers: list[str], codes: list[str], target: str, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, least: int = LEAST, quantiles: tuple[float, ...] = QUANTILES) -> Trees:
    """Trees for the rows' targets (not null)."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark, 'trees')}"
    rows.select(F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in numbers), *codes).write.parquet(f"{folder}/rows")
    raw = spark.read.parquet(f"{folder}/rows")
    model = frozen(raw, numbers, codes, "y")
    encoded(model, spread(raw, *numbers[:1], "y"), ["y"]).write.parquet(f"{folder}/bins")
    data = spark.read.parquet(f"{folder}/bins")
    nq, nf = len(quantiles), len(numbers) + len(codes)
    model.quantiles, model.start, model.trees = quantiles, [0.0] * nq, [[] for _ in quantiles]

    def advanced(rows: DataFrame, first: int, at: int) -> DataFrame:
        """The rows with the predictions of the trees so far, written: each tree is tried on a row once."""
        own = Trees(numbers, codes, start=list(model.start), trees=[list(x) for x in model.trees])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = _packed(batch.column(1))
                    out = own.add(_packed(batch.column(2), np.float64).copy(), bins, first) if batch.num_columns > 2 else own.predict(bins)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r.tobytes() for r in out], pa.binary())], ["y", "bins", "p"])

        rows.mapInArrow(run, "y double, bins binary, p binary").write.parquet(f"{folder}/at{at}")
        return spark.read.parquet(f"{folder}/at{at}")

    def whole(bins: np.ndarray, y: np.ndarray, _) -> np.ndarray:
        n = np.bincount(_cells(y), minlength=2 * CELLS)
        return np.stack([n, n * 0])

    first = _counted(data, whole, 2 * CELLS)[0]
    model.start = [_quantile_of(first, q) for q in quantiles]
    data = advanced(data, 0, 0)
    for made in range(1, rounds + 1):
        tree = [(np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)) for _ in quantiles]
        for level in range(depth):
            nodes = 2**level

            def level_counts(bins: np.ndarray, y: np.ndarray, p: np.ndarray, tree=tree, nodes=nodes) -> np.ndarray:
                below = y[:, None] - p < 0
                sums = np.zeros((2, nq * nodes * nf * 256), np.int64)
                for q, (feature, cut) in enumerate(tree):
                    node = leaves(bins, feature[: nodes - 1], cut[: nodes - 1]) if nodes > 1 else np.zeros(len(y), np.int64)
                    key = (((q * nodes + node)[:, None] * nf + np.arange(nf)) * 256 + bins).ravel()
                    sums[0] += np.bincount(key, minlength=sums.shape[1])
                    sums[1] += np.bincount(key[np.repeat(below[:, q], nf)], minlength=sums.shape[1])
                return sums

            n, below = _counted(data, level_counts, nq * nodes * nf * 256).reshape(2, nq, nodes, nf, 256)
            for q, (feature, cut) in enumerate(tree):
                for k in range(nodes):
                    feature[nodes - 1 + k], cut[nodes - 1 + k] = best_split(below[q, k], n[q, k], quantiles[q], least)

        def leaf_counts(bins: np.ndarray, y: np.ndarray, p: np.ndarray, tree=tree) -> np.ndarray:
            cell = _cells(y[:, None] - p)
            n = np.zeros(nq * 2**depth * 2 * CELLS, np.int64)
            for q, (feature, cut) in enumerate(tree):
                n += np.bincount((q * 2**depth + leaves(bins, feature, cut)) * 2 * CELLS + cell[:, q], minlength=len(n))
            return np.stack([n, n * 0])

        cells = _counted(data, leaf_counts, nq * 2**depth * 2 * CELLS)[0].reshape(nq, 2**depth, 2 * CELLS)
        for q, (feature, cut) in enumerate(tree):
            steps = np.array([rate * _quantile_of(cells[q, k], quantiles[q]) for k in range(2**depth)])
            model.trees[q].append((feature, cut, steps))
        if made < rounds:
            data = advanced(data, made - 1, made)
    return model


def predict(model: Trees, rows: DataFrame, key: str) -> DataFrame:
    """`key` and `values` (a double for each quantile)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            got = model.predict(bins) if batch.num_rows else np.zeros((0, len(model.start)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(got), pa.list_(pa.float64()))], [key, "values"])

    narrow = rows.select(key, *(F.col(c).cast("double").alias(c) for c in model.numbers), *model.codes)
    kind = dict(narrow.dtypes)[key]
    return encoded(model, spread(narrow, key), [key]).mapInArrow(run, f"`{key}` {kind}, values array<double>")
