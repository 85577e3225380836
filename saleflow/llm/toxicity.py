"""Toxicity by a linear-chain conditional random field over words.

Labels are per document, so training first marks words: a word or a leading part of one (3 to 6 characters) that
occurs in toxic documents far more than chance allows (a G-test over the training documents) marks the words of toxic
documents that have it. A two-state CRF is trained on those tagged words by maximum likelihood, with features of
the word, its leading and trailing parts and its neighbours. Words are parted by ASCII white space and hashed whole; a word
with punctuation or other blanks inside is followed in the chain by its parts, a run of over WIDTH characters by its windows,
and a run of a script without blanks by its pairs of characters, so toxic passages count wherever they stand. Scoring runs forward-backward over every whole text; words of
marginal 0.5 or more are the offending ones, and a logistic layer over the marginals (highest, expected count) gives the score.

Training uses at most TRAIN_ROWS labelled documents of each label, of at most TRAIN_BYTES together, and of their segments
(SEGMENT words) those with a marked word and one in PLAIN_SHARE of the others, weighted; both bound the fit, not what is scored. The
logistic layer weighs the documents back to all labels. Very long texts are scored whole. Ties: documents are taken by id hash,
then id; equal scores stay equal. Other columns, whatever their names, are ignored. Nulls, empty texts and texts without words have no marginals and
get the lowest score of the logistic layer. Without toxic labels every score is the smoothed share of toxic labels. Repeated rows
are scored each; an empty table gives no rows; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_rows
from .tokens import ragged_gather, text_slices

#: Training documents by label: all the memory and time of a fit depend on.
TRAIN_ROWS = {1: 1500, 0: 3000}
#: Bytes of their texts together, for each label.
TRAIN_BYTES = 16 << 20
#: Of the segments without a marked word one in so many is trained on, with that weight.
PLAIN_SHARE = 8
DIM, WIDTH, STARTS, TAIL = 1 << 20, 16, (3, 4, 5, 6), 3
LEAST_G, LEAST_SHARE, SEGMENT, STEPS = 20.0, 0.8, 48, 60
EDGES = ".,!?;:\"'()[]{}#$%&*|-_<>"
#: Characters that part a word, and those of scripts that are written without blanks.
_PARTING = r"\s!-/:-@\[-`{-~\x00-\x1f\xa1\xab\xb7\xbb\xbf\u2000-\u206f\u3000-\u3003\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_SCRIPTS = r"\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_PLAIN = re.compile(f"[^{_PARTING}{_SCRIPTS}]{{0,{WIDTH}}}")
_RUN, _UNSPACED = re.compile(f"[^{_PARTING}]+"), re.compile(f"[{_SCRIPTS}]")


@dataclass
class Words:
    """The units of some texts: code per unit, unit offsets of the texts, and hashed features of each distinct unit.

    `word` and `word_offsets`: the word that each unit is of, over all texts, and the word offsets of the texts."""

    codes: np.ndarray
    offsets: np.ndarray
    hashed: np.ndarray = field(repr=False)
    word: np.ndarray = field(repr=False)
    word_offsets: np.ndarray = field(repr=False)


def units(word: str) -> Iterator[str]:
    """A word whole, then its parts between punctuation and the windows of runs without blanks."""
    yield word
    if _PLAIN.fullmatch(word):
        return
    for run in _RUN.findall(word):
        if _UNSPACED.search(run):
            yield from (run[i : i + 2] for i in range(len(run)))
            continue
        if run != word:
            yield run
        if len(run) > WIDTH:
            yield from (run[i : i + STARTS[-1]] for i in range(1, len(run) - STARTS[0] + 1))


def words_of(texts: pa.Array) -> Words:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(words.dictionary), EDGES)
    known: dict[str, int] = {}
    flat, count = array("q"), []
    for word in plain.to_pylist():
        before = len(flat)
        flat.extend(known.setdefault(u, len(known)) for u in units(word))
        count.append(len(flat) - before)
    distinct = list(known) or [""]
    length = np.array(list(map(len, distinct)))
    heads = np.array([u[: STARTS[-1]] for u in distinct], f"U{STARTS[-1]}").view(np.uint32).reshape(len(distinct), -1)
    tails = np.array([u[-TAIL:] for u in distinct], f"U{TAIL}").view(np.uint32).reshape(len(distinct), -1)
    with np.errstate(over="ignore"):
        rolling, starts = np.zeros(len(distinct), np.uint64), {}
        for i in range(STARTS[-1]):
            rolling = (rolling + heads[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            rolling ^= rolling >> np.uint64(29)
            if i + 1 in STARTS:
                starts[i + 1] = np.where(length > i, rolling, np.uint64(0)) + np.uint64(i + 1)
        whole = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        parts = [whole, *starts.values()]
        tail = np.zeros(len(distinct), np.uint64)
        for i in range(TAIL):
            tail = (tail + tails[np.arange(len(distinct)), np.clip(length, 1, TAIL) - 1 - np.minimum(i, np.clip(length, 1, TAIL) - 1)]) * np.uint64(0xC2B2AE3D27D4EB4F)
        parts.append(tail ^ (tail >> np.uint64(31)))
        hashed = np.column_stack([(p * np.uint64(2 * k + 1) >> np.uint64(40)) % np.uint64(DIM) for k, p in enumerate(parts)]).astype(np.int64)
    word_offsets = lists.offsets.to_numpy().astype(np.int64)
    word_offsets -= word_offsets[0]
    size = np.array(count, np.int64)
    at = words.indices.to_numpy().astype(np.int64)
    codes = ragged_gather(np.frombuffer(flat, np.int64) if flat else np.zeros(0, np.int64), (np.cumsum(size) - size)[at], size[at])
    ends = np.concatenate([[0], np.cumsum(size[at])]).astype(np.int64)
    return Words(codes, ends[word_offsets], hashed, np.repeat(np.arange(len(at)), size[at]), word_offsets)


@dataclass
class Crf:
    """weights: of the current word's features; near: of the word before and after, by the same features.

    start and trans are potentials of state 1 against state 0 and of state pairs."""

    weights: np.ndarray
    near: np.ndarray
    start: float
    trans: np.ndarray
    bias: float
    layer: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def emissions(self, w: Words) -> np.ndarray:
        """Score of state 1 less that of state 0 for each word."""
        own, near = self.weights[w.hashed].sum(1), self.near[w.hashed].sum(1)
        e = self.bias + own[w.codes]
        beside = near[w.codes]
        if len(e):
            doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
            inner = doc[1:] == doc[:-1]
            e[1:] += beside[:-1] * inner
            e[:-1] += beside[1:] * inner
        return e

    def marginals(self, e: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of state 1 of each word: forward and backward ratios, all texts step by step together."""
        odds = np.exp(np.clip(e, -30, 30))
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        first, size = offsets[:-1][order], size[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), "right")
        a = np.exp(self.trans)
        forward, backward = np.zeros(len(e)), np.ones(len(e))
        r = None
        for t, n in enumerate(active):
            at = first[:n] + t
            r = odds[at] * (np.exp(self.start) if t == 0 else (a[0, 1] + r[:n] * a[1, 1]) / (a[0, 0] + r[:n] * a[1, 0]))
            r = np.clip(r, 1e-200, 1e200)
            forward[at] = r
        b = np.ones(len(size))
        for t in range(len(active) - 1, 0, -1):
            n = active[t]
            at = first[:n] + t
            x = odds[at] * b[:n]
            b[:n] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
            backward[at - 1] = b[:n]
        both = forward * backward
        return both / (1 + both)

    def scores(self, p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = summary(p, offsets) @ self.layer
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def summary(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: 1, highest marginal, log of 1 + expected count of toxic words."""
    n = np.diff(offsets)
    high = np.zeros(len(n))
    some = n > 0
    if some.any():
        high[some] = np.maximum.reduceat(p, offsets[:-1][some])
    total = np.concatenate([[0], np.cumsum(p)])
    return np.column_stack([np.ones(len(n)), high, np.log1p(np.maximum(total[offsets[1:]] - total[offsets[:-1]], 0))])


def marked_features(w: Words, toxic: np.ndarray) -> np.ndarray:
    """Which hashed features mark words of toxic documents, by counts of documents."""
    n = len(toxic)
    doc = np.repeat(np.arange(n), np.diff(w.offsets))
    pairs = np.unique(doc * (w.codes.max() + 1 if len(w.codes) else 1) + w.codes)
    pair_doc, pair_code = np.divmod(pairs, w.codes.max() + 1 if len(w.codes) else 1)
    counts = np.zeros((2, DIM))
    for k in range(len(STARTS) + 1):
        keys = np.unique(pair_doc * DIM + w.hashed[pair_code, k])
        for label in (0, 1):
            mine = keys[toxic[keys // DIM] == label] % DIM
            counts[label] = np.maximum(counts[label], np.bincount(mine, minlength=DIM)) if k else np.bincount(mine, minlength=DIM)
    clean, tox = counts
    chance = (clean + tox) * toxic.mean()
    g = 2 * tox * np.log(np.maximum(tox, 1) / np.maximum(chance, 1e-9))
    return (g >= LEAST_G) & (tox >= LEAST_SHARE * (tox + clean))


def fit(texts: pa.Array, y: np.ndarray, totals: dict[int, int] | None = None) -> Crf:
    """`totals`: labelled documents of each label, of which these are a part."""
    y = y.astype(np.int64)
    have = {k: int((y == k).sum()) for k in (0, 1)}
    totals = totals or have
    base = np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
    flat = Crf(np.zeros(DIM), np.zeros(DIM), 0.0, np.zeros((2, 2)), 0.0, np.array([base, 0.0, 0.0]))
    if not 0 < y.sum() < len(y):
        return flat
    w = words_of(texts)
    marks = marked_features(w, y)
    if not marks.any():
        return flat
    doc = np.repeat(np.arange(len(y)), np.diff(w.offsets))
    tags = marks[w.hashed[:, : len(STARTS) + 1]].any(1)[w.codes] & (y[doc] == 1)
    # chains of SEGMENT words, padded; words of all training documents take part
    size = np.diff(w.offsets)
    pieces = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)] or [[]]).astype(np.int64)
    # a segment without a tag teaches what its neighbours teach: one in PLAIN_SHARE of those stays
    has = np.add.reduceat(tags.astype(np.int64), pieces) > 0
    keep = has | (np.arange(len(pieces)) % PLAIN_SHARE == 0)
    stop = np.minimum(pieces + SEGMENT, w.offsets[1:][doc[pieces]])
    weight = np.where(has, 1.0, PLAIN_SHARE)[keep]
    pieces, stop = pieces[keep], stop[keep]
    at = np.minimum(pieces[:, None] + np.arange(SEGMENT), len(w.codes) - 1)
    real = pieces[:, None] + np.arange(SEGMENT) < stop[:, None]
    codes, gold = w.codes[at], tags[at] & real
    crf = Crf(np.zeros(DIM), np.zeros(DIM), 0.0, np.zeros((2, 2)), float(np.log((tags.sum() + 1) / len(tags))))
    used, local = np.unique(w.hashed, return_inverse=True)
    local = local.reshape(w.hashed.shape)
    n_used = len(used)
    theta = np.zeros(2 * n_used + 6)
    theta[-1] = crf.bias
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    inner = real[:, 1:]
    scale = 1 / max(1.0, float(gold.sum()))
    for step in range(1, STEPS + 1):
        own, near = theta[:n_used][local].sum(1), theta[n_used : 2 * n_used][local].sum(1)
        e = theta[-1] + own[codes]
        e[:, 1:] += near[codes[:, :-1]]
        e[:, :-1] += near[codes[:, 1:]] * inner
        trans, start = theta[-6:-2].reshape(2, 2), theta[-2]
        p, pair, first = _expected(e, real, trans, start)
        d = (gold - p) * real * weight[:, None]
        near_d = np.zeros_like(d)
        near_d[:, :-1] += d[:, 1:] * inner
        near_d[:, 1:] += d[:, :-1] * inner
        grad = np.zeros_like(theta)
        for k, x in enumerate((d, near_d)):
            by_code = np.bincount(codes.ravel(), x.ravel(), len(w.hashed))
            for j in range(local.shape[1]):
                grad[k * n_used : (k + 1) * n_used] += np.bincount(local[:, j], by_code, n_used)
        g0, g1 = gold[:, :-1], gold[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                seen = ((g0 == i) & (g1 == j) & inner).sum(1)
                grad[2 * n_used + 2 * i + j] = ((seen - pair[i][j]) * weight).sum()
        grad[-2] = ((gold[:, 0] - first) * weight).sum()
        grad[-1] = d.sum()
        grad = grad * scale - 1e-4 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        theta += 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    crf.weights[used], crf.near[used] = theta[:n_used], theta[n_used : 2 * n_used]
    crf.trans, crf.start, crf.bias = theta[-6:-2].reshape(2, 2), float(theta[-2]), float(theta[-1])
    x = summary(crf.marginals(crf.emissions(w), w.offsets), w.offsets)
    crf.layer = _logistic(x, y, np.where(y == 1, totals[1] / have[1], totals[0] / have[0]))
    return crf


def _expected(e: np.ndarray, real: np.ndarray, trans: np.ndarray, start: float):
    """Marginals, expected counts of state pairs, and the first word's marginal of padded chains."""
    steps = e.shape[1]
    a = np.exp(trans)
    alpha, beta = np.zeros((2, *e.shape)), np.ones((2, *e.shape))
    odds = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))])
    for t in range(steps):
        now = odds[:, :, t] * (np.array([[1.0], [np.exp(start)]]) if t == 0 else a.T @ alpha[:, :, t - 1])
        now = now / now.sum(0)
        alpha[:, :, t] = np.where(real[:, t], now, alpha[:, :, t - 1] if t else now)
    for t in range(steps - 2, -1, -1):
        after = a @ (odds[:, :, t + 1] * beta[:, :, t + 1])
        beta[:, :, t] = np.where(real[:, t + 1], after / after.sum(0), 1.0)
    p = alpha * beta
    p = p[1] / p.sum(0)
    pair = alpha[:, None, :, :-1] * a[:, :, None, None] * (odds * beta)[None, :, :, 1:]
    pair = pair / pair.sum((0, 1)) * real[None, None, :, 1:]
    return p, pair.sum(3), p[:, 0]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        theta += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * theta)
    return theta


TAGGED = "doc_id long, score double, predicted int, toxic_words array<int>"


def tag(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, limits: dict[int, int] | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted and toxic_words (places of words of marginal 0.5 or more)."""
    usable = fold(F.col("doc_id"), folds) != held
    kinds = [training_rows(docs, labels.where(F.col(label) == k), label, usable, n, TRAIN_BYTES) for k, n in (limits or TRAIN_ROWS).items()]
    rows = kinds[0].unionByName(kinds[1]).select("text", "y").toArrow()
    totals = {r[0]: r[1] for r in labels.where(usable & F.col(label).isNotNull()).groupBy(label).count().collect()}
    model = docs.sparkSession.sparkContext.broadcast(fit(rows["text"].combine_chunks(), rows["y"].to_numpy(), totals))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            for first, n in text_slices(batch.column(1)):
                w = words_of(batch.column(1).slice(first, n))
                p = crf.marginals(crf.emissions(w), w.offsets)
                s = crf.scores(p, w.offsets)
                hit = np.flatnonzero(p >= 0.5) if crf.layer[1:].any() else np.zeros(0, np.int64)
                hit = np.unique(w.word[hit])
                ends = np.searchsorted(hit, w.word_offsets).astype(np.int32)
                doc = np.searchsorted(w.word_offsets, hit, "right") - 1
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array((hit - w.word_offsets[doc]).astype(np.int32)))
                columns = [batch.column(0).slice(first, n), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), places]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted", "toxic_words"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = narrow.mapInArrow(score, TAGGED)
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted", "toxic_words")
