"""Groups of spelling variants over the whole vocabulary, by neighbourhoods in a reduced alphabet.

`vocabulary` counts the words of all texts. Each letter is hashed to one of a few symbols, which turns a word into a
reduced word of the same length; words that differ by one edit have reduced words that differ by one edit or none. For
every distinct reduced word all reduced words at one deletion, replacement or insertion are generated (2 x symbols x
length of them, instead of some 180 x length over the letters), and joined to the reduced words that exist; the words behind
both are then compared as they are. Nothing is lost: a pair of reduced words is met exactly once in either direction.

Reduced words travel as 64-bit hashes. Before the shuffle a bitmap of the hashes that exist drops most of the others; it
has 16 places a key up to MAX_BITS (64 MB), and beyond that it only drops fewer. Only hashes are shuffled in that step;
words follow to the matches. Two reduced words share a hash with probability V^2 / 2^65 over a vocabulary of V.

Nulls: a null text has no words; a null doc_id counts as an empty string in the hash of an occurrence. Very long words
are linear work, in blocks of positions. Ties of the form's count go to the smallest word in code-point order.
Repeated rows count each time. Empty tables: no rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Letters of a word; A-Z are lower-cased, the others stay.
LETTERS = r"A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
#: One occurrence in so many loses a letter, by its hash.
DELETE_EVERY = 31
#: Letters become so many symbols; a form has at least FORM_RATIO times the word's count.
SYMBOLS, FORM_RATIO = 8, 10
#: Places of the bitmap: for each key, and at most; bits of one of its rows.
PLACES, MAX_BITS, ROW_BITS = 16, 1 << 29, 1 << 15
#: Neighbours made at once.
BLOCK = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, delete_every: int = DELETE_EVERY) -> DataFrame:
    """word, n: words of at least `min_length` letters and how often they occur, if at least `min_count` times.

    Let h be the CRC-32 of `doc_id:word`; where `delete_every` divides it, the letter at h modulo the length is deleted.
    Shorter runs than `min_length` can't become words, so they are left out before anything is counted.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(runs).alias("w"))
    each = each.select("d", F.translate("w", upper, lower).alias("w"))
    each = each.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    each = each.select(F.when(F.col("h") % delete_every == 0, shorter).otherwise(F.col("w")).alias("word"))
    return each.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _mix(x: np.ndarray, length: int) -> np.ndarray:
    x = x + _U(length * 0xD6E8FEB86659FD93 % (1 << 64))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, _U)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=_U)


def _reduced(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `words`, their letters' symbols, counted from 1, a row each) for all words of a length, in blocks."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    hashed = ((points * _U(0x9E3779B1)) >> _U(15)) % _U(symbols) + _U(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        length = int(lengths[group[0]]) if len(group) else 0
        if length:
            rows = max(1, BLOCK // (length * 2 * symbols))
            for k in range(0, len(group), rows):
                part = group[k : k + rows]
                yield part, hashed[starts[part][:, None] + np.arange(length)]


def reduced_keys(words: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """The hash of each word's reduced form."""
    out = np.zeros(len(words), _U)
    with np.errstate(over="ignore"):
        for part, a in _reduced(words, symbols):
            out[part] = _mix((a * _powers(a.shape[1])).sum(axis=1, dtype=_U), a.shape[1])
    return out


def neighbourhoods(words: list[str], symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in `words`, hashes) of the reduced words at one edit or none, repeats included, in blocks of some BLOCK."""
    with np.errstate(over="ignore"):
        for part, a in _reduced(words, symbols):
            m, length = a.shape
            power = _powers(length + 1)
            before = np.zeros((m, length + 1), _U)
            np.cumsum(a * power[:length], axis=1, dtype=_U, out=before[:, 1:])
            total = before[:, -1:]
            yield part, _mix(total[:, 0], length)
            step = max(1, BLOCK // (m * symbols))
            marks = np.arange(1, symbols + 1, dtype=_U)
            for i in range(0, length + 1, step):
                at = slice(i, min(i + step, length))
                here, own, left = a[:, at], power[at], before[:, at]
                if here.shape[1]:
                    gone = left + (total - before[:, at.start + 1 : at.stop + 1]) * _U(_P_INVERSE)
                    yield np.repeat(part, gone.shape[1]), _mix(gone, length - 1).ravel()
                    other = total[:, :, None] + (marks - here[:, :, None]) * own[:, None]
                    told = np.broadcast_to(part[:, None, None], other.shape)[marks != here[:, :, None]]
                    yield told, _mix(other[marks != here[:, :, None]], length)
                at = slice(i, min(i + step, length + 1))
                left = before[:, at]
                more = (left + (total - left) * _U(_P))[:, :, None] + marks * power[at][:, None]
                yield np.repeat(part, more[0].size), _mix(more, length + 1).ravel()


def _present(keys: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Whether both places of each key are set."""
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        place = (keys >> _U(shift)) & _U(bits - 1)
        out[out] = (bitmap[(place[out] >> _U(3)).astype(np.int64)] >> (place[out] & _U(7)).astype(np.uint8)) & 1 > 0
    return out


def _bitmap(reduced: DataFrame) -> tuple[Broadcast, int]:
    """A bitmap of the keys (at most MAX_BITS), made by Spark in rows and broadcast."""
    spark = reduced.sparkSession
    bits = min(MAX_BITS, 1 << max(15, (reduced.count() * PLACES - 1).bit_length()))
    unsigned = F.array(F.col("key"), F.shiftrightunsigned("key", 32))
    place = reduced.select(F.explode(F.transform(unsigned, lambda k: k.bitwiseAND(bits - 1))).alias("p"))
    place = place.select(F.shiftright("p", ROW_BITS.bit_length() - 1).alias("row"), "p")
    rows = place.groupBy("row").agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(ROW_BITS - 1)).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        own = np.frombuffer(r.b, np.uint8)[: ROW_BITS // 8]
        out[r.row * (ROW_BITS // 8) : r.row * (ROW_BITS // 8) + len(own)] = own
    return spark.sparkContext.broadcast(out.tobytes()), bits


def _with_keys(words: DataFrame, symbols: int) -> DataFrame:
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pa.array(reduced_keys(batch.column(0).to_pylist(), symbols).view(np.int64))
            yield pa.RecordBatch.from_arrays([key, *batch.columns], ["key", *batch.schema.names])

    return words.mapInArrow(keyed, "key long, word string, n long")


def _neighbours(reduced: DataFrame, symbols: int) -> DataFrame:
    """near, key: for each reduced word the keys at one edit or none, once each, that may exist."""
    filled, bits = _bitmap(reduced)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(filled.value, np.uint8)
        for batch in batches:
            own = batch.column(0).to_numpy().view(_U)
            words = batch.column(1).to_pylist()
            for first in range(0, len(words), 2000):
                kept = []
                for places, keys in neighbourhoods(words[first : first + 2000], symbols):
                    ok = _present(keys, bitmap, bits)
                    kept.append(np.stack([own[first + places[ok]], keys[ok]], axis=1))
                pairs = np.unique(np.concatenate(kept), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 0].copy())], ["near", "key"])

    one = reduced.groupBy("key").agg(F.any_value("word").alias("word"))
    return one.mapInArrow(made, "near long, key long")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, near, near_n for all words at one inserted, deleted or replaced letter, in both directions.

    `words` has word and n, a row for each word. Each word is in the result with itself too (edits 0; else 1).
    """
    reduced = saved(_with_keys(words.select("word", F.col("n").cast("long")), symbols), "reduced")
    met = _neighbours(reduced, symbols).join(reduced.select(F.col("key").alias("near"), F.col("word").alias("v"), F.col("n").alias("near_n")), "near")
    both = met.drop("near").join(reduced, "key")
    edits = F.levenshtein("word", "v", 1)
    both = both.where(F.abs(F.length("word") - F.length("v")) <= 1).withColumn("edits", edits).where("edits >= 0")
    return both.select("key", "word", "n", F.col("v").alias("near"), "near_n", "edits")


def forms(near: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word, if it has at least `ratio` times the count."""
    other = F.when(F.col("edits") == 1, F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w")))
    best = near.groupBy("key", "word", "n").agg(F.min(other).alias("b"), F.sum("edits").cast("long").alias("n_near"))
    ok = -F.col("b.n") >= ratio * F.col("n")
    return best.select("word", "n", "n_near", F.when(ok, F.col("b.w")).alias("form"), F.when(ok, -F.col("b.n")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """Adds `root`: the last word that forms lead to, or the word itself.

    Counts grow by the ratio at each form, so paths are short; each round doubles the step, and its table is written.
    """
    step = saved(formed.where("form is not null").select("word", F.col("form").alias("root")), "step")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "step")
        moved = step.where("moved").limit(1).count()
        step = step.drop("moved")
        if not moved:
            return formed.join(step, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts."""
    formed = saved(forms(near_words(saved(vocabulary(docs), "vocabulary"))), "forms")
    return roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
