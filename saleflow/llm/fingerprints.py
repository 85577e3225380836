"""SimHash fingerprints of whole texts and exact search within a Hamming radius, in DataFrame functions only.

Terms are the pairs and triples of neighbouring words, lower-cased (a text with fewer words is one term); a term weighs
as often as it occurs. Its hash votes with that weight for or against each of 128 bits. The votes are counted by ordinary
sums over the exploded hashes: two counters of 32 bits share a long, so 64 sums serve all bits. A text stays in its task.

`report` sets a document beside the next one in falling order of doc_id. Rows are dealt by ranges of doc_id of some
RANGE_ROWS rows; the last row of a range is sent to the range after it too, so every neighbour is met in one shuffle.
The driver holds the ends of the ranges: at most MAX_RANGES numbers.

`within` uses permuted block tables: 128 bits are cut into blocks; two fingerprints at most `radius` bits apart agree in
at least `blocks - radius` of them. Each choice of that many blocks is a table keyed by them; a pair is taken from the
first table in which it agrees and then compared in full. Equal fingerprints are one row with a count, so copies don't
multiply, and a bucket of many near fingerprints is a skewed sort-merge join that AQE can split.

Nulls: a null text is empty; rows without doc_id are last in the order. Texts without words have the fingerprint 0.
Ties of doc_id go by text; repeated rows are each other's neighbours. A single row is its own next one. Empty table: no
rows. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLANKS = " \t\n\x0b\x0c\r"
#: Words of a term.
TERMS = (2, 3)
BITS, RADIUS, BLOCKS = 128, 3, 4
RANGE_ROWS, MAX_RANGES = 2000, 1 << 16
#: Documents whose id this divides are the queries of the report.
QUERY_EVERY = 50
_LANES = (1 << 32) + 1


def words(text: Column) -> Column:
    """The lower-cased words of a text; null without any."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare != "", F.split(F.lower(bare), r"[\x20\x09-\x0D]+"))


def term_hashes(w: str, lengths: tuple[int, ...] = TERMS) -> Column:
    """The hashes of all runs of so many words of the column `w`, repeats included; a text of fewer words is one term."""

    def runs(k: int) -> Column:
        return F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, k)))
        )

    return F.concat(*map(runs, lengths))


def votes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, f1, f2: the fingerprint of each group of term hashes `h` (null: no term). A term weighs as often as it occurs."""
    rows = rows.select(*keys, "h", F.when(F.col("h").isNotNull(), F.xxhash64("h", F.lit(BITS))).alias("h2"))
    sums = [F.sum(F.shiftright(c, k).bitwiseAND(F.lit(_LANES))).alias(f"{c}_{k}") for c in ("h", "h2") for k in range(32)]
    counted = rows.groupBy(*keys).agg(F.count("h").alias("total"), *sums)

    def word(c: str) -> Column:
        bit = lambda n, k: F.when(2 * n > F.col("total"), F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")).otherwise(0)
        out = F.lit(0).cast("long")
        for k in range(32):
            n = F.col(f"{c}_{k}")
            out = out + bit(n.bitwiseAND(F.lit((1 << 32) - 1)), k) + bit(F.shiftrightunsigned(n, 32), k + 32)
        return out

    return counted.select(*keys, word("h").alias("f1"), word("h2").alias("f2"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, f1, f2 for each row of `texts`; `keys` tell rows apart (rows of equal keys count as one text)."""
    split = texts.select(*keys, words(F.col(text)).alias("w"))
    return votes(split.select(*keys, F.explode_outer(term_hashes("w")).alias("h")), keys)


def shown(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, t and next_t in ranges: range, place (from 1 in the range), copy (a neighbour's row that isn't the range's own)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    ids = rows.select("doc_id")
    n = max(1, min(MAX_RANGES, math.ceil(ids.count() / RANGE_ROWS)))
    cuts: list[int] = []
    if n > 1:
        shares = "array(" + ",".join(repr(i / n) for i in range(1, n)) + ")"
        cuts = sorted(set(ids.agg(F.expr(f"percentile_approx(doc_id, {shares}, {max(10_000, 10 * n)})").alias("p")).first().p or []))
    place = F.lit(0)
    if cuts:
        ends, halves = _numbers(cuts), [1 << k for k in reversed(range(len(cuts).bit_length()))]

        def ahead(p: Column, s: Column) -> Column:  # a binary search for the number of cuts below the id
            return F.when(F.coalesce(F.get(ends, p + s - 1) < F.col("doc_id"), F.lit(False)), p + s).otherwise(p)

        place = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), ahead)
    tops = dict(ids.groupBy(place.alias("range")).agg(F.max("doc_id").alias("top")).collect())  # a row for each range
    filled = sorted(tops)
    after = dict(itertools.pairwise(filled))
    at = F.col("range").cast("int")
    known = range(len(cuts) + 1)
    top = F.get(F.split(F.lit(",".join(str("" if tops.get(k) is None else tops[k]) for k in known)), ","), at)
    follower = F.get(_numbers([after.get(k, -1) for k in known]), at)
    greatest = max((x for x in tops.values() if x is not None), default=None)
    own = F.struct(at.cast("long").alias("range"), F.lit(0).alias("copy"))
    to_next = F.when((top == F.col("doc_id").cast("string")) & (follower >= 0), F.struct(follower.alias("range"), F.lit(1).alias("copy")))
    to_first = F.when(F.col("doc_id").eqNullSafe(F.lit(greatest)), F.struct(F.lit(filled[0] if filled else 0).cast("long").alias("range"), F.lit(2).alias("copy")))
    dealt = rows.withColumn("range", place).select("doc_id", "t", F.explode(F.array_compact(F.array(own, to_next, to_first))).alias("to"))
    order = Window.partitionBy("range").orderBy("last", F.desc_nulls_last("doc_id"), "t")
    dealt = dealt.select("doc_id", "t", "to.range", "to.copy", (F.col("to.copy") == 2).alias("last"))
    return dealt.withColumn("next_t", F.lead("t").over(order)).withColumn("place", F.row_number().over(order))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, f1, f2, edited_f1, edited_f2, next_f1, next_f2 for every row of `docs`.

    The edited text has the document's last third replaced by as much of the next one's beginning (or all of it).
    """
    third = F.floor(F.length("t") / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.length("t") - third), F.substring("next_t", F.lit(1), third))
    rows = with_next(docs).withColumn("edited", F.when(F.col("copy") == 0, edited))
    keys = ["range", "place", "copy", "doc_id", "n_chars", "digest"]
    rows = rows.select("range", "place", "copy", "doc_id", F.length("t").cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("digest"), "t", "edited")
    both = F.array(F.struct(F.lit(0).alias("which"), F.col("t").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))
    texts = rows.select(*keys, F.explode(both).alias("x")).select(*keys, "x.which", "x.text")
    found = fingerprints(texts, [*keys, "which"])
    side = lambda k, c: F.max(F.when(F.col("which") == k, F.col(c)))
    one = found.groupBy(*keys).agg(side(0, "f1").alias("f1"), side(0, "f2").alias("f2"), side(1, "f1").alias("edited_f1"), side(1, "f2").alias("edited_f2"))
    order = Window.partitionBy("range").orderBy("place")
    one = one.withColumn("next_f1", F.lead("f1").over(order)).withColumn("next_f2", F.lead("f2").over(order)).where("copy = 0")
    return one.select("doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "f1", "f2", "edited_f1", "edited_f2", "next_f1", "next_f2")


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """q1, q2, f1, f2, n, distance: for each distinct (f1, f2) of `queries` all distinct ones of `prints` within `radius`
    bits, and how many rows of `prints` have each."""
    if not radius < blocks or BITS % blocks:
        raise ValueError("blocks must divide 128 and be more than the radius")
    width = BITS // blocks
    choices = list(itertools.combinations(range(blocks), blocks - radius))

    def part(a: Column, b: Column, i: int) -> list[Column]:
        """The parts of block i in either long."""
        out = []
        for word, base in ((a, 0), (b, 64)):
            first, last = max(i * width - base, 0), min((i + 1) * width - base, 64)
            if first < last:
                mask = ((1 << last) - (1 << first)) & ((1 << 64) - 1)
                out.append(word.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return out

    def tables(a: str, b: str) -> Column:
        keys = [F.xxhash64(F.lit(t), *(x for i in c for x in part(F.col(a), F.col(b), i))) for t, c in enumerate(choices)]
        return F.explode(F.array(*(F.struct(F.lit(t).alias("table"), k.alias("key")) for t, k in enumerate(keys)))).alias("at")

    asked = queries.select(F.col("f1").alias("q1"), F.col("f2").alias("q2")).distinct()
    asked = asked.select("q1", "q2", tables("q1", "q2")).select("q1", "q2", "at.*")
    known = prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"))
    known = known.select("f1", "f2", "n", tables("f1", "f2")).select("f1", "f2", "n", "at.*")
    met = asked.join(known, ["table", "key"])
    d1, d2 = F.col("q1").bitwiseXOR(F.col("f1")), F.col("q2").bitwiseXOR(F.col("f2"))
    agree = [sum((F.bit_count(x) for i in c for x in part(d1, d2, i)), F.lit(0)) == 0 for c in choices]
    first = F.coalesce(*(F.when(a, t) for t, a in enumerate(agree)))
    apart = distance(F.col("q1"), F.col("q2"), F.col("f1"), F.col("f2"))
    return met.where((first == F.col("table")) & (apart <= radius)).select("q1", "q2", "f1", "f2", "n", apart.alias("distance"))


def report(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within.

    n_within: for the queries (doc_id divisible by QUERY_EVERY) how many other rows lie within `radius` bits; else null.
    """
    all_rows = saved(compared(docs), "fingerprints")
    asked = all_rows.where(F.col("doc_id") % QUERY_EVERY == 0)
    found = within(asked, all_rows, radius, blocks).groupBy("q1", "q2").agg((F.sum("n") - 1).alias("n_within"))
    like = lambda k: 1 - distance(F.col("f1"), F.col("f2"), F.col(f"{k}_f1"), F.col(f"{k}_f2")) / F.lit(float(BITS))
    names = ["doc_id", "n_chars", "edited_sha256"]
    out = [shown(F.col("f1"), F.col("f2")).alias("fingerprint"), shown(F.col("edited_f1"), F.col("edited_f2")).alias("edited_fingerprint")]
    out += [like("edited").alias("near_edited"), like("next").alias("near_next")]
    query = F.coalesce(F.col("doc_id") % QUERY_EVERY == 0, F.lit(False))
    counted = all_rows.where(query).join(found.select(F.col("q1").alias("f1"), F.col("q2").alias("f2"), "n_within"), ["f1", "f2"])
    return counted.select(*names, *out, "n_within").unionByName(all_rows.where(~query).select(*names, *out, F.lit(None).cast("long").alias("n_within")))
