"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A document's statistics feed four rules, each rejecting above a cutoff: symbols per word, share of repeated lines, share
of repeated words, and characters per word. For each stratum (language) and rule, labelled documents that pass the
base rules and have quality 1 are the holdout. Cutoffs are tried from the mildest on; one is accepted while the exact
binomial (Clopper-Pearson) test rejects "more than `risk` / rules of good documents fall above it" at level `error` /
(strata x rules) (Bonferroni); the first that isn't certified ends the search (fixed sequence, so no further correction).
With probability 1 - `error`, no stratum then loses more than `risk` of its good documents. Where no cutoff can be
certified (few labels, an unknown stratum) the rule rejects nothing there.

Very long texts: all steps are n log n; texts of more windows than PLACE_BITS can number skip the hashes and compare all
windows. Ties: a document at a cutoff stays. Nulls: a null text has no words and fails the base rules; a null lang is the stratum ''. Documents without a label only
get a verdict. Repeated labels of one document count once (its lowest quality). Empty tables: no rows, or no cutoffs.
Columns of `documents` other than doc_id, text and lang are ignored by `score` and kept by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, split_by_keys

#: Words, and characters that count as symbols.
BLANKS, SYMBOLS = r"[\x20\x09-\x0D]", "#*$%&|<>"
#: Bits of a packed long that hold a window's place; texts with more windows skip the hashes.
PLACE_BITS = 22
#: Rule: cutoffs from the mildest to the strictest; a document above an accepted one is rejected.
CUTOFFS = {
    "symbols_per_word": [5.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25],
    "repeated_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeated_words": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "chars_per_word": [100.0, 60.0, 40.0, 30.0, 25.0, 20.0, 16.0],
}
RISK, ERROR = 0.05, 0.05


def with_statistics(docs: DataFrame, rows: bool) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, and, if asked
    for, `row` (all columns of the document).

    Windows found twice: the hashes of all windows are sorted with their places in one array of longs; only windows whose
    hash has an equal neighbour are then compared as strings, in a second sort. Both are n log n for very long texts.
    """
    everything = 1 << 30
    zero = F.lit(0).cast("long")
    row = [F.struct(*docs.columns).alias("row")] * rows
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(*row, F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("t"))
    kept = ["row"] * rows + ["doc_id", "stratum"]

    symbols = [F.octet_length("t") - F.octet_length(F.replace(F.col("t"), F.lit(x), F.lit(""))) for x in SYMBOLS]
    out = out.select(
        *kept,
        F.filter(F.split("t", f"{BLANKS}+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        sum(symbols[1:], symbols[0]).cast("long").alias("n_symbols"),
    )
    pair = F.zip_with("w", F.slice("w", 2, everything), lambda a, b: F.concat(a, F.lit(" "), b))
    three = F.zip_with(pair, F.slice("w", 3, everything), lambda a, b: F.concat(a, F.lit(" "), b))
    out = out.select(
        *kept,
        "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", zero, lambda a, x: a + F.length(x)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.slice(three, 1, F.greatest(F.size("w") - 2, F.lit(0))).alias("windows"),
    )
    kept += ["n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    place = (1 << PLACE_BITS) - 1
    packed = F.transform("windows", lambda x, i: F.shiftleft(F.xxhash64(x), PLACE_BITS).bitwiseOR(i.cast("long")))
    out = out.select(*kept, "windows", F.when(F.size("windows") <= place, F.sort_array(packed)).alias("h"))

    def neighbours(name: str, key) -> Column:  # whether each element of a sorted array has an equal one beside it
        col = F.col(name)
        after = F.zip_with(col, F.slice(col, 2, everything), lambda a, b: F.coalesce(key(a) == key(b), F.lit(False)))
        before = F.concat(F.array(F.lit(False)), after)
        return F.slice(F.zip_with(after, before, lambda a, b: a | b), 1, F.greatest(F.size(col), F.lit(0)))

    def only(name: str, flags: str) -> Column:
        both = F.zip_with(name, flags, lambda x, f: F.when(f, x))
        return F.filter(both, lambda x: x.isNotNull())

    out = out.select(*kept, "windows", "h", neighbours("h", lambda x: F.shiftright(x, PLACE_BITS)).alias("flags"))
    out = out.select(*kept, "windows", F.transform(only("h", "flags"), lambda x: x.bitwiseAND(place).cast("int")).alias("places"))
    every = F.when(F.size("windows") > 0, F.sequence(F.lit(0), F.size("windows") - 1)).otherwise(F.array().cast("array<int>"))
    out = out.select(*kept, "windows", F.coalesce("places", every).alias("places"))
    found = F.transform("places", lambda i: F.struct(F.get("windows", i).alias("w"), i.alias("i")))
    out = out.select(*kept, F.array_sort(found).alias("h"))
    out = out.select(*kept, "h", neighbours("h", lambda x: x["w"]).alias("flags"))
    out = out.select(*kept, F.sort_array(F.transform(only("h", "flags"), lambda x: x["i"])).alias("places"))
    start = F.struct(zero.alias("n"), F.lit(-1).alias("end"))

    def step(a: Column, i: Column) -> Column:
        return F.struct((a["n"] + i + 2 - F.greatest(a["end"], i - 1)).alias("n"), (i + 2).alias("end"))

    covered = F.aggregate("places", start, step, lambda a: a["n"])
    return out.select(*kept, covered.alias("n_repeat_words")).withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _rates() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeated_words": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Bin(n, p) and k <= n p: the term at k times the sum of its falling ratios."""
    logs = lambda a, b: F.aggregate(F.sequence(a, b), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    term = F.when(k > 0, logs(n - k + 1, n) - logs(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(0.0)
    term = term + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, j: Column) -> Column:  # j falls from k to 1
        t = a["t"] * j * (1 - p) / ((n - j + 1) * p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    down = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return term + F.log(F.aggregate(down, start, step, lambda a: a["s"]))


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled as good; of repeated labels the lowest quality counts."""
    lowest = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return lowest.where("quality = 1").select("doc_id")


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per stratum and rule the accepted cutoff: stratum, rule, cutoff. At most strata x rules rows.

    Good documents are counted per cutoff by partial aggregation, one row per stratum, rule and cutoff.
    """
    held = stats.where(~F.col("base_failed")).join(good_ids(labels), "doc_id", "left_semi")
    tries = [
        F.sum((rate > c).cast("long")).alias(f"{rule}|{i}") for rule, rate in _rates().items() for i, c in enumerate(CUTOFFS[rule])
    ]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *tries)
    cases = [
        F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"`{rule}|{i}`").alias("k"))
        for rule, cs in CUTOFFS.items()
        for i, c in enumerate(cs)
    ]
    share = risk / len(CUTOFFS)
    strata = max(1, counts.count())
    tested = counts.select("stratum", "n", F.explode(F.array(*cases)).alias("c")).select("stratum", "n", "c.*")
    certain = (F.col("k") <= F.col("n") * share) & (
        log_binomial_tail(F.col("k"), F.col("n"), share) <= F.log(F.lit(error / len(CUTOFFS) / strata))
    )
    ends = tested.withColumn("ok", certain).groupBy("stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"))
    return tested.join(ends, ["stratum", "rule"]).where("stop is null or step < stop").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(stats: DataFrame, chosen: DataFrame) -> DataFrame:
    """`stats` with the verdict `kept` by the cutoffs `chosen`."""
    by_stratum = chosen.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.min("cutoff"))  # a row per language at most
    joined = stats.join(F.broadcast(by_stratum), "stratum", "left")
    above = [F.coalesce(rate > F.col(rule), F.lit(False)) for rule, rate in _rates().items()]
    rejected = above[0] | above[1] | above[2] | above[3]
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*CUTOFFS)


def score(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """`with_statistics` and `kept`. The texts are read once: the statistics are written before the thresholds are set."""
    stats = saved(with_statistics(docs, rows=False), "statistics")
    return judged(stats, cutoffs(stats, labels, risk, error))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents kept, with their own columns.

    No text is written on the way: the cutoffs come from the narrow statistics of the documents labelled as good (told by a
    bitmap, so about those alone), and the statistics of all are made again as the rows are judged.
    """
    good = saved(good_ids(labels).select(F.expr(f"try_cast(doc_id as {docs.schema['doc_id'].dataType.simpleString()})").alias("doc_id")), "good")
    held = saved(with_statistics(split_by_keys(docs, F.col("doc_id"), good, F.col("doc_id"))[0], rows=False), "statistics")
    chosen = saved(cutoffs(held, labels, risk, error), "cutoffs")
    forget(good, held)
    stats = with_statistics(docs, rows=True)
    once = F.explode(F.array(F.struct(*(c for c in stats.columns if c != "row")))).alias("s")  # behind the generator: the filter isn't pushed into the statistics
    return judged(stats.select("row", once).select("row", "s.*"), chosen).where("kept").select("row.*")


def report(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
