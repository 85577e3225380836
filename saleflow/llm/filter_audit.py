"""Audit of how corpus filters interact: what each removes at each step of every order, and its fair share.

Five filters fail a document: A under 100 words; B fewer than 80 distinct words in 100; C over 10 capitals A-Z in 100 code
points; D any of `#$%&*|`; E a text equal to that of a smaller doc_id. `failures` tells them per document, `coalitions`
counts per part and set of filters the documents that fail any of them (the removal game), and `audit` derives from
these 2^5 counts all steps of all orders. The Hart-Mas-Colell potential of a coalition is its worth plus the potentials
of the coalitions with one filter less, over its size; the Shapley value of a filter is the potential of all filters
less that without the filter. Potentials are kept 60 times as large, so they stay whole numbers.

Texts are read once; beyond that only digests (SHA-256) and flags are shuffled. Copies are counted per digest before the
shuffle, so a group that holds a third of all rows is a few rows for each task.

Nulls: a null text is empty, a null lang is the part ''; a row without doc_id has no label, fails E never and makes none
fail it. Ties and repeated rows: each row counts; rows of one doc_id are not smaller than each other. Repeated labels of
a doc_id count if one of them is 1. Very long texts: linear work. An empty table has no parts, so no rows. Columns other
than doc_id, text and lang (labels: doc_id, quality, toxic) aren't read, whatever their names.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
_BLANKS = " \t\n\x0b\x0c\r"


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, bits: bit i is set if the text fails filter i of A to D."""
    out = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("t"))
    words = F.split(F.btrim("t", F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")
    out = out.select("doc_id", "part", "t", F.when(F.btrim("t", F.lit(_BLANKS)) == "", F.array().cast("array<string>")).otherwise(words).alias("w"))
    n, different = F.size("w"), F.size(F.array_distinct("w"))
    capitals = F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[A-Z]+", ""))
    fails = [n < 100, 100 * different < 80 * n, 100 * capitals > 10 * F.length("t"), F.col("t").rlike(r"[#$%&*|]")]
    bits = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return out.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits.alias("bits"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits (all five filters), good, toxic, n: documents counted by what they fail and how they are labelled."""
    known = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = text_failures(docs).join(known, "doc_id", "left")
    label = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    kinds = ["digest", "part", "bits", "good", "toxic"]
    of_id = rows.select("doc_id", "digest", "part", "bits", *label).groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    copies = of_id.groupBy(*kinds).agg(
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("n_least"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a digest has a row for each part and label at most
    stay = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = copies.withColumn("first", first).select(*kinds[1:], "n", stay.alias("stay"))
    both = F.array(F.struct(F.col("bits"), F.col("stay").alias("n")), F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - F.col("stay")).alias("n")))
    told = split.select("part", "good", "toxic", F.explode(both).alias("x"))
    return told.groupBy("part", "x.bits", "good", "toxic").agg(F.sum("x.n").alias("n"))


def coalitions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, n, and the arrays all, good, toxic: element s counts the documents that fail any filter of the set s."""
    size = 1 << len(filters)
    each = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("s"))
    lost = F.when(F.col("bits").bitwiseAND(F.col("s")) != 0, F.col("n")).otherwise(0)
    worth = each.groupBy("part", "s").agg(
        F.sum("n").alias("n"),
        F.sum(lost).alias("all"),
        F.sum(F.when(F.col("good"), lost).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), lost).otherwise(0)).alias("toxic"),
    )
    lists = worth.groupBy("part").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("s", "all", "good", "toxic"))).alias("x"))
    return lists.select("part", "n", *(F.col(f"x.{c}").alias(c) for c in ("all", "good", "toxic")))


def potentials(worth: Column, players: int) -> Column:
    """60 times the Hart-Mas-Colell potential of every coalition of at most 5 players, as an array indexed by its set."""
    zero = F.array(F.lit(0).cast("long"))

    def step(p: Column, s: Column) -> Column:  # sets with a player less come before s
        less = [F.when(s.bitwiseAND(1 << i) != 0, F.get(p, s - (1 << i))).otherwise(0) for i in range(players)]
        total = sum(less, 60 * F.get(worth, s))
        return F.concat(p, F.array((total / F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << players) - 1)), zero, step)


def steps(filters: str = FILTERS) -> list[dict]:
    """Every step of every order: the filter and those before it, as sets."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        for k, i in enumerate(order):
            out.append({"filter_order": "".join(filters[j] for j in order), "step": k + 1, "own": 1 << i, "before": sum(1 << j for j in order[:k])})
    return out


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (over all orders)."""
    players = len(filters)
    everyone = (1 << players) - 1
    orders = len(steps(filters)) // players
    known = coalitions(counted, filters).withColumn("p", potentials(F.col("all"), players))
    plan = F.from_json(F.lit(json.dumps(steps(filters))), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = known.select("*", F.explode(plan).alias("at")).select("*", "at.*")
    after = F.col("before") + F.col("own")
    gain = lambda c: F.get(c, after) - F.get(c, F.col("before"))
    share = F.get("p", F.lit(everyone)) - F.get("p", F.lit(everyone) - F.col("own"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.get("all", after)).alias("kept"),
        gain("all").alias("removed"),
        (F.get("all", F.col("own")) - gain("all")).alias("redundant"),
        (F.get("all", F.lit(everyone)) - F.get("all", F.lit(everyone) - F.col("own"))).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (share * orders / 60).cast("long").alias("shapley"),
    )
