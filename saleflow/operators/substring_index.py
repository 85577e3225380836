"""Substring search over text columns by posting lists of three-letter pieces, with verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleflow.shared import once

SIZE = 3


def _grams(text: Column) -> Column:
    """The distinct pieces of a lower-cased text; none of a shorter one."""
    low = text
    places = F.when(F.length(low) >= SIZE, F.sequence(F.lit(1), F.length(low) - (SIZE - 1)))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substring(low, i, F.lit(SIZE))))


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """gram, name (of the column), key: a row for each distinct piece of each text. Write it sorted by gram to prune files."""
    texts = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lower(c).alias("text")) for c in columns)))  # behind the generator: once for each text
    each = rows.select(key, texts.alias("t")).where("t.text is not null")
    return each.select(F.explode(_grams(F.col("t.text"))).alias("gram"), "t.name", key)


def search_all(index: DataFrame, rows: DataFrame, key: str, columns: list[str], patterns: list[str]) -> DataFrame:
    """(pattern, key) for all patterns at once, as `search` finds them: the rows are shuffled once, not for each pattern."""
    lows = {p: p.lower() for p in dict.fromkeys(patterns)}
    within = lambda low: reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in columns))
    spark = rows.sparkSession
    short = [p for p, low in lows.items() if len(low) < SIZE]
    pieces = [(p, low[i : i + SIZE]) for p, low in lows.items() if p not in short for i in range(len(low) - SIZE + 1)]
    told = F.filter(F.array(*(F.when(within(F.lit(lows[p])), p) for p in short)), lambda x: x.isNotNull()) if short else F.array().cast("array<string>")
    out = rows.select(F.explode(told).alias("pattern"), key)
    if not pieces:
        return out
    wanted = spark.createDataFrame(sorted(set(pieces)), "pattern string, gram string")
    counts = wanted.groupBy("pattern").agg(F.count(F.lit(1)).alias("pieces"))
    lists = index.where(F.col("gram").isin(sorted({g for _, g in pieces})) & F.col("name").isin(columns)).join(F.broadcast(wanted), "gram")
    whole = lists.groupBy("pattern", "name", key).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(counts), "pattern").where("n = pieces")
    mine = whole.groupBy(key).agg(F.collect_set("pattern").alias("patterns"))  # at most one of each
    found = F.filter("patterns", lambda p: reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.col(f"_low_{c}"), F.lower(p)), F.lit(False)) for c in columns)))
    low = once(rows.select(key, *(F.lower(c).alias(f"_low_{c}") for c in columns)), *(f"_low_{c}" for c in columns))
    return out.unionByName(low.join(mine, key).select(F.explode(found).alias("pattern"), key))


def search(index: DataFrame, rows: DataFrame, key: str, columns: list[str], pattern: str) -> DataFrame:
    """Rows of which any of `columns` contains `pattern`, whatever the case.

    A pattern of SIZE characters or more reads the lists of its own pieces alone: rows that have all of them in one
    column are candidates, and their texts decide. A shorter pattern is a scan.
    """
    low = pattern.lower()
    found = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False)) for c in columns))
    if len(low) < SIZE:
        return rows.where(found)
    grams = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    lists = index.where(F.col("gram").isin(grams) & F.col("name").isin(columns))
    whole = lists.groupBy("name", key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams))
    return rows.join(whole.select(key).distinct(), key, "left_semi").where(found)
