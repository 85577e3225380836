"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join that AQE can split on hot nodes; the edges of
each round are written to the shared folder. Nothing is collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def _star(directed: DataFrame, large: bool) -> DataFrame:
    """`directed` has u, v. Large: all neighbours above u move to the least one; small: all those below u, and u."""
    least = directed.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        moved = directed.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    else:
        moved = directed.join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): component is the least node that it reaches.

    Loops and repeated edges are allowed; nodes without edges aren't in the result.
    """
    long = lambda c: F.col(c).cast("long")
    now = edges.select(F.greatest(long("a"), long("b")).alias("a"), F.least(long("a"), long("b")).alias("b")).where("a <> b").distinct()
    now, mark = saved(now, "edges"), None
    for _ in range(rounds):
        got = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (got.n, got.x) == mark or not got.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        mark = (got.n, got.x)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v"))
        large = _star(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), large=True)
        before = now
        now = saved(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), large=False), "edges")
        forget(before)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
