"""Totals within a radius, where many rows stand in one place."""

from pyspark.sql import functions as F

from saleflow.operators import cells


def test_rows_of_one_place_are_compared_once(spark, monkeypatch):
    left = spark.range(4000).select("id", F.lit(127.5).alias("lng"), F.lit(36.5).alias("lat"))
    right = left.select("lng", "lat", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v")).unionByName(spark.sql("select 127.51D as lng, 36.5D as lat, 5L as v union all select 130D, 36D, 7L union all select null, 36D, 9L"))
    seen, join = [], cells.radius_join
    monkeypatch.setattr(cells, "radius_join", lambda *a, **b: seen.append(join(*a, **b)) or seen[-1])
    out = cells.radius_totals(left, right, 1500, [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")], [F.sum("n").alias("n"), F.sum("total").alias("total")])
    want = sum(range(0, 4000, 2)) + 5
    assert {(r.n, r.total) for r in out.collect()} == {(4001, want)} and out.count() == 4000
    assert seen[0].count() == 2  # places, not 4000 times 4001 rows
