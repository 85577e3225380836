"""Cell keys, radius joins, posting lists and price sketches against brute force."""

import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from saleflow.operators import cells, stats, substring_index


def metres(a, b):
    (x1, y1), (x2, y2) = ((math.radians(v) for v in p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(1.0, h)))


@pytest.fixture(scope="module")
def points():
    r = random.Random(4)
    out = [(i, 126 + r.random() * 3, 34 + r.random() * 4) for i in range(3000)]
    out += [(3000 + i, 127.5, 36.5) for i in range(200)]  # a tower of flats
    out += [(4000, None, None), (4001, 180.0, 90.0), (4002, -180.0, -90.0), (4003, 127.5, None)]
    return out


def frame(spark, points):
    return spark.createDataFrame(points, "id long, lng double, lat double")


def test_ranges_cover_the_box(spark, points):
    keyed = {r.id: r.cell for r in frame(spark, points).select("id", cells.cell(F.col("lng"), F.col("lat")).alias("cell")).collect()}
    r = random.Random(9)
    for _ in range(60):
        west, south = 126 + r.random() * 3, 34 + r.random() * 4
        box = (west, south, west + r.random() ** 3 * 2, south + r.random() ** 3 * 2)
        spans = cells.ranges(*box)
        assert 0 < len(spans) <= cells.RANGES and all(a <= b for a, b in spans)
        for i, x, y in points:
            if x is not None and y is not None and box[0] <= x <= box[2] and box[1] <= y <= box[3]:
                assert any(a <= keyed[i] <= b for a, b in spans)
    assert keyed[4000] is None and keyed[4001] == (1 << 2 * cells.BITS) - 1 and keyed[4002] == 0
    assert cells.ranges(-180, -90, 180, 90) == [(0, (1 << 2 * cells.BITS) - 1)]


def test_row_groups_fall_with_the_radius(spark, points, tmp_path):
    path = f"{tmp_path}/cells"
    cells.clustered(frame(spark, points), files=16).write.parquet(f"file://{path}")
    rows = spark.read.parquet(f"file://{path}")
    groups = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("cell")
        stats_of = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        groups += [(s.min, s.max) for s in stats_of if s.has_min_max]
    read = []
    for radius in (500, 20_000, 400_000):
        dx, dy = cells._reach(36.0, radius)
        spans = cells.ranges(127.0 - dx, 36.0 - dy, 127.0 + dx, 36.0 + dy)
        read.append(sum(any(a <= high and low <= b for a, b in spans) for low, high in groups))
        got = {r.id for r in cells.around(rows, 127.0, 36.0, radius).collect()}
        assert got == {i for i, x, y in points if x is not None and y is not None and metres((x, y), (127.0, 36.0)) <= radius}
    assert read[0] <= 3 and read[0] <= read[1] < read[2]


@pytest.mark.parametrize("radius", [50, 3000, 40_000])
def test_radius_join_equals_brute_force(spark, points, radius):
    some, others = points[:400] + points[2990:3010] + points[3195:], points[300:700] + points[3000:3010] + points[-4:]
    got = cells.radius_join(frame(spark, some), frame(spark, others), radius, widest=66.0).select("id", "r_id").collect()
    close = lambda a, b: None not in (*a[1:], *b[1:]) and metres(a[1:], b[1:]) <= radius
    inside = lambda p: p[2] is not None and abs(p[2]) < 66
    assert sorted((r.id, r.r_id) for r in got if abs(r.id - 4001.5) > 1) == sorted((a[0], b[0]) for a in some for b in others if close(a, b) and inside(a))


def test_posting_lists_find_what_a_scan_finds(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abAB 가나12-") for _ in range(n))
    data = [(i, word(r.randint(0, 14)), None if i % 7 == 0 else word(r.randint(0, 30))) for i in range(400)] + [(900, "Üx%_", "aaaaaa"), (901, None, "")]
    rows = spark.createDataFrame(data, "id long, a string, b string").cache()
    index = substring_index.postings(rows, "id", ["a", "b"]).cache()
    assert index.count() == index.distinct().count()
    patterns = ["%_", "aaa", "aaaaaaa", "üX%", ""] + [(t := r.choice(data)[1] or "")[(s := r.randint(0, max(0, len(t) - 1))) : s + 1 + k % 12] or "b" for k in range(45)]
    for p in patterns:
        want = sorted(i for i, *texts in data if any(t is not None and p.lower() in t.lower() for t in texts))
        assert sorted(x.id for x in substring_index.search(index, rows, "id", ["a", "b"], p).collect()) == want, p


def test_sketches_are_exact_when_small_and_bounded_when_large(spark):
    deals = spark.range(60_000).select(
        F.when(F.col("id") < 50, "small").otherwise("hot").alias("lawd_cd"), F.lit("apt").alias("deal_type"), F.expr("date_add(date '2024-01-01', cast(id % 85 as int))").alias("deal_date"), F.lit(1.0).alias("area"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) + 1).cast("double").alias("amount"),
    )
    monthly = stats.price_sketches(deals.repartition(8))
    plan = monthly._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll_sketch_agg_double" in plan
    assert monthly.select(F.max(F.octet_length("sketch"))).first()[0] < 40_000
    for share in (0.1, 0.5, 0.9):
        for r in stats.quarter_prices(monthly, share).collect():
            values = sorted(x.amount for x in deals.where(F.col("lawd_cd") == r.lawd_cd).select("amount").collect())
            rank = sum(v <= r.price for v in values) / len(values)
            assert abs(rank - share) <= (1 / len(values) if r.lawd_cd == "small" else stats.SKETCH_ERROR + 1e-9)
            assert r.n_deals == len(values)
