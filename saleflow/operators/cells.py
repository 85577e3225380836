"""A space-filling cell key over coordinates: clustered writes, box and radius filters as key ranges, radius joins."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import haversine_m, in_box

#: Bits of a coordinate in a key: cells of some 0.3 by 0.15 thousandths of a degree.
BITS = 20
#: Metres of a degree of latitude, a little less than the least, and key ranges that a filter may have.
METRES, RANGES = 110_500.0, 64


def _spread(x: Column) -> Column:
    """The bits of a number below 2^20, each moved to an even place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _step(x: Column, low: float, width: float) -> Column:
    return F.least(F.greatest(F.floor((x - low) / width * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def cell(lng: Column, lat: Column) -> Column:
    """The key of a point: bits of longitude and latitude in turn; null without a point."""
    key = _spread(_step(lng, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_step(lat, -90.0, 180.0)), 1))
    return F.when(lng.isNotNull() & lat.isNotNull(), key)


def ranges(west: float, south: float, east: float, north: float, most: int = RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges of keys that cover a box: cells at its edge are parted, the largest first."""

    def at(x: float, low: float, width: float) -> int:
        return min(max(math.floor((x - low) / width * (1 << BITS)), 0), (1 << BITS) - 1)

    x0, x1, y0, y1 = at(west, -180, 360), at(east, -180, 360), at(south, -90, 180), at(north, -90, 180)
    whole, edge = [], [(-BITS, 0, 0, 0)]  # level as a negative side, key of the cell, its corner
    while edge and len(whole) + len(edge) + 3 <= most:
        side, key, x, y = heapq.heappop(edge)
        if side == 0:
            heapq.heappush(edge, (side, key, x, y))
            break
        half = 1 << (-side - 1)
        for i in range(4):
            cx, cy = x + half * (i & 1), y + half * (i >> 1)
            child = key + i * half * half
            if cx > x1 or cx + half - 1 < x0 or cy > y1 or cy + half - 1 < y0:
                continue
            inside = x0 <= cx and cx + half - 1 <= x1 and y0 <= cy and cy + half - 1 <= y1
            if inside:
                whole.append((child, child + half * half - 1))
            else:
                heapq.heappush(edge, (side + 1, child, cx, cy))
    spans = sorted(whole + [(key, key + (1 << (-2 * side)) - 1) for side, key, _x, _y in edge])
    out: list[tuple[int, int]] = []
    for low, high in spans:
        if out and out[-1][1] + 1 == low:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def clustered(rows: DataFrame, files: int | None = None) -> DataFrame:
    """`rows` with their `cell`, dealt and sorted by it: written like that, row groups hold neighbours. Rows without a point are last."""
    keyed = rows.withColumn("cell", cell(F.col("lng"), F.col("lat")))
    order = F.col("cell").asc_nulls_last()
    return (keyed.repartitionByRange(files, order) if files else keyed.repartitionByRange(order)).sortWithinPartitions(order)


def in_ranges(spans: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in spans:
        out = out | F.col("cell").between(low, high)
    return out


def boxed(rows: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Clustered rows in a box: key ranges prune row groups, the coordinates decide."""
    return rows.where(in_ranges(ranges(west, south, east, north)) & in_box(west, south, east, north))


def _reach(lat: float, metres: float) -> tuple[float, float]:
    """Degrees of longitude and latitude that a radius spans at most."""
    dy = metres / METRES
    return dy / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + dy)))), dy


def around(rows: DataFrame, lng: float, lat: float, metres: float) -> DataFrame:
    """Clustered rows within a radius of a point."""
    dx, dy = _reach(lat, metres)
    near = haversine_m(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat)) <= metres
    return boxed(rows, lng - dx, lat - dy, lng + dx, lat + dy).where(near)


def radius_join(left: DataFrame, right: DataFrame, metres: float, widest: float = 66.0) -> DataFrame:
    """All pairs (columns of `left`, columns of `right` as r_*, metres) within a radius, up to `widest` degrees of latitude.

    Cells are as wide as the radius; each left point is sent to its cell and the eight around it, so a pair meets in
    one cell, by an equi join that AQE can split where many points share one.
    """
    dx, dy = _reach(widest, metres)
    place = lambda df, p: (F.floor(F.col(f"{p}lng") / dx).alias("x"), F.floor(F.col(f"{p}lat") / dy).alias("y"))
    renamed = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).where("r_lng is not null and r_lat is not null")
    around9 = F.explode(F.array(*(F.struct((F.col("x") + i).alias("_x"), (F.col("y") + j).alias("_y")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = left.where("lng is not null and lat is not null").select("*", *place(left, "")).select(*left.columns, around9.alias("_c")).select(*left.columns, "_c.*")
    b = renamed.select(*renamed.columns, *place(renamed, "r_")).withColumnsRenamed({"x": "_x", "y": "_y"})
    apart = haversine_m(F.col("lng"), F.col("lat"), F.col("r_lng"), F.col("r_lat"))
    return a.join(b, ["_x", "_y"]).drop("_x", "_y").withColumn("metres", apart).where(F.col("metres") <= metres)


def radius_totals(left: DataFrame, right: DataFrame, metres: float, totals: list[Column], merged: list[Column]) -> DataFrame:
    """Rows of `left` that have rows of `right` within a radius, with `totals` of those; `merged` adds up totals of points.

    Rows of one place have the same neighbours: places are compared, each once, whatever number of rows stands there.
    """
    known = "lng is not null and lat is not null"
    there = right.where(known).groupBy("lng", "lat").agg(*totals)
    pairs = radius_join(left.where(known).select("lng", "lat").distinct(), there, metres)
    back = {f"r_{c}": c for c in there.columns if c not in ("lng", "lat")}
    found = pairs.select("lng", "lat", *(F.col(a).alias(b) for a, b in back.items())).groupBy("lng", "lat").agg(*merged)
    return left.join(found, ["lng", "lat"])
