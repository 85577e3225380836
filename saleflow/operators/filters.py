"""Visibility, listing filters, pages, map cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleflow.functions.scalars import haversine_m


def visible(as_of: str) -> Column:
    """Active, or sold and deleted within 30 days."""
    return F.col("deleted_on").isNull() | (F.col("sold") & (F.col("deleted_on") >= F.date_sub(F.lit(as_of).cast("date"), 30)))


def status_mode(mode: str, as_of: str) -> Column:
    return {"active": F.col("deleted_on").isNull(), "with_sold": visible(as_of), "sold_only": F.coalesce(F.col("sold"), F.lit(False))}[mode]


#: Filter: column, comparison, factor (amounts are given in units of 10,000; 0 is not set).
RANGES = {
    "min_appraisal": ("appraisal_amount", ">=", 10_000), "max_appraisal": ("appraisal_amount", "<=", 10_000),
    "min_price": ("min_sale_price", ">=", 10_000), "max_price": ("min_sale_price", "<=", 10_000),
    "min_fails": ("fail_count", ">=", 1), "max_fails": ("fail_count", "<=", 1), "min_safety": ("safety", ">=", 1),
    "min_rate": ("sale_rate", ">=", 1), "max_rate": ("sale_rate", "<=", 1),
}


def filter_listings(df: DataFrame, given: dict, as_of: str) -> DataFrame:
    """All given predicates together; a range drops nulls."""
    tests = [F.lit(True)]
    for name in ("court_code", "sd_code", "sgg_code", "usage_lcl_cd", "usage_mcl_cd", "usage_scl_cd"):
        if given.get(name):
            tests.append(F.col(name) == given[name])
    for name, (column, sign, factor) in RANGES.items():
        if given.get(name):
            value = F.lit(given[name] * factor)
            tests.append(F.col(column) >= value if sign == ">=" else F.col(column) <= value)
    if given.get("date_from"):
        tests.append(F.col("sale_date") >= F.lit(given["date_from"]).cast("date"))
    if given.get("date_to"):
        tests.append(F.col("sale_date") <= F.lit(given["date_to"]).cast("date"))
    if given.get("upcoming") and given.get("mode") != "sold_only":
        tests.append(F.col("sale_date") >= F.lit(as_of).cast("date"))
    if given.get("has_road") is not None:
        tests.append(F.col("road_addr").isNotNull() if given["has_road"] else F.col("road_addr").isNull())
    tests.append(status_mode(given.get("mode", "active"), as_of))
    return df.where(reduce(lambda a, b: a & b, tests))


def keyword(q: str) -> Column:
    """A case number if it looks like one, else any of three address columns, whatever the case."""
    import re

    q = re.sub(r"[%_,()\\*\"']", " ", q).strip()
    if "타경" in q or re.match(r"^\d{4}", q):
        return F.col("case_no").contains(q)
    return F.lower("road_addr").contains(q.lower()) | F.lower("lot_addr").contains(q.lower()) | F.lower("conv_addr").contains(q.lower())


def exclude_flags(column: str, flags: list[str]) -> Column:
    return F.col(column).isNull() | ~F.arrays_overlap(F.col(column), F.array(*map(F.lit, flags)))


def has_any(column: str, values: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))


def in_usage(names: list[str]) -> Column:
    return F.col("usage_nm").isin(*names)


def in_territory() -> Column:
    """The country's box, for maps without a viewport."""
    return in_box(124, 33, 132, 39)


def in_box(west: float, south: float, east: float, north: float) -> Column:
    return F.col("lng").between(west, east) & F.col("lat").between(south, north)


def within_radius(lng: float, lat: float, metres: float) -> Column:
    """A box first, which prunes row groups, then the great circle."""
    dy = metres / 111_000
    dx = dy / 0.7
    return in_box(lng - dx, lat - dy, lng + dx, lat + dy) & (haversine_m(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat)) <= metres)


def visible_children(children: DataFrame, props: DataFrame, as_of: str) -> DataFrame:
    return children.join(props.where(visible(as_of)).select("docid"), "docid", "left_semi")


def page_total(df: DataFrame) -> DataFrame:
    """How many rows the pages of `list_page` have together."""
    return df.agg(F.count(F.lit(1)).alias("total"))


#: Sort mode of Japanese listings: column.
JP_SORTS = {"sale_unit_id": "sale_unit_id", "sale_cls": "sale_cls", "price": "standard_price", "bid_period": "bid_start", "status": "status", "address": "address_text"}


def jp_page(df: DataFrame, sort: str | None, rising: bool, page: int, size: int) -> DataFrame:
    """One page of Japanese listings, nulls last in both directions, sale_unit_id breaking ties; without a known sort mode
    the earliest bids first."""
    column, rising = (JP_SORTS[sort], rising) if sort in JP_SORTS else (JP_SORTS["bid_period"], True)
    order = F.col(column).asc_nulls_last() if rising else F.col(column).desc_nulls_last()
    size, page = max(10, min(100, size)), max(1, page)
    return df.orderBy(order, "sale_unit_id").offset((page - 1) * size).limit(size)


#: Sort mode: column and direction.
SORTS = {
    "date_asc": ("sale_date", True), "date_desc": ("sale_date", False), "price_asc": ("min_sale_price", True),
    "price_desc": ("min_sale_price", False), "appraisal_asc": ("appraisal_amount", True), "appraisal_desc": ("appraisal_amount", False),
    "fails_asc": ("fail_count", True), "fails_desc": ("fail_count", False), "safety_asc": ("safety", True), "safety_desc": ("safety", False),
    "rate_asc": ("sale_rate", True), "rate_desc": ("sale_rate", False),
}


def list_page(df: DataFrame, sort: str, page: int, size: int) -> DataFrame:
    """One page, nulls last in both directions, docid breaking ties."""
    column, rising = SORTS[sort]
    size, page = max(10, min(100, size)), max(1, page)
    order = F.col(column).asc_nulls_last() if rising else F.col(column).desc_nulls_last()
    return df.orderBy(order, "docid").offset((page - 1) * size).limit(size)


def map_rows(df: DataFrame, box: tuple[float, float, float, float], most: int, as_of: str) -> DataFrame:
    rows = df.where(visible(as_of) & in_box(*box))
    return rows.orderBy(F.col("sale_date").asc_nulls_last(), "docid").limit(max(50, min(1000, most)))


def marker_key() -> Column:
    return F.when(F.col("sold"), "sold").when(F.col("usage_lcl_cd").isin("10000", "20000", "30000", "40000"), F.col("usage_lcl_cd")).otherwise("unknown")


def markers(df: DataFrame, enabled: tuple[str, ...] = ("20000",)) -> DataFrame:
    """Rows whose marker key is enabled, with the key."""
    return df.withColumn("marker", marker_key()).where(F.col("marker").isin(*enabled))
