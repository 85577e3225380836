import datetime

import pytest
from pyspark.sql import functions as F

from saleflow.functions import scalars as s


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (s.to_int, "1,234", 1234), (s.to_int, "12.5", None), (s.to_int, "", None), (s.to_int, "null", None), (s.to_int, None, None), (s.to_int, "-7", -7),
        (s.to_float, "1,234.5", 1234.5), (s.to_float, "x", None), (s.to_date8, "20260417", datetime.date(2026, 4, 17)), (s.to_date8, "2026-04-17", datetime.date(2026, 4, 17)),
        (s.to_date8, "2026-4-7", None), (s.to_date8, "20261399", None), (s.usage_code, "00000", None), (s.usage_code, "0", None), (s.usage_code, " 20101 ", "20101"),
        (s.clean_addr, "서울특별시 관악구 신림로31가길 00005-00000", "서울특별시 관악구 신림로31가길 5"), (s.clean_addr, "서울특별시 동작구 여의대방로36길 00020-00001", "서울특별시 동작구 여의대방로36길 20-1"),
        (s.max_area, "건물 12.5㎡ 토지 84.97㎡", 84.97), (s.max_area, "없음", None), (s.jp_price, "4,940,000円", 4_940_000), (s.jp_price, "494万円", 4_940_000),
        (s.jp_price, "494万5,000円", 4_945_000), (s.jp_date, "令和08年04月17日", datetime.date(2026, 4, 17)), (s.jp_date, "令和元年5月1日", datetime.date(2019, 5, 1)),
        (s.jp_date, "平成元年2月3日", datetime.date(1989, 2, 3)), (s.jp_normalize_addr, "八王子市川町１３番１３", "八王子市川町13番13"), (s.jp_status, "特別売却", "special_sale"),
        (s.to_int, "1,234", 1234), (s.to_int, " 12 ", 12), (s.to_int, "1 234", None), (s.to_int, "12.5", None), (s.to_int, "null", None), (s.to_float, "1 2", None), (s.to_float, "1,2.5", 12.5),
        (s.special_deposit, "20", True), (s.special_deposit, "10", False), (s.special_deposit, "x", None),
        (s.deposit_rate, "20", 20.0), (s.deposit_rate, "0", None), (s.area_to_pyeong, "전용 33.05785㎡", "전용 10.00평"), (s.jp_block, "91", "01"), (s.jp_block, "47", "09"),
    ],
)
def test_values(spark, f, given, want):
    assert value(spark, f, given) == want


def test_structs(spark):
    lien = value(spark, s.primary_lien, "1. 2019.08.30 근저당권 / 2. 2020.04.10 근저당권")
    assert (lien.date, lien.kind, len(lien.others)) == (datetime.date(2019, 8, 30), "근저당권", 1)
    assert value(spark, s.primary_lien, "없음") is None
    case = value(spark, s.jp_case_no, "令和07年(ケ)第221号")
    assert tuple(case) == ("令和", 7, "ケ", 221)
    assert [b.label for b in value(spark, s.remark_badges, "유치권 및 공실, 제시외  건물")] == ["유치권", "제시외 건물 포함", "공실"]
    road = spark.range(1).select(s.road_addr(F.lit("서울특별시 관악구 남현3길 00039-00000"), F.lit("(남현동,씨에스타운)")).alias("x")).first().x
    assert road == "서울특별시 관악구 남현3길 39 (남현동, 씨에스타운)"


@pytest.mark.parametrize(("v", "want"), [(None, "-"), (500, "500원"), (123_456, "12만원"), (100_000_000, "1억원"), (1_234_560_000, "12억 3,456만원")])
def test_money(spark, v, want):
    assert spark.createDataFrame([(v,)], "v long").select(s.money(F.col("v")).alias("x")).first().x == want


@pytest.mark.parametrize(("v", "want"), [(None, "-"), (500, "500"), (123_456, "12만"), (100_000_000, "1.0억"), (1_234_560_000, "12억")])
def test_short_money(spark, v, want):
    assert spark.createDataFrame([(v,)], "v long").select(s.money_short(F.col("v")).alias("x")).first().x == want


def test_status_and_photo(spark):
    told = lambda p, q: spark.range(1).select(s.case_status(F.lit(p).cast("string"), F.lit(q).cast("string")).alias("x")).first().x
    assert [told("0002100001", None), told("x0002", "00"), told("0001", "01"), told("9", ""), told(None, None)] == ["진행 중", "변경", "정지/연기/취하", "상태 미상", None]
    assert tuple(value(spark, s.jp_photo_url, "https://x/data/image/SH_R07K221_2_b.jpg")) == ("SH", "R", 7, "K", 221, 2, "b")


def test_days(spark):
    days = lambda d: spark.createDataFrame([(d,)], "d date").select(s.d_day_label(s.d_day(F.col("d"), "2001-09-01")).alias("x")).first().x
    assert [days(datetime.date(2001, 9, x)) for x in (1, 4)] == ["D-day", "D-3"] and days(datetime.date(2001, 8, 30)) == "D+2"
