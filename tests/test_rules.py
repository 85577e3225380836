import pytest
from pyspark.sql import functions as F

from saleflow.functions import rules

SCHEMA = "flags array<string>, structure string, large string, usage string, year int, detail boolean"
BASE = {"flags": [], "structure": "[집합건물 철근콘크리트 84.9㎡]", "large": "20000", "usage": "아파트", "year": 2015, "detail": True}


def score(spark, **over):
    row = BASE | over
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    return df.select(rules.safety_score(F.col("flags"), F.col("structure"), F.col("large"), F.col("year"), F.col("detail"), 2026).alias("s")).first().s


@pytest.mark.parametrize(
    ("over", "want", "confidence"),
    [
        ({}, 100, "high"), ({"flags": ["yuchi"]}, 78, "high"), ({"flags": ["senior_tenant", "yuchi", "claim_90"]}, 45, "high"), ({"flags": ["no_such"]}, 100, "high"),
        ({"flags": list(rules.PENALTIES)}, 0, "high"), ({"structure": "[토지]", "large": "10000", "year": None}, 95, "high"), ({"year": 2000}, 100, "high"),
        ({"year": 1990}, 98, "high"), ({"year": 1980}, 96, "high"), ({"structure": "[토지]", "year": 1900}, 95, "high"), ({"detail": False}, 65, "low"),
        ({"structure": "[건물]", "year": None}, 97, "medium"),
    ],
)
def test_scores(spark, over, want, confidence):
    s = score(spark, **over)
    assert (s.score, s.confidence) == (want, confidence)


def test_factors_by_penalty_then_order(spark):
    s = score(spark, flags=["maeng_ji", "claim_90", "senior_tenant", "share_sale"])
    assert [f.flag for f in s.factors] == ["senior_tenant", "maeng_ji", "share_sale", "claim_90"]
    assert len(rules.PENALTIES) == 25


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("대항력 없음", []), ("대항력 있음", ["senior_tenant"]), ("지분 매각 맹지", ["maeng_ji", "share_maeng", "share_sale"]), ("법정 지상권", ["legal_ground"]),
        ("선순위 전세 임차인", ["senior_tenant"]), ("(사도)", ["private_road"]), ("사도세자", []), ("위반건축물, 송전선", ["illegal_bld", "power_line"]), (None, []),
    ],
)
def test_text_flags(spark, text, want):
    none, zero = F.lit(None).cast("string"), F.lit(0)
    flags = rules.risk_flags(F.col("t"), zero, none, zero, zero, none, none, none, none, none, none, 2026)
    assert spark.createDataFrame([(text,)], "t string").select(flags.alias("f")).first().f == want


@pytest.mark.parametrize(("address", "want"), [("제주시 애월읍", ["country_house"]), ("달성군 가창면, 12", ["country_house"]), ("서울 삼면길 4", ["townhouse"])])
def test_township(spark, address, want):
    none = F.lit(None).cast("string")
    cats = rules.kr_categories(F.lit("단독주택"), F.lit("[주택 1㎡]"), F.col("a"), none, none, none, none, F.lit(False))
    assert spark.createDataFrame([(address,)], "a string").select(cats.alias("c")).first().c == want


def test_merged_categories(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    t, f = F.lit(True), F.lit(False)
    row = spark.range(1).select(
        rules.merge_categories(a("whole_building"), a("farm_house", "junk"), a("townhouse"), t, f, t).alias("kept"),
        rules.merge_categories(a(), a("farm_house"), a("townhouse", "x"), t, f, f).alias("external"),
        rules.merge_categories(a(), a("farm_house"), a("townhouse"), t, t, t).alias("banned"),
        rules.jp_merge_categories(a(), a("bessou", "tousho"), a("akiya"), F.lit("2"), F.lit("13"), F.lit("東京"), t).alias("jp"),
    ).first()
    assert list(row) == [["farm_house", "whole_building"], ["townhouse"], [], ["akiya", "bessou"]]
