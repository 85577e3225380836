"""Risk flags, categories and the safety score as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import max_area_plain

#: Flags of the remark text and their patterns (Unicode classes, newline ends a line).
TEXT_FLAGS = [
    ("share_sale", r"지분|\d+분의\s*\d+"),
    ("maeng_ji", "맹지"),
    ("yuchi", "유치권"),
    ("legal_ground", r"법정\s*지상권"),
    ("senior_tenant", r"선순위.{0,8}임차|대항력[^\n]{0,4}(있|존재|인정|발생)"),
    ("rent_unknown", "(임대관계|점유관계).{0,6}미상"),
    ("illegal_bld", "위반건축물|위반 건축물"),
    ("reserve_forest", "보전산지"),
    ("forestry_land", "임업용"),
    ("agri_zone", "농림지역"),
    ("nat_protect", "자연보전권역"),
    ("private_road", r"사도법|(^|[\s,(])사도($|[\s,)])"),
    ("pollak", "포락"),
    ("pamyo", "파묘|분묘"),
    ("power_line", "송전선|구분지상권"),
    ("show_only", "제시외"),
]
#: Penalty of each flag.
PENALTIES = {
    "share_sale": 18, "maeng_ji": 18, "yuchi": 22, "legal_ground": 22, "senior_tenant": 25, "rent_unknown": 10,
    "illegal_bld": 16, "reserve_forest": 9, "forestry_land": 4, "agri_zone": 5, "nat_protect": 5, "private_road": 8,
    "pollak": 9, "pamyo": 6, "power_line": 7, "show_only": 5, "many_fails": 6, "special_20": 6, "claim_90": 8,
    "stopped": 20, "farm_land": 4, "forest_only": 5, "tiny_area": 3, "new_villa": 3, "share_maeng": 12,
}
#: Adjustment by nature of the listing.
NATURE_ADJUST = {"collective": 0, "building": -3, "land": -5, "other": -6, "unknown": -2}


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?dU){pattern}"), F.lit(False))


def detail_texts(detail: Column) -> Column:
    """Struct `text` (remarks and appraisal notes that aren't blank, a line each) and `special` (all strings of the sale's
    terms), of a detail JSON."""
    parsed = F.from_json(
        detail,
        "csBaseInfo struct<rmk:string,topRmk:string>, dspslGdsDxdyInfo map<string,string>, aeeWevlMnpntLst array<struct<aeeWevlMnpntCtt:string>>",
    )
    terms = parsed["dspslGdsDxdyInfo"]
    notes = F.transform(F.coalesce(parsed["aeeWevlMnpntLst"], F.array().cast("array<struct<aeeWevlMnpntCtt:string>>")), lambda x: x["aeeWevlMnpntCtt"])
    remarks = F.array(*(F.try_element_at(terms, F.lit(k)) for k in ("dspslGdsRmk", "gdsSpcfcRmk")))
    case = F.array(parsed["csBaseInfo"]["rmk"], parsed["csBaseInfo"]["topRmk"])
    parts = F.filter(F.concat(remarks, notes, case), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.struct(F.array_join(parts, "\n").alias("text"), F.array_join(F.array_sort(F.map_values(terms)), " ").alias("special"))


def risk_flags(
    text: Column, fails: Column, special: Column, claim: Column, appraisal: Column, suspension: Column, usage: Column,
    areas: Column, middle: Column, summary: Column, details: Column, as_of_year: int,
) -> Column:
    """Sorted array of up to 25 flags."""
    tests = {flag: _has(text, pattern) for flag, pattern in TEXT_FLAGS}
    tests["many_fails"] = fails >= 5
    tests["special_20"] = _has(special, r"특별매각|보증금.{0,4}20\s*%")
    tests["claim_90"] = (claim != 0) & (appraisal != 0) & (claim.cast("double") / appraisal >= 0.9)
    tests["stopped"] = suspension.isNotNull() & ~suspension.isin("", "00", "000", "0")
    tests["farm_land"], tests["forest_only"] = usage.contains("전답"), usage == "임야"
    tests["tiny_area"] = max_area_plain(areas) <= 30
    villa = middle.isin("10101", "10102", "10103", "10104", "10105") | _has(summary, "빌라|다세대|연립")
    years = F.concat(
        F.regexp_extract_all(F.coalesce(summary, F.lit("")), F.lit(r"(19[6-9]\d|20\d{2})\s*년"), F.lit(1)),
        F.regexp_extract_all(F.coalesce(details, F.lit("")), F.lit(r"(19[6-9]\d|20\d{2})"), F.lit(1)),
    )
    newest = F.array_max(F.transform(years, lambda y: y.cast("int")))
    tests["new_villa"] = villa & (_has(summary, "신축") | _has(text, "신축") | F.coalesce(newest >= as_of_year - 5, F.lit(False)))
    tests["share_maeng"] = tests["share_sale"] & tests["maeng_ji"]
    return F.array_sort(F.filter(F.array(*(F.when(t, flag) for flag, t in tests.items())), lambda x: x.isNotNull()))


def nature(structure: Column, large: Column) -> Column:
    return (
        F.when(structure.contains("집합건물"), "collective").when(structure.contains("건물"), "building").when(structure.contains("토지"), "land")
        .when(large == "10000", "land").when(large == "20000", "building").when(large.isNotNull(), "other").otherwise("unknown")
    )


def safety_score(flags: Column, structure: Column, large: Column, building_year: Column, has_detail: Column, as_of_year: int) -> Column:
    """Struct of score, confidence, kind, type_adjust, age_adjust and the six heaviest factors (flag, penalty)."""
    penalties = F.create_map(*(F.lit(x) for kv in PENALTIES.items() for x in kv))
    kind = nature(structure, large)
    adjust = F.try_element_at(F.create_map(*(F.lit(x) for kv in NATURE_ADJUST.items() for x in kv)), kind)
    building = kind.isin("collective", "building")
    age = F.lit(as_of_year) - building_year
    aged = F.when(building & (age > 40), -4).when(building & (age > 30), -2).otherwise(0)
    known = F.filter(
        F.transform(flags, lambda x, i: F.struct((-F.try_element_at(penalties, x)).alias("p"), i.alias("i"), x.alias("flag"))),
        lambda x: x["p"].isNotNull(),
    )
    total = F.aggregate(known, F.lit(0), lambda a, x: a + x["p"])
    full = F.greatest(F.lit(0), F.least(F.lit(100), 100 + total + adjust + aged))
    detail = F.coalesce(has_detail, F.lit(False))
    factors = F.transform(F.slice(F.array_sort(known), 1, 6), lambda x: F.struct(x["flag"].alias("flag"), (-x["p"]).alias("penalty")))
    return F.struct(
        F.when(detail, full).otherwise(F.least(full, F.lit(65))).alias("score"),
        F.when(~detail, "low").when(building & building_year.isNull(), "medium").otherwise("high").alias("confidence"),
        kind.alias("kind"), adjust.alias("type_adjust"), aged.alias("age_adjust"), factors.alias("factors"),
    )


#: Usage names and words of the categories.
LOCATION_TAGS = ("vacation_home", "farm_house", "country_house", "townhouse")
SINGLE_HOUSES = ["단독주택", "단독주택다가구", "다가구주택"]
WHOLE_BUILDINGS = [*SINGLE_HOUSES, "근린시설"]
VACATION, COUNTRYSIDE, FARM = "별장|펜션|산장|리조트", "전원|전원주택|농가|농어촌", "농가|축사|농장|농어촌"
TOWNSHIP = r"(?:^|[\s,(])[가-힣]{1,10}[읍면](?=[\s,)]|$)"


def location_excluded(structure: Column, summary: Column, share: Column) -> Column:
    """Share sale, land only, or a unit of a collective building."""
    text = F.concat_ws(" ", structure, summary)
    land_only = text.contains("[토지") & ~text.contains("건물")
    return F.coalesce(share, F.lit(False)) | land_only | text.contains("집합건물")


def kr_categories(usage: Column, structure: Column, road: Column, lot: Column, summary: Column, emd: Column, sgg: Column, share: Column) -> Column:
    """Sorted array: whole_building; for single houses not excluded also vacation_home, farm_house and one of country_house and townhouse."""
    one, address = F.concat_ws(" ", structure, road, summary), F.concat_ws(" ", road, lot)
    rural = F.coalesce(emd.rlike("[읍면]$"), F.lit(False)) | F.coalesce(sgg.endswith("군"), F.lit(False)) | _has(address, TOWNSHIP)
    house = usage.isin(*SINGLE_HOUSES) & ~location_excluded(structure, summary, share)
    country = rural | _has(one, COUNTRYSIDE)
    whole = usage.isin(*WHOLE_BUILDINGS) & structure.contains("[건물") & ~structure.contains("집합건물") & ~F.coalesce(share, F.lit(False))
    found = F.array(
        F.when(whole, "whole_building"), F.when(house & _has(one, VACATION), "vacation_home"), F.when(house & _has(one, FARM), "farm_house"),
        F.when(house & country, "country_house"), F.when(house & ~country, "townhouse"),
    )
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))


#: Words and prefectures of the Japanese categories.
BESSOU, AKIYA, RESORT = "別荘|山荘|リゾート|別邸|リゾ", "空き家|古民家|あきや|古い民家", ["91", "92", "93", "94", "47"]


def jp_categories(sale_cls: Column, prefecture: Column, address: Column) -> Column:
    house = sale_cls == "2"
    found = F.array(
        F.when(house & _has(address, BESSOU), "bessou"), F.when(house & _has(address, AKIYA), "akiya"),
        F.when(house & prefecture.isin(*RESORT), "rizoto"), F.when(prefecture == "47", "tousho"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def merge_categories(rule: Column, previous: Column, external: Column, house: Column, banned: Column, force: Column) -> Column:
    """Previous location tags survive a forced run without new ones; external tags fill single houses that have none."""
    empty = F.array().cast("array<string>")
    location = F.array(*(F.lit(x) for x in LOCATION_TAGS))
    kept = F.when(force & ~banned & (F.size(F.array_intersect(rule, location)) == 0), F.array_intersect(F.coalesce(previous, empty), location)).otherwise(empty)
    now = F.array_union(rule, kept)
    more = F.when(house & ~banned & (F.size(F.array_intersect(now, location)) == 0), F.array_intersect(F.coalesce(external, empty), location)).otherwise(empty)
    return F.array_sort(F.array_union(now, more))


def jp_merge_categories(rule: Column, previous: Column, external: Column, sale_cls: Column, prefecture: Column, address: Column, force: Column) -> Column:
    empty = F.array().cast("array<string>")
    base = F.when(force & (F.size(rule) == 0), F.coalesce(previous, empty)).otherwise(rule)
    more = F.when(sale_cls == "2", F.coalesce(external, empty)).otherwise(empty)
    merged = F.array_union(base, more)
    island = (prefecture == "47") | address.contains("島")
    return F.array_sort(F.when(F.coalesce(island, F.lit(False)), merged).otherwise(F.array_except(merged, F.array(F.lit("tousho")))))
