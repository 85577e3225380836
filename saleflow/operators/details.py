"""Details, deals, registers and the daily upkeep of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleflow.functions import scalars as sc
from saleflow.operators.windows import dedupe_last
from saleflow.shared import once
from saleflow.sources.scan import _key


def to_sale_results(scan: DataFrame, order: list[str], row: str = "row") -> DataFrame:
    """Closed-sale rows, last wins on docid."""
    scan = once(scan, row)  # all fields are read from it
    r = F.col(row)
    out = scan.select(
        _key(r, "docid").alias("docid"), _key(r, "boCd", "cortOfcCd").alias("court_code"), _key(r, "srnSaNo").alias("case_no"), _key(r, "daepyoSidoCd").alias("sd_code"),
        _key(r, "daepyoSiguCd", "daepyoSggCd").alias("sgg_code"), _key(r, "daepyoDongCd", "daepyoEmdCd").alias("emd_code"), sc.usage_code(_key(r, "lclsUtilCd")).alias("usage_lcl_cd"),
        sc.to_int(_key(r, "gamevalAmt")).alias("appraisal_amount"), sc.to_int(_key(r, "maeAmt")).alias("sale_amount"), sc.to_int(_key(r, "inqCnt")).alias("bidder_count"),
        sc.to_int(_key(r, "yuchalCnt")).alias("fail_count"), sc.to_date8(_key(r, "maeGiil")).alias("sale_date"), _key(r, "dspslUsgNm").alias("usage_nm"), *order,
    )
    return dedupe_last(out.where("docid is not null"), ["docid"], order).drop(*order)


def detail_case(detail: Column) -> Column:
    """Struct of claim, received, started and suspension of a detail JSON."""
    path = lambda *names: sc.first_truthy(*(F.get_json_object(detail, f"$.csBaseInfo.{n}") for n in names))
    return F.struct(
        sc.to_int(path("clmAmt")).alias("claim"), sc.to_date8(path("rcptYmd", "csRcptYmd")).alias("received"), sc.to_date8(path("cmdYmd", "csCmdcYmd")).alias("started"),
        path("auctnSuspStatCd").alias("suspension"), path("rmk").alias("remark"),
    )


#: Keys of a detail that are kept; rounds and photos have tables of their own.
KEPT = [
    "csBaseInfo", "dspslGdsDxdyInfo", "aeeWevlMnpntLst", "rgltLandLstAll", "bldSdtrDtlLstAll", "gdsRletStLtnoLstAll", "dstrtDemnInfo",
    "gdsDspslObjctLst", "picDvsIndvdCnt",
]


def slim_detail(detail: Column) -> Column:
    """The kept keys that hold something, as JSON."""
    values = [F.get_json_object(detail, f"$.{k}") for k in KEPT]
    entries = F.filter(
        F.array(*(F.when(~v.isin("", "[]", "{}", "null"), F.concat(F.lit(f'"{k}":'), F.when(v.rlike(r"^[\[{]"), v).otherwise(F.to_json(F.array(v))))) for k, v in zip(KEPT, values, strict=True))),
        lambda x: x.isNotNull(),
    )
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def normalize_deal(row: Column) -> Column:
    """Struct of a raw deal (map of strings): name of six keys, area of five, date only if all parts are digits."""
    parts = [F.trim(F.try_element_at(row, F.lit(k))) for k in ("dealYear", "dealMonth", "dealDay")]
    digits = parts[0].rlike("^[0-9]+$") & parts[1].rlike("^[0-9]+$") & parts[2].rlike("^[0-9]+$")
    date = F.concat_ws("-", F.lpad(parts[0], 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    areas = [sc.to_float(F.try_element_at(row, F.lit(k))) for k in ("excluUseAr", "dealArea", "totalFloorAr", "buildingAr", "landAr")]
    return F.struct(
        _key(row, "aptNm", "offiNm", "mhouseNm", "houseType", "buildingType", "umdNm").alias("name"), F.coalesce(*(F.when(a != 0, a) for a in areas)).alias("area"),
        sc.to_int(F.try_element_at(row, F.lit("floor"))).alias("floor"), sc.to_int(F.try_element_at(row, F.lit("buildYear"))).alias("built_year"),
        sc.to_float(F.try_element_at(row, F.lit("dealAmount"))).alias("amount"), F.when(digits, date.try_cast("date")).alias("deal_date"),
    )


def normalize_register(row: Column) -> Column:
    number = lambda k: sc.to_float(F.try_element_at(row, F.lit(k)))
    whole = lambda k: sc.to_int(F.try_element_at(row, F.lit(k)))
    return F.struct(
        sc.to_date8(F.try_element_at(row, F.lit("useAprDay"))).alias("approved_on"), _key(row, "strctCdNm").alias("structure"), _key(row, "mainPurpsCdNm").alias("purpose"),
        number("totArea").alias("total_area"), number("archArea").alias("building_area"), number("platArea").alias("plot_area"), whole("grndFlrCnt").alias("floors"),
        whole("ugrndFlrCnt").alias("basements"), whole("hhldCnt").alias("households"), number("heit").alias("height"),
    )


def register_params(sd: Column, sgg: Column, emd: Column, lot_no: Column, lot_addr: Column) -> Column:
    """Struct sigungu, bjdong, bun, ji, mountain; null where the codes or the lot number can't be read."""
    sigungu, lot = F.concat(sd, sgg), F.trim(F.coalesce(lot_no, F.lit("")))
    mountain = lot.startswith("산") | F.coalesce(lot_addr.rlike(r"산\s*[0-9]"), F.lit(False))
    bare = F.trim(F.regexp_replace(lot, "^산+", ""))
    parts = r"^([0-9]+)(?:-([0-9]+))?"
    ji = F.regexp_extract(bare, parts, 2)
    pad = lambda c: F.when(F.length(c) >= 4, c).otherwise(F.lpad(c, 4, "0"))
    made = F.struct(
        sigungu.alias("sigungu"), F.concat(emd, F.lit("00")).alias("bjdong"), pad(F.regexp_extract(bare, parts, 1)).alias("bun"),
        pad(F.when(ji == "", "0").otherwise(ji)).alias("ji"), F.when(mountain, "1").otherwise("0").alias("mountain"),
    )
    return F.when((F.length(sigungu) == 5) & bare.rlike(parts), made)


#: Keys of an item's area and unit, first that is set counts.
AREA_KEYS = ["土地面積（登記）", "土地面積（現況）", "床面積（登記）", "床面積（現況）", "専有面積（登記）", "専有面積（現況）", "土地面積(登記)", "床面積(登記)", "専有面積(登記)"]
UNIT_KEYS = ["号室", "建物の名称", "棟番号", "部屋番号"]


def _each(fields: Column, keys: list[str]) -> Column:
    found = F.transform(fields, lambda m: F.coalesce(*(sc.clean_str(F.try_element_at(m, F.lit(k))) for k in keys)))
    return sc.truthy(F.array_join(F.filter(found, lambda x: x.isNotNull()), " / "))


def jp_area_text(fields: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_each(fields, AREA_KEYS), r"(?<![A-Za-z])m\s*2(?![0-9])", "㎡"), r"\s+", " "))


def jp_unit_no(fields: Column) -> Column:
    return _each(fields, UNIT_KEYS)


def jp_area_m2(fields: Column) -> Column:
    return sc.truthy(F.regexp_extract(jp_area_text(fields), r"([0-9.]+)\s*㎡", 1)).try_cast("double")


def jp_filter(df: DataFrame, given: dict) -> DataFrame:
    """Any of court, prefecture, class, status, prices, categories (overlap), the document flag and a keyword."""
    out = df
    for name in ("court_id", "prefecture", "sale_cls", "status"):
        if given.get(name):
            out = out.where(F.col(name) == given[name])
    if given.get("min_price"):
        out = out.where(F.col("standard_price") >= given["min_price"] * 10_000)
    if given.get("max_price"):
        out = out.where(F.col("standard_price") <= given["max_price"] * 10_000)
    if given.get("categories"):
        out = out.where(F.arrays_overlap("categories", F.array(*map(F.lit, given["categories"]))))
    if given.get("has_pdf"):
        out = out.where(F.get_json_object("detail", "$.has_three_set_pdf") == "true")
    if q := (given.get("keyword") or "").strip():
        era = q.startswith(("令和", "平成"))
        out = out.where(F.col("case_no" if era else "address").contains(q))
    return out


def jp_close_aged(df: DataFrame, since: Column) -> DataFrame:
    """Rows fetched before then are closed unless closed or aborted already."""
    open_ = F.col("status").isNull() | ~F.col("status").isin("closed", "aborted")
    return df.withColumn("status", F.when(open_ & (F.col("fetched_at") < since), "closed").otherwise(F.col("status")))


def jp_apply_detail(props: DataFrame, details: DataFrame, key: str, prices: list[str], places: list[str]) -> tuple[DataFrame, DataFrame]:
    """(listings with the details' values that aren't null, history of prices that were known and changed)."""
    n = details.select(key, *(F.col(c).alias(f"_{c}") for c in (*prices, *places)))
    joined = props.join(n, key, "left")
    changed = F.lit(False)
    for c in prices:
        changed = changed | F.coalesce(F.col(c) != F.col(f"_{c}"), F.lit(False))
    history = joined.where(changed).select(key, *(F.col(f"_{c}").alias(c) for c in prices), *(F.col(c).alias(f"prev_{c}") for c in prices))
    new = joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in (*prices, *places) else F.col(c) for c in props.columns))
    return new, history


def refill(props: DataFrame, raw: DataFrame, key: str, columns: list[str], tolerance: float | None = None) -> DataFrame:
    """Recomputed columns over the stored ones; outcome is updated, noop or skipped (nothing to take).

    With a `tolerance` (coordinates: 1e-4) the stored values stay where all columns are within it.
    """
    n = raw.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = props.join(n, key, "left")
    some, differs = F.lit(False), F.lit(False)
    for c in columns:
        some = some | F.col(f"_{c}").isNotNull()
        same = F.col(f"_{c}").eqNullSafe(F.col(c)) if tolerance is None else F.coalesce(F.abs(F.col(f"_{c}") - F.col(c)) < tolerance, F.lit(False))
        differs = differs | (F.col(f"_{c}").isNotNull() & ~same)
    out = joined.withColumn("outcome", F.when(~some, "skipped").when(differs, "updated").otherwise("noop"))
    new = lambda c: F.when(F.col("outcome") == "updated", F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c)
    return out.select(*(new(c) if c in columns else F.col(c) for c in props.columns), "outcome")


def refill_arrays(df: DataFrame, column: str, recomputed: Column, force: bool) -> DataFrame:
    """An array column recomputed where it is empty, or everywhere; a row counts as changed if the sorted arrays differ."""
    due = F.lit(force) | F.col(column).isNull() | (F.size(column) == 0)
    new = F.array_sort(recomputed)
    empty = F.array().cast("array<string>")
    changed = due & (new != F.array_sort(F.coalesce(F.col(column), empty)))
    return df.withColumn("changed", changed).withColumn(column, F.when(due, new).otherwise(F.col(column)))


def geocode_candidates(props: DataFrame) -> DataFrame:
    return props.where("lng is not null and lat is not null and road_addr is null")


def apply_geocodes(props: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Road addresses found elsewhere, only where there is none."""
    return props.join(found.select(key, F.col("road_addr").alias("_road")), key, "left").withColumn("road_addr", F.coalesce("road_addr", "_road")).drop("_road")


def training_rows(results: DataFrame, props: DataFrame) -> DataFrame:
    """Sold and appraised results with the listing's structure text and usage."""
    known = results.where("sale_amount > 0 and appraisal_amount > 0")
    return known.join(props.select("docid", "conv_addr", F.col("usage_nm").alias("prop_usage")), "docid", "left")


def attach(props: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """Optional one-to-one columns; missing ones are null."""
    return props.join(other.select("docid", *columns), "docid", "left")


def jp_listing_view(props: DataFrame, cases: DataFrame, courts: DataFrame) -> DataFrame:
    """Listings of known cases and known courts."""
    return props.join(cases, ["court_code", "case_no"]).join(courts.select("court_code", "court_name"), "court_code")


def listing_view(props: DataFrame, cases: DataFrame, courts: DataFrame) -> DataFrame:
    """Listings of known cases, with the court's name where there is one."""
    return props.join(cases, ["court_code", "case_no"]).join(courts.select("court_code", "court_name"), "court_code", "left")


def detail_queue(props: DataFrame, limit: int) -> DataFrame:
    """Active listings never synced or with a refresh asked for, by sale date."""
    due = props.where("deleted_on is null and (synced_on is null or coalesce(refresh, false))")
    return due.orderBy(F.col("sale_date").asc_nulls_last(), "docid").limit(limit)


def union_masters(b: DataFrame, o: DataFrame, key: str) -> DataFrame:
    """Master rows of both prefixes; the first prefix wins on a code."""
    both = b.withColumn("_p", F.lit(1)).unionByName(o.withColumn("_p", F.lit(0)))
    return dedupe_last(both, [key], ["_p"]).drop("_p")


def estimate_caveats(method: Column, samples: Column, missing: dict[str, Column]) -> Column:
    """Low confidence of a regional or thin estimate, and the features that are missing."""
    low = F.when((method == "region_avg") | (samples < 30), "low_confidence")
    return F.filter(F.array(low, *(F.when(c.isNull(), name) for name, c in missing.items())), lambda x: x.isNotNull())



def flag_inputs(rows: DataFrame, detail: str = "detail") -> DataFrame:
    """`rows` with what the flags take from a detail JSON: detail_text (remarks and notes that aren't blank, a line each),
    special (string values of the sale's terms), suspension, claim, built (years of the buildings) and has_detail.

    The JSON is parsed once, to a VARIANT, and read by path; both steps stand behind generators, so neither is repeated
    where a column is used often. What isn't an object, list or string where one is expected counts as missing.
    """
    known = rows.select("*", F.inline(F.array(F.struct(F.try_parse_json(detail).alias("_v")))))
    get = lambda path, kind: F.try_variant_get("_v", path, kind)
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    listed = lambda path, inner: F.transform(F.coalesce(get(path, "array<variant>"), F.array().cast("array<variant>")), lambda x: text(F.try_variant_get(x, f"$.{inner}", "variant")))
    single = [text(get(f"$.{path}", "variant")) for path in ("dspslGdsDxdyInfo.dspslGdsRmk", "dspslGdsDxdyInfo.gdsSpcfcRmk")]
    case = [text(get(f"$.csBaseInfo.{k}", "variant")) for k in ("rmk", "topRmk")]
    parts = F.filter(F.concat(F.array(*single), listed("$.aeeWevlMnpntLst", "aeeWevlMnpntCtt"), F.array(*case)), lambda x: x.isNotNull() & (F.trim(x) != ""))
    terms = F.transform(F.map_values(get("$.dspslGdsDxdyInfo", "map<string,variant>")), text)
    found = F.struct(
        F.array_join(parts, "\n").alias("detail_text"), F.array_join(F.array_sort(F.filter(terms, lambda x: x.isNotNull())), " ").alias("special"),
        F.trim(get("$.csBaseInfo.auctnSuspStatCd", "string")).alias("suspension"), sc.to_int(get("$.csBaseInfo.clmAmt", "string")).alias("claim"),
        F.array_join(F.filter(listed("$.gdsDspslObjctLst", "bldDtlDts"), lambda x: x.isNotNull()), " ").alias("built"), F.col("_v").isNotNull().alias("has_detail"),
    )
    return known.select("*", F.inline(F.array(found))).drop("_v")
