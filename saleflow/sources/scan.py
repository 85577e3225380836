"""Raw scan pages, details and masters to typed rows; versioned snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from saleflow.functions import katec
from saleflow.functions import scalars as sc
from saleflow.operators.windows import dedupe_last
from saleflow.shared import once

from . import commits

RESULTS = "dlt_srchResult"


def split_envelopes(raw: DataFrame, column: str = "value", expect: tuple[str, ...] = (RESULTS,), http_status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good with `rows`, dead letters with a note): not JSON, an HTTP status from 400 on (column `http_status`), a status
    other than 200, or an expected key of the data missing is dead. `rows` is the first expected list."""
    rows = F.from_json(F.get_json_object(column, f"$.data.{expect[0]}"), "array<map<string,string>>")
    status = F.get_json_object(column, "$.status")
    note = F.when(F.get_json_object(column, "$").isNull(), "not json")
    if http_status:
        note = F.when(F.col(http_status) >= 400, F.concat(F.lit("http "), F.col(http_status).cast("string"))).when(F.get_json_object(column, "$").isNull(), "not json")
    note = note.when(F.coalesce(status, F.lit("200")) != "200", F.concat(F.lit("status "), status))
    for key in expect:
        note = note.when(F.get_json_object(column, f"$.data.{key}").isNull(), f"no {key}")
    told = raw.withColumn("note", note)
    return told.where("note is null").withColumn("rows", rows).drop("note"), told.where("note is not null")


def read_scan(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """One row per listing of the pages at `path`: page file, place on the page, `row` (map of strings).

    A file is a page, or with `whole=False` a bundle with a page in each line.
    """
    pages = spark.read.text(path, wholetext=whole).select("value", F.input_file_name().alias("page"))
    good, _ = split_envelopes(pages)
    return good.select("page", F.posexplode("rows").alias("place", "row"))


def stream_scan(spark: SparkSession, path: str, files: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(listings as of `read_scan`, dead letters) of bundles that arrive at `path`; the file source keeps the offsets."""
    pages = spark.readStream.option("maxFilesPerTrigger", files).text(path).select("value", F.input_file_name().alias("page"))
    good, dead = split_envelopes(pages)
    return good.select("page", F.posexplode("rows").alias("place", "row")), dead


def _key(row: Column, *names: str) -> Column:
    return sc.clean_str(F.coalesce(*(sc.truthy(F.try_element_at(row, F.lit(n))) for n in names)))


def to_cases(scan: DataFrame, order: list[str], row: str = "row") -> DataFrame:
    r = F.col(row)
    cases = scan.select(
        _key(r, "boCd", "cortOfcCd").alias("court_code"), _key(r, "srnSaNo").alias("case_no"), _key(r, "saNo").alias("sa_no"),
        _key(r, "saMyung", "csNm").alias("case_name"), _key(r, "jdbnCd").alias("dept_code"), _key(r, "jpDeptNm", "jdbnNm").alias("dept_name"),
        _key(r, "tel").alias("tel"), *order,
    )
    return dedupe_last(cases.where("court_code is not null and case_no is not null"), ["court_code", "case_no"], order).drop(*order)


#: Text columns of a listing and the keys they come from, the first that is set counts.
LISTING_KEYS = {
    "court_code": "boCd cortOfcCd", "case_no": "srnSaNo", "item": "maemulSer", "docid": "docid", "appraisal": "gamevalAmt", "minimum": "minmaePrice",
    "current": "currentMaemaePrice maemaePrice", "fails": "yuchalCnt", "sale": "maeGiil", "decision": "maegyuljGiil", "status_cd": "maemulStatCd statCd",
    "lcl": "lclsUtilCd", "mcl": "mclsUtilCd", "scl": "sclsUtilCd", "usage_nm": "dspslUsgNm", "sd_code": "daepyoSidoCd", "sgg_code": "daepyoSiguCd daepyoSggCd",
    "emd_code": "daepyoDongCd daepyoEmdCd", "rd_code": "daepyoRdCd", "lot_no": "daepyoLotno", "conv_addr": "convAddr daepyoAddr", "road": "bgPlaceRdAllAddr rdAllAddr",
    "road_sub": "rdAddrSub", "lot": "bgPlaceLotAllAddr lotAllAddr", "building_summary": "buldList", "area_summary": "areaList", "mokmul": "mokmulSer",
    "x": "xCordi", "y": "yCordi", "wgs_x": "wgs84Xcordi", "wgs_y": "wgs84Ycordi",
}

#: Whole numbers of a listing: text column and name.
LISTING_NUMBERS = {"appraisal": "appraisal_amount", "minimum": "min_sale_price", "current": "current_sale_price", "fails": "fail_count", "mokmul": "mokmul_ser"}


def to_properties(scan: DataFrame, order: list[str], row: str = "row", coordinates: bool = True) -> DataFrame:
    """Typed listings with coordinates and the raw row, last wins on (court_code, case_no, item_no).

    `row` is a map of strings or, better, the JSON text itself: it is parsed once, into a struct of the keys that are
    needed. Parsed rows pass a generator, which keeps later expressions from being pushed into the parsing.
    """
    names = dict.fromkeys(k for keys in LISTING_KEYS.values() for k in keys.split())
    told = isinstance(scan.schema[row].dataType, StringType)
    parsed = F.from_json(row, ", ".join(f"{k} string" for k in names)) if told else F.col(row)
    scan = scan.select(F.inline(F.array(F.struct(parsed.alias("_row"), (F.col(row) if told else F.to_json(row)).alias("search_row")))), *order)
    r = F.col("_row")
    key = (lambda r, *keys: sc.clean_str(F.coalesce(*(sc.truthy(r[k]) for k in keys)))) if told else _key
    texts = F.struct(*(key(r, *keys.split()).alias(name) for name, keys in LISTING_KEYS.items()))
    raw = scan.select(F.inline(F.array(texts)), "search_row", *order).where("court_code is not null and case_no is not null")
    c, item = F.col, sc.to_int(F.col("item"))
    keys = ["court_code", "case_no", "item_no"]
    raw = dedupe_last(raw.withColumn("item_no", F.when(item != 0, item).otherwise(1)), keys, order)
    same = ["docid", "status_cd", "usage_nm", "sd_code", "sgg_code", "emd_code", "rd_code", "lot_no", "conv_addr", "building_summary", "area_summary"]
    typed = raw.select(
        *keys, *same, *(sc.to_int(c(a)).alias(b) for a, b in LISTING_NUMBERS.items()), sc.to_date8(c("sale")).alias("sale_date"), sc.to_date8(c("decision")).alias("sale_decision_date"),
        *(sc.usage_code(c(x)).alias(f"usage_{x}_cd") for x in ("lcl", "mcl", "scl")), sc.road_addr(c("road"), c("road_sub")).alias("road_addr"), sc.clean_addr(c("lot")).alias("lot_addr"), "search_row",
        *(sc.to_float(c(x)).alias(x) for x in ("x", "y", "wgs_x", "wgs_y")),
    )
    rate = sc.sale_rate_pct(c("min_sale_price"), c("appraisal_amount")).alias("sale_rate_pct")
    place = katec.lnglat(c("x"), c("y"), c("wgs_x"), c("wgs_y")) if coordinates else F.lit(None).cast("struct<lng:double,lat:double>")
    placed = typed.select("*", rate, place.alias("p")).drop("x", "y", "wgs_x", "wgs_y")
    return placed.select("*", "p.lng", "p.lat").drop("p")


ROUNDS = "array<map<string,string>>"


def to_sale_rounds(details: DataFrame, key: str = "docid", column: str = "detail") -> DataFrame:
    """One row per sale round of a detail JSON; seq is the given one or the place from 1."""
    rows = F.from_json(F.get_json_object(column, "$.gdsDspslDxdyLst"), ROUNDS)
    out = details.select(key, F.posexplode(rows).alias("place", "r"))
    r = F.col("r")
    seq = sc.to_int(_key(r, "seq"))
    return out.select(
        key, F.when(seq != 0, seq).otherwise(F.col("place") + 1).alias("seq"), sc.to_date8(_key(r, "dxdyYmd")).alias("round_date"),
        sc.to_int(_key(r, "tsLwsDspslPrc")).alias("round_price"), _key(r, "auctnDxdyRsltCd").alias("result_cd"),
        F.coalesce(_key(r, "auctnDxdyKndCd"), F.lit("01")).alias("kind_cd"), sc.to_int(_key(r, "dspslAmt")).alias("sold_amount"),
    )


def ascii_name(case_no: Column) -> Column:
    """A case number in ASCII letters, digits and -_. alone: `2023타경6292` is `2023-6292`."""
    bare = F.regexp_replace(F.regexp_replace(case_no, r"[^A-Za-z0-9_.-]", "-"), "-{2,}", "-")
    return F.coalesce(sc.truthy(F.regexp_replace(bare, "^-+|-+$", "")), F.lit("x"))


def photo_manifest(details: DataFrame, keys: tuple[str, str, str] = ("court_code", "case_no", "item_no"), column: str = "detail", first: int | None = None, least: int = 100) -> DataFrame:
    """Photos of a detail JSON: seq (given, or the place from 1), kind, description, decoded size, whether it is large
    enough, path court/case/item/seq.ext, and the raw entry without its payload. `first` keeps the first so many."""
    court, case, item = keys
    rows = F.from_json(F.get_json_object(column, "$.csPicLst"), ROUNDS)
    rows = rows if first is None else F.slice(rows, 1, first)
    out = details.select(*keys, F.posexplode(rows).alias("place", "r"))
    r = F.col("r")
    given = sc.to_int(sc.first_truthy(*(sc.truthy(F.try_element_at(r, F.lit(k))) for k in ("cortAuctnPicSeq", "picSeq", "seq"))))
    ending = F.lower(F.regexp_extract(F.try_element_at(r, F.lit("picTitlNm")), r"\.([^.]*)$", 1))
    size = F.octet_length(F.try_to_binary(F.regexp_replace(F.try_element_at(r, F.lit("picFile")), r"^data:[^,]*,", ""), F.lit("base64")))
    out = once(out.select(*keys, "place", "r", given.alias("given"), ending.alias("ending"), size.alias("n")), "given", "ending", "n")
    seq = F.when(F.col("given") != 0, F.col("given")).otherwise(F.col("place") + 1)
    ending, n = F.col("ending"), F.col("n")
    path = [F.col(court), ascii_name(F.col(case)), F.col(item).cast("string")]
    number = F.when(seq < 10, F.concat(F.lit("0"), seq.cast("string"))).otherwise(seq.cast("string"))
    name = F.concat(number, F.lit("."), F.when(ending.rlike("^[a-z0-9]{1,5}$"), ending).otherwise("jpg"))
    return out.select(
        *keys, seq.alias("seq"), _key(r, "cortAuctnPicDvsCd").alias("kind"), _key(r, "picDesc", "picTitlNm").alias("description"), n.alias("n_bytes"),
        F.coalesce(n >= least, F.lit(False)).alias("ok"), F.when(n.isNotNull(), F.concat_ws("/", *path, name)).alias("storage_path"),
        F.to_json(F.map_filter(r, lambda k, v: k != "picFile")).alias("raw"),
    )


#: Tags of usage rows, their level and the key of their parent.
USAGE_TAGS = {"usage_lcl": (1, None), "usage_mcl": (2, "lcl_code"), "usage_scl": (3, "mcl_code")}


def load_masters(lines: DataFrame, order: str, column: str = "value") -> dict[str, DataFrame]:
    """Tagged JSON lines (`type`) to court, sd, sgg, emd and usage tables, last wins on the key; rows without code or name go.

    A court's prefix is the last letter of the given one if that is B or O; courts without one go. Usage rows have their
    tag's level, and as parent the key of the level above.
    """
    rows = lines.select(F.from_json(column, "map<string,string>").alias("r"), order)
    r = F.col("r")
    tag = _key(r, "type")
    prefix = _key(r, "prefix")
    last = F.right(prefix, F.lit(1))
    level, parent = F.lit(None).cast("int"), F.lit(None).cast("string")
    for name, (n, key) in USAGE_TAGS.items():
        level = F.when(tag == name, n).otherwise(level)
        parent = F.when(tag == name, _key(r, key)).otherwise(parent) if key else parent
    more = {
        "court": [F.when(last.isin("B", "O"), last).otherwise(prefix).alias("prefix")], "sd": [], "sgg": [_key(r, "sd_code").alias("sd_code")],
        "emd": [_key(r, "sd_code").alias("sd_code"), _key(r, "sgg_code").alias("sgg_code")], "usage": [level.alias("level"), parent.alias("parent_code")],
    }
    tags = {"court": ["court"], "sd": ["sido", "sd"], "sgg": ["sgg"], "emd": ["emd"], "usage": list(USAGE_TAGS)}
    keys = {"sgg": ["code", "sd_code"], "emd": ["code", "sd_code", "sgg_code"]}
    out = {}
    for name, columns in more.items():
        mine = rows.where(tag.isin(*tags[name])).select(_key(r, "code").alias("code"), _key(r, "name").alias("name"), *columns, order)
        mine = mine.where("prefix is not null") if name == "court" else mine
        out[name] = dedupe_last(mine.where("code is not null and name is not null"), keys.get(name, ["code"]), [order]).drop(order)
    return out


def write_snapshot(df: DataFrame, root: str, version: str, partition_by: list[str] | None = None, from_commit: int | None = None) -> str:
    """Write a new version folder, then a commit that names it: readers see a version once it is whole.

    A job never overwrites what it reads; a version that was written already is written again in a folder of its own.
    With `from_commit` (the number that `commits.latest` gave) a writer that was overtaken gets a Conflict; without it
    the snapshot goes on top of whatever was committed meanwhile.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    name = f"version={version}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}")
    while True:
        number, table = commits.latest(spark, root)
        if from_commit is not None and number != from_commit:
            raise commits.Conflict(f"{root}: read as {from_commit}, now {number}")
        try:
            commits.commit(spark, root, number + 1, {"last": version, "folders": table.get("folders", {}) | {version: name}})
            return f"{root}/{name}"
        except commits.Conflict:
            if from_commit is not None:
                raise


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The version's newest folder, or without a version the one committed last."""
    table = commits.latest(spark, root)[1]
    return spark.read.parquet(f"{root.rstrip('/')}/{table['folders'][version or table['last']]}")
