"""Parsing and formatting of single values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """The value, or null where it is an empty string."""
    return F.when(c != "", c)


def first_truthy(*columns: Column) -> Column:
    return F.coalesce(*(truthy(c) for c in columns))


def clean_str(c: Column) -> Column:
    return truthy(F.trim(c))


def to_int(c: Column) -> Column:
    """Integer literal with optional commas and outer blanks; anything else is null."""
    bare = F.trim(F.replace(c, F.lit(","), F.lit("")))
    return F.regexp_extract(bare, r"^[+-]?[0-9]+$", 0).try_cast("bigint")  # names its text once, so it is made once


def to_float(c: Column) -> Column:
    bare = F.trim(F.replace(c, F.lit(","), F.lit("")))
    return F.regexp_extract(bare, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$", 0).try_cast("double")


def to_date8(c: Column) -> Column:
    """Exactly YYYYMMDD or YYYY-MM-DD."""
    text = F.trim(c)
    dashed = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return F.regexp_extract(dashed, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", 0).try_cast("date")


def usage_code(c: Column) -> Column:
    text = clean_str(c)
    return F.when(~text.isin("00000", "0"), text)


def clean_addr(c: Column) -> Column:
    """`00005-00000` to `5`, `00020-00001` to `20-1`, runs of blanks to one."""
    text = F.regexp_replace(c, r"(?U)\b0+([0-9]+)", "$1")
    text = F.regexp_replace(text, r"(?U)-0+\b", "")
    return truthy(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def road_addr(base: Column, suffix: Column) -> Column:
    """Cleaned road address, and the building in brackets unless it is there already."""
    road = clean_addr(base)
    sub = F.regexp_replace(clean_str(suffix), r",\s*", ", ")
    return F.when(sub.isNull() | (F.instr(road, sub) > 0), road).otherwise(F.concat(road, F.lit(" "), sub))


def sale_rate_pct(minimum: Column, appraisal: Column) -> Column:
    return F.when((appraisal > 0) & minimum.isNotNull(), F.round(minimum.cast("double") / appraisal.cast("double") * 100, 2))


def max_area(text: Column) -> Column:
    """Largest number before a square-metre sign."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*\.?[0-9]*)\s*㎡"), F.lit(1))
    return F.array_max(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double")))


def max_area_plain(text: Column) -> Column:
    """The flags' form, which knows no thousands separators: of `1,020㎡` it reads 020."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9.]+)\s*㎡"), F.lit(1))
    return F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull()))


#: Usage names and their deal type, first match wins.
DEAL_TYPES = [
    ("공장|창고", "indu"),
    ("근린|상가", "nrg"),
    ("오피스텔", "offi"),
    ("단독|다가구", "sh"),
    ("연립|다세대|빌라", "rh"),
    ("아파트", "apt"),
    ("대지|전답|임야", "land"),
]


def deal_type(usage: Column, large: Column) -> Column:
    out = F.when(large == "10000", "land").when(large.isin("30000", "40000"), F.lit(None).cast("string"))
    for words, kind in DEAL_TYPES:
        out = out.when(usage.rlike(words), kind)
    return out


#: Middle usage codes and their market type.
MARKET_TYPES = {"201": "apt", "202": "rh", "203": "sh", "204": "offi", "205": "nrg", "206": "indu"}


def market_type(large: Column, middle: Column, remark: Column) -> Column:
    out = F.when(large.isin("10000", "30000", "40000"), "land")
    for words, kind in DEAL_TYPES:
        out = out.when(remark.rlike(words), kind)
    for code, kind in MARKET_TYPES.items():
        out = out.when(F.substring(middle, 1, 3) == code, kind)
    return out.otherwise("apt")


def money(v: Column) -> Column:
    """1억 2,345만원, 9,999만원, 500원, or -."""
    eok, rest = F.floor(v / 100_000_000), F.floor(v % 100_000_000 / 10_000)
    return (
        F.when(v.isNull(), "-")
        .when((v >= 100_000_000) & (rest > 0), F.concat(eok.cast("string"), F.lit("억 "), F.format_number(rest, 0), F.lit("만원")))
        .when(v >= 100_000_000, F.concat(eok.cast("string"), F.lit("억원")))
        .when(v >= 10_000, F.concat(F.format_number(F.floor(v / 10_000), 0), F.lit("만원")))
        .otherwise(F.concat(F.format_number(v, 0), F.lit("원")))
    )


def money_short(v: Column) -> Column:
    """1.2억, 12억, 9,999만, 500, or -."""
    eok = v / 100_000_000
    return (
        F.when(v.isNull(), "-")
        .when(eok >= 10, F.concat(F.format_string("%.0f", F.round(eok, 0)), F.lit("억")))
        .when(eok >= 1, F.concat(F.format_string("%.1f", F.round(eok, 1)), F.lit("억")))
        .when(v >= 10_000, F.concat(F.format_number(F.floor(v / 10_000), 0), F.lit("만")))
        .otherwise(F.format_number(v, 0))
    )


def fmt_date(d: Column) -> Column:
    """2026.08.10, or -."""
    return F.coalesce(F.date_format(d, "yyyy.MM.dd"), F.lit("-"))


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def percent(minimum: Column, base: Column) -> Column:
    some = (minimum != 0) & (base != 0)
    return F.when(some, F.concat(js_round(minimum / base * 100).cast("string"), F.lit("%"))).otherwise("-")


def discount(minimum: Column, base: Column) -> Column:
    off = (1 - minimum / base) * 100
    some = (minimum != 0) & (base != 0) & (off > 0)
    return F.when(some, F.concat(F.lit("▼"), js_round(off).cast("string"), F.lit("%"))).otherwise("-")


def d_day(sale_date: Column, as_of: str) -> Column:
    return F.datediff(sale_date, F.lit(as_of).cast("date"))


def d_day_label(days: Column) -> Column:
    return (
        F.when(days == 0, "D-day")
        .when(days > 0, F.concat(F.lit("D-"), days.cast("string")))
        .when(days < 0, F.concat(F.lit("D+"), (-days).cast("string")))
    )


def suspension_reason(suspension: Column, reason: Column) -> Column:
    """The reason, where a suspension code is set."""
    return F.when(suspension.isNotNull() & (suspension != "00") & (suspension != ""), clean_str(reason))


#: Labels of the suspended state, of the progress code's end, and of any other code.
SUSPENDED, UNKNOWN_STATUS = "정지/연기/취하", "상태 미상"
PROGRESS = {"0001": "진행 중", "0002": "변경", "0003": "정지", "0004": "취하"}


def case_status(progress: Column, suspension: Column) -> Column:
    """A suspension wins over the progress code's end; an unknown code isn't taken for a safe one."""
    code, stop = F.trim(progress), F.trim(suspension)
    out = F.when(stop.isNotNull() & ~stop.isin("", "00"), SUSPENDED)
    for end, label in PROGRESS.items():
        out = out.when(code.endswith(end), label)
    return out.when(code != "", UNKNOWN_STATUS)


def deposit_rate(c: Column) -> Column:
    rate = to_float(c)
    return F.when(rate > 0, rate)


def special_deposit(c: Column) -> Column:
    """Whether a deposit rate is another than the usual 10 percent."""
    return deposit_rate(c) != 10


def primary_lien(text: Column) -> Column:
    """First of `n. yyyy.mm.dd kind / ...` as (date, kind, others), or null."""
    items = F.transform(F.split(text, "/"), lambda x: F.trim(x))
    first = F.get(items, 0)
    parts = r"^[0-9]+\.\s*([0-9]{4})\.([0-9]{1,2})\.([0-9]{1,2})\.?\s*(\S.*)$"
    date = F.concat_ws("-", *(F.lpad(F.regexp_extract(first, parts, i), 4 if i == 1 else 2, "0") for i in (1, 2, 3)))
    found = F.struct(
        date.try_cast("date").alias("date"), F.regexp_extract(first, parts, 4).alias("kind"),
        F.filter(F.slice(items, 2, 1000), lambda x: x != "").alias("others"),
    )
    return F.when(first.rlike(parts), found)


#: Patterns of remarks, level and label, in order.
BADGES = [
    ("유치권", "danger", "유치권"),
    ("법정지상권", "danger", "법정지상권"),
    ("분묘기지권", "danger", "분묘기지권"),
    (r"대지권\s*미등기|대지권없음", "danger", "대지권 미등기"),
    ("토지별도등기", "danger", "토지별도등기"),
    ("위반건축물", "danger", "위반건축물"),
    (r"제시외\s*건물", "warn", "제시외 건물 포함"),
    ("일괄매각", "info", "일괄매각"),
    ("개별매각", "info", "개별매각"),
    ("공실", "info", "공실"),
    (r"점유자\s*없음", "info", "점유자 없음"),
]


def remark_badges(text: Column) -> Column:
    found = [F.when(text.rlike(p), F.struct(F.lit(level).alias("level"), F.lit(label).alias("label"))) for p, level, label in BADGES]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def score_grade(score: Column) -> Column:
    return F.when(score >= 80, "안전").when(score >= 65, "양호").when(score >= 45, "주의").when(score.isNotNull(), "위험")


def sold_days_left(deleted_at: Column, as_of: Column) -> Column:
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(deleted_at)) / 86400)
    return F.greatest(F.lit(0), 30 - days)


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6_371_000 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


PYEONG = 3.305785


def area_to_pyeong(text: Column) -> Column:
    """Every `N㎡` as `M평` with two decimals."""
    number = r"([0-9][0-9,]*\.?[0-9]*)\s*㎡"
    found = F.transform(
        F.regexp_extract_all(text, F.lit(number), F.lit(1)),
        lambda x: F.concat(F.format_number(F.regexp_replace(x, ",", "").try_cast("double") / PYEONG, 2), F.lit("평")),
    )
    return F.array_join(F.flatten(F.transform(F.arrays_zip(F.split(text, number).alias("a"), found.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit(""))))), "")


# --- the Japanese half
def jp_date(text: Column) -> Column:
    parts = r"(令和|平成)\s*([0-9]+|元)年\s*([0-9]+)月\s*([0-9]+)日"
    year = F.when(F.regexp_extract(text, parts, 2) == "元", F.lit(1)).otherwise(F.regexp_extract(text, parts, 2).try_cast("int"))
    year = year + F.when(F.regexp_extract(text, parts, 1) == "令和", F.lit(2018)).otherwise(F.lit(1988))
    made = F.concat_ws("-", year.cast("string"), *(F.lpad(F.regexp_extract(text, parts, i), 2, "0") for i in (3, 4)))
    return F.when(text.rlike(parts), made.try_cast("date"))


def jp_price(text: Column) -> Column:
    parts = r"([0-9,]+)(?:(万)([0-9,]*))?\s*円"
    bare = lambda i: F.regexp_replace(F.regexp_extract(text, parts, i), ",", "").try_cast("bigint")
    man = F.regexp_extract(text, parts, 2) == "万"
    return F.when(text.rlike(parts), F.when(man, bare(1) * 10_000 + F.coalesce(bare(3), F.lit(0))).otherwise(bare(1)))


def jp_case_no(text: Column) -> Column:
    parts = "(令和|平成)\\s*([0-9]+|元)年\\s*[(\uff08]([^)\uff09]+)[)\uff09]\\s*第\\s*([0-9]+)\\s*号"
    piece = lambda i: F.regexp_extract(text, parts, i)
    year = F.when(piece(2) == "元", F.lit(1)).otherwise(piece(2).try_cast("int"))
    found = F.struct(piece(1).alias("era"), year.alias("year"), piece(3).alias("mark"), piece(4).try_cast("int").alias("number"))
    return F.when(text.rlike(parts), found)


#: Full-width digits, hyphens and blank, and their half-width forms.
WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "\uff0d\u2212\u3000"
NARROW = "0123456789-- "


def jp_normalize_addr(text: Column) -> Column:
    return truthy(F.trim(F.translate(text, WIDE, NARROW)))


def jp_status(label: Column) -> Column:
    return (
        F.when(label.contains("期間入札"), "period_bid")
        .when(label.contains("特別売却"), "special_sale")
        .when(label.contains("売却中止") | label.contains("停止"), "aborted")
    )


#: Block of each prefecture code (91 to 94 are the branches of the northern island).
PREFECTURE_BLOCKS = [
    ("01", ["91", "92", "93", "94"]),
    ("02", ["02", "03", "04", "05", "06", "07"]),
    ("03", ["08", "09", "10", "11", "12", "13", "14"]),
    ("04", ["15", "16", "17", "18", "19", "20"]),
    ("05", ["21", "22", "23", "24"]),
    ("06", ["25", "26", "27", "28", "29", "30"]),
    ("07", ["31", "32", "33", "34", "35"]),
    ("08", ["36", "37", "38", "39"]),
    ("09", ["40", "41", "42", "43", "44", "45", "46", "47"]),
]


#: A photo's address: prefix, era letter, year, case mark, number, sequence, size.
PHOTO = r"/data/image/([A-Z]+)_([RH])([0-9]{2})([KN])([0-9]+)_([0-9]+)_([a-z])\.jpg"


def jp_photo_url(url: Column) -> Column:
    """Struct prefix, era, year, mark, number, seq, size of a photo's address, or null."""
    part = lambda i: F.regexp_extract(url, PHOTO, i)
    number = lambda i: part(i).try_cast("int")
    found = F.struct(
        part(1).alias("prefix"), part(2).alias("era"), number(3).alias("year"), part(4).alias("mark"), number(5).alias("number"), number(6).alias("seq"), part(7).alias("size")
    )
    return F.when(url.rlike(PHOTO), found)


def jp_block(prefecture: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for block, codes in PREFECTURE_BLOCKS:
        out = out.when(prefecture.isin(*codes), block)
    return out
