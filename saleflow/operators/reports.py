"""Markdown documents and operations summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleflow.functions import scalars as sc

NONE = "—"
#: Marks of the badges' levels, and notes under sections.
ICONS = {"danger": "🔴", "warn": "🟠", "info": "🔵"}
CHECK_NOTE = "- ※ 자동 추출 — 정확한 권리분석은 매각물건명세서·등기부등본 직접 확인"
SCORE_NOTE = "- ※ 법적 위험 기반 점수 (가격 매력도 제외) — 입찰 판단은 권리분석 직접 확인 필수"
ESTIMATE_NOTE = "- ※ 통계 모델의 추정치이며 실제 낙찰가와 다를 수 있음. 입찰 판단 책임은 이용자에게 있음"
NOTES = "aeeWevlMnpntLst"
LISTS = {"gdsRletStLtnoLstAll": "임차인현황", "rgltLandLstAll": "등기부 / 토지 권리", "gdsDspslObjctLst": "매각대상물"}
#: Headings of appraisal items by their code, names of the fields of a detail's lists, names of the flags.
APPRAISALS = {
    "00083001": "위치 / 인근 환경", "00083002": "교통", "00083003": "교통", "00083004": "주위 환경", "00083005": "도로 인접", "00083006": "이용 상태", "00083007": "공법상 규제", "00083008": "이용 상태",
    "00083009": "토지 형상·지세", "00083010": "토지 명세", "00083011": "도시계획 / 용도지역", "00083012": "토지 이용 계획", "00083013": "건물 명세", "00083014": "건물 명세", "00083015": "건물 구조",
    "00083016": "건물 설비", "00083017": "부대 설비", "00083018": "위반 건축물", "00083019": "기타", "00083020": "임대 관계", "00083021": "임대 관계", "00083022": "임대 관계", "00083023": "기타 참고사항",
    "00083024": "기타 참고사항", "00083025": "임대 관계", "00083026": "임대 관계", "00083027": "감정평가 의견",
}
FIELDS = {
    "rletStLtnoAddr": "소재지", "rdnmRefcAddr": "도로명주소", "auctnLstDvsCd": "구분", "mclDspslGdsLstUsgCd": "용도", "rgltLandLtnoAddr": "소재지", "landArDts": "면적", "auctnRgltKndCd": "권리종류",
    "rgltDvsDts": "구분", "pjbBuldList": "건물내역", "objctArDts": "면적", "bldNm": "건물명", "ldcgDts": "지목",
}
FLAGS = {
    "senior_tenant": "선순위 임차인(대항력)", "yuchi": "유치권", "legal_ground": "법정지상권", "stopped": "정지/연기/취하", "share_sale": "지분 매각", "maeng_ji": "맹지", "illegal_bld": "위반건축물",
    "share_maeng": "지분+맹지 조합", "rent_unknown": "점유관계 미상", "reserve_forest": "보전산지", "pollak": "포락지", "private_road": "사도", "claim_90": "청구액 감정가 90%+", "power_line": "송전선/구분지상권",
    "special_20": "특별매각 보증금 20%", "many_fails": "유찰 5회+", "pamyo": "분묘/파묘", "forest_only": "임야 단독", "agri_zone": "농림지역", "nat_protect": "자연보전권역", "show_only": "제시외 물건",
    "forestry_land": "임업용 산지", "farm_land": "농지", "tiny_area": "초소형(30㎡ 이하)", "new_villa": "신축 빌라",
}
JP_STATUS = {"period_bid": "期間入札", "special_sale": "特別売却", "reval_pending": "評価再調整", "re_bid": "再入札", "closed": "終結", "aborted": "中止"}
JP_KINDS = {"ケ": "(担保不動産競売)", "ヌ": "(強制競売)"}


def _text(*parts: Column | str) -> Column:
    """The parts put together; null where one is."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _or(c: Column, other: str = NONE) -> Column:
    return F.coalesce(c.cast("string"), F.lit(other))


def _lines(*lines: Column | str) -> Column:
    """Texts and arrays of texts, a line each; nulls are left out, and of nothing comes an empty text."""
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines))


def _section(title: str, lines: Column, note: str | None = None) -> tuple[str, Column, str | None]:
    """Title, lines, note and an empty line; nothing where there are no lines."""
    return title, lines, note


def _document(rows: DataFrame, name: str, filename: Column, parts: list) -> DataFrame:
    """Name, filename and markdown: the parts (texts and sections), one below the other; null ones are left out.

    Their texts are columns of a select of their own, so that a section that asks whether it has lines doesn't make them twice.
    """
    texts = [p if isinstance(p, Column) else p[1] for p in parts]
    made = rows.select(name, filename.alias("filename"), *(x.alias(f"_part{i}") for i, x in enumerate(texts)))

    def told(part, x: Column) -> Column:
        if isinstance(part, Column):
            return x
        title, _, note = part
        return F.when(x != "", _lines(title, x, *([note] if note else []), ""))

    return made.select(name, "filename", _lines(*(told(p, F.col(f"_part{i}")) for i, p in enumerate(parts))).alias("markdown"))


def _split(text: Column, before: str) -> Column:
    """Lines of a text that aren't blank, with a mark before each."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.transform(rows, lambda x: F.concat(F.lit(before), x)), F.array().cast("array<string>"))


def _named(code: Column, names: dict[str, str]) -> Column:
    """A code's name, or null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), code)


def _footer(site: str, source: str) -> list[Column]:
    """The last lines, where the site that publishes and the official source are known."""
    host = site.split("://")[-1].strip("/")
    return [_lines("---", f"Exported from {host} · 데이터는 {source}를 우선 확인하세요")] if site and source else []


def _getter(df: DataFrame):
    """A column by name, null where the table hasn't it."""
    return lambda name, kind="string": F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _share(part: Column, whole: Column) -> Column:
    """` (감정가의 N%)`, or an empty text."""
    return F.coalesce(F.when((part != 0) & (whole != 0), _text(" (감정가의 ", sc.js_round(part / whole * 100), "%)")), F.lit(""))


def _listed(entries: Column) -> Column:
    """Numbered lines of the plain values of each entry of a JSON list."""
    rows = F.from_json(entries, "array<map<string,string>>")
    plain = F.transform(rows, lambda m: F.map_filter(m, lambda k, v: v.isNotNull() & (v != "") & ~v.rlike(r"^[\[{]")))
    some = F.filter(plain, lambda m: F.size(m) > 0)
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(F.lit("**"), F.coalesce(_named(e["key"], FIELDS), e["key"]), F.lit("**: "), e["value"])), " · ")
    return F.coalesce(F.transform(some, lambda m, i: F.concat((i + 1).cast("string"), F.lit(". "), told(m))), F.array().cast("array<string>"))


def kr_report(props: DataFrame, rounds: DataFrame, photos: DataFrame | None = None, as_of: str | None = None, site: str = "", source: str = "") -> DataFrame:
    """docid, filename, markdown: one document per listing, sections in a fixed order, empty ones left out.

    `site` is the address that documents link to, `source` the name of the official site.

    `props` may have: case_no, item_no, case_name, court_name, dept_name, received, usage_label, region, addresses, prices, dates,
    sold columns, remark, lien, progress, suspension, reason, deposit_rate, special_remark, claim, lng, lat, score (the
    struct of `safety_score`), estimate (struct est, low, high, rate_pct, method, samples), summaries and the detail JSON;
    what it lacks is left out. A listing's own rounds and photos are gathered, some dozens.
    """
    g = _getter(props)
    ap, mn = g("appraisal_amount", "bigint"), g("min_sale_price", "bigint")
    line = _text("| ", F.col("seq"), " | ", sc.fmt_date(F.col("round_date")), " ", F.coalesce(F.col("hour"), F.lit("")) if "hour" in rounds.columns else "", " | ",
                 _or(F.col("place")) if "place" in rounds.columns else NONE, " | ", sc.money(F.col("round_price")), " | ", _or(F.col("result_cd")), " |")
    table = rounds.select("docid", F.struct("seq", line.alias("line")).alias("r")).groupBy("docid").agg(F.array_sort(F.collect_list("r")).alias("_rounds"))
    rows = props.join(table, "docid", "left")
    if photos is not None:
        urls = photos.where("storage_path is not null").groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("seq", "storage_path"))).alias("_photos"))
        rows = rows.join(urls, "docid", "left")
    item = F.coalesce(F.when(g("item_no", "bigint") > 1, _text(" #", g("item_no", "bigint"))), F.lit(""))
    case, court = g("case_no"), F.concat_ws(" · ", g("court_name"), sc.truthy(g("dept_name")))
    page = _text(f"{site}/p/", g("docid"))
    head = _lines(_text("# 🇰🇷 ", F.coalesce(case, g("docid"), F.lit("매물 상세")), item), "", _text("> Generated from ", page), "")
    meta = _lines(
        _text("- **사건번호**: `", _or(case), "`", item), _text("- **사건명**: ", _or(g("case_name"))), _text("- **법원·경매계**: ", _or(sc.truthy(court))),
        _text("- **접수일**: ", sc.fmt_date(g("received", "date"))), _text("- **용도**: ", _or(F.coalesce(g("usage_label"), g("usage_nm")))),
    )
    once = {"_lien": sc.primary_lien(g("primary_liens"))}  # what the document names more than once
    won = F.coalesce(g("sold", "boolean"), F.lit(False))
    amount = g("sold_amount", "bigint")
    sold = F.when(won, _lines(_text("- **낙찰가**: ", sc.money(amount), _share(amount, ap)), _text("- **낙찰일**: ", F.date_format(g("sold_date", "date"), "yyyy.MM.dd"))))
    status, reason = sc.case_status(g("progress"), g("suspension")), sc.suspension_reason(g("suspension"), g("reason"))
    rate, lien = sc.deposit_rate(g("deposit_rate")), F.col("_lien")
    days = sc.d_day(g("sale_date", "date"), as_of) if as_of else F.lit(None).cast("int")
    icons = F.create_map(*(F.lit(x) for kv in ICONS.items() for x in kv))
    once["_badges"] = F.transform(sc.remark_badges(g("remark")), lambda b: F.concat(F.try_element_at(icons, b["level"]), F.lit(" "), b["label"]))
    later = F.size(lien["others"])
    special = g("special_remark")
    special = F.when(~F.trim(special).isin("", "-"), special)
    key = _lines(
        _text("- **매각기일까지**: ", sc.d_day_label(days), " (", sc.fmt_date(g("sale_date", "date")), ")"),
        _text("- **진행 상태**: ", status, F.coalesce(_text(" · ", reason), F.lit(""))),
        _text("- **매수신청 보증금**: ", F.regexp_replace(rate.cast("string"), r"\.0$", ""), "%", F.when(rate != 10, " (특별매각조건)").otherwise("")),
        F.when(F.size("_badges") > 0, _text("- **물건 비고 배지**: ", F.array_join("_badges", " · "))),
        _text("- **말소기준권리 (후보)**: ", lien["date"], " ", lien["kind"], F.when(later > 0, _text(" (후순위 ", later, "건)")).otherwise("")),
        F.transform(F.slice(lien["others"], 1, 5), lambda o: F.concat(F.lit("  - 후순위: "), o)),
        F.when(special.isNotNull(), "- **물건 특정 비고**:"), F.when(special.isNotNull(), _split(special, "  > ")),
    )
    lng, lat = g("lng", "double"), g("lat", "double")
    place = _lines(
        "## 주소", _text("- **도로명**: ", g("road_addr")), _text("- **지번**: ", g("lot_addr")), _text("- **행정 구역**: ", sc.truthy(g("region"))),
        _text("- **표시 주소**: ", g("conv_addr")), _text("- **좌표**: `", lat, ", ", lng, "`"),
        _text("  - [Naver 지도](https://map.naver.com/v5/?c=", lng, ",", lat, ",18,0,0,0,dh)"), _text("  - [Google 지도](https://www.google.com/maps?q=", lat, ",", lng, "&z=18)"), "",
    )
    claim = g("claim", "bigint")
    price = _lines(
        "| 항목 | 값 |", "|---|---:|", _text("| 감정가 | ", sc.money(ap), " |"), _text("| 최저매각가 | ", sc.money(mn), _share(mn, ap), " |"),
        _text("| 매각가율 | ", sc.percent(mn, ap), " |"), _text("| 할인율 | ", sc.discount(mn, ap), " |"),
        _text("| 유찰횟수 | ", _or(_text(g("fail_count", "int"), "회")), " |"), F.when(claim > 0, _text("| 청구금액 | ", sc.money(claim), _share(claim, ap), " |")),
        _text("| 매각기일 | ", sc.fmt_date(g("sale_date", "date")), " |"), _text("| 매각결정기일 | ", sc.fmt_date(g("sale_decision_date", "date")), " |"),
    )
    parts = [head, _section("## 메타", meta), _section("## 낙찰 완료", sold), _section("## 입찰 전 핵심 정보", key, CHECK_NOTE), place, _section("## 가격", price)]
    if "score" in props.columns:
        s = F.col("score")
        doubt = F.when(s["confidence"] == "low", " (⚠ 상세정보 미확보, 잠정치)").when(s["confidence"] == "medium", " (건물 연식 정보 일부 부족)").otherwise("")
        once["_why"] = F.array_join(F.transform(s["factors"], lambda f: F.concat(F.coalesce(_named(f["flag"], FLAGS), f["flag"]), F.lit(" (−"), f["penalty"].cast("string"), F.lit("점)"))), " · ")
        lines = _lines(_text("- **점수**: ", s["score"], "/100 — ", sc.score_grade(s["score"]), doubt), _text("- **감점 요인**: ", sc.truthy(F.col("_why"))))
        parts.append(_section("## 매수 안전도 (참고)", lines, SCORE_NOTE))
    if "estimate" in props.columns:
        e = F.col("estimate")
        known = "model_version" in props.schema["estimate"].dataType.fieldNames()
        version = F.coalesce(_text(" (", e["model_version"], ")"), F.lit("")) if known else F.lit("")
        how = F.when(e["method"] == "model", _text("자체 낙찰 데이터 예측 모델", version, " · 학습 표본 ", F.coalesce(e["samples"], F.lit(0)), "건")).otherwise("지역 평균 매각가율 추정 (모델 표본 부족 — 참고용)")
        lines = _lines(
            _text("- **예상가**: ", sc.money(e["est"]), F.coalesce(_text(" (감정가의 ", e["rate_pct"], "%)"), F.lit(""))),
            F.when(e["low"].isNotNull() & e["high"].isNotNull(), _text("- **범위**: ", sc.money(e["low"]), " ~ ", sc.money(e["high"]))), _text("- **방법**: ", how),
        )
        parts.append(_section("## 낙찰 예상가 (베타)", F.when(~won & e["est"].isNotNull(), lines), ESTIMATE_NOTE))
    built = _lines(_text("- **건물 요약**: ", g("building_summary")), _text("- **면적 요약**: ", g("area_summary")))
    turns = F.when(F.size("_rounds") > 0, _lines("| 회차 | 기일 | 장소 | 최저가 | 결과 |", "|---:|---|---|---:|---|", F.transform("_rounds", lambda r: r["line"])))
    parts += [_section("## 건물·면적", built), _section("## 매각기일 이력", turns)]
    if "detail" in props.columns:
        listed = [NOTES, *LISTS]
        rows = rows.select("*", F.json_tuple("detail", *listed).alias(*(f"_{k}" for k in listed)))  # read once for all lists
        once["_notes"] = F.from_json(f"_{NOTES}", "array<struct<aeeWevlMnpntItmCd:string,aeeWevlMnpntCtt:string>>")
        real = F.filter(F.transform("_notes", lambda n, i: F.struct(n.alias("n"), (i + 1).alias("i"))), lambda x: ~F.trim(x["n"]["aeeWevlMnpntCtt"]).isin("", "-", "-."))
        code = lambda x: sc.truthy(x["n"]["aeeWevlMnpntItmCd"])
        title = lambda x: F.coalesce(_named(code(x), APPRAISALS), _text("항목 ", F.coalesce(code(x), x["i"].cast("string"))))
        told = lambda x: _lines(_text("### ", title(x)), _split(x["n"]["aeeWevlMnpntCtt"], "> "), "")
        parts.append(F.when(F.size("_notes") > 0, _lines("## 감정평가 요항", F.transform(real, told))))
        parts += [_section(f"## {title}", _lines(_listed(F.col(f"_{k}")))) for k, title in LISTS.items()]
    if photos is not None:
        parts.append(_section("## 사진", _lines(F.transform("_photos", lambda p: F.concat(F.lit("- "), p["storage_path"])))))
    from_ = f"- **법원경매정보 ({source})**: 사건번호 `" if source else "- **법원경매정보**: 사건번호 `"
    origin = _lines(_text(from_, case, "`, 법원 `", g("court_code"), "`"), _text("- **본 사이트 상세**: ", page))
    parts += [_section("## 원본", origin), *_footer(site, source and f"공식 사이트({source})")]
    return _document(rows.withColumns(once), "docid", F.concat(F.coalesce(case, g("docid")), F.lit(".md")), parts)


def _yen(c: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(c, 0), F.lit("円")), F.lit(NONE))


def jp_report(rows: DataFrame, photos: DataFrame | None = None, site: str = "", source: str = "") -> DataFrame:
    """sale_unit_id, filename, markdown of Japanese listings: head, facts, three prices, dates, place, items, photos.

    `rows` may have: case_no, court_name, court_code, case_kind, sale_cls_label, status, yen_10k_trap, has_three_set_pdf, the prices,
    dates as texts, address_text, lat, lng, transit_info and items (array of struct head, fields); what it lacks is left out.
    """
    g, unit = _getter(rows), F.col("sale_unit_id")
    page = _text(f"{site}/jp/p/", unit)
    if photos is not None:
        urls = photos.groupBy("sale_unit_id").agg(F.array_sort(F.collect_list(F.struct("seq", "photo_url"))).alias("_photos"))
        rows = rows.join(urls, "sale_unit_id", "left")
    title = F.when(g("case_no").isNotNull(), F.trim(_text(F.coalesce(g("court_name"), F.lit("")), " ", g("case_no")))).otherwise(_text("BIT ", unit))
    head = _lines(_text("# 🇯🇵 ", title), "", _text("> Generated from ", page), "")
    state = F.try_element_at(F.create_map(*(F.lit(x) for kv in JP_STATUS.items() for x in kv)), g("status"))
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in JP_KINDS.items() for x in kv)), g("case_kind")), F.lit(""))
    meta = _lines(
        _text("- **사건번호**: `", F.coalesce(g("case_no"), unit), "`"), _text("- **법원**: ", _or(g("court_name")), F.coalesce(_text(" (courtId=", g("court_code"), ")"), F.lit(""))),
        _text("- **사건 종류**: ", g("case_kind"), " ", kind), _text("- **종별**: ", _or(g("sale_cls_label"))), _text("- **상태**: ", F.coalesce(state, g("status"))),
        F.when(g("yen_10k_trap", "boolean"), "- ⚠ **1万円 함정 의심** (売却基準価額 ≤ 100,000円)"),
        F.when(g("has_three_set_pdf", "boolean"), _text(f"- 📑 **三点セット PDF 제공** — `{site}/api/jp/pdf/", unit, "`")), _text("- **BIT saleUnitId**: `", unit, "`"),
    )
    price = _lines(
        "| 항목 | 금액 | 비고 |", "|---|---:|---|", _text("| 売却基準価額 | ", _yen(g("standard_price", "bigint")), " | 법원이 정한 기준가 |"),
        _text("| 買受可能価額 | ", _yen(g("purchase_price", "bigint")), " | 매수 가능 최저가 (= 기준 × 80%) |"), _text("| 買受申出保証金 | ", _yen(g("deposit", "bigint")), " | 입찰 보증금 (= 기준 × 20%) |"),
        "| 鑑定評価額 | (미수집) | 상세 페이지 추가 정찰 필요 |",
    )
    between = lambda a, b: F.when(g(a).isNull() & g(b).isNull(), NONE).otherwise(_text(_or(g(a), "?"), " ~ ", _or(g(b), "?")))
    dates = _lines(
        _text("- **公示開始日**: ", _or(g("koji_start"))), _text("- **閲覧開始日**: ", _or(g("view_start"))), _text("- **入札期間**: ", between("bid_start", "bid_end")),
        _text("- **開札期日**: ", _or(g("open_date"))), _text("- **売却決定期日**: ", _or(g("decision_date"))), _text("- **特別売却期間**: ", between("special_start", "special_end")),
    )
    lat, lng = g("lat", "double"), g("lng", "double")
    ways = _split(g("transit_info"), "  - ")
    place = _lines(
        _text("- **所在地**: ", g("address_text")), _text("- **좌표**: `", lat, ", ", lng, "` (WGS84)"), _text("  - [Google 지도](https://www.google.com/maps?q=", lat, ",", lng, "&z=18)"),
        _text("  - [OpenStreetMap](https://www.openstreetmap.org/?mlat=", lat, "&mlon=", lng, "&zoom=18)"), F.when(F.size(ways) > 0, "- **교통**:"), ways,
    )
    parts = [head, _section("## 메타", meta), _section("## 3종 가격", price), _section("## 매각 일정", dates), _section("## 위치", place)]
    if "items" in rows.columns:
        told = lambda m: F.transform(F.map_entries(m), lambda e: F.concat(F.lit("| "), e["key"], F.lit(" | "), e["value"], F.lit(" |")))
        some = F.filter("items", lambda x: F.size(x["fields"]) > 0)
        each = F.transform(some, lambda x: _lines(_text("### ", x["head"]), "| 항목 | 값 |", "|---|---|", told(x["fields"]), ""))
        parts.append(F.when(F.size("items") > 0, _lines("## 物件 명세", each)))
    if photos is not None:
        parts.append(_section("## 사진", _lines(F.transform("_photos", lambda p: F.concat(F.lit("- "), p["photo_url"])))))
    where = _text(f"  - 매물 상세는 form POST 기반이라 직접 링크 불가. 본 사이트 상세 페이지 ({site}/jp/p/", unit, ") 사용 권장") if site else _text("  - 상세 페이지: ", page)
    parts += [_section("## 원본", _lines("- **BIT 사이트**: <https://www.bit.courts.go.jp/>", where)), *_footer(site, source and f"{source} 정보")]
    return _document(rows, "sale_unit_id", F.concat(F.coalesce(g("case_no"), unit), F.lit(".md")), parts)


def _day(c: str, zone: str = "Asia/Seoul") -> Column:
    return F.to_date(F.from_utc_timestamp(c, zone))


def run_summary(runs: DataFrame, as_of: str) -> DataFrame:
    """Runs of the day before (Korean time) by kind: runs, done, failed, running, rows, first start, last activity."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    mine = runs.where(_day("started_at") == F.date_sub(F.lit(as_of).cast("date"), 1))
    return mine.groupBy("kind").agg(
        F.count(F.lit(1)).alias("runs"), count("done").alias("ok"), count("failed").alias("failed"), count("running").alias("still_running"),
        F.sum("n_rows").alias("total_rows"), F.min("started_at").alias("first_started"), F.max(F.coalesce("finished_at", "started_at")).alias("last_active"),
    )


def _since(c: str, as_of: str, days: int) -> Column:
    return F.col(c) > F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")


def week_summary(runs: DataFrame, as_of: str) -> DataFrame:
    """Runs of seven days by Korean day and half (kinds that begin with jp_): runs, done, failed."""
    rows = runs.where(_since("started_at", as_of, 7)).groupBy(_day("started_at").alias("run_date"), F.col("kind").startswith("jp_").alias("is_jp"))
    return rows.agg(F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("status") == "done", 1)).alias("ok"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))


def recent_failures(runs: DataFrame, as_of: str, days: int = 3, most: int = 20) -> DataFrame:
    """The newest failed runs with their error, in Korean time."""
    rows = runs.where((F.col("status") == "failed") & _since("started_at", as_of, days)).orderBy(F.col("started_at").desc(), "run_id").limit(most)
    return rows.select("run_id", "kind", F.from_utc_timestamp("started_at", "Asia/Seoul").alias("kst"), "error")


def dead_letter_summary(dead: DataFrame, as_of: str, most: int = 20) -> DataFrame:
    """Unresolved dead letters of seven days by endpoint, most first."""
    rows = dead.where(_since("occurred_at", as_of, 7) & F.col("resolved_at").isNull()).groupBy("endpoint")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("occurred_at").alias("latest")).orderBy(F.col("n").desc(), "endpoint").limit(most)


def jp_freshness(rows: DataFrame) -> DataFrame:
    """Per prefecture: listings, those with detail, last update in Japanese time."""
    told = F.from_utc_timestamp(F.max("updated_at"), "Asia/Tokyo").alias("latest_jst")
    return rows.groupBy("prefecture").agg(F.count(F.lit(1)).alias("n"), F.count("detail").alias("with_detail"), told)


def flag_audit(rows: DataFrame, column: str, path: str) -> DataFrame:
    """Values of one JSON path with counts and their share of the rows that have the JSON; a missing key is null."""
    some = rows.where(F.col(column).isNotNull())
    counts = some.groupBy(F.get_json_object(column, path).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = some.agg(F.count(F.lit(1)).alias("_total")).withColumn("_", F.lit(1))
    return counts.withColumn("_", F.lit(1)).join(total, "_").withColumn("share", F.col("n") / F.col("_total")).drop("_", "_total")  # one row of totals
