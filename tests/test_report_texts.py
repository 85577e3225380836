"""Reports take a detail apart once and make each section's lines once."""

from saleflow.functions import scalars as sc
from saleflow.operators import reports


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


DETAIL = '{"aeeWevlMnpntLst":[{"aeeWevlMnpntItmCd":"00083002","aeeWevlMnpntCtt":"a\\n\\n b"},{"aeeWevlMnpntItmCd":null,"aeeWevlMnpntCtt":"-"}],"gdsDspslObjctLst":[{"bldNm":"c","n":3,"x":"","l":[1]},{}],"rgltLandLstAll":[]}'


def test_a_detail_is_read_once_and_lines_are_made_once(spark):
    props = spark.createDataFrame([("D1", DETAIL, "유치권", 20000), ("D2", None, None, None), ("D3", '{"gdsDspslObjctLst":[{"bldNm":"c"}', "공실", 0)], "docid string, detail string, remark string, appraisal_amount bigint")
    rounds = spark.createDataFrame([("D1", 2, None, 5, None), ("D1", 1, None, 10000, "x")], "docid string, seq int, round_date date, round_price bigint, result_cd string")
    photos = spark.createDataFrame([("D1", 2, "b"), ("D1", 1, "a"), ("D1", 3, None)], "docid string, seq int, storage_path string")
    out = reports.kr_report(props, rounds, photos)
    text = plan(out)
    assert text.count("get_json_object") == 0 and text.count("json_tuple") == 1 and text.count("from_json") == 4
    assert text.count("RLIKE(remark") == len(sc.BADGES)  # each badge's pattern is tried once
    got = {r.docid: r.markdown for r in out.collect()}
    assert "## 입찰 전 핵심 정보\n- **물건 비고 배지**: 🔴 유치권\n- ※" in got["D1"]
    assert "## 매각기일 이력\n| 회차 | 기일 | 장소 | 최저가 | 결과 |\n|---:|---|---|---:|---|\n| 1 | -  | — | 1만원 | x |\n| 2 | -  | — | 5원 | — |\n\n" in got["D1"]
    assert "## 감정평가 요항\n### 교통\n> a\n> b\n\n## 매각대상물\n1. **건물명**: c · **n**: 3\n\n## 사진\n- a\n- b\n\n## 원본" in got["D1"]
    for absent in ("임차인현황", "등기부 / 토지", "낙찰 완료", "건물·면적"):
        assert absent not in got["D1"]
    assert [x for x in got["D2"].split("\n") if x.startswith("## ")] == ["## 메타", "## 주소", "## 가격", "## 원본"]
    assert [x for x in got["D3"].split("\n") if x.startswith("## ")] == ["## 메타", "## 입찰 전 핵심 정보", "## 주소", "## 가격", "## 원본"]
