"""Domain tables shaped from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF, AS_OF_YEAR = "2001-09-01", 2001

SHAPES = {
    "sgg": """
        select concat('1', cast(n_regionkey as string)) as sd_code, lpad(cast(n_nationkey as string), 3, '0') as sgg_code,
               concat('SGG', cast(n_nationkey % 3 as string)) as sgg_name
        from nation""",
    "courts": "select concat('B', lpad(cast(s_suppkey as string), 6, '0')) as court_code, s_name as court_name, s_nationkey from supplier",
    "props": """
        select concat('D', cast(o_orderkey as string)) as docid,
               concat('B', lpad(cast(o_custkey % 10 + 1 as string), 6, '0')) as court_code,
               concat(cast(1995 + o_orderkey % 7 as string), '타경', cast(o_orderkey as string)) as case_no,
               concat('1', cast(n_regionkey as string)) as sd_code, lpad(cast(n_nationkey as string), 3, '0') as sgg_code,
               lpad(cast(o_custkey % 4 as string), 3, '0') as emd_code,
               case o_orderkey % 6 when 0 then '10000' when 4 then '30000' when 5 then cast(null as string) else '20000' end as usage_lcl_cd,
               case o_orderkey % 7 when 0 then '20101' when 1 then '20201' when 2 then '10103' when 3 then '20401' when 4 then '20601' else cast(null as string) end as usage_mcl_cd,
               case o_orderkey % 10 when 0 then '아파트' when 1 then '다세대' when 2 then '단독주택' when 3 then '근린시설' when 4 then '공장'
                    when 5 then '오피스텔' when 6 then '전답' when 7 then '임야' when 8 then '다가구주택' else cast(null as string) end as usage_nm,
               case o_orderkey % 5 when 0 then concat('[집합건물 철근콘크리트구조 ', cast(o_orderkey % 190 as string), '.5㎡]')
                    when 1 then concat('[건물 벽돌조 ', cast(o_orderkey % 250 as string), '㎡]')
                    when 2 then concat('[토지 ', cast(o_orderkey % 900 as string), '.25㎡]') else cast(null as string) end as conv_addr,
               concat('ROAD 000', cast(o_custkey % 50 as string), '-0000', cast(o_orderkey % 3 as string)) as road_addr,
               case when o_orderkey % 8 = 0 then cast(null as string) else concat('LOT ', cast(o_custkey as string), case when o_custkey % 3 = 0 then ' 애월읍' else ' 신림동' end) end as lot_addr,
               case o_orderkey % 4 when 0 then '빌라 신축 2층' when 1 then concat(cast(1960 + o_orderkey % 60 as string), '년 준공 농가') when 2 then '펜션' else cast(null as string) end as building_summary,
               cast(floor(o_totalprice) as bigint) * 1000 as appraisal_amount,
               case when o_orderkey % 19 = 0 then cast(null as bigint) else cast(floor(o_totalprice) as bigint) * (10 - o_orderkey % 4) * 100 end as min_sale_price,
               case when o_orderkey % 11 = 0 then cast(null as int) else cast(o_orderkey % 7 as int) end as fail_count,
               case when o_orderkey % 13 = 0 then cast(null as date) else cast(o_orderdate as date) end as sale_date,
               o_orderstatus as state,
               case when o_orderstatus = 'F' then cast(o_orderdate as date) else cast(null as date) end as deleted_on,
               case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then true when o_orderstatus = 'F' and o_orderkey % 3 = 1 then false else cast(null as boolean) end as sold,
               case when o_orderkey % 17 = 0 then cast(null as double) else 126.0 + (o_custkey % 300) / 100.0 end as lng,
               case when o_orderkey % 17 = 0 then cast(null as double) else 34.0 + (o_custkey % 400) / 100.0 end as lat,
               cast(o_orderkey % 101 as int) as safety, o_orderkey, o_custkey
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "rounds": """
        select concat('D', cast(l_orderkey as string)) as docid, l_linenumber as seq, cast(o_orderdate as date) + cast((l_linenumber - l_partkey % 5) * 30 as int) as round_date,
               cast(floor(l_extendedprice) as bigint) as round_price, case when l_linestatus = 'F' then 'failed' else cast(null as string) end as result_cd,
               case when l_partkey % 9 = 0 then '02' else '01' end as kind_cd, l_partkey, l_suppkey
        from lineitem join orders on l_orderkey = o_orderkey""",
    "results": """
        select concat('D', cast(o_orderkey as string)) as docid, concat('B', lpad(cast(o_custkey % 10 + 1 as string), 6, '0')) as court_code,
               concat('1', cast(n_regionkey as string)) as sd_code, case when o_orderkey % 23 = 0 then cast(null as string) else lpad(cast(n_nationkey as string), 3, '0') end as sgg_code,
               lpad(cast(o_custkey % 4 as string), 3, '0') as emd_code,
               case o_orderkey % 6 when 0 then '10000' when 4 then '30000' when 5 then cast(null as string) else '20000' end as usage_lcl_cd,
               cast(floor(o_totalprice) as bigint) * 1000 as appraisal_amount,
               case o_orderkey % 3 when 0 then cast(floor(o_totalprice) as bigint) * (50 + o_orderkey % 60) * 10 when 1 then cast(0 as bigint) else cast(null as bigint) end as sale_amount,
               cast(o_orderkey % 7 as int) as fail_count, cast(o_orderkey % 12 as int) as bidder_count, cast(o_orderdate as date) as sale_date,
               case when o_orderkey % 4 = 0 then cast(null as string) else 'R' end as usage_nm, o_orderkey
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F'""",
    "deals": """
        select concat('1', cast(n_regionkey as string), lpad(cast(n_nationkey as string), 3, '0')) as lawd_cd,
               case l_partkey % 4 when 0 then 'apt' when 1 then 'rh' when 2 then 'offi' else 'land' end as deal_type,
               cast(l_shipdate as date) as deal_date, l_quantity as area, cast(floor(l_extendedprice) as bigint) as amount
        from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "register": """
        select concat('D', cast(p_partkey as string)) as docid, cast(1950 + p_size as int) as building_year,
               case p_partkey % 5 when 0 then 'error' when 1 then 'not_found' else 'ok' end as fetch_status,
               case when p_partkey % 2 = 0 then date '2001-08-20' else date '2001-06-01' end as fetched_on
        from part""",
    "remarks": """
        select concat('D', cast(doc_id as string)) as docid,
               concat(case doc_id % 18 when 0 then '유치권 신고 있음 ' when 1 then '지분 매각 맹지 ' when 2 then '법정 지상권 성립 여지 ' when 3 then '대항력 있음 '
                      when 4 then '대항력 없음 ' when 5 then '위반건축물 제시외 건물 ' when 6 then '임대관계 미상 보전산지 ' when 7 then '3분의 1 분묘 '
                      when 8 then '송전선 공실 일괄매각 ' when 9 then '토지별도등기 점유자 없음 '
                      when 12 then '임업용 산지 ' when 13 then '농림지역 자연보전권역 ' when 14 then '인접 사도 포함 ' when 15 then '포락지 사도법 ' when 16 then '사도가 ' else '' end, coalesce(text, '')) as remark,
               case doc_id % 7 when 0 then '특별매각조건 있음' when 1 then '매수신청보증금 20%' when 2 then '보증금 10%' else cast(null as string) end as terms,
               case doc_id % 9 when 0 then '01' when 1 then '00' when 2 then '' else cast(null as string) end as suspension,
               case doc_id % 5 when 0 then cast(1990 + doc_id % 15 as string) else cast(null as string) end as built, doc_id
        from documents""",
    "tenants": """
        select c_custkey as tenant, concat('D', cast(c_custkey as string)) as docid, cast(abs(floor(c_acctbal)) as bigint) * 10000 as deposit,
               case when c_custkey % 7 = 0 then cast(null as date) else date '2000-01-01' end as lien_date,
               case c_custkey % 5 when 0 then date '1999-12-31' when 1 then date '2000-01-01' when 2 then date '1999-06-01' when 3 then date '2000-05-05' else cast(null as date) end as move_in,
               case when c_custkey % 3 = 0 then date '1999-07-01' else cast(null as date) end as fixed_date, c_custkey % 4 <> 0 as demanded,
               case when c_custkey % 6 = 0 then 5000000 else 0 end as small_claim, cast(c_custkey % 9 as bigint) * 100000 as tax,
               cast(c_custkey % 11 as bigint) * 1000000 as senior, cast(20000000 + c_custkey * 10000 as bigint) as bid
        from customer""",
    "runs": """
        select event_id as run_id, case event_type when 'view' then 'search' when 'click' then 'backfill_details' when 'signup' then 'jp_search' when 'purchase' then 'photos' else 'jp_details' end as kind,
               case when event_id % 7 = 0 then 'failed' when event_id % 31 = 0 then 'running' else 'done' end as status, event_id % 3 <> 0 as complete, cast(ts as timestamp) as started_at,
               case when event_id % 31 = 0 then cast(null as timestamp) else cast(ts as timestamp) end as finished_at, cast(floor(value) as bigint) as n_rows, cast(event_id % 50 as bigint) as ok,
               case when event_id % 7 = 0 then concat('error ', cast(event_id % 5 as string)) else cast(null as string) end as error
        from events""",
    "dead": """
        select concat('/e', cast(user_id % 9 as string)) as endpoint, cast(ts as timestamp) as occurred_at,
               case when event_id % 4 = 0 then cast(ts as timestamp) else cast(null as timestamp) end as resolved_at
        from events where event_type = 'error'""",
    "lineitem_rows": "select * from lineitem",
    "courts_x": "select s_suppkey, s_name from supplier",
    "sd": "select concat('1', cast(r_regionkey as string)) as sd_code, r_name as sd_name from region",
    "usage": """
        select cast((r_regionkey + 1) * 10000 as string) as code, concat('usage ', r_name) as name from region
        union all select cast(20101 + n_nationkey * 100 as string) as code, concat('kind ', n_name) as name from nation""",
    "jp": """
        select concat('U', cast(o_orderkey as string)) as sale_unit_id, concat('C', cast(o_custkey % 20 as string)) as court_id,
               case when o_orderkey % 23 = 0 then cast(null as string) else concat('令和0', cast(o_orderkey % 9 + 1 as string), '年(', case when o_orderkey % 2 = 0 then 'ケ' else 'ヌ' end, ')第', cast(o_orderkey % 700 as string), '号') end as case_no,
               case o_orderkey % 6 when 0 then '土地' when 1 then '戸建て' when 2 then 'マンション' when 3 then 'その他' when 4 then ' 戸建て ' else cast(null as string) end as sale_cls_label,
               case o_orderkey % 5 when 0 then '期間入札' when 1 then '特別売却' when 2 then '売却中止' when 3 then '停止' else '他' end as status_text,
               case o_orderkey % 4 when 0 then concat('/data/image/SH_R07K', cast(o_orderkey % 900 as string), '_', cast(o_orderkey % 6 as string), '_b.jpg') when 1 then '/other.jpg' else cast(null as string) end as photo_url,
               case o_orderkey % 5 when 0 then '軽井沢　別荘地１２番３' when 1 then '古民家 島' when 2 then 'リゾート１' else '八王子市' end as address,
               lpad(cast(case when o_orderkey % 60 > 53 then 91 + o_orderkey % 4 else o_orderkey % 50 end as string), 2, '0') as prefecture,
               case when o_orderkey % 10 = 0 then cast(null as bigint) else cast(floor(o_totalprice) as bigint) * 3 end as standard_price, cast(floor(o_totalprice) as bigint) as deposit,
               case o_orderkey % 3 when 0 then '{"has_three_set_pdf":true}' when 1 then '{"has_three_set_pdf":false}' else cast(null as string) end as detail,
               case o_orderstatus when 'F' then 'closed' when 'O' then 'period_bid' else cast(null as string) end as status, cast(o_orderdate as date) as fetched_on, o_orderkey
        from orders""",
    "scan": """
        select event_id, user_id, cast(ts as timestamp) as seen_at, event_type as status, cast(floor(value * 100) as bigint) as price, props from events""",
}
#: Which test tables a shape reads.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The domain table, over views of its test tables alone."""
    text = SHAPES[name]
    words = set(text.replace("\n", " ").split())
    for t in TABLES:
        if t in words:
            text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    text = re.sub(r'\{("[^}]*)\}', r"{{\1}}", text)  # braces of JSON texts
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL: the shapes as CTEs, then `body` (which may start with CTEs of its own after a comma)."""
    ctes = ",\n".join(f"{n} as ({SHAPES[n]})" for n in names)
    return f"with {ctes}{body if body.lstrip().startswith(',') else chr(10) + body}"
