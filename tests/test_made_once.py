"""Raw rows that are made once for all fields read from them."""

from pyspark.sql import functions as F

from saleflow.functions import scalars as sc
from saleflow.operators import details
from saleflow.sources import scan


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_raw_row_is_made_once(spark):
    raw = spark.range(3).select(F.create_map(F.lit("docid"), F.concat(F.lit("D"), "id"), F.lit("gamevalAmt"), F.lit("1,000"), F.lit("maeAmt"), F.col("id").cast("string")).alias("row"), F.lit(1).alias("n"))
    out = details.to_sale_results(raw, ["n"])
    assert plan(out).count("map(docid") == 1
    assert sorted((r.docid, r.appraisal_amount, r.sale_amount) for r in out.collect()) == [("D0", 1000, 0), ("D1", 1000, 1), ("D2", 1000, 2)]


def test_a_payload_is_decoded_once(spark):
    rows = spark.sql("""select 'B1' as court_code, '1' as case_no, 1 as item_no, '{"csPicLst":[{"picFile":"QUJD","picTitlNm":"a.PNG","picSeq":"7"},{"picSeq":"x"}]}' as detail""")
    out = scan.photo_manifest(rows)
    assert plan(out).count("unbase64") + plan(out).count("try_to_binary") <= 2
    assert [(r.seq, r.n_bytes, r.storage_path) for r in out.orderBy("seq").collect()] == [(2, None, None), (7, 3, "B1/1/1/07.png")]


def test_numbers_and_dates_name_their_text_once(spark):
    made = F.upper(F.col("v"))
    for f in (sc.to_int, sc.to_float, sc.to_date8):
        assert str(f(made)).count("upper") == 1
    rows = spark.createDataFrame([(" 1,234 ",), ("+5",), ("1.5",), (".5",), ("5.",), ("",), ("x",), ("20010203",), ("2001-02-03",), ("20011399",), (None,), ("99999999999999999999",)], "v string")
    got = [tuple(r) for r in rows.select(sc.to_int(F.col("v")), sc.to_float(F.col("v")), sc.to_date8(F.col("v")).cast("string")).collect()]
    assert got[:7] == [(1234, 1234.0, None), (5, 5.0, None), (None, 1.5, None), (None, 0.5, None), (None, 5.0, None), (None, None, None), (None, None, None)]
    assert got[7:] == [(20010203, 20010203.0, "2001-02-03"), (None, None, "2001-02-03"), (20011399, 20011399.0, None), (None, None, None), (None, 1e20, None)]
