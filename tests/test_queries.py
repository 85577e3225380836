"""Every registered query of the listing side against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from saleflow.operators import model
from saleflow.plans.tables import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_model_bands_and_error(spark):
    sf = SF.replace("0.001", "0.01")
    rows = QUERIES["k3_quantile_model"](spark, sf).collect()
    assert rows and all(r.low_rate <= r.rate <= r.high_rate and 0.1 <= r.rate <= 2.0 for r in rows)
    covered = QUERIES["k3_coverage"](spark, sf).first()
    assert covered.n > 200 and 0.76 <= covered.inside <= 0.84
    m = QUERIES["k6_evaluate"](spark, sf).first()
    assert m.n > 0 and m.mae < 0.8 * m.baseline_mae  # the shaped sale rates fall with failed rounds
    chosen = {r.method: r["n"] for r in QUERIES["k4_estimates"](spark, sf).groupBy("method").agg(F.count("rate").alias("n")).collect()}
    assert chosen["model"] > 0


def test_guards_of_the_model(spark):
    rows = spark.range(150).select(F.col("id").cast("string").alias("docid"), F.lit(0.9).alias("target"), F.lit("2001-08-30").cast("date").alias("sale_date"))
    got = model.evaluate(rows, "2001-09-01")
    assert got.columns == ["n", "mae", "mape", "baseline_mae"] and got.count() == 0


def test_entry_without_the_subpackage():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
