"""Sends this package to Spark's Python workers, so that they import it wherever they start."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """`addPyFile` of the zipped package, once for each Spark application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    staged = tempfile.mkdtemp(prefix="spark-saleflow-")
    shutil.copytree(here, f"{staged}/package/saleflow", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{staged}/saleflow", "zip", f"{staged}/package"))
