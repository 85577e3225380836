"""A commit log beside a table's folders: numbered JSON files, each put there only if it is absent.

A commit names all that a reader needs (folders, counts), so readers open one file. Writers put data into folders of their
own first and then commit number n + 1 to what they have read as n; of two writers from one number one gets a
`Conflict`, whatever their clocks say. Data of failed writers is never named by a commit.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

LOG = "_commits"


class Conflict(RuntimeError):
    """Another writer has committed since the table was read."""


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, p, p.getFileSystem(conf)


def new_load() -> str:
    return f"u{uuid.uuid4().hex}"


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a folder."""
    _jvm, _conf, p, fs = _files(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def versions(spark: SparkSession, root: str) -> list[int]:
    _jvm, _conf, p, fs = _files(spark, f"{root.rstrip('/')}/{LOG}")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def load(spark: SparkSession, root: str, version: int) -> dict:
    jvm, _conf, p, fs = _files(spark, f"{root.rstrip('/')}/{LOG}/{version:020d}.json")
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number, content) of the last commit; (-1, {}) before the first."""
    known = versions(spark, root)
    return (known[-1], load(spark, root, known[-1])) if known else (-1, {})


def commit(spark: SparkSession, root: str, version: int, content: dict) -> int:
    """Put commit `version`, or raise Conflict if it is there already. The file appears whole, by a rename that can't replace."""
    folder = f"{root.rstrip('/')}/{LOG}"
    jvm, conf, staged, fs = _files(spark, f"{folder}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(content | {"version": version}, ensure_ascii=False).encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{version:020d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(staged, target, keep)
    except Py4JJavaError as e:
        fs.delete(staged, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise Conflict(f"{root}: commit {version} was made by another writer") from None
        raise
    return version


def history(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The commits themselves as rows of `schema`."""
    return spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{root.rstrip('/')}/{LOG}")
