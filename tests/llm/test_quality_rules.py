import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saleflow.llm import quality_rules as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(x) for x in q.SYMBOLS), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(docs, rows):
    got = q.with_statistics(docs, False).collect()
    have = Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert have == Counter(brute(t) for _, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 10, 0.1), (3, 200, 0.05), (10, 1000, 0.0125), (0, 1, 0.3), (400, 100_000, 0.0125)])
def test_binomial_tail_is_exact(spark, k, n, p):
    c = lambda x: F.lit(x).cast("long")
    got = spark.range(1).select(q.log_binomial_tail(c(k), c(n), p).alias("x")).first().x
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
    want = max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))
    assert got == pytest.approx(want, rel=1e-9)


def labelled(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{i}x{j}###" for j in range(60)), "en") for i in range(50)]
    other = [(20_000 + i, " ".join(f"v{i}x{j}###" for j in range(60)), "xx") for i in range(50)]
    docs = spark.createDataFrame(good + bad + other, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad], "doc_id long, quality int, toxic int")
    return docs, labels


def test_certified_cutoffs_reject_only_where_labels_allow(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.kept for r in q.score(docs, labels).collect()}
    assert all(got[i] for i in range(3000)) and not any(got[10_000 + i] for i in range(50))
    assert all(got[20_000 + i] for i in range(50))  # a stratum without labels has no cutoffs


def test_false_rejections_stay_within_the_risk(spark):
    docs, labels = labelled(spark)
    noisy = docs.withColumn("text", F.when(F.col("doc_id") % 20 == 0, F.regexp_replace("text", "x", "###")).otherwise(F.col("text")))
    chosen = q.cutoffs(q.with_statistics(noisy, False), labels)
    assert chosen.where("rule = 'symbols_per_word' and cutoff < 3").count() == 0  # 5 % of the good ones lie above


def test_no_labels_and_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.score(docs, none).where("kept <> (not base_failed)").count() == 0
    assert q.score(no_docs, none).count() == 0
    assert q.keep(docs, none).columns == docs.columns


def test_texts_of_too_many_windows_for_the_hashes(docs, rows, monkeypatch):
    monkeypatch.setattr(q, "PLACE_BITS", 5)  # 31 windows
    got = q.with_statistics(docs, False).collect()
    assert Counter(r.n_repeat_words for r in got) == Counter(brute(t)[4] for _, t in rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 20, "en", 1, 2, "x", "y")], "doc_id long, text string, lang string, n_words long, kept long, row string, stratum string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.keep(docs.withColumn("text", F.lit(" ".join(f"w{i}" for i in range(60)))), none).columns == docs.columns
