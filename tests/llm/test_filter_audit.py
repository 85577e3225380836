import itertools
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from saleflow.llm import filter_audit as a


def brute(rows, labels):
    """rows: (doc_id, text, lang); every order is walked document by document."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        x = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t))]
        x.append(i is not None and least[t] < i)
        q = [y for j, *y in labels if j == i and i is not None]
        parts[lang or ""].append((x, any(y[0] == 1 for y in q), any(y[1] == 1 for y in q)))
    out = {}
    for part, docs in parts.items():
        total = defaultdict(int)
        for order in itertools.permutations(range(5)):
            left = list(docs)
            for step, f in enumerate(order):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                total[f] += len(gone)
                failing = sum(d[0][f] for d in docs)
                only = sum(d[0][f] and sum(d[0]) == 1 for d in docs)
                out[part, "".join("ABCDE"[k] for k in order), step + 1] = [
                    len(left), len(gone), failing - len(gone), only, sum(d[1] for d in gone), sum(d[2] for d in gone), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def told(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_equals_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 160, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (103, None, 1)]
    labels = [(i, None if g is None else int(g), int(b)) for i, g, b in labels]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = told(a.audit(a.failures(docs, table)))
    want = brute(rows, labels)
    assert len(want) == 600 * len({r[2] or "" for r in rows}) and got == want


def test_copies_over_parts_with_ties(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(5, text, "en"), (5, text, "de"), (6, text, "en"), (7, text, None), (None, text, "en"), (8, None, None), (9, "", ""), (None, None, "en")] + [(10, "AB " * 150, "en")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(5, 1, 0), (6, 0, 1), (10, 1, 1)]
    assert told(a.audit(a.failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))) == brute(rows, labels)


def test_potential_gives_shapley_values(spark):
    r = random.Random(5)
    for players in (1, 3, 5):
        docs = [r.randrange(1 << players) for _ in range(40)]
        worth = [sum(bool(d & s) for d in docs) for s in range(1 << players)]
        p = spark.createDataFrame([(worth,)], "w array<long>").select(a.potentials(F.col("w"), players).alias("p")).first().p
        for i in range(players):
            orders = list(itertools.permutations(range(players)))
            gain = sum(worth[sum(1 << j for j in o[: o.index(i) + 1])] - worth[sum(1 << j for j in o[: o.index(i)])] for o in orders)
            assert (p[-1] - p[-1 - (1 << i)]) * len(orders) == 60 * gain


def test_empty_and_clashing(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert a.audit(a.failures(no_docs, none)).count() == 0
    odd = docs.withColumn("bits", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("part", F.lit(2.0)).withColumn("good", F.lit(None))
    assert told(a.audit(a.failures(odd, none))) == told(a.audit(a.failures(docs, none)))
