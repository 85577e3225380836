import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from saleflow.llm import fingerprints as f


def mixed(h, part):
    return xxhash.xxh64_intdigest(part, h)


def simhash(text):
    """128 bits by votes of signed bits, term by term."""
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    score = [0] * 128
    for k in (2, 3):
        for i in range(max(len(w) - k + 1, min(1, len(w)))):
            h = 42
            for x in w[i : i + k]:
                h = mixed(h, x.encode())
            other = mixed(mixed(42, h.to_bytes(8, "little")), (128).to_bytes(4, "little"))
            for b in range(64):
                score[b] += 1 if h >> b & 1 else -1
                score[64 + b] += 1 if other >> b & 1 else -1
    first, second = (sum((score[base + b] > 0) << b for b in range(64)) for base in (0, 64))
    return f"{first:016x}{second:016x}"


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    prints = [simhash(t) for _, t in rows]
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    out = []
    for k, (i, t) in enumerate(rows):
        after, third = (k + 1) % len(rows), len(t) // 3
        edited = t[: len(t) - third] + rows[after][1][:third]
        e = simhash(edited)
        close = sum(apart(prints[k], x) <= f.RADIUS for x in prints) - 1 if i is not None and i % 50 == 0 else None
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), digest, prints[k], e, 1 - apart(prints[k], e) / 128, 1 - apart(prints[k], prints[after]) / 128, close))
    return Counter(out)


@pytest.mark.parametrize("rows_of_a_range", [2000, 7])
def test_equals_brute_force(docs, rows, monkeypatch, rows_of_a_range):
    monkeypatch.setattr(f, "RANGE_ROWS", rows_of_a_range)
    rows = [r for r in rows if len(r[1] or "") < 40_000 or "x" in r[1][:1]]
    kept = docs.where("doc_id is null or doc_id <> 150 or length(text) < 40000")
    assert Counter(map(tuple, f.report(kept).collect())) == brute([tuple(r) for r in kept.select("doc_id", "text").collect()])


def test_one_row_ties_and_empty(spark, no_docs):
    schema = "doc_id long, text string"
    for data in ([(3, "one two three four five six")], [(None, "b c"), (None, None), (None, "a b c d e f")], [(7, "x y z")] * 3 + [(-1 << 62, "p q r s t")], [(1 << 60, "a b"), ((1 << 60) + 1, "a b"), ((1 << 60) + 2, "c d e f g h")]):
        assert Counter(map(tuple, f.report(spark.createDataFrame(data, schema)).collect())) == brute(data)
    assert f.report(no_docs).count() == 0


def test_clashing_columns(docs):
    odd = docs.select("doc_id", "text", *(F.lit(1).alias(c) for c in ("t", "range", "place", "copy", "f1", "h", "which", "last")))
    assert Counter(map(tuple, f.report(odd).collect())) == Counter(map(tuple, f.report(docs).collect()))


@pytest.mark.parametrize(("radius", "blocks"), [(0, 1), (3, 4), (3, 8), (5, 8), (1, 2)])
def test_search_finds_all_within_the_radius(spark, radius, blocks):
    r = random.Random(blocks)
    base = [r.getrandbits(128) for _ in range(6)]
    prints = base + [base[0]] * 40
    for _ in range(900):  # a large group of near ones, and others at the edge
        x = r.choice([base[0], base[0], r.choice(base)])
        for b in r.sample(range(128), r.randint(0, radius + 2)):
            x ^= 1 << b
        prints.append(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda x: (signed(x >> 64), signed(x & (1 << 64) - 1))
    table = spark.createDataFrame([(*halves(x), k) for k, x in enumerate(prints)], "f1 long, f2 long, k int").cache()
    got = f.within(table.where("k % 7 = 0"), table, radius, blocks).collect()
    have = {((x.q1, x.q2), (x.f1, x.f2)): (x.n, x.distance) for x in got}
    counts = Counter(prints)
    want = {(halves(a), halves(b)): (counts[b], d) for a in set(prints[::7]) for b in counts if (d := (a ^ b).bit_count()) <= radius}
    assert have == want and len(got) == len(want)


def test_a_third_replaced_stays_nearer_than_the_next(spark):
    from tests.llm.conftest import prose

    data = [(k, prose(1000 + k, 90)) for k in range(60)]
    got = f.report(spark.createDataFrame(data, "doc_id long, text string")).collect()
    mean = lambda c: sum(r[c] for r in got) / len(got)
    assert mean("near_edited") > 0.7 > 0.6 > mean("near_next") and sum(r.near_edited > r.near_next for r in got) >= 57


def test_the_main_path_is_native(docs):
    plan = f.compared(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
