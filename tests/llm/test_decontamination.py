import hashlib
import random
import re
import tracemalloc

import pytest

from saleflow.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if mine := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= mine
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    t = dict(rows)
    items = [(1, " ".join(t[1].split()[5:40])), (2, t[2].upper()), (10, "one"), (3, "green ran"), (4, ""), (5, None), (6, "never seen " * 9), (7, " ".join(t[1].split()[10:25])), (1 << 40, "| | one two")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_equals_brute_force(docs, rows, benchmark, block):
    got = d.report(d.find(docs, benchmark, block_bytes=block)).collect()
    want = brute([t for _, t in rows], [(r.item_id, r.text) for r in benchmark.collect() if r.text is not None])
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def test_longest_match_has_its_place(docs, benchmark):
    r = d.find(docs.where("doc_id = 1"), benchmark).first()
    longest = max(r.matches, key=lambda m: m.n_words)
    assert (longest.item_id, longest.item_word) == ("1", 0) and longest.n_words >= 35


def test_clean_documents_stay_with_their_columns(spark, docs, no_docs, benchmark):
    left = d.decontaminate(docs, benchmark)
    assert left.columns == docs.columns
    assert left.count() == d.report(d.find(docs, benchmark)).where("not contaminated").count()
    none = benchmark.limit(0)
    assert d.decontaminate(docs, none).count() == docs.count() and d.decontaminate(no_docs, benchmark).count() == 0


def naive_matches(text, item):
    """Longest matches of at least a window: for each place in the text the longest stretch that the item has, unless covered."""
    a, b = words(text), words(item)
    n = min(10, len(b))
    best = []
    for i in range(len(a)):
        length, where = 0, 0
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > length:
                length, where = k, j
        if n and length >= n:
            best.append((i, where, length))
    return [m for m in best if not any(o != m and o[0] <= m[0] and m[0] + m[2] <= o[0] + o[2] for o in best)]


def test_longest_matches_equal_a_naive_matcher():
    r = random.Random(8)
    for trial in range(60):
        letters = "ab" if trial % 3 else "abcdefgh"
        items = [(str(k), " ".join(r.choice(letters) for _ in range(r.randint(1, 40)))) for k in range(4)]
        text = " ".join(r.choice(letters) for _ in range(60)) + " x " + items[1][1] + " y " + items[0][1][:30]
        (_, _, found, matches), = d.BenchmarkSuffixes(items, 10).search([text.encode()])
        want = {(k, *m) for k, (_, t) in enumerate(items) for m in naive_matches(text, t)}
        assert set(matches) == want and len(matches) == len(want) and found == {k for k, *_ in want}


def test_repeated_words_take_no_pairs():
    text, items = "same " * 20_000, [("long", "same " * 20_000), ("short", "same " * 12)]
    tracemalloc.start()
    (n, hits, found, matches), = d.BenchmarkSuffixes(items, 10).search([text.encode()])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, hits, found) == (20_000, [0, 20_000], {0, 1}) and peak < 200 << 20
    assert [m for m in matches if m[0] == 0] == [(0, 0, 0, 20_000)] and len([m for m in matches if m[0] == 1]) == 20_000 - 11
