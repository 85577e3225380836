import re
from collections import Counter

import numpy as np
import pytest

from saleflow.llm import jaccard_join as j
from saleflow.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and rows[a][0] is not None and rows[b][0] is not None and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [(i, len(s), least.get(g) if s and i is not None else i) for (i, _), s, g in zip(rows, sets, group, strict=True)]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
@pytest.mark.parametrize("block", [3000, 2])
def test_equals_brute_force(docs, rows, k, percent, block, monkeypatch):
    monkeypatch.setattr(j, "SMALL", 6 if block > 2 and k > 1 else 1)
    monkeypatch.setattr(j, "BUCKET", 20_000 if k > 1 else 3)
    monkeypatch.setattr(j, "BLOCK_SETS", block)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in j.groups(docs, k, percent).collect()]
    assert Counter(got) == Counter(brute(rows, k, percent))


def test_traversal_loses_no_pair():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    sets = []
    for _ in range(150):
        start = r.integers(0, 2000)
        s = base[start : start + r.integers(5, 300)].copy()
        s[r.random(len(s)) < r.choice([0, 0.02, 0.2])] = r.integers(0, 1 << 63)
        sets.append(np.unique(s))
    linked = {(a, b) for a in range(150) for b in range(a) if 10 * len(np.intersect1d(sets[a], sets[b])) >= 7 * len(np.union1d(sets[a], sets[b]))}

    def closure(pairs):
        group = list(range(150))
        for a, b in pairs:
            group = [group[a] if g == group[b] else g for g in group]
        return [group.index(g) for g in group]

    assert closure(j.block_links(sets, np.full(150, -1), 70)) == closure(linked)
    size = np.array([len(s) for s in sets])
    maps = [j.bitmap(s, j.width(len(s))).tobytes() for s in sets]
    for n in (4, 150):
        found = closure(j.bucket_edges(list(range(n)), size[:n], maps[:n], 70))
        assert all(found[a] == found[b] for a, b in linked if a < n and b < n)


def test_one_of_each_group_stays(docs, rows, no_docs):
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter(i for i, n, c in set(brute(rows, 5, 80)) if i is not None and i == c)
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert j.keep_one(no_docs).count() == 0 and j.groups(no_docs, 3, 90).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (50, 60), (60, 55), (-3, 55)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 50: -3, 60: -3, 55: -3, -3: -3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_key_filters_and_with_hot_shingles(docs, monkeypatch):
    """The same rows where all texts are shuffled, and where shingles of over two classes are stars by broadcast."""
    from saleflow.llm import common

    want = sorted(map(str, j.groups(docs, 5, 80).collect()))
    kept = sorted(map(str, j.keep_one(docs, 5, 80).collect()))
    monkeypatch.setattr(common, "FILTER_BYTES", 0)
    monkeypatch.setattr(j, "BUCKET", 2)
    monkeypatch.setattr(j, "HOT_ROWS", 2)
    monkeypatch.setattr(j, "HOT_SHARE", 0.0)
    assert sorted(map(str, j.groups(docs, 5, 80).collect())) == want
    assert sorted(map(str, j.keep_one(docs, 5, 80).collect())) == kept
