import zlib

import pytest

from saleflow.llm import quality_classifier as q
from saleflow.llm import toxicity as t

from .conftest import prose


@pytest.fixture(scope="module")
def table(spark):
    rows, labels = [], []
    for i in range(900):
        text, bad, toxic = prose(i, 40 + i % 60), i % 7 == 0, i % 6 == 0
        if bad:
            text = text.upper().replace(" ", "!! ")
        if toxic:
            w = text.split()
            for k in range(3):
                w.insert((i * 7 + k * 11) % len(w), ["vermin", "Vermin,", "rubbish", "rubbishy"][(i + k) % 4])
            text = " ".join(w)
        rows.append((i, text, "n", 1))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score string, y int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(rows, labels, name, folds, held):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    out = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    return sum(out) / len(out)


def test_quality_on_held_out_rows(table):
    assert accuracy(q.classify(*table).collect(), table[1], "quality", 3, 1) > 0.97


def test_toxicity_on_held_out_rows_with_offsets(table):
    rows = t.tag(*table).collect()
    assert accuracy(rows, table[1], "toxic", 5, 0) > 0.97
    texts = {r.doc_id: r.text.split() for r in table[0].collect()}
    hits = [texts[r.doc_id][k].lower() for r in rows for k in r.toxic_words]
    assert hits and sum(h.startswith(("vermin", "rubbish")) for h in hits) / len(hits) > 0.95


@pytest.mark.parametrize("f", [q.classify, t.tag])
def test_edge_rows_no_labels_and_empty(table, docs, no_docs, f):
    labels = table[1]
    assert f(docs, labels).count() == docs.count()
    assert {r.score for r in f(docs, labels.limit(0)).collect()} == {0.5}
    assert f(no_docs, labels).count() == 0


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(3)
    crf = t.Crf(np.zeros(t.DIM), np.zeros(t.DIM), 0.3, r.normal(size=(2, 2)), 0.0)
    e, offsets = r.normal(size=9), np.array([0, 4, 4, 5, 9])
    got = crf.marginals(e, offsets)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        total, on = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=int(b - a)):
            if y:
                w = np.exp(sum(e[a + i] for i in range(b - a) if y[i]) + 0.3 * y[0] + sum(crf.trans[y[i], y[i + 1]] for i in range(len(y) - 1)))
                total, on = total + w, on + w * np.array(y)
        if b > a:
            assert got[a:b] == pytest.approx(on / total)


def test_long_words_differ_after_their_first_characters():
    import pyarrow as pa

    w = t.words_of(pa.array(["internationalizations internationalizationxyz"]))
    first, second = w.hashed[w.codes[w.word == 0][0]], w.hashed[w.codes[w.word == 1][0]]
    assert first[0] != second[0] and first[-1] != second[-1]


@pytest.mark.parametrize("blank, bad", [("", "害虫"), ("\u3000", "害虫"), ("\u00a0", "vermin"), ("/", "vermin"), ("", "vermin")])
def test_toxic_passages_in_texts_without_ascii_blanks(blank, bad):
    import random

    import numpy as np
    import pyarrow as pa

    def text(i):
        r = random.Random(i)
        letters = "天地人山水火木金土日月星風雨雪花鳥魚" if bad == "害虫" else "acdfghjklopqstuwxyz"
        words = ["".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(30)]
        if i % 3 == 0:
            words.insert(20 + i % 8, bad)
        return blank.join(words)

    texts = [text(i) for i in range(450)]
    y = np.array([i % 3 == 0 for i in range(450)])
    crf = t.fit(pa.array(texts[:300]), y[:300])
    w = t.words_of(pa.array(texts[300:]))
    p = crf.marginals(crf.emissions(w), w.offsets)
    assert ((crf.scores(p, w.offsets) >= 0.5) == y[300:]).mean() > 0.95


def test_trees_equal_a_naive_walk_and_split():
    import numpy as np

    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=400), r.integers(0, 5, 400), r.normal(size=400)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 2) ^ (r.random(400) < 0.05)).astype(float)
    f = q.fit(x, y)

    def walk(row):
        total = f.base
        for node in f.roots:
            while f.left[node] != node:
                node = f.left[node] + (row[f.feature[node]] > f.threshold[node])
            total += f.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x), [walk(row) for row in x])
    assert ((f.score(x) >= 0.5) == (y == 1)).mean() > 0.9
    # the first split has the greatest gain of all features and cuts
    p = 1 / (1 + np.exp(-f.base))
    g, h = p - y, np.full(len(y), p * (1 - p))
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + q.L2)
    cuts = [(k, c) for k in range(3) for c in np.unique(np.quantile(x[:, k], np.linspace(0, 1, q.BINS + 1)[1:-1], method="lower"))]
    gain = lambda k, c: score(x[:, k] <= c) + score(x[:, k] > c)
    enough = [(k, c) for k, c in cuts if min(h[x[:, k] <= c].sum(), h[x[:, k] > c].sum()) >= q.LEAST * 0.05]
    best = max(gain(k, c) for k, c in enough)
    root = f.roots[0]
    assert np.isclose(gain(f.feature[root], f.threshold[root]), best)


def test_features_of_a_long_text_equal_those_in_parts(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array([prose(1, 30_000), None, "", prose(2, 50)])
    want = q.features(texts)
    monkeypatch.setattr(q, "text_slices", lambda t: ((i, 1) for i in range(len(t))))
    got = q.features(texts)
    assert np.argwhere(~np.isclose(got, want)).tolist() == [] and len(want) == 4 and (want[1] == want[2]).all()


def test_training_texts_are_bounded_in_bytes(table):
    from pyspark.sql import functions as F

    from saleflow.llm.labelled import training_rows

    docs, labels = table
    every = training_rows(docs, labels, "toxic", F.lit(True), 100).collect()
    some = training_rows(docs, labels, "toxic", F.lit(True), 100, 20_000).collect()
    size = lambda rows: sum(len(r.text.encode()) for r in rows)
    assert 0 < len(some) < len(every) == 100 and size(some) <= 20_000 < size(every)
    assert {r.doc_id for r in some} <= {r.doc_id for r in every}
