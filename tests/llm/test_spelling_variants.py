import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saleflow.llm import spelling_variants as v


def words_of(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = words_of(rows)
    out = {}
    for w in n:
        close = [x for x in n if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = [form, None, n[w], len(close), n[form] if form else None]
    for w, x in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        x[1] = root
    return {w: tuple(x) for w, x in out.items()}


def told(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: tuple(r)[1:] for r in got}


def misspelt(seed, base, times):
    r = random.Random(seed)
    out = [base] * times
    for _ in range(times // 12):
        i, c = r.randrange(len(base)), r.choice("abeotÿ×")
        out += [r.choice([base[:i] + base[i + 1 :], base[:i] + c + base[i + 1 :], base[:i] + c + base[i:]])] * r.randint(1, 3)
    r.shuffle(out)
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    out = [(k, misspelt(k, w, 40 * (1 + k % 3))) for k, w in enumerate(["mountain", "straßenbahn", "rivière", "committee", "élégance", "aaaaaaaaa", "abababab", "Mountainous"])]
    out += [(50, "mountainn " * 3 + "mountainnn " * 2), (50, "mountainn " * 3), (51, None), (52, ""), (None, "mountain " * 70), (53, "x" * 30_000 + " short 12345678 " + "x" * 30_001 + "\n" + "x" * 30_000 + "." + "x" * 30_001)]
    # a path of three forms: the counts grow by ten
    out += [(60 + k, "cathedrals " * 2 + "cathedral " * 25 + "cathedrel " * 2 + "cathedrul9" * 9) for k in range(12)] + [(90 + k, "catedral " * 300) for k in range(12)]
    return out


def test_equals_brute_force(spark, texts, docs, rows):
    for data in (texts, rows):
        got = told(v.variants(spark.createDataFrame(data, "doc_id long, text string").repartition(3)))
        assert got == brute(data)
    assert told(v.variants(docs)) == got  # clashing columns aren't read


def test_roots_follow_several_forms(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb", "abbbbbb"]
    words = spark.createDataFrame([(w, 10**k) for k, w in enumerate(chain)], "word string, n long")
    got = {r.word: r for r in v.roots(v.forms(v.near_words(words))).collect()}
    assert [got[w].root for w in chain] == [chain[-1]] * 7 and got[chain[0]].form == chain[1] and got[chain[-1]].form is None


@settings(max_examples=150, deadline=None)
@given(st.text("abcdeÿ", min_size=2, max_size=9), st.integers(2, 9), st.data())
def test_one_edit_stays_in_the_reduced_neighbourhood(w, symbols, data):
    i, c = data.draw(st.integers(0, len(w) - 1)), data.draw(st.sampled_from("abcdeÿz"))
    for other in (w, w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]):
        keys = np.concatenate([k for _, k in v.neighbourhoods([w], symbols)])
        assert v.reduced_keys([other], symbols)[0] in keys


def test_neighbourhoods_in_blocks(monkeypatch):
    words = ["abcdefgh", "bcdefghi", "x" * 40]
    want = sorted((int(p), int(k)) for a, b in v.neighbourhoods(words) for p, k in zip(a, b, strict=True))
    sizes = [1 + n + n * 7 + (n + 1) * 8 for n in map(len, words)]
    assert len(want) == sum(sizes)
    monkeypatch.setattr(v, "BLOCK", 64)
    assert sorted((int(p), int(k)) for a, b in v.neighbourhoods(words) for p, k in zip(a, b, strict=True)) == want


def test_a_full_bitmap_only_drops_less(spark, texts, monkeypatch):
    monkeypatch.setattr(v, "MAX_BITS", 1 << 15)
    monkeypatch.setattr(v, "PLACES", 1 << 20)
    assert told(v.variants(spark.createDataFrame(texts, "doc_id long, text string"))) == brute(texts)


def test_empty(spark, no_docs):
    assert v.variants(no_docs).count() == 0
    assert v.variants(spark.createDataFrame([(1, "short words only"), (2, "longestword")], "doc_id long, text string")).count() == 0
