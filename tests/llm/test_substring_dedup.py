import pytest
from pyspark.sql import functions as F

from saleflow.llm import common
from saleflow.llm import substring_dedup as s

from .conftest import passage, prose


def test_shared_passages_go_from_all_but_the_first(docs):
    got = {r.doc_id: r for r in s.report(s.dedup(docs)).collect()}
    middle = " ".join(passage(1).split()[20:40])
    assert middle in got[130].text and got[130].n_removed == 0
    for i in (131, 132, 133):
        assert middle not in got[i].text and got[i].class_id == 130 and got[i].sources == [130]
        assert got[i].text.startswith(prose(200 + i - 130, 50)[:200])


def test_clean_documents_stay_whole(docs, rows):
    got = {r.doc_id: r for r in s.report(s.dedup(docs)).collect()}
    for i in (20, 21, 140, 141, 142, 143, 146, 150, 151, 160):
        assert got[i].n_removed == 0 and got[i].text == dict(rows)[i] and got[i].class_id == i
    assert got[104].class_id == -5 and got[3].class_id == -5  # copies go with the least doc_id


def test_near_copies_of_lines(spark):
    lines = [prose(50 + i, 60) for i in range(3)]
    edited = lines[1].split()
    edited[30] = "changed"
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, prose(9, 40) + "\n" + " ".join(edited)), (3, prose(10, 90))], "doc_id long, text string")
    got = {r.doc_id: r for r in s.report(s.dedup(docs)).collect()}
    assert got[2].class_id == 1 and got[2].n_removed == 60 and got[3].n_removed == 0
    assert "changed" not in got[2].text


def test_stage_keeps_columns_and_drops_emptied(spark, docs, no_docs):
    left = s.without_repeats(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    ids = [r.doc_id for r in left.collect()]
    assert 131 in ids and 104 not in ids and 140 in ids
    assert s.without_repeats(no_docs).count() == 0


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8**s.ROWS) ** s.BANDS >= s.RECALL >= 0.99


def test_similar_lines_of_a_mixed_bucket_are_linked(spark, monkeypatch):
    rows = [(i, prose(500 + i, 40)) for i in range(30)]
    for k in range(3):
        words = prose(700 + k, 40).split()
        rows += [(100 + 2 * k, " ".join(words)), (101 + 2 * k, " ".join([*words[:-1], "changed"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = s.unit_table(docs).where("size(bands) > 1").drop("bands").withColumn("band", F.lit(1).cast("long"))  # one bucket
    keys = {r.key: r.doc_id for r in lines.collect()}
    for sets in (3000, 5):  # whole, and in parts
        monkeypatch.setattr(s, "BLOCK_SETS", sets, raising=False)
        got = {tuple(sorted((keys[r.a], keys[r.b]))) for r in s.similar(docs, lines).collect()}
        assert got == {(100, 101), (102, 103), (104, 105)}


def test_bands_collide_for_99_of_100_pairs():
    assert 1 - (1 - 0.8**s.ROWS) ** s.BANDS >= 0.99


def bag(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_against_brute_force(spark):
    """Links of lines by all pairs; every removed word lies in a paragraph that an earlier document of its class has too."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    lines = [(d, x.lower().split()) for d, t in texts.items() for x in t.split("\n") if len(x.split()) >= 20]
    sets = [set(bag(x)) for _, x in lines]
    holders: dict = {}
    for i, x in enumerate(sets):
        for w in x:
            holders.setdefault(w, []).append(i)
    pairs = {(i, j) for mine in holders.values() for i in mine for j in mine if lines[i][0] < lines[j][0]}
    like = [(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    got = {r.doc_id: r for r in s.report(s.dedup(docs)).collect()}
    found = sum(got[lines[i][0]].class_id == got[lines[j][0]].class_id and got[lines[j][0]].n_removed >= 20 for i, j in like)
    assert like and found >= 0.97 * len(like)
    runs: dict = {}
    for d, t in texts.items():
        w = t.lower().split()
        for p in range(len(w) - 19):
            runs.setdefault(tuple(w[p : p + 20]), set()).add(d)
    shared = {d for v in runs.values() if len(v) > 1 for d in v} | {d for i, j in like for d in (lines[i][0], lines[j][0])}
    assert {d for d, r in got.items() if r.n_removed} <= shared


@pytest.mark.parametrize("at", [0, 1, 37, 200])
def test_every_verbatim_passage_holds_a_window(spark, at):
    n = s.WINDOW + s.SPREAD - 1
    same = " ".join(prose(4242, n).split()[:n])
    docs = spark.createDataFrame([(i, f"{prose(1000 + i, at if i else 7)} {same} {prose(2000 + i, 90)}") for i in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in s.report(s.dedup(docs)).collect()}
    assert got[0] == 0 and all(got[i] >= s.WINDOW for i in range(1, 12))


def test_anchors_by_definition():
    import numpy as np

    r = np.random.default_rng(5)
    for sizes in ([0, 3, 19, 20, 25, 60, 0, 200], [39, 40, 41]):
        docs = np.concatenate([[0], np.cumsum(sizes)])
        h = r.integers(0, 1 << 62, docs[-1], dtype=np.int64).astype(np.uint64)
        want = set()
        for a, b in zip(docs[:-1], docs[1:]):
            n = b - a - s.WINDOW + 1
            for i in range(max(n - s.SPREAD + 1, min(n, 1))):
                mine = h[a + i : a + min(i + s.SPREAD, n)] >> np.uint64(1)
                want |= {int(a + i + k) for k in np.flatnonzero(mine == mine.min())}
        assert set(s.anchors(h, docs).tolist()) == want


def test_hot_keys_and_the_unfiltered_path(docs, monkeypatch):
    """The same rows with every key hot, and with maps of keys beyond their limit (all rows are shuffled)."""
    want = sorted(map(str, s.report(s.dedup(docs)).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 0.0)
    monkeypatch.setattr(common, "FILTER_BYTES", 0)
    assert sorted(map(str, s.report(s.dedup(docs)).collect())) == want


def test_rows_of_one_doc_id_with_different_texts(spark):
    a, b = prose(31, 60), prose(32, 60)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in s.report(s.dedup(docs)).collect())
    assert [d for d, _ in got] == [1, 2, 2, 3, 3] and got[0] == (1, 0) and (2, 60) in got and (3, 60) in got
