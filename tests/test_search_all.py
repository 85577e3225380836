"""All patterns at once against a search for each."""

from saleflow.operators import substring_index as si


def test_all_patterns_at_once(spark):
    rows = spark.createDataFrame([(1, "LOT 12 A", None), (2, "lot 7", "Lot 120"), (3, None, "타경100"), (4, "x", ""), (5, "ab", "cablot 1")], "id long, a string, b string")
    index = si.postings(rows, "id", ["a", "b"])
    patterns = ["LOT 12", "lot", "x", "1", "타경1", "no such", "", "b", "ot 1", "lot"]
    got = sorted(tuple(r) for r in si.search_all(index, rows, "id", ["a", "b"], patterns).collect())
    assert got == sorted((p, r.id) for p in set(patterns) for r in si.search(index, rows, "id", ["a", "b"], p).collect())
    for some in (["x"], ["lot"]):
        assert si.search_all(index, rows, "id", ["a", "b"], some).count() == si.search(index, rows, "id", ["a", "b"], some[0]).count()
