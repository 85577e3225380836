"""The page tree by tokens and by the library, and pages dealt over tasks."""

from html.parser import HTMLParser

import pytest

from saleflow.sources import cards

CARD = """<div class="bit__searchResult"><p class="my-2">期間入札</p><img class='bit__image' src="/a.jpg"/><a onclick="tranPropertyDetail('%s','C1')">x</a><br>a &amp; b</div>"""


def shown(node):
    return node.name, node.attrs, [c if isinstance(c, str) else shown(c) for c in node.children], node.text(), [n.name for n in node.walk()]


@pytest.mark.parametrize(
    "more", ["", "<p>open", "</div></p>", "<br/>", "&lt;", "<P CLASS='x'>y</P>", "<script>a<b</script>", "<!-- c --><p a=b>", "<div/><p>", "<", "<a href='?a=1&b=2'>z", "<p\nid=\"\">", "\r\n", "<title>&lt;</title>"]
)
def test_both_trees_are_one(monkeypatch, more):
    page = CARD % "U1" + more + CARD % "U2"
    fast = shown(cards.Tree(page).root)
    assert [c["sale_unit_id"] for c in cards.cards_of(page)][:1] == ["U1"]
    monkeypatch.setattr(cards.Tree, "plainly", lambda self, page: False)
    assert shown(cards.Tree(page).root) == fast


def test_plain_pages_need_no_library(monkeypatch):
    monkeypatch.setattr(HTMLParser, "feed", lambda self, page: pytest.fail("a plain page"))
    assert len(cards.cards_of(CARD % "U1" + CARD % "U2")) == 2


def test_pages_of_one_file_are_dealt_over_tasks(spark):
    pages = spark.createDataFrame([(i, CARD % f"U{i}") for i in range(64)], "page_id long, html string").coalesce(1)
    assert cards.parse_listing_cards(pages).rdd.getNumPartitions() >= 4
    assert cards.parse_detail_pages(pages).rdd.getNumPartitions() >= 4
    assert cards.parse_listing_cards(pages).count() == 64
