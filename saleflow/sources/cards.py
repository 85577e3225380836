"""Listing cards and detail pages of the Japanese site, parsed in Arrow batches with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saleflow.functions import scalars as sc
from saleflow.shared import spread

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Class names and labels of the site.
CARD, TH, TD = "bit__searchResult", "bit__multiHeadTable_th", "bit__multiHeadTable_td"
FIELD_TABLE, PRICES, IMAGE = "bit__paragraphBreaksTable", "bit__syousai_text_kakaku_container", "bit__image"
CARD_IMAGE, ACCESS, CARD_PRICES, SMALL, TITLE, HEAD = "bit__searchResult_img", "bit__icon_access", "bit__result_kakakuContainer", "bit__text_small", "bit__text_big", "bit__text_big"
PRICE_LABELS = {"売却基準価額": "standard_price", "買受申出保証金": "deposit", "買受可能価額": "purchase_price"}
CARD_PRICE_LABELS = {"売却基準価額": "standard_price", "保証金": "deposit", "買受可能価額": "purchase_price"}
DATE_LABELS = {"公示開始日": "notice_start", "閲覧開始日": "view_start", "入札期間": "bid_period", "開札期日": "open_date", "売却決定期日": "decision_date", "特別売却期間": "special_period"}
STATUSES = ("期間入札", "特別売却", "特別売却期間", "売却中止")
SALE_CLASSES = {"土地": "1", "戸建て": "2", "マンション": "3", "その他": "4"}
TRANSIT = ("駅", "バス", "ｋｍ", "km")
_DETAIL = re.compile(r"tranPropertyDetail\(\s*['\"]?([^'\",\s)]+)['\"]?\s*,\s*['\"]?([^'\",\s)]+)")
_CASE = re.compile(r"(?:令和|平成)\s*(?:\d+|元)年\s*[(（][^)）]+[)）]\s*第\s*\d+\s*号")
_PRICE = re.compile(r"[\d,]*\d[\d,]*(?:万[\d,]*)?\s*円")
CARDS = (
    "page_id long, sale_unit_id string, court_id string, case_no string, court_name string, sale_cls_label string, status_text string, photo_url string, address string, transit string, "
    "labels map<string,string>, prices map<string,string>"
)
DETAIL = (
    "page_id long, case_no string, court_name string, prices map<string,string>, dates map<string,string>, fields array<map<string,string>>, heads array<string>, photos array<string>, "
    "latitude double, longitude double, has_pdf boolean"
)


class Node:
    """An element; `nodes` are all of its page in their order, of which its own are from `at` up to `end`."""

    __slots__ = ("at", "attrs", "children", "classes", "end", "name", "nodes", "parent", "told")

    def __init__(self, name: str, attrs: dict, parent: Node | None, nodes: list[Node]) -> None:
        self.name, self.attrs, self.parent, self.nodes, self.told = name, attrs, parent, nodes, None
        self.classes = frozenset(attrs["class"].split()) if attrs.get("class") else NONE
        self.children: list[Node | str] = []
        self.at, self.end = len(nodes), len(nodes) + 1
        nodes.append(self)

    def walk(self) -> list[Node]:
        return self.nodes[self.at : self.end]

    def text(self) -> str:
        if self.told is None:
            self.told = " ".join("".join([c if c.__class__ is str else f" {c.text()} " for c in self.children]).split())
        return self.told

    def of(self, cls: str) -> list[Node]:
        return [n for n in self.walk() if cls in n.classes]


NONE: frozenset[str] = frozenset()


class Tree(HTMLParser):
    """The tree of a page. A page of plain markup alone (PLAIN) is read by its tokens, any other by the library; both build the same."""

    def __init__(self, page: str) -> None:
        self.nodes: list[Node] = []
        self.root = self.at = Node("", {}, None, self.nodes)
        self.depth = 0
        if not self.plainly(page):
            super().__init__(convert_charrefs=True)
            self.feed(page)
            self.close()
        for node in reversed(self.nodes):
            if node.parent is not None and node.parent.end < node.end:
                node.parent.end = node.end

    def plainly(self, page: str) -> bool:
        found = PLAIN.findall(page)
        if sum(map(len, [x[0] for x in found])) != len(page):
            return False
        if RAW.search(page):
            return False
        for whole, start, attrs, closed, end in found:
            if start:
                start = start.lower()
                self.handle_starttag(start, [(k.lower(), a if a else b) for k, a, b in ATTR.findall(attrs)] if attrs else ())
                if closed:
                    self.handle_endtag(start)
            elif end:
                self.handle_endtag(end.lower())
            else:
                self.at.children.append(unescape(whole) if "&" in whole else whole)
        return True

    def handle_starttag(self, tag: str, attrs: Iterable) -> None:
        node = Node(tag, dict(attrs), self.at, self.nodes)
        self.at.children.append(node)
        if tag not in VOID and self.depth < 400:
            self.at, self.depth = node, self.depth + 1

    def handle_endtag(self, tag: str) -> None:
        node, up = self.at, 1
        while node.parent is not None:
            if node.name == tag:
                self.at, self.depth = node.parent, self.depth - up
                return
            node, up = node.parent, up + 1

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


#: Plain markup: tags whose attributes are quoted and hold neither references nor angle brackets, and text; RAW elements have rules of their own.
PLAIN = re.compile(
    r"""(<(?:([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z][-A-Za-z0-9_]*=(?:"[^"<>&\x00\r]*"|'[^'<>&\x00\r]*'))*)[ \t\n]*(/?)|/([A-Za-z][A-Za-z0-9]*))>|[^<\x00\r]+)"""
)
ATTR = re.compile(r"""([A-Za-z][-A-Za-z0-9_]*)=(?:"([^"]*)"|'([^']*)')""")
RAW = re.compile(r"<(?:script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|plaintext|svg|math)\b", re.IGNORECASE)


def after(node: Node) -> Node | None:
    """The element that follows a node under its parent."""
    found = False
    for x in node.parent.children if node.parent else ():
        if found and isinstance(x, Node):
            return x
        found = found or x is node
    return None


def headed(node: Node, th: str, td: str) -> dict[str, str]:
    """Head cells and their values: the element right after a head cell, if it is a value cell."""
    out = {}
    for head in node.of(th):
        value = after(head)
        if value is not None and td in value.classes and head.text() and value.text():  # a text is made once
            out[head.text()] = value.text()
    return out


@cache
def _tokens(labels: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join([*map(re.escape, labels), f"(?P<price>{_PRICE.pattern})"]))


def priced(texts: Iterable[str], labels: dict[str, str]) -> dict[str, str]:
    """Prices by label in one pass: a label is open until its first price or the next label."""
    token = _tokens(tuple(labels))
    out: dict[str, str] = {}
    opened = None
    for m in (m for text in texts for m in token.finditer(text)):
        if m["price"] is None:
            opened = labels[m[0]]
        elif opened:
            out[opened], opened = m[0], None
    return out


def court_before(text: str) -> str | None:
    """The last word with 裁判所 in what stands before a case number."""
    return next((w for w in reversed(text.split()) if "裁判所" in w), None)


def holder(node: Node) -> Node | None:
    """The innermost card that holds an element."""
    up = node.parent
    while up is not None and CARD not in up.classes:
        up = up.parent
    return up


def cards_of(page: str) -> list[dict]:
    """One dict for each listing that the page links to, with what its card says; the first link to a listing counts."""
    found: dict[str, dict] = {}
    for node in Tree(page).nodes:
        link = _DETAIL.search(node.attrs.get("onclick") or "") if node.name == "a" else None
        if link and link[1] not in found:
            card = holder(node)
            found[link[1]] = {"sale_unit_id": link[1], "court_id": link[2], **(told(card) if card else EMPTY)}
    return list(found.values())


EMPTY = {k: None for k in ("case_no", "court_name", "sale_cls_label", "status_text", "photo_url", "address", "transit")} | {"labels": {}, "prices": {}}


def told(card: Node) -> dict:
    inside = card.walk()
    whole = card.text()
    case = _CASE.search(whole)
    first = lambda xs: next(xs, None)
    icon = first(n for n in inside if ACCESS in n.classes)
    lines = [n.text() for n in inside if n.name == "p" or n.name == "div" and not any(isinstance(c, Node) and c.name in ("p", "div") for c in n.children)]
    boxes = [x for n in inside if CARD_PRICES in n.classes for x in n.walk() if x.name == "div" and SMALL in x.classes]
    return {
        "case_no": case[0] if case else None,
        "court_name": court_before(whole[: case.start()]) if case else None,
        "sale_cls_label": first(n.text() for n in inside if "badge" in n.classes and n.text() in SALE_CLASSES),
        "status_text": first(n.text() for n in inside if n.name == "p" and n.text() in STATUSES),
        "photo_url": first(n.attrs["src"] for n in inside if n.name == "img" and n.attrs.get("src") and n.classes & {IMAGE, CARD_IMAGE}),
        "address": (icon.parent.text() or None) if icon is not None and icon.parent is not None else None,
        "transit": first(x.text() for x in boxes if any(w in x.text() for w in TRANSIT)),
        "labels": headed(card, TH, TD),
        "prices": priced(lines, CARD_PRICE_LABELS),
    }


def detail_of(page: str) -> dict:
    """What a detail page says: prices by label, dates by label, a map of fields for each item, photos, place, case and court."""
    root = Tree(page).root
    inside = root.walk()
    boxes = root.of(PRICES)[:1]
    lines = [n.text() for box in boxes for n in box.walk() if n.name == "p"]
    place = {n.attrs.get("id"): n.attrs.get("value") for n in inside if n.name == "input"}
    try:
        lat, lng = (float(place[k]) if place.get(k) else None for k in ("latitude", "longitude"))
    except ValueError:
        lat = lng = None
    title = next((n.text() for n in inside if {TITLE, "col-12", "d-sm-inline"} <= n.classes), "")
    case = _CASE.search(title)
    fields, heads, head = [], [], None
    for n in inside:
        if n.name == "p" and HEAD in n.classes:
            head = n.text()
        elif FIELD_TABLE in n.classes:
            cells = zip(n.of(FIELD_TABLE + "_th"), n.of(FIELD_TABLE + "_td"), strict=False)
            if pairs := {a.text(): b.text() for a, b in cells if a.text() and b.text()}:
                fields.append(pairs)
                heads.append(head)
    return {
        "case_no": case[0] if case else None, "court_name": (title[: case.start()].strip() or None) if case else None, "prices": priced(lines, PRICE_LABELS),
        "dates": headed(root, TH, TD), "fields": fields, "heads": heads, "photos": [n.attrs["src"] for n in root.of(IMAGE) if (n.attrs.get("src") or "").startswith("/data/image/")],
        "latitude": lat, "longitude": lng, "has_pdf": any(n.attrs.get("id") == "threeSetPDF" for n in inside),
    }


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.replace("map<string,string>", "map").split(", ")]


def parse_listing_cards(pages: DataFrame) -> DataFrame:
    """One row per card of `pages` (page_id, html), a listing once per page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"page_id": i, **c} for i, h in zip(batch.page_id, batch.html, strict=True) for c in cards_of(h or "")]
            yield pd.DataFrame(rows, columns=_names(CARDS))

    return spread(pages.select("page_id", "html"), "page_id").mapInPandas(parse, CARDS)


def parse_detail_pages(pages: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"page_id": i, **detail_of(h or "")} for i, h in zip(batch.page_id, batch.html, strict=True)], columns=_names(DETAIL))

    return spread(pages.select("page_id", "html"), "page_id").mapInPandas(parse, DETAIL)


def dated(labels: str, exact: bool = True) -> list[Column]:
    """Dates of a map of labelled texts, and starts and ends of periods; a card's labels may hold more than the name."""

    def value(name: str) -> Column:
        if exact:
            return F.try_element_at(labels, F.lit(name))
        return F.get(F.map_values(F.map_filter(labels, lambda k, v: F.contains(k, F.lit(name)))), F.lit(0))

    out = []
    for label, name in DATE_LABELS.items():
        if name.endswith("_period"):
            halves = F.split(value(label), "[〜～~]")
            out += [sc.jp_date(F.get(halves, i)).alias(f"{name.removesuffix('_period')}_{side}") for i, side in enumerate(("start", "end"))]
        else:
            out.append(sc.jp_date(value(label)).alias(name))
    return out


def with_typed(cards: DataFrame) -> DataFrame:
    """Cards with typed status, case parts, prices, dates and photo parts."""
    price = lambda n: sc.jp_price(F.try_element_at("prices", F.lit(n))).alias(n)
    return cards.select(
        "page_id", "sale_unit_id", "court_id", "case_no", sc.jp_case_no(F.col("case_no")).alias("case_parts"), "court_name", "sale_cls_label", "status_text",
        sc.jp_status(F.col("status_text")).alias("status"), "photo_url", sc.jp_photo_url(F.col("photo_url")).alias("photo_parts"), "address", "transit",
        price("standard_price"), price("deposit"), *dated("labels", exact=False),
    )


def detail_typed(found: DataFrame) -> DataFrame:
    """Detail pages with typed prices and dates beside the maps."""
    price = lambda n: sc.jp_price(F.try_element_at("prices", F.lit(n))).alias(n)
    return found.select("*", *map(price, PRICE_LABELS.values()), *dated("dates"))


def card_price_trap(price: Column) -> Column:
    return price <= 100_000


def to_jp_properties(cards: DataFrame) -> DataFrame:
    """Cards (sale_unit_id, court_id, case_no, sale_cls_label, status_text, photo_url, address, standard_price, deposit) as
    listings; cards without a court or case number go."""
    label = F.trim(F.coalesce("sale_cls_label", F.lit("")))
    code = F.try_element_at(F.create_map(*(F.lit(x) for kv in SALE_CLASSES.items() for x in kv)), label)
    seq = F.nullif(sc.jp_photo_url(F.col("photo_url"))["seq"], F.lit(0))
    known = cards.where("court_id is not null and case_no is not null")
    return known.select(
        "sale_unit_id", F.col("court_id").alias("court_code"), "case_no", sc.jp_case_no(F.col("case_no")).alias("case_parts"),
        F.coalesce(seq, F.lit(1)).alias("property_seq"), code.alias("sale_cls"), sc.truthy(label).alias("sale_cls_label"),
        "standard_price", "deposit", sc.jp_status(F.col("status_text")).alias("status"), F.col("address").alias("address_text"),
        sc.jp_normalize_addr(F.col("address")).alias("address_normalized"), F.coalesce(card_price_trap(F.col("standard_price")), F.lit(False)).alias("yen_10k_trap"),
    )


def register_courts(courts: DataFrame, cards: DataFrame) -> DataFrame:
    """Courts (code, name) with those that the cards name; a card's name wins."""
    seen = cards.where("court_id is not null and coalesce(court_name, '') <> ''")
    named = seen.groupBy(F.col("court_id").alias("code")).agg(F.max("court_name").alias("name"))
    return courts.select("code", "name").join(named.select("code"), "code", "left_anti").unionByName(named)
