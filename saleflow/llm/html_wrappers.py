"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page becomes a stream of block tokens: opening and closing block tags with their classes, and text. Repeated stretches
fold into repeated groups; pages of one host with the same folded stream have one layout. For each host at most SAMPLE
pages (of at most SAMPLE_BYTES together), the most frequent layouts first, are aligned one after another with the wrapper so
far: unmatched stretches become optional groups, a single copy of a repeated group joins it, and texts become slots.

A slot is of the article if its text lies in the container that holds most of the sample's text, in no element that says
menu, header, footer, sidebar, notice, advert, form, share bar or comments, and isn't repeated by most sample pages
(a text inside an <article> may be, and all may where such texts are most of the sample: near copies of one page). A form, or a
class, id or role word, says so only of an element that holds under half of the sample's text, or not the headings: a page
may stand in a form, and a layout may be called `has-sidebar`. Texts are told apart by their containers and by being
repeated, so a wrapper has one reading of a page. It is compiled with a capture group at each article slot, and every page is
matched as a whole: the text of a page is what the article slots capture. A page that the wrapper doesn't match (`matched`
is false: an unseen layout) is cut by the container and element rules directly, so no page and no text is dropped by the sample.

Character references are decoded, white space in a block becomes one blank, blocks are joined by one blank.

Nulls: null html gives an empty text, a null url is the host ''. Very long pages are matched like others: alignment is linear
beyond ALIGN_CELLS. Ties of layouts and pages go by count, then id hash. Repeated rows are extracted each; an empty table
gives no rows. Other columns are ignored, whatever their names. A host's pages are never gathered in one task, but for its sample.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, split_by_keys

SAMPLE, SAMPLE_BYTES = 24, 16 << 20
#: Streams whose lengths' product is greater are aligned at tokens that both have once.
ALIGN_CELLS = 1_000_000
#: Wrappers of at most so many characters in all are broadcast; more are joined by a shuffle on the host.
BROADCAST_CHARS = 32 << 20
#: Fixed values of HTML: elements whose content isn't text, inline elements, blocks that end by themselves, void blocks.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|button"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q s samp small span "
    "strike strong sub sup time tt u var wbr object canvas math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle msub msup "
    "msubsup munder mover munderover semantics annotation".split()
)
ENDS = {x: {x} for x in ("p", "li", "option", "tr")} | {x: {"dt", "dd"} for x in ("dt", "dd")} | {x: {"td", "th"} for x in ("td", "th")}
VOID = frozenset("br hr meta link input base col area embed source track param".split())
#: Elements, and words of classes, ids and roles, of what isn't the article; the last two unless they hold most of it.
OTHER, FORM = frozenset("head nav header footer aside menu dialog".split()), "form"
OTHER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|overlay|sidebar|"
    r"side|widgets?|related|recommend\w*|share|sharing|social|comments?|replies|reply|respond|discussion|disqus|menu|nav\w*|"
    r"breadcrumbs?|pagination|pager|footer|header|masthead|subscribe|subscription|newsletter|signup|login|search|form|"
    r"copyright|skip|toolbar|contentinfo|complementary|navigation)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|"
    r"<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?][^>]*>|([^<]+|<)",
    re.I | re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: The symbol of text in a stream; in a wrapper, what texts and slots of the article begin with (their containers follow).
TEXT, SLOT = "#", "@"
#: The characters that stand for symbols in an expression; a host with more symbols has no wrapper.
FIRST_CODE, LAST_CODE = 0xF0001, 0x10FFFD


def lex(page: str) -> list[tuple[str, str]]:
    """(symbol, raw text) of the block stream; the symbol of text is TEXT, of tags `<name names` or `/name`.

    Inline tags are left out, ends that HTML implies are put in, end tags without a start are ignored.
    """
    out: list[tuple[str, str]] = []
    open_: list[str] = []
    texts: list[str] = []

    def flush() -> None:
        if texts:
            if (text := "".join(texts)).strip():
                out.append((TEXT, text))
            texts.clear()

    def close(depth: int) -> None:
        while len(open_) > depth:
            out.append((f"/{open_.pop()}", ""))

    for m in _TOKEN.finditer(page):
        if m[8]:
            texts.append(m[8])
            continue
        name = (m[3] or m[6] or "").lower()
        if not name or name in INLINE:
            continue
        flush()
        if name in VOID:
            if name == "br":
                out.append(("<br", ""))
            continue
        if m[2] or m[5]:
            if name in open_:
                close(len(open_) - 1 - open_[::-1].index(name))
            continue
        if name in ENDS and (mine := [i for i, x in enumerate(open_) if x in ENDS[name]]) and mine[-1] >= len(open_) - 1:
            close(mine[-1])
        elif open_ and open_[-1] == "p":
            close(len(open_) - 1)
        names = " ".join(sorted({re.sub(r"\d+", "", "".join(x)) for x in _NAMES.findall(m[4] or m[7] or "")} - {""}))
        open_.append(name)
        out.append((f"<{name} {names}".rstrip(), ""))
    flush()
    close(0)
    return out


def is_other(symbol: str) -> bool:
    """Whether an opening symbol is of what is never the article."""
    return symbol[1:].partition(" ")[0] in OTHER


def may_be_other(symbol: str) -> bool:
    """Whether an opening symbol is of what isn't the article unless it holds most of it."""
    name, _, names = symbol[1:].partition(" ")
    return name == FORM or (name not in ("html", "body", "article", "main") and name not in OTHER and bool(OTHER_WORDS.search(names)))


def block_text(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


Path = tuple[str, ...]


def blocks(stream: list[tuple[str, str]], spared: frozenset[Path] = frozenset()) -> Iterator[tuple[Path, bool, str]]:
    """(open containers, whether one is other than the article, raw text) of each text; `spared` containers aren't other."""
    path: list[str] = []
    others: list[bool] = []
    for symbol, raw in stream:
        if symbol[0] == "<" and symbol != "<br":
            path.append(symbol)
            others.append(is_other(symbol) or may_be_other(symbol) and tuple(path) not in spared)
        elif symbol[0] == "/":
            path.pop()
            others.pop()
        elif symbol == TEXT:
            yield tuple(path), any(others), raw


HEADS = re.compile(r"<(?:h1|article|main)\b")


def spare(streams: list[list[tuple[str, str]]]) -> frozenset[Path]:
    """Containers that a form's name or a word would rule out, but that hold half of the text and of the headings."""
    total = heads = 0
    mass: Counter[Path] = Counter()
    led: Counter[Path] = Counter()
    for stream in streams:
        path: list[str] = []
        soft: list[Path] = []
        hard = 0
        for symbol, raw in stream:
            if symbol[0] == "<" and symbol != "<br":
                path.append(symbol)
                hard += is_other(symbol)
                if may_be_other(symbol):
                    soft.append(tuple(path))
                if not hard and HEADS.match(symbol):
                    heads += 1
                    led.update(soft)
            elif symbol[0] == "/":
                if soft and len(soft[-1]) == len(path):
                    soft.pop()
                hard -= is_other(path.pop())
            elif symbol == TEXT and not hard:
                n = len(block_text(raw))
                total += n
                for p in soft:
                    mass[p] += n
    return frozenset(p for p, n in mass.items() if 2 * n >= total and 2 * led[p] >= heads)


# A wrapper is a list of items: a symbol, ("r", items) for a repeated group, ("o", items) for an optional one.
def fold_repeats(items: list, longest: int = 8) -> list:
    """Fold stretches that stand two or more times in a row, none beginning with an end tag, into repeated groups, short ones first."""
    for size in range(1, longest + 1):
        out, i = [], 0
        while i < len(items):
            unit, n = items[i : i + size], 1
            while len(unit) == size and items[i + n * size : i + (n + 1) * size] == unit:
                n += 1
            if n > 1 and not (isinstance(unit[0], str) and unit[0][0] == "/") and any(not isinstance(x, str) or x[0] not in (TEXT, SLOT) for x in unit):
                group = unit[0] if size == 1 and unit[0][0] == "r" else ("r", unit)
                out.append(group)
                i += n * size
            else:
                out.append(items[i])
                i += 1
        items = [x for k, x in enumerate(out) if not (k and x == out[k - 1] and x[0] == "r")]
        for k in range(len(items) - 1, -1, -1):  # a single copy beside its repeated group belongs to it
            if items[k][0] == "r" and isinstance(items[k], tuple):
                unit = items[k][1]
                while items[k + 1 : k + 1 + len(unit)] == unit:
                    del items[k + 1 : k + 1 + len(unit)]
                while k >= len(unit) and items[k - len(unit) : k] == unit:
                    del items[k - len(unit) : k]
                    k -= len(unit)
    return items


def repeatable(items: list) -> list:
    """A paragraph, list item or cell of the article, alone or in a row, is a repeated group from the start."""
    out, i = [], 0
    while i < len(items):
        unit = items[i : i + 3]
        if len(unit) == 3 and all(isinstance(x, str) for x in unit) and unit[0][0] == "<" and unit[1][0] == SLOT and unit[2] == f"/{unit[0][1:].split(' ')[0]}" and unit[2][1:] in ENDS:
            if not out or out[-1] != ("r", unit):
                out.append(("r", unit))
            i += 3
        else:
            out.append(items[i])
            i += 1
    return out


def _key(item) -> str:
    return item if isinstance(item, str) else json.dumps(item)


def _opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Edits from a to b as difflib tells them; long streams are first cut at their ends and at tokens that both have once."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    out = [("equal", 0, head, 0, head)] if head else []
    shift = lambda ops, i, j: [(k, p + i, q + i, r + j, s + j) for k, p, q, r, s in ops]
    if len(x) * len(y) <= ALIGN_CELLS:
        out += shift(SequenceMatcher(None, x, y, autojunk=False).get_opcodes(), head, head)
    else:
        in_x, in_y = Counter(x), Counter(y)
        where = {t: j for j, t in enumerate(y) if in_y[t] == 1}
        pairs = [(i, where[t]) for i, t in enumerate(x) if in_x[t] == 1 and t in where]
        i = j = 0
        for p, q in [*_rising(pairs), (len(x), len(y))]:
            if (i, j) != (p, q):
                whole = len(pairs) == 0 or (p - i) * (q - j) > ALIGN_CELLS and (i, j) == (0, 0) and (p, q) == (len(x), len(y))
                out += [("replace", i + head, p + head, j + head, q + head)] if whole else shift(_opcodes(x[i:p], y[j:q]), i + head, j + head)
            if p < len(x):
                out.append(("equal", p + head, p + 1 + head, q + head, q + 1 + head))
            i, j = p + 1, q + 1
    if tail:
        out.append(("equal", len(a) - tail, len(a), len(b) - tail, len(b)))
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises on both sides."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [j], [k]
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(wrapper: list, page: list) -> list:
    """The wrapper that takes both: unmatched stretches become optional, a single copy of a repeated group joins it."""
    if wrapper == page:
        return wrapper
    out: list = []
    for kind, a, b, c, d in _opcodes(list(map(_key, wrapper)), list(map(_key, page))):
        one, two = wrapper[a:b], page[c:d]
        if kind == "equal":
            out += one
        elif len(one) == 1 and one[0][0] in ("r", "o") and not isinstance(one[0], str) and one[0][1] == two:
            out += one
        elif len(two) == 1 and two[0][0] == "r" and not isinstance(two[0], str) and two[0][1] == one:
            out += two
        else:
            for part in (one, two):
                if part:
                    bare = [y for x in part for y in (x[1] if not isinstance(x, str) and x[0] == "o" else [x])]
                    out.append(("o", bare))
    return fold_repeats(out)


def loosened(items: list) -> list:
    """Groups take all they can and give nothing back; where the same unit follows again, with optional groups alone
    between, it may be there any number of times (`*`)."""
    out: list = []
    i = 0
    while i < len(items):
        k = len(out)
        while k and not isinstance(out[k - 1], str) and out[k - 1][0] == "o":
            k -= 1
        last = out[k - 1] if k else None
        unit = last[1] if last is not None and not isinstance(last, str) else None
        x = items[i]
        if unit and items[i : i + len(unit)] == unit:
            out.append(("*", unit))
            i += len(unit)
            continue
        again = not isinstance(x, str) and x[0] == "r" and (unit == x[1] or out[max(0, k - len(x[1])) : k] == x[1])
        out.append(("*", x[1]) if again else x)
        i += 1
    return out


def pattern(items: list, code: dict[str, str]) -> str:
    """The regular expression of a wrapper, a character per symbol and a group `a` at each article slot."""
    parts = []
    for x in loosened(items):
        if not isinstance(x, str):
            parts.append(f"(?:{pattern(x[1], code)})" + {"r": "+", "o": "?", "*": "*"}[x[0]])
            continue
        name = x if x[0] != SLOT else TEXT + x[1:]
        char = code.setdefault(name, chr(FIRST_CODE + len(code)))
        parts.append(f"(?P<a>{char})?" if x[0] == SLOT else f"{char}?" if x[0] == TEXT else char)
    return "".join(parts)


def infer(pages: list[str]) -> dict:
    """The wrapper of one host's sample pages: pattern, symbols, main container, texts that most pages repeat, spared containers."""
    streams = [lex(p) for p in pages]
    spared = spare(streams)
    mass: Counter[Path] = Counter()
    seen: Counter[str] = Counter()
    found = []
    for stream in streams:
        mine = [(path, block_text(raw)) for path, other, raw in blocks(stream, spared) if not other]
        seen.update({t for _, t in mine})
        found.append(mine)
    fixed = {t for t, n in seen.items() if n >= 3 and 2 * n > len(streams)}
    every = [t for mine in found for _, t in mine]
    if 2 * sum(len(t) for t in every if t in fixed) > sum(map(len, every)):
        fixed = set()  # near copies of one page, not boilerplate
    for mine in found:
        for path, text in mine:
            if text not in fixed:
                for k in range(1, len(path) + 1):
                    mass[path[:k]] += len(text)
    total = max((n for path, n in mass.items() if len(path) == 1), default=0)
    best: Path = ()
    for path, n in mass.items():
        leaf = path[-1][1:].split(" ")[0] in ENDS or re.match(r"<h\d", path[-1])
        if not leaf and n >= 0.8 * total and (len(path), n) > (len(best), mass[best]):
            best = path
    for k, symbol in enumerate(best):  # an article element is the main container, whatever it holds
        if symbol[1:].split(" ")[0] == "article":
            best = best[: k + 1]
            break
    rules = Rules(best, frozenset(fixed), spared)
    wrapper: list = []
    for k, stream in enumerate(streams):
        told = iter(zip(rules.names(stream), rules.article(stream), strict=True))
        items = []
        for symbol, _ in stream:
            if symbol == TEXT:
                name, mine = next(told)
                items.append(SLOT + name[1:] if mine else name)
            elif symbol != "<br":
                items.append(symbol)
        items = fold_repeats(repeatable(items))
        wrapper = align(wrapper, items) if k else items
    code: dict[str, str] = {}
    try:
        expression = pattern(wrapper, code)
    except ValueError:  # more symbols than characters
        expression, code = "", {}
    spec = {"pattern": expression if FIRST_CODE + len(code) <= LAST_CODE else "", "code": code, "main": list(best)}
    return spec | {"fixed": sorted(fixed), "spared": sorted(map(list, spared))}


class Rules:
    """Which texts of a stream are of the article, by container and elements alone."""

    def __init__(self, main: Path, fixed: frozenset[str], spared: frozenset[Path] = frozenset()) -> None:
        self.main, self.fixed, self.spared = main, fixed, spared
        self.in_article = any(x[1:].split(" ")[0] == "article" for x in main)
        if self.in_article:
            self.fixed = frozenset()  # a text inside an article may be repeated

    def repeated(self, raw: str) -> bool:
        return bool(self.fixed) and block_text(raw) in self.fixed

    def names(self, stream: list[tuple[str, str]]) -> list[str]:
        """The symbol of each text: its containers, and whether most sample pages repeat it."""
        return [f"{TEXT}{'!' * self.repeated(raw)}{' '.join(path)}" for path, _, raw in blocks(stream)]

    def article(self, stream: list[tuple[str, str]], spared: frozenset[Path] | None = None) -> list[bool]:
        depth = len(self.main)
        parts = list(blocks(stream, self.spared if spared is None else spared))
        inside = [path[:depth] == self.main for path, _, _ in parts] if depth else [False] * len(parts)
        if not any(inside):  # another layout: its article or main element, else all of it
            inside = [any(re.match(r"<(article|main)\b", x) for x in path) for path, _, _ in parts]
            if not any(inside):
                inside = [True] * len(parts)
        return [mine and not other and not self.repeated(raw) for mine, (path, other, raw) in zip(inside, parts, strict=True)]


class Wrapper:
    def __init__(self, spec: dict) -> None:
        self.code = spec["code"]
        self.rules = Rules(tuple(spec["main"]), frozenset(spec["fixed"]), frozenset(map(tuple, spec["spared"])))
        self.pattern = regex.compile(_possessive(spec["pattern"]), regex.S) if spec["pattern"] else None

    def extract(self, page: str) -> tuple[str, bool]:
        """(main text, whether the page matches the wrapper)."""
        stream = lex(page)
        names = iter(self.rules.names(stream))
        symbols = [(next(names) if s == TEXT else s, raw) for s, raw in stream if s != "<br"]
        told = "".join(self.code.get(s, "\n") for s, _ in symbols)  # no expression matches an unknown symbol
        found = self.pattern.fullmatch(told) if self.pattern else None
        if found:  # an expression without an article slot has no group
            at = [a for a, _ in found.spans("a")] if "a" in self.pattern.groupindex else []
            raws = [symbols[k][1] for k in sorted(at)]
        else:
            texts = [raw for s, raw in stream if s == TEXT]
            kept = self.rules.article(stream)
            if not any(kept):  # a layout of its own: what it holds decides
                kept = self.rules.article(stream, self.rules.spared | spare([stream]))
            raws = [raw for raw, keep in zip(texts, kept, strict=True) if keep]
        return " ".join(t for t in map(block_text, raws) if t), bool(found)


def _possessive(expression: str) -> str:
    """Groups don't give back what they took, so a match takes one pass over the page."""
    return re.sub(r"\)([+?*])", r")\1+", expression)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def layout(page: str) -> int:
    """Hash of the folded stream."""
    items = fold_repeats([s for s, _ in lex(page) if s != "<br"])
    return xxhash.xxh3_64_intdigest(json.dumps(items)) - (1 << 63)


def layouts(pages: DataFrame) -> DataFrame:
    """page_id, host, layout and length of every page that has html, written."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(map(layout, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64()), batch.column(3)], ["page_id", "host", "layout", "length"])

    rows = pages.where("html is not null").select("page_id", host(F.col("url")).alias("host"), "html", F.length("html").cast("long").alias("length"))
    return saved(rows.mapInArrow(tell, "page_id long, host string, layout long, length long"), "layouts")


def wrappers(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """host, wrapper (JSON) of every host. Only ids are ranked; texts of the sample alone are brought together."""
    pages = pages.select("page_id", "url", "html")
    known = layouts(pages)
    counts = known.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n"))
    by_id = [F.xxhash64("page_id"), F.col("page_id")]
    rank = F.row_number().over(Window.partitionBy("host", "layout").orderBy(*by_id))
    first = known.withColumn("rank", rank).where(F.col("rank") <= sample).join(counts, ["host", "layout"])
    order = Window.partitionBy("host").orderBy("rank", F.col("n").desc(), *by_id)  # a page of each layout, frequent ones first
    chosen = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    size = F.sum("length").over(Window.partitionBy("host").orderBy("place"))  # of at most `sample` rows
    chosen = chosen.withColumn("size", size).where((F.col("size") <= SAMPLE_BYTES) | (F.col("place") == 1))
    chosen = saved(chosen.groupBy("host", F.col("page_id").alias("of")).agg(F.min("place").alias("place")), "sample")
    near, _ = split_by_keys(pages.where("html is not null"), F.col("page_id"), chosen, F.col("of"))
    same = F.col("page_id").eqNullSafe(F.col("of")) & (host(F.col("url")) == F.col("host"))
    rows = near.join(chosen, same).select("host", F.lpad(F.col("place").cast("string"), 9, "0").alias("id"), "html")

    def learn(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted({(i or "", x) for b in batches for i, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)})
        spec = json.dumps(infer(list(dict.fromkeys(x for _, x in texts[:sample]))))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([spec])], ["host", "wrapper"])

    return rows.groupBy("host").applyInArrow(learn, "host string, wrapper string")


EXTRACTED = "page_id long, url string, text string, n_chars long, matched boolean"


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per page: page_id, url, text (empty if none), n_chars, and whether it matches its host's wrapper."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        empty = {"pattern": "", "code": {}, "main": [], "fixed": [], "spared": []}
        for batch in batches:
            texts, matched = [], []
            for page, spec in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if len(known) > 500:
                    known.clear()
                spec = spec or json.dumps(empty)
                if spec not in known:
                    known[spec] = Wrapper(json.loads(spec))
                text, fits = known[spec].extract(page or "")
                texts.append(text)
                matched.append(fits)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(matched)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "matched"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    known = saved(wrappers(rows, sample), "wrappers")
    size = known.agg(F.sum(F.length("wrapper") + F.length("host")).alias("n")).first().n or 0
    known = F.broadcast(known) if size <= BROADCAST_CHARS else known
    rows = rows.withColumn("host", host(F.col("url"))).join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    return rows.mapInArrow(cut, EXTRACTED)
