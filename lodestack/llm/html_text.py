"""Operator 2: main text of web pages from a flat list of text blocks.

A page is cut into blocks at block-level tags. Each block is described by its word count and link density, by
those of its neighbours, and by flags of the regions that enclose it (elements and class names). A region is judged by
its share of the page's prose too: class names of html and body, of elements that hold all signs of an article, and of
elements that hold most of a page's prose while no sign lies elsewhere, describe a layout and aren't regions. A decision
tree, grown on the blocks of a small labelled table (``labelled_pages``), says which blocks belong to the article.
"""

from __future__ import annotations

import html as entities
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestack.llm.html_labels import labelled_pages
from lodestack.llm.tables import extended, pieces

# Fixed values of HTML: elements by role.
#: Their content isn't markup. Code is dropped to the end of the page if it isn't closed, the others hide nothing then.
CODE = {"script", "style"}
RAW = CODE | {"noscript", "template", "textarea", "iframe", "xmp", "noembed", "noframes", "title"}
#: Shown as graphics or not at all; a block element inside ends them, as browsers do.
UNSEEN = {"svg", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "label", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ITEMS = {"li", "dd", "dt"}
#: Elements that end when their like begins.
SIBLINGS = {"li", "dt", "dd", "option", "tr", "td", "th"}
#: What may stand in the head; anything else ends it.
IN_HEAD = {"html", "head", "title", "base", "link", "meta", "script", "style", "noscript", "template"}
#: Their class names describe the page, not a region.
WHOLE = {"html", "body"}
#: Words after these name a part that the element has or lacks, not the element.
HAVING = {"has", "with", "no", "without"}
#: Enclosing elements and the words of class, id and role names that hint at each region.
ZONES = {
    "menu": ({"nav", "menu", "dir"}, ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "toolbar", "skip", "sitemap")),
    "edge": ({"footer"}, ("footer", "copyright", "colophon", "legal", "masthead", "topbar", "banner", "contentinfo", "credits")),
    "header": ({"header"}, ("header",)),
    "side": ({"aside"}, ("sidebar", "side", "aside", "rail", "complementary", "widget", "related", "recommended", "trending", "popular", "teaser", "promo", "more", "also")),
    "notice": ({"dialog"}, ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "privacy", "disclaimer", "toast")),
    "advert": (set(), ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "adsense", "dfp", "promotion", "promoted", "outbrain", "taboola", "commercial")),
    "form": ({"form", "button", "select", "option", "label", "fieldset", "legend"}, ("form", "login", "search", "searchbox", "contact", "signin", "register")),
    "comment": (set(), ("comment", "comments", "discussion", "reply", "replies", "disqus", "respond", "thread", "feedback")),
    "share": (set(), ("share", "sharing", "social", "follow", "tags")),
    "article": ({"article", "main"}, ("article", "content", "post", "entry", "main", "story", "body", "text")),
}
#: An article element's own class names are often the topics it is filed under; these zones alone are believed.
OF_ARTICLE = {"article", "comment", "side", "advert"}
#: An element with this share of a page's words and with all signs of an article is a layout, not a region.
LAYOUT = 0.25
#: Without signs, an element known by its class names alone is one if it has this share of the prose, and so many words of it.
MOST_PROSE, LEAST_PROSE = 0.6, 30
#: Headings there name the site, and are no sign of an article.
OF_SITE = {"header", "edge", "menu"}
_ZONE_ELEMENTS = {e: z for z, (elements, _) in ZONES.items() for e in elements}
_ZONE_WORDS = {w: z for z, (_, words) in ZONES.items() for w in words}
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "in_list", "hidden", "other_zones", *ZONES)

#: Comments, declarations and tags; an attribute's value may hold >. Each alternative of the loop takes what no other can.
_TAG = regex.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*'|["']?[^\s>]*)|[^=>]+)*+)(?:>|\Z)""", regex.S)
_NAMED = regex.compile(r"""(?<![\w-])(class|id|role|hidden|href|style|aria-hidden)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", regex.I)
_CLOSED = regex.compile(r"""(?:^|[\s"'])/\s*$""")
_INVISIBLE = regex.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", regex.I)
_PARTS = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+|\s+")
_SPACE = regex.compile(r"\s+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")


class Region:
    """An element that has zones. Its parent is the innermost such element around it."""

    __slots__ = ("alone", "by_name", "over", "own", "parent", "prose", "sign", "signs", "words", "zones")

    def __init__(self, parent: Region | None, own: frozenset[str], alone: bool, by_name: bool):
        self.parent, self.own, self.alone, self.by_name = parent, own, alone, by_name
        self.over = False
        self.sign = own == {"article"}
        self.words = self.prose = self.signs = 0
        self.zones: frozenset[str] = frozenset()


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: bool
    in_list: bool
    hidden: bool
    region: Region | None
    zones: frozenset[str] = frozenset()


@lru_cache(10_000)
def _zone(word: str) -> str | None:
    """A known word's zone; a compound like commentlist counts as the longest known word that begins it."""
    word = word.lower()
    if word in _ZONE_WORDS:
        return _ZONE_WORDS[word]
    begun = [w for w in _ZONE_WORDS if len(w) >= 6 and word.startswith(w)]
    return _ZONE_WORDS[max(begun, key=len)] if begun else None


def _named_zones(value: str) -> set[str]:
    zones, skip = set(), False
    for word in _PARTS.findall(value):
        if word.isspace():
            skip = False
        elif word.lower() in HAVING:
            skip = True
        elif not skip and (z := _zone(word)):
            zones.add(z)
    return zones


def _attributes(raw: str) -> tuple[set[str], bool, bool]:
    """Zones that an element's class, id and role name, whether it is hidden, and whether it has an address."""
    zones, hidden, linked = set(), False, False
    for name, a, b, c in _NAMED.findall(raw):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            zones |= _named_zones(value)
        elif name == "href":
            linked = True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _INVISIBLE.search(value):
            hidden = True
    return zones, hidden, linked


class _Open:
    """The open elements: their states are counted when pushed and popped, so that depth costs nothing."""

    def __init__(self):
        self.stack: list[tuple | None] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.regions: list[Region] = []
        self.hidden = self.links = self.headings = self.items = self.unseen = 0

    def push(self, name: str, own: frozenset[str], hides: bool, linked: bool, by_name: bool = True) -> None:
        region = None
        if own:
            region = Region(self.regions[-1] if self.regions else None, own, name == "main", by_name)
            self.regions.append(region)
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, region, hides, linked))
        self._count(name, hides, linked, 1)

    def _count(self, name: str, hides: bool, linked: bool, by: int) -> None:
        self.hidden += by * hides
        self.links += by * linked
        self.headings += by * (name in HEADINGS)
        self.items += by * (name in ITEMS)
        self.unseen += by * (name in UNSEEN or name == "head")

    def remove(self, i: int) -> None:
        """Close element i alone; it is the innermost of its name."""
        name, region, hides, linked = self.stack[i]
        self.stack[i] = None
        self.at[name].pop()
        if name in BLOCK:
            self.blocks.pop()
        if region:
            region.over = True
            while self.regions and self.regions[-1].over:
                self.regions.pop()
        self._count(name, hides, linked, -1)
        while self.stack and self.stack[-1] is None:
            self.stack.pop()

    def cut(self, depth: int) -> None:
        """Close element depth and all inside it."""
        while len(self.stack) > depth:
            self.remove(len(self.stack) - 1)

    def innermost(self, name: str) -> int | None:
        found = self.at.get(name)
        return found[-1] if found else None

    def end(self, name: str) -> None:
        """An end tag closes what is open inside it, but an inline one never closes a block."""
        depth = self.innermost(name)
        if depth is not None:
            if name in BLOCK or not self.blocks or self.blocks[-1] < depth:
                self.cut(depth)
            else:
                self.remove(depth)

    def start(self, name: str) -> None:
        """Close what the start of an element implies to be over."""
        if name not in IN_HEAD and (head := self.innermost("head")) is not None:
            self.cut(head)
        if name == "a" and self.innermost("a") is not None:
            self.end("a")
        if name not in BLOCK:
            return
        inside = self.innermost("foreignobject")
        for odd in UNSEEN:
            if (depth := self.innermost(odd)) is not None and (inside is None or inside < depth):
                self.cut(depth)
        # A paragraph, and inline elements left open in it, end at the next block.
        while self.blocks and (self.stack[self.blocks[-1]][0] == "p" or self.stack[self.blocks[-1]][0] == name and name in SIBLINGS):
            self.cut(self.blocks[-1])


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; scripts, styles, comments, the head and graphics yield none.

    One pass over the tags; work is linear in the page however deep its elements lie. Text of formulas (math),
    and the text that stands in for objects and canvases, belongs to the block around it.
    """
    out: list[Block] = []
    open_ = _Open()
    regions: list[Region] = []
    parts: list[tuple[str, bool, bool]] = []
    endless: set[str] = set()
    loose = 0  # headings outside all regions

    def close() -> None:
        shown = [x for x in parts if not x[2]]
        hidden = not any(p.strip() for p, _, _ in shown)
        used = parts if hidden else shown  # hidden words of a block that is seen are left out
        text = _SPACE.sub(" ", "".join(p for p, _, _ in used)).strip()
        if text:
            linked = sum(len(p.strip()) for p, in_link, _ in used if in_link)
            out.append(Block(text, len(_WORD.findall(text)), min(1.0, linked / len(text)), open_.headings > 0, open_.items > 0, hidden, open_.regions[-1] if open_.regions else None))
            if out[-1].region:
                out[-1].region.words += out[-1].words
                out[-1].region.prose += _prose(out[-1])
        parts.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else n]
        if text and not open_.unseen:
            parts.append((entities.unescape(text), open_.links > 0, open_.hidden > 0))
        if not m:
            break
        at = m.end()
        name = (m[1] or "").lower()
        if not name:
            continue
        if page.startswith("</", m.start()):
            if name in BLOCK:
                close()
            open_.end(name)
            continue
        closed = _CLOSED.search(m[2]) is not None
        if name in RAW and not (name == "title" and open_.unseen and open_.innermost("head") is None):
            if not closed:
                end = None if name in endless else regex.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", regex.I).search(page, at)
                if end:
                    at = end.end()
                elif name in CODE:
                    break
                else:
                    endless.add(name)
            continue
        if name in BLOCK:
            close()
        elif name == "br":
            parts.append((" ", False, False))
        open_.start(name)
        if name in VOID or closed or name == "form" and open_.innermost("form") is not None:
            continue
        own, hides, linked = _attributes(m[2])
        if name in WHOLE:
            own, hides = set(), False
        if name in ("article", "main"):
            own &= OF_ARTICLE
        by_name = name not in _ZONE_ELEMENTS or _ZONE_ELEMENTS[name] == "form"
        if name in _ZONE_ELEMENTS:
            own.add(_ZONE_ELEMENTS[name])
        before = len(open_.regions)
        open_.push(name, frozenset(own), hides, linked and name == "a", by_name)
        if len(open_.regions) > before:
            regions.append(open_.regions[-1])
        if own == {"article"} or name == "h1" and not (open_.regions and open_.regions[-1].own & OF_SITE):
            if open_.regions:
                open_.regions[-1].signs += 1
            else:
                loose += 1
    close()
    _place(out, regions, loose)
    return out


def _prose(b: Block) -> int:
    return b.words if b.links < 0.5 and not b.hidden else 0


def _place(found: list[Block], regions: list[Region], loose: int) -> None:
    """Give each block its zones. regions has parents before children."""
    for r in reversed(regions):
        if r.parent:
            r.parent.words += r.words
            r.parent.prose += r.prose
            r.parent.signs += r.signs
    words, prose = sum(b.words for b in found), sum(map(_prose, found))
    signs = loose + sum(r.signs for r in regions if r.parent is None)
    above: dict[int, int] = {}  # signs that the regions around one are themselves
    for r in regions:
        around = r.parent.zones if r.parent and not r.alone else frozenset()
        above[id(r)] = above[id(r.parent)] + r.parent.sign if r.parent else 0
        elsewhere = signs - r.signs - above[id(r)]
        most = r.prose >= LEAST_PROSE and r.prose >= MOST_PROSE * prose
        layout = not elsewhere and (r.signs and r.words >= LAYOUT * words or r.by_name and most)
        r.zones = around | (r.own & {"article"} if layout else r.own)
    for b in found:
        b.zones = b.region.zones if b.region else frozenset()


def features(found: list[Block]) -> np.ndarray:
    rows = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        rows[i] = [
            min(b.words, 100), b.links, min(before.words, 100) if before else 0, before.links if before else 1, min(after.words, 100) if after else 0, after.links if after else 1,
            b.heading, b.in_list, b.hidden, len(b.zones - {"article"}), *(z in b.zones for z in ZONES),
        ]
    return rows


@dataclass
class Node:
    keep: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 8) -> Node:
    """A binary tree by the Gini index; ties go to the earlier feature and the lower cut."""
    node = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return node
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, kept = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cuts = np.flatnonzero((values[1:] > values[:-1]) & (n[:-1] >= least) & (n[:-1] <= len(y) - least))
        if not len(cuts):
            continue
        a, na = kept[cuts], n[cuts]
        b, nb = kept[-1] - a, len(y) - na
        cost = a * (na - a) / na + b * (nb - b) / nb
        i = int(np.argmin(cost))
        if best is None or cost[i] < best[0] - 1e-12:
            best = cost[i], f, (values[cuts[i]] + values[cuts[i] + 1]) / 2
    if best is None:
        return node
    _, node.feature, node.cut = best
    low = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def judge(node: Node, row: np.ndarray) -> bool:
    while node.low is not None:
        node = node.low if row[node.feature] <= node.cut else node.high
    return node.keep


@cache
def tree() -> Node:
    """Grown on all labelled pages: their number is a parameter of labelled_pages and doesn't depend on the input."""
    xs, ys = [], []
    for page, main in labelled_pages():
        found = blocks(page)
        xs.append(features(found))
        ys.append(np.array([b.text in main for b in found], bool))
    return grow(np.concatenate(xs), np.concatenate(ys))


def main_text(page: str) -> str:
    found = blocks(page)
    root, rows = tree(), features(found)
    return "\n\n".join(b.text for b, row in zip(found, rows, strict=True) if judge(root, row))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages' columns but html, with text and n_chars (code points) added.

    No shuffle; each page alone and whole: work is linear in its length, however long it is and however deep its
    elements lie. Null and empty pages have the empty text; repeated rows stay; an empty table gives an empty
    table. Columns named text or n_chars are replaced.
    """
    own = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    pages = pages.select(*[pages[c] for c in own], pages[html].alias("_html"))
    schema = extended(T.StructType(pages.schema.fields[:-1]), text=T.StringType(), n_chars=T.LongType())

    def run(batches):
        for batch in batches:
            for rows, raw in pieces(batch, "_html"):
                texts = [main_text(p.decode()) for p in raw]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*own, "text", "n_chars"])

    return pages.mapInArrow(run, schema)
