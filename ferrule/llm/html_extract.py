"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of block elements. For each path the text length
without links and the punctuation of its blocks are summed; both, over the number of blocks, are ratios that are high
for running text and low for menus and notices. The ratios are smoothed over the neighbouring blocks, by how near they
are in the tree, and fused by the root of their product. What tags, roles, class and id names say enters as a factor of the path, as
does a headline in one of its elements; no name drops anything by itself. Paths above a threshold (a share of the page's
weighted mean), and those with much of the page's weight in sentences, are content.

The blocks of content paths are the article, completed by what the paths cannot show: within the lowest element that
holds most of the content, blocks between its first and last (lists, captions, short lines) that are no menu and whose
names do not set them apart; and headings right before content. Work is linear in the page, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ferrule.llm.common import text_slices

#: Quotes count only around a whole value; other ones belong to a value without quotes and end with their tag.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|[^>])*+)(>|\Z)",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Their content is not text. An unclosed one of the first kind reaches to the page's end.
SWALLOW = frozenset("script style textarea xmp".split())
RAW = SWALLOW | frozenset("noscript template title svg math iframe object canvas noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul head button label legend".split())
CLOSES_P = BLOCK - {"body", "html", "button", "label", "legend", "option"}
#: Elements that end at the next of their kind, but for one beyond these.
ITEMS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never the container of an article by itself.
PARTS = HEADINGS | frozenset("p pre blockquote figure figcaption caption ul ol dl li dt dd table tbody thead tfoot tr td th details summary".split())

#: Factors of a path for an element in it.
ASIDE, MARKED, NAMED = 0.002, 0.05, 2.0
TAGS = dict.fromkeys("nav footer aside menu dialog search button select option label fieldset legend".split(), ASIDE) | {"header": 0.02, "form": 0.1, "article": NAMED, "main": NAMED}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar alert".split())
#: A class or id name marks furniture if it is one of these words, or a compound of at least one and of QUALIFIERS only.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising adbox adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promoted promotion recommended related reply replies respond share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
QUALIFIERS = frozenset(
    "area author bar block body bottom box btn buttons card cards center container count desktop first form global google icon icons inner inline item items last left links list main media mobile module of page panel post posts primary right secondary section side site slot small sticky text thread title top unit wrap wrapper".split()
)
#: Marks that weigh more: the text may read like the article's.
ASIDES = frozenset(
    "ad ads adv advert advertisement adverts advertising adbox adsense comment comments commentlist consent cookie cookies copyright disclaimer disqus gdpr login newsletter related reply replies respond share sharing shares sponsor sponsored".split()
)
PUNCTUATION = re.compile("[.,;:!?…、。，！？؟।]")
#: Text straight in a div or the like; an element with a headline in it; with one that is the page's title or its start.
LOOSE, HEADED, TITLED = 0.5, 4.0, 32.0
#: Blocks to each side; threshold over the mean; least score; weight of a path that is content whatever its score;
#: share of the content that its container holds; a heading is kept if at most NEAR blocks lie between it and content.
SMOOTH, SHARE, FLOOR, LARGE, MOST, NEAR = 2, 0.4, 0.12, 0.25, 0.8, 2


@dataclass(slots=True)
class Node:
    """An element: its place in page order, path, factor of the names on the way to it, and of a headline in it."""

    tag: str
    parent: int
    depth: int
    path: int
    factor: float
    article: bool
    headed: float = 1.0


@dataclass(slots=True)
class Block:
    """A run of text: its element, length of link text, depth of the lowest element around it and the one before."""

    node: int
    text: str
    links: int
    shared: int
    path: int
    factor: float


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for a in ATTR.finditer(text):
        value = a[2] or ""
        out.setdefault(a[1].lower(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value)
    return out


def _mark(attrs: dict[str, str], heading: bool) -> float:
    """The factor of an element's class and id names, role and visibility. A heading may be called a header."""
    found = 1.0
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(w) > 1]
        if MARKS.intersection(words) and all(w in MARKS or w in QUALIFIERS for w in words):
            if ASIDES.intersection(words):
                found = min(found, 0.01)
            elif not heading:
                found = min(found, MARKED)
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        found = min(found, ASIDE)
    return found


class _Reader:
    """One pass over a page: ``nodes`` in page order, ``blocks``."""

    def __init__(self, page: str) -> None:
        self.nodes = [Node("", -1, 0, 0, 1.0, False)]
        self.blocks: list[Block] = []
        self.title = ""
        self._stack, self._open = [0], {}
        self._paths: dict[tuple, int] = {}
        self._run: list[str] = []
        self._links = self._flagged = self._low = 0
        self._in_link: list[float] = []  # factors of the open links
        self._unclosed: set[str] = set()
        self._read(page)
        self._flush()

    def _path(self, up: int, label: tuple) -> int:
        return self._paths.setdefault((up, *label), len(self._paths) + 1)

    def _flush(self) -> None:
        text = " ".join(html.unescape("".join(self._run)).split()) if self._run else ""
        if text:
            at = self._stack[-1]
            node = self.nodes[at]
            path, factor = node.path, node.factor
            if self._flagged >= 0.8 * sum(len(x.strip()) for x in self._run):  # a marked link is all there is
                path, factor = self._path(path, ("a",)), factor * 0.01
            self.blocks.append(Block(at, text, min(self._links, len(text)), min(self._low, node.depth), path, factor))
            self._low = node.depth
        self._run.clear()
        self._links = self._flagged = 0

    def _add(self, text: str) -> None:
        if text:
            self._run.append(text)
            if self._in_link:
                self._links += len(text)
                if min(self._in_link) < 1:
                    self._flagged += len(text.strip())

    def _pop(self, down_to: int) -> None:
        self._flush()
        while len(self._stack) > down_to:
            self._open[self.nodes[self._stack.pop()].tag] -= 1
        self._low = min(self._low, self.nodes[self._stack[-1]].depth)
        self._in_link.clear()

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            if m is None:
                self._add(page[at:])
                return
            self._add(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._add(m[0][9:].removesuffix("]]>"))
            elif not m[4]:  # cut off inside a tag
                return
            elif m[1]:
                self._close(tag)
            elif tag in RAW and not (m[3].rstrip().endswith("/") and tag in ("svg", "math")):
                at = self._skip(page, tag, at)
            elif tag == "br":
                self._add(" ")
            elif tag == "hr":
                self._flush()
            elif tag not in VOID:
                self._start(tag, _attributes(m[3]) if m[3].strip(" \t\r\n/") else {})

    def _skip(self, page: str, tag: str, at: int) -> int:
        """The end of an element that holds no text."""
        end = None if tag in self._unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
        if end is None:
            self._unclosed.add(tag)
            return len(page) if tag in SWALLOW else at
        if tag == "title" and not self.title:
            self.title = " ".join(html.unescape(page[at : end.start()]).split())
        return end.end()

    def _close(self, tag: str) -> None:
        if tag == "a":
            if self._in_link:
                self._in_link.pop()
        elif self._open.get(tag):
            k = len(self._stack) - 1
            while self.nodes[self._stack[k]].tag != tag:
                k -= 1
            self._pop(k)

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        mark = _mark(attrs, tag in HEADINGS) if attrs and tag not in ("html", "body") else 1.0
        if tag == "a":
            self._in_link.append(mark)
            return
        if tag not in BLOCK and mark == 1.0:
            return
        self._flush()
        if tag in CLOSES_P and self.nodes[self._stack[-1]].tag == "p":
            self._pop(len(self._stack) - 1)
        if tag in ITEMS:
            alike, stop = ITEMS[tag]
            for k in range(len(self._stack) - 1, max(0, len(self._stack) - 64), -1):
                x = self.nodes[self._stack[k]].tag
                if x in stop:
                    break
                if x in alike:
                    self._pop(k)
                    break
        up = self.nodes[self._stack[-1]]
        own = TAGS.get(tag, 1.0)
        if own == NAMED and up.article:
            own = 1.0
        factor = max(up.factor * own * mark, 1e-30)
        name = attrs.get("class", "").split()
        self.nodes.append(Node(tag, self._stack[-1], up.depth + 1, self._path(up.path, (tag, name[0] if name else "", mark)), factor, up.article or tag in ("article", "main")))
        self._stack.append(len(self.nodes) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1


def _smooth(v: list[float], blocks: list[Block], nodes: list[Node]) -> list[float]:
    """Means over SMOOTH blocks to each side; one that is further in the tree than a sibling counts less."""
    out = []
    for i, own in enumerate(v):
        total, weight = own, 1.0
        for step in (-1, 1):
            low, depth = 1 << 30, nodes[blocks[i].node].depth
            for j in range(i + step, i + step * (SMOOTH + 1), step):
                if not 0 <= j < len(v):
                    break
                low = min(low, blocks[j + 1 if step < 0 else j].shared)
                far = depth + nodes[blocks[j].node].depth - 2 * low
                w = 1.0 / max(1, far - 1) ** 2
                total += w * v[j]
                weight += w
        out.append(total / weight)
    return out


def path_scores(page: "_Reader", ratios: bool = True) -> tuple[dict[int, float], float]:
    """The fused score of each path, and the threshold. ``ratios`` off leaves the factors alone (tests)."""
    blocks, nodes = page.blocks, page.nodes
    size: dict[int, float] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for b in blocks:
        size[b.path] = size.get(b.path, 0) + len(b.text) - b.links
        marks[b.path] = marks.get(b.path, 0) + len(PUNCTUATION.findall(b.text))
        count[b.path] = count.get(b.path, 0) + 1
    for b in blocks:  # a headline counts for all that its element holds
        x = nodes[b.node]
        if x.tag in ("h1", "h2"):
            titled = len(b.text) >= 0.5 * len(page.title) and (page.title.startswith(b.text) or b.text.startswith(page.title)) and page.title
            up = nodes[x.parent]
            up.headed = max(up.headed, TITLED if titled else HEADED if x.tag == "h1" else 1.0)
    for x in nodes[1:]:
        x.headed = max(x.headed, nodes[x.parent].headed)

    def factor(b: Block) -> float:
        x = nodes[b.node]
        return b.factor * x.headed * (1.0 if x.tag in PARTS else LOOSE)

    factors = [factor(b) for b in blocks]
    if ratios:
        length = _smooth([size[b.path] / count[b.path] for b in blocks], blocks, nodes)
        dots = _smooth([1 + marks[b.path] / count[b.path] for b in blocks], blocks, nodes)
    else:
        length = dots = [1.0] * len(blocks)
    score: dict[int, float] = {}
    weight: dict[int, float] = {}
    for b, x, y, f in zip(blocks, length, dots, factors, strict=True):
        score[b.path] = score.get(b.path, 0.0) + (x * y) ** 0.5 * f / count[b.path]
        weight[b.path] = weight.get(b.path, 0.0) + (len(b.text) - b.links) * f
    total = sum(weight.values())
    mean = sum(score[p] * weight[p] for p in score) / total if total else 0.0
    limit = max(FLOOR if ratios else 0.0, SHARE * mean)
    link = {p: 0 for p in size}
    for b in blocks:
        link[b.path] += b.links
    out = {}
    for p in score:
        if link[p] > size[p]:
            out[p] = 0.0
        elif marks[p] and weight[p] >= LARGE * total and score[p] >= FLOOR:
            out[p] = max(score[p], limit)
        else:
            out[p] = score[p]
    return out, limit


def extract(text: str | None, ratios: bool = True) -> str:
    """The article's blocks in page order, joined by two line feeds; empty if there is none."""
    page = _Reader(text or "")
    blocks, nodes = page.blocks, page.nodes
    if not blocks:
        return ""
    score, limit = path_scores(page, ratios)
    keep = [score[b.path] > 0 and score[b.path] >= limit for b in blocks]
    if not any(keep):
        return ""

    held = [0] * len(nodes)  # content in each element
    for b, yes in zip(blocks, keep, strict=True):
        held[b.node] += len(b.text) * yes
    for i in range(len(nodes) - 1, 0, -1):
        held[nodes[i].parent] += held[i]
    home = 0  # later in page order and still with most of the content: the lowest such element
    for i, x in enumerate(nodes):
        if held[i] >= MOST * held[0] and (x.parent == home or i == 0):
            home = i
    while home and nodes[home].tag in PARTS:
        home = nodes[home].parent
    inside = [False] * len(nodes)
    inside[home] = True
    for i in range(home + 1, len(nodes)):
        inside[i] = inside[nodes[i].parent]

    size: dict[int, int] = {}
    link: dict[int, int] = {}
    for b in blocks:
        size[b.path] = size.get(b.path, 0) + len(b.text)
        link[b.path] = link.get(b.path, 0) + b.links

    def menu(b: Block) -> bool:
        tag = nodes[b.node].tag
        return b.links >= 0.8 * len(b.text) and (tag not in PARTS or (link[b.path] > 0.8 * size[b.path] and tag != "p" and tag not in HEADINGS))

    least = 0.3 * nodes[home].factor
    chosen = list(keep)
    first, last = keep.index(True), len(keep) - keep[::-1].index(True)
    for i, b in enumerate(blocks):
        if not keep[i] and inside[b.node] and b.factor >= least and not menu(b):
            chosen[i] = first <= i < last or nodes[home].tag not in ("", "html", "body")
    gap = NEAR + 1
    for i in range(len(blocks) - 1, -1, -1):
        x = nodes[blocks[i].node]
        if not chosen[i] and gap <= NEAR and x.tag in HEADINGS and (blocks[i].factor >= least or (nodes[x.parent].tag == "header" and nodes[x.parent].article)):
            chosen[i] = True
        gap = 0 if chosen[i] else gap + 1
    return "\n\n".join(b.text for b, yes in zip(blocks, chosen, strict=True) if yes)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars. Null html counts as empty and gives an empty text; null ids and
    urls stay null.

    Repeated rows give repeated results; other columns are ignored; an empty table gives an empty result. One pass, no
    shuffle; memory holds one page and its blocks, and time is linear in the page.
    """
    own = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "html", 8 << 20):
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
