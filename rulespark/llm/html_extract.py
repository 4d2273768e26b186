"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page is cut into blocks: the text between the starts and ends of block elements. A linear classifier over a block's words, links,
marks, tags and containers gives each a cost for either label; the costs are terminal capacities, and smoothness edges join blocks that
follow each other (the wider apart in the DOM, the weaker) and blocks with the containers that hold them. The maximum flow separates content
from boilerplate at the least sum of costs and cut edges, so a short paragraph stays with its neighbours and an advert between two
paragraphs goes. Blocks that both labels suit equally are content.

Pages are independent rows: one narrow pass in Arrow batches without a shuffle, in slices of SLICE pages. Parsing is linear in
the page's length: an unclosed comment, script or tag runs to the page's end, as browsers have it. Any block within a container of boilerplate (a nav,
footer, aside, form, advert, notice, sidebar, comments ...) counts as boilerplate, whatever the containers within say; a header is one only
outside of articles. Defined cases: null and empty html give an empty text; repeated rows each give a row; other columns are ignored;
white space is what Unicode says, the no-break space included; a br is white space; nothing is decoded twice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._text import read, trim

SLICE = 64
# The classifier's weights: positive for content. Capacities are whole numbers.
BIAS, LINKS, LENGTH, LONG_WORDS, SENTENCE, INSIDE, NAMED, OUTSIDE, HARD = -6, -24, 16, 40, 6, 40, 30, -16, -120
BY_TAG = {"p": 6, "blockquote": 6, "pre": 6, "h1": 6, "li": -4, "td": -2, "th": -2}
# Smoothness: between neighbours with a common parent, and between a block and its container, a container and the next one.
NEXT, HOLDS, NESTS = 8, 2, 1
# HTML elements that break text into blocks, that have no end, and whose content is no text of the page.
BREAKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
SILENT = RAW | set("head object svg math template canvas audio video datalist".split())
# Elements, roles and words in class or id that mark boilerplate or content.
OFF_TAGS = set("nav footer aside form menu dialog select button noscript search".split())
ON_TAGS = {"article", "main"}
OFF_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
OFF_WORDS = set(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright discussion disqus "
    "feedback footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription toolbar topbar trending widget widgets".split()
)
HEADER_WORDS = {"header"}
ON_WORDS = set("article articlebody content entry maincontent post story".split())
TURNED = {"has", "no", "with", "without", "not", "is"}
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*|(?=>)))?)?)?")
SENTENCES = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")


@dataclass(slots=True)
class Node:
    """An element: its parent, depth, the nearest block element, and what it says of all that is within it."""

    tag: str
    parent: Node | None
    depth: int
    holder: Node | None = None
    off: bool = False
    on: int = 0  # INSIDE an article, or within what a class names one
    silent: bool = False
    link: bool = False


@dataclass(slots=True)
class Block:
    node: Node
    parts: list = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _words(value: str) -> list[str]:
    return [w.lower() for w in WORD.findall(value)]


def element(tag: str, attrs: dict[str, str], parent: Node) -> Node:
    """An element with what it and those around it say."""
    words = _words(attrs.get("class", "")) + _words(attrs.get("id", ""))
    told = {w for before, w in zip(["", *words], words, strict=False) if before not in TURNED}
    role = attrs.get("role", "").lower()
    on = INSIDE * (tag in ON_TAGS or role in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower())
    off = tag in OFF_TAGS or role in OFF_ROLES
    if tag not in ("html", "body", "main"):
        off |= bool(told & OFF_WORDS) or ((tag == "header" or bool(told & HEADER_WORDS)) and not parent.on and not on)
        on = on or NAMED * bool(told & ON_WORDS)
    node = Node(tag, parent, parent.depth + 1, None, parent.off or off, max(parent.on, 0 if off else on), parent.silent or tag in SILENT, parent.link or tag == "a")
    node.holder = node if tag in BREAKS else parent.holder or parent
    return node


class Parser:
    """The blocks of a page, with the elements around them."""

    def __init__(self, html: str):
        self.html, self.root = html, Node("", None, 0)
        self.stack, self.open, self.scopes = [self.root], Counter(), []
        self.at_p: int | None = None  # where an open paragraph stands; only inline elements stand above it
        self.blocks: list[Block] = []
        self.block: Block | None = None
        self.side: Block | None = None  # what inline elements of boilerplate hold within the block
        self.any_on = False

    def run(self) -> list[Block]:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            at = self.markup(lt)
        for b in self.blocks:
            b.text = " ".join("".join(b.parts).split())
        return [b for b in self.blocks if b.text]

    def markup(self, at: int) -> int:
        """What stands at a `<`; returns where it ends."""
        html = self.html
        if html.startswith("<!--", at):
            if html.startswith((">", "->"), at + 4):  # an empty comment
                return html.index(">", at + 4) + 1
            return self.past("-->", at + 4)
        if html.startswith(("<!", "<?"), at):
            return self.past(">", at + 2)
        close = html.startswith("</", at)
        name = NAME.match(html, at + 1 + close)
        if not name:
            if close and at + 2 < len(html):
                return self.past(">", at + 2)  # `</` and no name: a comment
            self.text("<")
            return at + 1
        tag, attrs, end = name[0].lower(), {}, name.end()
        while not html.startswith(">", end):
            m = ATTRIBUTE.match(html, end)
            if m.end() == end:
                end += 1
            else:
                if m[1]:
                    attrs.setdefault(m[1].lower(), unescape(next((v for v in m.groups()[1:] if v is not None), "")))
                end = m.end()
            if end >= len(html):
                return len(html)
        end += 1
        if close:
            self.end(tag)
            return end
        self.start(tag, attrs)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, end)
            return stop.start() if stop else len(html)
        return end

    def past(self, mark: str, at: int) -> int:
        found = self.html.find(mark, at)
        return len(self.html) if found < 0 else found + len(mark)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "br" or tag == "wbr":
            if tag == "br" and self.block is not None:
                self.block.parts.append(" ")
            return
        if tag in BREAKS:
            self.block = self.side = None
            if self.at_p is not None:
                self.pop(self.at_p)
            closes = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, ())
            while self.scopes and self.stack[self.scopes[-1]].tag in closes:
                self.pop(self.scopes[-1])
        if tag in VOID:
            return
        if tag == "body":
            self.end("head")
        node = element(tag, attrs, self.stack[-1])
        self.any_on |= node.on > 0
        if tag == "p":
            self.at_p = len(self.stack)
        elif tag in ("li", "ul", "ol", "menu", "dl", "dd", "dt", "table", "tr", "td", "th", "select", "option"):
            self.scopes.append(len(self.stack))
        self.stack.append(node)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BREAKS:
            self.block = self.side = None
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.pop(at)

    def pop(self, at: int) -> None:
        while len(self.stack) > at:
            self.open[self.stack.pop().tag] -= 1
        while self.scopes and self.scopes[-1] >= at:
            self.scopes.pop()
        if self.at_p is not None and self.at_p >= at:
            self.at_p = None

    def text(self, raw: str) -> None:
        node = self.stack[-1]
        if node.silent:
            return
        holder, block = node.holder or node, self.block
        aside = node.off and not holder.off
        if aside:
            block = self.side
        if block is None:
            if raw.isspace():
                return
            block = Block(node if aside else holder)
            self.blocks.append(block)
            if aside:
                self.side = block
            else:
                self.block = block
        text = unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if node.link:
            block.linked += len(text)


def cost(b: Block, any_on: bool) -> int:
    """What labelling the block boilerplate costs more than labelling it content; negative if boilerplate is cheaper."""
    if b.node.off:
        return HARD
    share = min(1.0, b.linked / len(b.text))
    words = b.text.count(" ") + 1
    out = BIAS + round(LINKS * share) + round(LENGTH * min(words, LONG_WORDS) / LONG_WORDS) + SENTENCE * bool(SENTENCES.search(b.text)) + BY_TAG.get(b.node.tag, 0)
    return out + (b.node.on or OUTSIDE * any_on)


def distance(a: Node, b: Node) -> int:
    """Steps between two elements in the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(blocks: list[Block]) -> tuple[int, list[tuple[int, int, int]]]:
    """The number of vertices, blocks first, then containers; and the smoothness edges (u, v, capacity)."""
    out, number = [], {}
    for i in range(1, len(blocks)):
        apart = distance(blocks[i - 1].node, blocks[i].node)
        out.append((i - 1, i, max(1, NEXT // max(1, apart - 1))))
    for i, b in enumerate(blocks):
        below, weight, at = i, HOLDS, b.node if b.node.tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") else b.node.parent
        while at is not None and at.parent is not None:
            known = id(at) in number
            v = number.setdefault(id(at), len(blocks) + len(number))
            out.append((below, v, weight))
            if known:
                break
            below, weight, at = v, NESTS, at.parent
    return len(blocks) + len(number), out


def minimum_cut(costs: list[int], n: int, smooth: list[tuple[int, int, int]]) -> list[bool]:
    """True for content: a labelling of the n vertices with the least sum of costs and cut edges, by a maximum flow along shortest
    paths (levels and blocking flows). Vertices beyond costs have none. Of equal labellings the one with most content."""
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def edge(u: int, v: int, there: int, back: int) -> None:
        out[u].append(len(to))
        out[v].append(len(to) + 1)
        to.extend((v, u))
        room.extend((there, back))

    for v, c in enumerate(costs):
        if c > 0:
            edge(source, v, c, 0)
        elif c < 0:
            edge(v, sink, -c, 0)
    for u, v, w in smooth:
        edge(u, v, w, w)
    while True:
        level, line = [-1] * (n + 2), [source]
        level[source] = 0
        for u in line:
            for e in out[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    line.append(to[e])
            if level[sink] >= 0:
                break
        if level[sink] < 0:
            break
        left, path, u = [len(x) for x in out], [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                cut = 0
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if not room[e] and not cut:
                        cut = k + 1
                del path[cut - 1 :]
                u = to[path[-1]] if path else source
                continue
            while left[u]:
                e = out[u][left[u] - 1]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                left[u] -= 1
            if left[u]:
                path.append(e)
                u = to[e]
            elif path:
                path.pop()
                u = to[path[-1]] if path else source
                left[u] -= 1
            else:
                break
    # Boilerplate is what still has a way to the sink.
    lost, line = [False] * (n + 2), [sink]
    lost[sink] = True
    for u in line:
        for e in out[u]:
            if room[e ^ 1] and not lost[to[e]]:
                lost[to[e]] = True
                line.append(to[e])
    return [not x for x in lost[:n]]


def labelled(html: str | None) -> tuple[list[Block], list[bool]]:
    """The blocks of a page with a text, and which of them are content."""
    page = Parser(html or "")
    blocks = page.run()
    if not blocks:
        return [], []
    n, smooth = edges(blocks)
    return blocks, minimum_cut([cost(b, page.any_on) for b in blocks], n, smooth)[: len(blocks)]


def main_text(html: str | None) -> tuple[str, int, int]:
    """(text, blocks, blocks of content) of a page."""
    blocks, keep = labelled(html)
    kept = [b.text for b, k in zip(blocks, keep, strict=True) if k]
    return "\n\n".join(kept), len(blocks), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for each row of pages."""
    kinds = dict(pages.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                got = [main_text(h) for h in rows.column(2).to_pylist()]
                texts, counts = pa.array([t for t, _, _ in got], pa.string()), [pa.array([f(x) for x in got], pa.int64()) for f in (lambda x: len(x[0]), lambda x: x[1], lambda x: x[2])]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), texts, *counts], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])
            trim()

    return pages.select("page_id", "url", "html").mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_kept long")


def op11_mincut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
