"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events once. Every block boundary ends a line; a line has its text, the
tags seen in it and the element that holds it. The ratios of text outside links to tags are smoothed with a Gaussian
along the page, and a threshold, from their standard deviation, clusters the lines into content and the rest. The content
lines' text is the mass of the elements that hold them, and mass selects the content regions: the article that holds
most of it, or else the smallest element that holds all of it and a title before it, without the blocks in it that have
none. Names of tags and classes are hints only: an element so named is left out unless it holds the title or the article
and most of the mass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.common import kept, pieces, shaped, table

# fixed values: elements of HTML, and words that name what is no article
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: never text of the page, wherever they stand
HIDDEN = frozenset("audio button canvas datalist embed head iframe input map math noscript object script select style svg template textarea title video".split())
#: hints: elements that seldom hold the article
ASIDES = frozenset("aside dialog footer form menu nav search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
REGIONS = frozenset("article main body div section td center blockquote".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar sidebars aside menu menus nav navbar navigation topnav breadcrumb breadcrumbs footer foot footnav masthead topbar toolbar pagination pager comment comments commentlist discussion disqus replies respond related recommended recommendations recirc widget widgets outbrain taboola copyright legal disclaimer skip search searchbox tags tagcloud".split()
)
#: a class name that starts so says nothing about its element
DENIALS = frozenset("no not has have with without is non hide show".split())
HEADER_NAMES = frozenset("header head masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: an opening tag closes an open element of these names, up to the nearest element that may hold it
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIGMA = 1.0
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def named(value: str, words: frozenset) -> bool:
    """Whether a class or id says one of these words, as a whole name or as the first or last part of one."""
    for name in value.split():
        parts = [w.lower() for w in WORD.findall(name)]
        if parts and parts[0] not in DENIALS and (name.lower() in words or parts[0] in words or parts[-1] in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "up", "depth", "block", "hint", "gone", "header", "heading", "title", "article", "skip", "mass", "holds", "out", "inside")

    def __init__(self, tag: str, up: "Node | None", hint: bool, header: bool):
        self.tag, self.up, self.hint = tag, up, hint
        self.depth = up.depth + 1 if up else 0
        #: the nearest block, itself included
        self.block = self if up is None or tag in BLOCKS else up.block
        article = tag in ("article", "main")
        self.article = article or up is not None and up.article
        self.gone = up is not None and (up.gone or tag in HIDDEN)
        self.header = up is not None and (up.header or header)
        self.heading = not article and (tag in HEADINGS or up is not None and up.heading)
        self.title = tag == "h1" or up is not None and up.title
        #: what is left out inside a line
        self.skip = up is not None and (up.skip or self.gone or hint and tag not in BLOCKS)
        self.mass = 0.0
        self.holds = self.out = self.inside = False


class Lines(HTMLParser):
    """Parser events to lines: (text, tags, characters in links, links, node). Each event takes constant time, amortised."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = Node("", None, False, False)
        self.nodes = [self.node]
        self.open: Counter = Counter()  # open elements by tag; inline ones by their block too
        self.lines: list[tuple[str, int, int, int, Node]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.in_link = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.links, self.node))
            self.tags = self.linked = self.links = 0
        self.parts.clear()

    def key(self, node: Node):
        return node.tag if node.tag in BLOCKS else (id(node.block), node.tag)

    def leave(self, node: Node) -> None:
        """Closes open elements up to this one."""
        while self.node is not node.up:
            self.open[self.key(self.node)] -= 1
            self.node = self.node.up

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
            shut = CLOSES.get(tag, {"p"} if tag not in ("option", "optgroup") else ())
            if shut and (self.node.tag in shut or tag in CLOSES) and self.node.block.tag in shut:
                self.leave(self.node.block)
        if tag in VOID:
            return
        if tag == "a":
            self.in_link, self.links = 1, self.links + 1
        hint, header = tag in ASIDES, tag == "header"
        if attrs and tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if name in ("class", "id") and value:
                    hint = hint or named(value, NOISE)
                    header = header or tag in REGIONS and named(value, HEADER_NAMES)
                elif name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                    hint = True
        self.node = Node(tag, self.node, hint, header)
        self.nodes.append(self.node)
        self.open[self.key(self.node)] += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag == "a":
            self.in_link = 0
        # an inline end tag never closes a block: its element must stand in the same one
        if self.open[tag if tag in BLOCKS else (id(self.node.block), tag)] > 0:
            x = self.node
            while x.tag != tag:
                x = x.up
            self.leave(x)

    def handle_data(self, data):
        if self.node.skip:
            return
        self.parts.append(data)
        if self.in_link:
            self.linked += len(data)


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    radius = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str | None, sigma: float = SIGMA, ratio: Callable[[int, int], float] = lambda chars, tags: chars / max(1, tags)) -> str:
    """The article's blocks, white space inside each turned to one space, joined by newlines; empty if there is none."""
    p = Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    texts, nodes = [x[0] for x in p.lines], [x[4] for x in p.lines]
    sizes = [len(t) for t in texts]
    ratios = np.array([ratio(n - linked, tags) for n, (_, tags, linked, *_) in zip(sizes, p.lines)], float)
    weigh(p.nodes, [(nodes[k], sizes[k]) for k in content(ratios, sigma)])
    whole = p.nodes[0].mass
    for n in nodes:
        if n.title or n.article:
            n.holds = True
    for x in reversed(p.nodes):
        if x.up is not None and (x.holds or x.tag in ("article", "main")):
            x.up.holds = True
    for x in p.nodes:
        x.out = x.up is not None and (x.up.out or x.hint and not (x.holds and 2 * x.mass >= whole))
    fine = [k for k, (n, menu) in enumerate(zip(nodes, link_lists(p.lines))) if not n.out and not (n.header and not (n.article and n.heading)) and not menu]
    if not fine:
        return ""
    # once more, of what is fine: its mass selects the regions
    good = [fine[k] for k in content(ratios[fine], sigma, 0.5)]
    weigh(p.nodes, [(nodes[k], sizes[k]) for k in fine])
    text = [x.mass for x in p.nodes]
    weigh(p.nodes, [(nodes[k], sizes[k]) for k in good])
    whole = p.nodes[0].mass
    articles = [x for x in p.nodes if x.tag in ("article", "main") and 2 * x.mass >= whole]
    at = max(articles or [x for x in p.nodes if x.tag in REGIONS and x.mass == whole] or p.nodes[:1], key=lambda x: x.depth)
    under(p.nodes, at)
    titles = [k for k in fine if nodes[k].title]
    before = [k for k in titles if k < good[0]]
    if not articles and before and not any(nodes[k].holds for k in titles):
        above, x = set(), nodes[before[-1]]
        while x is not None:
            above.add(id(x))
            x = x.up
        while id(at) not in above:
            at = at.up
        under(p.nodes, at)
    for x, own in zip(p.nodes, text):  # blocks at the ends of a region that are mostly no content are cut off, but not from an article
        x.inside = x is at or x.up is not None and x.up.inside and (bool(articles) or x.up is not at or x.tag not in REGIONS or 2 * x.mass >= own)
    sure = [k for k in good if nodes[k].inside] + [k for k in titles if nodes[k].holds]
    first, last = min(sure, default=0), max(sure, default=-1)
    return "\n".join(texts[k] for k in fine if nodes[k].holds and (nodes[k].inside or first <= k <= last))


def under(nodes: list[Node], top: Node) -> None:
    """Says of each element whether it stands in this one."""
    for x in nodes:
        x.holds = x is top or x.up is not None and x.up.holds


def content(ratios: np.ndarray, sigma: float, spreads: float = 1.0) -> np.ndarray:
    """Numbers of the lines whose smoothed ratio reaches the threshold: so many standard deviations, or else the largest."""
    smoothed = smooth(ratios, sigma)
    return np.flatnonzero(smoothed >= min(spreads * smoothed.std(), smoothed.max()))


def weigh(nodes: list[Node], lines: list[tuple[Node, int]]) -> None:
    """Each element's mass: the characters of these lines in it. Parents stand before their children."""
    for x in nodes:
        x.mass = 0
    for n, chars in lines:
        n.mass += chars
    for x in reversed(nodes):
        if x.up is not None:
            x.up.mass += x.mass


def link_lists(lines: list) -> list[bool]:
    """Lines that are menus: lines of several links and little else, and runs of three or more lines that are a link each."""
    alone = [linked >= 0.9 * len(text) for text, _, linked, _, _ in lines]
    out = [links >= 3 and linked >= 0.7 * len(text) for text, _, linked, links, _ in lines]
    k = 0
    while k < len(lines):
        j = k
        while j < len(lines) and alone[j]:
            j += 1
        if j - k >= 3:
            out[k:j] = [True] * (j - k)
        k = max(j, k + 1)
    return out


OUTPUTS = "text string, n_chars long"


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is the html; the others are kept."""
    for whole in batches:
        for batch in pieces(whole, whole.num_columns - 1):
            out = [main_text(x) for x in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])


def extract_text(pages: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, text and n_chars (code points) of each row of pages, from its whole html.

    Null or empty html, and pages without an article, give an empty text. Rows are taken one by one: repeated rows and
    ties change nothing; kept columns named as an output are replaced, other columns are not read. No shuffle.
    """
    keep = kept(keep, OUTPUTS)
    return pages.select(*keep, F.col("html").alias("_html")).mapInArrow(extract, shaped(pages, keep, OUTPUTS))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
