"""HTML extraction: a page becomes a flat list of text blocks, and a decision tree on each block and its neighbours says which are the article.

A block is text between block-level tags or doubled line breaks. What the tree
sees of it: its words, the share of them in links, the same two of the blocks
before and after it, its kind (heading, paragraph, item, control), the regions that
it is in, by elements and by words in their class, id and role, and whether the page
names its article or its surroundings so at all. The tree is grown
in numpy from the pages of `labelled_blocks`, a bounded table; pages of one's own
with labelled blocks can be given instead.

Pages are independent: each task reads its pages whole and answers them one by
one, so nothing is shuffled.

Cases: a null or empty page has an empty text, as has one without any block that
is taken for the article; bytes that are no UTF-8 and references to no character
become U+FFFD; tags that are never closed, closed twice or out of order are read
as far as they go, a tag or comment that never ends takes the rest of the page;
pages of any length are read whole, in time that grows with the length; white
space is what Unicode calls so, no-break spaces included; rows that repeat are
answered each; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_blocks import LABELLED

# Names of HTML's elements, by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
UNREAD = frozenset("script style iframe noembed noframes noscript title textarea template svg object audio video canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th".split())
PARAGRAPHS = frozenset("p blockquote pre figcaption".split())
CONTROLS = frozenset("button label legend option select summary".split())
# An element with an optional end: which open ones it ends, and inside of which only.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table")}
ENDS = {k: (a.split(), b.split()) for k, (a, b) in ENDS.items()}
CELLS, TABLE = ("td", "th", "table", "caption"), frozenset("table tbody thead tfoot tr td th caption".split())

#: Words of class, id and role that name what is not the article, its page's or its own heading, and the article.
AROUND = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot sidebar aside widget widgets ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert banner popup modal overlay dialog newsletter subscribe subscription signup login search share sharing social related recommended recommendations trending popular comment comments reply replies respond disqus discussion pagination pager toolbar copyright disclaimer skip paywall complementary contentinfo".split())
HEADER = frozenset("header masthead heading head".split())
ARTICLE = frozenset("article articlebody main content post entry story body text prose".split())
#: With one of these, the other words describe the page's arrangement.
ARRANGED = frozenset("with has no layout columns".split())

TOKEN = re.compile(r"<(?:(!--)(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|/[^>]*(?:>|\Z)|([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z))", re.S)
NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|style|hidden|aria-hidden|href)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.I)
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after", "heading", "item", "control", "paragraph", "in_article", "around", "in_header", "in_form", "article_named", "surroundings_named")


@dataclass
class Block:
    text: str
    words: int
    linked: float
    heading: bool
    item: bool
    control: bool
    paragraph: bool
    region: tuple[int, int, int, int]


def hints(attributes: str) -> tuple[set[str], bool, bool]:
    """Words of class, id, role and itemprop, whether the element is hidden, whether it links."""
    words: set[str] = set()
    hidden = links = False
    for name, *values in NAMED.findall(attributes):
        name, value = name.lower(), unescape("".join(values))
        if name == "href":
            links = True
        elif name == "style":
            hidden |= bool(HIDES.search(value))
        elif name == "hidden":
            hidden |= value.lower() != "until-found"
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            words.update(w for part in value.split() for w in re.split("[^a-z0-9]+", f"{part} {HUMP.sub(' ', part)}".lower()))
    return words, hidden, links


def region(name: str, attributes: str, outer: tuple[int, int, int, int]) -> tuple[tuple[int, int, int, int], bool]:
    """(in article, around it, in a header, in a form) inside an element, and whether the element is a link."""
    words, hidden, links = hints(attributes) if attributes and not attributes.isspace() else (set(), False, False)
    if name in ("html", "body") or words & ARRANGED:
        words = set()
    article, around, header, form = outer
    if name == "main" or "articlebody" in words:
        return (1, 0, 0, 0), links
    if hidden or name in ("nav", "aside", "footer", "dialog", "menu", "search") or words & AROUND:
        around = 1
    elif name == "article" or words & ARTICLE:
        if not around:
            article, header, form = 1, 0, 0
    elif name == "header" or words & HEADER:
        header = 1
    elif name == "form":
        form = 1
    return (article, around, header, form), links


class Page:
    """The open elements while a page is read, and the blocks so far."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.regions = [(0, 0, 0, 0)]
        self.at: dict[str, list[int]] = defaultdict(list)  # of each name, where it is open
        self.last_block = [-1]  # of each open element, the last block-level one up to it
        self.links = 0
        self.link_at: list[bool] = []
        self.parts: list[str] = []
        self.linked: list[bool] = []
        self.kind = ""
        self.broken = False  # a line break came last
        self.blocks: list[Block] = []

    def say(self, text: str) -> None:
        if not text.isspace():
            self.broken = False
        self.parts.append(unescape(text) if "&" in text else text)
        self.linked.append(self.links > 0)

    def flush(self) -> None:
        self.broken = False
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                words = text.count(" ") + 1
                in_links = sum(len(p.split()) for p, k in zip(self.parts, self.linked, strict=True) if k)
                kinds = self.kind
                self.blocks.append(Block(text, words, min(1.0, in_links / words), kinds in HEADINGS, kinds in ITEMS or bool(self.at["li"]), kinds in CONTROLS, kinds in PARAGRAPHS, self.regions[-1]))
            self.parts, self.linked = [], []

    def open(self, name: str, attributes: str) -> None:
        inside, links = region(name, attributes, self.regions[-1])
        n = len(self.names)
        self.at[name].append(n)
        self.names.append(name)
        self.regions.append(inside)
        self.last_block.append(n if name in BLOCK else self.last_block[-1])
        links = links and name == "a"
        self.link_at.append(links)
        self.links += links

    def close_to(self, n: int) -> None:
        while len(self.names) > n:
            self.at[self.names.pop()].pop()
            self.regions.pop()
            self.last_block.pop()
            self.links -= self.link_at.pop()
        self.kind = self.names[self.last_block[-1]] if self.last_block[-1] >= 0 else ""

    def innermost(self, names: Iterable[str]) -> int:
        return max((self.at[x][-1] for x in names if self.at[x]), default=-1)

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            if self.broken:
                self.flush()
            self.say("\n")
            self.broken = True
            return
        if name in BLOCK:
            self.flush()
            if self.at["p"] and self.at["p"][-1] > self.innermost(("button", *CELLS)):
                self.close_to(self.at["p"][-1])
            if name in ENDS:
                ended, within = ENDS[name]
                n = self.innermost(ended)
                if n > self.innermost(within):
                    self.close_to(n)
        elif name == "a" and self.at["a"]:
            self.end("a")
        if name not in VOID:
            self.open(name, attributes)
            if name in BLOCK:
                self.kind = name

    def end(self, name: str) -> None:
        if name in BLOCK or name == "br":
            self.flush()
        n = self.at[name][-1] if self.at[name] else -1
        if n < 0 or name not in TABLE and n < self.innermost(CELLS) or name not in BLOCK and n < self.last_block[-1]:
            if n >= 0 and name == "a":  # its end is further in than its start: the link ends
                self.links -= self.link_at[n]
                self.link_at[n] = False
            return
        self.close_to(n)


def blocks_of(html: str) -> list[Block]:
    """The page's text in blocks, in page order."""
    page, at = Page(), 0
    while True:
        token = TOKEN.search(html, at)
        if token is None:
            break
        if token.start() > at:
            page.say(html[at : token.start()])
        at = token.end()
        ended, started = token.group(2), token.group(3)
        if ended:
            page.end(ended.lower())
        elif started:
            name = started.lower()
            if name in UNREAD and not token.group(4).endswith("/"):
                page.flush() if name in ("title", "iframe") else None
                over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = over.end() if over else len(html)
            elif name not in UNREAD:
                page.start(name, token.group(4))
    if at < len(html):
        page.say(html[at:])
    page.flush()
    return page.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block, by FEATURES."""
    own = np.array([(b.words, b.linked) for b in blocks], float).reshape(-1, 2)
    around = np.pad(own, ((1, 1), (0, 0)))
    rest = np.array([(b.heading, b.item, b.control, b.paragraph, *b.region) for b in blocks], float).reshape(-1, 8)
    page = np.broadcast_to(np.array([any(b.region[k] for b in blocks) for k in (0, 1)], float), (len(blocks), 2))
    return np.concatenate([own, around[:-2], around[2:], rest, page], axis=1)


@dataclass
class Tree:
    """Of each node: feature (-1 at a leaf), the border up to which rows go low, the two nodes below, and the share of article at a leaf."""

    feature: np.ndarray
    border: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        at = np.zeros(len(rows), np.int64)
        while len(rows):
            f = self.feature[at]
            if (f < 0).all():
                break
            goes_low = rows[np.arange(len(rows)), np.maximum(f, 0)] <= self.border[at]
            at = np.where(f < 0, at, np.where(goes_low, self.low[at], self.high[at]))
        return self.share[at]


def grow(rows: np.ndarray, labels: np.ndarray, deepest: int = 10, least: int = 2) -> Tree:
    """A tree by Gini impurity: at most `deepest` questions, and at least `least` rows on either side of each. Of equal splits the first feature and the lowest border win."""
    nodes: list[list[float]] = []

    def add(at: np.ndarray, depth: int) -> int:
        me, y = len(nodes), labels[at]
        nodes.append([-1, 0, 0, 0, float(y.mean()) if len(y) else 0.0])
        best = (1e-9, -1, 0.0)
        if depth < deepest and 0 < y.sum() < len(y):
            whole = 2 * y.mean() * (1 - y.mean())
            for f in range(rows.shape[1]):
                order = np.argsort(rows[at, f], kind="stable")
                x, ones = rows[at, f][order], np.cumsum(y[order])
                n = np.arange(1, len(y))
                a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
                gain = whole - (n * 2 * a * (1 - a) + (len(y) - n) * 2 * b * (1 - b)) / len(y)
                gain[(x[1:] <= x[:-1]) | (n < least) | (len(y) - n < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, float((x[k] + x[k + 1]) / 2))
        if best[1] >= 0:
            goes_low = rows[at, best[1]] <= best[2]
            low, high = add(at[goes_low], depth + 1), add(at[~goes_low], depth + 1)
            nodes[me][:4] = [best[1], best[2], low, high]
        return me

    add(np.arange(len(labels)), 0)
    table = np.array(nodes)
    return Tree(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4])


def labelled_rows(pages: list[list[tuple[str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages: a page is pieces of html, each with the label of the blocks that it adds."""
    rows, labels = [], []
    for pieces in pages:
        html, mine = "", []
        for piece, label in pieces:
            html += piece
            mine += [label] * (len(blocks_of(html)) - len(mine))
        rows.append(features(blocks_of(html)))
        labels += mine
    return np.concatenate(rows), np.array(labels, float)


def article_text(html: str, tree: Tree) -> str:
    """The blocks that the tree takes for the article, a line each."""
    blocks = blocks_of(html)
    chosen = tree(features(blocks)) >= 0.5
    return "\n".join(b.text for b, yes in zip(blocks, chosen, strict=True) if yes)


TEXTS = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, labelled: list[list[tuple[str, int]]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages; labelled: pages to learn the tree from, in place of the table that comes with the library."""
    tree = grow(*labelled_rows(LABELLED if labelled is None else labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = [article_text((html or b"").decode("utf-8", "replace"), tree) for html in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html")).mapInArrow(run, TEXTS)
