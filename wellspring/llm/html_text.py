"""HTML extraction: flat text blocks and a decision tree.

A page is cut into flat blocks of text at block-level tags.  Each block is described by its word count and link density,
those of its neighbours, and by what encloses it (elements and class, id or role words that name page furniture).  A
decision tree, trained here on the small labelled table ``BLOCKS``, calls each block text or furniture.  The page's text
is its text blocks in order.

What encloses a block is a weak sign, because names of layout reach over whole pages.  So an element that names furniture
does not count as such if the page's article stands in it, or if it only seems to (a form, or a compound like
right-sidebar) and holds over half of the page's words.  The page's article is, of the article and main elements with words
that do not themselves name furniture, one outside furniture if there is one, and then the one with the most words.

Scripts, styles, templates, comments and the like are markup, not blocks.  Character references are decoded once, white
space inside a block becomes one space.  Text outside any furniture is kept whole; nothing is cut or capped.

Defined cases: null or empty html gives empty text; unclosed and stray tags are accepted, and furniture that is never
closed ends where its enclosing element does; rows repeat as they do in the table; extra columns do not matter.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Fixed values of the HTML standard: elements without content, raw-text elements, and elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td"
    " textarea tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("head title".split())
FURNITURE = frozenset("nav header footer aside form button select textarea menu dialog fieldset search option label".split())
MAIN = frozenset("article main".split())
#: Words of class, id, role and label attributes that name furniture, and those that name the article.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " header masthead topbar footer bottom sidebar side aside widget related recommended recommendations comment comments commentlist disqus reply replies"
    " respond cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register form"
    " search share sharing social pagination pager toolbar contentinfo complementary skip copyright legal hidden".split()
)
GOOD_WORDS = frozenset("article articlebody main content entry post story text body maincontent".split())
#: Class words with one of these tell the state of a layout (no-sidebar, nav-closed) and name nothing.
STATES = frozenset("no not has with without is open opened closed active inactive enabled disabled visible collapsed expanded hide show on off layout fixed sticky".split())
#: Furniture that holds articles of its own.
LISTS = frozenset("comment comments commentlist disqus reply replies respond related recommended recommendations widget".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-label|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*(?:\s[^>]*)?>", re.I) for t in RAW}
_NAME = re.compile(r"[a-z]+")
_CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}


@dataclass
class Block:
    """text: decoded; words, linked: words in all and inside links; bad, good, heading: what encloses it."""

    text: str
    words: int
    linked: int
    bad: int
    good: int
    heading: int
    item: int


@dataclass(eq=False)
class Mark:
    """An element that names furniture or an article; up: the next one around it; dirty: in furniture, itself counted."""

    furniture: bool
    weak: bool
    up: Mark | None
    words: int = 0
    layout: bool = False
    dirty: bool = False


def _settle(marks: list[Mark], total: int) -> None:
    """Decide which elements are layout; marks: outer ones before inner ones, words: those not in an inner mark."""
    for x in reversed(marks):
        if x.up:
            x.up.words += x.words
    for x in marks:
        x.dirty = x.furniture or x.up is not None and x.up.dirty
    articles = [x for x in marks if not x.furniture and x.words]
    at = max(articles, key=lambda x: (not x.dirty, x.words)) if articles else None
    while at:
        at.layout, at = True, at.up
    for x in marks:
        x.layout |= x.weak and 2 * x.words > total
        x.dirty = x.furniture and not x.layout or x.up is not None and x.up.dirty


def _marks(name: str, attrs: str) -> tuple[int, int, bool]:
    """(names furniture, names the article, hidden) of one tag; furniture is 1 if it only seems to be."""
    bad, good, hidden = (1 if name == "form" else 2) * (name in FURNITURE), int(name in MAIN), False
    whole = lists = False  # a word of its own names the article; a word names furniture that holds articles
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("hidden",) or (key == "aria-hidden" and value == "true"):
                hidden = True
            elif key == "style":
                hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif key != "aria-hidden":
                for word in value.split():
                    own = set(_NAME.findall(word))
                    if own & BAD_WORDS and (key == "aria-label" or not own & STATES):
                        bad = max(bad, 1 + bool(own & LISTS or word in BAD_WORDS))
                    good |= bool(own & GOOD_WORDS)
                    lists |= bool(own & LISTS) and not own & STATES
                    whole |= key in ("class", "id") and word in GOOD_WORDS
    return 0 if bad and whole and name not in FURNITURE and not lists else bad, int(good), hidden


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, Mark | None, int, bool, bool]] = []  # name, mark around it, names the article, hidden, link
    pieces: list[tuple[str, bool]] = []
    here: Mark | None = None
    marks: list[Mark] = []
    marked: list[Mark | None] = []  # innermost mark around each block
    n_good = n_hidden = n_link = n_head = n_item = 0

    def flush() -> None:
        if not pieces:
            return
        text = " ".join(_html.unescape("".join([t for t, _ in pieces])).split())
        if text:
            linked = sum(len(_html.unescape(t).split()) for t, link in pieces if link)
            n = text.count(" ") + 1
            out.append(Block(text, n, min(n, linked), 0, int(n_good > 0), int(n_head > 0), int(n_item > 0)))
            marked.append(here)
            if here:
                here.words += n
        pieces.clear()

    def pop() -> None:
        nonlocal here, n_good, n_hidden, n_link, n_head, n_item
        name, here, good, hidden, link = stack.pop()
        n_good, n_hidden, n_link = n_good - good, n_hidden - hidden, n_link - link
        n_head -= name in ("h1", "h2", "h3", "h4", "h5", "h6")
        n_item -= name == "li"

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not n_hidden:
            pieces.append((page[at:stop], n_link > 0))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not n_hidden:
                pieces.append((_html.escape(m[0][9:].removesuffix("]]>")), n_link > 0))
            continue
        if m[1]:
            if name in BLOCK:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name not in BLOCK and any(x[0] in BLOCK for x in stack[depth + 1 :]):
                        break  # an inline end tag does not close blocks
                    while len(stack) > depth:
                        pop()
                    break
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                found = _RAW_END[name].search(page, at)
                at = found.end() if found else end
            continue
        if name in BLOCK:
            flush()
            if name != "br":
                while stack and (stack[-1][0] not in BLOCK or stack[-1][0] == "p") and stack[-1][0] not in ("a", "label"):
                    pop()  # a block ends an open paragraph and stray inline elements
            if stack and name in _CLOSES and stack[-1][0] in (name, _CLOSES[name]):
                pop()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        bad, good, hidden = _marks(name, m[3])
        if name in ("body", "html"):
            bad, good, hidden = 0, 0, False
        hidden = hidden or name in HIDDEN
        if name == "body":
            while any(x[0] == "head" for x in stack):
                pop()
        stack.append((name, here, good, hidden, name == "a"))
        if bad or name in MAIN:
            here = Mark(bool(bad), bad == 1, here)
            marks.append(here)
        n_good, n_hidden, n_link = n_good + good, n_hidden + hidden, n_link + (name == "a")
        n_head += name in ("h1", "h2", "h3", "h4", "h5", "h6")
        n_item += name == "li"
    flush()
    _settle(marks, sum(b.words for b in out))
    for block, mark in zip(out, marked):
        block.bad = int(mark is not None and mark.dirty)
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "furniture", "article", "heading", "item")


def features(own: list[Block]) -> np.ndarray:
    words = np.array([0, *[b.words for b in own], 0], float)
    density = np.array([0, *[b.linked / b.words for b in own], 0], float)
    rest = np.array([[b.bad, b.good, b.heading, b.item] for b in own], float).reshape(-1, 4)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], rest])


#: The labelled table: features as above, and 1 for text.  Blocks were made up for this purpose and labelled by hand.
BLOCKS = [
    # navigation, menus and link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 1, 0), (3, 1.0, 2, 1.0, 12, 0.0, 1, 0, 0, 1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 1, 0), (4, 1.0, 3, 1.0, 4, 1.0, 0, 0, 0, 1, 0), (5, 0.8, 6, 1.0, 5, 1.0, 0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0, 0), (8, 0.9, 7, 1.0, 9, 0.9, 0, 0, 0, 1, 0), (3, 1.0, 30, 0.0, 3, 1.0, 1, 1, 0, 1, 0),
    (12, 0.95, 11, 1.0, 10, 1.0, 0, 0, 0, 1, 0), (6, 1.0, 25, 0.1, 6, 1.0, 1, 1, 0, 0, 0), (9, 0.7, 1, 1.0, 2, 1.0, 1, 0, 0, 0, 0),
    # headers, footers, notices, adverts, forms, sidebars, reader comments
    (10, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0, 0), (25, 0.0, 2, 1.0, 9, 0.0, 1, 0, 0, 0, 0), (60, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 0, 0),
    (14, 0.1, 45, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (7, 0.0, 80, 0.0, 3, 0.0, 1, 0, 1, 0, 0), (35, 0.0, 40, 0.0, 35, 0.0, 1, 1, 0, 0, 0),
    (90, 0.05, 50, 0.0, 60, 0.0, 1, 0, 0, 0, 0), (4, 0.0, 5, 0.0, 2, 0.0, 1, 0, 0, 0, 0), (2, 0.0, 1, 0.0, 1, 0.0, 1, 1, 0, 0, 0),
    (18, 0.3, 6, 0.0, 22, 0.0, 1, 0, 0, 0, 0), (120, 0.0, 3, 0.0, 5, 0.0, 1, 0, 0, 0, 0), (5, 0.0, 60, 0.0, 70, 0.0, 1, 1, 0, 0, 0),
    (11, 0.0, 2, 1.0, 12, 0.0, 1, 0, 1, 0, 0), (6, 0.0, 9, 0.0, 30, 0.0, 1, 1, 1, 0, 0), (15, 0.0, 20, 0.0, 4, 0.0, 1, 0, 0, 1, 0),
    (3, 0.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (4, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (3, 0.3, 2, 0.9, 3, 1.0, 0, 0, 0, 0, 0),
    # text inside an article, short and long, with some links
    (40, 0.0, 12, 0.0, 55, 0.0, 0, 1, 0, 0, 1), (1, 0.0, 40, 0.0, 50, 0.0, 0, 1, 0, 0, 1), (2, 0.0, 30, 0.0, 3, 0.0, 0, 1, 0, 0, 1),
    (9, 0.0, 8, 0.0, 40, 0.0, 0, 1, 1, 0, 1), (1, 0.0, 3, 1.0, 25, 0.0, 0, 1, 1, 0, 1), (15, 0.2, 60, 0.0, 20, 0.1, 0, 1, 0, 0, 1),
    (7, 0.0, 6, 0.0, 8, 0.0, 0, 1, 0, 1, 1), (30, 0.4, 25, 0.1, 60, 0.0, 0, 1, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 1),
    (200, 0.02, 90, 0.0, 150, 0.01, 0, 1, 0, 0, 1), (4, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 0, 1), (5, 1.0, 40, 0.0, 45, 0.0, 0, 1, 0, 0, 1),
    (2, 1.0, 22, 0.0, 31, 0.1, 0, 1, 0, 0, 1), (6, 0.0, 1, 1.0, 2, 1.0, 0, 1, 1, 0, 1), (3, 1.0, 1, 0.0, 18, 0.0, 0, 1, 1, 0, 1),
    (11, 0.5, 4, 0.0, 9, 0.6, 0, 1, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 0, 1), (25, 0.9, 10, 0.0, 30, 0.0, 0, 1, 0, 0, 1),
    # text on pages that mark no article
    (50, 0.0, 10, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (20, 0.1, 45, 0.0, 35, 0.0, 0, 0, 0, 0, 1), (12, 0.0, 30, 0.0, 28, 0.0, 0, 0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1, 0, 1), (5, 0.0, 40, 0.0, 55, 0.0, 0, 0, 1, 0, 1), (9, 0.0, 70, 0.0, 12, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 35, 0.0, 42, 0.0, 0, 0, 0, 0, 1), (14, 0.0, 50, 0.0, 13, 0.0, 0, 0, 0, 1, 1), (150, 0.05, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (30, 0.2, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (8, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 12, 0.0, 9, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 20, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 25, 0.0, 0, 0, 1, 0, 1),
]


@dataclass
class Node:
    """A split (column, at, below, above) or a leaf (value)."""

    value: int = 0
    column: int = -1
    at: float = 0.0
    below: Node | None = None
    above: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """CART by Gini impurity; ties go to the first column and the lowest cut."""
    leaf = Node(int(y.mean() * 2 >= 1))
    if depth == 0 or y.min() == y.max():
        return leaf
    best, cut = len(y) * 2 * y.mean() * (1 - y.mean()), None
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= at
            score = sum(2 * p.sum() * (1 - p.mean()) for p in (y[low], y[~low]))
            if score < best - 1e-9:
                best, cut = score, (c, float(at))
    if not cut:
        return leaf
    low = x[:, cut[0]] <= cut[1]
    return Node(leaf.value, *cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    if node.column < 0:
        return np.full(len(x), bool(node.value))
    low = x[:, node.column] <= node.at
    out = np.empty(len(x), bool)
    out[low], out[~low] = decide(node.below, x[low]), decide(node.above, x[~low])
    return out


@lru_cache(maxsize=1)
def tree() -> Node:
    rows = np.array(BLOCKS, float)
    return grow(rows[:, :-1], rows[:, -1])


def extract_many(pages: list[str]) -> list[str]:
    per = [blocks(p) for p in pages]
    x = [features(b) for b in per if b]
    kept = iter(decide(tree(), np.vstack(x)).tolist() if x else [])
    return [" ".join([b.text for b in own if next(kept)]) for own in per]


def extract(page: str) -> str:
    return extract_many([page])[0]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = extract_many([x or "" for x in batch.column("html").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    small_batches(spark)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark, table(spark, sf_dir, "pages"))
