"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block is described by its words and link density,
by those of the blocks before and after it, and by what stands around it: parts of the page such as menus, told by tags and names, or an
article. What an element holds counts: a form or an aside around most of a page's words is no mere part of it, and an article is the
page's only if it holds most of the words outside of such parts. A decision tree trained on a small labelled table says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags of HTML by their part in a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object")
CHROME_TAGS = frozenset("nav header footer aside form menu button dialog fieldset head".split())
ARTICLE_TAGS = frozenset({"article", "main"})
#: Tags that may also be wrapped around a whole page.
WRAPPING_TAGS = frozenset("form aside fieldset dialog button".split())
#: Words in ``class``, ``id`` or ``role`` by which pages mark what is not their main text, wherever they stand in a name.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies consent gdpr menu nav navbar navigation "
    "newsletter pagination pager popup promo promoted related replies share sharing sidebar signup social sponsor sponsored subscribe contentinfo complementary".split()
)
#: Words that do so only beside others of these or those, or beside words of place, as in ``site-footer``.
WEAK_WORDS = frozenset("banner disclaimer footer header notice reply respond search toolbar widget widgets".split())
PLACE_WORDS = frozenset("area bar block bottom box button buttons global item left link links list main page primary right secondary section site slot top".split())
#: A name that begins so says what a page has or has not; a name with these before a word of its parts lays out both.
HAVING_WORDS = frozenset("has have no not with without hide show is".split())
LAYOUT_WORDS = frozenset("content layout".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?/>|<(" + "|".join(RAW_TAGS) + r")(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
#: A quick look for what ``_mark`` reads.
_MARKS = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[^a-z]+")

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "chrome", "article")

#: A small labelled table of blocks: FEATURES, and whether the block is main text.
LABELLED = (
    # menus, footers, adverts, notices, forms and comments, marked as such
    (6, 1.0, 0, 0.0, 6, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (3, 1.0, 1, 1.0, 12, 0.0, 1, 0, 0), (8, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0),
    (25, 0.0, 8, 0.0, 60, 0.0, 1, 0, 0), (12, 0.1, 45, 0.0, 0, 0.0, 1, 0, 0), (40, 0.0, 20, 0.0, 40, 0.0, 1, 0, 0), (4, 0.0, 0, 0.0, 30, 0.0, 1, 0, 0),
    (60, 0.0, 30, 0.0, 30, 0.0, 1, 0, 0), (15, 0.0, 80, 0.0, 20, 0.0, 1, 1, 0), (35, 0.05, 15, 0.0, 5, 1.0, 1, 1, 0), (2, 1.0, 60, 0.0, 2, 1.0, 1, 1, 0),
    (90, 0.0, 70, 0.0, 50, 0.0, 1, 1, 0), (9, 0.0, 2, 1.0, 70, 0.0, 1, 1, 0), (14, 0.0, 40, 0.0, 9, 0.0, 1, 0, 0), (50, 0.0, 12, 0.0, 0, 0.0, 1, 0, 0),
    (22, 0.0, 0, 0.0, 15, 0.0, 1, 0, 0), (70, 0.02, 40, 0.0, 90, 0.0, 1, 0, 0), (10, 0.0, 55, 0.0, 10, 0.0, 1, 1, 0), (33, 0.0, 9, 0.0, 3, 0.0, 1, 1, 0),
    (17, 0.0, 100, 0.0, 60, 0.2, 1, 0, 0), (28, 0.0, 28, 0.0, 28, 0.0, 1, 0, 0), (45, 0.0, 3, 0.0, 14, 0.0, 1, 0, 0), (20, 0.3, 14, 0.0, 22, 0.0, 1, 1, 0),
    (110, 0.0, 110, 0.0, 8, 0.0, 1, 0, 0), (13, 0.0, 13, 0.0, 11, 0.0, 1, 0, 0), (6, 0.0, 60, 0.0, 80, 0.0, 1, 1, 0), (24, 0.0, 90, 0.0, 35, 0.0, 1, 0, 0),
    # blocks of an article, headings and single words among them
    (10, 0.0, 8, 0.0, 10, 0.0, 0, 1, 1), (60, 0.0, 10, 0.0, 45, 0.0, 0, 1, 1), (45, 0.02, 60, 0.0, 80, 0.0, 0, 1, 1), (2, 0.0, 45, 0.0, 60, 0.0, 0, 1, 1),
    (1, 0.0, 90, 0.0, 12, 0.0, 0, 1, 1), (120, 0.1, 2, 0.0, 9, 0.1, 0, 1, 1), (18, 0.3, 60, 0.0, 30, 0.0, 0, 1, 1), (5, 0.0, 6, 1.0, 60, 0.0, 0, 1, 1),
    (30, 0.0, 60, 0.0, 0, 0.0, 0, 1, 1), (3, 0.0, 4, 0.0, 2, 1.0, 0, 1, 1), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 1), (8, 0.0, 1, 1.0, 0, 0.0, 0, 1, 1),
    (40, 0.0, 4, 0.0, 5, 0.0, 0, 1, 1), (11, 0.0, 6, 1.0, 4, 0.0, 0, 1, 1), (5, 0.6, 3, 0.0, 6, 0.8, 0, 1, 1), (70, 0.0, 0, 0.0, 3, 1.0, 0, 1, 1),
    (15, 0.9, 15, 0.9, 15, 0.9, 0, 1, 1), (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 1), (26, 0.0, 10, 0.5, 7, 0.0, 0, 1, 1), (6, 0.0, 5, 0.0, 10, 1.0, 0, 1, 1),
    (30, 0.0, 60, 0.0, 12, 0.0, 0, 1, 1), (7, 0.4, 30, 0.0, 25, 0.0, 0, 1, 1), (3, 1.0, 50, 0.0, 40, 0.0, 0, 1, 1), (1, 1.0, 20, 0.0, 35, 0.1, 0, 1, 1),
    # pages that mark nothing: long text without links, and short text between long text
    (60, 0.0, 10, 0.0, 50, 0.0, 0, 0, 1), (35, 0.05, 40, 0.0, 30, 0.0, 0, 0, 1), (20, 0.0, 50, 0.0, 45, 0.1, 0, 0, 1), (6, 0.0, 40, 0.0, 60, 0.0, 0, 0, 1),
    (9, 0.0, 3, 1.0, 70, 0.0, 0, 0, 1), (14, 0.0, 35, 0.0, 0, 0.0, 0, 0, 1), (80, 0.2, 0, 0.0, 90, 0.1, 0, 0, 1), (22, 0.1, 25, 0.0, 12, 0.0, 0, 0, 1),
    (50, 0.0, 10, 0.0, 1, 1.0, 0, 0, 1), (65, 0.05, 70, 0.0, 2, 1.0, 0, 0, 1), (40, 0.0, 1, 1.0, 4, 0.0, 0, 0, 1), (25, 0.0, 30, 0.0, 6, 1.0, 0, 0, 1),
    (100, 0.1, 2, 1.0, 0, 0.0, 0, 0, 1), (55, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (30, 0.0, 4, 0.0, 3, 0.0, 0, 0, 1), (45, 0.1, 5, 0.6, 8, 0.9, 0, 0, 1),
    (4, 0.0, 70, 0.0, 28, 0.0, 0, 0, 1), (16, 0.0, 17, 0.0, 18, 0.0, 0, 0, 1),
    # and there, lists of links and scraps among them
    (1, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0), (2, 1.0, 50, 0.0, 40, 0.0, 0, 0, 0), (3, 1.0, 2, 1.0, 30, 0.0, 0, 0, 0), (20, 0.9, 40, 0.0, 50, 0.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (4, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0), (12, 0.9, 8, 1.0, 10, 0.8, 0, 0, 0), (30, 0.7, 5, 1.0, 4, 1.0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), (5, 0.5, 4, 0.5, 2, 1.0, 0, 0, 0), (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 0), (7, 0.6, 30, 0.0, 5, 0.8, 0, 0, 0),
    (4, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), (6, 0.0, 3, 1.0, 4, 0.9, 0, 0, 0), (18, 0.55, 60, 0.0, 6, 0.9, 0, 0, 0), (3, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0),
    # short sentences without links, alone, in a row or before a long one
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (8, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (3, 0.0, 0, 0.0, 3, 0.0, 0, 0, 1),
    (3, 0.0, 3, 0.0, 4, 0.0, 0, 0, 1), (4, 0.0, 3, 0.0, 50, 0.0, 0, 0, 1), (2, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1), (4, 0.0, 6, 0.0, 0, 0.0, 0, 0, 1),
    (2, 0.0, 9, 0.0, 2, 0.0, 0, 0, 1), (3, 0.0, 4, 0.0, 0, 0.0, 0, 0, 1), (5, 0.0, 2, 1.0, 8, 0.0, 0, 0, 1), (6, 0.0, 12, 0.0, 2, 1.0, 0, 0, 1),
    (7, 0.0, 1, 1.0, 0, 0.0, 0, 0, 1), (9, 0.1, 0, 0.0, 1, 1.0, 0, 0, 1),
)


@dataclass
class Tree:
    """A node asks ``features[feature] <= cut``; a leaf has a value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return self.value[at] >= 0.5


def train_tree(table=LABELLED, depth: int = 8) -> Tree:
    """A binary tree by Gini impurity; the first of equally good cuts is taken."""
    data = np.array(table, float)
    nodes: list[list] = []

    def grow(rows: np.ndarray, level: int) -> int:
        me, y = len(nodes), data[rows, -1]
        nodes.append([-1, 0.0, 0, 0, y.mean()])
        best = (2 * len(y) * y.mean() * (1 - y.mean()) - 1e-9, None, None)
        for f in range(data.shape[1] - 1) if level < depth else ():
            seen = np.unique(data[rows, f])
            for cut in (seen[:-1] + seen[1:]) / 2:
                side = data[rows, f] <= cut
                cost = sum(2 * s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (side, ~side))
                if cost < best[0]:
                    best = (cost, f, cut)
        if best[1] is not None:
            side = data[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1], best[2]
            nodes[me][2] = grow(rows[side], level + 1)
            nodes[me][3] = grow(rows[~side], level + 1)
        return me

    grow(np.arange(len(data)), 0)
    columns = list(zip(*nodes))
    return Tree(*(np.array(c, t) for c, t in zip(columns, (int, float, int, int, float))))


@dataclass
class Blocks:
    """A page's blocks in order: texts, words, words in links, the marked elements around them, and whether an article is.

    ``marks`` says of each marked element how it is marked: ``hidden``, ``wrapping`` by a tag that may hold a page, or ``part``.
    """

    texts: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    around: list[tuple[int, ...]] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)


#: The share of a page's words from which on an element holds the page and is no part of it.
HOLDS_PAGE = {"wrapping": 0.5, "part": 0.9, "hidden": 2.0}


def _mark(name: str, attributes: str, in_article: bool) -> str | None:
    """How an element is marked as a part of the page, if it is."""
    found = None
    if name in CHROME_TAGS and not (name == "header" and in_article):
        found = "wrapping" if name in WRAPPING_TAGS else "part"
    if not _MARKS.search(attributes):
        return found
    named = name not in ARTICLE_TAGS and name not in ("html", "body")
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            if named and any(_names_chrome(x) for x in value.split()):
                found = "part"
        elif key == "hidden" and value != "false" or key == "aria-hidden" and value == "true" or key == "style" and _NOT_SHOWN.search(value):
            return "hidden"
    return found


def _names_chrome(name: str) -> bool:
    """Whether a class or id says so: ``ad-container`` and ``site-footer`` do, ``has-sidebar``, ``content-sidebar-wrap`` and ``post-header`` do not."""
    parts = [p for p in _PARTS.split(name) if p]
    first = next((i for i, p in enumerate(parts) if p in CHROME_WORDS), None)
    if not parts or parts[0] in HAVING_WORDS:
        return False
    if first is not None:
        return not any(p in LAYOUT_WORDS for p in parts[:first])
    return any(p in WEAK_WORDS for p in parts) and all(p in WEAK_WORDS or p in PLACE_WORDS for p in parts)


def blocks_of(page: str) -> Blocks:
    out, held, linked, links = Blocks(), [], [], 0
    stack: list[tuple[str, bool, bool]] = []
    marked: list[int] = []
    article = 0

    def close_block() -> None:
        words = " ".join(held)
        if words and (text := " ".join(html.unescape(words).split())):
            out.texts.append(text)
            out.words.append(text.count(" ") + 1)
            out.linked.append(len(html.unescape(" ".join(linked)).split()))
            out.around.append(tuple(marked))
            out.article.append(article > 0)
        held.clear()
        linked.clear()

    pos = 0
    for m in _TOKEN.finditer(page):
        if m.start() > pos:
            _hold(held, page[pos : m.start()])
            if links:
                linked.append(page[pos : m.start()])
        pos = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[0][:9].upper() == "<![CDATA[":
                _hold(held, html.escape(m[0][9:].removesuffix("]]>")))
            continue
        if name in BLOCK_TAGS:
            close_block()
        if name == "a":
            links = 0 if m[2] else 1
        elif name in VOID_TAGS:
            continue
        elif m[2]:
            if any(s[0] == name for s in stack):
                while stack:
                    opened, c, a = stack.pop()
                    article -= a
                    if c:
                        marked.pop()
                    if opened == name:
                        break
        elif name in BLOCK_TAGS or _MARKS.search(m[4]):
            if m[4].endswith("/"):
                continue
            if name in ("p", "li") and stack and stack[-1][0] == name:  # their end may be left out
                opened, c, a = stack.pop()
                article -= a
                if c:
                    marked.pop()
            mark, a = _mark(name, m[4], article > 0), name in ARTICLE_TAGS
            if mark:
                marked.append(len(out.marks))
                out.marks.append(mark)
            stack.append((name, mark is not None, a))
            article += a
    if pos < len(page):
        _hold(held, page[pos:])
    close_block()
    return out


def _hold(held: list[str], piece: str) -> None:
    """Pieces of a block are run together: inline tags do not part words."""
    if held:
        held[-1] += piece
    else:
        held.append(piece)


def _parts(b: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Whether each block is in a marked part of the page, and whether it is in the page's article."""
    words, held = np.array(b.words, float), np.zeros(len(b.marks))
    for n, around in zip(b.words, b.around):
        for i in around:
            held[i] += n
    part = held <= np.array([HOLDS_PAGE[m] for m in b.marks]) * words.sum() if b.marks else np.zeros(0, bool)
    chrome = np.array([any(part[i] for i in around) for around in b.around])
    article = np.array(b.article)
    if 2 * words[article & ~chrome].sum() < words[~chrome].sum():
        article = np.zeros(len(words), bool)
    return chrome, article


def features_of(b: Blocks) -> np.ndarray:
    words = np.array(b.words, float)
    density = np.minimum(np.array(b.linked, float) / np.maximum(words, 1), 1)
    shift = lambda v, k: np.concatenate([[0.0], v[:-1]]) if k < 0 else np.concatenate([v[1:], [0.0]])
    return np.column_stack([words, density, shift(words, -1), shift(density, -1), shift(words, 1), shift(density, 1), *(x.astype(float) for x in _parts(b))])


def main_text(page: str, tree: Tree) -> str:
    b = blocks_of(page)
    if not b.texts:
        return ""
    x = features_of(b)
    kept, article = tree.predict(x), x[:, FEATURES.index("article")] > 0
    if article.any():  # a page with an article has no main text beside it
        kept &= article
    return " ".join(t for t, k in zip(b.texts, kept) if k)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    Null, empty and blank html and pages without main text give an empty text. Character references are decoded, white space within
    a block becomes one blank and blocks are joined by one. Unclosed and stray tags are borne. Pages are read whole, whatever their length, each on
    its own, so repeated rows and null identifiers do not matter; other columns are not looked at.
    """
    tree = train_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
