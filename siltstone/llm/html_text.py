"""Main text of HTML pages from flat text blocks.

A page is cut at block-level tags into text blocks.  A decision tree, grown on
the small labelled table below, tells content from boilerplate by each block's
word count and link density and those of the blocks before and after.

Defined results
---------------
* Scripts, styles, templates, comments and declarations have no text; entities
  are decoded; white space in a block becomes one space; blocks without words
  are dropped.  Broken markup is read as far as it goes, never refused: only
  a script, style or comment left open runs to the end of the page.  A head
  ends at its closing tag or at what can't stand in it, text or tag; other
  silent tags that are self-closed or never closed hide nothing.
* A page's text is its content blocks, joined by newlines; where there are
  none, and for null or empty pages, it is empty.
* Result columns ``text, n_blocks, n_content`` replace input columns of these
  names; all others but the page pass.  Repeated rows give the same result.
  An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .frames import extended, tuned

RESULT = ("text", "n_blocks", "n_content")
_BLOCK = "address article aside blockquote body br button caption center dd details dir div dl dt fieldset figcaption figure footer form frame h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
_RAW = frozenset("script style".split())
_SILENT = frozenset("script style noscript template svg".split())
#: What can stand in a head; the end of any other tag is ignored there.
_HEAD = frozenset("html head title meta link base basefont bgsound noscript script style template svg".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*>?",
    re.S,
)
#: A slash that ends a tag, not an unquoted value.
_EMPTY = re.compile(r"<[^\s>/]+(?:\s*|.*[\s\"']|.*\s[^\s=\"']+)/>\Z", re.S)
BLOCKS = frozenset(_BLOCK)

#: Blocks labelled by hand: words and link density of the block, of the one
#: before and of the one after, and whether it is content.
LABELLED = [
    # navigation, menus, link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0), (3, 1.0, 2, 1.0, 1, 1.0, 0),
    (1, 1.0, 1, 1.0, 8, 0.0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0), (9, 0.9, 7, 1.0, 5, 1.0, 0),
    (14, 0.85, 9, 0.9, 3, 1.0, 0), (6, 1.0, 40, 0.0, 5, 1.0, 0), (20, 0.8, 12, 0.7, 18, 0.9, 0), (4, 0.75, 3, 1.0, 5, 0.6, 0),
    (1, 1.0, 0, 0.0, 2, 1.0, 0), (2, 1.0, 0, 0.0, 1, 1.0, 0), (3, 1.0, 0, 0.0, 4, 1.0, 0), (4, 1.0, 0, 0.0, 3, 1.0, 0),
    (1, 1.0, 1, 1.0, 60, 0.0, 0), (2, 1.0, 1, 1.0, 40, 0.0, 0), (3, 1.0, 2, 1.0, 90, 0.0, 0), (1, 1.0, 1, 1.0, 120, 0.0, 0),
    (45, 0.95, 6, 1.0, 8, 0.0, 0), (60, 0.9, 0, 0.0, 30, 0.0, 0), (38, 1.0, 3, 1.0, 20, 0.0, 0), (52, 0.9, 12, 0.8, 5, 1.0, 0),
    # advertisements and notices between menu and text, or after it
    (8, 0.0, 1, 1.0, 9, 0.0, 0), (5, 0.0, 2, 1.0, 11, 0.0, 0), (12, 0.0, 1, 1.0, 7, 0.0, 0), (3, 0.0, 1, 1.0, 10, 0.0, 0),
    (9, 0.0, 1, 1.0, 30, 0.0, 0), (15, 0.0, 1, 1.0, 8, 0.0, 0), (20, 0.0, 1, 1.0, 9, 0.0, 0), (11, 0.0, 3, 1.0, 12, 0.0, 0),
    (26, 0.0, 1, 1.0, 10, 0.0, 0), (7, 0.0, 2, 1.0, 60, 0.0, 0), (14, 0.0, 1, 1.0, 14, 0.0, 0), (18, 0.0, 1, 1.0, 24, 0.0, 0),
    # footers, credits: the last block
    (6, 0.0, 50, 0.0, 0, 0.0, 0), (10, 0.0, 45, 0.0, 0, 0.0, 0), (14, 0.0, 80, 0.0, 0, 0.0, 0), (3, 0.0, 20, 0.0, 0, 0.0, 0),
    (22, 0.0, 12, 0.0, 0, 0.0, 0), (17, 0.1, 30, 0.0, 0, 0.0, 0), (12, 0.4, 8, 1.0, 0, 0.0, 0), (28, 0.0, 120, 0.0, 0, 0.0, 0),
    (9, 0.0, 9, 0.0, 0, 0.0, 0), (35, 0.0, 60, 0.0, 0, 0.0, 0), (5, 0.0, 300, 0.0, 0, 0.0, 0), (16, 0.0, 1, 0.0, 0, 0.0, 0),
    # headlines and short paragraphs inside running text
    (9, 0.0, 8, 0.0, 30, 0.0, 1), (11, 0.0, 10, 0.0, 60, 0.0, 1), (7, 0.0, 40, 0.0, 50, 0.0, 1), (4, 0.0, 35, 0.0, 45, 0.0, 1),
    (10, 0.0, 14, 0.0, 80, 0.0, 1), (12, 0.0, 6, 0.0, 12, 0.0, 1), (3, 0.0, 60, 0.0, 55, 0.0, 1), (8, 0.0, 22, 0.0, 20, 0.0, 1),
    (2, 0.0, 30, 0.0, 14, 0.0, 1), (15, 0.0, 20, 0.0, 6, 0.0, 1), (6, 0.0, 12, 0.0, 9, 0.0, 1), (1, 0.0, 25, 0.0, 40, 0.0, 1),
    (8, 0.0, 15, 0.0, 16, 0.0, 1), (9, 0.0, 10, 0.0, 12, 0.0, 1), (10, 0.0, 12, 0.0, 3, 0.0, 1), (5, 0.0, 9, 0.0, 7, 0.0, 1),
    # paragraphs, some with a few links
    (45, 0.0, 30, 0.0, 50, 0.0, 1), (60, 0.05, 12, 0.0, 70, 0.0, 1), (120, 0.0, 9, 0.0, 40, 0.1, 1), (33, 0.1, 60, 0.0, 22, 0.0, 1),
    (80, 0.15, 55, 0.1, 90, 0.0, 1), (26, 0.0, 40, 0.0, 6, 0.0, 1), (200, 0.02, 150, 0.0, 12, 0.0, 1), (50, 0.2, 44, 0.1, 38, 0.3, 1),
    (70, 0.0, 20, 0.0, 14, 0.0, 1), (90, 0.0, 1, 1.0, 60, 0.0, 1), (55, 0.0, 2, 1.0, 48, 0.0, 1), (300, 0.01, 8, 0.0, 10, 0.0, 1),
    # only paragraphs, last ones, and first ones right after a menu
    (12, 0.0, 0, 0.0, 0, 0.0, 1), (25, 0.0, 0, 0.0, 0, 0.0, 1), (40, 0.0, 0, 0.0, 0, 0.0, 1), (70, 0.05, 0, 0.0, 0, 0.0, 1),
    (18, 0.0, 0, 0.0, 50, 0.0, 1), (35, 0.0, 0, 0.0, 30, 0.0, 1), (9, 0.0, 0, 0.0, 40, 0.0, 1), (60, 0.0, 0, 0.0, 80, 0.0, 1),
    (38, 0.0, 50, 0.0, 0, 0.0, 1), (42, 0.0, 80, 0.0, 0, 0.0, 1), (55, 0.0, 35, 0.0, 0, 0.0, 1), (48, 0.0, 120, 0.0, 0, 0.0, 1),
    (32, 0.0, 1, 1.0, 60, 0.0, 1), (40, 0.0, 1, 1.0, 45, 0.0, 1), (36, 0.0, 2, 1.0, 70, 0.0, 1), (45, 0.0, 1, 1.0, 30, 0.0, 1),
    (64, 0.0, 5, 0.0, 0, 0.0, 1), (150, 0.0, 30, 0.0, 0, 0.0, 1), (75, 0.0, 1, 1.0, 8, 0.0, 1), (40, 0.3, 35, 0.2, 50, 0.0, 1),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 5, least: int = 2):
    """A decision tree (Gini): nested (feature, cut, low, high), or a leaf's share."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return float(y.mean())
    best = (1e-9, 0, 0.0)
    whole = y.mean() * (1 - y.mean())
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        low = np.cumsum(t)[:-1]
        p, q = low / n, (t.sum() - low) / (len(t) - n)
        gain = whole - (n * p * (1 - p) + (len(t) - n) * q * (1 - q)) / len(t)
        gain[(v[1:] == v[:-1]) | (n < least) | (len(t) - n < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-12:
            best = (gain[k], f, (v[k] + v[k + 1]) / 2)
    if best[0] <= 1e-9:
        return float(y.mean())
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@cache
def default_tree():
    table = np.array(LABELLED, dtype=np.float64)
    return grow(table[:, :6], table[:, 6])


def classify(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree >= 0.5)
    f, cut, low, high = tree
    out = np.empty(len(x), dtype=bool)
    below = x[:, f] <= cut
    out[below], out[~below] = classify(low, x[below]), classify(high, x[~below])
    return out


@cache
def _tags(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}(?![a-z0-9:-])[^>]*>?", re.I)


def _hidden(page: str, name: str, tag: str, at: int, open_: set[str]) -> int:
    """Where the element ends whose start tag ends at ``at``; there if it hides nothing.

    ``open_`` holds the names of which no closing tag follows any more.
    """
    if name not in open_:
        if _EMPTY.match(tag):
            # <script/> holds nothing, unless its own closing tag comes next
            after = _tags(name).search(page, at)
            return after.end() if after and after.group(1) and name != "svg" else at
        for after in _tags(name).finditer(page, at):
            if after.group(1):
                return after.end()
        open_.add(name)
    return len(page) if name in _RAW and not _EMPTY.match(tag) else at


def blocks(page: str | None) -> list[tuple[str, int, float]]:
    """Text, word count and link density of each block, in order."""
    out: list[tuple[str, int, float]] = []
    text: list[str] = []
    linked = 0
    in_link = in_head = False
    silent, open_ = _SILENT, set()

    def close():
        nonlocal linked
        body = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if body:
            n = body.count(" ") + 1
            out.append((body, n, min(1.0, linked / n)))
        linked = 0

    def take(piece: str):
        nonlocal linked, in_head
        in_head = in_head and not piece.strip()
        if piece and not in_head:
            text.append(piece)
            if in_link:
                linked += len(piece.split())

    at = 0
    page = page or ""
    while m := _TOKEN.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        ends = bool(m.group(1))
        if in_head:
            in_head = name != "head" if ends else name in _HEAD
        elif name == "head" and not ends:
            in_head = True
            silent = _SILENT | {"title"}
        if name in silent and not ends:
            at = _hidden(page, name, m.group(), at, open_)
        elif name == "a":
            in_link = not ends
        elif name in BLOCKS:
            close()
    take(page[at:])
    close()
    return out


def extract(page: str | None, tree=None) -> tuple[str, int, int]:
    """Content text, number of blocks, number of content blocks."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    own = np.array([(n, d) for _, n, d in found], dtype=np.float64)
    none = np.zeros((1, 2))
    x = np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])], axis=1)
    content = classify(tree or default_tree(), x)
    return "\n".join(t for (t, _, _), c in zip(found, content) if c), len(found), int(content.sum())


def extract_pages(pages: DataFrame, page: str = "html") -> DataFrame:
    """Adds ``text, n_blocks, n_content`` and drops the page."""
    result = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_blocks", T.IntegerType()), T.StructField("n_content", T.IntegerType())])

    def run(html):
        got = [extract(p) for p in html.to_pylist()]
        return pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())

    return extended(pages, [page], run, result, (page,))


def query(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(spread(tuned(spark).read.parquet(f"{sf_dir}/pages.parquet")))
