"""Main text of HTML pages as a maximum-scoring contiguous region.

A page is a sequence of tags and words. Words score by where they stand and tags score negative; the
weights are log-odds counted on labelled pages, which are those that mark their text with a single
``<article>`` or ``<main>``. One linear scan finds the contiguous region of the highest total; its words, without
those of containers that are no text of the page (menus, adverts, forms, comments), are the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by what they do to the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg math".split())
#: Containers that hold no text of the page, whatever they are called.
BARRED = frozenset("nav aside footer form menu button select dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names in class, id or role that mark such a container.
BARRED_NAME = re.compile(
    r"(?<![a-z])(ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|"
    r"consent|gdpr|notice|notices|alert|popup|modal|overlay|sidebar|side|aside|nav|navbar|navigation|menu|menubar|breadcrumb|"
    r"breadcrumbs|footer|masthead|topbar|toolbar|related|recommended|share|sharing|social|newsletter|subscribe|signup|login|"
    r"search|pagination|pager|widget|comment|comments|reply|replies|respond|disqus|discussion|contentinfo|complementary|"
    r"site-header|page-header)(?![a-z])"
)
#: Of these, names that mark one inside a marked text too, and those that do so on a section, where others name its subject.
CLEAR_NAME = re.compile(
    r"(?<![a-z])(ad|ads|adv|advert|adverts|advertisement|sponsored|promo|cookie|cookies|consent|gdpr|popup|modal|sidebar|"
    r"navbar|menubar|breadcrumb|breadcrumbs|newsletter|subscribe|signup|pagination|comment|comments|respond|disqus)(?![a-z])"
)
SECTION_NAME = re.compile(
    r"(?:^|\s)(ads?|adverts?|cookie[-_]notice|sidebar|breadcrumbs?|newsletter|pagination|(reader|user)?[-_]?comments?|respond|disqus)"
    r"([-_](area|block|box|form|list|section|thread|wrapper))?(?=\s|$)"
)
#: The other names do so inside a marked text only where they are the whole name, but for a word for its shape.
WHOLE_NAME = re.compile(
    r"(?:^|\s)(banner|notices?|alert|overlay|side|aside|nav|navigation|menu|footer|masthead|topbar|toolbar|related|recommended|"
    r"share|sharing|social|login|search|pager|widget|reply|replies|contentinfo|complementary)"
    r"([-_](area|articles|bar|block|box|buttons?|form|links|list|panel|posts|stories|widget|wrapper))?(?=\s|$)"
)
COMMENT_NAME = re.compile(r"(?<![a-z])(comments?|respond|disqus)(?![a-z])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_SECTIONS = frozenset("section article main table pre blockquote figure figcaption".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Where a barred container ends at the latest, though it was never closed.
_ENDS = frozenset(("article", "main", "body", "html"))
#: Elements that need no end tag, with the elements at whose start they end.
_UNCLOSED = {
    "p": BLOCKS - {"select", "option"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "td": frozenset("td th tr tbody tfoot".split()),
    "th": frozenset("td th tr tbody tfoot".split()),
    "tr": frozenset("tr tbody tfoot".split()),
}
#: Elements that hold others and have an end tag.
_HOLDERS = BLOCKS - VOID - frozenset(_UNCLOSED)

#: Bounds of a weight, and what a tag costs at least.
LOWEST, HIGHEST, TAG = -2.0, 3.0, -0.05


class Piece(NamedTuple):
    """A tag (``words`` 0) or a run of text, with the key of its weight."""

    key: str
    words: int
    text: str
    barred: bool
    #: Whether a new block begins with the piece, and whether it lies in the marked text.
    block: bool
    marked: bool


class Bar:
    """An open container that holds no text of the page."""

    def __init__(self, name: str, comments: bool, early: bool):
        self.name, self.depth = name, 1
        #: Whether a marked text that starts ends it, as it would one before the text that was never closed.
        self.lifts = early and not comments
        self.comments = comments
        self.articles = 0

    def ends(self, name: str, closing: bool) -> bool:
        """Take the next tag in; whether the container has ended with it, or before it."""
        if name in _ENDS and not (name == self.name == "article"):
            if not closing:
                self.articles += name in ("article", "main")
                return self.lifts or name in ("body", "html")
            self.articles -= name in ("article", "main")
            return self.articles < 0 or name in ("body", "html")
        if name == "footer" and not closing and not self.comments and self.name != "footer":
            return True
        if self.name in _UNCLOSED:
            if not closing and self.depth == 1 and name in _UNCLOSED[self.name]:
                return True
            if name in _HOLDERS:
                self.depth += -1 if closing else 1
                return self.depth < 1
            return closing and name == self.name and self.depth == 1
        if name == self.name:
            self.depth += -1 if closing else 1
        return self.depth < 1


def holds_no_text(name: str, attributes: str, marked: bool) -> bool:
    """Whether an element is barred by what it is or by its class, id or role."""
    if name in BARRED or (name == "header" and not marked):
        return True
    names = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes)).lower() if attributes else ""
    if not names or name in VOID or name in _HEADINGS or name in ("main", "body", "html"):
        return False
    if name == "article":
        return bool(COMMENT_NAME.search(names))
    if not marked:
        return bool(BARRED_NAME.search(names))
    if name in _SECTIONS:
        return bool(SECTION_NAME.search(names))
    return bool(CLEAR_NAME.search(names) or WHOLE_NAME.search(names))


def parse(html: str) -> tuple[list[Piece], int]:
    """The pieces of a page in order, and how many elements mark a text."""
    out: list[Piece] = []
    place, block, link, marked, marks = "flow", True, 0, 0, 0
    bar: Bar | None = None
    at = 0
    low = None
    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            n = len(text.split())
            if n:
                key = "barred" if bar else f"{place} link" if link else place
                out.append(Piece(key, n, text, bar is not None, block, marked > 0))
                block = False
            elif out and not block:
                # white space between two inline tags parts words
                out.append(Piece("space", 0, " ", bar is not None, False, marked > 0))
        if not m:
            return out, marks
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            low = html.lower() if low is None else low
            end = low.find(f"</{name}", at)
            stop = html.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else len(html)
            continue
        out.append(Piece(f"</{name}>" if closing else f"<{name}>", 0, " " if name == "br" else "", bar is not None, False, marked > 0))
        if name == "a":
            link = 0 if closing else 1
        if name in BLOCKS:
            block, place, link = True, "flow" if closing else name, 0
        if bar and not bar.ends(name, closing):
            continue
        own = bar is not None and closing and name == bar.name == "article"
        bar = None
        if not closing and holds_no_text(name, m[3], marked > 0):
            named = " ".join(x or y or z for x, y, z in _NAMES.findall(m[3])).lower()
            bar = Bar(name, bool(COMMENT_NAME.search(named)), marks == 0)
        elif name in ("article", "main") and not own:
            if closing:
                marked = max(0, marked - 1)
            else:
                marks += marked == 0
                marked += 1


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and past-the-end place of the contiguous run with the largest positive sum, the first such."""
    best, begin, end = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def weigh(piece: Piece, weights: dict[str, float]) -> float:
    # what is left out of a marked text does not part it
    if piece.key == "space" or (piece.barred and piece.marked):
        return 0.0
    if piece.words:
        return piece.words * weights.get(piece.key, 1.0 if not piece.barred else LOWEST)
    return min(TAG, weights.get(piece.key, TAG))


def extract(html: str, weights: dict[str, float]) -> str:
    pieces, _ = parse(html)
    begin, end = best_region([weigh(p, weights) for p in pieces])
    blocks: list[list[str]] = []
    for p in pieces[begin:end]:
        if p.barred:
            continue
        if p.block or not blocks:
            blocks.append([])
        blocks[-1].append(unescape(p.text))
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def learn(pages: DataFrame) -> dict[str, float]:
    """Log-odds of each place and tag, counted over all labelled pages.

    A word counts once, a tag once; keys are names of HTML elements or places, all others count as one.
    The driver gets one row per key.
    """
    known = BLOCKS | RAW | VOID | BARRED | frozenset("a b i em strong span small sup sub code br img u q cite".split())
    keys = {"flow", "barred"} | {k for n in known for k in (n, f"{n} link", f"<{n}>", f"</{n}>")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for html in batch.column(0):
                pieces, marks = parse(html.as_py() or "")
                if marks == 1:
                    for p in pieces:
                        (inside if p.marked else outside)[p.key if p.key in keys else "other"] += p.words or 1
        names = sorted(inside | outside)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[k] for k in names], pa.int64()) for c in (inside, outside))],
            names=["key", "inside", "outside"],
        )

    counted = pages.select("html").mapInArrow(run, "key string, inside long, outside long")
    rows = counted.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return {
        r["key"]: float(np.clip(np.log((r["inside"] + 1) / (r["outside"] + 1)), LOWEST, HIGHEST)) for r in rows
    }


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html).

    Character references are decoded; white space inside a block becomes one space; blocks follow each other on
    lines of their own. An element that needs no end tag ends where the next one starts, in the barred ones too; captions
    of figures and what stands inside embedded objects count as text. A null or empty html, or a page without text, gives the empty text. Repeated rows are
    taken each for itself, null ids and urls are carried, other columns are not. An empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    weights = learn(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(html.as_py() or "", weights) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
