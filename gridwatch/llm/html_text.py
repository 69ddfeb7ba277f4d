"""Main text of web pages (operator 9).

The standard library's streaming parser feeds events to a builder that cuts
the page into lines (text between block boundaries) and knows for each line
the elements around it.  A line's text-to-tag ratio, with boilerplate
elements at zero, is smoothed along the page by a Gaussian; lines above a
threshold cluster into content.  The region is the innermost element that
holds most of that content (an article, where one does), and its lines are
returned, boilerplate inside it left out.  Elements that are named as comments,
notices, adverts or navigation never are content, however much of the page
they hold.  A form, or an element named after its place (a sidebar, a widget),
is left out only if it doesn't hold most of the page's unlinked text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwatch.llm.common import ready

FEED = 1 << 16
#: Gaussian: deviation and reach in lines; threshold as a part of the page's
#: deviation; the region holds at least this part of the selected text.
SIGMA, REACH, LEVEL, MAJORITY, ARTICLE_SHARE, LINKED = 1.0, 2, 0.5, 0.7, 0.3, 0.7

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never content.
SKIPPED = frozenset("""head title script style noscript template iframe object svg math canvas audio video map
nav aside footer button select option textarea label fieldset dialog menu datalist""".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section
summary table tbody tfoot thead tr ul""".split())
#: Elements that end an open paragraph.
ENDS_P = BLOCKS - {"caption", "tbody", "thead", "tfoot", "tr", "body", "html"}
#: An open one of these ends where the next begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
SCOPES = frozenset("article section div main body td th table ul ol dl blockquote".split())
#: Words of class, id or role that mark boilerplate, where a name has no others than these and ``PLACES`` and
#: ``AROUND``.
MARKED = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion
banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc
footer colophon copyright comment comments commentlist disqus reply replies respond
share sharing social related recommended recommendations teaser login search toolbar skip""".split())
#: Words that name a place of the page: boilerplate unless most of the text is there.
PLACES = frozenset("sidebar side rail widget widgets header masthead".split())
AROUND = frozenset("""main site page global top bottom left right primary secondary inner outer wrap wrapper container box area
list item items section block bar link links button buttons icon icons panel slot unit group form google posts articles
stories recent post article user users reader readers entry blog""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A form or place with more than this part of the unlinked text is content.
FORM_SHARE, MARKED_SHARE = 0.5, MAJORITY
#: Also in an article these words may name the article's own head.
OWN_HEAD = frozenset({"header"})


def _words(name: str) -> set[str]:
    return {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}


def _marked(tag: str, attrs: list[tuple[str, str | None]], article: bool) -> tuple[bool, bool]:
    """Is one of the names a boilerplate name as a whole, and is one a place?
    Ids of headings, and of sections in an article, are made from their titles
    and tell nothing."""
    slug, marked, place = tag in HEADINGS or (article and tag == "section"), False, False
    for k, v in attrs:
        if k in ("class", "role") or (k == "id" and not slug):
            for name in (v or "").split():
                words = _words(name)
                if words <= MARKED | PLACES | AROUND:
                    marked = marked or bool(words & MARKED)
                    place = place or bool(words & (PLACES - OWN_HEAD if article else PLACES))
    return marked, place


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    a = dict(attrs)
    style = (a.get("style") or "").replace(" ", "").lower()
    return "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class _Lines(HTMLParser):
    """Lines as (text, tags, linked characters, boilerplate, innermost scope,
    innermost doubtful element).  Scopes and doubtful elements know the one
    around them (-1: none); an inner one has a larger number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool, int, int]] = []
        self.kinds, self.around = ["page"], [-1]         # of a scope: its element, the scope around it
        self.shares: list[float] = []                    # of a doubtful element: the part that makes it content
        self.outer: list[int] = []                       # the doubtful element around it
        # open elements: (tag, boilerplate, scope, in article, doubtful element)
        self.open: list[tuple[str, bool, int, bool, int]] = [("", False, 0, False, -1)]
        self.opened: Counter[str] = Counter()
        self.words: list[str] = []
        self.tags = self.linked = self.links = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text or self.tags:
            _, skip, scope, _, doubtful = self.open[-1]
            self.lines.append((text, self.tags, self.linked, skip, scope, doubtful))
        self.words, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in ENDS_P:
            self._close({"p"}, BLOCKS - {"p"})
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], {"ul", "ol", "dl", "table", "select", "menu"})
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.words.append(" ")
            return
        _, skip, scope, article, doubtful = self.open[-1]
        skip = skip or tag in SKIPPED or (tag == "header" and not article) or (bool(attrs) and _hidden(attrs))
        marked = place = False
        if attrs and tag not in ("html", "body", "article", "main"):
            marked, place = _marked(tag, attrs, article)
        skip = skip or marked
        if (tag == "form" or place) and not skip:
            self.outer.append(doubtful)
            doubtful = len(self.shares)
            self.shares.append(FORM_SHARE if tag == "form" else MARKED_SHARE)
        article = article or tag in ("article", "main") or any(
            "main" in _words(v or "") for k, v in attrs if k in ("class", "id", "role"))
        if tag in SCOPES or tag in ("article", "main"):
            self.around.append(scope)
            scope = len(self.kinds)
            self.kinds.append("article" if tag in ("article", "main") else tag)
        self.open.append((tag, skip, scope, article, doubtful))
        self.opened[tag] += 1
        self.links += tag == "a"
        if tag in ("td", "th"):
            self.words.append(" ")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # a slash at the end means nothing but on void elements
        self.handle_starttag(tag, attrs)

    def _close(self, tags: set[str], within: set[str] | frozenset[str]) -> None:
        """Close the innermost open element of ``tags`` if no element of
        ``within`` is open inside it."""
        if not any(self.opened[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                self._pop(k)
                return
            if self.open[k][0] in within:
                return

    def _pop(self, k: int) -> None:
        for element in self.open[k:]:
            self.opened[element[0]] -= 1
            self.links -= element[0] == "a"
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for k in range(len(self.open) - 1, 0, -1) if self.opened[tag] else ():
            if self.open[k][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] in ("script", "style"):
            return
        self.words.append(data)
        if self.links:
            self.linked += len(data.strip())


def _smooth(ratio: np.ndarray) -> np.ndarray:
    at = np.arange(-REACH, REACH + 1)
    kernel = np.exp(-at * at / (2 * SIGMA * SIGMA))
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[REACH:REACH + len(ratio)]
    return np.convolve(ratio, kernel, "full")[REACH:REACH + len(ratio)] / weight


def _upward(at: np.ndarray, amount: np.ndarray, around: list[int]) -> np.ndarray:
    """What the lines inside each element hold (``at``: their innermost one)."""
    out = np.zeros(len(around))
    np.add.at(out, at[at >= 0], amount[at >= 0])
    for k in range(len(around) - 1, -1, -1):
        if around[k] >= 0:
            out[around[k]] += out[k]
    return out


def main_text(html: str | None) -> str:
    """The page's main text, blocks joined by line ends; null: empty."""
    html = html or ""
    parser = _Lines()
    for k in range(0, len(html), FEED):
        parser.feed(html[k:k + FEED])
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    skip = np.array([x[3] for x in lines])
    in_links = np.array([x[2] for x in lines])
    linked = in_links > LINKED * np.maximum(size, 1)
    plain = np.where(skip, 0, np.maximum(size - in_links, 0))
    doubtful = np.array([x[5] for x in lines])
    held = _upward(doubtful, plain, parser.outer)
    boilerplate = held <= np.array(parser.shares) * plain.sum()
    for k, outer in enumerate(parser.outer):
        boilerplate[k] |= outer >= 0 and boilerplate[outer]
    skip = skip | np.append(boilerplate, False)[doubtful]
    ratio = np.where(skip | linked, 0, size) / np.maximum([x[1] for x in lines], 1)
    smooth = _smooth(ratio)
    usable = ~skip & (size > 0)
    chosen = usable & ~linked & (smooth >= LEVEL * smooth.std())
    if not chosen.any():
        chosen = usable & ~linked
    if not chosen.any():
        return ""
    scope = np.array([x[4] for x in lines])
    mass = _upward(scope, np.where(chosen, size, 0), parser.around)
    total = size[chosen].sum()
    articles = [k for k, kind in enumerate(parser.kinds) if kind == "article" and mass[k] >= ARTICLE_SHARE * total]
    if articles:
        region = max(articles, key=lambda k: (mass[k], -k))
    else:        # scopes are numbered from the outside in: the last one is innermost
        region = max(k for k in range(len(mass)) if mass[k] >= MAJORITY * total)
    within = np.zeros(len(parser.kinds), bool)
    within[region] = True
    for k in range(region + 1, len(within)):
        within[k] = within[parser.around[k]]
    inside = within[scope]
    if not articles:
        # a linked line stays where content is on both sides of it
        at = np.flatnonzero(chosen)
        amid = np.zeros(len(lines), bool)
        for a, b in zip(at, at[1:], strict=False):
            between = np.arange(a + 1, b)[usable[a + 1:b]]
            amid[between] = len(between) <= REACH and bool(linked[between].all())
        usable = usable & ~(linked & ~amid)
    return "\n".join(lines[k][0] for k in np.flatnonzero(usable & inside))


def extract_text(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``df`` without its html, with the main text (empty if there is none, or
    if the html is null).  Other columns pass through; a column named like the
    new one is replaced.  An empty table gives no rows."""
    ready(df.sparkSession)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return df.withColumn(out, F.arrow_udf(of, "string")(F.col(html_col))).drop(*([html_col] if html_col != out else []))
