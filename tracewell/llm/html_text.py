"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser reports tags and text as it goes through a page;
nothing but the open elements and the lines found so far is held.  A line is
the text between two block borders.  Elements that never hold main text (menus,
page headers, footers, sidebars, notices, adverts, forms, scripts, reader
comments) are told by their tag, role or class, and their lines are no
candidates.  Of the others, the ratio of characters to tags of each line is
smoothed by a Gaussian over its neighbours, and a threshold between two
clusters of ratios divides content from the rest.  The content lines choose the
region: the article element that holds most of them, or, in a page without one,
the smallest element that holds nearly all.  All candidate lines of the region
belong to the text, short ones too.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.frames import map_text, read

#: Names of the HTML standard. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: A start of these ends an open one of the same set, up to the elements that may hold several.
ENDED_BY = {
    **dict.fromkeys(("li",), (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"}))),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset({"dl"}))),
    **dict.fromkeys(("td", "th"), (frozenset({"td", "th"}), frozenset({"tr", "table"}))),
    **dict.fromkeys(("tr",), (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"}))),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th"}), frozenset({"table"}))),
    **dict.fromkeys(("option",), (frozenset({"option"}), frozenset({"select", "datalist"}))),
}
#: Elements without main text, and those whose content is no text at all.
BOILERPLATE = frozenset("aside footer form nav menu dialog search head title".split())
SILENT = frozenset("script style noscript template svg math iframe object embed audio video canvas select datalist textarea button noframes frameset".split())
#: Roles and words of class names and ids that mark such elements.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad ads adslot adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs captcha cookie cookies consent copyright disclaimer disqus footer gdpr legal login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification notifications pager pagination popup promo promoted promotion recommended related search searchbox searchform share sharing sidebar sidebars signup skip social sponsor "
    "sponsored subscribe subscription teaser toolbar widget".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond discussion".split())
#: Class names of a page's header; an article's own header has other words beside it.
PAGE_HEADERS = frozenset({("header",), ("site", "header"), ("top", "header"), ("global", "header")})
_NOT_ITS_OWN = frozenset("has is no not with without".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_OPEN = re.compile(r"<[A-Za-z/!?]")
_SIGMA = 1.0
_WEIGHTS = np.exp(-(np.arange(-2, 3) ** 2) / (2 * _SIGMA**2))


def _marked(attrs: list[tuple[str, str | None]], words: frozenset[str]) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id"):
            for one in value.split():
                said = [w.lower() for w in _WORD.findall(one)]
                # a box "with-sidebar" holds more than one
                if _NOT_ITS_OWN.isdisjoint(said) and (not words.isdisjoint(said) or words is WORDS and tuple(said) in PAGE_HEADERS):
                    return True
        elif value and name == "role" and words is WORDS and value.strip().lower() in ROLES:
            return True
    return False


class _Events(HTMLParser):
    """Lines of one page: text, tags around it, links in it, and the element that each lies in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Of each element: parent, tag, whether its lines are candidates (else it is boilerplate), whether it is an article.
        self.parent, self.tags, self.good, self.article = [-1], [""], [True], [False]
        self.within = [False]  # an article, or below one
        self.open = [0]
        self.silent = 0
        self.lines: list[tuple[int, str, int, int]] = []
        self._text: list[str] = []
        self._n_tags = self._linked = self._links = 0

    def parse_marked_section(self, i, report=1):
        # unknown sections are comments to a browser
        return self.parse_bogus_comment(i)

    def _line(self):
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.lines.append((self.open[-1], text, self._n_tags, self._linked))
            self._text = []
        self._n_tags = self._linked = 0

    def _pop_to(self, place: int):
        for node in self.open[place:]:
            tag = self.tags[node]
            self.silent -= tag in SILENT
            self._links -= tag == "a"
        del self.open[place:]

    def _find(self, wanted: frozenset[str], until: frozenset[str]) -> int:
        for place in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[place]]
            if tag in wanted:
                return place
            if tag in until:
                break
        return 0

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCK
        if block:
            self._n_tags += 1
            self._line()
            place = self._find(frozenset({"p"}), _P_ENDS)
            if place:
                self._pop_to(place)
            if tag in ENDED_BY:
                place = self._find(*ENDED_BY[tag])
                if place:
                    self._pop_to(place)
        self._n_tags += 1
        if tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        up = self.open[-1]
        good = self.good[up]
        if block:
            if tag in ("article", "main") and not good:
                # an element that was never closed, or a form around the page, doesn't swallow the article
                good = self.tags[self._outer_bad()] in ("nav", "form", "header", "menu")
            if tag in BOILERPLATE or tag == "header" and not self.within[up]:
                good = False
            elif good and tag not in ("html", "body"):
                good = not _marked(attrs, COMMENT_WORDS) and (tag in ("main", "article") or not _marked(attrs, WORDS))
        self.parent.append(up)
        self.tags.append(tag)
        self.good.append(good)
        self.article.append(good and (tag in ("article", "main") or ("role", "main") in attrs))
        self.within.append(self.within[up] or self.article[-1])
        self.open.append(len(self.tags) - 1)
        self.silent += tag in SILENT
        self._links += tag == "a"

    def _outer_bad(self) -> int:
        return next(n for n in self.open if not self.good[n])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT:  # <script/> still opens an element in HTML, but svg's and others end here
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._n_tags += 1
        if tag == "br":
            self._text.append(" ")
            return
        if tag in BLOCK:
            self._line()
            place = self._find(frozenset({tag}), _SCOPES)
        else:
            # an inline end tag without its start closes nothing around it
            place = self._find(frozenset({tag}), BLOCK)
        if place:
            self._pop_to(place)

    def handle_data(self, data):
        if not self.silent and self.good[self.open[-1]]:
            self._text.append(data)
            if self._links:
                self._linked += len(data)

    def close(self):
        super().close()
        self._line()


_P_ENDS = frozenset(BLOCK - {"p"} | {"button"})
_SCOPES = frozenset({"table", "td", "th", "caption"})


def ratios(lines: list[tuple[int, str, int, int]]) -> np.ndarray:
    """Characters per tag of each line, smoothed by a Gaussian over two lines on either side."""
    raw = np.array([len(text) / max(1, tags) for _, text, tags, _ in lines])
    weights = np.convolve(np.ones(len(raw)), _WEIGHTS)[2 : 2 + len(raw)]
    return np.convolve(raw, _WEIGHTS)[2 : 2 + len(raw)] / weights


def threshold(values: np.ndarray) -> float:
    """Border of two clusters: each round halfway between the means of the values above and below."""
    border = float(values.mean())
    for _ in range(32):
        high = values >= border
        if high.all() or not high.any():
            break
        new = float(values[high].mean() + values[~high].mean()) / 2
        if new == border:
            break
        border = new
    return border


def _without_open_end(html: str) -> str:
    """The page without a tag or comment at its end that is never closed: it would hold the rest."""
    found = _OPEN.search(html, html.rfind(">") + 1)
    html = html[: found.start()] if found else html
    comment = html.find("<!--", html.rfind("-->") + 1)
    return html[:comment] if comment >= 0 and not re.search("</(?:script|style)", html[comment:], re.IGNORECASE) else html


def extract(html: str) -> str:
    """Main text of a page: blocks in page order, one a line; empty if it has none."""
    page = _Events()
    page.feed(_without_open_end(html))
    page.close()
    lines = page.lines
    if not lines:
        return ""
    smooth = ratios(lines)
    content = smooth >= threshold(smooth)
    chars = np.array([len(text) for _, text, _, _ in lines])
    # characters of content lines, and all, below each element: parents come before children
    held, total = np.zeros(len(page.parent)), np.zeros(len(page.parent))
    of = np.array([node for node, _, _, _ in lines])
    np.add.at(held, of, chars * content)
    np.add.at(total, of, chars)
    for node in range(len(page.parent) - 1, 0, -1):
        held[page.parent[node]] += held[node]
        total[page.parent[node]] += total[node]
    articles = [n for n in range(1, len(page.parent)) if page.article[n] and total[n]]
    if articles:
        outer = _below(page.parent, set(articles))
        within = [n for n in articles if not outer[page.parent[n]]]  # an article in another one is a part of it
        best = max(within, key=lambda n: (held[n], total[n], -n))
        # parts of one article in a row: those beside the best one that hold content of their own
        region = {n for n in within if n == best or page.parent[n] == page.parent[best] and page.tags[n] == page.tags[best] and 2 * held[n] >= held[best] > 0}
        inside = _below(page.parent, region)
        return "\n".join(text for node, text, _, _ in lines if inside[node])
    region = 0
    for node in range(1, len(page.parent)):
        if page.parent[node] == region and held[node] >= 0.9 * held[0] and page.tags[node] not in _LEAVES:
            region = node
    inside = np.array(_below(page.parent, {region}))[of]
    first, last = np.flatnonzero(content & inside)[[0, -1]]
    own = {page.parent[n] for n in of[content & inside]}
    links = np.array([linked for _, _, _, linked in lines])
    # at the ends, headings before them and what stands beside content lines in one element belong to them, unless mostly links
    heads = np.array([page.tags[n] in _HEADINGS for n in of]) & (np.arange(len(lines)) < first)
    beside = (heads | np.array([page.parent[n] in own for n in of])) & (2 * links < chars)
    at = np.arange(len(lines))
    return "\n".join(lines[i][1] for i in at[inside & (beside | (at >= first) & (at <= last))])


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote".split())


def _below(parent: list[int], tops: set[int]) -> list[bool]:
    """Which elements are among `tops` or below one; parents come before children."""
    out: list[bool] = []
    for node, up in enumerate(parent):
        out.append(node in tops or up >= 0 and out[up])
    return out


def main_text(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add text (main text, empty if there is none) and n_chars (its code points) to every row.

    Null and empty pages have no text.  Every row is read alone, so repeated rows and ties get equal
    texts.  White space (with the breaks of br) becomes one space within a block.  A page is one row
    and must fit a task's memory.  Kept columns named text or n_chars are replaced.
    """

    def setup():
        def work(pages: pa.Array) -> list[pa.Array]:
            found = [extract(p) if p else "" for p in pages.to_pylist()]
            return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

        return work

    return map_text(df, html, setup, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)


def op12_html_text(spark, sf_dir):
    """Main text of every page of `pages`."""
    return main_text(read(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", F.col("text"), "n_chars")
