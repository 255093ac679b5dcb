"""Main text of HTML pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering.

The standard library's streaming parser feeds events to ``Page``, which cuts a
page into lines, one per block, each with its text, its tags and the region
(sectioning element) it stands in.  Each line has a text-to-tag ratio; the ratios
are smoothed over neighbouring lines, and a threshold between two clusters of
them says which lines read like content.  A region is content when lines above
the threshold hold most of its text, and then all of its lines are kept, short
ones too; a page's ``article`` or ``main`` takes the place of a page-wide region, and one that holds any line above it is content.
Lines of menus, adverts, forms, comments and the like are told by element, role
and class: they count for the threshold, but are never content.  A form, or an
element told by class or id, that the page stands in is none of them: one that holds
an ``article`` or ``main``, where none is outside it, and at least as much text as is
outside, or, without, nine times that text.  The page is then read again without that mark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot "
    "th thead title tr ul".split()
)
_REGIONS = frozenset("article body div main section td".split())
_DROPPED = frozenset(
    "aside button canvas datalist dialog embed footer form head iframe input label menu nav noscript object optgroup option script select "
    "style svg template textarea title audio video map".split()
)
_RAW = frozenset(("script", "style"))
_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class and id names of what isn't the article.
_MARKS = frozenset(
    "ad ads adbox adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist cookie "
    "cookies copyright consent disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup privacy promo promoted promotion related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
#: Those that an article has as parts of its own.
_OWN = frozenset(("header",))
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Elements that an opening tag closes, and where the search for them ends.
_CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "option": ("option", "select datalist"), "tbody": ("tbody thead tfoot tr td th", "table"),
}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_P_CLOSERS = _BLOCKS - frozenset("br body head html title option caption legend summary tbody td tfoot th thead tr dd dt li".split())
_NAME = re.compile(r"[a-z]+")


def _marked(attrs: list[tuple[str, str | None]], prose: bool, inside: bool) -> int:
    """1 if the element is hidden or has such a role, 2 if only its class or id says what it is.

    Inside an article, headings and paragraphs (``prose``) are told by no name, and a header is the article's own.
    """
    found = 0
    for name, value in attrs:
        if name in ("class", "id"):
            words = set(_NAME.findall((value or "").lower())) - (_OWN if inside else frozenset())
            if not prose and not _MARKS.isdisjoint(words):
                found = 2
        elif name == "role" and (value or "").strip().lower() in _ROLES:
            return 1
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return 1
    return found


@dataclass
class Line:
    region: int
    dropped: int = 0
    tags: int = 0
    parts: list[str] = field(default_factory=list)
    text: str = ""


class Page(HTMLParser):
    """Cuts a page into lines while the parser runs; an element left open ends with its parent."""

    def __init__(self, released: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        # Element, dropped, region; dropped is 0, 1, or minus the number of the element whose class, id or form says so.
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]
        self.released, self.seen = released, 1
        self.held: dict[int, int] = {}  # text inside such elements
        self.articles: set[int] = set()  # those that hold an article or main
        self.regions: list[tuple[str, int]] = [("", -1)]  # element, parent
        self.lines: list[Line] = [Line(0)]

    def _break(self) -> None:
        (_, dropped, region), last = self.stack[-1], self.lines[-1]
        if last.parts or (last.dropped, last.region) != (dropped, region):
            self.lines.append(Line(region, dropped))

    def _close(self, places: frozenset[str], stops: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in places:
                del self.stack[i:]
                return
            if self.stack[i][0] in stops:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _P_CLOSERS:
            self._close(frozenset(("p",)), _REGIONS | frozenset(("button", "table", "li", "blockquote", "figure")))
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag == "body" and any(s[0] == "head" for s in self.stack):
            self._close(frozenset(("head",)), frozenset())
        _, dropped, region = self.stack[-1]
        # A page header is dropped, one inside an article is its heading.
        self.seen += 1
        if not dropped and tag in _DROPPED and tag != "form":
            dropped = 1
        if not dropped and tag == "header" and not any(s[0] in ("article", "main") for s in self.stack):
            dropped = 1
        if not dropped and tag == "form" and self.seen not in self.released:
            dropped = -self.seen
        inside = any(s[0] in ("article", "main") for s in self.stack)
        if not dropped and attrs and tag not in ("html", "body", "main") and (tag != "article" or inside):
            mark = _marked(attrs, tag in _PROSE and inside, inside)
            dropped = 1 if mark == 1 else -self.seen if mark and self.seen not in self.released else 0
        if dropped < 0 and tag in ("article", "main"):
            self.articles.add(-dropped)
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._break()
            self.lines[-1].tags += 1
            return
        if tag in _REGIONS and not dropped:
            self.regions.append((tag, region))
            region = len(self.regions) - 1
        self.stack.append((tag, dropped, region))
        if tag in _BLOCKS:
            self._break()
        elif dropped != self.lines[-1].dropped:
            self._switch(dropped)
        self.lines[-1].tags += 1

    def _switch(self, dropped: int) -> None:
        """An inline element that is dropped, or its end: the text around it stays one line."""
        self.lines.append(Line(self.stack[-1][2], dropped))

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                if tag not in _BLOCKS and any(s[0] in _BLOCKS for s in self.stack[i + 1 :]):
                    return  # a stray inline end tag doesn't close the blocks around it
                del self.stack[i:]
                break
        if tag in _BLOCKS:
            self._break()
        elif self.stack[-1][1] != self.lines[-1].dropped:
            self._switch(self.stack[-1][1])

    def around(self, region: int, name: str) -> int:
        """The outermost region of that element around one, or -1."""
        found = -1
        while region > 0:
            element, parent = self.regions[region]
            found, region = (region if element == name else found), parent
        return found

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] not in _RAW:
            self.lines[-1].parts.append(data)
            if (dropped := self.stack[-1][1]) < 0 and not any(s[0] in _DROPPED and s[0] != "form" for s in self.stack):
                self.held[-dropped] = self.held.get(-dropped, 0) + len(" ".join(data.split()))


def _smoothed(values: np.ndarray, radius: int = 2) -> np.ndarray:
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2.0 * max(1, radius / 2) ** 2))
    weight = np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]
    return np.convolve(values, kernel)[radius : radius + len(values)] / weight


def _threshold(values: np.ndarray) -> float:
    """The middle between two clusters of the values (one-dimensional 2-means); the least of them if they are one."""
    low, high = float(values.min()), float(values.max())
    if high <= 1.5 * low:
        return low
    for _ in range(20):
        cut = (low + high) / 2
        above = values >= cut
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _read(html: str) -> tuple[Page, list[Line]]:
    """The page and its lines, without the marks of what the page stands in; every turn releases one more, however deep they are."""
    released: frozenset[int] = frozenset()
    while True:
        page = Page(released)
        page.feed(html)
        page.close()
        lines = _joined(page.lines)
        if not page.held:
            return page, lines
        outside = [x for x in lines if not x.dropped]
        size, most = sum(len(x.text) for x in outside), max(page.held, key=page.held.__getitem__)
        if any(page.around(x.region, n) >= 0 for x in outside for n in ("article", "main")):
            return page, lines
        if page.held[most] < max(1, (1 if most in page.articles else 9) * size):
            return page, lines
        released |= {most}


def main_text(html: str) -> str:
    page, lines = _read(html)
    if not lines or all(x.dropped for x in lines):
        return ""
    sizes = np.array([len(x.text) for x in lines], float)
    ratio = _smoothed(np.log1p(sizes / np.array([max(1, x.tags) for x in lines])))
    content = ratio >= _threshold(ratio)
    place, need = np.array([-1 if x.dropped else x.region for x in lines]), 0.5
    for name in ("article", "main"):
        outer = np.array([-1 if x.dropped else page.around(x.region, name) for x in lines])
        if (outer >= 0).any():
            place, need = outer, 0.0
            break
    found = [p for p in np.unique(place) if p >= 0]
    whole = {p: sizes[place == p].sum() for p in found}
    most = max(found, key=whole.__getitem__)
    kept = {p for p in found if (share := sizes[content & (place == p)].sum() / whole[p]) >= need and share > 0 or not need and 4 * whole[p] >= whole[most]}
    kept = kept or {most}  # nothing stands out: the region with the most text
    return " ".join(x.text for x, p in zip(lines, place) if p in kept)


def _joined(lines: list[Line]) -> list[Line]:
    """The lines that hold text, with white space as single spaces."""
    out = []
    for line in lines:
        line.text = " ".join("".join(line.parts).split())
        if line.text:
            out.append(line)
    return out


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: keys, text, n_chars (code points); no shuffle.

    A null or empty page, and one without content, has an empty text.  Broken
    markup is read as far as the parser gets, which is always to the end.
    Repeated rows are read one by one; other columns are not read.
    """
    small_batches(pages.sparkSession, 500)
    names = [f"_{i}" for i in range(len(keys))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [main_text(h) if h else "" for h in pdf["_html"]]
            yield pd.DataFrame({**{n: pdf[n] for n in names}, "_text": texts, "_n": [len(t) for t in texts]})

    plain = pages.select(*(F.col(f"`{k}`").cast("string").alias(n) for k, n in zip(keys, names)), F.col(f"`{html}`").cast("string").alias("_html"))
    out = plain.mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", _text string, _n long")
    types = {k: pages.schema[k].dataType for k in keys}
    return out.select(*(F.col(n).cast(types[k]).alias(k) for k, n in zip(keys, names)), F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
