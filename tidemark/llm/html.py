"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements part the page into lines. A line has its text, its number of
tags, what of it is in links, and its chain of containers. The logarithms of the ratios of text to tags (from ``FULL`` on all
alike) are smoothed along the page with a Gaussian, two means of the smoothed values give the threshold, and lines above it (lines of full text: above three quarters of it) that aren't mostly links are content. The region
is the page's only article or main element if that holds most of the content's text, else the innermost container that holds
most of it and has no content beside it. A region grows by elements: its result is the lines that stand in it directly or in
one of its containers that has content or that lies between content and is not mostly links.

Lists of elements, roles and class names only correct this. Menus, footers, asides, hidden elements and reader comments are left
out; forms, headers and elements whose class or id has a boilerplate word as a name of its own or as the first or last part of
one (not "has-sidebar" and the like) are left out unless they hold half of the page's text.

Defined results: a null, empty or text-free page gives the empty text; broken markup is parsed as far as it goes (open
elements end where an enclosing one ends); each page is worked on by itself, so repeated pages give repeated rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column

from tidemark.llm.texts import over_texts

#: Elements by their role in a page.
SILENT = frozenset("script style noscript template head title svg math canvas object embed iframe audio video select option textarea button".split())
OUT = frozenset("nav footer aside menu dialog".split())
DOUBTFUL = frozenset("header form fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article main section div td body html blockquote".split())
#: Elements by which a page itself marks its content, and the ratio from which a line is full text.
MARKED = frozenset(("article", "main"))
FULL = 100.0
#: The ratio above which smoothed lines are content however the two means lie, as on a page of nothing but text.
ENOUGH = 8.0
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended widget toolbar pagination pager skip".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Parts of names that say something about a page, not what an element is.
ABOUT = frozenset("has with without no is layout open closed enabled disabled".split())
#: An open element on the left is closed by the start of one on the right.
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


CLOSES = {tag: [x for x, by in CLOSED_BY.items() if tag in by] for tag in frozenset().union(*CLOSED_BY.values())}
#: Nothing beyond these is closed by the start of an element.
BOUNDS = CONTAINER | frozenset("table ul ol dl select".split())


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters in links
    out: bool
    doubtful: int  # the innermost element around it that is left out unless it holds most of the text
    container: int  # the innermost


class Open(NamedTuple):
    tag: str
    silent: bool
    out: bool
    doubtful: int
    container: int
    link: bool


class Tree:
    """Elements numbered in the order in which they begin, each with the one around it; 0 is around all. So an element's descendants are the numbers up to its last one."""

    def __init__(self) -> None:
        self.parent = [-1]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        return len(self.parent) - 1

    def sums(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For each element the weights of what stands in it, at any depth."""
        out = np.bincount(at, weight, len(self.parent)).tolist()
        for n in range(len(self.parent) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return np.array(out)

    def last(self) -> list[int]:
        out = list(range(len(self.parent)))
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] = max(out[self.parent[n]], out[n])
        return out

    def below(self, at: int) -> list[int]:
        """For each element that child of ``at`` in which it stands; itself where it stands in none."""
        out = list(range(len(self.parent)))
        for n in range(at + 1, len(out)):
            if self.parent[n] != at:
                out[n] = out[self.parent[n]] if self.parent[n] > at else n
        return out


def named(names: str, among: frozenset[str]) -> bool:
    """Whether a class or id is one of these words, or has one as its first or last part."""
    for name in names.lower().split():
        parts = re.split(r"[-_]+", name.strip("-_"))
        if (parts[0] in among or parts[-1] in among) and ABOUT.isdisjoint(parts):
            return True
    return False


class Lines(HTMLParser):
    """Collects the lines of a page. What an open element says is kept with it, and the places of open elements by name, so each tag takes a constant time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}  # in ``open``, by element
        self.bounds: list[int] = []
        self.lines: list[Line] = []
        self.containers, self.doubts = Tree(), Tree()
        self.names = [""]  # of each container: its element
        self.outer = [0]  # and the outermost article or main element that it is or stands in
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.unended = False

    def parse_comment(self, i: int, report: int = 1) -> int:
        """Once a comment has no end no later one has; so it isn't looked for again."""
        end = -1 if self.unended else super().parse_comment(i, report)
        self.unended = end < 0
        return end

    def state(self) -> Open:
        return self.open[-1] if self.open else Open("", False, False, 0, 0, False)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        at = self.state()
        if text:
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), at.out, at.doubtful, at.container))
            self.tags = 0
        self.text, self.linked = [], 0

    def close_to(self, k: int) -> None:
        closed = self.open[k:]
        if any(x.tag in BLOCK for x in closed):
            self.flush()
        for x in closed:
            self.places[x.tag].pop()
            if x.tag in BOUNDS:
                self.bounds.pop()
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self.flush()
        place = max((self.places[x][-1] for x in CLOSES.get(tag, ()) if self.places.get(x)), default=-1)
        if place >= (self.bounds[-1] if self.bounds else 0):
            self.close_to(place)
        if tag in VOID:
            return
        at, own = self.state(), self.state().container
        a = {k: v or "" for k, v in attrs}
        names, page = f"{a.get('class', '')} {a.get('id', '')}", tag in ("html", "body")
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))
        out = tag in OUT or hidden or a.get("role", "").lower() in ROLES or (not page and tag != "main" and named(names, COMMENTS))
        doubtful = tag in DOUBTFUL or (not page and tag not in MARKED and named(names, WORDS))
        if tag in CONTAINER or tag in OUT or tag in DOUBTFUL:
            own = self.containers.add(own)
            self.names.append(tag)
            self.outer.append(self.outer[at.container] or (own if tag in MARKED else 0))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BOUNDS:
            self.bounds.append(len(self.open))
        self.open.append(Open(tag, at.silent or tag in SILENT, at.out or out, self.doubts.add(at.doubtful) if doubtful else at.doubtful, own, at.link or tag == "a"))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.places.get(tag):
            self.close_to(self.places[tag][-1])
        elif tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.state().silent:
            self.text.append(data)
            self.linked += len(data) if self.state().link else 0

    def corrected(self) -> np.ndarray:
        """Which lines the lists leave: a doubtful element of several lines that holds half of the text, and any article there is, is no boilerplate."""
        out = np.array([x.out for x in self.lines])
        length = np.where(out, 0, [len(x.text) for x in self.lines])
        article = ~out & np.array([self.outer[x.container] > 0 for x in self.lines])
        at = np.array([x.doubtful for x in self.lines])
        lines, held, articles = (self.doubts.sums(at, w) for w in (~out, length, article))
        kept = ((lines > 1) & (2 * held >= length.sum()) & (articles == article.sum())).tolist()
        kept[0] = True
        for n in range(1, len(kept)):
            kept[n] = kept[n] and kept[self.doubts.parent[n]]
        return ~out & np.array(kept)[at]

    def marked(self, content: np.ndarray, weight: np.ndarray, least: float) -> int | None:
        """The outermost article or main element with content, if it is the only one and holds so much weight."""
        held: dict[int, float] = {}
        for k in np.flatnonzero(content):
            if outer := self.outer[self.lines[k].container]:
                held[outer] = held.get(outer, 0.0) + weight[k]
        return next(iter(held)) if len(held) == 1 and sum(held.values()) >= least else None

    def region(self, content: np.ndarray) -> int:
        """The container of all content that no inner one holds, or the first article or main element on the way to it."""
        held = self.containers.sums(np.array([x.container for x in self.lines]), content)
        at = 0
        for n in range(1, len(held)):  # children come after their parents
            if self.containers.parent[n] == at and held[n] == held[0]:
                at = n
                if self.names[n] in MARKED:
                    break
        return at


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    return np.convolve(ratio, kernel)[reach : reach + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """Two means in one dimension; the threshold lies between them."""
    low, high = float(values.min()), float(values.max())
    for _ in range(30):
        cut = (low + high) / 2
        above = values >= cut
        if above.all() or not above.any():
            return cut if high > low else low
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def extract(html: str | None, sigma: float = 1.0, share: float = 0.6) -> tuple[str, int, int, float]:
    """(text, lines, lines kept, threshold)"""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return "", 0, 0, 0.0
    length = np.array([len(x.text) for x in lines], float)
    ratio = np.log1p(np.minimum(FULL, length / np.array([max(1, x.tags) for x in lines])))
    smooth = smoothed(ratio, sigma)
    limit = min(threshold(smooth), float(np.log1p(ENOUGH)))
    left = parser.corrected()
    # one line of full text between two short ones is smoothed to under the threshold, but not far
    links = 2 * np.array([x.linked for x in lines]) >= length
    content = left & ~links & ((smooth >= limit) | ((ratio >= np.log1p(FULL)) & (smooth >= 0.75 * limit)))
    if not content.any():
        content = left
    at = parser.marked(content, length, share * float(length[content].sum()))
    at = parser.region(content) if at is None else at
    last, below = parser.containers.last()[at], parser.containers.below(at)
    inside = [k for k in np.flatnonzero(content).tolist() if at <= lines[k].container <= last]
    units: dict[int, list[int]] = {}
    for k, x in enumerate(lines):
        if left[k] and at <= x.container <= last:
            units.setdefault(below[x.container], []).append(k)
    chosen: list[int] = []
    for unit, own in units.items():
        between = bool(inside) and inside[0] < own[0] and own[-1] < inside[-1]
        if unit == at or content[own].any() or (between and 2 * sum(lines[k].linked for k in own) < length[own].sum()):
            chosen += own
    return "\n\n".join(lines[k].text for k in sorted(chosen)), len(lines), len(chosen), float(limit)


def main_text(column: Column, sigma: float = 1.0, share: float = 0.6) -> Column:
    """A struct (text, n_chars, n_lines, n_kept, threshold) for each page's html."""

    def start():
        def score(pages: list[str | None]) -> pd.DataFrame:
            rows = [extract(x, sigma, share) for x in pages]
            return pd.DataFrame([(t, len(t), n, k, c) for t, n, k, c in rows], columns=["text", "n_chars", "n_lines", "n_kept", "threshold"])

        return score

    return over_texts(column, start, "text string, n_chars long, n_lines long, n_kept long, threshold double")
