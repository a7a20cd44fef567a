r"""Main text of web pages, by the distribution of line blocks.

Markup is stripped by a tokenizer (darkroom.functions.markup). What is left are lines: one for each block of text, and empty ones where
markup stood: one at each edge of a container, WINDOW where an element goes altogether (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and readers' comments, known by element, role and words of class and id) and at the edges of <article> and <main>. Lengths of lines,
links not counted, are summed over windows of WINDOW lines. Text surges where a window's sum leaves zero and dives where it is zero again; the
text between is a body, with all its lines. A body counts if some window of it reaches LEAST characters, or if it shares a container with lines of one that
does (an advert between a heading and its text parts them); if none does, the largest one counts.

Where a page marks its article, lines outside it are empty and every body inside counts, however short: articles first, then <main>, then the whole page.
If words of class and id leave nothing of a page, they are not looked at.

Inside a block references are decoded and white space is one space; <br> is white space. Blocks are joined by \n in the page's order. Work is linear in the page.

Defined cases: null and empty pages have an empty text; markup that ends early or is never closed reads as browsers read it; repeated rows and null keys
stay as they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.functions import markup

WINDOW, LEAST = 3, 80
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre"
    " section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("blockquote center div dl fieldset ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that are never main text; those of WEAK may hold the page's article all the same.
GONE = frozenset("nav footer aside menu dialog head title script style noscript template iframe noembed noframes object applet svg math canvas audio video map select datalist textarea button xmp".split())
WEAK = frozenset({"header", "form"})
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
#: Words of class and id: readers' comments, and all else that is no main text.
COMMENTS = frozenset("comment comments commentlist commentary reply replies respond responses disqus discussion".split())
WORDS = frozenset(
    "menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside header headers masthead topbar footer footers colophon copyright ad ads advert adverts advertisement advertisements advertising adsense"
    " banner banners sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay toast newsletter subscribe subscription signup login signin"
    " share sharing social related recommended recommendations widget widgets toolbar pagination pager search form forms".split()
)
#: With one of these a class says what the page has, not what the element is: has-sidebar, no-ads.
ABOUT = frozenset("with without no not has have".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: An open element is closed by the next of its kind, unless one of the others stands between.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


def _named(values: tuple[str | None, ...]) -> set[str]:
    """Words of classes and ids, lower case, without those of names that say what the page has."""
    out = set()
    for value in values:
        for name in (value or "").split():
            parts = {p.lower() for p in _PART.findall(name)}
            if not parts & ABOUT:
                out |= parts
    return out


def _goes(t: markup.Token, by_words: bool) -> str:
    """"" for an element that stays, "weak" for one that goes unless it holds the article, "gone"."""
    if t.name in ("html", "body", "main"):
        return ""
    if t.name in GONE:
        return "gone"
    if t.attributes:
        a = {name: value for name, value, _, _ in t.attributes}
        if "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or "display:none" in re.sub(r"\s", "", a.get("style") or "").lower():
            return "gone"
        if by_words and ("class" in a or "id" in a):
            words = _named((a.get("class"), a.get("id")))
            if words & COMMENTS:
                return "gone"
            if words & WORDS:
                return "gone" if t.name == "article" else "weak"
        if (a.get("role") or "").lower() in ROLES:
            return "weak"
    return "weak" if t.name in WEAK else ""


class Lines:
    """Lines of a page: their texts, lengths without links, and whether they lie in an article or <main>."""

    def __init__(self, page: str, by_words: bool = True) -> None:
        self.texts: list[str] = []
        self.lengths: list[int] = []
        self.article: list[bool] = []
        self.main: list[bool] = []
        self.box: list[int] = []  # the innermost container of each line; 0: none
        self.boxes, self.n_boxes = [0], 0
        self.parts: list[tuple[str, bool]] = []
        self.stack: list[tuple[str, str]] = []
        self.open: Counter[str] = Counter()
        self.state: Counter[str] = Counter()  # open elements that go, by how; links, articles, mains that count
        for t in markup.tokens(page):
            if t.kind == "text":
                if not self.state["gone"] and not self.state["weak"]:
                    self.parts.append((html.unescape(page[t.start : t.end]), self.state["link"] > 0))
            elif t.kind == "open":
                self.opened(t, by_words)
            elif t.kind == "close" and self.open[t.name]:
                while self.popped() != t.name:
                    pass
        self.ended()

    def opened(self, t: markup.Token, by_words: bool) -> None:
        if t.name == "br":
            self.parts.append((" ", False))
            return
        if t.name in BLOCKS:
            self.closed_before({"p"}, None)
            if t.name in CLOSED_BY:
                self.closed_before(*CLOSED_BY[t.name])
            self.ended()
        if t.name in VOID:
            return
        how = "" if self.state["gone"] else _goes(t, by_words)
        kind = how
        if how:
            self.gap(WINDOW)
        elif t.name in ("article", "main") and not self.state["gone"]:
            kind = t.name
            self.gap(WINDOW)
            if self.state["weak"]:  # what was thought to go holds the article
                kind, self.held = f"{t.name}+", [*getattr(self, "held", []), self.state["weak"]]
                self.state["weak"] = 0
            self.state[t.name] += 1
        elif t.name == "a":
            kind = "link"
            self.state["link"] += 1
        if how:
            self.state[how] += 1
        if t.name in CONTAINERS:
            self.gap(1)
            self.n_boxes += 1
            self.boxes.append(self.n_boxes)
        self.stack.append((t.name, kind))
        self.open[t.name] += 1

    def closed_before(self, names: set[str], until: set[str] | None) -> None:
        """Closes the last open element of these names, unless one of `until` (None: one that is not inline) is open inside it."""
        if not any(self.open[n] for n in names):
            return
        for name, _ in reversed(self.stack):
            if name in names:
                while self.popped() not in names:
                    pass
                return
            if name not in INLINE if until is None else name in until:
                return

    def popped(self) -> str:
        name, kind = self.stack.pop()
        self.open[name] -= 1
        if name in BLOCKS:
            self.ended()
        if name in CONTAINERS:
            self.boxes.pop()
        if kind.endswith("+"):
            self.state["weak"] = self.held.pop()
            kind = kind[:-1]
        if kind:
            self.state[kind] -= 1
        if kind and kind != "link":
            self.gap(WINDOW)
        elif name in CONTAINERS:
            self.gap(1)
        return name

    def gap(self, n: int) -> None:
        self.ended()
        self.add("", 0, n)

    def add(self, text: str, length: int, n: int = 1) -> None:
        self.texts += [text] * n
        self.lengths += [length] * n
        self.article += [self.state["article"] > 0] * n
        self.main += [self.state["main"] > 0] * n
        self.box += [self.boxes[-1]] * n

    def ended(self) -> None:
        """The block that is being read ends."""
        if self.parts:
            text = " ".join("".join(s for s, _ in self.parts).split())
            if text:
                self.add(text, sum(len(s.strip()) for s, link in self.parts if not link))
            self.parts = []


def bodies(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of lines whose windows are not all empty; the first and last line of each have text."""
    if not len(lengths):
        return []
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))  # windows that end at each line, and beyond the last
    some = np.concatenate([[False], sums > 0, [False]])
    surge, dive = np.flatnonzero(~some[:-1] & some[1:]), np.flatnonzero(some[:-1] & ~some[1:])
    return [(int(a), int(b) - WINDOW + 1) for a, b in zip(surge, dive, strict=True)]


def _chosen(lines: Lines, inside: list[bool] | None) -> list[str]:
    texts = np.array([bool(t) for t in lines.texts])
    lengths = np.array(lines.lengths, np.int64)
    if inside is not None:
        # inside an article links count too, as nothing of it goes
        lengths = np.where(np.array(inside), np.maximum(lengths, texts), 0)
        return [t for a, b in bodies(lengths) for t in lines.texts[a:b] if t]
    found = bodies(lengths)
    most = [int(np.convolve(lengths[a:b], np.ones(WINDOW, np.int64)).max()) for a, b in found]
    if found and max(most) < LEAST:
        most[int(np.argmax([lengths[a:b].sum() for a, b in found]))] = LEAST
    boxes = [{lines.box[i] for i in range(a, b) if lines.texts[i]} - {0} for a, b in found]
    counted = set().union(*(x for x, m in zip(boxes, most, strict=False) if m >= LEAST))
    return [t for (a, b), m, x in zip(found, most, boxes, strict=True) if m >= LEAST or x & counted for t in lines.texts[a:b] if t]


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    for by_words in (True, False):
        lines = Lines(page, by_words)
        for inside in (lines.article, lines.main, None):
            if inside is None or any(i and t for i, t in zip(inside, lines.texts, strict=True)):
                found = _chosen(lines, inside)
                if found:
                    return "\n".join(found)
    return ""


def extract(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    """(key, url, text, n_chars), a row for each page."""
    kinds = dict(pages.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(p.as_py()) for p in b.column("page")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), texts], names=["key", "url", "text"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    return rows.mapInArrow(read, f"key {kinds[key]}, url {kinds[url]}, text string").withColumn("n_chars", F.length("text").cast("long"))
