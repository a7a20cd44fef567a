"""Markup as a stream of tags and text, read in one pass as browsers read it.

A state machine over text, tags, attributes, comments and raw text (scripts, styles): values in double, single or no quotes, names in any case, `>` inside
values, comments and declarations, and tags that never end. Every token carries its place, so that what is not changed can be copied as it stands. Work is linear
in the markup's length, whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(\s*=\s*)?""")
_BARE = re.compile(r"[^\s>]*")
_SKIP = re.compile(r"[\s/]*")
#: Elements whose content is text without tags up to their end tag.
RAW = frozenset({"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"})


class Token(NamedTuple):
    """kind: text, open, close or other (comments and declarations); name: of a tag, lower case; attributes: (name, value, start, end) with places of the raw value, quotes included, None without one."""

    kind: str
    start: int
    end: int
    name: str = ""
    attributes: tuple[tuple[str, str | None, int, int], ...] = ()
    alone: bool = False


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str | None, int, int]], int, bool]:
    """A tag's attributes from `at`, where the tag ends, and whether it ends in />; the first of equal names counts."""
    found, n, names = [], len(page), set()
    while True:
        before, at = at, _SKIP.match(page, at).end()
        if at >= n:
            return found, n, False
        if page[at] == ">":
            return found, at + 1, page[at - 1] == "/" and at > before
        if page[at] == "=":
            at += 1
            continue
        m = _ATTRIBUTE.match(page, at)
        name, at, value, start, end = m[1].lower(), m.end(), None, -1, -1
        if m[2]:
            start = at
            if page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                end = n if end < 0 else end + 1
                value = page[at + 1 : end - 1] if page[end - 1] == page[at] and end > at + 1 else page[at + 1 : end]
            else:
                end = _BARE.match(page, at).end()
                value = page[at:end]
            at = end
        if name not in names:
            names.add(name)
            found.append((name, value, start, end))


def tokens(page: str) -> Iterator[Token]:
    """Tokens of a page in order, which cover it without gaps."""
    at, n, raw = 0, len(page), None
    absent: set[str] = set()  # end marks that the rest of the page lacks
    lower = None
    while at < n:
        if raw is not None:
            lower = page.lower() if lower is None else lower
            lower = lower if len(lower) == n else "".join(c.lower() if c.isascii() else c for c in page)
            end = -1 if raw in absent else lower.find(f"</{raw}", at)
            if end < 0:
                absent.add(raw)
                end = n
            if end > at:
                yield Token("text", at, end, raw)
            at, raw = end, None
            continue
        sign = page.find("<", at)
        while 0 <= sign < n - 1 and not (page[sign + 1] in "!?/" or page[sign + 1].isascii() and page[sign + 1].isalpha()):
            sign = page.find("<", sign + 1)
        sign = n if sign < 0 or sign >= n - 1 else sign
        if sign > at:
            yield Token("text", at, sign)
            at = sign
            continue
        mark = page[at + 1]
        if page.startswith("<!--", at):
            # <!--> and <!---> are whole comments
            end = at + 5 if page.startswith(">", at + 4) else at + 6 if page.startswith("->", at + 4) else -1 if "-->" in absent else page.find("-->", at + 4)
            if end < 0:
                absent.add("-->")
                end = n
            elif not page.startswith((">", "->"), at + 4):
                end += 3
            yield Token("other", at, end)
            at = end
        elif mark in "!?" or mark == "/" and not (page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()):
            end = -1 if ">" in absent else page.find(">", at + 2)
            if end < 0:
                absent.add(">")
            end = n if end < 0 else end + 1
            yield Token("other", at, end)
            at = end
        else:
            m = _NAME.match(page, at + 1 + (mark == "/"))
            attributes, end, alone = _attributes(page, m.end())
            name = m[0].lower()
            yield Token("close" if mark == "/" else "open", at, end, name, tuple(attributes), alone)
            at = end
            raw = name if mark != "/" and name in RAW and end < n else None


def rewritten(page: str, tag: str, attribute: str, changes: dict[str, str]) -> str:
    """page with the values of a tag's attribute that changes has, their references decoded, replaced and quoted; all else as it stands."""
    parts, at = [], 0
    for t in tokens(page):
        if t.kind == "open" and t.name == tag:
            for name, value, start, end in t.attributes:
                if name == attribute and value is not None and (new := changes.get(html.unescape(value))) is not None:
                    parts += [page[at:start], '"', new.replace("&", "&amp;").replace('"', "&quot;"), '"']
                    at = end
    return "".join([*parts, page[at:]]) if parts else page


def rewrite_attribute(page: Column, tag: str, attribute: str, changes: Column) -> Column:
    """page with the values of tag's attribute replaced as a map has it, whatever their quotes, case and references; a null page stays null, a null map changes nothing."""

    @F.pandas_udf(T.StringType())
    def rewrite(pages: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([p if p is None or not m else rewritten(p, tag, attribute, dict(m)) for p, m in zip(pages, maps, strict=True)], dtype=object)

    return rewrite(page, changes)
