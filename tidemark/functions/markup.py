"""Markup as tokens: text and tags told apart by the states of an HTML tokenizer, in one pass over the text.

Unlike a chain of patterns this knows quoted values (a ``>`` inside one ends no tag), comments and raw text elements, and
what is left open at the end: an unfinished tag or comment hides the rest, as it does in a browser. Time is linear in
the length also for broken markup. Null gives null, empty text gives empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import ALLOWED_ELEMENTS, BLOCK_ELEMENTS, swap_entities

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
# one attribute: a name, and a value in double quotes, in single quotes, or bare; an open quote runs to the end
_ATTRIBUTE = re.compile(
    r"""[\s/]*+(?:(?P<name>[^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"(?P<double>[^"]*+)(?:"|\Z)|'(?P<single>[^']*+)(?:'|\Z)|(?P<bare>[^\s>]*+)))?)?"""
)
_SHORT_COMMENT = re.compile(r"-?>")  # "<!-->" and "<!--->" are whole comments
_COMMENT_END = re.compile(r"--!?>")

#: Elements whose content is no markup; only their own closing tag ends them.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "iframe")}
# Elements that may stand in a head without ending it.
_HEAD = frozenset(("base", "basefont", "bgsound", "head", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"))
_BLOCKS, _ALLOWED = frozenset(BLOCK_ELEMENTS), frozenset(ALLOWED_ELEMENTS)


def tokens(html: str) -> Iterator[tuple[str, str, str | None]]:
    """(kind, value, href): kind ``text`` with the text, ``open`` or ``close`` with the name as written, the first href."""
    at, size = 0, len(html)
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            yield "text", html[at:], None
            return
        if begin > at:
            yield "text", html[at:begin], None
        at = begin
        closing = html.startswith("/", at + 1)
        name = _NAME.match(html, at + 1 + closing)
        if name is None:
            if html.startswith("<!--", at):
                ends = _SHORT_COMMENT.match(html, at + 4) or _COMMENT_END.search(html, at + 4)
                at = ends.end() if ends else size
            elif closing or html.startswith(("!", "?"), at + 1):
                end = html.find(">", at)
                at = end + 1 if end >= 0 else size
            else:
                yield "text", "<", None
                at += 1
            continue
        at, href = name.end(), None
        while True:
            found = _ATTRIBUTE.match(html, at)
            at = found.end()
            if found["name"] is None:
                break
            if href is None and found["name"].lower() == "href":
                href = next((v for v in (found["double"], found["single"], found["bare"]) if v is not None), "")
        if at >= size:
            return  # an unfinished tag
        at += 1
        yield "close" if closing else "open", name[0], href
        raw = None if closing else _RAW.get(name[0].lower())
        if raw is not None:
            end = raw.search(html, at)
            if end is None:
                return
            at = end.start()


def _shown(html: str, dropped: frozenset[str]) -> Iterator[tuple[str, str, str | None]]:
    """Tokens outside the dropped elements and the head; a dropped element leaves its closing tag."""
    head, inside, depth = False, None, 0
    for kind, value, href in tokens(html):
        name = value.lower()
        if inside is not None:
            if kind != "text" and name == inside:
                depth += 1 if kind == "open" else -1
            if depth:
                continue
            inside = None
        elif kind == "open" and name in dropped:
            inside, depth = name, 1
            continue
        if head and kind != "text":
            # a head ends with its closing tag or with the first element that cannot stand in it
            head = not (name == "head" if kind == "close" else name not in _HEAD)
            if head or name == "head":
                if not head:
                    yield kind, value, href
                continue
        elif kind == "open" and name == "head":
            head = True
            continue
        if not head:
            yield kind, value, href


def _flat(html: str) -> str:
    out = []
    for kind, value, _ in _shown(html, frozenset(("script", "style"))):
        name = value.lower()
        out.append(value if kind == "text" else " " if name in _BLOCKS or name in ("script", "style") else "")
    return "".join(out)


_ESCAPES = str.maketrans({'"': "&quot;", "<": "&lt;", ">": "&gt;"})


def _allowed(html: str) -> str:
    out = []
    for kind, value, href in _shown(html, frozenset(("script", "style", "iframe", "object"))):
        if kind == "text":
            out.append(value.replace("<", "&lt;"))
        elif value.lower() in _ALLOWED:
            if kind == "close":
                out.append(f"</{value}>")
            elif value.lower() == "a" and href is not None:
                out.append(f'<{value} href="{href.translate(_ESCAPES)}">')
            else:
                out.append(f"<{value}>")
    return "".join(out)


@F.pandas_udf(StringType())
def _flatten(html: pd.Series) -> pd.Series:
    return html.map(_flat, na_action="ignore")


@F.pandas_udf(StringType())
def _clean(html: pd.Series) -> pd.Series:
    return html.map(_allowed, na_action="ignore")


def visible_text(html: Column) -> Column:
    """Visible text: head, scripts, styles and comments dropped, block tags part words, inline tags do not."""
    return F.trim(F.regexp_replace(swap_entities(_flatten(html)), r"\s+", " "))


def allowed_markup(html: Column) -> Column:
    """Keep the allowed elements, drop all attributes but ``href``. A text job, not a security control."""
    return _clean(html)
