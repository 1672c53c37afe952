"""Text expressions: canonical forms, fingerprints, search text, HTML to text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"

# Limits and marker of the body text handed to the model.
BODY_LIMIT = 16_000
BODY_MARKER = "\n\n[Email body truncated for task extraction]"

# Elements that start a new word when HTML is flattened.
BLOCK_ELEMENTS = (
    "address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "li", "link", "main", "meta", "nav", "ol", "p", "pre", "section", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
)

# Named entities of the mail bodies.
NAMED_ENTITIES = (
    ("&nbsp;", " "),
    ("&middot;", "·"),
    ("&copy;", "©"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
)

# Elements kept by the display clean-up.
ALLOWED_ELEMENTS = (
    "p", "br", "div", "span", "b", "strong", "i", "em", "u", "ul", "ol", "li", "a", "blockquote",
    "h1", "h2", "h3", "h4", "h5", "h6", "table", "thead", "tbody", "tr", "td", "th",
)


def strip(text: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def squash(text: Column) -> Column:
    """Null to empty, runs of whitespace to one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def fingerprint(
    title: Column, description: Column, due: Column, priority: Column, assignee: Column, email: Column
) -> Column:
    """Content hash of a task. Nulls become '' first: ``concat_ws`` would drop them."""
    parts = [
        squash(title),
        squash(description),
        F.coalesce(due.cast("string"), F.lit("")),
        F.coalesce(priority, F.lit("")),
        squash(assignee),
        squash(email),
    ]
    return F.md5(F.concat_ws("|", *parts))


def task_fingerprint() -> Column:
    """:func:`fingerprint` over the standard task columns."""
    return fingerprint(
        *(F.col(c) for c in ("title", "description", "due_date", "priority", "assignee", "assignee_email"))
    )


def search_text(columns: Sequence[Column]) -> Column:
    """Lower-case words of all columns, each with a space on both sides."""
    joined = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))
    words = F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " ")
    return F.lower(F.concat(F.lit(" "), words, F.lit(" ")))


def search_tokens(query: str | None) -> list[str] | None:
    """Distinct tokens of two or more characters; ``None`` means "no search"."""
    if query is None or not query.strip():
        return None
    # Python's \w also holds "_" and marks, which are separators here
    words = "".join(ch if ch.isalpha() or ch.isnumeric() else " " for ch in query.strip().lower()).split()
    return list(dict.fromkeys(w for w in words if len(w) >= 2))


def matches_all_prefixes(haystack: Column, tokens: Sequence[str]) -> Column:
    """True when every token begins some word of ``haystack``."""
    if not tokens:
        return F.lit(False)
    return reduce(Column.__and__, [F.contains(haystack, F.lit(" " + t)) for t in tokens])


def embedding_text(title: Column, description: Column) -> Column:
    return F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))


def clip_body(body: Column, limit: int = BODY_LIMIT) -> Column:
    text = F.coalesce(body, F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(BODY_MARKER))).otherwise(text)


def clip_error(message: Column, kind: Column, limit: int = 4_000) -> Column:
    """Error text of at most ``limit`` characters; blank falls back to the error's kind."""
    return F.substring(F.when(is_blank(message), kind).otherwise(message), 1, limit)


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in phrases])


def swap_entities(text: Column) -> Column:
    return reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), NAMED_ENTITIES, text)


def html_to_text(html: Column) -> Column:
    """Visible text: head, scripts, styles and comments dropped, block tags part words, inline tags do not."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?is)<(?:script|style|head)\b[^>]*>.*?</(?:script|style|head)\s*>", " ")
    text = F.regexp_replace(text, r"(?i)</?(?:" + "|".join(BLOCK_ELEMENTS) + r")\b[^>]*>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.trim(F.regexp_replace(swap_entities(text), r"\s+", " "))


def html_allow_list(html: Column) -> Column:
    """Keep the allowed elements, drop all attributes but ``href``. A text job, not a security control."""
    allowed = "|".join(ALLOWED_ELEMENTS)
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(
        text, r"(?is)<(?:script|style|head|iframe|object)\b[^>]*>.*?</(?:script|style|head|iframe|object)\s*>", ""
    )
    # mark what stays, remove every other tag, then put the marks back
    text = F.regexp_replace(text, r'(?i)<a\b[^>]*?\bhref="([^">]*)"[^>]*>', "\u0001a href=\"$1\"\u0002")
    text = F.regexp_replace(text, rf"(?i)<(/?)({allowed})\b[^>]*>", "\u0001$1$2\u0002")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.translate(text, "\u0001\u0002", "<>")

