"""Expressions that read loosely formed text: times, model replies, verdicts, failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, is_blank, strip

ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"

# Ordered task priorities, verdicts, and failure kinds with a settled class.
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
VERDICTS = ("SAME", "DIFFERENT", "AMBIGUOUS")
FAILURE_KINDS = {
    "extraction_non_retryable": "NON_RETRYABLE",
    "provider_unavailable": "UNAVAILABLE",
    "verification_malformed": "NON_RETRYABLE",
    "verification_unavailable": "UNAVAILABLE",
}
ROUTER_PHRASES = (
    "no fallback model group found",
    "no healthy deployment",
    "no deployments available",
    "all deployments unhealthy",
    "no models configured",
)

REPLY_SCHEMA = "responseRequired string, tasks string, _broken string"
TASK_SCHEMA = "task string, description string, dueDate string, priority string"
VERDICT_SCHEMA = "result string, reason string, _broken string"
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def parse_instant(text: Column) -> Column:
    """ISO-8601 with an offset, else null; ``try_`` because ANSI casts raise."""
    value = F.upper(text)
    # seconds may be left out, which Spark's own parser does not take together with an offset
    complete = F.regexp_replace(value, r"^(.{10}T\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.when(F.rlike(value, F.lit(ISO_INSTANT)), F.try_to_timestamp(complete))


def is_after(text: Column, boundary: Column) -> Column:
    """Strictly after; unreadable times are not."""
    return F.coalesce(parse_instant(text) > boundary, F.lit(False))


def text_or_null(text: Column) -> Column:
    value = strip(text)
    return F.when(F.lower(value).isin("", "null"), None).otherwise(value)


def strict_date(text: Column) -> Column:
    value = text_or_null(text)
    return F.when(F.rlike(value, F.lit(ISO_DATE)), F.try_to_date(value, "yyyy-MM-dd"))


def priority_or_medium(text: Column) -> Column:
    value = F.upper(text_or_null(text))
    return F.when(value.isin(*PRIORITIES), value).otherwise("MEDIUM")


def clean_reply(reply: Column) -> Column:
    """The outermost bracketed part of a reply; without one, the reply less its code fence."""
    core = F.regexp_extract(reply, r"(?s)([\{\[].*[\}\]]|[\{\[].*)", 1)
    unfenced = F.regexp_replace(strip(reply), r"(?s)^```(?:json)?\s*(.*?)(?:\s*```)?$", "$1")
    return F.coalesce(F.nullif(core, F.lit("")), unfenced)


def _flag(text: Column) -> Column:
    number = F.coalesce(text.try_cast("double"), F.lit(0.0))
    return F.coalesce((F.lower(text) == "true") | (number != 0), F.lit(False))


def reply_root(text: Column) -> Column:
    """Top-level fields of a cleaned reply; ``_broken`` is set where it is no JSON object."""
    return F.from_json(text, REPLY_SCHEMA, _PERMISSIVE)


def is_bare_list(text: Column) -> Column:
    return F.startswith(text, F.lit("["))


def reply_items(text: Column, root: Column) -> Column:
    """The listed tasks as JSON texts; null where the reply lists none in a readable way."""
    listed = F.when(is_bare_list(text), text).when(root["_broken"].isNull(), strip(root["tasks"]))
    return F.when(is_bare_list(listed), F.from_json(listed, "array<string>"))


def reply_outcome(reply: Column, finish_reason: Column, items: Column) -> Column:
    """OK, EMPTY (blank reply), TRUNCATED (stopped by the length limit, never read) or UNREADABLE."""
    return (
        F.when(is_blank(reply), "EMPTY")
        .when(finish_reason == "length", "TRUNCATED")
        .when(items.isNotNull(), "OK")
        .otherwise("UNREADABLE")
    )


def reply_needs_answer(text: Column, root: Column) -> Column:
    return ~is_bare_list(text) & _flag(root["responseRequired"])


def reply_tasks(items: Column) -> Column:
    """Tasks with a title, their fields cleaned."""
    parsed = F.transform(items, lambda item: F.from_json(item, TASK_SCHEMA))
    return F.transform(
        F.filter(parsed, lambda t: text_or_null(t["task"]).isNotNull()),
        lambda t: F.struct(
            text_or_null(t["task"]).alias("title"),
            text_or_null(t["description"]).alias("description"),
            strict_date(t["dueDate"]).alias("due_date"),
            priority_or_medium(t["priority"]).alias("priority"),
        ),
    )


def read_verdict(content: Column, finish_reason: Column) -> Column:
    """Struct ``(outcome, verdict, reason)``; outcome VERDICT, MALFORMED or UNAVAILABLE."""
    text = strip(content)
    unfenced = strip(F.regexp_replace(F.regexp_replace(text, r"^```[a-zA-Z]*\n?", ""), r"```\s*$", ""))
    text = F.when(F.startswith(text, F.lit("```")), unfenced).otherwise(text)
    node = F.from_json(text, VERDICT_SCHEMA, _PERMISSIVE)
    verdict = F.upper(strip(node["result"]))
    known = F.coalesce(node["_broken"].isNull() & verdict.isin(*VERDICTS), F.lit(False))
    outcome = (
        F.when(finish_reason == "length", "MALFORMED")
        .when(is_blank(content), "UNAVAILABLE")
        .when(known, "VERDICT")
        .otherwise("MALFORMED")
    )
    usable = outcome == "VERDICT"
    return F.struct(
        outcome.alias("outcome"),
        F.when(usable, verdict).alias("verdict"),
        F.when(usable, node["reason"]).alias("reason"),
    )


def failure_category(kind: Column, http_status: Column, message: Column) -> Column:
    """NON_RETRYABLE, UNAVAILABLE or TRANSIENT. Known kinds come first, then 404, then router phrases."""
    settled = F.create_map(*[F.lit(x) for pair in FAILURE_KINDS.items() for x in pair])
    exhausted = contains_any(F.lower(F.coalesce(message, F.lit(""))), ROUTER_PHRASES)
    return F.coalesce(
        F.try_element_at(settled, F.coalesce(kind, F.lit(""))),
        F.when(http_status == 404, "NON_RETRYABLE"),
        F.when(exhausted, "UNAVAILABLE"),
        F.lit("TRANSIENT"),
    )


def retry_after_seconds(header: Column) -> Column:
    seconds = strip(header).try_cast("bigint")
    return F.when(seconds > 0, seconds)


def round1(value: Column) -> Column:
    return F.round(value, 1)


def int_div(value: Column, by: int) -> Column:
    """Integer quotient rounded towards zero."""
    return F.call_function("div", value, F.lit(by))


def whole_minutes(start: Column, end: Column) -> Column:
    """Elapsed seconds rounded down, then cut to minutes towards zero."""
    seconds = F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).cast("bigint")
    return int_div(seconds, 60)
