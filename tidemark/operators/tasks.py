"""Task queries: filters, search, orders, pages, counts, trends and the dashboard parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, matches_all_prefixes, search_text, search_tokens
from ..session import cut_lineage
from .timeline import first_per_key

CLOSED = ("COMPLETED", "ARCHIVED")
URGENT = ("HIGH", "CRITICAL")
STATUSES = ("NEW", "IN_PROGRESS", "COMPLETED", "BLOCKED", "ARCHIVED")
SEARCHED = ("title", "assignee", "description", "source_subject")

LIST_COLUMNS = (
    "id", "title", "description", "assignee", "due_date", "priority", "status", "source_subject", "source_sender",
)
FULL_COLUMNS = (
    "id", "title", "description", "assignee", "assignee_email", "due_date", "priority", "status", "source_email_id",
    "source_subject", "source_sender", "source_mailbox", "source_domain", "source_type", "created_at", "updated_at",
    "email_received_at", "source_email_body", "ai_reason",
)
CARD_COLUMNS = ("id", "title", "assignee", "due_date", "priority", "status", "updated_at")


def clamp(value: int, low: int, high: int) -> int:
    return min(max(value, low), high)


# -- predicates ---------------------------------------------------------------------------------------------------


def is_open() -> Column:
    return ~F.col("status").isin(*CLOSED)


def is_overdue(as_of: date) -> Column:
    return F.coalesce((F.col("due_date") < F.lit(as_of)) & is_open(), F.lit(False))


def is_urgent() -> Column:
    return is_open() & F.coalesce(F.col("priority").isin(*URGENT), F.lit(False))


def is_upcoming(as_of: date) -> Column:
    return F.coalesce((F.col("due_date") >= F.lit(as_of)) & is_open(), F.lit(False))


def filter_tasks(
    df: DataFrame,
    *,
    status: str | None = None,
    priority: str | None = None,
    assignee_email: str | None = None,
    source_domain: str | None = None,
    source_type: str | None = None,
    search: str | None = None,
    attention: str | None = None,
    as_of: date | None = None,
) -> DataFrame:
    """Conjunction of the given filters; absent and blank arguments add none."""
    wanted: list[Column] = []
    for name, value in (("status", status), ("priority", priority), ("source_type", source_type)):
        if value is not None:
            wanted.append(F.col(name) == value)
    for name, value in (("assignee_email", assignee_email), ("source_domain", source_domain)):
        if value is not None and value.strip():
            wanted.append(F.lower(name) == value.strip().lower())
    tokens = search_tokens(search)
    if tokens is not None:
        wanted.append(matches_all_prefixes(search_text([F.col(c) for c in SEARCHED]), tokens))
    mode = (attention or "").lower()
    if mode == "overdue":
        wanted.append(is_overdue(as_of))
    elif mode == "priority":
        wanted.append(is_urgent())
    return df.filter(reduce(Column.__and__, wanted)) if wanted else df


# -- orders and pages ---------------------------------------------------------------------------------------------


def received_or_created() -> Column:
    return F.coalesce("email_received_at", "created_at")


def priority_rank() -> Column:
    p = F.col("priority")
    return F.when(p == "CRITICAL", 3).when(p == "HIGH", 2).when(p == "MEDIUM", 1).otherwise(0)


def page_order(sort: str) -> list[Column]:
    newest = [received_or_created().desc(), F.desc("id")]
    orders = {
        "due-asc": [F.asc_nulls_last("due_date"), F.asc("id")],
        "due-desc": [F.desc_nulls_first("due_date"), F.desc("id")],
        "received-asc": [received_or_created().asc(), F.asc("id")],
        "received-desc": newest,
        "priority": [priority_rank().desc(), F.desc("id")],
        "recent": [F.desc("updated_at"), F.desc("id")],
    }
    return orders.get(sort.strip().lower(), newest)


def task_page(df: DataFrame, page: int = 0, size: int = 20, sort: str = "received-desc", **filters) -> DataFrame:
    """One page of the filtered list; a blank ``sort`` leaves the order to the id."""
    page, size = max(page, 0), clamp(size, 1, 50)
    order = page_order(sort) if sort.strip() else [F.asc("id")]
    return filter_tasks(df, **filters).orderBy(*order).offset(page * size).limit(size).select(*LIST_COLUMNS)


def page_info(df: DataFrame, page: int = 0, size: int = 20, **filters) -> DataFrame:
    """One row of page figures; counts without sorting."""
    page, size = max(page, 0), clamp(size, 1, 50)
    counted = filter_tasks(df, **filters).agg(F.count(F.lit(1)).alias("total_elements"))
    pages = F.ceil(F.col("total_elements") / size).cast("bigint")
    return counted.select(
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        "total_elements",
        pages.alias("total_pages"),
        (pages > page + 1).alias("has_next"),
        F.lit(page > 0).alias("has_previous"),
    )


def cards(df: DataFrame, reason: str | None = None) -> DataFrame:
    return df.select(*CARD_COLUMNS, F.lit(reason).cast("string").alias("reason"))


# -- counts -------------------------------------------------------------------------------------------------------


def distinct_sources(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct(F.coalesce("source_email_id", F.col("id").cast("string"))).alias("sources"))


def unique_sources(df: DataFrame) -> DataFrame:
    """First task (lowest id) per source message; an empty source id counts as missing."""
    own = F.coalesce(F.nullif(F.col("source_email_id"), F.lit("")), F.concat(F.lit("task:"), F.col("id")))
    return first_per_key(df.withColumn("_source", own), ["_source"], [F.asc("id")]).drop("_source")


def counts_by_assignee(df: DataFrame, top: int | None = 5, merge_empty: bool = False) -> DataFrame:
    """Tasks per assignee. Grouping is on the stored value, so a task assigned to someone called 'Unassigned'
    stays apart from tasks without assignee, unless ``merge_empty`` treats null and '' as that name."""
    if merge_empty:
        df = df.withColumn("assignee", _named())
    counted = df.groupBy("assignee").agg(F.count(F.lit(1)).alias("total"))
    named = counted.select(F.coalesce("assignee", F.lit("Unassigned")).alias("name"), "total")
    if top is None:
        return named
    return named.orderBy(F.desc("total"), F.asc("name")).limit(top)


def _named() -> Column:
    return F.coalesce(F.nullif(F.col("assignee"), F.lit("")), F.lit("Unassigned"))


def workload(df: DataFrame, as_of: date, merge_empty: bool = False) -> DataFrame:
    """Open, overdue, urgent and all tasks per assignee in one pass."""
    if merge_empty:
        df = df.withColumn("assignee", _named())
    return (
        df.groupBy("assignee")
        .agg(
            F.count_if(is_open()).alias("open_count"),
            F.count_if(is_overdue(as_of)).alias("overdue_count"),
            F.count_if(is_urgent()).alias("high_priority_count"),
            F.count(F.lit(1)).alias("total_count"),
        )
        .withColumn("name", F.coalesce("assignee", F.lit("Unassigned")))
        .select("name", "open_count", "overdue_count", "high_priority_count", "total_count")
    )


def summary(df: DataFrame, as_of: date) -> DataFrame:
    """Seven counts in one pass. High priority here means HIGH only, open or not."""
    status = F.col("status")
    return df.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(status == "NEW").alias("new_tasks"),
        F.count_if(status == "IN_PROGRESS").alias("in_progress"),
        F.count_if(status == "COMPLETED").alias("completed"),
        F.count_if(status == "BLOCKED").alias("blocked"),
        F.count_if(is_overdue(as_of)).alias("overdue"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority"),
    )


def status_slices(summary_row: DataFrame) -> DataFrame:
    """The summary's status counts as rows, zeros left out."""
    return summary_row.selectExpr(
        "stack(4, 'NEW', new_tasks, 'IN_PROGRESS', in_progress, 'COMPLETED', completed, 'BLOCKED', blocked)"
        " AS (status, value)"
    ).filter("value > 0")


def simple_counts(df: DataFrame, as_of: date) -> DataFrame:
    """Counts by status, by priority, and past due but not completed, as ``(kind, value, n)``."""
    past_due = F.coalesce((F.col("due_date") < F.lit(as_of)) & (F.col("status") != "COMPLETED"), F.lit(False))
    kinds = F.array(
        F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")),
        F.struct(F.lit("priority").alias("kind"), F.col("priority").alias("value")),
        F.struct(F.lit("past_due").alias("kind"), past_due.cast("string").alias("value")),
    )
    # partial aggregation leaves a dozen rows per task before the shuffle
    return df.select(F.inline(kinds)).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def calendar(spark, last_day: date, days: int) -> DataFrame:
    """``days`` consecutive days ending with ``last_day``; at most a year, so its size is fixed."""
    first = last_day - timedelta(days=days - 1)
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last_day))).alias("day"))


def daily_counts(df: DataFrame, moment: Column, last_day: date, days: int, name: str = "n") -> DataFrame:
    """Rows per UTC day over the last ``days`` days, with zero for empty days."""
    first = last_day - timedelta(days=days - 1)
    low = F.lit(datetime.combine(first, datetime.min.time()))
    high = F.lit(datetime.combine(last_day + timedelta(days=1), datetime.min.time()))
    counted = (
        df.filter((moment >= low) & (moment < high))
        .groupBy(F.to_date(moment).alias("day"))
        .agg(F.count(F.lit(1)).alias(name))
    )
    return (
        calendar(df.sparkSession, last_day, days)
        .join(counted, "day", "left")
        .select("day", F.coalesce(name, F.lit(0)).cast("bigint").alias(name))
    )


def task_trend(df: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    return daily_counts(df, received_or_created(), as_of, clamp(days, 1, 31), "task_count")


def aligned_series(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two gap-free daily series side by side."""
    return left.join(right, "day", "left")


# -- top-k lists --------------------------------------------------------------------------------------------------


def attention_queue(df: DataFrame, as_of: date, top: int = 6) -> DataFrame:
    """Most overdue tasks and soonest urgent tasks, one row per task, overdue ones first."""
    soonest = [F.asc_nulls_last("due_date"), F.asc("id")]
    late = cards(df.filter(is_overdue(as_of)), "overdue").orderBy(*soonest).limit(top)
    urgent = cards(df.filter(is_urgent()), "priority").orderBy(*soonest).limit(top)
    return (
        first_per_key(late.unionByName(urgent), ["id"], [F.asc("reason")])
        .orderBy(F.asc("reason"), *soonest)
        .limit(top)
    )


def attention_split(df: DataFrame, as_of: date, top: int = 6) -> DataFrame:
    """Variant whose urgent part leaves overdue tasks out; both full counts are on every row."""
    flagged = df.withColumn(
        "reason", F.when(is_overdue(as_of), "overdue").when(is_urgent(), "priority")
    ).filter("reason IS NOT NULL")
    best = flagged.orderBy("reason", F.asc_nulls_last("due_date"), "id").limit(top)
    counts = flagged.agg(
        F.struct(
            F.count_if(F.col("reason") == "overdue").alias("overdue_count"),
            F.count_if(F.col("reason") == "priority").alias("high_priority_count"),
        ).alias("both")
    ).scalar()
    return best.select(*CARD_COLUMNS, "reason", *[counts[n].alias(n) for n in ("overdue_count", "high_priority_count")])


def upcoming_deadlines(df: DataFrame, as_of: date, top: int = 5) -> DataFrame:
    return cards(df.filter(is_upcoming(as_of)).orderBy("due_date", "id").limit(top))


def recent_activity(df: DataFrame, top: int = 6) -> DataFrame:
    return cards(df.orderBy(F.desc_nulls_last("updated_at"), F.desc("id")).limit(top))


# -- distinct lists -----------------------------------------------------------------------------------------------


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct assignees, source domains and source types as ``(kind, value, email)``, in one scan."""
    options = F.array(
        F.when(
            F.col("assignee").isNotNull() & ~is_blank(F.col("assignee_email")),
            F.struct(
                F.lit("assignee").alias("kind"), F.col("assignee").alias("value"), F.col("assignee_email").alias("email")
            ),
        ),
        *[
            F.when(
                F.col(c).isNotNull(),
                F.struct(F.lit(c).alias("kind"), F.col(c).alias("value"), F.lit(None).cast("string").alias("email")),
            )
            for c in ("source_domain", "source_type")
        ],
    )
    return df.select(F.inline(F.array_compact(options))).distinct()


def owner_options(df: DataFrame) -> DataFrame:
    """First assignee name per normalised address."""
    email = F.lower(F.trim("assignee_email"))
    listed = (
        df.filter(F.col("assignee").isNotNull() & ~is_blank(F.col("assignee_email")))
        .select("assignee", email.alias("email"))
        .distinct()
    )
    return first_per_key(listed, ["email"], [F.asc("assignee")])


def dashboard(df: DataFrame, as_of: date, status: str | None = None, priority: str | None = None, days: int = 7) -> Mapping[str, DataFrame]:
    """The dashboard's parts. The filtered tasks are derived once, with the columns that any part needs, and written to
    the shared folder; every part reads them from there."""
    needed = (*CARD_COLUMNS, "source_email_id", "email_received_at", "created_at")
    base = cut_lineage(filter_tasks(df, status=status, priority=priority).select(*needed))
    counts = base.agg(
        F.countDistinct(F.coalesce("source_email_id", F.col("id").cast("string"))).alias("actionable_emails"),
        F.count_if(is_overdue(as_of)).alias("overdue_count"),
        F.count_if(is_urgent()).alias("high_priority_count"),
    )
    return {
        "counts": counts,
        "tasks_by_assignee": counts_by_assignee(base),
        "employee_workload": workload(df, as_of),  # never filtered
        "attention": attention_queue(base, as_of),
        "upcoming": upcoming_deadlines(base, as_of),
        "recent": recent_activity(base),
        "trend": task_trend(base, as_of, days),
    }


def dashboard_rows(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All parts as one table ``(part, item)`` with each row as JSON text."""
    rows = [
        df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns)).alias("item"))
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def export_rows(df: DataFrame) -> DataFrame:
    """Ten text columns in the order of the exported sheet."""
    stamp = F.col("email_received_at")
    # seconds and fractions appear only where they are not zero
    minute, second, micro = (F.date_format(stamp, p) for p in ("yyyy-MM-dd'T'HH:mm", ":ss", ".SSSSSS"))
    fraction = F.when(micro == ".000000", "").otherwise(F.regexp_replace(micro, r"^(\.\d{3})000$", "$1"))
    tail = F.when((second == ":00") & (fraction == ""), "").otherwise(F.concat(second, fraction))
    columns: Sequence[tuple[str, Column]] = (
        ("task", F.col("title")),
        ("description", F.col("description")),
        ("assignee", F.col("assignee")),
        ("to_email", F.col("assignee_email")),
        ("due_date", F.col("due_date").cast("string")),
        ("priority", F.col("priority")),
        ("status", F.col("status")),
        ("subject", F.col("source_subject")),
        ("from_email", F.col("source_sender")),
        ("email_received_at", F.concat(minute, tail, F.lit("Z"))),
    )
    return df.select(*[F.coalesce(c, F.lit("")).alias(n) for n, c in columns])
