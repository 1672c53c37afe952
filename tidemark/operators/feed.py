"""Change feed: events of state changes, selection for publishing, retry and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .queue import backoff_seconds, is_due

BATCH = 100

# Which projections a change makes stale.
STALE_PROJECTIONS = {
    "TASK_CREATED": ("task_summary", "task_dashboard", "filter_options"),
    "TASK_STATUS_CHANGED": ("task_summary", "task_dashboard"),
    "TASK_PRIORITY_CHANGED": ("task_summary", "task_dashboard"),
    "TASK_ASSIGNEE_CHANGED": ("task_summary", "task_dashboard", "filter_options"),
    "TASK_UPDATED": ("task_summary", "task_dashboard"),
    "EMAIL_PROCESSED": ("dashboard_summary", "task_summary", "task_dashboard", "emails", "ingestion"),
}


def change_events(
    rows: DataFrame, event_type: Column, entity_type: str, entity_id: Column, payload: dict[str, Column], at: Column
) -> DataFrame:
    """One PENDING event per row. The id is a function of the content, so a replay gives the same events."""
    pairs = [x for name, value in payload.items() for x in (F.lit(name), F.coalesce(value.cast("string"), F.lit("")))]
    body = F.to_json(F.create_map(*pairs))
    return rows.select(
        F.sha2(F.concat_ws("|", event_type, F.lit(entity_type), entity_id.cast("string"), body), 256).alias("id"),
        event_type.alias("event_type"),
        F.lit(entity_type).alias("entity_type"),
        entity_id.cast("string").alias("entity_id"),
        body.alias("payload"),
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt_count"),
        at.alias("created_at"),
    )


def sla_events(slas: DataFrame) -> DataFrame:
    """Events for SLA rows in their current state."""
    kind = (
        F.when(F.col("status") == "COMPLETED", "SLA_COMPLETED")
        .when(F.col("status") == "BREACHED", "SLA_BREACHED")
        .otherwise("SLA_CREATED")
    )
    moment = F.coalesce("first_response_at", F.when(F.col("status") == "BREACHED", F.col("sla_deadline_at")), "received_at")
    payload = {"slaId": F.col("sla_id"), "status": F.col("status")}
    return change_events(slas, kind, "SLA", F.col("sla_id"), payload, moment)


def sla_transitions(slas: DataFrame) -> DataFrame:
    """One event per transition of each SLA: created, and later completed or breached."""
    met, missed = F.col("status") == "COMPLETED", F.col("status") == "BREACHED"
    steps = F.array(
        F.struct(F.lit("SLA_CREATED").alias("kind"), F.lit("WAITING").alias("state"), F.col("received_at").alias("at")),
        F.when(met, F.struct(F.lit("SLA_COMPLETED").alias("kind"), F.lit("COMPLETED").alias("state"), F.col("first_response_at").alias("at"))),
        F.when(
            missed,
            F.struct(F.lit("SLA_BREACHED").alias("kind"), F.lit("BREACHED").alias("state"), F.coalesce("first_response_at", "sla_deadline_at").alias("at")),
        ),
    )
    taken = slas.select("sla_id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("t"))
    payload = {"slaId": F.col("sla_id"), "status": F.col("t.state")}
    return change_events(taken, F.col("t.kind"), "SLA", F.col("sla_id"), payload, F.col("t.at"))


def task_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events of tasks that are new in ``after`` and of each field of the others that changed.

    A new task gives TASK_CREATED alone; a changed status, priority or assignee an event each; any other change of a
    known task gives TASK_UPDATED if none of those three did.
    """
    watched = ["status", "priority", "assignee", "assignee_email", "title", "due_date"]
    old = before.select("id", F.struct(*watched).alias("o"))
    paired = after.select("id", "updated_at", "created_at", F.struct(*watched).alias("n")).join(old, "id", "left")

    def differs(*columns: str) -> Column:
        same = F.lit(True)
        for c in columns:
            same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
        return ~same

    known = F.col("o").isNotNull()
    status, priority = known & differs("status"), known & differs("priority")
    assignee = known & differs("assignee", "assignee_email")
    other = known & differs("title", "due_date") & ~status & ~priority & ~assignee
    kinds = F.array(
        F.when(~known, F.lit("TASK_CREATED")),
        F.when(status, F.lit("TASK_STATUS_CHANGED")),
        F.when(priority, F.lit("TASK_PRIORITY_CHANGED")),
        F.when(assignee, F.lit("TASK_ASSIGNEE_CHANGED")),
        F.when(other, F.lit("TASK_UPDATED")),
    )
    changed = paired.withColumn("kind", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    payload = {"taskId": F.col("id"), "status": F.col("n.status"), "priority": F.col("n.priority"), "assignee": F.col("n.assignee")}
    moment = F.when(F.col("kind") == "TASK_CREATED", F.col("created_at")).otherwise(F.col("updated_at"))
    return change_events(changed, F.col("kind"), "TASK", F.col("id"), payload, moment)


def mail_events(queue: DataFrame) -> DataFrame:
    """An event for every message whose processing has ended well."""
    ended = queue.filter(F.col("status").isin("COMPLETED", "SKIPPED"))
    payload = {c: F.col(n) for c, n in (("mailboxUserId", "mailbox_user_id"), ("messageId", "message_id"), ("status", "status"))}
    return change_events(
        ended, F.lit("EMAIL_PROCESSED"), "EMAIL", F.col("id"), payload, F.coalesce("processed_at", "updated_at")
    )


def due_events(feed: DataFrame, as_of: datetime, limit: int = BATCH) -> DataFrame:
    """The oldest due PENDING events, claimed for publishing."""
    return (
        feed.filter((F.col("status") == "PENDING") & is_due(as_of))
        .orderBy("created_at", "id")
        .limit(limit)
        .withColumns(
            {
                "status": F.lit("PROCESSING"),
                "claimed_at": F.lit(as_of),
                "attempt_count": F.col("attempt_count") + 1,
            }
        )
    )


def retry_at(attempt: Column, as_of: Column, base: int = 2, cap: int = 60) -> Column:
    return F.timestamp_add("SECOND", backoff_seconds(F.greatest(F.lit(1), attempt), base, cap), as_of)


def settle(claimed: DataFrame, results: DataFrame, as_of: datetime) -> DataFrame:
    """Claimed events after publishing: ``results`` holds ``(id, error)``, error null where it worked."""
    joined = claimed.join(results.select("id", F.col("error").alias("_error"), F.lit(True).alias("_done")), "id", "left")
    ok = F.col("_done").isNotNull() & F.col("_error").isNull()
    return joined.withColumns(
        {
            "status": F.when(ok, "PUBLISHED").when(F.col("_done"), "PENDING").otherwise(F.col("status")),
            "published_at": F.when(ok, F.lit(as_of)).otherwise(F.col("published_at")),
            "next_attempt_at": F.when(F.col("_error").isNotNull(), retry_at(F.col("attempt_count"), F.lit(as_of))).otherwise(
                F.col("next_attempt_at")
            ),
            "claimed_at": F.when(F.col("_done").isNull(), F.col("claimed_at")),
        }
    ).drop("_error", "_done")


def recover_stale(feed: DataFrame, as_of: datetime, minutes: int = 2) -> DataFrame:
    stale = (F.col("status") == "PROCESSING") & (
        F.col("claimed_at") < F.timestamp_add("MINUTE", F.lit(-minutes), F.lit(as_of))
    )
    stale = F.coalesce(stale, F.lit(False))
    return feed.withColumns(
        {
            "status": F.when(stale, "PENDING").otherwise(F.col("status")),
            "next_attempt_at": F.when(stale, F.lit(as_of)).otherwise(F.col("next_attempt_at")),
            "claimed_at": F.when(~stale, F.col("claimed_at")),
        }
    )


def purge_published(feed: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    old = (F.col("status") == "PUBLISHED") & (
        F.col("published_at") < F.timestamp_add("DAY", F.lit(-days), F.lit(as_of))
    )
    return feed.filter(~F.coalesce(old, F.lit(False)))


def envelopes(feed: DataFrame) -> DataFrame:
    """What a subscriber receives."""
    return feed.select(
        "id",
        F.col("event_type").alias("type"),
        "entity_type",
        "entity_id",
        F.from_json("payload", "map<string,string>").alias("payload"),
        "created_at",
    )


def stale_projections(feed: DataFrame) -> DataFrame:
    """Events with every projection they make stale; SLA events make none stale."""
    table = F.create_map(
        *[x for k, v in STALE_PROJECTIONS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))]
    )
    return feed.select(
        "id", "event_type", F.explode(F.try_element_at(table, F.col("event_type"))).alias("projection")
    )
