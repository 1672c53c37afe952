"""Task tables after logs of commands, and backfills."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import normalize_sender
from ..functions.text import is_blank, task_fingerprint
from .identity import name_of_email


def apply_commands(tasks: DataFrame, commands: DataFrame, employees: DataFrame) -> DataFrame:
    """Tasks after ``set_status``, ``set_priority`` and ``set_assignee`` commands ``(seq, at, task_id, action, value)``.

    The last command per task and field decides. A blank assignee clears name and address; otherwise the address is
    kept as given and the name comes from the directory, or is the address.
    """

    def last(action: str, value: Column) -> Column:
        return F.max(F.when(F.col("action") == action, F.struct("at", "seq", value.alias("value"))))

    folded = commands.groupBy(F.col("task_id").alias("id")).agg(
        last("set_status", F.col("value")).alias("_status"),
        last("set_priority", F.col("value")).alias("_priority"),
        last("set_assignee", F.col("value")).alias("_assignee"),
        F.max(F.when(F.col("action").isin("set_status", "set_priority", "set_assignee"), F.col("at"))).alias("_touched"),
    )
    # names are looked up for what is left of each task's commands, not for every command
    folded = name_of_email(folded.withColumn("_address", F.col("_assignee.value")), employees, "_address", "_person")
    given = F.col("_assignee").isNotNull()
    cleared = is_blank(F.col("_assignee.value"))
    return (
        tasks.join(folded, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status.value", "status"),
                "priority": F.coalesce("_priority.value", "priority"),
                "assignee": F.when(given, F.when(~cleared, F.col("_person"))).otherwise(F.col("assignee")),
                "assignee_email": F.when(given, F.when(~cleared, F.col("_assignee.value"))).otherwise(
                    F.col("assignee_email")
                ),
                "updated_at": F.coalesce("_touched", "updated_at"),
            }
        )
        .drop("_status", "_priority", "_assignee", "_touched", "_address", "_person")
    )


def create_tasks(drafts: DataFrame, as_of: datetime) -> DataFrame:
    """Hand-made tasks with defaults: NEW, MEDIUM, normalised sender, and a content hash."""
    return drafts.withColumns(
        {
            "status": F.coalesce("status", F.lit("NEW")),
            "priority": F.coalesce("priority", F.lit("MEDIUM")),
            "normalized_sender": normalize_sender(F.col("source_sender")),
            "created_at": F.lit(as_of),
            "updated_at": F.lit(as_of),
        }
    ).withColumn("task_fingerprint", task_fingerprint())


def backfill_tasks(tasks: DataFrame) -> DataFrame:
    """Recompute normalised senders and content hashes."""
    return tasks.withColumns(
        {"normalized_sender": normalize_sender(F.col("source_sender")), "task_fingerprint": task_fingerprint()}
    )


def backfill_flags(intelligence: DataFrame) -> DataFrame:
    return intelligence.withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("response_required", "requires_action")}
    )


def backfill_due_now(queue: DataFrame, as_of: datetime) -> DataFrame:
    waiting = F.col("status").isin("PENDING", "FAILED")
    return queue.withColumn("next_attempt_at", F.when(waiting, F.lit(as_of)).otherwise(F.col("next_attempt_at")))
