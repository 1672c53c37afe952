"""Dashboard counts kept up to date by change events, as signed counts per combination of the dimensions that reports use.

An event counts its row as it was before with -1 and as it is after with +1. Each batch stores the sums of its own events only;
sums over batches commute, so events may come late and in any order, and a batch that is run again replaces its folder. Work
per batch does not grow with the history; what a report reads does not grow with the rows, only with combinations and batches
since the last ``compact``. Reports take "now" as an argument, since due dates are a dimension.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tasks as tk
from ..operators.queue import POLICY, STATUSES, QueuePolicy

TASK_DIMENSIONS = ("assignee", "status", "priority", "due_date")
QUEUE_DIMENSIONS = ("status",)


def changes(before: DataFrame, after: DataFrame, dimensions: Sequence[str], key: str = "id") -> DataFrame:
    """Change events (before, after) between two states of a table; new rows have no before, removed ones no after.

    Rows whose dimensions are as before give no event.
    """
    old = before.select(F.col(key).alias("_key"), F.struct(*dimensions).alias("before"))
    new = after.select(F.col(key).alias("_key"), F.struct(*dimensions).alias("after"))
    return old.join(new, "_key", "full").filter(~F.col("before").eqNullSafe(F.col("after"))).select("before", "after")


def signed(events: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Sums (dimensions, n) of events (before, after); sums of zero are left out."""
    sides = F.array(
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("row"), F.lit(-1).alias("sign"))),
        F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("row"), F.lit(1).alias("sign"))),
    )
    each = events.select(F.explode(sides).alias("s")).filter("s IS NOT NULL")
    counted = each.groupBy(*(F.col(f"s.row.{c}").alias(c) for c in dimensions)).agg(F.sum("s.sign").alias("n"))
    return counted.filter("n <> 0")


def start(rows: DataFrame, target: str, dimensions: Sequence[str]) -> None:
    """Counts of a whole table, the base that later batches add to."""
    counted = rows.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    _store_base(counted, target, -1)
    # so that there are batches to read before the first one; it sums to nothing
    counted.limit(0).write.mode("overwrite").parquet(f"{target}/batches/batch=-1")


def _store_base(counted: DataFrame, target: str, through: int) -> None:
    counted.write.mode("overwrite").parquet(f"{target}/base/through={through}")
    counted.sparkSession.range(1).select("id").write.mode("overwrite").parquet(f"{target}/commits/through={through}")


def rollup_sink(target: str, dimensions: Sequence[str]):
    """``foreachBatch`` function that stores the signed counts of each batch of events in a folder of its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        signed(batch, dimensions).write.mode("overwrite").parquet(f"{target}/batches/batch={batch_id}")

    return write


def _bases(spark: SparkSession, target: str) -> DataFrame:
    """Last batch of each stored base; one that was not written to its end has no commit."""
    return spark.read.schema("id bigint, through int").parquet(f"{target}/commits").select("through")


def counts(spark: SparkSession, target: str, schema: str, upto: int | None = None) -> DataFrame:
    """Counts (dimensions, n) as of now, or after batch ``upto``; ``schema`` has the dimensions with their types.

    They are those of the newest base that ends no later than ``upto``, and the batches after it.
    """
    names = [field.split()[0] for field in schema.split(", ")]
    within = F.lit(True) if upto is None else F.col("through") <= upto
    through = _bases(spark, target).filter(within).agg(F.max("through")).first()[0]
    base = spark.read.schema(f"{schema}, n bigint, through int").parquet(f"{target}/base")
    parts = base.filter(F.col("through") == through).drop("through")
    batches = spark.read.schema(f"{schema}, n bigint, batch int").parquet(f"{target}/batches")
    later = batches.filter((F.col("batch") > through) & (F.lit(True) if upto is None else F.col("batch") <= upto))
    return parts.unionByName(later.drop("batch")).groupBy(*names).agg(F.sum("n").alias("n")).filter("n <> 0")


def compact(spark: SparkSession, target: str, schema: str, through: int) -> None:
    """Store the counts after batch ``through`` as a new base; readers then skip the batches up to it.

    Only for batches that are over: one of them that is run again later is not seen.
    """
    _store_base(counts(spark, target, schema, through), target, through)


TASK_SCHEMA = "assignee string, status string, priority string, due_date date"
QUEUE_SCHEMA = "status string"


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")


def workload(counted: DataFrame, as_of: date) -> DataFrame:
    """:func:`operators.tasks.workload` from task counts."""
    return (
        counted.groupBy("assignee")
        .agg(
            _total(tk.is_open()).alias("open_count"),
            _total(tk.is_overdue(as_of)).alias("overdue_count"),
            _total(tk.is_urgent()).alias("high_priority_count"),
            _total(F.lit(True)).alias("total_count"),
        )
        .select(F.coalesce("assignee", F.lit("Unassigned")).alias("name"), "open_count", "overdue_count", "high_priority_count", "total_count")
    )


def summary(counted: DataFrame, as_of: date) -> DataFrame:
    """:func:`operators.tasks.summary` from task counts."""
    status = F.col("status")
    return counted.agg(
        _total(F.lit(True)).alias("total_tasks"),
        _total(status == "NEW").alias("new_tasks"),
        _total(status == "IN_PROGRESS").alias("in_progress"),
        _total(status == "COMPLETED").alias("completed"),
        _total(status == "BLOCKED").alias("blocked"),
        _total(tk.is_overdue(as_of)).alias("overdue"),
        _total(F.col("priority") == "HIGH").alias("high_priority"),
    )


def queue_stats(counted: DataFrame) -> DataFrame:
    """:func:`operators.queue.stats` from queue counts."""
    return counted.agg(*(_total(F.col("status") == s).alias(s.lower()) for s in STATUSES))


def queue_backlog(counted: DataFrame, policy: QueuePolicy = POLICY) -> DataFrame:
    """:func:`operators.queue.backlog` from queue counts."""
    return counted.agg(
        _total(F.col("status").isin("PENDING", "FAILED")).alias("outstanding"),
        _total(F.col("status") == "DEAD_LETTER").alias("dead_letters"),
    ).withColumns(
        {"backlog_alert": F.col("outstanding") > policy.backlog_warning, "dead_letter_alert": F.col("dead_letters") > 0}
    )
