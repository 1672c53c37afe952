"""Incremental discovery of inbox and sent mail, and publishing of the change feed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import parse_instant
from ..operators import feed as fd
from ..operators import ingest
from ..operators import queue as qu
from ..session import use_keyed_state
from .runner import batch_folder_sink, ledger_sink, run_available


def register_stream(
    pages: DataFrame,
    boundary: datetime,
    stored_queue: Callable[[], DataFrame],
    target: str,
    checkpoint: str,
    as_of: datetime,
) -> None:
    """Queue every discovered message that is not stored yet, however late and in whatever order its page arrives.

    A message is stored if ``stored_queue`` (what other jobs have stored) holds its key or an earlier batch of this stream
    brought it; those keys are the stream's state, so a batch looks at its own keys only and never at what earlier ones have written. There is no
    watermark: mailboxes do not arrive in one order of time, and a first walk of an old mailbox lies far behind the others.
    """
    use_keyed_state(pages.sparkSession)

    def fresh(batch: DataFrame) -> DataFrame:
        return qu.register(batch.withColumn("mailbox_address", F.col("mailbox_user_id")), stored_queue(), as_of)

    found = ingest.discovered(pages, boundary).withColumn("received_at", parse_instant(F.col("received")))
    once = found.dropDuplicates(["mailbox_user_id", "message_id"])
    run_available(once.writeStream.foreachBatch(batch_folder_sink(target, fresh)), checkpoint)


def removals_stream(pages: DataFrame, target: str, checkpoint: str) -> None:
    """Keys of removed messages, to be applied to the queue table."""
    gone = ingest.removals(pages)
    run_available(gone.writeStream.foreachBatch(batch_folder_sink(target)), checkpoint)


def sent_stream(
    pages: DataFrame, boundary: datetime | None, target: str, checkpoint: str, scanned: DataFrame | None = None
) -> None:
    """Sent mail with its own checkpoint; ``scanned`` names the mailboxes whose first run is over."""
    sent = ingest.sent_items(pages, boundary, scanned)
    run_available(sent.writeStream.foreachBatch(batch_folder_sink(target)), checkpoint)


def append_changes(slas: DataFrame, target: str, checkpoint: str) -> None:
    """Turn a stream of SLA states into change events."""
    run_available(fd.sla_events(slas).writeStream.foreachBatch(batch_folder_sink(target)), checkpoint)


def publish(
    events: DataFrame,
    target: str,
    checkpoint: str,
    deliver: Callable[[DataFrame], DataFrame] | None = None,
    max_attempts: int = 5,
) -> None:
    """Deliver change events as envelopes and keep a ledger of every attempt.

    A batch claims its own events and those of earlier batches that failed and may be tried again; an id that has been
    delivered is never claimed a second time. ``deliver`` gets the claimed envelopes and returns their ids with a
    boolean ``ok``; by default all are delivered. The ledger has one row per attempt: the envelope, ``attempt`` and
    ``state`` (PUBLISHED, FAILED, or DEAD after ``max_attempts``).
    """

    def attempt(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        new = fd.envelopes(batch.dropDuplicates(["id"])).withColumn("attempt", F.lit(1))
        if earlier is not None:
            last = earlier.groupBy("id").agg(F.max_by("state", "attempt").alias("_state"), F.max("attempt").alias("_tried"))
            new = new.join(last.select("id"), "id", "left_anti")
            again = last.filter("_state = 'FAILED'").select("id", "_tried")
            retried = earlier.join(again, (earlier["id"] == again["id"]) & (earlier["attempt"] == again["_tried"]), "left_semi")
            new = new.unionByName(retried.withColumn("attempt", F.col("attempt") + 1).drop("state"))
        if deliver is None:
            return new.withColumn("state", F.lit("PUBLISHED"))
        told = deliver(new).select("id", "ok")
        state = (
            F.when(F.coalesce("ok", F.lit(False)), "PUBLISHED")
            .when(F.col("attempt") >= max_attempts, "DEAD")
            .otherwise("FAILED")
        )
        return new.join(told, "id", "left").withColumn("state", state).drop("ok")

    run_available(events.writeStream.foreachBatch(ledger_sink(target, attempt)), checkpoint)
