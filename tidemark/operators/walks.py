"""Page walks of many mailboxes at once: follow links, stop after a number of pages, resume, start anew after an expiry.

All mailboxes take their next page together: a round asks for one page per mailbox that still walks, so a run is a bounded
number of joins on the mailbox, however many mailboxes there are.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import is_after
from ..functions.text import blank_to_null, is_blank
from ..session import cut_lineage, scratch_path
from ..sources.landing import MESSAGE_TYPE
from .queue import KEY

PAGES_PER_RUN = 5
#: Answer to a link that the feed no longer knows.
EXPIRED = 410

#: What is known of a mailbox between runs: the link of the last whole walk, and that of the next page of an open one.
LINKS = "mailbox_user_id string, delta_link string, next_link string"
#: What ``fetch`` returns for a request (mailbox_user_id, link); a null link asks for the first page.
ANSWER = f"mailbox_user_id string, status int, value array<{MESSAGE_TYPE}>, next_link string, delta_link string"

Fetch = Callable[[DataFrame], DataFrame]


def fetch_from(pages: DataFrame) -> Fetch:
    """Requests answered from a table of pages: ``mailbox_user_id``, ``link`` and the columns of ``ANSWER``."""

    def fetch(requests: DataFrame) -> DataFrame:
        asked = requests.select(F.col("mailbox_user_id").alias("_mailbox"), F.col("link").alias("_link"))
        same = (F.col("mailbox_user_id") == F.col("_mailbox")) & F.col("link").eqNullSafe(F.col("_link"))
        return pages.join(asked, same).select("mailbox_user_id", "status", "value", "next_link", "delta_link")

    return fetch


def walk(
    mailboxes: DataFrame,
    links: DataFrame,
    fetch: Fetch,
    pages_per_run: int = PAGES_PER_RUN,
    commit: Callable[[DataFrame, DataFrame], None] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """One run over all ``mailboxes``; returns the pages it read (``user_id``, ``page_no``, ``value``) and one row per
    mailbox.

    A mailbox goes on at its ``next_link``, else its ``delta_link``, else the first page, for ``pages_per_run`` pages at most.
    The delta link is replaced only when the last page of a walk is read. An expired link clears both links and starts
    again at the first page, once a run, with a fresh allowance. The rows have the columns of ``LINKS`` and ``outcome``
    (ADVANCED: walk complete, CUT: allowance used up, FAILED), ``pages`` read in the run, ``resets`` and ``error``.

    A page whose fetch failed changes nothing: the links stay at what the pages before it gave. Requests without an answer,
    blank mailboxes, a second expiry and last pages without a delta link fail; other mailboxes go on. Repeated mailboxes
    count once, and of several link rows or answers for one of them the smallest counts. Mailboxes without a row in
    ``links`` start anew; rows of other mailboxes are kept apart.

    ``commit(pages, rows)`` is called after each round with that round's stored pages and the links after them, so what
    it stores never runs ahead of the pages: a run that dies resumes from the last commit.
    """
    spark = mailboxes.sparkSession
    known = links.groupBy("mailbox_user_id").agg(F.min(F.struct("delta_link", "next_link")).alias("l"))
    rows = (
        mailboxes.select("mailbox_user_id")
        .distinct()
        .join(known, "mailbox_user_id", "left")
        .select(
            "mailbox_user_id",
            blank_to_null(F.col("l.delta_link")).alias("delta_link"),
            blank_to_null(F.col("l.next_link")).alias("next_link"),
            F.when(is_blank(F.col("mailbox_user_id")), "FAILED").otherwise("OPEN").alias("outcome"),
            F.lit(0).alias("walked"),
            F.lit(0).alias("pages"),
            F.lit(0).alias("resets"),
            F.when(is_blank(F.col("mailbox_user_id")), "no mailbox").alias("error"),
        )
    )
    rows = cut_lineage(rows)
    target = scratch_path(spark, "walk")
    # the longest run: an allowance less one page, the expiry, and a fresh allowance
    for k in range(2 * max(pages_per_run, 1)):
        asking = rows.filter("outcome = 'OPEN'")
        if asking.isEmpty():
            break
        link = F.coalesce("next_link", "delta_link").alias("link")
        # a round's answers are stored before anything is concluded from them, and are asked for once
        answers = fetch(asking.select("mailbox_user_id", link)).select(*(f.split()[0] for f in _ANSWER_FIELDS))
        answers.write.parquet(f"{target}/round={k}")
        stored = spark.read.schema(ANSWER).parquet(f"{target}/round={k}")
        rows = cut_lineage(_after(rows, stored, max(pages_per_run, 1)))
        if commit is not None:
            commit(_readable(stored.withColumn("round", F.lit(k))), rows.drop("walked"))
    every = f"{ANSWER}, round int"
    read = spark.read.schema(every).parquet(target) if _any(rows) else spark.createDataFrame([], every)
    return _readable(read), rows.drop("walked")


_ANSWER_FIELDS = ("mailbox_user_id", "status", "value", "next_link", "delta_link")


def _any(rows: DataFrame) -> bool:
    """Whether a round has been walked: only blank mailboxes fail without one."""
    return not rows.filter(~is_blank(F.col("mailbox_user_id"))).isEmpty()


def _fine(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def _readable(answers: DataFrame) -> DataFrame:
    fine = answers.filter(_fine(F.col("status")))
    return fine.select(F.col("mailbox_user_id").alias("user_id"), F.col("round").alias("page_no"), "value")


def _after(rows: DataFrame, answers: DataFrame, allowance: int) -> DataFrame:
    """The mailboxes after a round's answers."""
    told = answers.groupBy("mailbox_user_id").agg(
        F.min(
            F.struct(
                "status",
                blank_to_null(F.col("next_link")).alias("next_link"),
                blank_to_null(F.col("delta_link")).alias("delta_link"),
            )
        ).alias("a")
    )
    open_ = F.col("outcome") == "OPEN"
    status = F.col("a.status")
    fine = open_ & _fine(status)
    more = fine & F.col("a.next_link").isNotNull()
    last = fine & F.col("a.next_link").isNull() & F.col("a.delta_link").isNotNull()
    anew = open_ & F.coalesce(status == EXPIRED, F.lit(False)) & (F.col("resets") == 0)
    walked = F.when(anew, 0).when(fine, F.col("walked") + 1).otherwise(F.col("walked"))
    outcome = (
        F.when(~open_, F.col("outcome"))
        .when(anew, "OPEN")
        .when(more, F.when(F.col("walked") + 1 >= allowance, "CUT").otherwise("OPEN"))
        .when(last, "ADVANCED")
        .otherwise("FAILED")
    )
    error = (
        F.when(~open_ | anew | more | last, F.col("error"))
        .when(status.isNull(), "no answer")
        .when(fine, "last page without a delta link")
        .otherwise(F.concat(F.lit("status "), status.cast("string")))
    )
    return rows.join(told, "mailbox_user_id", "left").select(
        "mailbox_user_id",
        F.when(last, F.col("a.delta_link")).when(~anew, F.col("delta_link")).alias("delta_link"),
        F.when(more, F.col("a.next_link")).when(~anew & ~last, F.col("next_link")).alias("next_link"),
        outcome.alias("outcome"),
        walked.alias("walked"),
        (F.col("pages") + fine.cast("int")).alias("pages"),
        (F.col("resets") + anew.cast("int")).alias("resets"),
        error.alias("error"),
    )


def found(pages: DataFrame, boundary: datetime, stored: DataFrame) -> DataFrame:
    """What a run's pages ask of the queue: keys to register (``removed`` false) and to skip (true), each at most once.

    ``pages`` are those of :func:`walk`, in whose order messages come and go; ``stored`` has the keys of the queue. A new
    message is registered if some page brings it, received after ``boundary``. A removal counts for a stored message, and
    for a new one if it comes after the message; it then gives both rows: registered, and skipped.
    """
    item = pages.select("user_id", "page_no", F.posexplode("value").alias("pos", "m")).filter(~is_blank(F.col("m.id")))
    gone = F.col("m.@removed").isNotNull()
    came = ~gone & is_after(F.col("m.receivedDateTime"), F.lit(boundary))
    place = F.struct("page_no", "pos")
    keys = item.groupBy(F.col("user_id").alias("mailbox_user_id"), F.col("m.id").alias("message_id")).agg(
        F.min(F.when(came, place)).alias("came"), F.max(F.when(gone, place)).alias("gone")
    )
    known = stored.select(*KEY).distinct().withColumn("_stored", F.lit(True))
    held = F.col("_stored").isNotNull()
    register = ~held & F.col("came").isNotNull()
    skip = F.col("gone").isNotNull() & (held | F.coalesce(F.col("gone") > F.col("came"), F.lit(False)))
    asked = F.array_compact(F.array(F.when(register, False), F.when(skip, True)))
    return keys.join(known, list(KEY), "left").select(*KEY, F.explode(asked).alias("removed"))
