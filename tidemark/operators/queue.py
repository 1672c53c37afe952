"""Work queue: registration, claims, outcomes, retry times, lease recovery and reports.

The queue is a table with one row per (mailbox, message). Every operator is one pass over it, or a join on its key,
that returns the rows in their next state.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import failure_category, retry_after_seconds, int_div
from ..functions.text import clip_error, is_blank
from ..session import cut_lineage
from .tasks import clamp
from .timeline import first_per_key, hour_of, next_value, running_totals

KEY = ("mailbox_user_id", "message_id")
STATUSES = ("PENDING", "PROCESSING", "FAILED", "DEFERRED", "COMPLETED", "DEAD_LETTER", "SKIPPED")
ENTRY_COLUMNS = (
    "id", "mailbox_user_id", "message_id", "attempt_count", "defer_count", "failure_category", "error_message",
    "first_deferred_at", "updated_at",
)

# Notes left on a row.
UNAVAILABLE_NOTE = "Message is no longer available in Microsoft Graph."
REMOVED_NOTE = "Message was removed from the Inbox by Microsoft Graph."
LEASE_NOTE = " Lease expired and was reclaimed."


@dataclass(frozen=True)
class QueuePolicy:
    max_attempts: int = 5
    max_defers: int = 100
    lease_minutes: int = 15
    max_backoff_minutes: int = 60
    defer_minutes: int = 20
    defer_horizon_minutes: int = 2880
    backlog_warning: int = 200


POLICY = QueuePolicy()


def _no(kind: str) -> Column:
    return F.lit(None).cast(kind)


# -- registration -------------------------------------------------------------------------------------------------


def register(discovered: DataFrame, existing: DataFrame, as_of: datetime) -> DataFrame:
    """New PENDING rows for discovered messages that are not queued yet; blank keys are refused."""
    valid = discovered.filter(~is_blank(F.col("mailbox_user_id")) & ~is_blank(F.col("message_id")))
    return (
        valid.groupBy(*KEY)
        .agg(F.min("mailbox_address").alias("mailbox_address"))
        .join(existing.select(*KEY), list(KEY), "left_anti")
        .select(
            *KEY,
            "mailbox_address",
            F.lit("PENDING").alias("status"),
            F.lit(0).alias("attempt_count"),
            F.lit(as_of).alias("created_at"),
            F.lit(as_of).alias("next_attempt_at"),
        )
    )


def apply_removals(queue: DataFrame, removed: DataFrame) -> DataFrame:
    """Skip removed messages whose row is waiting; finished and running rows are left alone."""
    gone = removed.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & F.col("status").isin("PENDING", "FAILED", "DEFERRED")
    return (
        queue.join(gone, list(KEY), "left")
        .withColumns(
            {
                "status": F.when(hit, "SKIPPED").otherwise(F.col("status")),
                "next_attempt_at": F.when(~hit, F.col("next_attempt_at")),
                "claimed_at": F.when(~hit, F.col("claimed_at")),
                "claimed_by": F.when(~hit, F.col("claimed_by")),
                "error_message": F.when(hit, REMOVED_NOTE).otherwise(F.col("error_message")),
            }
        )
        .drop("_gone")
    )


# -- claims -------------------------------------------------------------------------------------------------------


def is_due(as_of: datetime) -> Column:
    return F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(as_of))


def claim_order() -> list[Column]:
    return [F.coalesce("next_attempt_at", "created_at").asc(), F.asc("created_at"), F.asc("id")]


def claimable(queue: DataFrame, as_of: datetime, policy: QueuePolicy = POLICY) -> DataFrame:
    waiting = F.col("status").isin("PENDING", "FAILED") & (F.col("attempt_count") < policy.max_attempts)
    deferred = (F.col("status") == "DEFERRED") & (F.col("defer_count") < policy.max_defers)
    return queue.filter((waiting | deferred) & is_due(as_of))


def claim_batch(
    queue: DataFrame, limit: int, worker: str | None, as_of: datetime, policy: QueuePolicy = POLICY
) -> DataFrame:
    """The next rows to work on, claimed by ``worker``, in claim order. Senseless arguments claim nothing."""
    if limit <= 0 or policy.max_attempts <= 0 or policy.max_defers <= 0 or not (worker or "").strip():
        return queue.limit(0)
    return (
        claimable(queue, as_of, policy)
        .orderBy(*claim_order())
        .limit(limit)
        .withColumns(
            {
                "status": F.lit("PROCESSING"),
                "claimed_at": F.lit(as_of),
                "claimed_by": F.lit(worker),
                "processed_at": _no("timestamp"),
                "error_message": _no("string"),
                "updated_at": F.lit(as_of),
            }
        )
    )


def claim_next(queue: DataFrame, mailbox: str, worker: str, as_of: datetime, policy: QueuePolicy = POLICY) -> DataFrame:
    """The next waiting row of one mailbox; deferred rows do not count here, and a failed row needs a due time."""
    rows = queue.filter(
        (F.col("mailbox_user_id") == mailbox)
        & ((F.col("status") == "PENDING") | ((F.col("status") == "FAILED") & F.col("next_attempt_at").isNotNull()))
    )
    return claim_batch(rows, 1, worker, as_of, policy)


def claim_next_per_mailbox(queue: DataFrame, as_of: datetime, policy: QueuePolicy = POLICY) -> DataFrame:
    """:func:`claim_next` for every mailbox at once."""
    rows = queue.filter(
        (F.col("status") == "PENDING") | ((F.col("status") == "FAILED") & F.col("next_attempt_at").isNotNull())
    )
    return first_per_key(claimable(rows, as_of, policy), ["mailbox_user_id"], claim_order()).select("mailbox_user_id", "id")


def claimed_rows(queue: DataFrame, claims: DataFrame) -> DataFrame:
    """Queue rows of claimed ids with their claim rank; ids that vanished are left out."""
    return claims.select("id", "claim_rank").join(queue, "id").orderBy("claim_rank")


def ready_mailboxes(queue: DataFrame, as_of: datetime, policy: QueuePolicy = POLICY) -> DataFrame:
    due = F.col("status").isin("PENDING", "FAILED") & (F.col("attempt_count") < policy.max_attempts) & is_due(as_of)
    return queue.filter(due).select("mailbox_user_id").distinct()


# -- retry times --------------------------------------------------------------------------------------------------


def backoff_seconds(attempt: Column, base: int, cap: int) -> Column:
    """``base`` doubled per earlier attempt (at most ten times), no more than ``cap``."""
    steps = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(10)).cast("int")
    return F.least(F.lit(base) * F.pow(F.lit(2), steps), F.lit(cap)).cast("bigint")


def jitter_seconds(bounded: Column, *seed: Column) -> Column:
    """Repeatable spread of up to a fifth of the delay, in place of a random one."""
    return F.pmod(F.xxhash64(*seed), F.greatest(F.lit(1), int_div(bounded, 5)) + 1)


def transient_retry_seconds(attempt: Column, policy: QueuePolicy = POLICY) -> Column:
    return backoff_seconds(attempt, 30, policy.max_backoff_minutes * 60)


def deferred_retry_minutes(retry_after: Column, policy: QueuePolicy = POLICY) -> Column:
    """Minutes the provider asked for, at least one, or the standard interval."""
    asked = retry_after_seconds(retry_after)
    return F.coalesce(F.greatest(F.lit(1), int_div(asked, 60)), F.lit(policy.defer_minutes))


# -- outcomes -----------------------------------------------------------------------------------------------------


def owned(outcomes: DataFrame, queue: DataFrame, policy: QueuePolicy = POLICY) -> DataFrame:
    """Outcomes whose worker holds a live claim on the row; others are void."""
    held = queue.filter("status = 'PROCESSING'").select("id", "claimed_by", "claimed_at")
    live = F.col("claimed_at") >= F.timestamp_add("MINUTE", F.lit(-policy.lease_minutes), F.col("reported_at"))
    return outcomes.join(held, "id").filter((F.col("worker") == F.col("claimed_by")) & live).drop("claimed_by", "claimed_at")


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, policy: QueuePolicy = POLICY) -> DataFrame:
    """Queue after one outcome per claimed row: complete, fail, unavailable, release, start.

    The first valid outcome of a claim counts; it ends the claim, so later ones have no owner any more. ``start``
    only counts the attempt and keeps the claim.
    """
    valid = owned(outcomes, queue, policy)
    first = first_per_key(valid, ["id"], [F.asc("reported_at"), F.asc("action")]).select(
        "id",
        F.struct(
            "action",
            "reported_at",
            failure_category(F.col("kind"), F.col("http_status"), F.col("message")).alias("category"),
            clip_error(F.col("message"), F.coalesce("kind", F.lit("error"))).alias("note"),
            "retry_after",
        ).alias("o"),
    )
    rows = queue.join(first, "id", "left")
    action, at, category = F.col("o.action"), F.col("o.reported_at"), F.col("o.category")
    failed = action == "fail"
    since = F.coalesce("first_deferred_at", at)
    defers = F.col("defer_count") + 1
    horizon = (F.unix_micros(at) - F.unix_micros(since)) >= policy.defer_horizon_minutes * 60_000_000
    exhausted = (defers > policy.max_defers) | horizon
    spent = F.col("attempt_count") >= policy.max_attempts

    status = (
        F.when(action.isNull(), F.col("status"))
        .when(action == "complete", "COMPLETED")
        .when(action == "unavailable", "SKIPPED")
        .when(action == "release", "PENDING")
        .when(action == "start", "PROCESSING")
        .when(category == "NON_RETRYABLE", "DEAD_LETTER")
        .when(category == "UNAVAILABLE", F.when(exhausted, "DEAD_LETTER").otherwise("DEFERRED"))
        .otherwise(F.when(spent, "DEAD_LETTER").otherwise("FAILED"))
    )
    pause = transient_retry_seconds(F.col("attempt_count"), policy)
    again = (
        F.when(action.isNull() | (action == "start"), F.col("next_attempt_at"))
        .when(action == "release", at)
        .when(failed & (status == "FAILED"), F.timestamp_add("SECOND", pause + jitter_seconds(pause, F.col("id"), F.col("attempt_count")), at))
        .when(failed & (status == "DEFERRED"), F.timestamp_add("MINUTE", deferred_retry_minutes(F.col("o.retry_after"), policy), at))
    )
    kept = action.isNull() | (action == "start")
    deferring = failed & (category == "UNAVAILABLE")
    return rows.select(
        "id",
        *KEY,
        status.alias("status"),
        (F.col("attempt_count") + F.when(action == "start", 1).otherwise(0)).alias("attempt_count"),
        F.when(F.coalesce(deferring, F.lit(False)), defers).otherwise(F.col("defer_count")).alias("defer_count"),
        again.alias("next_attempt_at"),
        F.when(kept, F.col("claimed_at")).alias("claimed_at"),
        F.when(kept, F.col("claimed_by")).alias("claimed_by"),
        F.when(kept, F.col("processed_at")).when(action == "complete", at).alias("processed_at"),
        F.when(deferring & ~exhausted, since).otherwise(F.col("first_deferred_at")).alias("first_deferred_at"),
        F.when(failed, category).otherwise(F.col("failure_category")).alias("failure_category"),
        F.when(kept, F.col("error_message"))
        .when(failed, F.col("o.note"))
        .when(action == "unavailable", UNAVAILABLE_NOTE)
        .alias("error_message"),
        "created_at",
        F.coalesce(at, "updated_at").alias("updated_at"),
    )


def requeue_dead_letters(queue: DataFrame, ids: DataFrame, as_of: datetime) -> DataFrame:
    """Revive the named rows with fresh counters; only dead letters can be revived."""
    wanted = ids.select("id").distinct().withColumn("_wanted", F.lit(True))
    hit = F.col("_wanted").isNotNull() & (F.col("status") == "DEAD_LETTER")
    reset = {
        "status": F.lit("PENDING"),
        "attempt_count": F.lit(0),
        "defer_count": F.lit(0),
        "first_deferred_at": _no("timestamp"),
        "failure_category": _no("string"),
        "error_message": _no("string"),
        "next_attempt_at": F.lit(as_of),
        "claimed_at": _no("timestamp"),
        "claimed_by": _no("string"),
    }
    return (
        queue.join(wanted, "id", "left")
        .withColumns({n: F.when(hit, v).otherwise(F.col(n)) for n, v in reset.items()})
        .drop("_wanted")
    )


def recover_leases(queue: DataFrame, as_of: datetime, policy: QueuePolicy = POLICY) -> DataFrame:
    """Give up claims older than the lease: due again at once, or dead when attempts are used up."""
    lost = (F.col("status") == "PROCESSING") & (
        F.col("claimed_at") < F.timestamp_add("MINUTE", F.lit(-policy.lease_minutes), F.lit(as_of))
    )
    lost = F.coalesce(lost, F.lit(False))
    spent = F.col("attempt_count") >= policy.max_attempts
    note = F.substring(F.concat(F.coalesce("error_message", F.lit("")), F.lit(LEASE_NOTE)), 1, 4000)
    changes = {
        "status": F.when(spent, "DEAD_LETTER").otherwise("FAILED"),
        "claimed_at": _no("timestamp"),
        "claimed_by": _no("string"),
        "next_attempt_at": F.when(~spent, F.lit(as_of)),
        "error_message": note,
        "updated_at": F.lit(as_of),
    }
    return queue.withColumns({n: F.when(lost, v).otherwise(F.col(n)) for n, v in changes.items()})


# -- reports ------------------------------------------------------------------------------------------------------


def stats(queue: DataFrame) -> DataFrame:
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


def backlog(queue: DataFrame, policy: QueuePolicy = POLICY) -> DataFrame:
    """Outstanding and dead rows with their alerts; deferred rows are not outstanding."""
    return queue.agg(
        F.count_if(F.col("status").isin("PENDING", "FAILED")).alias("outstanding"),
        F.count_if(F.col("status") == "DEAD_LETTER").alias("dead_letters"),
    ).withColumns(
        {
            "backlog_alert": F.col("outstanding") > policy.backlog_warning,
            "dead_letter_alert": F.col("dead_letters") > 0,
        }
    )


def entries(queue: DataFrame, status: str) -> DataFrame:
    return queue.filter(F.col("status") == status).select(*ENTRY_COLUMNS).orderBy(F.desc("updated_at"), F.asc("id"))


def ingested_since(queue: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    since = F.timestamp_add("DAY", F.lit(-clamp(days, 1, 365)), F.lit(as_of))
    return queue.filter(F.col("created_at") >= since).select("created_at").orderBy("created_at")


RUN_OUTCOMES = ("claimed", "completed", "skipped", "rate_limited", "failed", "deferred", "dead_lettered")


def run_counters(log: DataFrame, outcomes: Sequence[str] = RUN_OUTCOMES) -> DataFrame:
    """Counters per run from an outcome log ``(run_id, outcome)``; ``claimed`` counts all rows of the run."""
    named = [F.count_if(F.col("outcome") == o).alias(o) for o in outcomes if o != "claimed"]
    return log.groupBy("run_id").agg(F.count(F.lit(1)).alias("claimed"), *named)


def run_log(outcomes: DataFrame, before: DataFrame, after: DataFrame, policy: QueuePolicy = POLICY) -> DataFrame:
    """Outcome log of a run: what became of each valid report."""
    valid = owned(outcomes, before, policy).select("id", "run_id", "action")
    named = (
        F.when(F.col("action") == "complete", "completed")
        .when(F.col("action") == "unavailable", "skipped")
        .when(F.col("action") == "release", "rate_limited")
        .when(F.col("action") == "start", "started")  # under way: no outcome yet
        .when(F.col("status") == "DEAD_LETTER", "dead_lettered")
        .when(F.col("status") == "DEFERRED", "deferred")
        .otherwise("failed")
    )
    return valid.join(after.select("id", "status"), "id").select("run_id", named.alias("outcome"))


def _window_starts(moments: DataFrame) -> DataFrame:
    """(at): the calls that open a window of a minute: the first one, then each first one more than a minute after the last such.

    A call more than a minute after the call before it opens a window whatever went before. From those on, each window's
    opening is found by following links, from each moment to the first one more than a minute later. The links are
    doubled in each round, so the rounds are the logarithm of the windows between two pauses.
    """
    minute = F.expr("INTERVAL 60 SECONDS")
    none = F.lit(None).cast(moments.schema["at"].dataType)
    # at one moment calls come before the ends of windows, which therefore look strictly ahead
    calls = moments.select(F.lit(0).alias("k"), F.col("at").alias("moment"), F.lit(0).alias("phase"), "at", F.col("at").alias("value"))
    ends = moments.select(F.lit(0).alias("k"), (F.col("at") + minute).alias("moment"), F.lit(1).alias("phase"), "at", none.alias("value"))
    ahead = next_value(calls.unionByName(ends), ["k"], hour_of(F.col("moment")), ["moment", "phase"], F.col("value"), "ahead")
    ahead = cut_lineage(ahead.filter("ahead IS NOT NULL").select("phase", "at", "ahead"))
    paused = ahead.filter((F.col("phase") == 0) & (F.col("ahead") > F.col("at") + minute)).select(F.col("ahead").alias("at"))
    found = cut_lineage(moments.agg(F.min("at").alias("at")).filter("at IS NOT NULL").unionByName(paused))
    links = ahead.filter("phase = 1").select("at", "ahead")
    links = cut_lineage(links.join(found.select(F.col("at").alias("ahead")), "ahead", "left_anti").select("at", "ahead"))
    while True:
        more = found.join(links, "at").select(F.col("ahead").alias("at"))
        if more.isEmpty():
            return found
        found = cut_lineage(found.unionByName(more))
        beyond = links.select(F.col("at").alias("ahead"), F.col("ahead").alias("beyond"))
        links = cut_lineage(links.join(beyond, "ahead").select("at", F.col("beyond").alias("ahead")))


def call_outcomes(calls: DataFrame, moment: str = "ts", key: str = "event_id", per_minute: int = 20, per_day: int = 50) -> DataFrame:
    """What a limiter says to every call, as if they came one by one: ``call, at, window_start, day, outcome``.

    A window opens with a call and holds for a minute; the next later call opens the next one, whether it is permitted or not.
    A call is refused (DAY) if its day has had ``per_day`` permitted ones, else (MINUTE) if its window has had
    ``per_minute``. Calls of one moment come in the order of ``key``, which must be unique; calls without a moment are
    left out. Only the window over midnight hands something on from one day to the next, so days are counted again until
    what they hand on no longer changes.
    """
    rows = cut_lineage(calls.select(F.col(key).alias("call"), F.col(moment).alias("at")).filter("at IS NOT NULL"))
    starts = _window_starts(rows.select("at").distinct())
    opening = rows.groupBy("at").agg(F.min("call").alias("call")).join(starts, "at").select("call", F.lit(1).alias("_opens"))
    order = [F.asc("at"), F.asc("call")]
    opened = rows.join(opening, "call", "left").withColumn("_all", F.lit(0))
    numbered = running_totals(opened, ["_all"], hour_of(F.col("at")), order, sums={"window": F.coalesce(F.col("_opens"), F.lit(0)).cast("bigint")})
    placed = numbered.select("call", "at", "window", F.to_date("at").alias("day"))
    spans = placed.groupBy("window").agg(F.min("at").alias("window_start"), F.max("day").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("window", "day").orderBy(*order))
    placed = cut_lineage(placed.join(spans, "window").withColumn("_nth", nth))
    crossing = F.to_date("window_start") < F.col("_last")
    handed: DataFrame | None = None
    while True:
        if handed is None:
            told = placed.withColumn("_had", F.lit(0).cast("bigint"))
        else:
            told = placed.join(handed, ["window", "day"], "left").na.fill(0, ["_had"])
        fits = F.col("_nth") + F.col("_had") <= per_minute
        counted = running_totals(told.withColumn("_fits", fits), ["day"], hour_of(F.col("at")), order, sums={"_taken": F.col("_fits").cast("bigint")})
        had = F.col("_taken") - F.col("_fits").cast("bigint")
        outcome = F.when(had >= per_day, "DAY").when(F.col("_fits"), "PERMITTED").otherwise("MINUTE")
        judged = cut_lineage(counted.select("call", "at", "window", "window_start", "day", "_last", outcome.alias("outcome")))
        over = judged.filter(crossing & (F.col("day") < F.col("_last")) & (F.col("outcome") == "PERMITTED"))
        now = cut_lineage(over.groupBy("window", F.col("_last").alias("day")).agg(F.count(F.lit(1)).alias("_had")))
        before = handed if handed is not None else now.limit(0)
        if now.exceptAll(before).isEmpty() and before.exceptAll(now).isEmpty():
            return judged.select("call", "at", "window_start", "day", "outcome")
        handed = now


def call_budget(calls: DataFrame, moment: str = "ts", key: str = "event_id", per_minute: int = 20, per_day: int = 50) -> DataFrame:
    """Per window that a call has opened: its calls, how many were permitted, and what minute and day have left after it."""
    said = cut_lineage(call_outcomes(calls, moment, key, per_minute, per_day))
    ok = F.count_if(F.col("outcome") == "PERMITTED")
    parts = said.groupBy("window_start", "day").agg(F.count(F.lit(1)).alias("calls"), ok.alias("permitted"))
    used = Window.partitionBy("day").orderBy("window_start")  # at most 1,440 windows a day
    parts = parts.withColumn("day_used", F.sum("permitted").over(used))
    windows = parts.groupBy("window_start").agg(F.sum("calls").alias("calls"), F.sum("permitted").alias("permitted"), F.max_by("day_used", "day").alias("day_used"))
    return windows.select(
        "window_start",
        "calls",
        "permitted",
        F.greatest(F.lit(0), per_minute - F.col("permitted")).alias("minute_left"),
        F.greatest(F.lit(0), per_day - F.col("day_used")).alias("day_left"),
        (F.col("permitted") < F.col("calls")).alias("over_budget"),
    )


def claim_size(batch: int, minute_left: int, day_left: int) -> int:
    return max(0, min(batch, minute_left, day_left))
