"""The work queue's command log as a batch job that does not replay a message's log in one piece.

A log is cut into segments of a bounded number of commands. Every segment is replayed from a guess of the state it starts
in, all at once; a segment's next guess is what the last segment before it that changed anything ended in. Only segments
whose guess has changed are replayed again, until none changes; then every segment has started from the right state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..streaming.queue_state import COLUMNS, MINUTE_US, commands
from .queue import KEY, POLICY, QueuePolicy
from .timeline import next_value, running_totals

#: Commands of a segment at most: an array of some hundred KB.
SEGMENT = 4096
#: Commands whose states are written out together.
CHUNK = 64
STATE = "status string, attempts int, defers int, first_deferred_us bigint, next_us bigint, claimed_us bigint, claimed_by string"
_TYPE = f"struct<{', '.join(f.replace(' ', ': ', 1) for f in STATE.split(', '))}>"
_FIELDS = tuple(f.split()[0] for f in STATE.split(", "))
#: Segments that are ordered together when guesses are passed on.
_STRETCH = 1000
HOUR_US = 60 * MINUTE_US


def fresh() -> Column:
    """The state of a message before its first command."""
    values = ("PENDING", 0, 0, None, None, None, None)
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(_FIELDS, values))).cast(_TYPE)


def _status_after(s: Column, c: Column, policy: QueuePolicy) -> Column:
    """Status after a command, null where the command is void."""
    status, us, action = s["status"], c["us"], c["action"]
    waiting = status.isin("PENDING", "FAILED") & (s["attempts"] < policy.max_attempts)
    deferred = (status == "DEFERRED") & (s["defers"] < policy.max_defers)
    due = F.coalesce(s["next_us"] <= us, F.lit(True)) & (F.coalesce(c["worker"], F.lit("")) != "")
    oldest = us - policy.lease_minutes * MINUTE_US
    held = status == "PROCESSING"
    live = held & (c["worker"] == s["claimed_by"]) & (s["claimed_us"] >= oldest)
    spent = s["attempts"] >= policy.max_attempts
    since = F.coalesce(s["first_deferred_us"], us)
    given_up = (s["defers"] + 1 > policy.max_defers) | (us - since >= policy.defer_horizon_minutes * MINUTE_US)
    failed = (
        F.when(c["category"] == "NON_RETRYABLE", "DEAD_LETTER")
        .when(c["category"] == "UNAVAILABLE", F.when(given_up, "DEAD_LETTER").otherwise("DEFERRED"))
        .otherwise(F.when(spent, "DEAD_LETTER").otherwise("FAILED"))
    )
    return (
        F.when(action == "claim", F.when((waiting | deferred) & due, "PROCESSING"))
        .when(action == "requeue", F.when(status == "DEAD_LETTER", "PENDING"))
        .when(action == "remove", F.when(status.isin("PENDING", "FAILED", "DEFERRED"), "SKIPPED"))
        .when(action == "reap", F.when(held & (s["claimed_us"] < oldest), F.when(spent, "DEAD_LETTER").otherwise("FAILED")))
        .when(
            live,
            F.when(action == "start", "PROCESSING")
            .when(action == "release", "PENDING")
            .when(action == "complete", "COMPLETED")
            .when(action == "unavailable", "SKIPPED")
            .when(action == "fail", failed),
        )
    )


def _moved(s: Column, c: Column, after: Column, policy: QueuePolicy) -> Column:
    """The state after an accepted command that leads to the status ``after``."""
    us, action = c["us"], c["action"]
    anew, unavailable = action == "requeue", (action == "fail") & (c["category"] == "UNAVAILABLE")
    doublings = F.least(F.greatest(s["attempts"] - 1, F.lit(0)), F.lit(10))
    pause = F.least(F.lit(30) * F.pow(F.lit(2), doublings), F.lit(policy.max_backoff_minutes * 60)).cast("bigint")
    due = (
        F.when(action.isin("claim", "start"), s["next_us"])
        .when(action.isin("requeue", "release"), us)
        .when((action == "reap") & (after == "FAILED"), us)
        .when(after == "DEFERRED", us + c["retry_minutes"].cast("bigint") * MINUTE_US)
        .when(after == "FAILED", us + pause * 1_000_000)
    )
    since = F.when(after == "DEFERRED", F.coalesce(s["first_deferred_us"], us)).when(~anew, s["first_deferred_us"])
    fields = (
        after,
        F.when(anew, 0).otherwise(s["attempts"] + (action == "start").cast("int")),
        F.when(anew, 0).otherwise(s["defers"] + F.coalesce(unavailable, F.lit(False)).cast("int")),
        since,
        due,
        F.when(action == "claim", us).when(action == "start", s["claimed_us"]),
        F.when(action == "claim", c["worker"]).when(action == "start", s["claimed_by"]),
    )
    return F.struct(*(v.alias(n) for n, v in zip(_FIELDS, fields))).cast(_TYPE)


def _step(s: Column, c: Column, policy: QueuePolicy) -> Column:
    """(state after the command, whether it was accepted)."""
    # the status is bound once: every field of the state looks at it
    return F.transform(
        F.array(_status_after(s, c, policy)),
        lambda after: F.struct(
            F.when(after.isNull(), s).otherwise(_moved(s, c, after, policy)).alias("state"),
            after.isNotNull().alias("accepted"),
        ),
    )[0]


def _ends(entry: Column, log: Column, policy: QueuePolicy) -> Column:
    """(last state, whether any command was accepted) of a segment."""

    def merge(acc: Column, c: Column) -> Column:
        return F.transform(
            F.array(_step(acc["state"], c, policy)),
            lambda r: F.struct(r["state"].alias("state"), (acc["accepted"] | r["accepted"]).alias("accepted")),
        )[0]

    return F.aggregate(log, F.struct(entry.alias("state"), F.lit(False).alias("accepted")), merge)


def _trace(entry: Column, log: Column, policy: QueuePolicy) -> Column:
    """(state, accepted) after each command of a segment, behind one of the entry itself."""
    first = F.array(F.struct(entry.alias("state"), F.lit(False).alias("accepted")))
    return F.aggregate(log, first, lambda acc, c: F.array_append(acc, _step(F.element_at(acc, -1)["state"], c, policy)))


def _chunks(rows: DataFrame, policy: QueuePolicy) -> DataFrame:
    """Segments (key, entry, log) cut into chunks, each with the state that it starts in."""
    log = F.col("log")
    count = F.ceil(F.size("log") / CHUNK).cast("int")

    def part(i: Column) -> Column:
        return F.slice(log, i * CHUNK + 1, F.lit(CHUNK))

    # the states at the chunks' borders; the last chunk's end is not needed
    inner = F.when(count > 1, F.sequence(F.lit(0), count - 2)).otherwise(F.array().cast("array<int>"))
    marks = F.aggregate(
        inner, F.array("entry"), lambda acc, i: F.array_append(acc, _ends(F.element_at(acc, -1), part(i), policy)["state"])
    )
    cut = rows.select(*KEY, "log", F.posexplode(marks).alias("_i", "entry"))
    return cut.select(*KEY, "entry", part(F.col("_i")).alias("log"))


def segments(raw: DataFrame, policy: QueuePolicy = POLICY, size: int = SEGMENT) -> DataFrame:
    """Commands as (key, seg, log): arrays of at most ``size`` commands in the order of time.

    Commands without a key or a moment have no place in a log and are left out.
    """
    placed = commands(raw, policy).dropna(subset=[*KEY, "us"])
    order = [F.asc(c) for c in ("us", "seq", "action", "worker", "category", "retry_minutes")]
    numbered = running_totals(placed, KEY, F.floor(F.col("us") / HOUR_US), order, {"n": F.lit(1)})
    command = F.struct("n", "us", "action", "worker", "category", "retry_minutes")
    cut = numbered.withColumn("seg", F.floor((F.col("n") - 1) / size))
    return cut.groupBy(*KEY, "seg").agg(F.array_sort(F.collect_list(command)).alias("log"))


def _guessed(known: DataFrame) -> DataFrame:
    """Segments with the state they should start in: the end of the last one before them that changed anything."""
    back = known.withColumn("_back", -F.col("seg"))
    moved = F.when(F.col("accepted"), F.col("_back"))
    linked = next_value(back, KEY, F.floor(F.col("_back") / _STRETCH), ["_back"], moved, "_from")
    ends = known.filter("accepted").select(*KEY, (-F.col("seg")).alias("_from"), F.col("state").alias("_end"))
    joined = linked.join(ends, [*KEY, "_from"], "left")
    return joined.withColumn("guess", F.when(F.col("_from").isNull(), F.col("first")).otherwise(F.col("_end")))


def fold(
    raw: DataFrame, stored: DataFrame | None = None, policy: QueuePolicy = POLICY, size: int = SEGMENT
) -> tuple[DataFrame, DataFrame]:
    """Replay a log of commands; returns the applied commands as the queue stream does, and each message's last state.

    ``stored`` has the states (key and the columns of ``STATE``, one row per message) that earlier logs ended in; other
    messages are fresh. Messages without commands are not in the result. There are as many rounds as segments of one
    message follow each other that end differently for each of their guesses: few, since a requeued or finished message
    forgets how it began; in the worst case one per segment of the longest log.
    """
    logs = cut_lineage(segments(raw, policy, size))
    begun = logs.withColumn("first", fresh())
    if stored is not None:
        before = stored.select(*KEY, F.struct(*_FIELDS).cast(_TYPE).alias("_stored"))
        begun = logs.join(before, list(KEY), "left").withColumn("first", F.coalesce("_stored", fresh()))

    def replayed(rows: DataFrame) -> DataFrame:
        ended = rows.withColumn("_ends", _ends(F.col("entry"), F.col("log"), policy))
        return ended.select(*KEY, "seg", "first", "entry", "_ends.state", "_ends.accepted")

    known = cut_lineage(replayed(begun.withColumn("entry", F.col("first"))))
    while True:
        wrong = _guessed(known.join(_long(known), list(KEY), "left_semi")).filter(~F.col("guess").eqNullSafe(F.col("entry")))
        again = cut_lineage(wrong.select(*KEY, "seg", "first", F.col("guess").alias("entry")))
        if again.isEmpty():
            break
        redone = replayed(again.join(logs, [*KEY, "seg"]))
        known = cut_lineage(known.join(again, [*KEY, "seg"], "left_anti").unionByName(redone))

    chunks = _chunks(known.select(*KEY, "seg", "entry").join(logs, [*KEY, "seg"]), policy)
    traced = chunks.withColumn("_trace", F.slice(_trace(F.col("entry"), F.col("log"), policy), 2, CHUNK))
    each = traced.select(*KEY, F.explode(F.arrays_zip("log", "_trace")).alias("e"))
    values = (
        *KEY, "e.log.us", "e.log.action", "e._trace.accepted", "e._trace.state.status", "e._trace.state.attempts",
        "e._trace.state.defers", "e._trace.state.next_us",
    )
    rows = each.select(*(F.col(v).alias(c) for c, v in zip(COLUMNS, values)))
    last = known.groupBy(*KEY).agg(F.max_by("state", "seg").alias("s")).select(*KEY, "s.*")
    return rows, last


def _long(known: DataFrame) -> DataFrame:
    """Keys of messages with more than one segment; the others are settled at once."""
    return known.filter("seg = 1").select(*KEY)
