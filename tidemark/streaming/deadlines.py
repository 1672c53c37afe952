"""Response deadlines on a stream: messages and answers wait for each other in keyed state, in whatever order they come."""

from __future__ import annotations

import heapq
import pickle
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.addresses import address_set
from ..functions.text import strip
from ..session import use_keyed_state

OUTPUT = "sla_id string, kind string, at_us bigint, deadline_us bigint, reply_id string, responded_by string, breach int"
#: How long a row may be known and not yet have reached the stream.
ARRIVAL = timedelta(minutes=10)
ARRIVAL_DELAY = f"{int(ARRIVAL.total_seconds())} seconds"
#: Groups of conversations that share their state.
BUCKETS = 256


def conversation_events(slas: DataFrame, replies: DataFrame) -> DataFrame:
    """Openings and replies in one stream, keyed by conversation, mailbox and address; one row per address of a reply."""
    none = F.lit(None)
    opened = slas.select(
        "conversation_id",
        F.col("mailbox_user_id").alias("mailbox"),
        F.lower(strip(F.col("customer_email"))).alias("address"),
        F.col("received_at").alias("moment"),
        "sla_id",
        F.unix_micros("sla_deadline_at").alias("deadline_us"),
        none.cast("string").alias("reply_id"),
    )
    answers = replies.select(
        "conversation_id",
        "mailbox",
        F.explode(address_set(F.col("recipients"))).alias("address"),
        F.col("sent_at").alias("moment"),
        none.cast("string").alias("sla_id"),
        none.cast("bigint").alias("deadline_us"),
        "reply_id",
    )
    return opened.unionByName(answers).dropna(subset=["conversation_id", "mailbox", "address", "moment"])


class AnswerTracker(StatefulProcessor):
    """Emits OPENED with each message and ANSWERED whenever an earlier first answer of it becomes known.

    Both sides are kept: a reply that arrives before its message, or after a later reply, still counts. With ``timers``,
    BREACHED (``breach`` 1) comes when the clock passes an unanswered message's deadline, or with an answer that is late, and
    CORRECTED (``breach`` -1) if an answer in time becomes known after that.

    Many conversations share a bucket and its state, so that a batch costs a few state calls per bucket instead of several per
    row: (conversation, mailbox, address) -> messages (sla_id -> [us, deadline, first answer, breached]) and sorted replies.
    A bucket has one timer, at the first deadline that somebody waits for.
    """

    def __init__(self, timers: bool = False) -> None:
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held binary")

    def load(self) -> None:
        held = self.state.get()
        # the conversations, a heap of the deadlines that somebody waits for, and the timer that is set
        self.talks, self.waits, self.armed = pickle.loads(held[0]) if held else ({}, [], None)

    def save(self, expired: int | None = None) -> None:
        first = self.waits[0][0] if self.waits else None
        if first != self.armed:
            if self.armed is not None and self.armed != expired:
                self.handle.deleteTimer(self.armed)
            if first is not None:
                self.handle.registerTimer(first)
            self.armed = first
        self.state.update((pickle.dumps((self.talks, self.waits, self.armed)),))

    def answered(self, sla_id, message, answer, mailbox) -> Iterator[Row]:
        """Note the first answer that is known so far."""
        _, deadline, _, breached = message
        late = answer[0] > deadline
        yield _event(sla_id, "ANSWERED", answer[0], deadline, answer[1], mailbox)
        if self.timers and late != breached:
            yield _event(sla_id, "BREACHED" if late else "CORRECTED", answer[0], deadline, answer[1], mailbox, 1 if late else -1)
        message[2:] = answer[0], self.timers and late

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.load()
        clock = timerValues.getCurrentWatermarkInMs()
        out = []
        while self.waits and self.waits[0][0] <= clock:
            _, talk, sla_id = heapq.heappop(self.waits)
            message = self.talks[talk][0][sla_id]
            if not message[3] and message[2] is None:
                out.append(_event(sla_id, "BREACHED", message[1], message[1], None, None, 1))
                message[3] = True
        self.save(expiredTimerInfo.getExpiryTimeInMs())
        return iter(out)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        brought: dict[tuple, tuple[dict, set]] = {}
        for r in rows:
            if r.sla_id is None and r.reply_id is None:
                continue
            opened, answers = brought.setdefault((r.conversation_id, r.mailbox, r.address), ({}, set()))
            if r.sla_id is not None:
                opened[r.sla_id] = (r.us, r.deadline_us)
            else:
                answers.add((r.us, r.reply_id))
        out: list[Row] = []
        if brought:
            self.load()
            for talk, (opened, answers) in brought.items():
                self.take(talk, opened, sorted(answers), out)
            self.save()
        return iter(out)

    def take(self, talk: tuple, opened: dict, new: list, out: list[Row]) -> None:
        messages, known = self.talks.setdefault(talk, ({}, []))
        if new:
            # only messages that wait, or whose answer came later, are touched
            for sla_id, message in messages.items():
                at = bisect_right(new, message[0], key=lambda x: x[0])
                if at < len(new) and (message[2] is None or new[at][0] < message[2]):
                    out += self.answered(sla_id, message, new[at], talk[1])
            known[:] = sorted({*known, *new}) if known else new
        for sla_id, (us, deadline) in opened.items():
            if sla_id in messages:
                continue
            out.append(_event(sla_id, "OPENED", us, deadline, None, None))
            message = messages[sla_id] = [us, deadline, None, False]
            at = bisect_right(known, us, key=lambda x: x[0])
            if at < len(known):
                out += self.answered(sla_id, message, known[at], talk[1])
            elif self.timers and deadline is not None:
                heapq.heappush(self.waits, (deadline // 1000 + 1, talk, sla_id))  # the first whole millisecond past it

    def close(self) -> None:
        pass


def _event(sla_id, kind, at_us, deadline_us, reply_id, responded_by, breach=0) -> Row:
    return Row(sla_id=sla_id, kind=kind, at_us=at_us, deadline_us=deadline_us, reply_id=reply_id, responded_by=responded_by, breach=breach)


def _dealt(events: DataFrame, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("conversation_id", "mailbox", "address"), F.lit(buckets)).cast("int")
    return events.withColumns({"us": F.unix_micros("moment"), "bucket": bucket})


def track_deadlines(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Stream of openings and answers. There is no watermark and no retention: late rows and late answers count.

    State grows with the messages and replies of the conversations; each is a few numbers. A batch writes the state of the
    buckets that it touches; ``buckets`` must stay as it is for the life of a checkpoint.
    """
    use_keyed_state(events.sparkSession)
    return _dealt(events, buckets).groupBy("bucket").transformWithState(
        statefulProcessor=AnswerTracker(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def track_breaches(events: DataFrame, clock: str = "known_at", delay: str = ARRIVAL_DELAY, buckets: int = BUCKETS) -> DataFrame:
    """As :func:`track_deadlines`, with the breaches themselves, as the clock passes the deadlines.

    ``clock`` is when a row became known, not when it happened: what happened long ago may become known today. It need only
    come in order up to ``delay``. A row without conversation, mailbox and address, see :func:`tick`, moves the clock on.
    """
    use_keyed_state(events.sparkSession)
    timed = _dealt(events.withWatermark(clock, delay), buckets)
    return timed.groupBy("bucket").transformWithState(
        statefulProcessor=AnswerTracker(timers=True), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def tick(events: DataFrame, moment: datetime, clock: str = "known_at") -> DataFrame:
    """A row of ``events``' columns that only says what time it is."""
    given = {clock: F.lit(moment)} | {c: F.lit("") for c in ("conversation_id", "mailbox", "address")}
    one = events.sparkSession.range(1)
    return one.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema))


def states(events: DataFrame) -> DataFrame:
    """State per message as the emitted rows add up, in whatever order they were written; no clock is needed."""
    answer = F.min(F.when(F.col("kind") == "ANSWERED", F.struct("at_us", "reply_id", "responded_by")))
    summed = events.groupBy("sla_id").agg(answer.alias("a"), F.sum("breach").alias("breached"))
    status = F.when(F.col("breached") > 0, "BREACHED").when(F.col("a").isNotNull(), "COMPLETED").otherwise("WAITING")
    return summed.select(
        "sla_id",
        status.alias("status"),
        F.timestamp_micros("a.at_us").alias("first_response_at"),
        F.col("a.reply_id").alias("response_message_id"),
        F.col("a.responded_by").alias("responded_by"),
    )


def settle(events: DataFrame, as_of: datetime) -> DataFrame:
    """State per message from its events: answered ones, and unanswered ones whose deadline lies before ``as_of``."""
    answer = F.min(F.when(F.col("kind") == "ANSWERED", F.struct("at_us", "reply_id", "responded_by")))
    settled = events.groupBy("sla_id").agg(answer.alias("a"), F.max("deadline_us").alias("deadline_us"))
    late = F.coalesce(F.col("a.at_us") > F.col("deadline_us"), F.lit(True))
    clock = F.unix_micros(F.lit(as_of).cast("timestamp"))
    return settled.filter(F.col("a").isNotNull() | (F.col("deadline_us") < clock)).select(
        "sla_id",
        F.when(late, "BREACHED").otherwise("COMPLETED").alias("status"),
        F.timestamp_micros("a.at_us").alias("first_response_at"),
        F.col("a.reply_id").alias("response_message_id"),
        F.col("a.responded_by").alias("responded_by"),
    )
