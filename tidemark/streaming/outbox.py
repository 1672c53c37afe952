"""The change feed's outbox on a stream: claims go out, delivery results come in, timers retry, recover and forget.

Work per batch is that of the events it brings, of what is open in their buckets and of the ids published within the retention;
what was published before that is forgotten.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import use_keyed_state

OUTPUT = "id string, kind string, attempt int, at_ms bigint, due_ms bigint, error string"
RETRY_BASE, RETRY_MOST, MOST_DOUBLINGS = 2, 60, 10
STALE_CLAIM = timedelta(minutes=2)
RETENTION = timedelta(days=7)
#: Groups of ids that share their state.
BUCKETS = 256
DAY_MS = 86_400_000


def pause_ms(attempt: int, base: int = RETRY_BASE, most: int = RETRY_MOST) -> int:
    """Pause after a failed attempt."""
    return 1000 * min(most, base * 2 ** min(max(1, attempt) - 1, MOST_DOUBLINGS))


def outbox_rows(events: DataFrame, results: DataFrame) -> DataFrame:
    """Events (id, known_at) and results of attempts (id, attempt, error, known_at) in one stream; ``error`` is null where it worked."""
    told = results.select("id", "attempt", "error", "known_at")
    new = events.select("id", F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("error"), "known_at")
    return new.unionByName(told)


class Outbox(StatefulProcessor):
    """The events of one bucket: each is PENDING until it is due, PROCESSING since it was claimed, or PUBLISHED.

    Emits CLAIMED with each attempt that is to be delivered, FAILED with the time of the next one, PUBLISHED, RECOVERED where a
    claim had no result in time, and PURGED when a published event is forgotten. Results may become known before
    their claim is due; they wait for it.

    Many ids share a bucket, so that a batch costs a few state calls per bucket instead of dozens per id. ``open`` holds what is
    not published yet: id -> [status, attempt, at, due, waiting results]; ``done`` holds id -> (attempt, at) of published events
    by the day on which they are forgotten, of which a batch writes only those that change. A bucket has one timer, at
    the earliest moment at which something is due.
    """

    def __init__(self, stale: timedelta = STALE_CLAIM, retention: timedelta = RETENTION) -> None:
        self.stale_ms, self.retention_ms = (int(x.total_seconds() * 1000) for x in (stale, retention))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "held binary")
        self.done = handle.getMapState("done", "day bigint", "held binary")

    def load(self) -> None:
        held = self.state.get()
        # events that are open, first moment of each day of the published ones, and the timer that is set
        self.open, self.firsts, self.armed = pickle.loads(held[0]) if held else ({}, {}, None)
        self.days: dict[int, dict] = {}
        self.touched: set[int] = set()

    def day(self, day: int) -> dict:
        if day not in self.days:
            self.days[day] = pickle.loads(self.done.getValue((day,))[0]) if day in self.firsts else {}
        return self.days[day]

    def save(self, expired: int | None = None) -> None:
        for day in self.touched:
            if held := self.days[day]:
                self.done.updateValue((day,), (pickle.dumps(held),))
                self.firsts[day] = min(at for _, at in held.values()) + self.retention_ms + 1
            elif day in self.firsts:
                self.done.removeKey((day,))
                del self.firsts[day]
        moments = [self.due_of(x) for x in self.open.values() if x[0]]
        first = min([*moments, *self.firsts.values()], default=None)
        if first != self.armed:
            if self.armed is not None and self.armed != expired:
                self.handle.deleteTimer(self.armed)
            if first is not None:
                self.handle.registerTimer(first)
            self.armed = first
        if self.open or self.firsts:
            self.state.update((pickle.dumps((self.open, self.firsts, self.armed)),))
        else:
            self.state.clear()

    def due_of(self, event: list) -> int:
        return event[3] if event[0] == "PENDING" else event[2] + self.stale_ms + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[str, int] = {}
        told: dict[str, list] = {}
        for r in rows:
            if r.id is None:
                continue
            if r.attempt is None:
                arrived[r.id] = min(r.ms, arrived.get(r.id, r.ms))
            else:
                told.setdefault(r.id, []).append((r.attempt, r.error, r.ms))
        out: list[Row] = []
        if not arrived and not told:
            return iter(out)
        self.load()
        published = {i for day in list(self.firsts) for i in self.day(day)}
        for ident in dict.fromkeys((*arrived, *told)):
            if ident in published:
                continue
            event = self.open.setdefault(ident, [None, 0, None, None, {}])
            results = told.get(ident, [])
            event[4].update((attempt, (error, ms)) for attempt, error, ms in results)
            if event[0] is None:
                if ident in arrived:
                    self.claim(ident, event, 1, arrived[ident], out)
            elif results:
                attempt = event[1]
                late = [(a, ms) for a, error, ms in results if error is None and a < attempt]
                if event[0] == "PROCESSING":
                    self.settle(ident, event, out)
                if late and ident in self.open:  # an attempt that was given up has worked after all
                    self.published(ident, *min(late), out)
        self.save()
        return iter(out)

    def claim(self, ident: str, event: list, attempt: int, ms: int, out: list[Row]) -> None:
        event[:4] = "PROCESSING", attempt, ms, None
        out.append(_row(ident, "CLAIMED", attempt, ms))
        self.settle(ident, event, out)

    def settle(self, ident: str, event: list, out: list[Row]) -> None:
        """Apply the result of the attempt under way, if it is known."""
        _, attempt, claimed, _, results = event
        if attempt not in results:
            return
        error, ms = results.pop(attempt)
        ms = max(ms, claimed)
        if error is None:
            self.published(ident, attempt, ms, out)
        else:
            event[:4] = "PENDING", attempt, ms, ms + pause_ms(attempt)
            out.append(_row(ident, "FAILED", attempt, ms, event[3], error))

    def published(self, ident: str, attempt: int, ms: int, out: list[Row]) -> None:
        del self.open[ident]
        day = (ms + self.retention_ms + 1) // DAY_MS
        self.day(day)[ident] = (attempt, ms)
        self.touched.add(day)
        out.append(_row(ident, "PUBLISHED", attempt, ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Each event that is due takes one step, at its own moment; what that makes due comes with the next batch."""
        out: list[Row] = []
        clock = timerValues.getCurrentWatermarkInMs()
        self.load()
        for day in [day for day, first in self.firsts.items() if first <= clock]:
            held = self.day(day)
            for ident in [i for i, (_, at) in held.items() if at + self.retention_ms + 1 <= clock]:
                attempt, at = held.pop(ident)
                out.append(_row(ident, "PURGED", attempt, at + self.retention_ms + 1))
            self.touched.add(day)
        for ident, event in [(i, x) for i, x in self.open.items() if x[0] and self.due_of(x) <= clock]:
            now = self.due_of(event)
            if event[0] == "PROCESSING":
                out.append(_row(ident, "RECOVERED", event[1], now))
            self.claim(ident, event, event[1] + 1, now, out)
        self.save(expiredTimerInfo.getExpiryTimeInMs())
        return iter(out)

    def close(self) -> None:
        pass


def _row(ident: str, kind: str, attempt: int, at_ms: int, due_ms: int | None = None, error: str | None = None) -> Row:
    return Row(id=ident, kind=kind, attempt=attempt, at_ms=at_ms, due_ms=due_ms, error=error)


def track_outbox(
    rows: DataFrame, delay: str = "10 minutes", stale: timedelta = STALE_CLAIM, retention: timedelta = RETENTION, buckets: int = BUCKETS
) -> DataFrame:
    """Stream of what happens to every event of ``rows`` (see :func:`outbox_rows`).

    ``known_at`` is the clock; it need only come in order up to ``delay``. Rows with a null id move it on. A timer that a timer
    has set fires with the next batch, with the time at which it was due. An event that
    comes again within the retention is ignored; one that comes again after it is a new one. ``buckets`` must stay as it
    is for the life of a checkpoint; a bucket's open events are written whole by each batch that touches it.
    """
    use_keyed_state(rows.sparkSession)
    timed = rows.withWatermark("known_at", delay).withColumn("ms", F.unix_millis("known_at"))
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithState(
        statefulProcessor=Outbox(stale, retention), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
