"""The work queue as keyed state: each message's commands are applied in time order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.parsing import failure_category
from ..operators.queue import POLICY, QueuePolicy, deferred_retry_minutes
from ..session import use_keyed_state

MINUTE_US = 60_000_000
OUTPUT = (
    "mailbox_user_id string, message_id string, at_us bigint, action string, accepted boolean, status string, "
    "attempt_count int, defer_count int, next_attempt_us bigint"
)
COLUMNS = [field.split()[0] for field in OUTPUT.split(", ")]
STATE = (
    "status string, attempts int, defers int, first_deferred_us bigint, next_us bigint, claimed_us bigint, "
    "claimed_by string"
)
FRESH = ("PENDING", 0, 0, None, None, None, None)


def commands(raw: DataFrame, policy: QueuePolicy = POLICY) -> DataFrame:
    """Classify failures up front, so that the keyed step only moves states."""
    return raw.select(
        "mailbox_user_id",
        "message_id",
        F.unix_micros("moment").alias("us"),
        "seq",
        "action",
        "worker",
        failure_category(F.col("kind"), F.col("http_status"), F.col("message")).alias("category"),
        deferred_retry_minutes(F.col("retry_after"), policy).cast("int").alias("retry_minutes"),
    )


def step(state: tuple, action: str, worker: str | None, us: int, category: str, retry_minutes: int, policy: QueuePolicy):
    """Next state after one command, or ``None`` when the command is void in this state."""
    status, attempts, defers, first_deferred, due, claimed, owner = state
    if action == "claim":
        ready = (status in ("PENDING", "FAILED") and attempts < policy.max_attempts) or (
            status == "DEFERRED" and defers < policy.max_defers
        )
        if not ready or (due is not None and due > us) or not worker:
            return None
        return ("PROCESSING", attempts, defers, first_deferred, due, us, worker)
    if action == "requeue":
        return ("PENDING", 0, 0, None, us, None, None) if status == "DEAD_LETTER" else None
    if action == "remove":
        if status not in ("PENDING", "FAILED", "DEFERRED"):
            return None
        return ("SKIPPED", attempts, defers, first_deferred, None, None, None)
    if action == "reap":
        if status != "PROCESSING" or claimed >= us - policy.lease_minutes * MINUTE_US:
            return None
        if attempts >= policy.max_attempts:
            return ("DEAD_LETTER", attempts, defers, first_deferred, None, None, None)
        return ("FAILED", attempts, defers, first_deferred, us, None, None)
    # the rest needs a live claim of the same worker
    if status != "PROCESSING" or worker != owner or claimed < us - policy.lease_minutes * MINUTE_US:
        return None
    if action == "start":
        return (status, attempts + 1, defers, first_deferred, due, claimed, owner)
    if action == "release":
        return ("PENDING", attempts, defers, first_deferred, us, None, None)
    if action == "complete":
        return ("COMPLETED", attempts, defers, first_deferred, None, None, None)
    if action == "unavailable":
        return ("SKIPPED", attempts, defers, first_deferred, None, None, None)
    if action != "fail":
        return None
    if category == "NON_RETRYABLE":
        return ("DEAD_LETTER", attempts, defers, first_deferred, None, None, None)
    if category == "UNAVAILABLE":
        since = us if first_deferred is None else first_deferred
        if defers + 1 > policy.max_defers or us - since >= policy.defer_horizon_minutes * MINUTE_US:
            return ("DEAD_LETTER", attempts, defers + 1, first_deferred, None, None, None)
        return ("DEFERRED", attempts, defers + 1, since, us + retry_minutes * MINUTE_US, None, None)
    if attempts >= policy.max_attempts:
        return ("DEAD_LETTER", attempts, defers, first_deferred, None, None, None)
    pause = min(30 * 2 ** min(max(attempts - 1, 0), 10), policy.max_backoff_minutes * 60)
    return ("FAILED", attempts, defers, first_deferred, us + pause * 1_000_000, None, None)


class QueueMachine(StatefulProcessor):
    """One message's queue row as state; void commands are reported and change nothing."""

    def __init__(self, policy: QueuePolicy = POLICY) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = tuple(self.row.get()) if self.row.exists() else FRESH
        out = []
        # one key's share of one micro-batch, bounded by the trigger size
        for c in sorted(rows, key=lambda r: (r.us, r.seq)):
            after = step(state, c.action, c.worker, c.us, c.category, c.retry_minutes, self.policy)
            state = after or state
            values = (*key, c.us, c.action, after is not None, state[0], state[1], state[2], state[4])
            out.append(Row(**dict(zip(COLUMNS, values))))
        self.row.update(state)
        return iter(out)

    def close(self) -> None:
        pass


def queue_stream(stream: DataFrame, policy: QueuePolicy = POLICY) -> DataFrame:
    """Stream of applied commands with the state after each. Messages start out PENDING."""
    use_keyed_state(stream.sparkSession)
    return (
        commands(stream, policy)
        .groupBy("mailbox_user_id", "message_id")
        .transformWithState(
            statefulProcessor=QueueMachine(policy), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
        )
    )
