"""The command log in segments against a replay of each message."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import command_log
from tidemark.operators.queue import POLICY
from tidemark.streaming import queue_state

RAW = (
    "mailbox_user_id string, message_id string, moment timestamp, seq bigint, action string, worker string, kind string, "
    "http_status int, message string, retry_after string"
)
START = datetime(2024, 2, 1, tzinfo=timezone.utc)
ACTIONS = ["claim", "claim", "claim", "start", "start", "fail", "fail", "release", "complete", "unavailable", "requeue", "remove", "reap", "odd", None]
USUAL = ["claim", "claim", "start", "fail", "fail", "release", "requeue", "reap"]


def log_of(rnd, message, n, actions, pace):
    at, rows = START, []
    for i in range(n):
        at += timedelta(seconds=rnd.choice(pace))
        fault = rnd.choice([("provider_unavailable", None), ("http", 404), ("http", 500), (None, None)])
        worker = rnd.choice(["w1", "w1", "w1", "w2", None, ""])
        rows.append(("u", message, at, i, rnd.choice(actions), worker, *fault, "boom", rnd.choice(["90", "600", None])))
    return rows


def replay(rows, states):
    """The stream's step, command by command; ``rows`` as the up-front classification gives them."""
    out = []
    for r in sorted(rows, key=lambda r: (r.message_id, r.us, r.seq)):
        before = states.get(r.message_id, queue_state.FRESH)
        after = queue_state.step(before, r.action, r.worker, r.us, r.category, r.retry_minutes, POLICY)
        s = states[r.message_id] = after or before
        out.append(("u", r.message_id, r.us, r.action, after is not None, s[0], s[1], s[2], s[4]))
    return out


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("seed, actions, pace", [(1, ACTIONS, [5, 60, 600]), (2, USUAL, [1, 40, 1000]), (3, USUAL, [20, 3600, 90000])])
def test_equal_to_a_replay(spark, seed, actions, pace):
    rnd = random.Random(seed)
    rows = [r for m, n in (("hot", 200), ("a", 1), ("b", 8), ("c", 9), ("d", 90)) for r in log_of(rnd, m, n, actions, pace)]
    raw = spark.createDataFrame(rows, RAW)
    states = {}
    want = replay(queue_state.commands(raw).collect(), states)
    got, last = command_log.fold(raw, size=8)
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert {r.message_id: tuple(r)[2:] for r in last.collect()} == states


def test_segments_of_several_chunks(spark):
    rnd = random.Random(9)
    sizes = (("one", 64), ("two", 65), ("full", 128), ("more", 129), ("hot", 700))
    rows = [r for m, n in sizes for r in log_of(rnd, m, n, USUAL, [1, 40, 1000])]
    raw = spark.createDataFrame(rows, RAW)
    want = sorted(map(key, replay(queue_state.commands(raw).collect(), {})))
    for size in (200, command_log.SEGMENT):
        assert sorted(map(key, command_log.fold(raw, size=size)[0].collect())) == want


def test_a_log_in_two_parts(spark):
    rnd = random.Random(7)
    rows = [r for m in ("hot", "b") for r in log_of(rnd, m, 60, USUAL, [1, 40, 1000])]
    raw = spark.createDataFrame(rows, RAW)
    whole, last = command_log.fold(raw, size=8)
    early, between = command_log.fold(raw.filter("seq < 25"), size=8)
    late, end = command_log.fold(raw.filter("seq >= 25"), between, size=8)
    assert sorted(map(key, early.unionByName(late).collect())) == sorted(map(key, whole.collect()))
    assert sorted(map(key, end.collect())) == sorted(map(key, last.collect()))


def test_counters_that_pass_through_many_segments(spark):
    """Starts of the first segment show in the last one, through segments that claim and release only."""
    at = [START + timedelta(seconds=i) for i in range(40)]
    first = [("claim", 0), ("start", 1), ("start", 2), ("release", 3)]
    rest = [("claim" if i % 2 == 0 else "release", i) for i in range(4, 40)]
    rows = [("u", "m", at[i], i, a, "w", None, None, None, None) for a, i in first + rest]
    got, last = command_log.fold(spark.createDataFrame(rows, RAW), size=4)
    assert got.filter("NOT accepted").count() == 0 and last.first().attempts == 2


def test_odd_input(spark):
    none = spark.createDataFrame([], RAW)
    rows, last = command_log.fold(none)
    assert rows.count() == 0 and last.count() == 0
    twice = [("u", "m", START, 1, "claim", "w", None, None, None, None)] * 2 + [("u", "m", None, 1, "claim", "w", None, None, None, None), (None, "m", START, 1, "claim", "w", None, None, None, None)]
    rows, last = command_log.fold(spark.createDataFrame(twice, RAW).withColumn("status", F.lit("x")))
    assert sorted(r.accepted for r in rows.collect()) == [False, True]
    assert last.first().status == "PROCESSING"
