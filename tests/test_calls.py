"""Call windows and budgets against a limiter that sees one call after the other."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import queue as qu

START = datetime(2024, 3, 1, 23, 57)


def replay(calls, per_minute, per_day):
    window = day = None
    minute_count = day_count = 0
    out = {}
    for key, at in sorted(calls, key=lambda c: (c[1], c[0])):
        if window is None or at > window + timedelta(seconds=60):
            window, minute_count = at, 0
        if day != at.date():
            day, day_count = at.date(), 0
        outcome = "DAY" if day_count >= per_day else "MINUTE" if minute_count >= per_minute else "PERMITTED"
        if outcome == "PERMITTED":
            minute_count, day_count = minute_count + 1, day_count + 1
        out[key] = (window, at.date(), outcome)
    return out


def said(spark, calls, per_minute, per_day):
    df = spark.createDataFrame([(k, t, "x") for k, t in calls], "event_id bigint, ts timestamp, window string")
    rows = qu.call_outcomes(df, per_minute=per_minute, per_day=per_day).collect()
    assert len(rows) == len([t for _, t in calls if t is not None])
    return {r["call"]: (r["window_start"], r["day"], r["outcome"]) for r in rows}


@pytest.mark.parametrize("seed, pace, per_minute, per_day", [(1, 8, 3, 40), (2, 45, 1, 6)])
def test_outcomes_equal_a_sequential_limiter(spark, seed, pace, per_minute, per_day):
    rnd = random.Random(seed)
    calls, at = [], START
    for k in range(300):
        # bursts, calls of one moment, ends of windows to the second, long pauses, several midnights
        at += timedelta(seconds=rnd.choice([0, 0, 1, pace, pace, 60, 61, rnd.randrange(pace * 3), rnd.choice([30, 30_000])]))
        calls.append((k * 7 % 300, at))
    want = replay(calls, per_minute, per_day)
    assert said(spark, calls, per_minute, per_day) == want
    assert {o for _, _, o in want.values()} == {"PERMITTED", "MINUTE", "DAY"}


def test_a_window_over_midnight_hands_on_what_it_has_used(spark):
    midnight = datetime(2024, 3, 2)
    calls = [(i, midnight + timedelta(seconds=i - 10)) for i in range(20)]
    for per_minute, per_day in ((12, 100), (12, 4), (4, 100)):
        assert said(spark, calls, per_minute, per_day) == replay(calls, per_minute, per_day)


def test_windows_open_with_the_first_call_not_with_the_clock(spark):
    calls = [(i, datetime(2024, 3, 1, 9, 0, 50) + timedelta(seconds=20 * i)) for i in range(5)]
    df = spark.createDataFrame([(k, t) for k, t in calls] + [(99, None)], "event_id bigint, ts timestamp")
    rows = sorted(tuple(r) for r in qu.call_budget(df, per_minute=3).collect())
    first, second = datetime(2024, 3, 1, 9, 0, 50), datetime(2024, 3, 1, 9, 2, 10)
    assert rows == [(first, 4, 3, 0, 47, True), (second, 1, 1, 2, 46, False)]
    assert qu.call_budget(df.where("false")).count() == 0
