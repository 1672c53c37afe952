"""Streaming jobs: what they give must equal the batch operators, also after a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F


from tidemark.operators import queue as qu
from tidemark.sources import landing
from tidemark.streaming import deadlines, discovery, queue_state, runner
from test_replies import SENT, mailboxes

NOW = datetime(2026, 8, 27)


def page(*messages):
    items = ", ".join(
        '{"id": "%s", "receivedDateTime": "%s"%s}' % (i, t, ', "@removed": {"reason": "deleted"}' if gone else "")
        for i, t, gone in messages
    )
    return '{"user_id": "u1", "value": [%s]}' % items


def land(spark, folder, *pages):
    runner.land_texts(spark.createDataFrame([(p,) for p in pages], "page string").coalesce(1), folder)


def test_registration_resumes_and_repeats_safely(spark, tmp_path):
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("inbox", "queue", "checkpoint"))
    boundary = datetime(2026, 8, 27, 10)
    empty = spark.createDataFrame([], "mailbox_user_id string, message_id string")

    def stored():
        try:
            return runner.read_batches(spark, target)
        except Exception:
            return empty

    def run(where):
        discovery.register_stream(runner.page_stream(spark, inbox, 1), boundary, stored, target, where, NOW)
        return sorted(r.message_id for r in runner.read_batches(spark, target).collect())

    land(spark, inbox, page(("m0", "2026-08-27T09:59:00Z", False), ("m1", "2026-08-27T10:01:00Z", False)))
    land(spark, inbox, page(("m2", "2026-08-27T10:02:00Z", False), (" ", "2026-08-27T10:02:00Z", False)))
    assert run(checkpoint) == ["m1", "m2"]
    land(spark, inbox, page(("m2", "2026-08-27T10:02:00Z", False), ("m3", "2026-08-27T10:03:00Z", False), ("m1", "x", True)))
    assert run(checkpoint) == ["m1", "m2", "m3"]
    gone = landing.read_pages(spark, inbox)
    from tidemark.operators import ingest

    assert [r.message_id for r in ingest.removals(gone).collect()] == ["m1"]


def test_deadline_stream_equals_batch(spark, tmp_path):
    slas, replies = mailboxes(11, 4, 2, 120)
    opened = spark.createDataFrame(
        [(*s[:5], s[5], s[5] + timedelta(minutes=20)) for s in slas],
        "sla_id string, mailbox_user_id string, message_id string, conversation_id string, customer_email string, "
        "received_at timestamp, sla_deadline_at timestamp",
    )
    sent = spark.createDataFrame(replies, SENT)
    events = deadlines.conversation_events(opened, sent)
    source, target = str(tmp_path / "events"), str(tmp_path / "out")
    # landed in sixteen files that follow neither time nor conversation, each a batch of its own
    piece = F.pmod(F.xxhash64("moment", "address"), F.lit(16)).cast("int")
    events.repartitionById(16, piece).write.parquet(source)
    stream = runner.table_stream(spark, source, events.schema, 1)
    writer = deadlines.track_deadlines(stream).writeStream.foreachBatch(runner.batch_folder_sink(target))
    runner.run_available(writer, str(tmp_path / "checkpoint"))
    as_of = max(s[5] for s in slas) + timedelta(days=60)
    got = {r.sla_id: (r.status, r.first_response_at) for r in deadlines.settle(runner.read_batches(spark, target), as_of).collect()}

    expected = {}
    for s in slas:
        if s[3] is None:
            continue
        answers = [r for r in replies if r[2] == s[3] and r[1] == s[1] and r[3] > s[5]
                   and s[4].lower() in {a.strip().lower() for a in r[4] if a}]
        if answers:
            first = min(r[3] for r in answers)
            expected[s[0]] = ("COMPLETED" if first <= s[5] + timedelta(minutes=20) else "BREACHED", first)
    assert {k: v for k, v in got.items() if v[1] is not None} == expected
    assert set(got) == {s[0] for s in slas if s[3] is not None}  # the others have breached


COMMANDS = [
    ("claim", None), ("start", None), ("fail", "http"), ("claim", None), ("start", None), ("complete", None),
    ("requeue", None), ("remove", None), ("reap", None), ("release", None), ("unavailable", None),
    ("fail", "provider_unavailable"), ("fail", "extraction_non_retryable"),
]


def test_queue_stream_equals_replay(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for seq in range(400):
        action, kind = rng.choice(COMMANDS)
        rows.append(("b", f"m{rng.randrange(6)}", NOW + timedelta(minutes=seq), seq, action, rng.choice(["w1", "w1", "w2"]), kind, None, "boom", "90"))
    raw = spark.createDataFrame(
        rows,
        "mailbox_user_id string, message_id string, moment timestamp, seq bigint, action string, worker string, kind string, "
        "http_status int, message string, retry_after string",
    )
    source, target = str(tmp_path / "commands"), str(tmp_path / "states")
    raw.repartitionByRange(3, "moment").write.parquet(source)
    writer = queue_state.queue_stream(runner.table_stream(spark, source, raw.schema)).writeStream
    runner.run_available(writer.foreachBatch(runner.batch_folder_sink(target)), str(tmp_path / "checkpoint"))
    got = {(r.message_id, r.at_us): (r.accepted, r.status, r.attempt_count, r.defer_count) for r in runner.read_batches(spark, target).collect()}

    kinds = {"http": "TRANSIENT", "provider_unavailable": "UNAVAILABLE", "extraction_non_retryable": "NON_RETRYABLE", None: "TRANSIENT"}
    states, expected = {}, {}
    for _, message, moment, _, action, worker, kind, *_ in rows:
        us = int((moment - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        before = states.get(message, queue_state.FRESH)
        after = queue_state.step(before, action, worker, us, kinds[kind], 1, qu.POLICY)
        states[message] = after or before
        expected[(message, us)] = (after is not None, states[message][0], states[message][1], states[message][2])
    assert got == expected
    assert len({v[1] for v in got.values()}) >= 4


def test_five_deferrals_leave_attempts_alone():
    state, us = queue_state.FRESH, 0
    for _ in range(5):
        state = queue_state.step(state, "claim", "w", us, "", 20, qu.POLICY)
        state = queue_state.step(state, "fail", "w", us, "UNAVAILABLE", 20, qu.POLICY)
        us += 20 * queue_state.MINUTE_US
    assert state[:3] == ("DEFERRED", 0, 5)


@pytest.mark.parametrize("attempts, expected", [(1, "FAILED"), (5, "DEAD_LETTER")])
def test_expired_lease(attempts, expected):
    held = ("PROCESSING", attempts, 0, None, None, 0, "w")
    assert queue_state.step(held, "reap", "", 15 * queue_state.MINUTE_US, "", 0, qu.POLICY) is None
    assert queue_state.step(held, "reap", "", 15 * queue_state.MINUTE_US + 1, "", 0, qu.POLICY)[0] == expected


def test_publishing_delivers_each_event_once(spark, tmp_path):
    rows = spark.range(20).selectExpr(
        "concat('e', id % 10) AS id", "'TASK_UPDATED' AS event_type", "'TASK' AS entity_type", "'1' AS entity_id",
        "'{\"a\":\"b\"}' AS payload", "timestamp_seconds(id % 10) AS created_at",
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = runner.table_stream(spark, str(tmp_path / "feed"), rows.schema)
    discovery.publish(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    out = runner.read_batches(spark, str(tmp_path / "out"))
    assert out.count() == 10 and out.filter(F.col("payload")["a"] == "b").count() == 10


def test_sla_changes_become_events(spark, tmp_path):
    slas = spark.createDataFrame(
        [("a", "BREACHED", None, NOW, NOW), ("b", "WAITING", None, NOW, NOW)],
        "sla_id string, status string, first_response_at timestamp, sla_deadline_at timestamp, received_at timestamp",
    )
    slas.write.parquet(str(tmp_path / "slas"))
    discovery.append_changes(runner.table_stream(spark, str(tmp_path / "slas"), slas.schema), str(tmp_path / "feed"), str(tmp_path / "c"))
    got = runner.read_batches(spark, str(tmp_path / "feed"))
    assert sorted(r.event_type for r in got.collect()) == ["SLA_BREACHED", "SLA_CREATED"]
