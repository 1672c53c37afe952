"""Streams with timers: breaches as the clock passes deadlines, and the outbox's retries, recoveries and retention."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import deadlines, outbox, runner
from test_replies import SENT, mailboxes

SLAS = "sla_id string, mailbox_user_id string, message_id string, conversation_id string, customer_email string, received_at timestamp, sla_deadline_at timestamp"


def run(spark, tmp_path, deliveries, schema, track, name="out"):
    folder, target = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}"
    for d in deliveries:
        d.coalesce(1).write.mode("append").parquet(folder)
    stream = track(runner.table_stream(spark, folder, schema, 1))
    runner.run_available(stream.writeStream.foreachBatch(runner.batch_folder_sink(target)), f"{tmp_path}/{name}-checkpoint")
    return runner.read_batches(spark, target)


def test_breaches_add_up_to_the_states_in_any_order(spark, tmp_path):
    slas, replies = mailboxes(31, 4, 2, 160)
    opened = spark.createDataFrame([(*s[:5], s[5], s[5] + timedelta(minutes=40)) for s in slas], SLAS)
    events = deadlines.conversation_events(opened, spark.createDataFrame(replies, SENT))
    as_of = max(s[5] for s in slas) + timedelta(minutes=10)
    # four deliveries that follow neither time nor conversation; what happened long ago becomes known late
    part = F.pmod(F.xxhash64("moment", "address"), F.lit(4))
    known = events.withColumn("known_at", F.timestamp_add("HOUR", (part - 3).cast("int"), F.lit(as_of)))
    parts = [known.filter(part == i) for i in range(4)] + [deadlines.tick(known, as_of + deadlines.ARRIVAL)]
    rows = run(spark, tmp_path, parts, known.schema, deadlines.track_breaches).cache()
    got = {r.sla_id: (r.status, r.first_response_at) for r in deadlines.states(rows).collect()}
    want = {}
    for s in slas:
        if s[3] is None or not s[3].strip():
            continue
        answers = [r[3] for r in replies if r[2] == s[3] and r[1] == s[1] and r[3] > s[5] and s[4].lower() in {a.strip().lower() for a in r[4] if a}]
        first, due = min(answers, default=None), s[5] + timedelta(minutes=40)
        late = first > due if first else due < as_of
        want[s[0]] = ("BREACHED" if late else "COMPLETED" if first else "WAITING", first)
    assert {k: v for k, v in got.items() if k in want} == want
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds["BREACHED"] > kinds["CORRECTED"] > 0
    assert rows.groupBy("sla_id").agg(F.sum("breach").alias("n")).filter("n NOT IN (0, 1)").count() == 0
    on_time = rows.filter("kind = 'BREACHED' AND reply_id IS NULL")
    assert on_time.count() > 0 and on_time.filter("at_us <> deadline_us").count() == 0


def test_outbox_equals_a_replay(spark, tmp_path):
    rnd = random.Random(9)
    start = datetime(2024, 2, 1)
    events = [(f"e{i}", start + timedelta(seconds=rnd.randrange(900))) for i in range(60)]
    results, want = [], {}
    for ident, at in events:
        attempt, now, log = 1, at, []
        while True:
            kind = rnd.choice(["ok", "ok", "fail", "lost"]) if attempt < 9 else "ok"
            said = at + timedelta(seconds=rnd.randrange(4))
            log.append(("CLAIMED", attempt, now))
            if kind == "lost":
                now += timedelta(seconds=120, milliseconds=1)
                log.append(("RECOVERED", attempt, now))
            else:
                results.append((ident, attempt, None if kind == "ok" else "refused", said))
                now = max(now, said)
                log.append(("PUBLISHED" if kind == "ok" else "FAILED", attempt, now))
                if kind == "ok":
                    break
                now += timedelta(seconds=min(60, 2 * 2 ** (attempt - 1)))
            attempt += 1
        want[ident] = log
    arrived = spark.createDataFrame(events + events[::3], "id string, known_at timestamp")  # some come twice
    told = outbox.outbox_rows(arrived, spark.createDataFrame(results, "id string, attempt int, error string, known_at timestamp"))
    middle = start + timedelta(seconds=450)
    # a timer that a timer has set fires with the next batch
    clock = [spark.createDataFrame([(None, None, None, start + timedelta(hours=k))], told.schema) for k in range(1, 15)]
    late = spark.createDataFrame([(None, None, None, start + timedelta(days=9))], told.schema)
    parts = [told.filter(F.col("known_at") < F.lit(middle)), told.filter(F.col("known_at") >= F.lit(middle)), *clock, late]
    rows = run(spark, tmp_path, parts, told.schema, outbox.track_outbox).collect()
    got = {}
    for r in rows:
        moment = datetime(1970, 1, 1) + timedelta(milliseconds=r["at_ms"])
        got.setdefault(r["id"], []).append((r["kind"], r["attempt"], moment))
    assert {k: sorted(x for x in v if x[0] != "PURGED") for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    # what was published is forgotten after the retention
    assert all(sum(x[0] == "PURGED" for x in v) == 1 for v in got.values())
    assert {r["kind"] for r in rows} == {"CLAIMED", "FAILED", "RECOVERED", "PUBLISHED", "PURGED"}
