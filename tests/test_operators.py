"""Operators on small hand-made tables."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, feed, identity, ingest, quality, queue as qu, tasks as tk
from tidemark.operators.timeline import next_value, rank_first, running_totals
from tidemark.sources import landing

NOW = datetime(2024, 1, 20)


def test_running_totals_do_not_depend_on_the_buckets(spark):
    df = spark.range(500).selectExpr("id % 3 AS k", "id AS at", "id % 7 AS v", "xxhash64(id) AS h")
    args = dict(sums={"s": F.col("v")}, xors={"x": F.col("h")})
    plain = running_totals(df, ["k"], F.lit(0), [F.asc("at")], **args)
    cut = running_totals(df, ["k"], F.expr("at div 40"), [F.asc("at")], **args)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.select(plain.columns).collect()))
    total = 0
    for r in cut.filter("k = 1").orderBy("at").collect():
        total += r.v
        assert r.s == total


def test_next_value_does_not_depend_on_the_buckets(spark):
    df = spark.range(300).selectExpr("id % 2 AS k", "id AS at", "IF(id % 11 = 3, id, NULL) AS v")
    plain = next_value(df, ["k"], F.lit(0), ["at"], F.col("v"), "n")
    cut = next_value(df, ["k"], F.expr("at div 10"), ["at"], F.col("v"), "n")
    rows = sorted(map(tuple, plain.collect()), key=str)
    assert rows == sorted(map(tuple, cut.select(plain.columns).collect()), key=str)
    for k, at, _, n in rows:
        later = [x for x in range(at + 1, 300) if x % 2 == k and x % 11 == 3]
        assert n == (later[0] if later else None)


def test_rank_first_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 4 AS k", "id AS v")
    top = rank_first(df, ["k"], [F.desc("v")], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.count() == 8


def test_candidates_equal_brute_force(spark):
    rows = [(i, f"b{i % 2}", (i * 37) % 50) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, block string, at bigint")
    cut = dedup.recent_candidates(df, df, ["block"], ["at"], F.expr("at div 3"), 3).collect()
    got = dedup.recent_candidates(df, df, ["block"], ["at"], F.expr("at div 8"), 3).collect()
    assert sorted(got) == sorted(cut)
    expected = set()
    for i, b, at in rows:
        older = sorted([(r[2], r[0]) for r in rows if r[1] == b and r[2] < at], reverse=True)[:3]
        expected |= {(i, o[1], n + 1) for n, o in enumerate(older)}
    assert {tuple(r) for r in got} == expected


def decide(spark, scores, verdicts):
    scored = spark.createDataFrame([(1, c, i + 1, s) for i, (c, s) in enumerate(scores)], "new_id bigint, candidate_id bigint, candidate_rank int, score double")
    given = spark.createDataFrame([(1, c, o, v, "why") for c, o, v in verdicts], "new_id bigint, candidate_id bigint, outcome string, verdict string, reason string")
    fresh = spark.createDataFrame([(1,), (2,)], "id bigint")
    ruled = {r.new_id: r for r in dedup.decide_similar(fresh, scored, given).collect()}
    assert ruled[2].decision == "CREATE"  # no candidates at all
    row = ruled[1]
    return row.decision, row.matched_task_id


def test_similarity_decisions(spark):
    assert decide(spark, [(10, 0.5)], [(10, "VERDICT", "SAME")]) == ("CREATE", None)
    assert decide(spark, [(10, None)], [(10, "VERDICT", "SAME")]) == ("SEMANTIC_SAME", 10)
    assert decide(spark, [(10, 0.9)], [(10, "VERDICT", "DIFFERENT")]) == ("CREATE", None)
    assert decide(spark, [(10, 0.9)], [(10, "VERDICT", "AMBIGUOUS")]) == ("CREATE_AMBIGUOUS", 10)
    assert decide(spark, [(10, 0.9), (11, 0.9)], [(10, "UNAVAILABLE", None), (11, "VERDICT", "SAME")]) == ("SEMANTIC_SAME", 11)
    assert decide(spark, [(10, 0.9), (11, 0.9)], [(10, "MALFORMED", None), (11, "UNAVAILABLE", None)]) == ("DEFER_UNAVAILABLE", 11)
    assert decide(spark, [(10, 0.9), (11, 0.9)], [(10, "VERDICT", "AMBIGUOUS"), (11, "UNAVAILABLE", None)]) == ("DEFER_UNAVAILABLE", 11)


TASK = "id bigint, source_email_id string, source_mailbox string, normalized_sender string, task_fingerprint string, status string, created_at timestamp"


def test_exact_decisions(spark):
    t = NOW
    old = spark.createDataFrame([(1, "e1", "b", "s", "h1", "NEW", t), (2, "e2", "b", "s", "h2", "ARCHIVED", t)], TASK)
    new = [
        (10, "e1", "b", "s", "h1", "NEW", t), (11, "e9", "b", "s", "h1", "NEW", t), (12, "e3", "b", "s", "h2", "NEW", t),
        (13, "e3", "b", "s", "h2", "NEW", t), (14, "e4", "b", "s", "h2", "NEW", t), (15, "e5", None, "s", "h2", "NEW", t),
        (16, "e5", None, "s", "h2", "NEW", t), (17, "e6", "b", None, "h1", "NEW", t), (18, "e2", "b", "s", "h2", "NEW", t),
    ]
    got = dedup.resolve_exact(old, spark.createDataFrame(new, TASK)).collect()
    assert {r.id: (r.decision, r.task_id) for r in got} == {
        10: ("KNOWN", 1), 11: ("EXACT", 1), 12: ("CREATED", 12), 13: ("KNOWN", 12), 14: ("EXACT", 12),
        15: ("CREATED", 15), 16: ("KNOWN", 15), 17: ("CREATED", 17), 18: ("KNOWN", 2),
    }


QUEUE = (
    "id bigint, mailbox_user_id string, message_id string, status string, attempt_count int, defer_count int, "
    "next_attempt_at timestamp, claimed_at timestamp, claimed_by string, processed_at timestamp, first_deferred_at timestamp, "
    "failure_category string, error_message string, created_at timestamp, updated_at timestamp"
)
OUTCOME = "id bigint, action string, worker string, reported_at timestamp, kind string, http_status int, message string, retry_after string"


def outcome(spark, action, kind=None, attempts=1, defers=0, deferred=None, worker="w", minutes=5, retry_after=None):
    claimed = NOW - timedelta(minutes=minutes)
    row = (1, "b", "m", "PROCESSING", attempts, defers, None, claimed, "w", None, deferred, None, None, NOW, NOW)
    q = spark.createDataFrame([row], QUEUE)
    o = spark.createDataFrame([(1, action, worker, NOW, kind, None, "boom", retry_after)], OUTCOME)
    return qu.apply_outcomes(q, o).first()


def test_queue_outcomes(spark):
    done = outcome(spark, "complete")
    assert done.status == "COMPLETED" and done.processed_at == NOW and done.claimed_by is None
    assert outcome(spark, "release").status == "PENDING"
    assert outcome(spark, "unavailable").status == "SKIPPED"
    deferred = outcome(spark, "fail", "provider_unavailable", attempts=3, retry_after="150")
    assert (deferred.status, deferred.defer_count, deferred.attempt_count) == ("DEFERRED", 1, 3)
    assert deferred.next_attempt_at == NOW + timedelta(minutes=2) and deferred.first_deferred_at == NOW
    assert outcome(spark, "fail", "provider_unavailable", defers=100).status == "DEAD_LETTER"
    assert outcome(spark, "fail", "provider_unavailable", deferred=NOW - timedelta(minutes=2880)).status == "DEAD_LETTER"
    assert outcome(spark, "fail", "extraction_non_retryable").status == "DEAD_LETTER"
    failed = outcome(spark, "fail", "http", attempts=2)
    assert failed.status == "FAILED" and 60 <= (failed.next_attempt_at - NOW).total_seconds() <= 72
    assert outcome(spark, "fail", "http", attempts=5).status == "DEAD_LETTER"
    assert outcome(spark, "complete", worker="thief").status == "PROCESSING"
    assert outcome(spark, "complete", minutes=16).status == "PROCESSING"
    assert outcome(spark, "complete", minutes=15).status == "COMPLETED"


def test_claims_refuse_senseless_arguments(spark):
    q = spark.createDataFrame([(1, "b", "m", "PENDING", 0, 0, None, None, None, None, None, None, None, NOW, NOW)], QUEUE)
    assert qu.claim_batch(q, 0, "w", NOW).count() == 0
    assert qu.claim_batch(q, 5, " ", NOW).count() == 0
    assert qu.claim_batch(q, 5, "w", NOW).first().claimed_by == "w"
    assert qu.claim_size(20, 2, 10) == 2 and qu.claim_size(20, 0, 10) == 0


def test_registration_is_idempotent(spark):
    found = spark.createDataFrame([("b", "m1"), ("b", "m2"), ("b", "m1"), (" ", "m3"), ("b", None)], "mailbox_user_id string, message_id string")
    found = found.withColumn("mailbox_address", F.lit("b@x"))
    none = found.limit(0)
    first = qu.register(found, none, NOW)
    assert sorted(r.message_id for r in first.collect()) == ["m1", "m2"]
    assert qu.register(found, first, NOW).count() == 0


def test_employee_upsert(spark):
    people = spark.createDataFrame(
        [(1, "ann", "ann@x", "u1"), (2, "bob", "BOB@x", None), (3, "cy", "cy@old", "u3")],
        "id bigint, name string, email string, microsoft_user_id string",
    )
    users = spark.createDataFrame(
        [(1, "u1", "anna@x", None), (2, "u2", None, "bob@x"), (3, "u9", "cy@new", None), (4, "u4", "dee@x", None),
         (5, "u5", "dee@y", None), (6, "u6", "DEE@x", None), (7, " ", "e@x", None), (8, "u8", " ", None)],
        "position int, id string, mail string, upn string",
    )
    got = {r.position: r.outcome for r in identity.upsert_employees(people, users).collect()}
    assert got == {1: "UPDATED", 2: "UPDATED", 3: "SKIPPED", 4: "CREATED", 5: "SKIPPED", 6: "UPDATED", 7: "SKIPPED", 8: "SKIPPED"}


def test_employee_upsert_equals_a_replay(spark):
    rnd = random.Random(12)
    local = ["ann", "bob", "cy", "dee", "eve", "fay", "gus", "hal"]

    def mail():
        return rnd.choice([f"{rnd.choice(local)}@{rnd.choice('xyz')}", f"{rnd.choice(local).upper()}@x"])

    stored = [(i, rnd.choice(local), mail(), rnd.choice([None, f"u{i}", f"u{i}"])) for i in range(12)]
    users = [(i, rnd.choice([f"u{rnd.randrange(40)}", f"u{rnd.randrange(40)}", " "]), rnd.choice([mail(), mail(), None]), mail()) for i in range(120)]
    staff, want = [[i, ms, e.lower(), n] for i, n, e, ms in stored], {}
    for position, user, first, second in users:
        address = first or second
        if not user.strip():
            want[position] = ("SKIPPED", None)
            continue
        name = address.split("@")[0].lower()
        hit = next((s for s in staff if s[1] == user), None) or next((s for s in staff if s[2] == address.lower()), None)
        if hit:
            want[position] = ("UPDATED", hit[0])
            hit[1:] = [user, address.lower(), name]
        elif any(s[3] == name for s in staff):
            want[position] = ("SKIPPED", None)
        else:
            want[position] = ("CREATED", None)
            staff.append([None, user, address.lower(), name])
    people = spark.createDataFrame(stored, "id bigint, name string, email string, microsoft_user_id string")
    feed = spark.createDataFrame(users, "position int, id string, mail string, upn string")
    got = {r.position: (r.outcome, r.employee_id) for r in identity.upsert_employees(people, feed).collect()}
    assert got == want and {o for o, _ in want.values()} >= {"UPDATED", "SKIPPED"}
    assert identity.upsert_employees(people, feed.where("false")).count() == 0


def test_a_directory_id_that_comes_twice_updates_what_it_has_created(spark):
    people = spark.createDataFrame([], "id bigint, name string, email string, microsoft_user_id string")
    users = spark.createDataFrame([(1, "u1", "ann@x.org", None), (2, "u1", "anne@x.org", None), (3, "u2", "ann@x.org", None)], "position int, id string, mail string, upn string")
    got = {r.position: r.outcome for r in identity.upsert_employees(people, users).collect()}
    assert got == {1: "CREATED", 2: "UPDATED", 3: "CREATED"}  # the first address and name are free again


def test_export_times(spark):
    rows = spark.sql("SELECT * FROM VALUES (TIMESTAMP '2026-08-27 10:15:00'), (TIMESTAMP '2026-08-27 10:15:30.500'), (NULL) AS t(email_received_at)")
    full = rows.selectExpr("'t' title", "CAST(NULL AS STRING) description", "'' assignee", "'' assignee_email", "CAST(NULL AS DATE) due_date",
                           "'LOW' priority", "'NEW' status", "'' source_subject", "'s@x' source_sender", "email_received_at")
    out = tk.export_rows(full)
    assert len(out.columns) == 10 and out.columns[8:] == ["from_email", "email_received_at"]
    assert sorted(r.email_received_at for r in out.collect()) == ["", "2026-08-27T10:15:30.500Z", "2026-08-27T10:15Z"]


def test_export_writes_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q"')], "task string, description string")
    landing.write_export(df, str(tmp_path / "sheet"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "sheet")).first()
    assert back.task == "a" and "q" in back.description


def test_feed_selection_and_retry(spark):
    rows = [("a", "PENDING", 0, None, NOW), ("b", "PENDING", 3, NOW + timedelta(hours=1), NOW), ("c", "PUBLISHED", 1, None, NOW)]
    df = spark.createDataFrame(rows, "id string, status string, attempt_count int, next_attempt_at timestamp, created_at timestamp")
    df = df.withColumns({"claimed_at": F.lit(None).cast("timestamp"), "published_at": F.lit(None).cast("timestamp")})
    claimed = feed.due_events(df, NOW)
    assert [r.id for r in claimed.collect()] == ["a"]
    failed = feed.settle(claimed, spark.createDataFrame([("a", "down")], "id string, error string"), NOW).first()
    assert failed.status == "PENDING" and failed.next_attempt_at == NOW + timedelta(seconds=2)
    waits = df.select(feed.retry_at(F.lit(9), F.lit(NOW)).alias("t")).first()
    assert waits.t == NOW + timedelta(seconds=60)


def test_guards_stop_the_job(spark):
    people = spark.createDataFrame([("A@x",), ("a@y",), ("b@x",)], "email string")
    report = quality.shared_names(people)
    assert report.first().violations == 1
    with pytest.raises(quality.GuardViolation, match="shared_names: 1"):
        quality.require_clean(report)


def test_classifier_reads_whole_bodies(spark):
    long = "filler " * 5000
    rows = [("Hi", long + "please review", "a@x"), ("Hi", long + "please review unsubscribe", "a@x"),
            ("please  review", "", "noreply@x"), ("please", "note", "a@x"), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, b string, f string")
    got = [r[0] for r in df.select(ingest.is_actionable(F.col("s"), F.col("b"), F.col("f"))).collect()]
    assert got == [True, False, False, False, False]
    assert len(ingest.REQUEST_PHRASES) == 48 and len(ingest.MARKETING_PHRASES) == 19 and len(ingest.NOTICE_PHRASES) == 14


def test_page_arguments_are_clamped(spark):
    df = spark.range(200).selectExpr("id", "'t' title", "'d' description", "'a' assignee", "DATE '2024-01-01' due_date",
                                     "'LOW' priority", "'NEW' status", "'s' source_subject", "'f' source_sender")
    assert tk.task_page(df, page=-3, size=900, sort="due-asc").count() == 50
    info = tk.page_info(df, page=3, size=50).first()
    assert (info.total_pages, info.has_next, info.has_previous) == (4, False, True)
    assert tk.clamp(500, 1, 31) == 31


def test_trend_has_no_gaps(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 3, 23, 59),), (datetime(2024, 1, 1),), (datetime(2023, 12, 1),)], "t timestamp")
    rows = tk.daily_counts(df, F.col("t"), date(2024, 1, 4), 4).orderBy("day").collect()
    assert [(r.day.day, r.n) for r in rows] == [(1, 1), (2, 0), (3, 1), (4, 0)]


def test_exact_decisions_equal_replay(spark):
    import random
    from datetime import datetime, timedelta

    rng = random.Random(12)
    schema = (
        "id bigint, source_email_id string, task_fingerprint string, source_mailbox string, normalized_sender string, "
        "created_at timestamp, status string"
    )
    rows = []
    for i in range(220):
        at = datetime(2026, 1, 1) + timedelta(minutes=rng.randrange(150))
        rows.append((i, rng.choice([None, *[f"m{k}" for k in range(12)]]), f"h{rng.randrange(4)}", rng.choice(["a", "b", None]), rng.choice(["s", "t", None]), at, rng.choice(["NEW", "NEW", "ARCHIVED"])))
    old, fresh = rows[:40], rows[40:]
    got = dedup.resolve_exact(spark.createDataFrame(old, schema), spark.createDataFrame(fresh, schema)).collect()

    stored, want = list(sorted(old, key=lambda r: (r[5], r[0]))), {}
    for r in sorted(fresh, key=lambda r: (r[5], r[0])):
        known = [s for s in stored if r[1] is not None and s[1] == r[1] and s[2] == r[2]]
        same = [s for s in stored if None not in (r[3], r[4]) and s[2:5] == r[2:5] and s[6] != "ARCHIVED"]
        if known:
            want[r[0]] = ("KNOWN", known[0][0])
        elif same:
            want[r[0]] = ("EXACT", same[0][0])
        else:
            want[r[0]] = ("CREATED", r[0])
            stored.append((*r[:6], "NEW"))
    assert {r.id: (r.decision, r.task_id) for r in got} == want
