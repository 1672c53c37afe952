"""Registered queries that run streaming jobs over data landed from the driver tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import command_log, mutations, queue as qu
from ..session import scratch_path
from ..sources import landing
from ..sources import tables as tb
from ..streaming import deadlines, discovery, outbox, queue_state, rollups, runner
from .mail_queries import _LANDED, BOUNDARY, _open
from . import mail_queries, task_queries
from .registry import Registry
from .views_sql import parse_instant

registry = Registry()
AS_OF = tb.MAIL_AS_OF


def _landed_pages(spark, d):
    folder = scratch_path(spark, "pages")
    runner.land_texts(landing.mail_pages(spark, d), folder)
    return folder


def _shuffled(rows, folder):
    """Land rows in files that follow neither time nor key: what a stream gives must not depend on where they lie."""
    pieces = F.pmod(F.xxhash64(*rows.columns), F.lit(FILES)).cast("int")
    rows.repartitionById(FILES, pieces).write.parquet(folder)


#: Files of a landed stream, each a micro-batch of its own.
FILES = 16


@registry.add(
    f"""SELECT DISTINCT mailbox_user_id, message_id, 'PENDING' AS status FROM {_LANDED}
        WHERE NOT removed AND {parse_instant('received')} > TIMESTAMP '2024-01-10'
          AND (mailbox_user_id, message_id) NOT IN (SELECT mailbox_user_id, message_id FROM queue WHERE id % 3 = 0)"""
)
def stream_registration(spark, d):
    folder, target = scratch_path(spark, "pages"), scratch_path(spark, "queue")
    pages = landing.mail_pages(spark, d)
    order = F.pmod(F.xxhash64("page"), F.lit(FILES)).cast("int")
    runner.land_texts(pages.repartitionById(FILES, order), folder)
    discovery.register_stream(
        runner.page_stream(spark, folder, 1),
        BOUNDARY,
        lambda: tb.queue(spark, d).filter("id % 3 = 0"),
        target,
        scratch_path(spark, "checkpoint"),
        AS_OF,
    )
    return runner.read_batches(spark, target).select("mailbox_user_id", "message_id", "status")


@registry.add(f"SELECT mailbox_user_id, message_id FROM {_LANDED} WHERE removed")
def stream_removals(spark, d):
    folder, target = _landed_pages(spark, d), scratch_path(spark, "removed")
    discovery.removals_stream(runner.page_stream(spark, folder, 4), target, scratch_path(spark, "checkpoint"))
    return runner.read_batches(spark, target)


@registry.add(
    f"""SELECT mailbox_user_id AS mailbox, message_id AS reply_id, {parse_instant('received')} AS sent_at
        FROM {_LANDED} WHERE NOT removed AND {parse_instant('received')} > TIMESTAMP '2024-01-03'"""
)
def stream_sent_items(spark, d):
    folder, target = _landed_pages(spark, d), scratch_path(spark, "sent")
    discovery.sent_stream(runner.page_stream(spark, folder, 4), BOUNDARY, target, scratch_path(spark, "checkpoint"))
    return runner.read_batches(spark, target).select("mailbox", "reply_id", "sent_at")


@registry.add(
    f"""SELECT sla_id, CASE WHEN first_response_at IS NULL THEN 'BREACHED' WHEN first_response_at > sla_deadline_at THEN 'BREACHED'
         ELSE 'COMPLETED' END AS status, first_response_at, response_message_id, responded_by
       FROM (SELECT s.sla_id, s.sla_deadline_at, min(r.sent_at) AS first_response_at,
               arg_min(r.reply_id, (r.sent_at, r.reply_id)) AS response_message_id, arg_min(r.mailbox, (r.sent_at, r.reply_id)) AS responded_by
             FROM sla s LEFT JOIN sent_mail r ON r.conversation_id = s.conversation_id AND r.mailbox = s.mailbox_user_id
               AND r.sent_at > s.received_at AND list_contains(r.recipients, lower(trim(s.sender_email)))
             WHERE s.conversation_id IS NOT NULL GROUP BY ALL)
       WHERE first_response_at IS NOT NULL OR sla_deadline_at < TIMESTAMP '{AS_OF}'"""
)
def stream_deadlines(spark, d):
    events = deadlines.conversation_events(_open(spark, d), tb.sent_mail(spark, d))
    folder, target = scratch_path(spark, "events"), scratch_path(spark, "deadlines")
    _shuffled(events, folder)
    stream = runner.table_stream(spark, folder, events.schema, 1)
    writer = deadlines.track_deadlines(stream).writeStream.foreachBatch(runner.batch_folder_sink(target))
    runner.run_available(writer, scratch_path(spark, "checkpoint"))
    return deadlines.settle(runner.read_batches(spark, target), AS_OF)


_ANSWERS = """(SELECT s.sla_id, s.sla_deadline_at, min(r.sent_at) AS first_response_at,
           arg_min(r.reply_id, (r.sent_at, r.reply_id)) AS response_message_id, arg_min(r.mailbox, (r.sent_at, r.reply_id)) AS responded_by
         FROM sla s LEFT JOIN sent_mail r ON r.conversation_id = s.conversation_id AND r.mailbox = s.mailbox_user_id
           AND r.sent_at > s.received_at AND list_contains(r.recipients, lower(trim(s.sender_email)))
         WHERE s.conversation_id IS NOT NULL GROUP BY ALL)"""
#: Deliveries of the stream of breaches; each becomes known a day after the one before.
DELIVERIES = 4


@registry.add(
    f"""SELECT sla_id, CASE WHEN first_response_at <= sla_deadline_at THEN 'COMPLETED' WHEN first_response_at IS NOT NULL THEN 'BREACHED'
         WHEN sla_deadline_at < TIMESTAMP '{AS_OF}' THEN 'BREACHED' ELSE 'WAITING' END AS status,
         first_response_at, response_message_id, responded_by FROM {_ANSWERS}"""
)
def stream_breaches(spark, d):
    """Breaches as events: mail and answers become known in an order of their own while the clock goes on."""
    events = deadlines.conversation_events(_open(spark, d), tb.sent_mail(spark, d))
    folder, target = scratch_path(spark, "events"), scratch_path(spark, "breaches")
    part = F.pmod(F.xxhash64(*events.columns), F.lit(DELIVERIES)).cast("int")
    known = events.withColumn("known_at", F.timestamp_add("DAY", part - DELIVERIES, F.lit(AS_OF)))
    for i in range(DELIVERIES):  # one after the other, as they would land
        known.filter(part == i).coalesce(2).write.mode("append").parquet(folder)
    deadlines.tick(known, AS_OF + deadlines.ARRIVAL).coalesce(1).write.mode("append").parquet(folder)
    stream = runner.table_stream(spark, folder, known.schema, 1)
    writer = deadlines.track_breaches(stream).writeStream.foreachBatch(runner.batch_folder_sink(target))
    runner.run_available(writer, scratch_path(spark, "checkpoint"))
    return deadlines.states(runner.read_batches(spark, target))


_MINUTE = 60_000_000
_READY = "((p.status IN ('PENDING', 'FAILED') AND p.attempts < 5) OR (p.status = 'DEFERRED' AND p.defers < 100)) AND coalesce(p.due <= c.us, true)"
_LIVE = f"p.status = 'PROCESSING' AND p.claimed >= c.us - 15 * {_MINUTE}"
_DEAD = f"(p.defers + 1 > 100 OR c.us - coalesce(p.since, c.us) >= 2880 * CAST({_MINUTE} AS BIGINT))"


#: Commands in turn: of the stream's many short logs, and of the batch job's few long ones, which never finish.
_SHORT = ("claim", "start", "fail", "claim", "start", "complete", "reap", "requeue", "release", "remove")
_LONG = ("claim", "start", "fail", "claim", "start", "release", "reap", "requeue", "claim", "fail")


# one command of every message at a time; the worker is always the same
def _replay(message, actions):
    actions = str(list(actions))
    return f"""WITH RECURSIVE command AS MATERIALIZED (
          SELECT *, row_number() OVER (PARTITION BY mailbox_user_id, message_id ORDER BY us, seq) AS i FROM (
            SELECT 'mbx' || (user_id % 10) AS mailbox_user_id, {message} AS message_id,
              epoch_us(ts) AS us, event_id AS seq,
              {actions}[(event_id // 5) % 10 + 1] AS action,
              CASE WHEN event_id % 4 = 0 THEN 'UNAVAILABLE' WHEN event_id % 9 = 1 THEN 'NON_RETRYABLE' ELSE 'TRANSIENT' END AS category
            FROM events)),
        step AS (
          SELECT mailbox_user_id, message_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS us, CAST(NULL AS VARCHAR) AS action, false AS accepted,
            'PENDING' AS status, 0 AS attempts, 0 AS defers, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS claimed
          FROM (SELECT DISTINCT mailbox_user_id, message_id FROM command)
          UNION ALL
          SELECT mailbox_user_id, message_id, i, us, action, after IS NOT NULL, coalesce(after, status),
            CASE WHEN after IS NULL THEN attempts WHEN action = 'requeue' THEN 0 WHEN action = 'start' THEN attempts + 1 ELSE attempts END,
            CASE WHEN after IS NULL THEN defers WHEN action = 'requeue' THEN 0 WHEN action = 'fail' AND category = 'UNAVAILABLE' THEN defers + 1 ELSE defers END,
            CASE WHEN after IS NULL THEN since WHEN action = 'requeue' THEN NULL WHEN after = 'DEFERRED' THEN coalesce(since, us) ELSE since END,
            CASE WHEN after IS NULL OR action IN ('claim', 'start') THEN due WHEN action IN ('requeue', 'release') OR (action = 'reap' AND after = 'FAILED') THEN us
                 WHEN after = 'DEFERRED' THEN us + {_MINUTE} WHEN after = 'FAILED' THEN us + 1000000 * least(30 * CAST(pow(2, least(greatest(attempts - 1, 0), 10)) AS BIGINT), 3600) END,
            CASE WHEN after IS NULL OR action = 'start' THEN claimed WHEN action = 'claim' THEN us END
          FROM (SELECT c.*, p.status, p.attempts, p.defers, p.since, p.due, p.claimed,
                  CASE c.action
                    WHEN 'claim' THEN CASE WHEN {_READY} THEN 'PROCESSING' END
                    WHEN 'requeue' THEN CASE WHEN p.status = 'DEAD_LETTER' THEN 'PENDING' END
                    WHEN 'remove' THEN CASE WHEN p.status IN ('PENDING', 'FAILED', 'DEFERRED') THEN 'SKIPPED' END
                    WHEN 'reap' THEN CASE WHEN p.status = 'PROCESSING' AND p.claimed < c.us - 15 * {_MINUTE}
                                          THEN CASE WHEN p.attempts >= 5 THEN 'DEAD_LETTER' ELSE 'FAILED' END END
                    ELSE CASE WHEN {_LIVE} THEN CASE c.action WHEN 'start' THEN 'PROCESSING' WHEN 'release' THEN 'PENDING' WHEN 'complete' THEN 'COMPLETED'
                      ELSE CASE c.category WHEN 'NON_RETRYABLE' THEN 'DEAD_LETTER'
                        WHEN 'UNAVAILABLE' THEN CASE WHEN {_DEAD} THEN 'DEAD_LETTER' ELSE 'DEFERRED' END
                        ELSE CASE WHEN p.attempts >= 5 THEN 'DEAD_LETTER' ELSE 'FAILED' END END END END
                  END AS after
                FROM step p JOIN command c ON c.mailbox_user_id = p.mailbox_user_id AND c.message_id = p.message_id AND c.i = p.i + 1))
        SELECT mailbox_user_id, message_id, us AS at_us, action, accepted, status, CAST(attempts AS INTEGER) AS attempt_count,
          CAST(defers AS INTEGER) AS defer_count, due AS next_attempt_us FROM step WHERE i > 0"""


def _commands(spark, d, message, actions):
    return tb.table(spark, d, "events").selectExpr(
        "concat('mbx', user_id % 10) AS mailbox_user_id",
        f"{message} AS message_id",
        "ts AS moment",
        "event_id AS seq",
        f"element_at(array{actions}, cast((event_id div 5) % 10 + 1 AS int)) AS action",
        "'w1' AS worker",
        "CASE event_id % 4 WHEN 0 THEN 'provider_unavailable' WHEN 1 THEN 'http' END AS kind",
        "cast(CASE WHEN event_id % 9 = 1 THEN 404 END AS int) AS http_status",
        "'boom' AS message",
        "'90' AS retry_after",
    )


@registry.add(_replay("'m' || user_id || '-' || (event_id % 5)", _SHORT))
def stream_queue(spark, d):
    """Commands in the order of time; the oracle replays them message by message."""
    raw = _commands(spark, d, "concat('m', user_id, '-', event_id % 5)", _SHORT)
    folder, target = scratch_path(spark, "commands"), scratch_path(spark, "states")
    raw.repartitionByRange(FILES, "moment").write.parquet(folder)
    stream = runner.table_stream(spark, folder, raw.schema, 1000)
    writer = queue_state.queue_stream(stream).writeStream.foreachBatch(runner.batch_folder_sink(target))
    runner.run_available(writer, scratch_path(spark, "checkpoint"))
    return runner.read_batches(spark, target)


@registry.add(_replay("'m' || (event_id % 5)", _LONG))
def queue_log(spark, d):
    """Fifty messages hold all commands: their logs are replayed in segments."""
    return command_log.fold(_commands(spark, d, "concat('m', event_id % 5)", _LONG))[0]


@registry.add(
    """SELECT id, event_type AS type, entity_id, json_extract_string(payload, '$.step') AS step FROM feed WHERE status = 'PENDING'"""
)
def stream_publish(spark, d):
    """Every event is landed twice and every third delivery fails at first; each id is delivered once all the same."""
    rows = tb.feed(spark, d).filter("status = 'PENDING'")
    folder, target = scratch_path(spark, "feed"), scratch_path(spark, "published")
    _shuffled(rows, f"{folder}/a")
    _shuffled(rows.orderBy("id"), f"{folder}/b")
    stream = runner.table_stream(spark, f"{folder}/*", rows.schema, 4)

    def deliver(envelopes):
        return envelopes.select("id", ((F.crc32(F.col("id").cast("string")) % 3 != 0) | (F.col("attempt") > 1)).alias("ok"))

    discovery.publish(stream, target, scratch_path(spark, "checkpoint"), deliver)
    published = runner.read_batches(spark, target).filter("state = 'PUBLISHED'")
    return published.select("id", "type", "entity_id", F.col("payload")["step"].alias("step"))


# attempt k of an event fails as often as its id says; every seventh event's first claim is lost
_LOST = "n % 7 = 0"
_ATTEMPTS = f"CASE WHEN {_LOST} THEN greatest(2, n % 3 + 1) ELSE n % 3 + 1 END"
_PAUSES = f"CASE WHEN {_LOST} THEN 120001 + CASE WHEN n % 3 = 2 THEN 4000 ELSE 0 END ELSE [1000, 3000, 7000][n % 3 + 1] END"


@registry.add(
    f"""SELECT id, CAST({_ATTEMPTS} AS INTEGER) AS attempts, epoch_us(created_at) // 1000 + {_PAUSES} AS published_ms,
          CAST({_ATTEMPTS} - 1 - CASE WHEN {_LOST} THEN 1 ELSE 0 END AS BIGINT) AS failures, CAST(CASE WHEN {_LOST} THEN 1 ELSE 0 END AS BIGINT) AS recovered
        FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) // 3 AS n FROM feed WHERE status = 'PENDING')"""
)
def stream_outbox(spark, d):
    """Retries when they are due and claims that are given up, on the feed's own clock."""
    rows = tb.feed(spark, d).filter("status = 'PENDING'").select("id", F.col("created_at").alias("known_at"))
    attempts = rows.select("id", "known_at", F.expr("cast(substr(id, 2) AS bigint) div 3").alias("n"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("attempt")).filter(f"attempt > 1 OR NOT {_LOST}")
    results = attempts.select(
        "id", "attempt", F.when(F.col("attempt") <= F.col("n") % 3, "refused").alias("error"), F.timestamp_add("SECOND", F.col("attempt"), F.col("known_at")).alias("known_at")
    )
    told = outbox.outbox_rows(rows, results)
    first, last = rows.agg(F.min("known_at"), F.max("known_at")).first()
    folder, target = scratch_path(spark, "outbox"), scratch_path(spark, "delivered")
    step = (last - first) / DELIVERIES if first else None
    for i in range(DELIVERIES if first else 0):  # one delivery after the other, as time goes on
        part = told.filter((F.col("known_at") >= F.lit(first + i * step)) if i else F.lit(True))
        part = part.filter(F.col("known_at") < F.lit(first + (i + 1) * step)) if i + 1 < DELIVERIES else part
        part.coalesce(1).write.mode("append").parquet(folder)
    for day in (1, 2, 3):  # a timer that a timer has set fires with the next batch
        moment = last + timedelta(days=day) if last else None
        clock = spark.range(1 if last else 0).select(*(F.lit(moment if f.name == "known_at" else None).cast(f.dataType).alias(f.name) for f in told.schema))
        clock.coalesce(1).write.mode("append").parquet(folder)
    writer = outbox.track_outbox(runner.table_stream(spark, folder, told.schema, 1)).writeStream.foreachBatch(runner.batch_folder_sink(target))
    runner.run_available(writer, scratch_path(spark, "checkpoint"))
    done = runner.read_batches(spark, target).groupBy("id").agg(
        F.max(F.when(F.col("kind") == "PUBLISHED", F.col("attempt"))).alias("attempts"),
        F.max(F.when(F.col("kind") == "PUBLISHED", F.col("at_ms"))).alias("published_ms"),
        F.count_if(F.col("kind") == "FAILED").alias("failures"),
        F.count_if(F.col("kind") == "RECOVERED").alias("recovered"),
    )
    return done


def _kept_up_to_date(spark, before, after, dimensions, schema):
    """Counts of ``before``, then of change events in shuffled batches, compacted half way."""
    folder, target = scratch_path(spark, "changes"), scratch_path(spark, "rollup")
    events = rollups.changes(before, after, dimensions)
    rollups.start(before, target, dimensions)
    _shuffled(events, folder)
    stream = runner.table_stream(spark, folder, events.schema, 4)
    runner.run_available(stream.writeStream.foreachBatch(rollups.rollup_sink(target, dimensions)), scratch_path(spark, "checkpoint"))
    rollups.compact(spark, target, schema, 1)
    return rollups.counts(spark, target, schema)


def _task_counts(spark, d):
    rows = tb.tasks(spark, d)
    done = mutations.apply_commands(rows, task_queries._commands(spark, d), tb.employees(spark, d))
    return _kept_up_to_date(spark, rows, done, rollups.TASK_DIMENSIONS, rollups.TASK_SCHEMA)


def _after_commands(sql):
    """SQL over the tasks, over the tasks after commands instead."""
    changed = task_queries.registry.bodies["tasks_after_commands"]
    return f"""WITH done AS (SELECT c.id, c.assignee, c.status, c.priority, t.due_date FROM ({changed}) c JOIN tasks t USING (id))
        {sql.replace("FROM tasks", "FROM done")}"""


@registry.add(_after_commands(task_queries._workload_sql("coalesce(assignee, 'Unassigned')") + " GROUP BY assignee"))
def workload_kept(spark, d):
    return rollups.workload(_task_counts(spark, d), task_queries.DAY)


@registry.add(_after_commands(task_queries._SUMMARY))
def task_summary_kept(spark, d):
    return rollups.summary(_task_counts(spark, d), task_queries.DAY)


def _queue_counts(spark, d):
    rows = tb.queue(spark, d)
    done = qu.apply_outcomes(rows, tb.queue_outcomes(spark, d))
    return _kept_up_to_date(spark, rows, done, rollups.QUEUE_DIMENSIONS, rollups.QUEUE_SCHEMA)


def _after_outcomes(name):
    changed = mail_queries.registry.bodies["queue_after_outcomes"]
    return f"""WITH done AS ({changed}) {mail_queries.registry.bodies[name].replace("FROM queue", "FROM done")}"""


@registry.add(_after_outcomes("queue_stats"))
def queue_stats_kept(spark, d):
    return rollups.queue_stats(_queue_counts(spark, d))


@registry.add(_after_outcomes("queue_backlog"))
def queue_backlog_kept(spark, d):
    return rollups.queue_backlog(_queue_counts(spark, d))
