"""Registered queries: tasks, search, pages, dashboards, duplicates, identities, commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, feed, identity, mutations, paging, quality, search_index, tasks as tk
from ..session import cut_lineage, scratch_path
from ..sources import landing
from ..sources import tables as tb
from .registry import Registry
from .views_sql import fingerprint

registry = Registry()
DAY = tb.TASKS_AS_OF.date()
AS_OF = tb.TASKS_AS_OF

OPEN = "status NOT IN ('COMPLETED', 'ARCHIVED')"
TODAY = "DATE '2000-06-15'"
NOW = "TIMESTAMP '2000-06-15 12:00:00'"


def _columns(names) -> str:
    """Column list for the oracle; dates are compared as ISO text."""
    return ", ".join("CAST(due_date AS VARCHAR) AS due_date" if n == "due_date" else n for n in names)


LIST, FULL, CARD = _columns(tk.LIST_COLUMNS), _columns(tk.FULL_COLUMNS), _columns(tk.CARD_COLUMNS)
LATE = f"(due_date < {TODAY} AND {OPEN})"
URGENT = f"({OPEN} AND priority IN ('HIGH', 'CRITICAL'))"
WORDS = r"""lower(' ' || regexp_replace(coalesce(title, '') || ' ' || coalesce(assignee, '') || ' ' ||
  coalesce(description, '') || ' ' || coalesce(source_subject, ''), '[^\p{L}\p{N}]+', ' ', 'g') || ' ')"""
STAMP = "coalesce(email_received_at, created_at)"


@registry.add(f"SELECT {FULL} FROM tasks")
def all_tasks(spark, d):
    return tb.tasks(spark, d).select(*tk.FULL_COLUMNS)


@registry.add(f"SELECT {FULL} FROM tasks WHERE id = 77")
def task_by_id(spark, d):
    return tb.tasks(spark, d).filter("id = 77").select(*tk.FULL_COLUMNS)


@registry.add(f"SELECT {LIST} FROM tasks WHERE source_email_id = 'msg-33'")
def tasks_by_source_message(spark, d):
    return tb.tasks(spark, d).filter("source_email_id = 'msg-33'").select(*tk.LIST_COLUMNS)


@registry.add(
    f"""SELECT {FULL} FROM tasks WHERE status = 'IN_PROGRESS' AND priority = 'MEDIUM' AND source_type = 'EXTERNAL'
        AND lower(source_domain) = 'building.example' AND lower(assignee_email) LIKE '%@org.example'"""
)
def filtered_tasks(spark, d):
    rows = tk.filter_tasks(
        tb.tasks(spark, d),
        status="IN_PROGRESS",
        priority="MEDIUM",
        source_type="EXTERNAL",
        source_domain=" Building.Example ",
        assignee_email="  ",
    )
    return rows.filter("lower(assignee_email) LIKE '%@org.example'").select(*tk.FULL_COLUMNS)


@registry.add(f"SELECT {LIST} FROM tasks WHERE lower(assignee_email) = 'user7@old.example'")
def tasks_of_assignee(spark, d):
    return tk.filter_tasks(tb.tasks(spark, d), assignee_email=" USER7@old.Example ").select(*tk.LIST_COLUMNS)


_SEARCH = f"SELECT {LIST} FROM tasks WHERE contains({WORDS}, ' aud') AND contains({WORDS}, ' prior') AND contains({WORDS}, ' user1')"


@registry.add(_SEARCH)
def task_search(spark, d):
    return tk.filter_tasks(tb.tasks(spark, d), search="AUD, prior: user1 x!").select(*tk.LIST_COLUMNS)


@registry.add(_SEARCH)
def task_search_indexed(spark, d):
    """The index of an earlier state of the tasks, brought up to date by their changes; the same rows as the scan's."""
    now, path = tb.tasks(spark, d), scratch_path(spark, "index")
    old = F.when(F.col("id") % 20 == 0, F.lit("Audit of priorities, user1")).otherwise(F.col("title"))
    search_index.store(now.select("id", *tk.SEARCHED).withColumn("title", old), path)
    changed = now.filter("id % 20 = 0").select("id", *tk.SEARCHED, F.lit(False).alias("deleted"))
    search_index.update(changed, path, 1)
    return search_index.search(now, path, "AUD, prior: user1 x!").select(*tk.LIST_COLUMNS)


@registry.add(f"SELECT {LIST} FROM tasks WHERE false")
def task_search_without_token(spark, d):
    return tk.filter_tasks(tb.tasks(spark, d), search=" a - b ").select(*tk.LIST_COLUMNS)


@registry.add(f"SELECT {FULL} FROM tasks WHERE {LATE}")
def overdue_tasks(spark, d):
    return tk.filter_tasks(tb.tasks(spark, d), attention="overdue", as_of=DAY).select(*tk.FULL_COLUMNS)


@registry.add(f"SELECT {LIST} FROM tasks WHERE {URGENT}")
def urgent_tasks(spark, d):
    return tk.filter_tasks(tb.tasks(spark, d), attention="priority").select(*tk.LIST_COLUMNS)


@registry.add(f"SELECT {LIST} FROM tasks WHERE status = 'BLOCKED'")
def tasks_by_status(spark, d):
    return tk.filter_tasks(tb.tasks(spark, d), status="BLOCKED").select(*tk.LIST_COLUMNS)


@registry.add(f"SELECT {LIST} FROM tasks WHERE {OPEN} AND due_date >= {TODAY}")
def upcoming_tasks(spark, d):
    return tb.tasks(spark, d).filter(tk.is_upcoming(DAY)).select(*tk.LIST_COLUMNS)


PAGE_ORDERS = {
    "due-asc": "due_date ASC NULLS LAST, id",
    "due-desc": "due_date DESC NULLS FIRST, id DESC",
    "received-asc": f"{STAMP}, id",
    "received-desc": f"{STAMP} DESC, id DESC",
    "priority": "CASE priority WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END DESC, id DESC",
    "recent": "updated_at DESC, id DESC",
    "anything else": f"{STAMP} DESC, id DESC",
}


def _page_query(sort: str):
    def query(spark, d):
        return tk.task_page(tb.tasks(spark, d), page=2, size=500, sort=sort, status="IN_PROGRESS")

    query.__name__ = "task_page_" + sort.replace("-", "_").replace(" ", "_")
    return query


for _sort, _order in PAGE_ORDERS.items():
    registry.add(f"SELECT {LIST} FROM tasks WHERE status = 'IN_PROGRESS' ORDER BY {_order} LIMIT 50 OFFSET 100")(
        _page_query(_sort)
    )


def _late_query(sort: str):
    def query(spark, d):
        """Page 150 of fifty rows, from the ranges of the stored list that hold it."""
        rows, path = tb.tasks(spark, d), scratch_path(spark, "pages")
        paging.store_ranges(rows, path, sort, 2000)
        return paging.stored_page(spark, path, rows.schema, 150, 50, sort)

    query.__name__ = "late_page_" + sort.replace("-", "_")
    return query


for _sort in ("received-desc", "due-asc"):
    registry.add(f"SELECT {LIST} FROM tasks ORDER BY {PAGE_ORDERS[_sort]} LIMIT 50 OFFSET 7500")(_late_query(_sort))


@registry.add(
    """SELECT CAST(3 AS INTEGER) AS page, CAST(50 AS INTEGER) AS size, n AS total_elements,
         CAST(ceil(n / 50.0) AS BIGINT) AS total_pages, ceil(n / 50.0) > 4 AS has_next, true AS has_previous
       FROM (SELECT count(*) AS n FROM tasks WHERE priority = 'HIGH')"""
)
def task_page_info(spark, d):
    return tk.page_info(tb.tasks(spark, d), page=3, size=99, priority="HIGH")


@registry.add("SELECT count(DISTINCT coalesce(source_email_id, CAST(id AS VARCHAR))) AS sources FROM tasks")
def distinct_sources(spark, d):
    return tk.distinct_sources(tb.tasks(spark, d))


@registry.add("SELECT count(DISTINCT coalesce(source_email_id, CAST(id AS VARCHAR))) AS sources FROM tasks WHERE status = 'NEW'")
def distinct_sources_of_new(spark, d):
    return tk.distinct_sources(tk.filter_tasks(tb.tasks(spark, d), status="NEW"))


@registry.add(
    f"""SELECT {LIST} FROM (SELECT *, row_number() OVER (
          PARTITION BY coalesce(source_email_id, 'task:' || id) ORDER BY id) AS rn FROM tasks) WHERE rn = 1"""
)
def unique_task_sources(spark, d):
    return tk.unique_sources(tb.tasks(spark, d)).select(*tk.LIST_COLUMNS)


@registry.add("SELECT coalesce(assignee, 'Unassigned') AS name, count(*) AS total FROM tasks GROUP BY assignee ORDER BY total DESC, name LIMIT 5")
def top_assignees(spark, d):
    return tk.counts_by_assignee(tb.tasks(spark, d))


@registry.add("SELECT coalesce(nullif(assignee, ''), 'Unassigned') AS name, count(*) AS total FROM tasks GROUP BY 1")
def assignee_counts_merged(spark, d):
    return tk.counts_by_assignee(tb.tasks(spark, d), top=None, merge_empty=True)


def _workload_sql(name: str) -> str:
    return f"""SELECT {name} AS name, count(*) FILTER (WHERE {OPEN}) AS open_count,
      count(*) FILTER (WHERE {LATE}) AS overdue_count, count(*) FILTER (WHERE {URGENT}) AS high_priority_count,
      count(*) AS total_count FROM tasks"""


@registry.add(_workload_sql("coalesce(assignee, 'Unassigned')") + " GROUP BY assignee")
def workload(spark, d):
    return tk.workload(tb.tasks(spark, d), DAY)


@registry.add(_workload_sql("coalesce(nullif(assignee, ''), 'Unassigned')") + " GROUP BY 1")
def workload_merged(spark, d):
    return tk.workload(tb.tasks(spark, d), DAY, merge_empty=True)


def _trend_sql(first: str, where: str = "true") -> str:
    return f"""SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS task_count FROM
      (SELECT CAST(unnest(generate_series({first}, {TODAY}, INTERVAL 1 DAY)) AS DATE) AS day)
      LEFT JOIN (SELECT CAST({STAMP} AS DATE) AS day, count(*) AS n FROM tasks WHERE {where} GROUP BY 1) USING (day)"""


@registry.add(_trend_sql("DATE '2000-06-09'"))
def task_trend(spark, d):
    return tk.task_trend(tb.tasks(spark, d), DAY, 7)


@registry.add(_trend_sql("DATE '2000-05-16'", "status = 'COMPLETED'"))
def task_trend_of_completed(spark, d):
    return tk.task_trend(tk.filter_tasks(tb.tasks(spark, d), status="COMPLETED"), DAY, 400)


@registry.add(
    f"""SELECT CAST(day AS VARCHAR) AS day, coalesce(a.n, 0) AS received, coalesce(b.n, 0) AS unique_tasks FROM
      (SELECT CAST(unnest(generate_series(DATE '2000-06-02', {TODAY}, INTERVAL 1 DAY)) AS DATE) AS day)
      LEFT JOIN (SELECT CAST(email_received_at AS DATE) AS day, count(*) AS n FROM tasks GROUP BY 1) a USING (day)
      LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM (SELECT *, row_number() OVER (
          PARTITION BY coalesce(source_email_id, 'task:' || id) ORDER BY id) AS rn FROM tasks) WHERE rn = 1 GROUP BY 1) b
      USING (day)"""
)
def aligned_daily_series(spark, d):
    rows = tb.tasks(spark, d)
    received = tk.daily_counts(rows, F.col("email_received_at"), DAY, 14, "received")
    unique = tk.daily_counts(tk.unique_sources(rows), F.col("created_at"), DAY, 14, "unique_tasks")
    return tk.aligned_series(received, unique)


_SUMMARY = f"""SELECT count(*) AS total_tasks, count(*) FILTER (WHERE status = 'NEW') AS new_tasks,
  count(*) FILTER (WHERE status = 'IN_PROGRESS') AS in_progress, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
  count(*) FILTER (WHERE status = 'BLOCKED') AS blocked, count(*) FILTER (WHERE {LATE}) AS overdue,
  count(*) FILTER (WHERE priority = 'HIGH') AS high_priority FROM tasks"""


@registry.add(_SUMMARY)
def task_summary(spark, d):
    return tk.summary(tb.tasks(spark, d), DAY)


@registry.add(f"SELECT status, value FROM ({_SUMMARY} WHERE priority = 'LOW') UNPIVOT (value FOR s IN (new_tasks, in_progress, completed, blocked)) JOIN (VALUES ('new_tasks', 'NEW'), ('in_progress', 'IN_PROGRESS'), ('completed', 'COMPLETED'), ('blocked', 'BLOCKED')) v(s, status) USING (s) WHERE value > 0")
def status_slices(spark, d):
    return tk.status_slices(tk.summary(tk.filter_tasks(tb.tasks(spark, d), priority="LOW"), DAY))


@registry.add(
    f"""SELECT 'status' AS kind, status AS value, count(*) AS n FROM tasks GROUP BY 2
        UNION ALL SELECT 'priority', priority, count(*) FROM tasks GROUP BY 2
        UNION ALL SELECT 'past_due', CAST(coalesce(due_date < {TODAY} AND status <> 'COMPLETED', false) AS VARCHAR), count(*)
        FROM tasks GROUP BY 2"""
)
def simple_counts(spark, d):
    return tk.simple_counts(tb.tasks(spark, d), DAY)


_ATTENTION = f"""SELECT {CARD}, min(reason) AS reason FROM (
    (SELECT {CARD}, 'overdue' AS reason FROM tasks WHERE {LATE} ORDER BY due_date, id LIMIT 6)
    UNION ALL
    (SELECT {CARD}, 'priority' FROM tasks WHERE {URGENT} ORDER BY due_date NULLS LAST, id LIMIT 6))
  GROUP BY ALL ORDER BY min(reason), due_date NULLS LAST, id LIMIT 6"""


@registry.add(_ATTENTION)
def attention_queue(spark, d):
    return tk.attention_queue(tb.tasks(spark, d), DAY)


@registry.add(
    f"""SELECT {CARD}, reason, (SELECT count(*) FROM tasks WHERE {LATE}) AS overdue_count,
          (SELECT count(*) FROM tasks WHERE {URGENT} AND NOT coalesce({LATE}, false)) AS high_priority_count
        FROM (SELECT *, CASE WHEN {LATE} THEN 'overdue' WHEN {URGENT} THEN 'priority' END AS reason FROM tasks)
        WHERE reason IS NOT NULL ORDER BY reason, due_date NULLS LAST, id LIMIT 6"""
)
def attention_split(spark, d):
    return tk.attention_split(tb.tasks(spark, d), DAY)


@registry.add(f"SELECT {CARD}, CAST(NULL AS VARCHAR) AS reason FROM tasks WHERE {OPEN} AND due_date >= {TODAY} ORDER BY due_date, id LIMIT 5")
def upcoming_deadlines(spark, d):
    return tk.upcoming_deadlines(tb.tasks(spark, d), DAY)


@registry.add(f"SELECT {CARD}, CAST(NULL AS VARCHAR) AS reason FROM tasks ORDER BY updated_at DESC NULLS LAST, id DESC LIMIT 6")
def recent_activity(spark, d):
    return tk.recent_activity(tb.tasks(spark, d))


@registry.add(
    """SELECT DISTINCT 'assignee' AS kind, assignee AS value, assignee_email AS email FROM tasks
         WHERE assignee IS NOT NULL AND trim(assignee_email) <> ''
       UNION ALL SELECT DISTINCT 'source_domain', source_domain, NULL FROM tasks WHERE source_domain IS NOT NULL
       UNION ALL SELECT DISTINCT 'source_type', source_type, NULL FROM tasks WHERE source_type IS NOT NULL"""
)
def filter_options(spark, d):
    return tk.filter_options(tb.tasks(spark, d))


@registry.add(
    """SELECT lower(trim(assignee_email)) AS email, min(assignee) AS assignee FROM tasks
       WHERE assignee IS NOT NULL AND trim(assignee_email) <> '' GROUP BY 1"""
)
def owner_options(spark, d):
    return tk.owner_options(tb.tasks(spark, d))


@registry.add(
    f"""SELECT count(DISTINCT coalesce(source_email_id, CAST(id AS VARCHAR))) AS actionable_emails,
          count(*) FILTER (WHERE {LATE}) AS overdue_count, count(*) FILTER (WHERE {URGENT}) AS high_priority_count
        FROM tasks WHERE priority = 'CRITICAL'"""
)
def dashboard_counts(spark, d):
    return tk.dashboard(tb.tasks(spark, d), DAY, priority="CRITICAL")["counts"]


def _dashboard_sql() -> str:
    """Every part's own query over the filtered tasks, its rows as JSON without null fields."""
    shown = "* REPLACE (strftime(updated_at, '%Y-%m-%dT%H:%M:%S.000Z') AS updated_at)"
    parts = {
        "counts": ("*", registry.bodies["dashboard_counts"].replace("WHERE priority = 'CRITICAL'", "")),
        "tasks_by_assignee": ("*", registry.bodies["top_assignees"]),
        "employee_workload": ("*", registry.bodies["workload"].replace("FROM tasks", "FROM every_task")),
        "attention": (shown, registry.bodies["attention_queue"]),
        "upcoming": (shown, registry.bodies["upcoming_deadlines"]),
        "recent": (shown, registry.bodies["recent_activity"]),
        "trend": ("*", registry.bodies["task_trend"].replace("2000-06-09", "2000-06-02")),
    }
    rows = [
        f"SELECT '{name}' AS part, CAST(json_merge_patch('{{}}', to_json(t)) AS VARCHAR) AS item FROM (SELECT {columns} FROM ({sql.replace('FROM tasks', 'FROM chosen')})) t"
        for name, (columns, sql) in parts.items()
    ]
    filtered = "WITH every_task AS (SELECT * FROM tasks), chosen AS (SELECT * FROM tasks WHERE priority = 'CRITICAL') "
    return filtered + " UNION ALL ".join(rows)


@registry.add(_dashboard_sql)
def dashboard(spark, d):
    return tk.dashboard_rows(tk.dashboard(tb.tasks(spark, d), DAY, priority="CRITICAL", days=14))


@registry.add(
    f"""SELECT coalesce(title, '') AS task, coalesce(description, '') AS description, coalesce(assignee, '') AS assignee,
          coalesce(assignee_email, '') AS to_email, coalesce(CAST(due_date AS VARCHAR), '') AS due_date, priority, status,
          source_subject AS subject, coalesce(source_sender, '') AS from_email,
          coalesce(strftime(email_received_at, '%Y-%m-%dT%H:%MZ'), '') AS email_received_at FROM tasks"""
)
def export_rows(spark, d):
    return tk.export_rows(tb.tasks(spark, d))


_LOG = """(SELECT l_orderkey AS task_id, l_linenumber AS seq, l_shipdate AS attempted_at,
    CASE WHEN l_returnflag <> 'A' THEN 'sheet said ' || l_returnflag END AS error FROM lineitem)"""


def _export_log(spark, d):
    return tb.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS task_id",
        "l_linenumber AS seq",
        "l_shipdate AS attempted_at",
        "CASE WHEN l_returnflag <> 'A' THEN concat('sheet said ', l_returnflag) END AS error",
    )


@registry.add(f"SELECT {LIST} FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM {_LOG} g WHERE g.task_id = t.id AND g.error IS NULL)")
def export_pending(spark, d):
    return landing.export_pending(tb.tasks(spark, d).select(*tk.LIST_COLUMNS), _export_log(spark, d))


@registry.add(
    f"""SELECT task_id, bool_or(error IS NULL) AS exported,
          CASE WHEN count(*) FILTER (WHERE error IS NULL) = 0 THEN
            (list(error ORDER BY attempted_at DESC, seq DESC, error DESC))[1] END AS export_error,
          count(*) AS attempts, max(attempted_at) AS last_attempt_at
        FROM (SELECT task_id, attempted_at, seq, max(error) AS error FROM {_LOG} GROUP BY ALL) GROUP BY 1"""
)
def export_state(spark, d):
    # one attempt per (task, time, number)
    log = _export_log(spark, d).groupBy("task_id", "attempted_at", "seq").agg(F.max("error").alias("error"))
    return landing.export_state(log)


@registry.add(f"SELECT count(*) AS attempted, count(*) FILTER (WHERE error IS NULL) AS succeeded, count(error) AS failed FROM {_LOG}")
def export_result(spark, d):
    return landing.export_result(_export_log(spark, d))


# -- duplicates ---------------------------------------------------------------------------------------------------

ACTIVE = "status <> 'ARCHIVED' AND normalized_sender IS NOT NULL"
KEYS = "source_mailbox, normalized_sender, task_fingerprint"


@registry.add(f"SELECT id, {fingerprint()} AS task_fingerprint FROM tasks")
def task_fingerprints(spark, d):
    return dedup.with_current_hash(tb.tasks(spark, d)).select("id", "task_fingerprint")


def _groups(source: str) -> str:
    return f"""SELECT {KEYS}, count(*) AS active_duplicate_count, min(created_at) AS first_seen_at,
      max(created_at) AS last_seen_at, (list(id ORDER BY created_at, id))[1] AS oldest_id
      FROM {source} WHERE {ACTIVE} GROUP BY ALL HAVING count(*) > 1"""


_REHASHED = f"(SELECT * EXCLUDE (task_fingerprint), {fingerprint()} AS task_fingerprint FROM tasks)"


@registry.add(_groups("tasks"))
def duplicate_groups(spark, d):
    return dedup.duplicate_groups(tb.tasks(spark, d))


@registry.add(_groups(_REHASHED))
def recomputed_collisions(spark, d):
    return dedup.duplicate_groups(dedup.with_current_hash(tb.tasks(spark, d)))


def _members(source: str) -> str:
    return f"""SELECT {KEYS}, id, title, status, created_at, n AS active_duplicate_count,
        CASE WHEN rn = 1 THEN 'KEEP ACTIVE (oldest)' ELSE 'WILL BE ARCHIVED' END AS action
      FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY created_at, id) AS rn,
                   count(*) OVER (PARTITION BY {KEYS}) AS n FROM {source} WHERE {ACTIVE}) WHERE n > 1"""


@registry.add(_members("tasks"))
def duplicate_members(spark, d):
    return dedup.duplicate_members(tb.tasks(spark, d))


@registry.add(_members(_REHASHED))
def recomputed_collision_members(spark, d):
    return dedup.duplicate_members(dedup.with_current_hash(tb.tasks(spark, d)))


@registry.add(
    f"""SELECT id, CASE WHEN rn > 1 THEN 'ARCHIVED' ELSE status END AS status,
          CASE WHEN rn > 1 THEN {NOW} ELSE updated_at END AS updated_at
        FROM tasks LEFT JOIN (SELECT id, row_number() OVER (PARTITION BY {KEYS} ORDER BY created_at, id) AS rn
                              FROM tasks WHERE {ACTIVE}) USING (id)"""
)
def archived_duplicates(spark, d):
    return dedup.archive_duplicates(tb.tasks(spark, d), AS_OF).select("id", "status", "updated_at")


_OLD = "created_at < TIMESTAMP '1999-01-01'"


@registry.add(
    f"""SELECT p.id AS probe_id, (SELECT min_by(e.id, (e.created_at, e.id)) FROM tasks e WHERE e.{_OLD} AND e.status <> 'ARCHIVED'
            AND e.source_mailbox = p.source_mailbox AND e.normalized_sender = p.normalized_sender
            AND e.task_fingerprint = p.task_fingerprint) AS matched_task_id
        FROM tasks p WHERE NOT p.{_OLD} AND matched_task_id IS NOT NULL"""
)
def exact_matches(spark, d):
    rows = tb.tasks(spark, d)
    probes = rows.filter(f"NOT ({_OLD})").withColumnRenamed("id", "probe_id").select("probe_id", *dedup.GROUP)
    return dedup.active_exact_matches(rows.filter(_OLD), probes)


# extracted tasks: several hashes per message, so that known, repeated and new ones all occur
def _fresh(spark, d):
    return dedup.with_current_hash(tb.tasks(spark, d).withColumn("due_date", F.trunc("due_date", "year"))).withColumn(
        "source_email_id", F.concat(F.lit("msg-"), F.expr("id div 40"))
    )


_FRESH = f"""(SELECT *, {fingerprint()} AS task_fingerprint FROM (
    SELECT * EXCLUDE (task_fingerprint) REPLACE (CAST(date_trunc('year', due_date) AS DATE) AS due_date,
      'msg-' || (id // 40) AS source_email_id) FROM tasks))"""

# the rows that stored tasks do not settle are replayed one by one, with a list of what has been created so far
_EXACT = f"""
  SELECT * FROM (WITH RECURSIVE judged AS MATERIALIZED (
    SELECT f.*, k.known_id, o.old_id, coalesce(f.source_email_id, 'row:' || f.id) || '/' || f.task_fingerprint AS m,
      CASE WHEN f.source_mailbox IS NULL OR f.normalized_sender IS NULL THEN 'row:' || f.id
           ELSE f.source_mailbox || '//' || f.normalized_sender || '//' || f.task_fingerprint END AS s
    FROM (SELECT id, source_email_id, {KEYS}, created_at FROM {_FRESH} WHERE NOT {_OLD}) f
    LEFT JOIN (SELECT source_email_id, task_fingerprint, min_by(id, (created_at, id)) AS known_id FROM {_FRESH}
               WHERE {_OLD} AND source_email_id IS NOT NULL GROUP BY ALL) k USING (source_email_id, task_fingerprint)
    LEFT JOIN (SELECT {KEYS}, min_by(id, (created_at, id)) AS old_id FROM {_FRESH} WHERE {_OLD} AND {ACTIVE}
               GROUP BY ALL) o USING ({KEYS})
  ), waiting AS MATERIALIZED (
    SELECT id, m, s, old_id, row_number() OVER (ORDER BY created_at, id) AS i FROM judged WHERE known_id IS NULL
  ), replay AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS task,
      CAST([] AS STRUCT(m VARCHAR, s VARCHAR, id BIGINT)[]) AS made
    UNION ALL
    SELECT w.i, w.id,
      CASE WHEN by_message IS NOT NULL THEN 'KNOWN' WHEN by_scope IS NOT NULL THEN 'EXACT' ELSE 'CREATED' END,
      coalesce(by_message, by_scope, w.id),
      CASE WHEN by_message IS NULL AND by_scope IS NULL THEN list_append(made, {{'m': w.m, 's': w.s, 'id': w.id}}) ELSE made END
    FROM (SELECT w.*, r.made, list_filter(r.made, lambda x: x.m = w.m)[1].id AS by_message,
            coalesce(w.old_id, list_filter(r.made, lambda x: x.s = w.s)[1].id) AS by_scope
          FROM replay r JOIN waiting w ON w.i = r.i + 1) w
  )
  SELECT id, source_email_id, {KEYS},
    CASE WHEN known_id IS NOT NULL THEN 'KNOWN' ELSE outcome END AS decision, coalesce(known_id, task) AS task_id
  FROM judged LEFT JOIN (SELECT id, outcome, task FROM replay) USING (id))"""


def _exact_decisions(spark, d):
    rows = _fresh(spark, d)
    return dedup.resolve_exact(rows.filter(_OLD), rows.filter(f"NOT ({_OLD})"))


@registry.add(_EXACT)
def exact_decisions(spark, d):
    return _exact_decisions(spark, d)


@registry.add(
    f"""SELECT 'created_twice' AS check_name, count(*) AS violations FROM (SELECT 1 FROM ({_EXACT})
        WHERE decision = 'CREATED' AND source_email_id IS NOT NULL GROUP BY source_email_id, task_fingerprint HAVING count(*) > 1)"""
)
def created_once(spark, d):
    """No message creates one task twice: the report finds nothing."""
    made = _exact_decisions(spark, d).filter("decision = 'CREATED' AND source_email_id IS NOT NULL")
    return quality.unique_checks({"created_twice": (made, ["source_email_id", "task_fingerprint"])})


@registry.add(
    f"""SELECT 'EXACT' AS match_type, task_id AS matched_task_id, CAST(NULL AS BIGINT) AS new_task_id, source_email_id,
          source_mailbox, normalized_sender, 'Exact canonical fingerprint match' AS match_reason
        FROM ({_EXACT}) WHERE decision = 'EXACT'"""
)
def exact_audit(spark, d):
    return dedup.exact_audit(_exact_decisions(spark, d))


@registry.add(
    f"""SELECT count(*) AS total_processed, count(*) FILTER (WHERE decision = 'CREATED') AS unique_created,
          count(*) FILTER (WHERE decision = 'EXACT') AS exact, CAST(0 AS BIGINT) AS semantic_same,
          CAST(0 AS BIGINT) AS semantic_ambiguous FROM ({_EXACT})"""
)
def audit_summary(spark, d):
    return dedup.audit_summary(_exact_decisions(spark, d))


BLOCK = ["source_mailbox", "normalized_sender", "assignee_key"]


def _blocked(spark, d):
    key = F.nullif(F.lower(F.trim("assignee_email")), F.lit(""))
    return tb.tasks(spark, d).withColumn("assignee_key", key)


@registry.add(
    f"""WITH b AS (SELECT *, nullif(lower(trim(assignee_email)), '') AS assignee_key FROM tasks)
        SELECT new_id, candidate_id, CAST(candidate_rank AS INTEGER) AS candidate_rank FROM (
          SELECT n.id AS new_id, c.id AS candidate_id,
            row_number() OVER (PARTITION BY n.id ORDER BY c.created_at DESC, c.id DESC) AS candidate_rank
          FROM b n JOIN b c USING (source_mailbox, normalized_sender, assignee_key)
          WHERE c.{ACTIVE.replace('normalized_sender', 'c.normalized_sender')} AND c.created_at < n.created_at)
        WHERE candidate_rank <= 3"""
)
def similarity_candidates(spark, d):
    rows = _blocked(spark, d)
    hour = F.floor(F.unix_micros(F.col("created_at")) / 3_600_000_000).cast("bigint")
    return dedup.recent_candidates(rows, dedup.scoped_active(rows), BLOCK, ["created_at"], hour)


# similarity over the embedding table: label blocks, vec_id orders, verdicts follow from the ids
def _pairs(spark, d):
    vectors = tb.table(spark, d, "embeddings").selectExpr("vec_id AS id", "label", "embedding AS vector")
    found = dedup.recent_candidates(vectors, vectors, ["label"], ["id"], F.expr("id div 64"))
    return vectors, dedup.score_candidates(found, vectors)


def _verdicts(scored):
    n = F.col("new_id") * 7 + F.col("candidate_id")
    return scored.select(
        "new_id",
        "candidate_id",
        F.when(n % 11 == 0, "UNAVAILABLE").when(n % 11 == 1, "MALFORMED").otherwise("VERDICT").alias("outcome"),
        F.when(n % 5 == 0, "SAME").when(n % 5 == 1, "AMBIGUOUS").otherwise("DIFFERENT").alias("verdict"),
        F.concat(F.lit("because "), n).alias("reason"),
    )


_COSINE = "coalesce(list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0), 0)"
_PAIRS = f"""(SELECT new_id, candidate_id, candidate_rank, {_COSINE} AS score FROM (
    SELECT n.vec_id AS new_id, c.vec_id AS candidate_id, CAST(n.embedding AS DOUBLE[]) AS a, CAST(c.embedding AS DOUBLE[]) AS b,
      CAST(row_number() OVER (PARTITION BY n.vec_id ORDER BY c.vec_id DESC) AS INTEGER) AS candidate_rank
    FROM embeddings n JOIN embeddings c ON n.label = c.label AND c.vec_id < n.vec_id) WHERE candidate_rank <= 3)"""


@registry.add(f"SELECT new_id, candidate_id, candidate_rank, round(score, 6) AS score FROM {_PAIRS}")
def similarity_scores(spark, d):
    return _pairs(spark, d)[1].withColumn("score", F.round("score", 6))


_SIMILAR = f"""
  SELECT new_id, coalesce(decision, 'CREATE') AS decision, matched_task_id, match_reason FROM
  (SELECT vec_id AS new_id FROM embeddings) LEFT JOIN (
    SELECT new_id,
      CASE WHEN same IS NOT NULL THEN 'SEMANTIC_SAME' WHEN away IS NOT NULL THEN 'DEFER_UNAVAILABLE'
           WHEN bad IS NOT NULL THEN 'DEFER_MALFORMED' WHEN unsure IS NOT NULL THEN 'CREATE_AMBIGUOUS' ELSE 'CREATE' END AS decision,
      coalesce(same, away, bad, unsure) AS matched_task_id,
      'because ' || (new_id * 7 + coalesce(same, away, bad, unsure)) AS match_reason
    FROM (SELECT new_id, min_by(candidate_id, candidate_rank) FILTER (WHERE n % 11 > 1 AND n % 5 = 0) AS same,
            min_by(candidate_id, candidate_rank) FILTER (WHERE n % 11 = 0) AS away,
            min_by(candidate_id, candidate_rank) FILTER (WHERE n % 11 = 1) AS bad,
            min_by(candidate_id, candidate_rank) FILTER (WHERE n % 11 > 1 AND n % 5 = 1) AS unsure
          FROM (SELECT *, new_id * 7 + candidate_id AS n FROM {_PAIRS} WHERE score >= 0.25) GROUP BY 1)) USING (new_id)"""


def _similar(spark, d):
    vectors, scored = _pairs(spark, d)
    return dedup.decide_similar(vectors, scored, _verdicts(scored), threshold=0.25)


@registry.add(_SIMILAR)
def similarity_decisions(spark, d):
    return _similar(spark, d)


@registry.add(
    f"""SELECT CASE decision WHEN 'CREATE_AMBIGUOUS' THEN 'SEMANTIC_AMBIGUOUS' ELSE decision END AS match_type, matched_task_id,
          CASE decision WHEN 'CREATE_AMBIGUOUS' THEN new_id END AS new_task_id, match_reason
        FROM ({_SIMILAR}) WHERE decision IN ('SEMANTIC_SAME', 'CREATE_AMBIGUOUS')"""
)
def similarity_audit(spark, d):
    return dedup.similar_audit(_similar(spark, d))


# -- identities ---------------------------------------------------------------------------------------------------

_RANKED = """(SELECT e.*, lower(split_part(email, '@', 1)) AS canonical_key, coalesce(n, 0) AS task_count,
    count(*) OVER (PARTITION BY lower(split_part(email, '@', 1))) AS size,
    row_number() OVER (PARTITION BY lower(split_part(email, '@', 1)) ORDER BY coalesce(n, 0) DESC, email) AS rn
  FROM employees e LEFT JOIN (SELECT lower(trim(assignee_email)) AS k, count(*) AS n FROM tasks GROUP BY 1) c
    ON lower(trim(email)) = k)"""
_PLAN = f"""(SELECT d.id AS duplicate_id, d.email AS duplicate_email, d.name AS duplicate_name, c.id AS canonical_id,
    c.email AS canonical_email, d.canonical_key
  FROM {_RANKED} d JOIN {_RANKED} c ON d.canonical_key = c.canonical_key AND c.rn = 1 WHERE d.rn > 1)"""


@registry.add(f"SELECT id, name, email, microsoft_user_id, task_count FROM {_RANKED}")
def employee_task_counts(spark, d):
    return identity.task_counts(tb.employees(spark, d), tb.tasks(spark, d))


@registry.add(
    f"""SELECT canonical_key, id, name, email, microsoft_user_id, task_count,
          CASE WHEN rn = 1 THEN 'KEEP' ELSE 'MERGE AWAY' END AS action FROM {_RANKED} WHERE size > 1"""
)
def duplicate_identities(spark, d):
    return identity.duplicate_identities(tb.employees(spark, d), tb.tasks(spark, d))


@registry.add(f"SELECT * FROM {_PLAN}")
def merge_plan(spark, d):
    return identity.merge_plan(tb.employees(spark, d), tb.tasks(spark, d))


@registry.add(
    f"""SELECT id, coalesce(k, name) AS name, email, microsoft_user_id FROM employees
        LEFT JOIN (SELECT DISTINCT canonical_id, canonical_key AS k FROM {_PLAN}) ON id = canonical_id
        WHERE id NOT IN (SELECT duplicate_id FROM {_PLAN})"""
)
def merged_employees(spark, d):
    people = tb.employees(spark, d)
    return identity.merge_employees(people, identity.merge_plan(people, tb.tasks(spark, d)))


@registry.add(
    f"""SELECT t.id, coalesce(e.k, n.k, assignee) AS assignee, coalesce(e.m, n.m, assignee_email) AS assignee_email FROM tasks t
        LEFT JOIN (SELECT lower(trim(duplicate_email)) AS x, arg_min(canonical_key, duplicate_id) AS k,
                     arg_min(canonical_email, duplicate_id) AS m FROM {_PLAN} GROUP BY 1) e ON lower(trim(assignee_email)) = e.x
        LEFT JOIN (SELECT lower(trim(duplicate_name)) AS x, arg_min(canonical_key, duplicate_id) AS k,
                     arg_min(canonical_email, duplicate_id) AS m FROM {_PLAN} GROUP BY 1) n
          ON assignee_email IS NULL AND lower(trim(assignee)) = n.x"""
)
def reassigned_tasks(spark, d):
    rows = tb.tasks(spark, d)
    plan = identity.merge_plan(tb.employees(spark, d), rows)
    return identity.reassign_tasks(rows, plan).select("id", "assignee", "assignee_email")


@registry.add("SELECT name, email FROM employees WHERE microsoft_user_id IS NOT NULL")
def directory_members(spark, d):
    return identity.directory_members(tb.employees(spark, d))


# -- commands -----------------------------------------------------------------------------------------------------

_COMMANDS = """(SELECT event_id AS seq, ts AS at_time, (event_id // 3) * 4 AS task_id,
    ['set_status', 'set_priority', 'set_assignee'][event_id % 3 + 1] AS action,
    CASE event_id % 3 WHEN 0 THEN ['NEW', 'IN_PROGRESS', 'COMPLETED', 'BLOCKED'][(event_id // 3) % 4 + 1]
      WHEN 1 THEN ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(event_id // 3) % 4 + 1]
      ELSE CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 5 = 1 THEN 'guest' || user_id || '@else.example'
           ELSE 'USER' || user_id || '@org.example' END END AS value FROM events)"""


def _commands(spark, d):
    return tb.table(spark, d, "events").selectExpr(
        "event_id AS seq",
        "ts AS at",
        "(event_id div 3) * 4 AS task_id",
        "element_at(array('set_status', 'set_priority', 'set_assignee'), cast(event_id % 3 + 1 AS int)) AS action",
        """CASE event_id % 3
             WHEN 0 THEN element_at(array('NEW', 'IN_PROGRESS', 'COMPLETED', 'BLOCKED'), cast((event_id div 3) % 4 + 1 AS int))
             WHEN 1 THEN element_at(array('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'), cast((event_id div 3) % 4 + 1 AS int))
             ELSE CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 5 = 1 THEN concat('guest', user_id, '@else.example')
                       ELSE concat('USER', user_id, '@org.example') END END AS value""",
    )


@registry.add(
    f"""WITH c AS (SELECT * FROM {_COMMANDS}),
        l AS (SELECT task_id, action, arg_max(value, (at_time, seq)) AS value, max(at_time) AS t FROM c GROUP BY 1, 2),
        e AS (SELECT lower(email) AS k, arg_min(name, id) AS name FROM employees GROUP BY 1)
        SELECT t.id, coalesce(s.value, status) AS status, coalesce(p.value, priority) AS priority,
          CASE WHEN a.value IS NULL THEN assignee WHEN trim(a.value) = '' THEN NULL ELSE coalesce(e.name, a.value) END AS assignee,
          CASE WHEN a.value IS NULL THEN assignee_email WHEN trim(a.value) = '' THEN NULL ELSE a.value END AS assignee_email,
          coalesce(greatest(s.t, p.t, a.t), updated_at) AS updated_at
        FROM tasks t LEFT JOIN l s ON s.task_id = t.id AND s.action = 'set_status'
          LEFT JOIN l p ON p.task_id = t.id AND p.action = 'set_priority'
          LEFT JOIN l a ON a.task_id = t.id AND a.action = 'set_assignee' LEFT JOIN e ON e.k = lower(trim(a.value))"""
)
def tasks_after_commands(spark, d):
    done = mutations.apply_commands(tb.tasks(spark, d), _commands(spark, d), tb.employees(spark, d))
    return done.select("id", "status", "priority", "assignee", "assignee_email", "updated_at")


@registry.add(
    f"""WITH c AS (SELECT * FROM {_COMMANDS}),
        l AS (SELECT task_id, action, arg_max(value, (at_time, seq)) AS value, max(at_time) AS t FROM c GROUP BY 1, 2),
        e AS (SELECT lower(email) AS k, arg_min(name, id) AS name FROM employees GROUP BY 1),
        n AS (SELECT t.id, t.created_at, t.status AS s0, t.priority AS p0, t.assignee AS a0, t.assignee_email AS m0,
            coalesce(s.value, status) AS s1, coalesce(p.value, priority) AS p1,
            CASE WHEN a.value IS NULL THEN assignee WHEN trim(a.value) = '' THEN NULL ELSE coalesce(e.name, a.value) END AS a1,
            CASE WHEN a.value IS NULL THEN assignee_email WHEN trim(a.value) = '' THEN NULL ELSE a.value END AS m1,
            coalesce(greatest(s.t, p.t, a.t), updated_at) AS updated_at
          FROM tasks t LEFT JOIN l s ON s.task_id = t.id AND s.action = 'set_status'
            LEFT JOIN l p ON p.task_id = t.id AND p.action = 'set_priority'
            LEFT JOIN l a ON a.task_id = t.id AND a.action = 'set_assignee' LEFT JOIN e ON e.k = lower(trim(a.value)))
        SELECT event_type, 'TASK' AS entity_type, CAST(id AS VARCHAR) AS entity_id,
          '{{"taskId":"' || id || '","status":"' || s1 || '","priority":"' || p1 || '","assignee":"' || coalesce(a1, '') || '"}}' AS payload,
          'PENDING' AS status, CASE WHEN event_type = 'TASK_CREATED' THEN created_at ELSE updated_at END AS created_at
        FROM (SELECT *, 'TASK_CREATED' AS event_type FROM n WHERE id % 10 = 0
          UNION ALL SELECT *, 'TASK_STATUS_CHANGED' FROM n WHERE id % 10 <> 0 AND s0 <> s1
          UNION ALL SELECT *, 'TASK_PRIORITY_CHANGED' FROM n WHERE id % 10 <> 0 AND p0 <> p1
          UNION ALL SELECT *, 'TASK_ASSIGNEE_CHANGED' FROM n WHERE id % 10 <> 0 AND (a0 IS DISTINCT FROM a1 OR m0 IS DISTINCT FROM m1))"""
)
def task_feed_events(spark, d):
    """Every tenth task is new; the others changed by their commands."""
    rows = tb.tasks(spark, d)
    after = mutations.apply_commands(rows, _commands(spark, d), tb.employees(spark, d))
    return feed.task_events(rows.filter("id % 10 <> 0"), after).drop("id", "attempt_count")


@registry.add(
    f"""SELECT id, coalesce(status, 'NEW') AS status, coalesce(priority, 'MEDIUM') AS priority, normalized_sender,
          {fingerprint()} AS task_fingerprint
        FROM (SELECT * EXCLUDE (status, priority), CASE WHEN id % 2 = 0 THEN status END AS status,
                coalesce(CASE WHEN id % 3 = 0 THEN priority END, 'MEDIUM') AS priority FROM tasks)"""
)
def created_tasks(spark, d):
    drafts = (
        tb.tasks(spark, d)
        .withColumns(
            {
                "status": F.when(F.col("id") % 2 == 0, F.col("status")),
                "priority": F.when(F.col("id") % 3 == 0, F.col("priority")),
            }
        )
        .drop("normalized_sender", "task_fingerprint", "created_at", "updated_at")
    )
    return mutations.create_tasks(drafts, AS_OF).select("id", "status", "priority", "normalized_sender", "task_fingerprint")


@registry.add(f"SELECT id, nullif(lower(trim(source_sender)), '') AS normalized_sender, {fingerprint()} AS task_fingerprint FROM tasks")
def backfilled_tasks(spark, d):
    return mutations.backfill_tasks(tb.tasks(spark, d)).select("id", "normalized_sender", "task_fingerprint")


# -- guards -------------------------------------------------------------------------------------------------------


@registry.add(
    f"""SELECT 'active_duplicates' AS check_name, count(*) AS violations FROM ({_groups('tasks')})
        UNION ALL SELECT 'recomputed_collisions', count(*) FROM ({_groups(_REHASHED)})
        UNION ALL SELECT 'shared_names', count(*) FROM (SELECT lower(split_part(email, '@', 1)) AS k FROM employees
          GROUP BY 1 HAVING count(*) > 1)"""
)
def quality_guards(spark, d):
    rows, people = tb.tasks(spark, d), tb.employees(spark, d)
    return (
        quality.active_duplicates(rows)
        .unionByName(quality.recomputed_collisions(rows))
        .unionByName(quality.shared_names(people))
    )


@registry.add(
    """SELECT 'task_message_hash' AS check_name, count(*) AS violations FROM (SELECT 1 FROM tasks
         WHERE source_email_id IS NOT NULL GROUP BY source_email_id, task_fingerprint HAVING count(*) > 1)
       UNION ALL SELECT 'employee_email', count(*) FROM (SELECT 1 FROM employees GROUP BY email HAVING count(*) > 1)
       UNION ALL SELECT 'employee_directory_id', count(*) FROM (SELECT 1 FROM employees WHERE microsoft_user_id IS NOT NULL
         GROUP BY microsoft_user_id HAVING count(*) > 1)
       UNION ALL SELECT 'queue_message', count(*) FROM (SELECT 1 FROM queue GROUP BY mailbox_user_id, message_id HAVING count(*) > 1)
       UNION ALL SELECT 'intelligence_message', count(*) FROM (SELECT 1 FROM emails GROUP BY mailbox_user_id, message_id HAVING count(*) > 1)
       UNION ALL SELECT 'sla_message', count(*) FROM (SELECT 1 FROM opened GROUP BY mailbox_user_id, message_id HAVING count(*) > 1)
       UNION ALL SELECT 'customer_domain', count(*) FROM (SELECT 1 FROM emails WHERE sender_domain IS NOT NULL GROUP BY sender_domain HAVING count(*) > 1)
       UNION ALL SELECT 'task_status', count(*) FROM tasks WHERE status NOT IN ('NEW', 'IN_PROGRESS', 'COMPLETED', 'BLOCKED')"""
)
def uniqueness_checks(spark, d):
    from ..operators import sla

    rows, people, mail = tb.tasks(spark, d), tb.employees(spark, d), tb.emails(spark, d)
    opened = sla.open_slas(mail, sla.own_domains(people, [tb.OWN_DOMAIN]))
    report = quality.unique_checks(
        {
            "task_message_hash": (rows, ["source_email_id", "task_fingerprint"]),
            "employee_email": (people, ["email"]),
            "employee_directory_id": (people, ["microsoft_user_id"]),
            "queue_message": (tb.queue(spark, d), ["mailbox_user_id", "message_id"]),
            "intelligence_message": (mail, ["mailbox_user_id", "message_id"]),
            "sla_message": (opened, ["mailbox_user_id", "message_id"]),
            "customer_domain": (mail.select("sender_domain").dropna(), ["sender_domain"]),
        }
    )
    # ARCHIVED is left out of the accepted values on purpose, so that the check has something to find
    return report.unionByName(
        quality.outside_values(rows, "status", ["NEW", "IN_PROGRESS", "COMPLETED", "BLOCKED"], "task_status")
    )


# -- the whole chain of decisions -----------------------------------------------------------------------------------

# some tasks have no vector and some a short one
_VECTOR = "CASE WHEN id % 13 = 0 THEN NULL WHEN id % 17 = 0 THEN {a}CAST(1 AS DOUBLE){b} ELSE {a}CAST(id % 7 AS DOUBLE), CAST(id % 5 AS DOUBLE), CAST(id % 3 - 1 AS DOUBLE){b} END"
# one by one: each step sees the stored tasks (joined before) and the list of what the steps before have created
_TASK_DECISIONS = f"""
  SELECT * FROM (WITH RECURSIVE f AS MATERIALIZED (
    SELECT *, {_VECTOR.format(a='[', b=']')} AS v, coalesce(source_email_id, 'row:' || id) || '/' || task_fingerprint AS m,
      CASE WHEN source_mailbox IS NULL OR normalized_sender IS NULL THEN 'row:' || id
           ELSE source_mailbox || '//' || normalized_sender || '//' || task_fingerprint END AS s,
      source_mailbox || '//' || normalized_sender || '//' || nullif(lower(trim(assignee_email)), '') AS b
    FROM {_FRESH}
  ), known AS (SELECT m, min_by(id, (created_at, id)) AS known_id FROM f WHERE {_OLD} AND source_email_id IS NOT NULL GROUP BY 1),
  held AS (SELECT s, min_by(id, (created_at, id)) AS old_id FROM f WHERE {_OLD} AND {ACTIVE} GROUP BY 1),
  latest AS (
    SELECT id, list({{'t': t, 'old': 1, 'id': c, 'v': v}}) AS stored FROM (
      SELECT n.id, c.created_at AS t, c.id AS c, c.v, row_number() OVER (PARTITION BY n.id ORDER BY c.created_at DESC, c.id DESC) AS r
      FROM f n JOIN f c USING (b) WHERE NOT n.{_OLD} AND c.{_OLD} AND c.status <> 'ARCHIVED' AND c.created_at < n.created_at)
    WHERE r <= 3 GROUP BY 1
  ), waiting AS MATERIALIZED (
    SELECT f.id, created_at, m, s, b, v, known_id, old_id, coalesce(stored, []) AS stored, row_number() OVER (ORDER BY created_at, f.id) AS i
    FROM f LEFT JOIN known USING (m) LEFT JOIN held USING (s) LEFT JOIN latest ON latest.id = f.id WHERE NOT {_OLD}
  ), replay AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS BIGINT) AS task_id,
      CAST(NULL AS VARCHAR) AS match_reason,
      CAST([] AS STRUCT(m VARCHAR, s VARCHAR, b VARCHAR, c STRUCT(t TIMESTAMP, "old" INTEGER, id BIGINT, v DOUBLE[]))[]) AS made
    UNION ALL
    SELECT i, id, decision, CASE WHEN decision = 'KNOWN' THEN by_message WHEN decision = 'EXACT' THEN by_scope
        WHEN decision IN ('CREATED', 'CREATE_AMBIGUOUS') THEN id ELSE other END,
      CASE WHEN decision NOT IN ('KNOWN', 'EXACT', 'CREATED') THEN 'because ' || (id * 7 + other) END,
      CASE WHEN decision IN ('CREATED', 'CREATE_AMBIGUOUS')
        THEN list_append(made, {{'m': m, 's': s, 'b': b, 'c': {{'t': created_at, 'old': 0, 'id': id, 'v': v}}}}) ELSE made END
    FROM (SELECT *, CASE WHEN by_message IS NOT NULL THEN 'KNOWN' WHEN by_scope IS NOT NULL THEN 'EXACT' WHEN same IS NOT NULL THEN 'SEMANTIC_SAME'
          WHEN away IS NOT NULL THEN 'DEFER_UNAVAILABLE' WHEN bad IS NOT NULL THEN 'DEFER_MALFORMED' WHEN unsure IS NOT NULL THEN 'CREATE_AMBIGUOUS'
          ELSE 'CREATED' END AS decision, coalesce(same, away, bad, unsure) AS other
      FROM (SELECT *, list_filter(needed, lambda x: x.n % 11 > 1 AND x.n % 5 = 0)[1].c AS same, list_filter(needed, lambda x: x.n % 11 = 0)[1].c AS away,
              list_filter(needed, lambda x: x.n % 11 = 1)[1].c AS bad, list_filter(needed, lambda x: x.n % 11 > 1 AND x.n % 5 = 1)[1].c AS unsure
        FROM (SELECT *, list_filter(list_transform(near, lambda x: {{'c': x.id, 'n': id * 7 + x.id,
                  'score': CASE WHEN len(v) = len(x.v) THEN {_COSINE.replace('list_dot_product(a, a)', 'list_dot_product(v, v)').replace('list_dot_product(b, b)', 'list_dot_product(x.v, x.v)').replace('list_dot_product(a, b)', 'list_dot_product(v, x.v)')} END}}),
                  lambda x: x.score IS NULL OR x.score >= 0.75) AS needed
          FROM (SELECT w.*, r.made, coalesce(w.known_id, list_filter(r.made, lambda x: x.m = w.m)[1].c.id) AS by_message,
                  coalesce(w.old_id, list_filter(r.made, lambda x: x.s = w.s)[1].c.id) AS by_scope,
                  list_sort(list_concat(w.stored, list_transform(list_filter(r.made, lambda x: x.b = w.b)[-3:], lambda x: x.c)), 'DESC')[:3] AS near
                FROM replay r JOIN waiting w ON w.i = r.i + 1))))
  )
  SELECT id, decision, task_id, match_reason FROM replay WHERE i > 0)"""


def _task_decisions(spark, d):
    rows = _fresh(spark, d).withColumn("assignee_key", F.nullif(F.lower(F.trim("assignee_email")), F.lit("")))
    # the tasks are joined together once, not for every table and round that reads them
    rows = cut_lineage(rows.select("id", "source_email_id", *dedup.GROUP, "assignee_key", "status", "created_at"))
    vectors = rows.select("id", F.expr(_VECTOR.format(a="array(", b=")")).alias("vector"))
    old, new = rows.filter(_OLD), rows.filter(f"NOT ({_OLD})")
    hour = F.floor(F.unix_micros(F.col("created_at")) / 3_600_000_000).cast("bigint")
    # the verifier is asked for the pairs that come up
    return dedup.decide_tasks(old, new, vectors, _verdicts, BLOCK, hour)


@registry.add(f"SELECT * FROM ({_TASK_DECISIONS})")
def task_decisions(spark, d):
    return _task_decisions(spark, d)


@registry.add(
    f"""SELECT count(*) AS total_processed, count(*) FILTER (WHERE decision IN ('CREATED', 'CREATE_AMBIGUOUS')) AS unique_created,
          count(*) FILTER (WHERE decision = 'EXACT') AS exact, count(*) FILTER (WHERE decision = 'SEMANTIC_SAME') AS semantic_same,
          count(*) FILTER (WHERE decision = 'CREATE_AMBIGUOUS') AS semantic_ambiguous FROM ({_TASK_DECISIONS})"""
)
def task_decision_summary(spark, d):
    return dedup.audit_summary(_task_decisions(spark, d))
