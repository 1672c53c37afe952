"""Registered queries: landed mail, deadlines, replies, queue, change feed, text jobs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..functions import markup
from ..functions import addresses as ad
from ..functions import parsing as ps
from ..functions import text as tx
from ..functions.calendar import deadline
from ..operators import feed as fd
from ..operators import identity, ingest, mutations, queue as qu, sla
from ..operators.timeline import next_value
from ..sources import landing
from ..sources import tables as tb
from .registry import Registry
from .views_sql import deadline_sql, domain_of, fingerprint, parse_instant, strip

registry = Registry()
AS_OF = tb.MAIL_AS_OF
NOW = "TIMESTAMP '2024-01-20'"
TODAY = date(2024, 1, 20)
BOUNDARY = AS_OF - timedelta(days=10)


# -- landed pages -------------------------------------------------------------------------------------------------

_LANDED = f"""(
  SELECT mailbox_user_id, message_id, subject, sender_name, CASE WHEN trim(sender_email) <> '' THEN sender_email END AS sender_email,
    sender_domain, received, conversation_id, position % 59 = 0 AS removed, position,
    CASE WHEN position % 5 = 0 THEN 'Preview ' || position ELSE '<p>' || body || '</p><b>x</b>y' END AS body,
    'Desk ' || (position % 4) || CASE WHEN position % 5 = 1 THEN ';-;x' ELSE '' END AS recipient_names,
    mailbox_user_id || '@org.example' || CASE WHEN position % 5 = 1 THEN ';cc@org.example;-' ELSE '' END AS recipient_emails
  FROM emails WHERE position % 67 <> 0)"""
_CLASS = """CASE WHEN lower(sender_domain) = 'org.example' THEN 'INTERNAL' WHEN lower(sender_domain) = 'gmail.com' THEN 'GMAIL'
  WHEN lower(sender_domain) IN ('outlook.com', 'hotmail.com', 'live.com') THEN 'MICROSOFT' ELSE 'EXTERNAL' END"""


def _pages(spark, d):
    return landing.parse_pages(landing.mail_pages(spark, d))


def _joined(column: str):
    return F.concat_ws(";", F.transform(column, lambda x: F.coalesce(x, F.lit("-"))))


@registry.add(
    f"""SELECT mailbox_user_id, message_id, subject, sender_name, sender_email, sender_domain, {_CLASS} AS source_type, received,
          conversation_id, recipient_names, recipient_emails,
          CASE WHEN position % 5 = 0 THEN body ELSE trim(regexp_replace(replace(replace(replace(replace(body, '<p>', ' '), '</p>', ' '),
            '<b>', ''), '</b>', ''), '\\s+', ' ', 'g')) END AS body
        FROM {_LANDED} WHERE NOT removed AND {parse_instant('received')} > TIMESTAMP '2024-01-10'"""
)
def mailbox_snapshot(spark, d):
    rows = ingest.snapshot(_pages(spark, d), tb.OWN_DOMAIN, BOUNDARY)
    return rows.withColumns({c: _joined(c) for c in ("recipient_names", "recipient_emails")})


@registry.add(f"SELECT mailbox_user_id, message_id, received FROM {_LANDED} WHERE NOT removed AND {parse_instant('received')} > TIMESTAMP '2024-01-10'")
def inbox_discovery(spark, d):
    return ingest.discovered(_pages(spark, d), BOUNDARY)


@registry.add(
    f"""SELECT mailbox_user_id AS mailbox, message_id AS reply_id, conversation_id, {parse_instant('received')} AS sent_at, recipient_emails AS recipients
        FROM {_LANDED} WHERE NOT removed AND {parse_instant('received')} > TIMESTAMP '2024-01-03'"""
)
def sent_items_scan(spark, d):
    return ingest.sent_items(_pages(spark, d), BOUNDARY).withColumn("recipients", _joined("recipients"))


@registry.add(
    f"""SELECT mailbox_user_id AS mailbox, message_id AS reply_id, {parse_instant('received')} AS sent_at FROM {_LANDED} WHERE NOT removed
          AND ({parse_instant('received')} > TIMESTAMP '2024-01-03' OR mailbox_user_id IN (SELECT mailbox_user_id FROM queue WHERE id % 2 = 1))"""
)
def sent_items_of_known(spark, d):
    """Mailboxes that have been walked before give their older mail as well."""
    scanned = tb.queue(spark, d).filter("id % 2 = 1").select(F.col("mailbox_user_id").alias("mailbox"))
    return ingest.sent_items(_pages(spark, d), BOUNDARY, scanned).select("mailbox", "reply_id", "sent_at")


_KNOWN = "SELECT mailbox_user_id, message_id FROM queue WHERE id % 3 = 0"


@registry.add(
    f"""SELECT DISTINCT mailbox_user_id, message_id, mailbox_user_id || '@org.example' AS mailbox_address, 'PENDING' AS status,
          CAST(0 AS INTEGER) AS attempt_count, {NOW} AS created_at, {NOW} AS next_attempt_at
        FROM {_LANDED} WHERE NOT removed AND {parse_instant('received')} > TIMESTAMP '2024-01-10'
          AND (mailbox_user_id, message_id) NOT IN ({_KNOWN})"""
)
def registered_messages(spark, d):
    found = ingest.discovered(_pages(spark, d), BOUNDARY).withColumn(
        "mailbox_address", F.concat("mailbox_user_id", F.lit("@org.example"))
    )
    return qu.register(found.unionByName(found), tb.queue(spark, d).filter("id % 3 = 0"), AS_OF)


QUEUE = """id, mailbox_user_id, message_id, status, attempt_count, defer_count, next_attempt_at, claimed_at, claimed_by,
  processed_at, first_deferred_at, failure_category, error_message, created_at, updated_at"""


@registry.add(
    f"""SELECT id, mailbox_user_id, message_id, CASE WHEN hit THEN 'SKIPPED' ELSE status END AS status,
          CASE WHEN NOT hit THEN next_attempt_at END AS next_attempt_at,
          CASE WHEN hit THEN 'Message was removed from the Inbox by Microsoft Graph.' ELSE error_message END AS error_message
        FROM (SELECT q.*, r.message_id IS NOT NULL AND status IN ('PENDING', 'FAILED', 'DEFERRED') AS hit FROM queue q
              LEFT JOIN (SELECT * FROM {_LANDED} WHERE removed) r USING (mailbox_user_id, message_id))"""
)
def removed_messages(spark, d):
    done = qu.apply_removals(tb.queue(spark, d), ingest.removals(_pages(spark, d)))
    return done.select("id", "mailbox_user_id", "message_id", "status", "next_attempt_at", "error_message")


_PERSON = """(SELECT c_custkey, 'ms-' || (c_custkey // 10) || '-' || (c_custkey % 10) AS id, c_name,
    CASE WHEN c_custkey % 4 NOT IN (1, 2) THEN 'User' || (c_custkey // 10) || '@org.example' END AS mail,
    CASE WHEN c_custkey % 8 <> 1 THEN 'p' || c_custkey || '@org.example' END AS upn
  FROM customer WHERE c_custkey % 50 <> 7)"""


@registry.add(
    f"""SELECT id, c_name AS "displayName", coalesce(mail, upn) AS email, coalesce(mail, upn, id) AS mailbox_address FROM {_PERSON}"""
)
def directory_users(spark, d):
    return ingest.directory_users(landing.parse_pages(landing.directory_pages(spark, d), landing.USER_PAGE_SCHEMA))


# user by user, with the list of employees as it stands; the ninth and tenth of a family share one directory id
@registry.add(
    f"""SELECT position, user_id, email, name, employee_id, outcome FROM (
  WITH RECURSIVE p AS MATERIALIZED (
    SELECT c_custkey, 'ms-' || (c_custkey // 10) || '-' || least(c_custkey % 10, 8) AS user_id, coalesce(mail, upn) AS email,
      lower(split_part(coalesce(mail, upn), '@', 1)) AS name, row_number() OVER (ORDER BY c_custkey) AS i FROM {_PERSON}
  ), replay AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS email,
      CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS employee_id, CAST(NULL AS VARCHAR) AS outcome,
      (SELECT list({{'k': CAST(id AS BIGINT), 'id': CAST(id AS BIGINT), 'name': lower(name), 'email': lower(email), 'ms': microsoft_user_id}} ORDER BY id) FROM employees) AS staff
    UNION ALL
    SELECT i, c_custkey, user_id, email, name, CASE WHEN outcome = 'UPDATED' THEN list_filter(staff, lambda x: x.k = hit)[1].id END, outcome,
      CASE outcome WHEN 'CREATED' THEN list_append(staff, {{'k': 10000000 + c_custkey, 'id': CAST(NULL AS BIGINT), 'name': name, 'email': lower(email), 'ms': user_id}})
        WHEN 'UPDATED' THEN list_transform(staff, lambda x: CASE WHEN x.k = hit THEN {{'k': x.k, 'id': x.id, 'name': name, 'email': lower(email), 'ms': user_id}} ELSE x END)
        ELSE staff END
    FROM (SELECT *, CASE WHEN email IS NULL THEN 'SKIPPED' WHEN hit IS NOT NULL THEN 'UPDATED' WHEN namesake IS NOT NULL THEN 'SKIPPED' ELSE 'CREATED' END AS outcome
      FROM (SELECT p.*, staff, coalesce(list_filter(staff, lambda x: x.ms = p.user_id)[1].k, list_filter(staff, lambda x: x.email = lower(p.email))[1].k) AS hit,
              list_filter(staff, lambda x: x.name = p.name)[1].k AS namesake
            FROM replay r JOIN p ON p.i = r.i + 1))
  ) SELECT * FROM replay WHERE i > 0)"""
)
def employee_upserts(spark, d):
    people = tb.table(spark, d, "customer").filter("c_custkey % 50 <> 7").selectExpr(
        "c_custkey AS position",
        "concat('ms-', c_custkey div 10, '-', least(c_custkey % 10, 8)) AS id",
        "CASE WHEN c_custkey % 4 NOT IN (1, 2) THEN concat(' User', c_custkey div 10, '@org.example') END AS mail",
        "CASE WHEN c_custkey % 8 <> 1 THEN concat('p', c_custkey, '@org.example') END AS upn",
    )
    return identity.upsert_employees(tb.employees(spark, d), people)


@registry.add(
    """SELECT mailbox, coalesce(a.name, b.name) AS assignee, coalesce(a.email, b.email) AS assignee_email
       FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ms-' || (c_custkey // 10) || '-' || (c_custkey % 4)
               WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'USER' || (c_custkey // 10) || '@Org.example' END AS mailbox FROM customer)
       LEFT JOIN employees a ON a.microsoft_user_id = mailbox
       LEFT JOIN employees b ON lower(b.email) = lower(mailbox)"""
)
def mailbox_owners(spark, d):
    boxes = tb.table(spark, d, "customer").selectExpr(
        """CASE WHEN c_custkey % 2 = 0 THEN concat('ms-', c_custkey div 10, '-', c_custkey % 4)
                WHEN c_custkey % 3 = 0 THEN ' ' ELSE concat('USER', c_custkey div 10, '@Org.example') END AS mailbox"""
    )
    return identity.resolve_by_mailbox(boxes, tb.employees(spark, d))


@registry.add(
    """SELECT c_custkey, n AS name, (SELECT arg_min(email, id) FROM employees e WHERE lower(e.name) = lower(n)) AS assignee_email
       FROM (SELECT c_custkey, 'uSER' || (c_custkey // 7) AS n FROM customer)"""
)
def emails_of_names(spark, d):
    rows = tb.table(spark, d, "customer").selectExpr("c_custkey", "concat('uSER', c_custkey div 7) AS name")
    return identity.email_of_name(rows, tb.employees(spark, d))


# -- classification and reports over mail -------------------------------------------------------------------------

_SUBJECT = """CASE doc_id % 9 WHEN 0 THEN 'Please  REVIEW the draft' WHEN 1 THEN 'Could you update this' WHEN 2 THEN 'Security alert'
  WHEN 3 THEN 'Can you fix it? Learn more' WHEN 4 THEN 'please note' WHEN 5 THEN 'Follow-up on terms of use'
  WHEN 6 THEN 'we need you to check' END"""
_SENDER = "CASE doc_id % 7 WHEN 0 THEN ' No-Reply@x.example' WHEN 1 THEN 'x.notifications@y.example' ELSE source || '@z.example' END"


def _any(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


@registry.add(
    f"""SELECT doc_id, NOT automated AND NOT {_any('c', ingest.MARKETING_PHRASES)} AND NOT {_any('c', ingest.NOTICE_PHRASES)}
          AND {_any('c', ingest.REQUEST_PHRASES)} AS actionable, automated
        FROM (SELECT doc_id, lower(trim(regexp_replace(coalesce({_SUBJECT}, ''), '\\s+', ' ', 'g'))) || ' ' ||
                lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS c, doc_id % 7 < 2 AS automated FROM documents)"""
)
def actionable_documents(spark, d):
    docs = tb.table(spark, d, "documents").select("doc_id", "text", "source")
    subject = F.expr(_SUBJECT)
    sender = F.expr(_SENDER.replace("source || '@z.example'", "concat(source, '@z.example')"))
    return docs.select(
        "doc_id",
        ingest.is_actionable(subject, F.col("text"), sender).alias("actionable"),
        ad.is_automated_sender(sender).alias("automated"),
    )


@registry.add("SELECT position, message_id FROM emails WHERE NOT (coalesce(trim(subject), '') = '' AND coalesce(trim(body), '') = '')")
def extractable_mail(spark, d):
    return ingest.worth_extracting(tb.emails(spark, d)).select("position", "message_id")


def _classed(spark, d):
    return tb.emails(spark, d).withColumn("source_type", ad.source_class(F.col("sender_domain"), tb.OWN_DOMAIN))


@registry.add(f"SELECT sender_domain, min_by(source_type, position) AS source_type, count(*) AS n FROM (SELECT *, {_CLASS} AS source_type FROM emails) GROUP BY 1")
def mail_sources(spark, d):
    return ingest.source_report(_classed(spark, d))


@registry.add(
    f"""SELECT sender_email AS contact, min_by(sender_email, position) AS email, min_by(sender_name, position) AS name,
          min_by(sender_domain, position) AS domain, count(*) AS n
        FROM (SELECT *, {_CLASS} AS source_type FROM emails) WHERE source_type <> 'INTERNAL' GROUP BY 1 ORDER BY n DESC, contact LIMIT 5"""
)
def top_contacts(spark, d):
    return ingest.top_contacts(_classed(spark, d))


@registry.add("SELECT count(*) AS total_emails, count(DISTINCT mailbox_user_id) AS connected_mailboxes FROM emails")
def mail_totals(spark, d):
    return ingest.mail_totals(tb.emails(spark, d))


@registry.add("SELECT coalesce((SELECT min(ts) FROM events), TIMESTAMP '2024-01-20') AS started_at")
def start_boundary(spark, d):
    stored = tb.table(spark, d, "events").agg(F.min("ts").alias("started_at"))
    return ingest.start_boundary(stored, AS_OF)


# -- address and text expressions over whole columns --------------------------------------------------------------


@registry.add(
    f"""SELECT position, nullif(lower({strip('sender_email')}), '') AS sender, {domain_of('sender_email')} AS domain,
          {domain_of('sender_email', 'NULL')} AS domain_or_null,
          lower({strip("CASE WHEN instr(sender_email, '@') > 1 THEN split_part(sender_email, '@', 1) ELSE sender_email END")}) AS name,
          lower(split_part(sender_email, '@', 1)) AS local_part, {_CLASS} AS source_class,
          CASE WHEN {_CLASS} IN ('INTERNAL', 'EXTERNAL') THEN {_CLASS} END AS source_type,
          {parse_instant('received')} AS received_at, coalesce({parse_instant('received')} > {NOW}, false) AS is_late
        FROM emails"""
)
def address_fields(spark, d):
    email, domain = F.col("sender_email"), F.col("sender_domain")
    kind = ad.source_class(domain, tb.OWN_DOMAIN)
    return tb.emails(spark, d).select(
        "position",
        ad.normalize_sender(email).alias("sender"),
        ad.domain_of(email).alias("domain"),
        ad.domain_of(email, missing=None).alias("domain_or_null"),
        ad.name_from_email(email).alias("name"),
        ad.local_part(email).alias("local_part"),
        kind.alias("source_class"),
        ad.parse_source_type(F.concat(F.lit(" "), F.lower(kind))).alias("source_type"),
        ps.parse_instant(F.col("received")).alias("received_at"),
        ps.is_after(F.col("received"), F.lit(AS_OF)).alias("is_late"),
    )


_BLOCKS = "|".join(tx.BLOCK_ELEMENTS)


def _entities(x: str) -> str:
    for a, b in tx.NAMED_ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x.replace("'&#39;'", "'&#39;'")


@registry.add(
    "SELECT page_id, trim(regexp_replace("
    + _entities(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
        "'(?is)<(?:script|style|head)\\b[^>]*>.*?</(?:script|style|head)\\s*>', ' ', 'g'), "
        f"'(?i)</?(?:{_BLOCKS})\\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')"
    )
    + ", '\\s+', ' ', 'g')) AS text FROM pages"
)
def page_texts(spark, d):
    return tb.table(spark, d, "pages").select("page_id", markup.visible_text(F.col("html")).alias("text"))


_KEPT = "|".join(tx.ALLOWED_ELEMENTS)


@registry.add(
    f"""SELECT page_id, translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
          '(?is)<(?:script|style|head|iframe|object)\\b[^>]*>.*?</(?:script|style|head|iframe|object)\\s*>', '', 'g'),
          '(?i)<a\\b[^>]*?\\bhref="([^">]*)"[^>]*>', chr(1) || 'a href="\\1"' || chr(2), 'g'),
          '(?i)<(/?)({_KEPT})\\b[^>]*>', chr(1) || '\\1\\2' || chr(2), 'g'), '<[^>]*>', '', 'g'), chr(1) || chr(2), '<>') AS html FROM pages"""
)
def page_clean_html(spark, d):
    return tb.table(spark, d, "pages").select("page_id", markup.allowed_markup(F.col("html")).alias("html"))


@registry.add(
    """SELECT doc_id, CASE WHEN length(text) > 16000 THEN left(text, 16000) || chr(10) || chr(10) ||
         '[Email body truncated for task extraction]' ELSE text END AS body,
         left(text, 1000) AS error_text, trim('Doc ' || source || ' ' || lang) AS embed_text FROM documents"""
)
def clipped_documents(spark, d):
    docs = tb.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        tx.clip_body(F.col("text")).alias("body"),
        tx.clip_error(F.col("text"), F.lit("Error"), 1000).alias("error_text"),
        tx.embedding_text(F.concat(F.lit("Doc "), "source"), F.col("lang")).alias("embed_text"),
    )


@registry.add(
    """SELECT mailbox_user_id, message_id, 'Subject:' || chr(10) || coalesce(subject, '') || chr(10) || chr(10) || 'Sender:' || chr(10) || sender_email
         || chr(10) || chr(10) || 'Recipients:' || chr(10) || mailbox_user_id || '@org.example' || chr(10) || chr(10) || 'Received date/time:' || chr(10)
         || received || chr(10) || chr(10) || 'Email Body:' || chr(10) || body AS request FROM emails"""
)
def extraction_requests(spark, d):
    to = F.array(F.concat("mailbox_user_id", F.lit("@org.example")))
    return ingest.extraction_requests(tb.emails(spark, d).withColumn("recipient_emails", to))


# -- model replies ------------------------------------------------------------------------------------------------

# replies follow from the event number: fenced, bare lists, chatter around, broken, truncated, blank
_REPLY = """CASE {k} % 8
  WHEN 0 THEN '```json' || chr(10) || '{{"responseRequired": true, "tasks": [{{"task": " Send report ' || ({k} % 40) || '", "dueDate": "2024-02-' || lpad(CAST({k} % 35 AS VARCHAR), 2, '0') || '", "priority": "high"}}]}}' || chr(10) || '```'
  WHEN 1 THEN '[{{"task": "Call ' || ({k} % 40) || '", "description": "null", "priority": "someday"}}, {{"task": " "}}]'
  WHEN 2 THEN 'Sure: {{"responseRequired": false, "tasks": [{{"task": "A"}}, {{"task": null}}, {{"task": "B", "description": " d "}}]}} done'
  WHEN 3 THEN '{{"responseRequired": true, "tasks": []}}'
  WHEN 4 THEN '{{"tasks": {{"task": "x"}}}}'
  WHEN 5 THEN 'no json here'
  WHEN 6 THEN '{{"responseRequired": true, "tasks": [{{"task": "cut'
  ELSE '  ' END"""
_REPLIES = f"""(SELECT event_id AS k, 'mbx' || (user_id % 10) AS mailbox_user_id, 'm' || event_id AS message_id, {_REPLY.format(k='event_id')} AS content,
    CASE WHEN event_id % 8 = 6 THEN 'length' ELSE 'stop' END AS finish_reason FROM events WHERE event_type IN ('click', 'view', 'error'))"""
_OUTCOME = """CASE k % 8 WHEN 4 THEN 'UNREADABLE' WHEN 5 THEN 'UNREADABLE' WHEN 6 THEN 'TRUNCATED' WHEN 7 THEN 'EMPTY' ELSE 'OK' END"""


def _replies(spark, d):
    mail = tb.emails(spark, d)
    text = _REPLY.format(k="position").replace("CAST(position % 35 AS VARCHAR)", "CAST(position % 35 AS STRING)").replace("chr(10)", "char(10)")
    return mail.select(
        F.col("position").alias("k"),
        "mailbox_user_id",
        "message_id",
        F.expr(text).alias("content"),
        F.when(F.col("position") % 8 == 6, "length").otherwise("stop").alias("finish_reason"),
    )


@registry.add(
    f"""SELECT k, mailbox_user_id, message_id, {_OUTCOME} AS outcome,
          CASE WHEN k % 8 IN (0, 3) THEN true WHEN k % 8 IN (1, 2) THEN false END AS response_required,
          CASE k % 8 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 END AS n_tasks, k % 8 < 3 AS actionable FROM {_REPLIES}"""
)
def reply_outcomes(spark, d):
    parsed = ingest.extracted_tasks(_replies(spark, d))
    return parsed.withColumn("n_tasks", F.size("tasks")).drop("tasks")


# the oracle reads the JSON itself rather than repeating what was generated
_ITEMS = f"""(SELECT k, mailbox_user_id, message_id, pos, trim(json_extract_string(t, '$.task')) AS title,
      nullif(nullif(lower(trim(json_extract_string(t, '$.description'))), ''), 'null') AS description,
      TRY_CAST(json_extract_string(t, '$.dueDate') AS DATE) AS due_date,
      CASE WHEN upper(json_extract_string(t, '$.priority')) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
           THEN upper(json_extract_string(t, '$.priority')) ELSE 'MEDIUM' END AS priority
    FROM (SELECT k, mailbox_user_id, message_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (
      SELECT *, CASE WHEN left(j, 1) = '[' THEN json_extract(j, '$[*]') ELSE json_extract(j, '$.tasks[*]') END AS l FROM (
        SELECT *, regexp_extract(content, '(?s)([\\{{\\[].*[\\}}\\]])', 1) AS j FROM {_REPLIES} WHERE k % 8 < 4)))
    WHERE nullif(trim(json_extract_string(t, '$.task')), '') IS NOT NULL)"""


@registry.add(f"SELECT k, message_id, title, description, CAST(due_date AS VARCHAR) AS due_date, priority FROM {_ITEMS}")
def extracted_tasks(spark, d):
    parsed = ingest.extracted_tasks(_replies(spark, d))
    return parsed.select("k", "message_id", F.explode("tasks").alias("t")).select("k", "message_id", "t.*")


@registry.add(
    f"""SELECT *, {fingerprint()} AS task_fingerprint FROM (
        SELECT message_id || '#' || (row_number() OVER (PARTITION BY k ORDER BY pos) - 1) AS task_key, i.title, i.description,
          i.due_date, i.priority, o.name AS assignee, o.email AS assignee_email, message_id AS source_email_id,
          subject AS source_subject, nullif(lower({strip('sender_email')}), '') AS normalized_sender, mailbox_user_id AS source_mailbox,
          CASE WHEN {_CLASS} IN ('INTERNAL', 'EXTERNAL') THEN {_CLASS} END AS source_type, {parse_instant('received')} AS email_received_at
        FROM {_ITEMS} i JOIN emails USING (mailbox_user_id, message_id)
        LEFT JOIN employees o ON o.microsoft_user_id = 'ms-' || user_no || '-0')""".replace("SELECT *, md5", "SELECT * REPLACE (CAST(due_date AS VARCHAR) AS due_date), md5")
)
def extracted_task_rows(spark, d):
    owner = tb.employees(spark, d).select("name", "email", "microsoft_user_id")
    mail = _classed(spark, d).withColumn("_owner", F.concat(F.lit("ms-"), F.col("user_no"), F.lit("-0")))
    mail = identity.resolve_by_mailbox(mail, owner.withColumn("id", F.lit(0)), "_owner")
    rows = ingest.task_rows(mail, ingest.extracted_tasks(_replies(spark, d)))
    return rows.drop("source_sender", "source_email_body", "source_domain", "status")


_VERDICT = """CASE {k} % 7 WHEN 0 THEN '{{"result":"SAME","reason":"r' || {k} || '"}}' WHEN 1 THEN '```json' || chr(10) || '{{"result":" different "}}' || chr(10) || '```'
  WHEN 2 THEN '{{"result":"AMBIGUOUS","reason":null}}' WHEN 3 THEN 'this is not json {{{{' WHEN 4 THEN '{{"result":"MAYBE"}}' WHEN 5 THEN '{{"reason":"x"}}' ELSE ' ' END"""


@registry.add(
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'MALFORMED' WHEN event_id % 7 < 3 THEN 'VERDICT' WHEN event_id % 7 = 6 THEN 'UNAVAILABLE' ELSE 'MALFORMED' END AS outcome,
         CASE WHEN event_id % 10 <> 0 THEN CASE event_id % 7 WHEN 0 THEN 'SAME' WHEN 1 THEN 'DIFFERENT' WHEN 2 THEN 'AMBIGUOUS' END END AS verdict,
         CASE WHEN event_id % 10 <> 0 AND event_id % 7 = 0 THEN 'r' || event_id END AS reason FROM events"""
)
def verdict_outcomes(spark, d):
    rows = tb.table(spark, d, "events").select("event_id")
    text = F.expr(_VERDICT.format(k="event_id").replace("chr(10)", "char(10)"))
    finish = F.when(F.col("event_id") % 10 == 0, "length").otherwise("stop")
    return rows.select("event_id", ps.read_verdict(text, finish).alias("v")).select("event_id", "v.*")


_CATEGORY = """CASE WHEN kind IN ('extraction_non_retryable', 'verification_malformed') THEN 'NON_RETRYABLE'
  WHEN kind IN ('provider_unavailable', 'verification_unavailable') THEN 'UNAVAILABLE' WHEN http_status = 404 THEN 'NON_RETRYABLE'
  WHEN contains(lower(message), 'no healthy deployment') THEN 'UNAVAILABLE' ELSE 'TRANSIENT' END"""
_AFTER = "CASE WHEN TRY_CAST(trim(retry_after) AS BIGINT) > 0 THEN TRY_CAST(trim(retry_after) AS BIGINT) END"


@registry.add(f"SELECT id, {_CATEGORY} AS category, {_AFTER} AS retry_after_seconds FROM queue_outcomes")
def failure_categories(spark, d):
    rows = tb.queue_outcomes(spark, d)
    return rows.select(
        "id",
        ps.failure_category(F.col("kind"), F.col("http_status"), F.col("message")).alias("category"),
        ps.retry_after_seconds(F.col("retry_after")).alias("retry_after_seconds"),
    )


# -- deadlines and replies ----------------------------------------------------------------------------------------


def _open(spark, d):
    domains = sla.own_domains(tb.employees(spark, d), [tb.OWN_DOMAIN])
    return sla.open_slas(tb.emails(spark, d), domains)


def _state(spark, d):
    opened = _open(spark, d)
    return sla.with_answers(opened, sla.match_replies(opened, tb.sent_mail(spark, d)), AS_OF)


@registry.add(f"SELECT event_id, {deadline_sql('ts')} AS deadline_at FROM events")
def deadlines(spark, d):
    return tb.table(spark, d, "events").select("event_id", deadline(F.col("ts")).alias("deadline_at"))


@registry.add("SELECT domain FROM own_domains WHERE domain IS NOT NULL")
def own_domains(spark, d):
    return sla.own_domains(tb.employees(spark, d), [tb.OWN_DOMAIN])


@registry.add(
    """SELECT message_id, sender_domain FROM emails WHERE response_required AND sender_domain <> 'unknown'
       AND sender_domain NOT IN (SELECT domain FROM own_domains WHERE domain IS NOT NULL)"""
)
def eligible_mail(spark, d):
    domains = sla.own_domains(tb.employees(spark, d), [tb.OWN_DOMAIN])
    return sla.eligible(tb.emails(spark, d), domains).select("message_id", "sender_domain")


@registry.add(
    """SELECT sla_id, mailbox_user_id, message_id, conversation_id, sender_email AS customer_email, sender_domain AS customer_domain,
         subject, received_at, sla_deadline_at FROM sla"""
)
def opened_slas(spark, d):
    return _open(spark, d)


@registry.add(
    f"""SELECT mailbox_user_id, message_id, conversation_id, coalesce({parse_instant('received')}, {NOW}) AS received_at, sender_name,
          sender_email, sender_domain, subject, response_required, requires_action FROM emails"""
)
def mail_intelligence(spark, d):
    mail = tb.emails(spark, d)
    return mutations.backfill_flags(sla.intelligence(mail.unionByName(mail), AS_OF))


@registry.add("SELECT sla_id, first_response_at, reply_id AS response_message_id, responded_by, fallback FROM matches")
def reply_matches(spark, d):
    return sla.match_replies(_open(spark, d), tb.sent_mail(spark, d))


@registry.add("SELECT sla_id, received_at, sla_deadline_at, first_response_at, response_message_id, responded_by, status FROM sla_state")
def sla_states(spark, d):
    return _state(spark, d).select(
        "sla_id", "received_at", "sla_deadline_at", "first_response_at", "response_message_id", "responded_by", "status"
    )


# reports read a state table whose first responses follow from the message number, so that they stay one scan
def _stated(spark, d):
    n = F.regexp_replace("message_id", "m", "").cast("bigint")
    answered = F.when(n % 3 != 0, F.timestamp_add("MINUTE", ((n % 100) * 97 - 3000).cast("int"), F.col("sla_deadline_at")))
    first = F.when(answered > F.col("received_at"), F.timestamp_add("SECOND", (n % 61).cast("int"), answered))
    opened = _open(spark, d).withColumns(
        {"first_response_at": first, "responded_by": F.when(first.isNotNull(), F.col("mailbox_user_id"))}
    )
    return opened.withColumn("status", sla.sla_status(F.lit(AS_OF)))


_STATED = f"""(SELECT *, CASE WHEN first_response_at IS NOT NULL THEN mailbox_user_id END AS responded_by,
    CASE WHEN first_response_at IS NULL THEN CASE WHEN sla_deadline_at < {NOW} THEN 'BREACHED' ELSE 'WAITING' END
         WHEN first_response_at > sla_deadline_at THEN 'BREACHED' ELSE 'COMPLETED' END AS status
  FROM (SELECT *, CASE WHEN position % 3 <> 0 AND sla_deadline_at + to_minutes(position % 100 * 97 - 3000) > received_at
      THEN sla_deadline_at + to_minutes(position % 100 * 97 - 3000) + to_seconds(position % 61) END AS first_response_at FROM sla))"""
_FOUR = """count(*) AS total, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
  count(*) FILTER (WHERE status = 'WAITING') AS waiting, count(*) FILTER (WHERE status = 'BREACHED') AS breached"""


@registry.add(
    f"""SELECT '2024-01-15' AS day, *, CASE WHEN total > 0 THEN round(completed * 100.0 / total, 1)::DOUBLE END AS compliance_rate
        FROM (SELECT {_FOUR} FROM {_STATED} WHERE received_at >= TIMESTAMP '2024-01-15' AND received_at < TIMESTAMP '2024-01-16')"""
)
def sla_summary(spark, d):
    return sla.sla_summary(_stated(spark, d), date(2024, 1, 15))


@registry.add(
    f"""SELECT '2023-01-15' AS day, *, CAST(NULL AS DOUBLE) AS compliance_rate
        FROM (SELECT {_FOUR} FROM {_STATED} WHERE received_at >= TIMESTAMP '2023-01-15' AND received_at < TIMESTAMP '2023-01-16')"""
)
def sla_summary_of_empty_day(spark, d):
    return sla.sla_summary(_stated(spark, d), date(2023, 1, 15))


@registry.add(
    f"""SELECT CAST(day AS VARCHAR) AS day, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed, coalesce(waiting, 0) AS waiting,
          coalesce(breached, 0) AS breached
        FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-22', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS day)
        LEFT JOIN (SELECT CAST(received_at AS DATE) AS day, {_FOUR} FROM {_STATED} GROUP BY 1) USING (day)"""
)
def sla_trend(spark, d):
    return sla.sla_trend(_stated(spark, d), TODAY, 30)


@registry.add(
    f"""SELECT sla_id, sender_email AS customer_email, sender_domain AS customer_domain, subject, received_at, sla_deadline_at, first_response_at,
          CAST(trunc(floor((epoch_us(first_response_at) - epoch_us(sla_deadline_at)) / 1e6) / 60) AS BIGINT) AS delay_minutes, status, responded_by
        FROM {_STATED} WHERE status = 'BREACHED' AND received_at >= TIMESTAMP '2024-01-03' AND received_at < TIMESTAMP '2024-01-18'"""
)
def breached_mail(spark, d):
    return sla.breached(_stated(spark, d), date(2024, 1, 3), date(2024, 1, 17))


@registry.add(
    f"""SELECT sla_id, status, CAST(trunc(floor((epoch_us(first_response_at) - epoch_us(sla_deadline_at)) / 1e6) / 60) AS BIGINT) AS delay_minutes
        FROM {_STATED} WHERE status = 'BREACHED' AND mailbox_user_id = 'mbx3'"""
)
def breached_mail_of_mailbox(spark, d):
    return sla.breached(_stated(spark, d), mailbox=" mbx3 ").select("sla_id", "status", "delay_minutes")


@registry.add(f"SELECT sla_id, sla_deadline_at, 'BREACHED' AS status FROM sla WHERE sla_deadline_at < {NOW}")
def breach_sweep(spark, d):
    waiting = _open(spark, d).withColumn("status", F.lit("WAITING"))
    return sla.sweep_breaches(waiting, AS_OF).select("sla_id", "sla_deadline_at", "status")


@registry.add(
    f"""SELECT sla_id, CASE WHEN hit THEN CASE WHEN status = 'BREACHED' OR sent_at > sla_deadline_at THEN 'BREACHED' ELSE 'COMPLETED' END ELSE status END AS status,
          CASE WHEN hit THEN sent_at ELSE first_response_at END AS first_response_at,
          CASE WHEN hit THEN 'r' || position END AS response_message_id
        FROM (SELECT *, position % 2 = 0 AND first_response_at IS NULL AS hit, received_at + to_hours(position % 130) AS sent_at FROM {_STATED})"""
)
def recorded_responses(spark, d):
    rows = _stated(spark, d).withColumn("response_message_id", F.lit(None).cast("string"))
    n = F.regexp_replace("message_id", "m", "").cast("bigint")
    first = rows.filter(n % 2 == 0).select(
        "sla_id",
        F.timestamp_add("HOUR", (n % 130).cast("int"), F.col("received_at")).alias("sent_at"),
        F.concat(F.lit("r"), n).alias("reply_id"),
        F.lit("w").alias("responded_by"),
    )
    later = first.withColumns({"sent_at": F.timestamp_add("HOUR", F.lit(5), F.col("sent_at")), "reply_id": F.lit("later")})
    done = sla.record_first_response(rows, first.unionByName(later))
    return done.select("sla_id", "status", "first_response_at", "response_message_id")


def _domain_commands(spark, d):
    return tb.table(spark, d, "events").selectExpr(
        "event_id AS id",
        "ts AS at",
        "CASE WHEN event_id % 50 = 0 THEN ' ' ELSE concat(' Client', user_id, '.Example') END AS domain",
        "CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS action",
    )


_DOMAINS = """(SELECT 'client' || user_id || '.example' AS domain, arg_max(event_id % 3 <> 0, (ts, event_id)) AS active
  FROM events WHERE event_id % 50 <> 0 GROUP BY 1 HAVING count(*) FILTER (WHERE event_id % 3 <> 0) > 0)"""


@registry.add(f"SELECT domain, active FROM {_DOMAINS}")
def customer_domains(spark, d):
    return sla.customer_domains(_domain_commands(spark, d))


@registry.add(f"SELECT message_id, sender_domain FROM emails WHERE sender_domain IN (SELECT domain FROM {_DOMAINS} WHERE active)")
def mail_from_customers(spark, d):
    return sla.from_active_domains(tb.emails(spark, d), sla.customer_domains(_domain_commands(spark, d))).select(
        "message_id", "sender_domain"
    )


@registry.add(
    """SELECT c.conv_id, c.turn, min(a.turn) AS answer_turn FROM conversations c LEFT JOIN conversations a
         ON a.conv_id = c.conv_id AND a.role = 'assistant' AND a.turn > c.turn WHERE c.role = 'user' GROUP BY ALL"""
)
def thread_answers(spark, d):
    """First answer to every question of a thread, by the same forward lookup as reply matching."""
    turns = tb.table(spark, d, "conversations").select("conv_id", "turn", "role")
    answer = F.when(F.col("role") == "assistant", F.col("turn"))
    found = next_value(turns, ["conv_id"], F.expr("turn div 1000"), ["turn"], answer, "answer_turn")
    return found.filter("role = 'user'").select("conv_id", "turn", "answer_turn")


# -- queue --------------------------------------------------------------------------------------------------------

_DUE = f"(next_attempt_at IS NULL OR next_attempt_at <= {NOW})"
_READY = f"((status IN ('PENDING', 'FAILED') AND attempt_count < 5) OR (status = 'DEFERRED' AND defer_count < 100)) AND {_DUE}"
_CLAIM = "coalesce(next_attempt_at, created_at), created_at, id"


@registry.add(f"SELECT id, 'PROCESSING' AS status, 'w9' AS claimed_by, {NOW} AS claimed_at FROM queue WHERE {_READY} ORDER BY {_CLAIM} LIMIT 20")
def queue_claim(spark, d):
    size = qu.claim_size(20, 25, 50)
    return qu.claim_batch(tb.queue(spark, d), size, "w9", AS_OF).select("id", "status", "claimed_by", "claimed_at")


@registry.add(f"SELECT id FROM queue WHERE {_READY}")
def queue_claimable(spark, d):
    return qu.claimable(tb.queue(spark, d), AS_OF).select("id")


_NEXT = f"(status = 'PENDING' OR (status = 'FAILED' AND next_attempt_at IS NOT NULL)) AND {_DUE} AND attempt_count < 5"


@registry.add(f"SELECT id FROM queue WHERE mailbox_user_id = 'mbx4' AND {_NEXT} ORDER BY {_CLAIM} LIMIT 1")
def queue_claim_next(spark, d):
    return qu.claim_next(tb.queue(spark, d), "mbx4", "w1", AS_OF).select("id")


@registry.add(
    f"""SELECT mailbox_user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY mailbox_user_id ORDER BY {_CLAIM}) AS rn
        FROM queue WHERE {_NEXT}) WHERE rn = 1"""
)
def queue_claim_next_per_mailbox(spark, d):
    return qu.claim_next_per_mailbox(tb.queue(spark, d), AS_OF)


@registry.add(
    f"""SELECT q.id, claim_rank, q.message_id, q.status FROM queue q JOIN (
          SELECT id, CAST(row_number() OVER (ORDER BY {_CLAIM}) AS INTEGER) AS claim_rank FROM (
            SELECT * FROM queue WHERE {_READY} ORDER BY {_CLAIM} LIMIT 50)) USING (id)"""
)
def claimed_rows(spark, d):
    from pyspark.sql import Window

    rows = tb.queue(spark, d)
    order = qu.claim_order()
    batch = qu.claimable(rows, AS_OF).orderBy(*order).limit(50)  # a claim is one small batch
    claims = batch.withColumn("claim_rank", F.row_number().over(Window.orderBy(*order)))
    return qu.claimed_rows(rows, claims).select("id", "claim_rank", "message_id", "status")


@registry.add(f"SELECT DISTINCT mailbox_user_id FROM queue WHERE status IN ('PENDING', 'FAILED') AND attempt_count < 5 AND {_DUE}")
def ready_mailboxes(spark, d):
    return qu.ready_mailboxes(tb.queue(spark, d), AS_OF)


_OWNED = """(SELECT o.*, attempt_count, defer_count, first_deferred_at FROM queue_outcomes o JOIN queue q USING (id)
  WHERE q.status = 'PROCESSING' AND worker = claimed_by AND claimed_at >= reported_at - INTERVAL 15 MINUTE)"""


@registry.add(f"SELECT id, action, worker, reported_at FROM {_OWNED}")
def owned_outcomes(spark, d):
    return qu.owned(tb.queue_outcomes(spark, d), tb.queue(spark, d)).select("id", "action", "worker", "reported_at")


_NEXT_STATE = f"""(SELECT id, action, reported_at, category, CASE WHEN action IS NULL THEN status WHEN action = 'complete' THEN 'COMPLETED'
    WHEN action = 'unavailable' THEN 'SKIPPED' WHEN action = 'release' THEN 'PENDING' WHEN action = 'start' THEN 'PROCESSING'
    WHEN category = 'NON_RETRYABLE' THEN 'DEAD_LETTER'
    WHEN category = 'UNAVAILABLE' THEN CASE WHEN defer_count + 1 > 100 OR reported_at - coalesce(first_deferred_at, reported_at) >= INTERVAL 2880 MINUTE
      THEN 'DEAD_LETTER' ELSE 'DEFERRED' END
    ELSE CASE WHEN attempt_count >= 5 THEN 'DEAD_LETTER' ELSE 'FAILED' END END AS status, attempt_count, defer_count, next_attempt_at, message, kind,
    retry_s, error_message
  FROM (SELECT q.*, o.action, o.reported_at, o.message, o.kind, {_CATEGORY.replace('kind', 'o.kind').replace('http_status', 'o.http_status').replace('(message)', '(o.message)')} AS category,
          {_AFTER.replace('retry_after', 'o.retry_after')} AS retry_s
        FROM queue q LEFT JOIN (SELECT id, action, reported_at, message, kind, http_status, retry_after FROM {_OWNED}) o USING (id)))"""


@registry.add(
    f"""SELECT id, status, CAST(CASE WHEN action = 'start' THEN attempt_count + 1 ELSE attempt_count END AS INTEGER) AS attempt_count,
          CASE WHEN action = 'fail' AND category = 'UNAVAILABLE' THEN defer_count + 1 ELSE defer_count END AS defer_count,
          CASE WHEN action IS NULL OR action = 'start' THEN error_message WHEN action = 'fail' THEN CASE WHEN trim(message) = '' THEN coalesce(kind, 'error') ELSE message END
               WHEN action = 'unavailable' THEN 'Message is no longer available in Microsoft Graph.' END AS error_message,
          CASE WHEN action IS NULL OR action = 'start' THEN next_attempt_at WHEN action = 'release' THEN reported_at
               WHEN status = 'DEFERRED' THEN reported_at + to_minutes(coalesce(greatest(1, retry_s // 60), 20)) END AS deferred_until,
          CASE WHEN action = 'fail' AND status = 'FAILED'
               THEN least(30 * CAST(pow(2, least(greatest(attempt_count - 1, 0), 10)) AS BIGINT), 3600) END AS least_pause
        FROM {_NEXT_STATE}"""
)
def queue_after_outcomes(spark, d):
    rows, reports = tb.queue(spark, d), tb.queue_outcomes(spark, d)
    done = qu.apply_outcomes(rows, reports)
    # the spread of a retry time is hash-based; what is compared is the pause without it
    retried = (F.col("status") == "FAILED") & (F.col("_was") == "PROCESSING")
    return done.join(rows.select("id", F.col("status").alias("_was")), "id").select(
        "id",
        "status",
        "attempt_count",
        "defer_count",
        "error_message",
        F.when(~retried, F.col("next_attempt_at")).alias("deferred_until"),
        F.when(retried, qu.transient_retry_seconds(F.col("attempt_count"))).alias("least_pause"),
    )


@registry.add(
    f"""SELECT run_id, count(*) AS claimed, count(*) FILTER (WHERE action = 'complete') AS completed, count(*) FILTER (WHERE action = 'unavailable') AS skipped,
          count(*) FILTER (WHERE action = 'release') AS rate_limited, count(*) FILTER (WHERE action = 'fail' AND status = 'FAILED') AS failed,
          count(*) FILTER (WHERE action = 'fail' AND status = 'DEFERRED') AS deferred, count(*) FILTER (WHERE action = 'fail' AND status = 'DEAD_LETTER') AS dead_lettered
        FROM (SELECT run_id, s.action, s.status FROM {_NEXT_STATE} s JOIN queue_outcomes o USING (id) WHERE s.action IS NOT NULL) GROUP BY 1"""
)
def run_counters(spark, d):
    rows, reports = tb.queue(spark, d), tb.queue_outcomes(spark, d)
    return qu.run_counters(qu.run_log(reports, rows, qu.apply_outcomes(rows, reports)))


@registry.add(
    f"""SELECT id, CASE WHEN hit THEN 'PENDING' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE attempt_count END AS attempt_count,
          CASE WHEN hit THEN 0 ELSE defer_count END AS defer_count, CASE WHEN hit THEN {NOW} ELSE next_attempt_at END AS next_attempt_at,
          CASE WHEN NOT hit THEN error_message END AS error_message
        FROM (SELECT *, id % 4 = 1 AND status = 'DEAD_LETTER' AS hit FROM queue)"""
)
def requeued(spark, d):
    rows = tb.queue(spark, d)
    done = qu.requeue_dead_letters(rows, rows.filter("id % 4 = 1"), AS_OF)
    return done.select("id", "status", "attempt_count", "defer_count", "next_attempt_at", "error_message")


@registry.add(
    f"""SELECT id, CASE WHEN lost THEN CASE WHEN attempt_count >= 5 THEN 'DEAD_LETTER' ELSE 'FAILED' END ELSE status END AS status,
          CASE WHEN lost THEN CASE WHEN attempt_count < 5 THEN {NOW} END ELSE next_attempt_at END AS next_attempt_at,
          CASE WHEN NOT lost THEN claimed_by END AS claimed_by,
          CASE WHEN lost THEN coalesce(error_message, '') || ' Lease expired and was reclaimed.' ELSE error_message END AS error_message
        FROM (SELECT *, coalesce(status = 'PROCESSING' AND claimed_at < {NOW} - INTERVAL 15 MINUTE, false) AS lost FROM queue)"""
)
def recovered_leases(spark, d):
    return qu.recover_leases(tb.queue(spark, d), AS_OF).select("id", "status", "next_attempt_at", "claimed_by", "error_message")


@registry.add(f"SELECT id, CASE WHEN status IN ('PENDING', 'FAILED') THEN {NOW} ELSE next_attempt_at END AS next_attempt_at FROM queue")
def queue_due_now(spark, d):
    return mutations.backfill_due_now(tb.queue(spark, d), AS_OF).select("id", "next_attempt_at")


@registry.add("SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in qu.STATUSES) + " FROM queue")
def queue_stats(spark, d):
    return qu.stats(tb.queue(spark, d))


@registry.add(
    """SELECT outstanding, dead_letters, outstanding > 200 AS backlog_alert, dead_letters > 0 AS dead_letter_alert FROM (
         SELECT count(*) FILTER (WHERE status IN ('PENDING', 'FAILED')) AS outstanding, count(*) FILTER (WHERE status = 'DEAD_LETTER') AS dead_letters FROM queue)"""
)
def queue_backlog(spark, d):
    return qu.backlog(tb.queue(spark, d))


def _entry_sql(status: str) -> str:
    return f"SELECT {', '.join(qu.ENTRY_COLUMNS)} FROM queue WHERE status = '{status}'"


@registry.add(_entry_sql("DEAD_LETTER"))
def dead_letters(spark, d):
    return qu.entries(tb.queue(spark, d), "DEAD_LETTER")


@registry.add(_entry_sql("DEFERRED"))
def deferred_messages(spark, d):
    return qu.entries(tb.queue(spark, d), "DEFERRED")


@registry.add("SELECT mailbox_user_id, status, status = 'COMPLETED' AS is_completed FROM queue WHERE message_id = 'm70'")
def queue_status_lookup(spark, d):
    found = tb.queue(spark, d).filter("message_id = 'm70'")
    return found.select("mailbox_user_id", "status", (F.col("status") == "COMPLETED").alias("is_completed"))


@registry.add("SELECT created_at FROM queue WHERE created_at >= TIMESTAMP '2024-01-13'")
def ingestion_times(spark, d):
    return qu.ingested_since(tb.queue(spark, d), AS_OF, 7)


# call by call, with the state of the limiter
_CALLS = """SELECT event_id AS call, ts AS "at", w AS window_start, CAST(d AS VARCHAR) AS day, outcome FROM (
  WITH RECURSIVE c AS MATERIALIZED (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
  replay AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS TIMESTAMP) AS w, 0 AS n,
      CAST(NULL AS DATE) AS d, 0 AS used, CAST(NULL AS VARCHAR) AS outcome
    UNION ALL
    SELECT i, event_id, ts, w, CASE WHEN outcome = 'PERMITTED' THEN n + 1 ELSE n END, d, CASE WHEN outcome = 'PERMITTED' THEN used + 1 ELSE used END, outcome
    FROM (SELECT *, CASE WHEN used >= {per_day} THEN 'DAY' WHEN n >= {per_minute} THEN 'MINUTE' ELSE 'PERMITTED' END AS outcome FROM (
      SELECT c.i, c.event_id, c.ts, CASE WHEN r.w IS NULL OR c.ts > r.w + INTERVAL 60 SECOND THEN c.ts ELSE r.w END AS w,
        CASE WHEN r.w IS NULL OR c.ts > r.w + INTERVAL 60 SECOND THEN 0 ELSE r.n END AS n, CAST(c.ts AS DATE) AS d,
        CASE WHEN r.d = CAST(c.ts AS DATE) THEN r.used ELSE 0 END AS used
      FROM replay r JOIN c ON c.i = r.i + 1)))
  SELECT * FROM replay WHERE i > 0)"""


@registry.add(_CALLS.format(per_minute=1, per_day=200))
def call_outcomes(spark, d):
    return qu.call_outcomes(tb.table(spark, d, "events"), per_minute=1, per_day=200)


@registry.add(
    f"""WITH said AS MATERIALIZED ({_CALLS.format(per_minute=20, per_day=50)}),
        used AS (SELECT *, count(*) FILTER (WHERE outcome = 'PERMITTED') OVER (PARTITION BY day ORDER BY "at", call) AS day_used FROM said)
        SELECT window_start, count(*) AS calls, count(*) FILTER (WHERE outcome = 'PERMITTED') AS permitted,
          greatest(0, 20 - count(*) FILTER (WHERE outcome = 'PERMITTED')) AS minute_left,
          greatest(0, 50 - arg_max(day_used, ("at", call))) AS day_left, count(*) FILTER (WHERE outcome <> 'PERMITTED') > 0 AS over_budget
        FROM used GROUP BY 1"""
)
def call_budget(spark, d):
    return qu.call_budget(tb.table(spark, d, "events"))


@registry.add(
    """SELECT event_id, least(30 * CAST(pow(2, least(greatest(event_id % 14 - 1, 0), 10)) AS BIGINT), 3600) AS transient_seconds,
         least(2 * CAST(pow(2, least(greatest(event_id % 14, 1) - 1, 10)) AS BIGINT), 60) AS feed_seconds, true AS spread_ok FROM events"""
)
def retry_pauses(spark, d):
    attempt = F.col("event_id") % 14
    pause = qu.transient_retry_seconds(attempt)
    spread = qu.jitter_seconds(pause, F.col("event_id"), attempt)
    return tb.table(spark, d, "events").select(
        "event_id",
        pause.alias("transient_seconds"),
        qu.backoff_seconds(F.greatest(attempt, F.lit(1)), 2, 60).alias("feed_seconds"),
        ((spread >= 0) & (spread <= pause / 5)).alias("spread_ok"),
    )


# -- change feed --------------------------------------------------------------------------------------------------


@registry.add(
    f"""SELECT id, 'PROCESSING' AS status, attempt_count + 1 AS attempt_count FROM feed WHERE status = 'PENDING' AND {_DUE}
        ORDER BY created_at, id LIMIT 100"""
)
def feed_claim(spark, d):
    return fd.due_events(tb.feed(spark, d), AS_OF).select("id", "status", "attempt_count")


@registry.add(
    f"""SELECT id, CASE WHEN status <> 'PROCESSING' THEN status WHEN user_no % 3 = 0 THEN 'PUBLISHED' WHEN user_no % 3 = 1 THEN 'PENDING' ELSE status END AS status,
          CASE WHEN status = 'PROCESSING' AND user_no % 3 = 1 THEN {NOW} + to_seconds(least(2 * CAST(pow(2, least(greatest(attempt_count, 1) - 1, 10)) AS BIGINT), 60))
               ELSE next_attempt_at END AS next_attempt_at,
          CASE WHEN status = 'PROCESSING' AND user_no % 3 = 0 THEN {NOW} ELSE published_at END AS published_at
        FROM (SELECT *, CAST(entity_id AS BIGINT) AS user_no FROM feed)"""
)
def feed_settled(spark, d):
    rows = tb.feed(spark, d)
    user = F.col("entity_id").cast("bigint")
    results = rows.filter((F.col("status") == "PROCESSING") & (user % 3 != 2)).select(
        "id", F.when(user % 3 == 1, "offline").alias("error")
    )
    return fd.settle(rows, results, AS_OF).select("id", "status", "next_attempt_at", "published_at")


@registry.add(
    f"""SELECT id, CASE WHEN stale THEN 'PENDING' ELSE status END AS status, CASE WHEN stale THEN {NOW} ELSE next_attempt_at END AS next_attempt_at,
          CASE WHEN NOT stale THEN claimed_at END AS claimed_at
        FROM (SELECT *, coalesce(status = 'PROCESSING' AND claimed_at < {NOW} - INTERVAL 2 MINUTE, false) AS stale FROM feed)"""
)
def feed_recovered(spark, d):
    return fd.recover_stale(tb.feed(spark, d), AS_OF).select("id", "status", "next_attempt_at", "claimed_at")


@registry.add(f"SELECT id, status FROM feed WHERE NOT coalesce(status = 'PUBLISHED' AND published_at < {NOW} - INTERVAL 7 DAY, false)")
def feed_purged(spark, d):
    return fd.purge_published(tb.feed(spark, d), AS_OF).select("id", "status")


@registry.add(
    """SELECT id, event_type AS type, entity_type, entity_id, json_extract_string(payload, '$.entityId') AS payload_entity,
         json_extract_string(payload, '$.step') AS payload_step, created_at FROM feed"""
)
def feed_envelopes(spark, d):
    rows = fd.envelopes(tb.feed(spark, d))
    return rows.withColumns(
        {"payload_entity": F.col("payload")["entityId"], "payload_step": F.col("payload")["step"]}
    ).drop("payload")


@registry.add(
    """SELECT id, event_type, unnest(CASE WHEN event_type IN ('TASK_CREATED', 'TASK_ASSIGNEE_CHANGED') THEN ['task_summary', 'task_dashboard', 'filter_options']
         WHEN event_type = 'EMAIL_PROCESSED' THEN ['dashboard_summary', 'task_summary', 'task_dashboard', 'emails', 'ingestion']
         WHEN event_type LIKE 'TASK%' THEN ['task_summary', 'task_dashboard'] ELSE [] END) AS projection FROM feed"""
)
def stale_projections(spark, d):
    return fd.stale_projections(tb.feed(spark, d))


@registry.add(
    f"""SELECT event_type, 'SLA' AS entity_type, sla_id AS entity_id, '{{"slaId":"' || sla_id || '","status":"' || state || '"}}' AS payload,
          'PENDING' AS status, moment AS created_at
        FROM (SELECT sla_id, 'SLA_CREATED' AS event_type, 'WAITING' AS state, received_at AS moment FROM {_STATED}
              UNION ALL SELECT sla_id, 'SLA_COMPLETED', 'COMPLETED', first_response_at FROM {_STATED} WHERE status = 'COMPLETED'
              UNION ALL SELECT sla_id, 'SLA_BREACHED', 'BREACHED', coalesce(first_response_at, sla_deadline_at) FROM {_STATED} WHERE status = 'BREACHED')"""
)
def sla_transition_events(spark, d):
    return fd.sla_transitions(_stated(spark, d)).drop("id", "attempt_count")


@registry.add(
    """SELECT 'EMAIL_PROCESSED' AS event_type, 'EMAIL' AS entity_type, CAST(id AS VARCHAR) AS entity_id,
         '{"mailboxUserId":"' || mailbox_user_id || '","messageId":"' || message_id || '","status":"' || status || '"}' AS payload,
         'PENDING' AS status, coalesce(processed_at, updated_at) AS created_at
       FROM queue WHERE status IN ('COMPLETED', 'SKIPPED')"""
)
def mail_feed_events(spark, d):
    return fd.mail_events(tb.queue(spark, d)).drop("id", "attempt_count")


@registry.add(
    f"""SELECT CASE status WHEN 'COMPLETED' THEN 'SLA_COMPLETED' WHEN 'BREACHED' THEN 'SLA_BREACHED' ELSE 'SLA_CREATED' END AS event_type,
          'SLA' AS entity_type, sla_id AS entity_id, '{{"slaId":"' || sla_id || '","status":"' || status || '"}}' AS payload, 'PENDING' AS status,
          coalesce(first_response_at, CASE WHEN status = 'BREACHED' THEN sla_deadline_at END, received_at) AS created_at FROM {_STATED}"""
)
def sla_feed_events(spark, d):
    return fd.sla_events(_stated(spark, d)).drop("id", "attempt_count")


@registry.add(
    """SELECT c_custkey AS message_id, list_aggregate(list_transform(list_filter(r, lambda x: trim(coalesce(x.address, '')) <> ''),
         lambda x: CASE WHEN trim(coalesce(x.name, '')) = '' THEN x.address ELSE x.name || ' <' || x.address || '>' END), 'string_agg', '; ') AS shown
       FROM (SELECT c_custkey, [{'name': c_name, 'address': 'c' || c_custkey || '@x.example'},
               {'name': CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN c_mktsegment END, 'address': c_mktsegment || '@y.example'},
               {'name': c_name, 'address': CASE WHEN c_custkey % 2 = 0 THEN '  ' END}] AS r FROM customer)"""
)
def recipient_texts(spark, d):
    """Recipients as a reader sees them."""
    people = tb.table(spark, d, "customer").selectExpr(
        "c_custkey AS message_id",
        """array(named_struct('name', c_name, 'address', concat('c', c_custkey, '@x.example')),
                 named_struct('name', CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN c_mktsegment END,
                              'address', concat(c_mktsegment, '@y.example')),
                 named_struct('name', c_name, 'address', CASE WHEN c_custkey % 2 = 0 THEN '  ' END)) AS r""",
    )
    return people.select("message_id", F.array_join(ad.recipient_display(F.col("r")), "; ").alias("shown"))
