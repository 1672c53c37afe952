"""The same derived views as ``sources.tables``, written for the SQL oracle."""

from __future__ import annotations

import re

_NORM = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"
_WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def fingerprint(prefix: str = "") -> str:
    p = prefix
    return (
        "md5("
        + " || '|' || ".join(
            [
                _NORM.format(p + "title"),
                _NORM.format(p + "description"),
                f"coalesce(CAST({p}due_date AS VARCHAR), '')",
                f"coalesce({p}priority, '')",
                _NORM.format(p + "assignee"),
                _NORM.format(p + "assignee_email"),
            ]
        )
        + ")"
    )


def domain_of(x: str, missing: str = "'unknown'") -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {strip(x)} = '' OR instr({x}, '@') = 0 OR suffix({x}, '@') THEN {missing} "
        f"ELSE lower(split_part({x}, '@', -1)) END"
    )


CUSTOMER_ADDRESS = """('Cust' || user_id || '@' || CASE user_id % 5 WHEN 0 THEN 'org.example' WHEN 1 THEN 'gmail.com'
  WHEN 2 THEN 'Outlook.com' WHEN 3 THEN 'client' || (user_id % 7) || '.example' ELSE 'partner.example' END)"""

ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"


def parse_instant(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{ISO_INSTANT}') THEN CAST(rtrim({x}, 'Z') AS TIMESTAMP) END"


def deadline_sql(ts: str) -> str:
    """Deadline as a scalar subquery: 24 hours of 09:00-18:00 Monday to Friday, walked day by day."""
    return f"""(
    WITH RECURSIVE walk(cur, remaining) AS (
      SELECT {ts}, 1440::BIGINT
      UNION ALL
      SELECT CASE WHEN isodow(cur) > 5 OR CAST(cur AS TIME) >= TIME '18:00:00'
                  THEN date_trunc('day', cur) + INTERVAL 33 HOUR
                  WHEN CAST(cur AS TIME) < TIME '09:00:00' THEN date_trunc('day', cur) + INTERVAL 9 HOUR
                  WHEN (epoch_us(date_trunc('day', cur) + INTERVAL 18 HOUR) - epoch_us(cur)) // 60000000 >= remaining
                  THEN cur + to_minutes(remaining)
                  ELSE date_trunc('day', cur) + INTERVAL 33 HOUR END,
             CASE WHEN isodow(cur) > 5 OR CAST(cur AS TIME) >= TIME '18:00:00'
                    OR CAST(cur AS TIME) < TIME '09:00:00' THEN remaining
                  ELSE greatest(0, remaining -
                    (epoch_us(date_trunc('day', cur) + INTERVAL 18 HOUR) - epoch_us(cur)) // 60000000) END
      FROM walk WHERE remaining > 0)
    SELECT cur FROM walk WHERE remaining = 0)"""


_FEED = (
    "['TASK_CREATED','TASK_STATUS_CHANGED','TASK_PRIORITY_CHANGED','TASK_ASSIGNEE_CHANGED','TASK_UPDATED',"
    "'SLA_CREATED','SLA_COMPLETED','SLA_BREACHED','EMAIL_PROCESSED']"
)

VIEWS: dict[str, str] = {
    "task_rows": f"""
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 3 = 0 THEN '  REVIEW   contract ' WHEN o_orderkey % 3 = 1 THEN 'Review Contract'
         ELSE 'Send invoice, then audit' END AS title,
    CASE WHEN o_orderkey % 17 <> 0 THEN 'Priority ' || o_orderpriority END AS description,
    CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 3 THEN '' WHEN o_custkey % 53 = 5 THEN 'Unassigned'
         ELSE 'user' || (o_custkey // 10) END AS assignee,
    CASE WHEN o_orderkey % 19 = 0 OR o_custkey % 7 = 0 THEN NULL
         WHEN o_orderkey % 10 < 6 THEN 'user' || (o_custkey // 10) || '@org.example'
         WHEN o_orderkey % 10 < 8 THEN ' User' || (o_custkey // 10) || '@ALT.example '
         ELSE 'USER' || (o_custkey // 10) || '@old.example' END AS assignee_email,
    CASE WHEN o_orderkey % 11 <> 0
         THEN CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey % 4 * 10 AS INTEGER) END AS due_date,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '5-LOW' THEN 'LOW'
         ELSE 'MEDIUM' END AS priority,
    CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'NEW' ELSE 'IN_PROGRESS' END
         WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'BLOCKED' ELSE 'IN_PROGRESS' END
         ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'COMPLETED' ELSE 'ARCHIVED' END END AS status,
    CASE WHEN o_orderkey % 23 <> 0 THEN 'msg-' || (o_orderkey // 3) END AS source_email_id,
    'Re: ' || c_name AS source_subject,
    CASE WHEN o_orderkey % 29 <> 0 THEN ' Desk@' || c_mktsegment || '.example' END AS source_sender,
    CASE WHEN o_orderkey % 29 <> 0 THEN lower('Desk@' || c_mktsegment || '.example') END AS normalized_sender,
    r_name AS source_mailbox,
    c_mktsegment || '.example' AS source_domain,
    CASE o_custkey % 3 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'EXTERNAL' END AS source_type,
    'Body of ' || o_orderkey AS source_email_body,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'Asked for by ' || c_name END AS ai_reason,
    o_orderdate + to_minutes(o_orderkey % 1440) AS created_at,
    o_orderdate + to_hours(o_orderkey % 97) AS updated_at,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate - to_hours(o_orderkey % 5) END AS email_received_at
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "tasks": f"""
  SELECT *, CASE WHEN id % 31 = 0 THEN md5(coalesce(source_email_id, '') || '|' || {fingerprint()})
                 ELSE {fingerprint()} END AS task_fingerprint
  FROM task_rows""",
    "employees": """
  SELECT g * 3 + n AS id,
    CASE n WHEN 0 THEN 'user' || g WHEN 1 THEN 'User ' || g ELSE 'USER' || g END AS name,
    CASE n WHEN 0 THEN 'user' || g || '@org.example' WHEN 1 THEN 'User' || g || '@alt.example'
           ELSE 'USER' || g || '@old.example' END AS email,
    CASE WHEN (g + n) % 4 <> 0 THEN 'ms-' || g || '-' || n END AS microsoft_user_id
  FROM (SELECT DISTINCT c_custkey // 10 AS g FROM customer) p
  CROSS JOIN (VALUES (0), (1), (2)) v(n)
  WHERE n = 0 OR (n = 1 AND g % 3 = 0) OR (n = 2 AND g % 6 = 0)""",
    "email_rows": f"""
  SELECT event_id AS position, user_id AS user_no, 'm' || event_id AS message_id, 'mbx' || (user_id % 10) AS mailbox_user_id,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'c' || user_id
         WHEN user_id % 3 = 1 THEN 'c' || user_id || '-' || (event_id % 3)
         ELSE 'c' || user_id || '-' || event_id END AS conversation_id,
    'Customer ' || user_id AS sender_name,
    CASE WHEN event_id % 37 = 0 THEN 'nobody' WHEN event_id % 41 = 0 THEN ' ' || upper({CUSTOMER_ADDRESS})
         ELSE {CUSTOMER_ADDRESS} END AS sender_email,
    CASE WHEN event_id % 43 <> 0 THEN 'Subject ' || event_type || ' ' || (event_id % 9) END AS subject,
    CASE WHEN event_id % 86 <> 0 THEN 'Body ' || event_id ELSE '  ' END AS body,
    CASE WHEN event_id % 101 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS received,
    event_type <> 'view' AS response_required, event_type = 'click' AS requires_action
  FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "emails": f"SELECT *, {domain_of('sender_email')} AS sender_domain FROM email_rows",
    "sent_mail": f"""
  SELECT user_id AS user_no, 's' || event_id AS reply_id,
    'mbx' || ((CASE WHEN event_id % 5 = 0 THEN user_id + 1 ELSE user_id END) % 10) AS mailbox,
    CASE WHEN event_id % 7 = 0 THEN ' ' WHEN user_id % 3 = 0 AND event_id % 4 <> 0 THEN 'c' || user_id
         WHEN user_id % 3 = 1 AND event_id % 4 <> 0 THEN 'c' || user_id || '-' || (event_id % 3)
         ELSE 'x' || event_id END AS conversation_id,
    ts AS sent_at,
    CASE WHEN event_id % 6 = 0 THEN ['other@else.example'] ELSE [lower({CUSTOMER_ADDRESS})] END AS recipients
  FROM events WHERE event_type IN ('purchase', 'signup')""",
    "own_domains": f"""
  SELECT 'org.example' AS domain
  UNION SELECT {domain_of("email", "NULL")} FROM employees WHERE microsoft_user_id IS NOT NULL""",
    "opened": f"""
  SELECT *, {parse_instant('received')} AS received_at, mailbox_user_id || '/' || message_id AS sla_id
  FROM emails
  WHERE response_required AND sender_domain <> 'unknown'
    AND sender_domain NOT IN (SELECT domain FROM own_domains WHERE domain IS NOT NULL)
    AND {parse_instant('received')} IS NOT NULL""",
    "sla": f"SELECT *, {deadline_sql('received_at')} AS sla_deadline_at FROM opened",
    "timeline": """
  SELECT user_no, row_number() OVER (PARTITION BY user_no ORDER BY moment, phase, id) AS n, * EXCLUDE (user_no) FROM (
    SELECT user_no, received_at AS moment, 0 AS phase, sla_id AS id, conversation_id AS conv, mailbox_user_id AS mailbox,
           lower(trim(sender_email)) AS customer, lower(sender_email) AS lookup, CAST([] AS VARCHAR[]) AS recipients
    FROM opened
    UNION ALL
    SELECT user_no, sent_at, 1, reply_id, nullif(trim(conversation_id), ''), mailbox, NULL, NULL, recipients
    FROM sent_mail)""",
    "replay": """
  SELECT user_no, 0::BIGINT AS n, NULL::VARCHAR AS reply_id, NULL::TIMESTAMP AS moment, NULL::VARCHAR AS mailbox,
         CAST([] AS STRUCT(id VARCHAR, conv VARCHAR, mailbox VARCHAR, customer VARCHAR, lookup VARCHAR, moment TIMESTAMP)[]) AS open_rows,
         CAST([] AS VARCHAR[]) AS closed, false AS fallback
  FROM (SELECT DISTINCT user_no FROM timeline)
  UNION ALL
  SELECT user_no, n, reply_id, moment, mailbox,
         CASE WHEN phase = 0 THEN list_append(open_rows, fresh)
              ELSE list_filter(open_rows, lambda s: NOT list_contains(closed, s.id)) END,
         closed, fallback
  FROM (
    SELECT *, CASE WHEN phase = 0 THEN CAST([] AS VARCHAR[])
                   WHEN NOT fallback THEN list_transform(list_filter(in_conv, lambda s: s.mailbox = mailbox_now
                          AND s.moment < moment_now AND list_contains(recipients, s.customer)), lambda s: s.id)
                   WHEN len(found) = 1 THEN list_transform(found, lambda s: s.id)
                   ELSE CAST([] AS VARCHAR[]) END AS closed,
           CASE WHEN phase = 1 THEN id END AS reply_id, moment_now AS moment, mailbox_now AS mailbox
    FROM (
      SELECT r.user_no, t.n, t.phase, t.id, t.moment AS moment_now, t.mailbox AS mailbox_now, t.recipients, r.open_rows,
             {'id': t.id, 'conv': t.conv, 'mailbox': t.mailbox, 'customer': t.customer, 'lookup': t.lookup, 'moment': t.moment} AS fresh,
             list_filter(r.open_rows, lambda s: s.conv = t.conv) AS in_conv,
             list_filter(r.open_rows, lambda s: list_contains(t.recipients, s.lookup) AND s.moment < t.moment) AS found,
             t.phase = 1 AND len(list_filter(r.open_rows, lambda s: s.conv = t.conv)) = 0 AS fallback
      FROM replay r JOIN timeline t ON t.user_no = r.user_no AND t.n = r.n + 1))""",
    "matches": """
  SELECT unnest(closed) AS sla_id, reply_id, moment AS first_response_at, mailbox AS responded_by, fallback
  FROM replay WHERE len(closed) > 0""",
    "sla_state": """
  SELECT s.*, m.first_response_at, m.reply_id AS response_message_id, m.responded_by,
    CASE WHEN m.first_response_at IS NULL
         THEN CASE WHEN s.sla_deadline_at < TIMESTAMP '2024-01-20' THEN 'BREACHED' ELSE 'WAITING' END
         WHEN m.first_response_at > s.sla_deadline_at THEN 'BREACHED' ELSE 'COMPLETED' END AS status
  FROM sla s LEFT JOIN matches m USING (sla_id)""",
    "queue": """
  SELECT event_id AS id, 'mbx' || (user_id % 10) AS mailbox_user_id, 'm' || event_id AS message_id, status,
    CAST((event_id // 7) % 6 AS INTEGER) AS attempt_count, CAST((event_id // 7) % 4 * 40 AS INTEGER) AS defer_count,
    CASE WHEN status IN ('PENDING', 'FAILED', 'DEFERRED') AND event_id % 9 <> 0
         THEN ts + to_hours(event_id % 11 * 12 - 60) END AS next_attempt_at,
    CASE WHEN status = 'PROCESSING' THEN ts + INTERVAL 5 MINUTE END AS claimed_at,
    CASE WHEN status = 'PROCESSING' THEN 'w' || (event_id % 3) END AS claimed_by,
    CASE WHEN status = 'COMPLETED' THEN ts + INTERVAL 10 MINUTE END AS processed_at,
    CASE WHEN status = 'DEFERRED' THEN ts - to_hours(event_id % 72) END AS first_deferred_at,
    CASE status WHEN 'FAILED' THEN 'TRANSIENT' WHEN 'DEFERRED' THEN 'UNAVAILABLE'
         WHEN 'DEAD_LETTER' THEN CASE WHEN event_id % 2 = 0 THEN 'NON_RETRYABLE' ELSE 'TRANSIENT' END END AS failure_category,
    CASE WHEN status IN ('FAILED', 'DEFERRED', 'DEAD_LETTER') THEN 'err ' || event_id END AS error_message,
    ts AS created_at, ts + to_minutes(event_id % 50) AS updated_at
  FROM (SELECT *, ['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED', 'DEFERRED', 'DEAD_LETTER', 'SKIPPED'][event_id % 7 + 1] AS status
        FROM events)""",
    "queue_outcomes": """
  SELECT event_id AS id, 'run-' || (event_id % 20) AS run_id,
    ['complete', 'fail', 'unavailable', 'release', 'fail', 'start'][k % 6 + 1] AS action,
    'w' || ((CASE WHEN k % 8 = 0 THEN event_id + 1 ELSE event_id END) % 3) AS worker,
    ts + to_minutes(5 + k % 18) AS reported_at,
    CASE k % 9 WHEN 0 THEN 'extraction_non_retryable' WHEN 1 THEN 'provider_unavailable'
      WHEN 2 THEN 'verification_malformed' WHEN 3 THEN 'verification_unavailable' WHEN 4 THEN 'http' END AS kind,
    CASE k % 5 WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 404 ELSE 429 END WHEN 4 THEN 503 END AS http_status,
    CASE WHEN k % 4 = 0 THEN 'Router: No Healthy Deployment left' WHEN k % 4 = 1 THEN '  ' ELSE 'boom' END AS message,
    CASE k % 6 WHEN 0 THEN '120' WHEN 1 THEN ' 30 ' WHEN 2 THEN '-5' WHEN 3 THEN 'Wed, 21 Oct' END AS retry_after
  FROM (SELECT event_id, ts, event_id // 7 AS k FROM events WHERE event_id % 7 = 1)""",
    "feed": f"""
  SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, {_FEED}[event_id % 9 + 1] AS event_type,
    CASE WHEN event_id % 9 < 5 THEN 'TASK' WHEN event_id % 9 < 8 THEN 'SLA' ELSE 'EMAIL_PROCESSING' END AS entity_type,
    CAST(user_id AS VARCHAR) AS entity_id,
    '{{"entityId":"' || user_id || '","step":"' || (event_id % 4) || '"}}' AS payload,
    ['PENDING', 'PROCESSING', 'PUBLISHED'][event_id % 3 + 1] AS status,
    CAST((event_id // 3) % 14 AS INTEGER) AS attempt_count,
    CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN ts + to_seconds(event_id % 60) END AS next_attempt_at,
    CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL 30 SECOND END AS claimed_at,
    CASE WHEN event_id % 3 = 2 THEN ts + INTERVAL 1 MINUTE END AS published_at,
    ts AS created_at
  FROM events""",
}


def _needed(sql: str, seen: list[str]) -> None:
    for name, body in VIEWS.items():
        if name not in seen and re.search(rf"(?:FROM|JOIN)\s+{name}\b", sql):
            seen.append(name)
            _needed(body, seen)


def oracle(body: str) -> str:
    """``body`` preceded by the views it uses, directly or not."""
    needed: list[str] = []
    _needed(body, needed)
    ordered = [v for v in VIEWS if v in needed]
    if not ordered:
        return body
    if body.lstrip().startswith("WITH "):
        body = "," + body.lstrip()[5:]
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in ordered)
    return f"WITH RECURSIVE {views}\n{body}"
