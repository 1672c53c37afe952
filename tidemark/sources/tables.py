"""Domain views over the driver's parquet tables.

Each function reads only the columns it needs and derives one table of the data model (tasks, employees,
inbound mail, sent mail, work queue, change feed) with row-wise rules, so every view grows with its input.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.addresses import domain_of, normalize_sender
from ..functions.text import task_fingerprint

# "Now" of each view lies inside its data.
TASKS_AS_OF = datetime(2000, 6, 15, 12)
MAIL_AS_OF = datetime(2024, 1, 20)

OWN_DOMAIN = "org.example"


# Column types of the given tables.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Full scan of one table; the schema is given, so planning reads no file; zone-less times become instants."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")
    naive = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region").select("r_regionkey", "r_name")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    placed = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    rows = placed.selectExpr(
        "o_orderkey AS id",
        """CASE WHEN o_orderkey % 3 = 0 THEN '  REVIEW   contract '
                WHEN o_orderkey % 3 = 1 THEN 'Review Contract' ELSE 'Send invoice, then audit' END AS title""",
        "CASE WHEN o_orderkey % 17 <> 0 THEN concat('Priority ', o_orderpriority) END AS description",
        """CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 3 THEN ''
                WHEN o_custkey % 53 = 5 THEN 'Unassigned'
                ELSE concat('user', o_custkey div 10) END AS assignee""",
        """CASE WHEN o_orderkey % 19 = 0 OR o_custkey % 7 = 0 THEN NULL
                WHEN o_orderkey % 10 < 6 THEN concat('user', o_custkey div 10, '@org.example')
                WHEN o_orderkey % 10 < 8 THEN concat(' User', o_custkey div 10, '@ALT.example ')
                ELSE concat('USER', o_custkey div 10, '@old.example') END AS assignee_email""",
        """CASE WHEN o_orderkey % 11 <> 0
                THEN date_add(trunc(o_orderdate, 'MM'), cast(o_orderkey % 4 * 10 AS int)) END AS due_date""",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH'
                WHEN '5-LOW' THEN 'LOW' ELSE 'MEDIUM' END AS priority""",
        """CASE WHEN o_orderstatus = 'O' THEN if(o_orderkey % 2 = 0, 'NEW', 'IN_PROGRESS')
                WHEN o_orderstatus = 'P' THEN if(o_orderkey % 2 = 0, 'BLOCKED', 'IN_PROGRESS')
                ELSE if(o_orderkey % 2 = 0, 'COMPLETED', 'ARCHIVED') END AS status""",
        "CASE WHEN o_orderkey % 23 <> 0 THEN concat('msg-', o_orderkey div 3) END AS source_email_id",
        "concat('Re: ', c_name) AS source_subject",
        "CASE WHEN o_orderkey % 29 <> 0 THEN concat(' Desk@', c_mktsegment, '.example') END AS source_sender",
        "r_name AS source_mailbox",
        "concat(c_mktsegment, '.example') AS source_domain",
        "CASE o_custkey % 3 WHEN 0 THEN 'INTERNAL' WHEN 1 THEN 'EXTERNAL' END AS source_type",
        "concat('Body of ', o_orderkey) AS source_email_body",
        "CASE WHEN o_orderkey % 5 <> 0 THEN concat('Asked for by ', c_name) END AS ai_reason",
        "timestampadd(MINUTE, cast(o_orderkey % 1440 AS int), o_orderdate) AS created_at",
        "timestampadd(HOUR, cast(o_orderkey % 97 AS int), o_orderdate) AS updated_at",
        """CASE WHEN o_orderkey % 13 <> 0
                THEN timestampadd(HOUR, -cast(o_orderkey % 5 AS int), o_orderdate) END AS email_received_at""",
    )
    # some stored hashes predate the current rule
    current = task_fingerprint()
    stale = F.md5(F.concat_ws("|", F.coalesce("source_email_id", F.lit("")), current))
    return rows.withColumns(
        {
            "normalized_sender": normalize_sender(F.col("source_sender")),
            "task_fingerprint": F.when(F.col("id") % 31 == 0, stale).otherwise(current),
        }
    )


def employees(spark: SparkSession, folder: str) -> DataFrame:
    """Directory rows; every third person has a second spelling, every sixth a third one."""
    # ten customers are one person
    people = table(spark, folder, "customer").selectExpr("c_custkey div 10 AS g").distinct()
    spelled = people.selectExpr(
        "g",
        """explode(filter(array(
             named_struct('n', 0, 'email', concat('user', g, '@org.example'), 'name', concat('user', g)),
             if(g % 3 = 0, named_struct('n', 1, 'email', concat('User', g, '@alt.example'),
                                        'name', concat('User ', g)), NULL),
             if(g % 6 = 0, named_struct('n', 2, 'email', concat('USER', g, '@old.example'),
                                        'name', concat('USER', g)), NULL)), x -> x IS NOT NULL)) AS s""",
    )
    return spelled.selectExpr(
        "g * 3 + s.n AS id",
        "s.name AS name",
        "s.email AS email",
        "CASE WHEN (g + s.n) % 4 <> 0 THEN concat('ms-', g, '-', s.n) END AS microsoft_user_id",
    )


CUSTOMER_ADDRESS = """concat('Cust', user_id, '@', CASE user_id % 5 WHEN 0 THEN 'org.example' WHEN 1 THEN 'gmail.com'
  WHEN 2 THEN 'Outlook.com' WHEN 3 THEN concat('client', user_id % 7, '.example') ELSE 'partner.example' END)"""


def emails(spark: SparkSession, folder: str) -> DataFrame:
    """Inbound mail."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    rows = events.filter("event_type IN ('click', 'view', 'error')").selectExpr(
        "event_id AS position",
        "user_id AS user_no",
        "concat('m', event_id) AS message_id",
        "concat('mbx', user_id % 10) AS mailbox_user_id",
        """CASE WHEN event_id % 13 = 0 THEN NULL WHEN user_id % 3 = 0 THEN concat('c', user_id)
                WHEN user_id % 3 = 1 THEN concat('c', user_id, '-', event_id % 3)
                ELSE concat('c', user_id, '-', event_id) END AS conversation_id""",
        "concat('Customer ', user_id) AS sender_name",
        f"""CASE WHEN event_id % 37 = 0 THEN 'nobody' WHEN event_id % 41 = 0 THEN concat(' ', upper({CUSTOMER_ADDRESS}))
                 ELSE {CUSTOMER_ADDRESS} END AS sender_email""",
        "CASE WHEN event_id % 43 <> 0 THEN concat('Subject ', event_type, ' ', event_id % 9) END AS subject",
        "CASE WHEN event_id % 86 <> 0 THEN concat('Body ', event_id) ELSE '  ' END AS body",
        """CASE WHEN event_id % 101 = 0 THEN 'yesterday'
                ELSE date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") END AS received""",
        "event_type <> 'view' AS response_required",
        "event_type = 'click' AS requires_action",
    )
    return rows.withColumn("sender_domain", domain_of(F.col("sender_email")))


def sent_mail(spark: SparkSession, folder: str) -> DataFrame:
    """Outbound mail."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return events.filter("event_type IN ('purchase', 'signup')").selectExpr(
        "user_id AS user_no",
        "concat('s', event_id) AS reply_id",
        "concat('mbx', if(event_id % 5 = 0, user_id + 1, user_id) % 10) AS mailbox",
        """CASE WHEN event_id % 7 = 0 THEN ' ' WHEN user_id % 3 = 0 AND event_id % 4 <> 0 THEN concat('c', user_id)
                WHEN user_id % 3 = 1 AND event_id % 4 <> 0 THEN concat('c', user_id, '-', event_id % 3)
                ELSE concat('x', event_id) END AS conversation_id""",
        "ts AS sent_at",
        f"""CASE WHEN event_id % 6 = 0 THEN array('other@else.example')
                 ELSE array(upper({CUSTOMER_ADDRESS}), concat(' ', {CUSTOMER_ADDRESS}), NULL, '') END AS recipients""",
    )


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """Work queue snapshot."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return events.selectExpr(
        "*",
        """element_at(array('PENDING', 'PROCESSING', 'COMPLETED', 'FAILED', 'DEFERRED', 'DEAD_LETTER', 'SKIPPED'),
                      cast(event_id % 7 + 1 AS int)) AS status""",
    ).selectExpr(
        "event_id AS id",
        "concat('mbx', user_id % 10) AS mailbox_user_id",
        "concat('m', event_id) AS message_id",
        "status",
        "cast((event_id div 7) % 6 AS int) AS attempt_count",
        "cast((event_id div 7) % 4 * 40 AS int) AS defer_count",
        """CASE WHEN status IN ('PENDING', 'FAILED', 'DEFERRED') AND event_id % 9 <> 0
                THEN timestampadd(HOUR, cast(event_id % 11 * 12 - 60 AS int), ts) END AS next_attempt_at""",
        "CASE WHEN status = 'PROCESSING' THEN timestampadd(MINUTE, 5, ts) END AS claimed_at",
        "CASE WHEN status = 'PROCESSING' THEN concat('w', event_id % 3) END AS claimed_by",
        "CASE WHEN status = 'COMPLETED' THEN timestampadd(MINUTE, 10, ts) END AS processed_at",
        "CASE WHEN status = 'DEFERRED' THEN timestampadd(HOUR, -cast(event_id % 72 AS int), ts) END AS first_deferred_at",
        """CASE status WHEN 'FAILED' THEN 'TRANSIENT' WHEN 'DEFERRED' THEN 'UNAVAILABLE'
                WHEN 'DEAD_LETTER' THEN if(event_id % 2 = 0, 'NON_RETRYABLE', 'TRANSIENT') END AS failure_category""",
        "CASE WHEN status IN ('FAILED', 'DEFERRED', 'DEAD_LETTER') THEN concat('err ', event_id) END AS error_message",
        "ts AS created_at",
        "timestampadd(MINUTE, cast(event_id % 50 AS int), ts) AS updated_at",
    )


def queue_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What workers report for their claims, including late reports and reports of other workers' claims."""
    events = table(spark, folder, "events").select("event_id", "ts").filter("event_id % 7 = 1")
    return events.selectExpr("event_id div 7 AS k", "event_id", "ts").selectExpr(
        "event_id AS id",
        "concat('run-', event_id % 20) AS run_id",
        "element_at(array('complete', 'fail', 'unavailable', 'release', 'fail', 'start'), cast(k % 6 + 1 AS int)) AS action",
        "concat('w', if(k % 8 = 0, event_id + 1, event_id) % 3) AS worker",
        "timestampadd(MINUTE, cast(5 + k % 18 AS int), ts) AS reported_at",
        """CASE k % 9 WHEN 0 THEN 'extraction_non_retryable' WHEN 1 THEN 'provider_unavailable'
                WHEN 2 THEN 'verification_malformed' WHEN 3 THEN 'verification_unavailable'
                WHEN 4 THEN 'http' END AS kind""",
        "cast(CASE k % 5 WHEN 1 THEN if(k % 2 = 0, 404, 429) WHEN 4 THEN 503 END AS int) AS http_status",
        "CASE WHEN k % 4 = 0 THEN 'Router: No Healthy Deployment left' WHEN k % 4 = 1 THEN '  ' ELSE 'boom' END AS message",
        "CASE k % 6 WHEN 0 THEN '120' WHEN 1 THEN ' 30 ' WHEN 2 THEN '-5' WHEN 3 THEN 'Wed, 21 Oct' END AS retry_after",
    )


FEED_TYPES = (
    "TASK_CREATED", "TASK_STATUS_CHANGED", "TASK_PRIORITY_CHANGED", "TASK_ASSIGNEE_CHANGED", "TASK_UPDATED",
    "SLA_CREATED", "SLA_COMPLETED", "SLA_BREACHED", "EMAIL_PROCESSED",
)  # fixed values: change event types


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Change feed snapshot."""
    types = ", ".join(f"'{t}'" for t in FEED_TYPES)
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    return events.selectExpr(
        "concat('e', lpad(cast(event_id AS string), 12, '0')) AS id",
        f"element_at(array({types}), cast(event_id % 9 + 1 AS int)) AS event_type",
        "CASE WHEN event_id % 9 < 5 THEN 'TASK' WHEN event_id % 9 < 8 THEN 'SLA' ELSE 'EMAIL_PROCESSING' END AS entity_type",
        "cast(user_id AS string) AS entity_id",
        """concat('{"entityId":"', user_id, '","step":"', event_id % 4, '"}') AS payload""",
        "element_at(array('PENDING', 'PROCESSING', 'PUBLISHED'), cast(event_id % 3 + 1 AS int)) AS status",
        "cast((event_id div 3) % 14 AS int) AS attempt_count",
        """CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0
                THEN timestampadd(SECOND, cast(event_id % 60 AS int), ts) END AS next_attempt_at""",
        "CASE WHEN event_id % 3 = 1 THEN timestampadd(SECOND, 30, ts) END AS claimed_at",
        "CASE WHEN event_id % 3 = 2 THEN timestampadd(MINUTE, 1, ts) END AS published_at",
        "ts AS created_at",
    )
