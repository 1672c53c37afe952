"""Registered query that walks the feeds of all mailboxes in several runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import walks
from ..session import cut_lineage
from ..sources import landing
from ..sources import tables as tb
from .mail_queries import _KNOWN, _LANDED, BOUNDARY
from .registry import Registry
from .views_sql import parse_instant

registry = Registry()

#: Pages of a mailbox at most; a walk of them takes three runs of five.
PAGES = 12
RUNS = 3
#: The page that one mailbox in five fails to get in the second run.
BROKEN = 7

# by the mailbox's number: 1 goes on from a delta link, 2 from an open walk, 3 from an expired token, 4 meets a broken page
_START = "CASE kind WHEN 1 THEN least(2, n - 1) WHEN 2 THEN least(4, n - 1) ELSE 0 END"
_KIND = "CAST(substr(mailbox_user_id, 4) AS INTEGER) % 5"


def _feed(spark, d):
    """Pages with links, and the links each mailbox starts from."""
    last = tb.emails(spark, d).agg(F.max("position")).first()[0]
    numbered = landing.numbered_pages(spark, d, (last or 0) // PAGES + 1)
    order = Window.partitionBy("user_id").orderBy("page_no")  # a dozen pages a mailbox
    typed = numbered.select(
        F.col("user_id").alias("mailbox_user_id"),
        (F.row_number().over(order) - 1).alias("i"),
        F.from_json("page", landing.PAGE_SCHEMA)["value"].alias("value"),
        F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"),
    )
    typed = cut_lineage(typed)

    def link(i):
        return F.when(i > 0, F.concat(F.lit("p"), i.cast("string")))

    more = F.col("i") + 1 < F.col("n")
    pages = typed.select(
        "mailbox_user_id",
        link(F.col("i")).alias("link"),
        F.lit(200).alias("status"),
        "value",
        F.when(more, link(F.col("i") + 1)).alias("next_link"),
        F.when(~more, "end").alias("delta_link"),
    )
    boxes = typed.groupBy("mailbox_user_id").agg(F.first("n").alias("n")).withColumn("kind", F.expr(_KIND))
    none = F.array().cast(typed.schema["value"].dataType)
    extra = boxes.select(
        "mailbox_user_id",
        F.explode(
            F.array(
                F.struct(F.lit("end").alias("link"), F.lit(200).alias("status"), F.lit("end").alias("delta_link")),
                F.struct(F.lit("gone").alias("link"), F.lit(walks.EXPIRED).alias("status"), F.lit(None).cast("string").alias("delta_link")),
            )
        ).alias("e"),
    ).select("mailbox_user_id", "e.link", "e.status", none.alias("value"), F.lit(None).cast("string").alias("next_link"), "e.delta_link")
    start = link(F.expr(_START))
    links = boxes.filter("kind IN (1, 2, 3)").select(
        "mailbox_user_id",
        F.when(F.col("kind") == 1, start).when(F.col("kind") == 2, "old").otherwise("gone").alias("delta_link"),
        F.when(F.col("kind") == 2, start).alias("next_link"),
    )
    return pages.unionByName(extra), boxes, links


@registry.add(
    f"""WITH landed AS (SELECT *, {_KIND} AS kind, position // (max(position) OVER () // {PAGES} + 1) AS page_no
                        FROM (SELECT * FROM (SELECT mailbox_user_id, position FROM emails) LEFT JOIN (SELECT position, message_id, received, removed FROM {_LANDED}) USING (position))),
        page AS (SELECT *, dense_rank() OVER (PARTITION BY mailbox_user_id ORDER BY page_no) - 1 AS i FROM landed),
        box AS (SELECT mailbox_user_id, kind, max(i) + 1 AS n FROM page GROUP BY ALL),
        reach AS (SELECT *, {_START} AS s, kind = 4 AND n > {BROKEN} AS broken FROM box),
        walked AS (SELECT *, least(n - s, CASE WHEN broken THEN 12 ELSE 15 END) AS data FROM reach),
        told AS (SELECT mailbox_user_id, message_id, removed, (mailbox_user_id, message_id) IN ({_KNOWN}) AS stored, {parse_instant('received')} > TIMESTAMP '{BOUNDARY}' AS recent
                 FROM page JOIN walked USING (mailbox_user_id) WHERE message_id IS NOT NULL AND i >= s AND i < s + data)
        SELECT mailbox_user_id, CASE WHEN n - s <= 5 THEN 'ADVANCED' ELSE 'CUT' END || ',' ||
            CASE WHEN n - s <= 5 THEN 'ADVANCED' WHEN broken THEN 'FAILED' WHEN n - s <= 10 THEN 'ADVANCED' ELSE 'CUT' END || ',' ||
            CASE WHEN data = n - s THEN 'ADVANCED' ELSE 'CUT' END AS outcomes,
          CASE WHEN data = n - s THEN 'end' WHEN kind = 1 THEN 'p' || s WHEN kind = 2 THEN 'old' END AS delta_link,
          CASE WHEN data < n - s THEN 'p' || (s + data) END AS next_link,
          CAST(data + CASE WHEN n - s <= 5 THEN 2 WHEN n - s <= 10 AND NOT broken THEN 1 ELSE 0 END AS BIGINT) AS pages,
          CAST(CASE WHEN kind = 3 THEN 1 ELSE 0 END AS BIGINT) AS resets,
          (SELECT count(*) FROM told t WHERE t.mailbox_user_id = w.mailbox_user_id AND NOT removed AND recent AND NOT stored) AS registered,
          (SELECT count(*) FROM told t WHERE t.mailbox_user_id = w.mailbox_user_id AND removed AND stored) AS skipped
        FROM walked w"""
)
def mailbox_walks(spark, d):
    """Three runs of at most five pages a mailbox: cut off and resumed, reset after an expiry, failing in the second run."""
    pages, boxes, links = _feed(spark, d)
    broken = (F.col("link") == f"p{BROKEN}") & (F.expr(_KIND) == 4)
    down = pages.withColumn("status", F.when(broken, 503).otherwise(F.col("status")))
    stored = tb.queue(spark, d).filter("id % 3 = 0").select("mailbox_user_id", "message_id")
    runs, told = [], []
    for run in range(RUNS):
        read, rows = walks.walk(boxes, links, walks.fetch_from(down if run == 1 else pages))
        asked = cut_lineage(walks.found(read, BOUNDARY, stored))
        stored = stored.unionByName(asked.filter("NOT removed").drop("removed"))
        links = rows.select("mailbox_user_id", "delta_link", "next_link")
        runs.append(rows.withColumn("run", F.lit(run)))
        told.append(asked)
    every, asked = runs[0], told[0]
    for rows, keys in zip(runs[1:], told[1:]):
        every, asked = every.unionByName(rows), asked.unionByName(keys)
    counts = asked.groupBy("mailbox_user_id").agg(
        F.count_if(~F.col("removed")).alias("registered"), F.count_if("removed").alias("skipped")
    )
    log = F.array_sort(F.collect_list(F.struct("run", "outcome", "delta_link", "next_link")))  # one of each run
    summed = every.groupBy("mailbox_user_id").agg(log.alias("log"), F.sum("pages").alias("pages"), F.sum("resets").alias("resets"))
    return summed.join(counts, "mailbox_user_id", "left").select(
        "mailbox_user_id",
        F.array_join("log.outcome", ",").alias("outcomes"),
        F.element_at("log", -1)["delta_link"].alias("delta_link"),
        F.element_at("log", -1)["next_link"].alias("next_link"),
        "pages",
        "resets",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("registered", "skipped")),
    )
