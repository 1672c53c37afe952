"""Landed JSON pages of the mail and directory feeds, and file sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

ADDRESS_TYPE = "struct<emailAddress: struct<name: string, address: string>>"
MESSAGE_TYPE = (
    "struct<id: string, subject: string, receivedDateTime: string, bodyPreview: string, conversationId: string, "
    f"body: struct<content: string>, `from`: {ADDRESS_TYPE}, toRecipients: array<{ADDRESS_TYPE}>, "
    f"ccRecipients: array<{ADDRESS_TYPE}>, `@removed`: struct<reason: string>>"
)
PAGE_SCHEMA = f"user_id string, value array<{MESSAGE_TYPE}>"
USER_PAGE_SCHEMA = "value array<struct<id: string, displayName: string, mail: string, userPrincipalName: string>>"


def read_pages(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA) -> DataFrame:
    """Landed pages, one JSON object per line; fields that are absent become null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def parse_pages(texts: DataFrame, schema: str = PAGE_SCHEMA) -> DataFrame:
    """The same from a text column ``page``."""
    return texts.select(F.from_json("page", schema, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")


def _address(name: str, address: str) -> str:
    return f"named_struct('emailAddress', named_struct('name', {name}, 'address', {address}))"


def mail_pages(spark: SparkSession, folder: str, per_page: int = 250) -> DataFrame:
    """The inbound mail as JSON page texts of at most ``per_page`` position numbers each."""
    return numbered_pages(spark, folder, per_page).select("page")


def numbered_pages(spark: SparkSession, folder: str, per_page: int) -> DataFrame:
    """The same with the mailbox and the number of each page; numbers rise, but may leave gaps."""
    mail = tables.emails(spark, folder)
    message = mail.selectExpr(
        "mailbox_user_id AS user_id",
        f"position div {per_page} AS page_no",
        f"""named_struct(
              'id', if(position % 67 = 0, ' ', message_id), 'subject', subject, 'receivedDateTime', received,
              'bodyPreview', concat('Preview ', position), 'conversationId', conversation_id,
              'body', named_struct('content', if(position % 5 = 0, '', concat('<p>', body, '</p><b>x</b>y'))),
              'from', {_address('sender_name', 'sender_email')},
              'toRecipients', array({_address("concat('Desk ', position % 4)", "concat(mailbox_user_id, '@org.example')")}),
              'ccRecipients', if(position % 5 = 1, array({_address("''", "'cc@org.example'")}, {_address("'x'", "' '")}), NULL),
              '@removed', if(position % 59 = 0, named_struct('reason', 'deleted'), NULL)) AS message""",
    )
    # a page holds a bounded number of messages
    return message.groupBy("user_id", "page_no").agg(
        F.to_json(F.struct("user_id", F.collect_list("message").alias("value"))).alias("page")
    )


def directory_pages(spark: SparkSession, folder: str, per_page: int = 100) -> DataFrame:
    """The customers as JSON page texts of a people directory."""
    people = tables.table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    person = people.selectExpr(
        f"c_custkey div {per_page} AS page_no",
        """named_struct('id', if(c_custkey % 50 = 7, ' ', concat('ms-', c_custkey div 10, '-', c_custkey % 10)),
              'displayName', c_name,
              'mail', CASE WHEN c_custkey % 4 = 1 THEN ' ' WHEN c_custkey % 4 <> 2
                           THEN concat(' User', c_custkey div 10, '@org.example') END,
              'userPrincipalName', CASE WHEN c_custkey % 8 <> 1
                           THEN concat('p', c_custkey, '@org.example') END) AS person""",
    )
    return person.groupBy("page_no").agg(
        F.to_json(F.struct(F.collect_list("person").alias("value"))).alias("page")
    ).select("page")


def write_export(rows: DataFrame, path: str) -> None:
    """Exported sheet as CSV files with a header; written in parallel."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_pending(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """Tasks without a successful export."""
    return tasks.join(log.filter("error IS NULL").select(F.col("task_id").alias("id")), "id", "left_anti")


def export_state(log: DataFrame) -> DataFrame:
    """Per task: exported or not, last error (at most 1000 characters), attempts, last attempt."""
    last = F.max_by(F.substring("error", 1, 1000), F.struct("attempted_at", "seq"))
    return log.groupBy("task_id").agg(
        F.coalesce(F.bool_or(F.col("error").isNull()), F.lit(False)).alias("exported"),
        F.when(F.count_if(F.col("error").isNull()) == 0, last).alias("export_error"),
        F.count(F.lit(1)).alias("attempts"),
        F.max("attempted_at").alias("last_attempt_at"),
    )


def export_result(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
