"""Pages from stored ranges against an offset over the whole list."""

import random
from datetime import date, datetime, timedelta

import pytest

from tidemark.operators import paging, tasks as tk

COLUMNS = (
    "id bigint, title string, description string, assignee string, due_date date, priority string, status string, source_subject string, "
    "source_sender string, created_at timestamp, updated_at timestamp, email_received_at timestamp"
)


def rows(rnd, n):
    start = datetime(2024, 1, 1)
    for i in rnd.sample(range(n * 3), n):
        at = start + timedelta(hours=rnd.randrange(n // 20 + 1))  # many ties
        due = rnd.choice([None, None, date(2024, 1, 1) + timedelta(days=rnd.randrange(9))])
        yield i, f"t{i}", None, "a", due, rnd.choice(["HIGH", "LOW", "CRITICAL", None]), "NEW", "s", "x", at, at, rnd.choice([None, at])


@pytest.mark.parametrize("sort", ["received-desc", "due-asc", "due-desc", "priority", "recent"])
def test_pages_equal_offset(spark, tmp_path, sort):
    df = spark.createDataFrame(list(rows(random.Random(3), 900)), COLUMNS).cache()
    path = f"{tmp_path}/{sort}"
    paging.store_ranges(df, path, sort, 100)
    for page, size in ((0, 20), (7, 13), (17, 50), (18, 50), (44, 20), (45, 20), (1000, 50)):
        got = paging.stored_page(spark, path, df.schema, page, size, sort)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in tk.task_page(df, page, size, sort).collect()]


def test_a_late_page_reads_its_ranges_only(spark, tmp_path):
    n = 500_500
    df = spark.range(n).selectExpr(
        "id", "concat('t', id) AS title", "CAST(NULL AS string) AS description", "'a' AS assignee", "CAST(NULL AS date) AS due_date", "'LOW' AS priority", "'NEW' AS status",
        "'s' AS source_subject", "'x' AS source_sender", "timestamp_seconds(id div 7) AS created_at", "timestamp_seconds(id) AS updated_at", "CAST(NULL AS timestamp) AS email_received_at",
    )
    path = f"{tmp_path}/late"
    paging.store_ranges(df, path, "received-asc", 20_000)
    found = paging.ranges_of(spark, path, 10_000 * 50, 50)
    assert 1 <= len(found) <= 2
    page = paging.stored_page(spark, path, df.schema, 10_000, 50, "received-asc")
    assert [r["id"] for r in page.collect()] == list(range(500_000, 500_050))
    assert len(page.inputFiles()) <= 2


def test_empty_list(spark, tmp_path):
    df = spark.createDataFrame([], COLUMNS)
    paging.store_ranges(df, f"{tmp_path}/none")
    assert paging.stored_page(spark, f"{tmp_path}/none", df.schema).count() == 0
