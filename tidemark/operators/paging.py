"""Late pages of an ordered list: the list is stored in ranges of its order, with the number of rows before each range.

A page then reads the one or two ranges that hold it and orders only these, however far down the list it lies. Storing costs
one range exchange; it serves every page until it is written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tasks import LIST_COLUMNS, clamp, page_order

RANGE_ROWS = 100_000


def store_ranges(df: DataFrame, path: str, sort: str = "received-desc", range_rows: int = RANGE_ROWS) -> None:
    """Write ``df`` below the fresh ``path`` in ranges of about ``range_rows`` rows of the order ``sort``.

    The orders end with the id, so ranges of equal dates are cut as well. An empty list has no range.
    """
    count = max(1, -(-df.count() // max(1, range_rows)))
    order = page_order(sort)
    ranged = df.repartitionByRange(count, *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    ranged.write.partitionBy("part").parquet(f"{path}/rows")
    spark = df.sparkSession
    stored = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
    sizes = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges")


def ranges_of(spark: SparkSession, path: str, first: int, size: int) -> list[tuple[int, int]]:
    """(part, number of its first row) of the ranges that hold the rows from ``first`` on."""
    sizes = spark.read.schema("part int, n bigint, first bigint").parquet(f"{path}/ranges")
    found = sizes.filter((F.col("first") < first + size) & (F.col("first") + F.col("n") > first)).orderBy("part")
    return [(r["part"], r["first"]) for r in found.collect()]  # a page of at most 50 rows lies in as many ranges at most


def stored_page(spark: SparkSession, path: str, schema: T.StructType, page: int = 0, size: int = 20, sort: str = "received-desc") -> DataFrame:
    """One page of the stored list (``schema``: that of the stored rows), the same as that of :func:`tasks.task_page`."""
    page, size = max(page, 0), clamp(size, 1, 50)
    parts = ranges_of(spark, path, page * size, size)
    if not parts:
        return spark.createDataFrame([], schema).select(*LIST_COLUMNS)
    held = spark.read.schema(schema).parquet(*(f"{path}/rows/part={p}" for p, _ in parts))
    return held.orderBy(*page_order(sort)).offset(page * size - parts[0][1]).limit(size).select(*LIST_COLUMNS)
