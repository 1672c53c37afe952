"""Helpers of the training-data operators: shared scratch tables, Arrow columns, even dealing by id."""

from __future__ import annotations

import bisect
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure


def prepared(spark: SparkSession) -> SparkSession:
    """The library's settings, and batches for Python that stay small although each row holds a whole text."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, as in tests, a temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.conf.get("tidemark.scratch", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-llm-")
        spark.conf.set("tidemark.scratch", named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns of ``docs``, under their own names whatever else the table holds."""
    return docs.select(*(docs[c] for c in columns))


def carrying(docs: DataFrame, carried: tuple[str, ...]) -> tuple[DataFrame, list[T.StructField]]:
    """The carried columns as c0, c1, ... and the text, so that no name of theirs meets one of ours; and their fields."""
    chosen = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(carried)), docs["text"].alias("text"))
    return chosen, list(chosen.schema)[:-1]


def batches_of(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about ``most_bytes`` each; a longer single text makes one slice."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    first = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if batch.num_rows > first:
        yield batch.slice(first)


def parts_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut_points(ids: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that cut the column into even ranges; reads that column alone."""
    shares = [i / parts for i in range(1, parts)]
    if not shares:
        return []
    row = ids.agg(F.percentile_approx(column, shares, 20_000).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def range_number(column: Column, cuts: list[int]) -> Column:
    """Number of cut points that are not above the value; nulls come first, in range 0."""
    if not cuts:
        return F.lit(0)
    # a balanced tree of comparisons: logarithmic per row
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(column.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def range_of(value: int, cuts: list[int]) -> int:
    """``range_number`` of one value on the driver."""
    return bisect.bisect_right(cuts, value)
