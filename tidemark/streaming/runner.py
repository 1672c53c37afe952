"""Shared pieces of the streaming jobs: sources, one-shot runs and replay-safe sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.landing import PAGE_SCHEMA


def page_stream(spark: SparkSession, folder: str, pages_per_batch: int = 1000) -> DataFrame:
    """Landed JSON pages as they arrive. The checkpoint of the query takes the place of feed links."""
    return (
        spark.readStream.schema(PAGE_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", pages_per_batch)
        .json(folder)
    )


def table_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything that has landed, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def batch_folder_sink(target: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """``foreachBatch`` function that writes each batch to its own folder.

    A batch that is run again after a failure overwrites its folder, so every batch counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={batch_id}")

    return write


def ledger_sink(target: str, prepare: Callable[[DataFrame, DataFrame | None], DataFrame]):
    """Like :func:`batch_folder_sink`, but ``prepare`` also gets the rows of all earlier batches (None at first).

    Only earlier batches are shown, so a batch that is run again sees what it saw the first time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        earlier = batch.sparkSession.read.parquet(target).filter(F.col("batch_id") < batch_id) if batch_id else None
        rows = prepare(batch, earlier.drop("batch_id") if earlier is not None else None)
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={batch_id}")

    return write


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch_id")


def land_texts(texts: DataFrame, folder: str) -> None:
    """Write JSON texts as files of a landing folder."""
    texts.select(F.col("page").alias("value")).write.mode("append").text(folder)
