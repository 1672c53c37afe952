"""Word index for the task search: words of the searched columns with the ids that hold them, in ranges of the words' order.

A word prefix is one stretch of that order, so a search reads the files of a few ranges instead of every text. A frequent
word is cut by id into several ranges. Changes are added as generations: postings of the changed rows, and the ids whose
earlier postings no longer count. A generation counts once its commit, written last, is there; writing it again replaces it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_text, search_tokens
from ..session import cut_lineage
from .tasks import SEARCHED

#: Postings of a range, about.
RANGE_POSTINGS = 1_000_000
_POSTINGS = "term string, id bigint, gen int, part int"
_RANGES = "part int, low string, high string, gen int"


def postings(df: DataFrame) -> DataFrame:
    """(term, id): every different word of a row once. Rows without words have no posting; a null id is left out."""
    words = F.array_distinct(F.split(search_text([F.col(c) for c in SEARCHED]), " "))
    return df.filter("id IS NOT NULL").select(F.explode(words).alias("term"), "id").filter("term <> ''")


def store(df: DataFrame, path: str, range_postings: int = RANGE_POSTINGS) -> None:
    """Write the index of all rows as generation 0 below ``path``."""
    _write(postings(df), None, path, 0, range_postings)


def update(changes: DataFrame, path: str, generation: int, range_postings: int = RANGE_POSTINGS) -> None:
    """Add changed rows as a ``generation`` (from 1, rising): the searched columns, ``id`` and ``deleted``, a row per id.

    Work grows with the changes only. ``update(batch, path, batch_id + 1)`` fits ``foreachBatch``.
    """
    if generation < 1:
        raise ValueError("generations of changes start at 1")
    kept = changes.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
    _write(postings(kept), changes.select("id").distinct(), path, generation, range_postings)


def _write(found: DataFrame, changed: DataFrame | None, path: str, generation: int, range_postings: int) -> None:
    spark = found.sparkSession
    held = cut_lineage(found)  # counted, sampled and sorted
    parts = max(1, -(-held.count() // max(1, range_postings)))
    ranged = held.repartitionByRange(parts, "term", "id").withColumn("part", F.spark_partition_id())
    target = f"{path}/postings/gen={generation}"
    ranged.sortWithinPartitions("term", "id").write.mode("overwrite").partitionBy("part").parquet(target)
    written = spark.read.schema("term string, id bigint, part int").parquet(target)
    bounds = written.groupBy("part").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges/gen={generation}")
    if changed is not None:
        changed.write.mode("overwrite").parquet(f"{path}/changed/gen={generation}")
    spark.range(1).select("id").write.mode("overwrite").parquet(f"{path}/commits/gen={generation}")


def _starts(term: Column, token: str) -> Column:
    return F.startswith(term, F.lit(token))


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, gen int").parquet(f"{path}/commits").select("gen")


def _live(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows (id, gen) that no later committed generation has replaced."""
    commits = _commits(spark, path)
    if commits.filter("gen > 0").isEmpty():
        return rows
    changed = spark.read.schema("id bigint, gen int").parquet(f"{path}/changed").join(commits, "gen", "left_semi")
    newest = changed.groupBy("id").agg(F.max("gen").alias("_newest"))
    return rows.join(newest, "id", "left").filter(F.col("gen") >= F.coalesce("_newest", F.lit(0)))


def ranges_of(spark: SparkSession, path: str, tokens: list[str]) -> list[tuple[int, int, int]]:
    """(generation, first range, last range) that hold words beginning with a token; a row per token and generation."""
    ranges = spark.read.schema(_RANGES).parquet(f"{path}/ranges").join(_commits(spark, path), "gen", "left_semi")
    token = F.explode(F.array(*map(F.lit, tokens))).alias("token")
    # words with a prefix lie between the prefix itself and the last word that begins with it
    holds = (F.col("high") >= F.col("token")) & ((F.col("low") < F.col("token")) | F.startswith("low", "token"))
    found = ranges.select("*", token).filter(holds).groupBy("gen", "token").agg(F.min("part").alias("a"), F.max("part").alias("z"))
    return sorted({(r["gen"], r["a"], r["z"]) for r in found.collect()})


def hits(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """Postings (term, id, gen) of the ranges that hold a token's words, only words that begin with a token."""
    wanted = [(F.col("gen") == g) & F.col("part").between(a, z) for g, a, z in ranges_of(spark, path, tokens)]
    read = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
    begins = reduce(Column.__or__, [_starts(F.col("term"), t) for t in tokens])
    return read.filter(reduce(Column.__or__, wanted, F.lit(False))).filter(begins).select("term", "id", "gen")


def matching_ids(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Ids of the rows in which every token of ``query`` begins some word; none for a query without token."""
    tokens = search_tokens(query)
    if not tokens:
        return spark.createDataFrame([], "id bigint")
    found = (
        hits(spark, path, tokens)
        .groupBy("id", "gen")
        .agg(*(F.bool_or(_starts(F.col("term"), t)).alias(f"_{i}") for i, t in enumerate(tokens)))
        .filter(" AND ".join(f"_{i}" for i in range(len(tokens))))
    )
    found = _live(spark, path, found)
    return found.select("id")


def search(df: DataFrame, path: str, query: str | None) -> DataFrame:
    """The rows of ``df`` that the scan of :func:`tasks.filter_tasks` would find, through the index of ``df``."""
    if search_tokens(query) is None:
        return df
    return df.join(matching_ids(df.sparkSession, path, query), "id", "left_semi")


def compact(spark: SparkSession, path: str, target: str, range_postings: int = RANGE_POSTINGS) -> None:
    """Write the postings that count as generation 0 of a new index below ``target``."""
    held = spark.read.schema(_POSTINGS).parquet(f"{path}/postings").join(_commits(spark, path), "gen", "left_semi")
    _write(_live(spark, path, held).select("term", "id"), None, target, 0, range_postings)
