"""Ordered per-key computations that do not put a whole key into one task.

A key's timeline is cut into buckets (for example hours). Totals per (key, bucket) are pre-aggregated and carried
forward over the few rows that remain per key, and only the rows of one bucket are ordered together. Cost is linear
in the rows, whatever the size of the largest key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def hour_of(moment: Column) -> Column:
    return F.floor(F.unix_micros(moment) / 3_600_000_000).cast("bigint")


def spread_nulls(key: Column, rows: DataFrame) -> Column:
    """``key`` for an outer join, with nulls replaced by texts that match nothing.

    Null keys never match, but hashing would send all of them to one task. The replacement is made of the first column
    of ``rows``, the one that identifies them, so that no other column is read for it.
    """
    return F.coalesce(key, F.concat(F.lit("\u0000"), F.xxhash64(rows.columns[0]).cast("string")))


def rank_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "_rank") -> DataFrame:
    """The first ``k`` rows per key in ``order``.

    Spark turns the filter on ``row_number`` into a limit per key before the shuffle as well, so at most ``k`` rows
    per key leave each map task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return rank_first(df, keys, order, 1).drop("_rank")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column] | None = None,
    xors: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums and running exclusive-ors per key.

    ``bucket`` must not decrease along ``order`` and keys must not be null.
    """
    sums, xors = dict(sums or {}), dict(xors or {})
    cut = df.withColumn(BUCKET, bucket)
    per_bucket = cut.groupBy(*keys, BUCKET).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.bit_xor(c).alias(n) for n, c in xors.items()]
    )
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.coalesce(F.bit_xor(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in xors],
    )
    within = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns(
        {n: F.sum(c).over(within) for n, c in sums.items()} | {n: F.bit_xor(c).over(within) for n, c in xors.items()}
    )
    joined = inside.join(carried, [*keys, BUCKET])
    totals = {n: F.col(n) + F.col(f"_before_{n}") for n in sums}
    totals |= {n: F.col(n).bitwiseXOR(F.col(f"_before_{n}")) for n in xors}
    return joined.withColumns(totals).drop(BUCKET, *[f"_before_{n}" for n in (*sums, *xors)])


def next_value(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Add, per row, the first non-null ``value`` of the rows after it in ``order`` (as-of join, looking forward).

    ``value`` must itself sort along ``order``, so that the earliest one of a bucket is its minimum.
    """
    # frames run backwards: "unbounded following" frames are recomputed per row, "unbounded preceding" ones are not
    backwards = [F.desc(c) for c in order]
    cut = df.withColumns({BUCKET: bucket, "_value": value})
    firsts = cut.groupBy(*keys, BUCKET).agg(F.min("_value").alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carried = firsts.select(*keys, BUCKET, F.last("_first", ignorenulls=True).over(later).alias("_later"))
    after = Window.partitionBy(*keys, BUCKET).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn("_inside", F.last("_value", ignorenulls=True).over(after))
    joined = inside.join(carried, [*keys, BUCKET])
    return joined.withColumn(name, F.coalesce("_inside", "_later")).drop(BUCKET, "_value", "_inside", "_later")
