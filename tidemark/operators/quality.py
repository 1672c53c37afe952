"""Data-quality guards: how many groups or rows violate a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import local_part
from .dedup import GROUP, scoped_active, with_current_hash


class GuardViolation(RuntimeError):
    """A guard found violating groups."""


def repeated_keys(df: DataFrame, keys: Sequence[str], name: str, nulls_differ: bool = True) -> DataFrame:
    """Number of keys held by more than one row. As in a unique index, nulls differ, unless told otherwise."""
    whole = df.dropna(subset=list(keys)) if nulls_differ else df
    return _count(whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), name)


def outside_values(df: DataFrame, column: str, accepted: Sequence[str], name: str) -> DataFrame:
    """Number of rows whose value is not an accepted one; null passes."""
    return _count(df.filter(~F.col(column).isin(*accepted)), name)


def _count(bad: DataFrame, name: str) -> DataFrame:
    return bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def active_duplicates(tasks: DataFrame) -> DataFrame:
    return repeated_keys(scoped_active(tasks), GROUP, "active_duplicates", nulls_differ=False)


def recomputed_collisions(tasks: DataFrame) -> DataFrame:
    return repeated_keys(scoped_active(with_current_hash(tasks)), GROUP, "recomputed_collisions", nulls_differ=False)


def shared_names(employees: DataFrame) -> DataFrame:
    keyed = employees.select(local_part(F.col("email")).alias("canonical_key"))
    return repeated_keys(keyed, ["canonical_key"], "shared_names", nulls_differ=False)


def unique_checks(tables: Mapping[str, tuple[DataFrame, Sequence[str | Column]]]) -> DataFrame:
    """Repeated-key counts of several tables in one report."""
    checks = []
    for name, (df, keys) in tables.items():
        keyed = df.select(*[F.col(k) if isinstance(k, str) else k for k in keys])
        checks.append(repeated_keys(keyed, keyed.columns, name))
    return reduce(DataFrame.unionByName, checks)


def require_clean(report: DataFrame) -> None:
    """Stop the job when a guard found something. The report has one row per guard."""
    broken = report.filter("violations > 0").collect()
    if broken:
        raise GuardViolation("; ".join(f"{r['check_name']}: {r['violations']}" for r in broken))
