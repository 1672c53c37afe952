"""Named queries over a folder of driver tables, each with its SQL oracle where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from .views_sql import oracle

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)
    #: Oracles as they were given, without the views they use.
    bodies: dict[str, str] = field(default_factory=dict)
    #: Oracles built from other queries' ones.
    late: dict[str, Callable[[], str]] = field(default_factory=dict)

    def add(self, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
        """Register the decorated query under its function name; a function gives SQL that builds on other queries'."""

        def register(fn: Query) -> Query:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                return zone_free(fn(configure(spark), folder))

            self.queries[fn.__name__] = run
            if callable(sql):
                self.late[fn.__name__] = sql
            elif sql is not None:
                self.bodies[fn.__name__] = sql
                self.oracles[fn.__name__] = oracle(sql)
            return fn

        return register

    def merge(self, other: Registry) -> None:
        self.queries.update(other.queries)
        self.oracles.update(other.oracles)
        self.oracles.update({name: oracle(sql()) for name, sql in other.late.items()})


def zone_free(df: DataFrame) -> DataFrame:
    """Result times as UTC wall-clock times and result dates as ISO text, the forms the SQL oracles return."""
    forms = {"timestamp": "timestamp_ntz", "date": "string"}
    plain = {f.name: F.col(f.name).cast(forms[t]) for f in df.schema if (t := f.dataType.typeName()) in forms}
    return df.withColumns(plain) if plain else df
