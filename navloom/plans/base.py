"""A catalogue of named queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries are named {name}")
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the function under its own name."""

        def register(f: Query) -> Query:
            self.add(f.__name__, f, sql)
            return f

        return register


def rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def rounded_many(df: DataFrame, **places: int) -> DataFrame:
    """``rounded`` for results of very many rows: Spark rounds a double by its decimal text, which is made here only where a value is large or near the middle of two steps."""

    def plain(c: str, n: int) -> Column:
        size = F.abs(c) * 10.0**n
        steps = F.floor(size + 0.5)
        clear = (size < 1e9) & (F.abs(size - F.floor(size) - 0.5) > 1e-3)
        return F.when(clear, F.when(F.col(c) < 0, -steps).otherwise(steps) / F.lit(10.0**n)).otherwise(F.round(c, n))

    return df.withColumns({c: plain(c, n) for c, n in places.items()})
