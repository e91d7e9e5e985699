"""Named queries with the SQL that a second engine can check them by."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            @functools.wraps(f)
            def run(spark: SparkSession, d: str) -> DataFrame:
                ship(spark)
                return f(spark, d)

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return add


core = Registry()
