"""The register of queries: a function of Slides, and the equivalent SQL over the same relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.fixtures import Slides, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a function of Slides under its name, with its oracle: the views that the SQL names are added."""

    def add(f: Callable[[Slides], DataFrame]) -> Callable[[Slides], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Slides(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add
