"""Names, callables and outside SQL of the library's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.virtual import BASE_SQL, Virtual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a Virtual ensemble, with SQL over the base tables where there is any."""

    def add(f: Callable[[Virtual], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Virtual(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            text = sql.strip()
            SQL[name] = BASE_SQL + (text if text.upper().startswith("SELECT") or text.startswith("(") else "," + text)
        return f

    return add
