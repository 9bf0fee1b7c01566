"""Names of the queries, their callables, and equal statements for a second engine."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers ``f(spark, sf_dir)`` under its name; ``sql`` gives the same rows."""

    def register(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return register
