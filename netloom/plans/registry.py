"""Registry of queries over the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def attach(name: str, sql: str) -> None:
    """The SQL of a query that another module registers."""
    SQL[name] = sql


def load() -> None:
    """Imports the modules whose queries register themselves."""
    from netloom.plans import coords, corpus, drawn, evaluation, files, forests, graphs, skew, texts, tools, vectors  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
