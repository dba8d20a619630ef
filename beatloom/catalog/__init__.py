"""Registered queries: each runs one operator over the given tables and, where
SQL can say the same, carries the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beatloom.fixtures import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with its checking SQL."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn

    return wrap


def load_all() -> None:
    from beatloom.catalog import (  # noqa: F401
        beats_q,
        evaluation_q,
        hrv_q,
        joins_q,
        labels_q,
        models_q,
        tables_q,
        waves_q,
    )
