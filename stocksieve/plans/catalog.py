"""Registry of named queries and their independent SQL oracles.

``query(name, oracle)`` registers a callable ``(spark, sf_dir) -> DataFrame``;
``oracle`` is ANSI SQL for DuckDB over the driver tables (or ``None`` for a
query with no SQL twin, checked by row count and by brute-force tests).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco
