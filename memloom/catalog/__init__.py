"""Registered queries over the test tables with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Tables that one call of a registered query has built, by name; nothing outlives the call.
BUILT: ContextVar[dict[str, DataFrame]] = ContextVar("built")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, the SQL that must give the same rows."""
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            token = BUILT.set({})
            try:
                return function(spark, folder)
            finally:
                BUILT.reset(token)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    import importlib

    for module in MODULES:
        importlib.import_module(f"memloom.catalog.{module}")


MODULES = [
    "nodes", "edges", "hierarchy", "retrieval", "expansion", "metrics", "temporal", "packs", "features", "cards", "sources", "streams",
]
