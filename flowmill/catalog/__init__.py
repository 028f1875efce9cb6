"""Registered queries: a Spark callable per operator and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from flowmill.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> None:
    for module in ("ingest", "quality", "metrics", "split", "compare", "generate", "privacy",
                   "models", "streams"):
        import_module(f"flowmill.catalog.{module}")
