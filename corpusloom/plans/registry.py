"""Registered queries and their SQL twins. Every module below adds its own with ``@query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    """Register a query under ``name``; ``twin`` is the equivalent SQL over the same tables."""

    def add(job):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = job
        if twin is not None:
            TWINS[name] = twin
        return job

    return add


SPREAD_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; text tables in too few pieces are spread over the cores."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(frame) if name in SPREAD_TABLES else frame


def sql_text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in ("corpus", "knowledge", "lexicon", "pages", "quality", "catalog", "streams"):
        importlib.import_module(f"corpusloom.plans.{name}")
