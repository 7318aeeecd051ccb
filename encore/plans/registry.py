"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus their DuckDB oracle SQL.

Each query reads the curated plays table built from the given star-schema tables (or the
``events`` table for sessions), so its work grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from encore.sources import curated

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated.plays(spark, sf_dir)


# Importing the modules registers their queries.
from encore.plans import q_core, q_more, q_reports  # noqa: E402,F401,I001
