"""All queries by name, and the SQL that states the same rows for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import catalog_queries, chunk_queries, event_queries, retrieval_queries, sql_queries

_MODULES = (sql_queries, chunk_queries, retrieval_queries, catalog_queries, event_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
