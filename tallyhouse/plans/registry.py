"""All queries of the library and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = ("usage_queries", "ledger_queries", "acceptance_queries", "evidence_queries", "receipt_queries", "source_queries", "landed_queries", "analytics_queries", "panel_queries", "stream_queries")


def register(name: str, query: Query, sql: str | None = None) -> None:
    """Add a query; without SQL it is only run."""
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tallyhouse.plans.{module}")


def queries() -> dict[str, Query]:
    """Name -> (spark, sf_dir) -> DataFrame."""
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL."""
    _load()
    return dict(_sql)
