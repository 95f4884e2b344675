"""Query catalogue: every registered query takes ``(spark, sf_dir)`` and
returns a DataFrame over the driver tables; most also carry the DuckDB SQL
that must give the same rows (``oracle_sql``)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

_FAMILIES = ("ingest_queries", "feature_queries", "clean_queries", "profile_queries",
             "split_queries", "model_queries", "stream_queries", "missing_queries", "series_queries")


def register(key: str, sql: str | None = None):
    """Decorator: add a query (and optionally its oracle SQL) to the catalogue."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = fn
        if sql is not None:
            _ORACLES[key] = sql
        return fn
    return deco


def _load() -> None:
    for fam in _FAMILIES:
        importlib.import_module(f"{__package__}.{fam}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
