"""Query name to (DataFrame function, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under its name, with its DuckDB SQL if any."""

    def add(f):
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries; they import this one, so not before it is whole."""
    for m in ("accuracy", "geometry", "retrieval", "calibration", "captions", "jobs"):
        import_module(f"overfly.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
