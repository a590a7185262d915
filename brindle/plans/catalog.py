"""Registry of queries and their oracle SQL.

A query is registered under its function's name; ``sql`` is DuckDB SQL for the same rows. Queries without it
are beyond SQL (models, state, Unicode forms) and are tested otherwise.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("corpus", "scoring", "metrics", "sweeps", "rules", "entities", "dialogue", "content", "files")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql:
            _ORACLES[key] = sql
        return f

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"brindle.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
