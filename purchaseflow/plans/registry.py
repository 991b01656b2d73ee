"""All queries of the library proper, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("reports", "jobs", "ledger", "documents")


def query(name: str, sql: str | None = None):
    """Registers a function (spark, folder) under ``name``."""

    def add(function):
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"purchaseflow.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
