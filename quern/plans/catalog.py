"""The registry of queries: a function of the fixture each, with its SQL where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans.fixture import Fixture, sql

_QUERIES: dict[str, Callable[[Fixture], DataFrame]] = {}
_SQL: dict[str, str] = {}
MODULES = ("facts", "search", "graph", "context", "sessions", "sources", "flow", "retention")


def query(text: str | None = None):
    def register(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
        _QUERIES[f.__name__] = f
        if text is not None:
            _SQL[f.__name__] = sql(text)
        return f

    return register


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"quern.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: lambda spark, sf_dir, f=f: f(Fixture(spark, sf_dir)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
