"""Registered queries: a callable on the inputs, and the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Inputs, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of :class:`Inputs`. ``ctes`` are further ``with`` items of the SQL text."""

    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if sql is not None:
            items = [part for part in (with_clause(ctes + " " + sql), ctes.strip()) if part]
            ORACLES[name] = (f"with {', '.join(items)}\n" if items else "") + sql.strip()
        return build

    return register
