"""The registry of queries, and helpers for writing their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, of: Callable[[str], str] | None = None):
    """Registers a query with its SQL; of puts the fixtures' common tables before it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = of(sql) if of else sql
        return f

    return add


cat, scan, res, words = fx.with_fixtures, lambda s: fx.with_fixtures(s, scans=True), fx.with_results, fx.with_words


def quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(quote, values))


def cases(value: str, pairs) -> str:
    """CASE of value with a branch for each pair; NULL where there is none."""
    return f"CASE {value} " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in pairs) + " END"
