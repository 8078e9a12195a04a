"""A registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 6):
    """df with doubles rounded, as value comparisons want it."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.round(c, digits) for c in columns})
