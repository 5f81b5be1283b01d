"""Registration of queries with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(codes: Column | str, sep: str = "|") -> Column:
    """An array as one string."""
    return F.array_join(codes, sep)


def nested(lists: Column | str) -> Column:
    """An array of arrays as one string."""
    return F.array_join(F.transform(lists, lambda x: F.array_join(x, "|")), ";")
