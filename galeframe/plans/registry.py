"""Where the catalogue's modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of (spark, sf_dir), and the SQL that it must equal."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is there twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, so that sums in another order give the same value; without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)
