"""Registration of queries, and rounding shared with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldshift.catalog.sqlbook import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query and, when SQL can express it, its oracle.

    ``views`` names the shared SQL views the statement uses.
    """

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views.split())
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Six decimals, minus zero folded into zero; ``rnd()`` in the SQL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})
