"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventide.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Doubles are compared at this many decimals.
DECIMALS = 6


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package()
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(c: Column | str) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, DECIMALS) + F.lit(0.0)


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(
        *[rounded(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes]
    )
