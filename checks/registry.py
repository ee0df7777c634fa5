"""Registered queries and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 4


def r(expr: str) -> str:
    """Rounded SQL value without negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {DECIMALS}) + 0.0)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded as in the checks."""
    return df.select(*[(F.round(F.col(f"`{f.name}`").cast("double"), DECIMALS) + F.lit(0.0)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; its doubles are rounded."""
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add
