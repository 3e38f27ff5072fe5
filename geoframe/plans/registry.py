"""Queries over the star-schema tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """df with columns rounded; -0.0 is 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})
