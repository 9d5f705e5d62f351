"""Registration of queries with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function of the inputs under its name."""

    def register(f: Callable[[Inputs], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Inputs(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles to fixed places, so that sums in another order compare equal."""
    return df.select(*[F.round(c, places).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
