"""Registered queries and, where plain SQL can express them, the SQL to check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.values import ref

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles, since sums differ in their last bits between engines."""
    return df.select(*[
        F.round(ref(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else ref(f.name)
        for f in df.schema.fields
    ])


def day_text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.date_format(ref(c), "yyyy-MM-dd") for c in columns})
