"""Spatial work is done once per distinct location and then brought back to every row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.functions.values import finite, ref
from rillwork.session import broadcast_if_small


def distinct_locations(left: DataFrame, x: str, y: str) -> DataFrame:
    places = left.select(ref(x).cast("double").alias("x"), ref(y).cast("double").alias("y"))
    return places.where(finite(F.col("x")).isNotNull() & finite(F.col("y")).isNotNull()).distinct()


def attach_locations(left: DataFrame, found: DataFrame, x: str, y: str) -> DataFrame:
    """Bring results of distinct locations back to every row of the left table.

    There are far fewer locations than samples: when their measured size allows it they are
    broadcast, and the samples are not shuffled at all.
    """
    at = (ref(x).cast("double") == F.col("_x")) & (ref(y).cast("double") == F.col("_y"))
    side = broadcast_if_small(found.withColumnsRenamed({"x": "_x", "y": "_y"}))
    return left.join(side, at, "left").drop("_x", "_y")
