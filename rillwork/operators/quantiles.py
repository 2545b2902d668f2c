"""Exact, linearly interpolated quantiles over tables of any size.

``percentile`` keeps every distinct value of a group in one task. Here one wide aggregate gives the
moments of all columns and a sketch of bounded size that brackets each wanted rank. A second pass
counts the values in the brackets. Their distinct values are cut into bins of about equal size, and
only the bins that hold a wanted rank are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.functions import values as V

# Rank error of the sketch is at most n / ACCURACY; up to this many rows no bracket is needed.
# Both choose a plan and leave the values alone.
ACCURACY = 10_000
BINS = 256

MOMENTS = ["n", "mean", "std", "lo", "hi"]


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (column, value) per present number."""
    cells = [F.struct(F.lit(c).alias("column"), V.numeric(df, c).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where("value IS NOT NULL")


def column_moments(df: DataFrame, columns: list[str], marks: list[float]) -> DataFrame:
    """One row (column, n, mean, std, lo, hi, edges) per column that has a number, in one pass."""
    aggregates = []
    for i, c in enumerate(columns):
        value = V.numeric(df, c)
        aggregates.append(F.struct(
            F.lit(c).alias("column"), F.count(value).alias("n"), F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"), F.min(value).alias("lo"), F.max(value).alias("hi"),
            F.percentile_approx(value, marks, ACCURACY).alias("edges"),
        ).alias(f"c{i}"))
    row = df.agg(*aggregates)
    return row.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(columns))])).alias("_c")).select(
        "_c.*").where("n > 0")


def bracket_counts(values: DataFrame, sketch: DataFrame, marks: list[float]) -> DataFrame:
    """(column, moments, slot, value, rows): how often each value of a bracket occurs.

    A slot lies wholly inside or wholly outside the brackets, and slots rise with the value. The
    values of an outside slot collapse into one row without a value.
    """
    value = F.col("value")
    edges = [F.when(F.col("n") > ACCURACY, F.get("edges", F.lit(i))) for i in range(len(marks))]
    inside, slot = F.col("n") <= ACCURACY, F.lit(0)
    for low, high in zip(edges[::2], edges[1::2], strict=True):
        inside = inside | value.between(low, high)
        slot = slot + V.flag(value >= low).cast("int") + V.flag(value > high).cast("int")
    return (
        values.join(F.broadcast(sketch), "column")
        .groupBy("column", *MOMENTS, slot.alias("slot"), F.when(inside, value).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def binned(counted: DataFrame) -> DataFrame:
    """``counted`` with the bin of each value: cuts at quantiles of a slot's distinct values, so that
    bins are of about equal size however the values are spread."""
    shares = [i / BINS for i in range(1, BINS)]
    # Reading the count too gives all uses of ``counted`` one plan, so that they share one shuffle.
    cuts = counted.where("rows > 0").groupBy("column", "slot").agg(F.percentile_approx("value", shares, ACCURACY).alias("cuts"))
    below = F.size(F.filter("cuts", lambda cut: cut < F.col("value")))
    # A few slots per column. Never NULL or negative, for a slot without values too.
    return counted.join(F.broadcast(cuts), ["column", "slot"]).withColumn(
        "bin", F.when(F.col("value").isNotNull(), F.greatest(below, F.lit(0))).otherwise(0)).drop("cuts")


def quantile_table(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """One row per column: count, mean, deviation, range (``n, mean, std, lo, hi``) and the array
    ``quantiles``. Reads the table twice."""
    reach = 4 / ACCURACY
    marks = [m for p in probabilities for m in (max(p - reach, 0.0), min(p + reach, 1.0))]
    sketch = column_moments(df, columns, marks)
    counted = binned(bracket_counts(long_values(df, columns), sketch, marks))
    places = [F.lit(p) * (F.col("n") - 1) for p in probabilities]
    ranks = [rank for place in places for rank in (F.floor(place), F.ceil(place))]
    # A column has few slots, each of at most BINS bins; those with a wanted rank are kept.
    by_column = W.partitionBy("column").orderBy("slot", "bin")
    bins = (
        counted.groupBy("column", *MOMENTS, "slot", "bin").agg(F.sum("rows").alias("size"))
        .withColumn("start", F.sum("size").over(by_column) - F.col("size"))
        .where(V.any_of([(r >= F.col("start")) & (r < F.col("start") + F.col("size")) for r in ranks]))
        .select("column", "slot", "bin", "start")
    )
    running = F.sum("rows").over(W.partitionBy("column", "slot", "bin").orderBy("value"))
    ranked = counted.join(F.broadcast(bins), ["column", "slot", "bin"]).withColumn(
        "reach", F.col("start") + running
    )

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("reach") > rank, F.struct("reach", "value")))

    picks = [at(F.floor(place)).alias(f"a{i}") for i, place in enumerate(places)]
    picks += [at(F.ceil(place)).alias(f"b{i}") for i, place in enumerate(places)]
    picked = ranked.groupBy("column", *MOMENTS).agg(*picks)
    found = []
    for i, (p, place) in enumerate(zip(probabilities, places, strict=True)):
        low, high = F.col(f"a{i}.value"), F.col(f"b{i}.value")
        step = place - F.floor(place)
        between = F.when(step == 0, low).otherwise(low + step * (high - low))
        missed = F.when(low.isNull() | high.isNull(), F.raise_error(F.lit("rank outside its bracket")))
        # The ends are known from the range.
        exact = F.col("lo") if p == 0 else F.col("hi") if p == 1 else F.coalesce(missed.cast("double"), between)
        found.append(exact)
    return picked.select("column", *MOMENTS, F.array(*found).alias("quantiles"))


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """Rows (column, p, value) with the same values as a sort of the whole column would give."""
    cells = [F.struct(F.lit(float(p)).alias("p"), F.get("quantiles", F.lit(i)).alias("value"))
             for i, p in enumerate(probabilities)]
    found = quantile_table(df, columns, probabilities)
    return found.select("column", F.explode(F.array(*cells)).alias("c")).select("column", "c.*")
