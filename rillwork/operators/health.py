"""Normalisation, watershed scores, ranking and priority lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.functions import values as V
from rillwork.operators.clean import drop_blank, drop_incomplete, median_map
from rillwork.session import checkpoint


def minmax(
    df: DataFrame, columns: list[str], constant: float | None = None, impute: bool = False, suffix: str = "_norm"
) -> DataFrame:
    """Scale each column to 0..1 over the whole table, as ``<column>_norm``.

    A column without spread gives ``constant``. With ``impute`` missing values take the median
    first, and a column without any value gives ``constant`` too.
    """
    values = {c: V.finite(V.numeric(df, c)) if impute else V.numeric(df, c) for c in columns}
    # One column for the sub-query, so that the plan holds it once however many columns use it.
    if impute:
        summary = median_map(df.select(*[v.alias(c) for c, v in values.items()]), columns)
    else:
        summary = df.agg(F.struct(*[
            F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(str(i)) for i, v in enumerate(values.values())
        ])).scalar()
    out = {}
    for i, (c, value) in enumerate(values.items()):
        known = F.try_element_at("_summary", F.lit(c)) if impute else F.col("_summary")[str(i)]
        if impute:
            value = F.coalesce(value, known["median"])
        lo, hi = known["lo"], known["hi"]
        scaled = F.try_divide(value - lo, hi - lo)
        if constant is not None:
            scaled = F.when((hi == lo) | hi.isNull(), F.lit(constant)).otherwise(scaled)
        out[c + suffix] = scaled
    return df.withColumn("_summary", summary).withColumns(out).drop("_summary")


def sickness_v1(df: DataFrame, chemistry: list[str], distance: str, huc: str) -> DataFrame:
    """0.6 x mean normalised chemistry + 0.4 x (1 - normalised distance), per row."""
    typed = df.withColumns({c: V.numeric(df, c) for c in [*chemistry, distance]})
    kept = drop_blank(drop_incomplete(typed, [huc]), [distance, *chemistry])
    scaled = minmax(kept, [*chemistry, distance])
    score = V.row_mean([V.ref(c + "_norm") for c in chemistry])
    index = S.CHEMISTRY_SHARE * score + S.DISTANCE_SHARE * (1 - V.ref(distance + "_norm"))
    return scaled.withColumn("Sickness_Index", index)


def sickness_v2(
    df: DataFrame, weights: dict[str, float] = S.HEALTH_WEIGHTS, distance: str | None = None
) -> DataFrame:
    """Weighted sum of normalised analytes x (0.5 + 0.5 x proximity), per row.

    Missing values take the column's median. An absent analyte adds nothing; without any
    distance the factor is left out.
    """
    present = {c: w for c, w in weights.items() if c in df.columns}
    columns = [*present, *([distance] if distance else [])]
    scaled = minmax(df, columns, constant=0.0, impute=True)
    index = F.lit(0.0)
    for c, w in present.items():
        index = index + w * V.ref(c + "_norm")
    if distance:
        # Without any distance the scaled column is 0 and the factor 1.
        proximity = 1 - V.ref(distance + "_norm")
        index = index * (S.PROXIMITY_FLOOR + S.PROXIMITY_SHARE * proximity)
    return scaled.withColumn("Sickness_Index", index)


def aggregate_health(df: DataFrame, huc: str, means: dict[str, str]) -> DataFrame:
    """Mean of the given columns (source name to output name) per watershed."""
    aggregates = [F.avg(V.ref(c)).alias(out) for c, out in means.items() if c in df.columns]
    return drop_incomplete(df, [huc]).groupBy(huc).agg(*aggregates)


def rank_dense(df: DataFrame, score: str, out: str = "Rank") -> DataFrame:
    """Dense rank by falling score over the whole table; a missing score has no rank.

    The distinct scores are sorted across all tasks. Positions come from each sorted partition
    and its offset, so no window holds the whole table.
    """
    scores = df.where(V.ref(score).isNotNull()).select(V.ref(score).alias("_score")).distinct()
    # The id holds the partition number above 33 bits of row number within the partition.
    ordered = checkpoint(
        scores.orderBy(F.desc("_score")).withColumn("_id", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per sorted partition.
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = (
        ordered.withColumns({"_part": part, "_row": row})
        .join(F.broadcast(offsets), "_part")
        .select("_score", (F.col("_before") + F.col("_row") + 1).cast("int").alias(out))
    )
    return df.join(ranked, V.ref(score) == F.col("_score"), "left").drop("_score")


def top_by(df: DataFrame, score: str, key: str, n: int = 10) -> DataFrame:
    """The n rows of highest score; rows without a score do not count, ties go by key."""
    return df.where(V.ref(score).isNotNull()).orderBy(F.desc(score), key).limit(n)


def join_polygons(polygons: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Every polygon with its summary; polygons without data stay. Keys are compared as text."""
    typed = summary.withColumn(key, V.ref(key).cast("string"))
    return polygons.withColumn(key, V.ref(key).cast("string")).join(typed, key, "left")
