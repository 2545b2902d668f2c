"""Per-site and per-watershed aggregates of result tables.

Wide tables are made with conditional aggregates rather than a pivot: one shuffle on the row
key, partial aggregation before it, and a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.functions import values as V
from rillwork.operators import clean as C


def pivot_mean(
    df: DataFrame, keys: list[str], analytes: list[str], analyte_col: str = S.ANALYTE, value_col: str = S.VALUE
) -> DataFrame:
    """One row per key with the mean of each analyte; rows with a NULL key are left out."""
    value = V.numeric(df, value_col)
    means = [F.avg(F.when(V.ref(analyte_col) == a, value)).alias(a) for a in analytes]
    return C.drop_incomplete(df, keys).groupBy(*[V.ref(k) for k in keys]).agg(*means)


def site_wide(df: DataFrame) -> DataFrame:
    """Raw results to one labelled row per site: recode, convert units, mean, AMD_present."""
    kept = C.drop_incomplete(C.keep_columns(df, S.RESULT_COLUMNS), [S.LAT, S.LON, S.VALUE])
    named = C.normalise_unit_text(C.convert_unit(C.recode(kept, S.ANALYTE, S.SHORT_NAMES)))
    keys = [S.SITE, S.LAT, S.LON, "MonitoringLocationTypeName"]
    wide = pivot_mean(named, keys, list(S.SHORT_NAMES.values()))
    wide = C.rename(wide, {S.LAT: "latitude", S.LON: "longitude", "MonitoringLocationTypeName": "site_type"})
    return C.label_any(wide, S.PRESENT_RULES, "AMD_present")


def usable_results(df: DataFrame, analytes: list[str] = S.ANALYTES) -> DataFrame:
    """The rows that count for site features: known analyte, date and number, no sentinel."""
    typed = C.coerce_dates(C.coerce_numeric(df, [S.VALUE]), S.DATE, "Year")
    listed = C.keep_values(typed, S.ANALYTE, analytes)
    return C.drop_sentinels(C.drop_incomplete(listed, ["Year", S.VALUE, S.SITE]))


def annual_means(df: DataFrame) -> DataFrame:
    """Mean per site, analyte and year."""
    return df.groupBy(S.SITE, S.ANALYTE, "Year").agg(F.avg(S.VALUE).alias("annual_mean"))


STATISTICS = ["mean", "median", "std", "min", "max", "n_years", "trend"]


def analyte_statistics(yearly: DataFrame) -> DataFrame:
    """Statistics and trend of the annual means per site and analyte."""
    value, years = F.col("annual_mean"), F.count("annual_mean")
    return yearly.groupBy(S.SITE, S.ANALYTE).agg(
        F.avg(value).alias("mean"),
        # At most one value per year, so this group stays small.
        F.median(value).alias("median"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        years.cast("int").alias("n_years"),
        F.when(years > 2, F.regr_slope(value, F.col("Year").cast("double"))).alias("trend"),
    )


def site_features(df: DataFrame, analytes: list[str] = S.ANALYTES) -> DataFrame:
    """Statistics and trend of the annual means per site, ratios and the AMD_impacted label."""
    # By site after the annual means (partial sums have shrunk them): both groupings below need no further shuffle.
    yearly = annual_means(usable_results(df, analytes)).repartition(S.SITE)
    statistics = analyte_statistics(yearly)
    wide = statistics.groupBy(S.SITE).agg(*[
        F.max(F.when(F.col(S.ANALYTE) == a, F.col(name))).alias(f"{a}_{name}")
        for a in analytes for name in STATISTICS
    ])
    wide = C.add_ratio(wide, "Iron_mean", "Manganese_mean", "Fe_Mn_ratio")
    wide = C.add_ratio(wide, "Iron_mean", "Sulfate_mean", "Fe_Sulfate_ratio")
    return C.label_any(wide, S.IMPACTED_RULES, "AMD_impacted")


def analyte_profile(df: DataFrame) -> DataFrame:
    """Count, mean, range and period per analyte, most results first."""
    typed = C.coerce_dates(C.coerce_numeric(df, [S.VALUE]))
    return (
        C.drop_incomplete(typed, [S.ANALYTE])
        .groupBy(S.ANALYTE)
        .agg(
            F.count(S.VALUE).alias("n_results"),
            F.avg(S.VALUE).alias("mean_value"),
            F.min(S.VALUE).alias("min_value"),
            F.max(S.VALUE).alias("max_value"),
            F.min(S.DATE).alias("first_date"),
            F.max(S.DATE).alias("last_date"),
        )
        .orderBy(F.desc("n_results"), S.ANALYTE)
    )


def site_profile(df: DataFrame) -> DataFrame:
    """Count and period per site, most results first."""
    typed = C.coerce_dates(C.coerce_numeric(df, [S.VALUE]))
    return (
        C.drop_incomplete(typed, [S.SITE])
        .groupBy(S.SITE)
        .agg(
            F.count(S.VALUE).alias("n_results"),
            F.min(S.DATE).alias("first_date"),
            F.max(S.DATE).alias("last_date"),
        )
        .orderBy(F.desc("n_results"), S.SITE)
    )


def watershed_wide(
    df: DataFrame, analytes: list[str], huc: str = "HUC12", complete: bool = True
) -> DataFrame:
    """Mean of each analyte per watershed; by default only watersheds that have them all."""
    wide = pivot_mean(df, [huc], analytes)
    return C.drop_incomplete(wide) if complete else wide


def cluster_summary(df: DataFrame, features: list[str], cluster: str = "Cluster") -> DataFrame:
    """Mean of each feature (two decimals, half to even) and row count per cluster."""
    means = [F.bround(F.avg(V.ref(c)), 2).alias(c) for c in features]
    return C.drop_incomplete(df, [cluster]).groupBy(cluster).agg(*means, F.count(F.lit(1)).alias("Count"))
