"""Writing tables and layers, resumable appends and quality counts."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import schema as S
from rillwork.functions.values import ref
from rillwork.operators.clean import clean_results, keep_values
from rillwork.sources.tables import is_complete


def write_csv(df: DataFrame, path: str, drop: list[str] = ("parts", "polygon_of")) -> None:
    """CSV with a header in every part; geometry columns are left out, nested ones written as JSON."""
    flat = df.drop(*drop)
    nested = [f.name for f in flat.schema.fields if isinstance(f.dataType, (T.MapType, T.StructType, T.ArrayType))]
    flat.withColumns({c: F.to_json(ref(c)) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def append_layer(df: DataFrame, path: str, by: str = "layer") -> None:
    """Add rows to a master table partitioned by layer; earlier rows are not read again."""
    df.write.mode("append").partitionBy(by).parquet(path)


def write_clean_and_subset(df: DataFrame, clean_path: str, subset_path: str) -> None:
    """Cleaned results, and of those the analytes of interest; cleaned once, written twice."""
    write_table(clean_results(df), clean_path)
    stored = df.sparkSession.read.parquet(clean_path)
    write_table(keep_values(stored, S.ANALYTE, S.ANALYTES), subset_path)


def _polygons(parts: Column, polygon_of: Column | None) -> Column:
    """Rings grouped by polygon; without polygon numbers each ring is a polygon of its own."""
    single = F.transform(parts, lambda ring: F.array(ring))
    if polygon_of is None:
        return single
    numbers = F.array_sort(F.array_distinct(polygon_of))
    grouped = F.transform(numbers, lambda n: F.filter(parts, lambda ring, i: F.get(polygon_of, i) == n))
    return F.coalesce(grouped, single)


def _geometry(kind: Column, parts: Column, polygon_of: Column | None) -> Column:
    """GeoJSON geometry text. Polygons and lines with several parts keep their nesting."""
    first = F.get(parts, F.lit(0))
    coordinates = (
        F.when(kind == "Point", F.to_json(F.get(first, F.lit(0))))
        .when(kind == "MultiPoint", F.to_json(F.transform(parts, lambda p: F.get(p, F.lit(0)))))
        .when(kind == "LineString", F.to_json(first))
        .when(kind == "MultiPolygon", F.to_json(_polygons(parts, polygon_of)))
        .otherwise(F.to_json(parts))
    )
    return F.when(
        parts.isNotNull(),
        F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}")),
    ).otherwise("null")


def feature_text(df: DataFrame, parts: str = "parts", kind: str = "geometry_type") -> Column:
    """A row as one GeoJSON Feature; every column but the geometry becomes a property."""
    others = [c for c in df.columns if c not in (parts, kind, "polygon_of")]
    polygon_of = ref("polygon_of") if "polygon_of" in df.columns else None
    if others == ["properties"]:
        properties = F.to_json("properties")
    else:
        properties = F.to_json(F.struct(*[ref(c) for c in others]), {"ignoreNullFields": "false"})
    return F.concat(
        F.lit('{"type":"Feature","geometry":'), _geometry(ref(kind), ref(parts), polygon_of),
        F.lit(',"properties":'), properties, F.lit("}"),
    )


def write_geojson(df: DataFrame, path: str, parts: str = "parts", kind: str = "geometry_type") -> bool:
    """Newline-delimited GeoJSON; a table without geometry is not written."""
    if parts not in df.columns or kind not in df.columns:
        warnings.warn("no geometry column, GeoJSON not written", stacklevel=2)
        return False
    df.select(feature_text(df, parts, kind)).write.mode("overwrite").text(path)
    return True


def preview(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in a fixed order."""
    return df.orderBy(*[ref(c) for c in order]).limit(n)


def resume_missing(df: DataFrame, done_path: str, key: list[str]) -> DataFrame:
    """Rows whose key is not in the stored output yet; all rows if nothing is stored. Keys that are
    NULL are equal."""
    spark = df.sparkSession
    if not is_complete(spark, done_path):
        return df
    done = spark.read.parquet(done_path).select(*[ref(k).alias(f"_done{i}") for i, k in enumerate(key)])
    same = reduce(Column.__and__, [ref(k).eqNullSafe(F.col(f"_done{i}")) for i, k in enumerate(key)])
    return df.join(done, same, "left_anti")


def append_missing(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Finish a partly written output: only missing keys are computed and added."""
    resume_missing(df, path, key).write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_chunks(df: DataFrame, key: list[str], chunks: int, name: str = "chunk") -> DataFrame:
    """A chunk number for each row, by a hash of its key: the same in every run."""
    return df.withColumn(name, F.pmod(F.xxhash64(*[ref(k) for k in key]), F.lit(chunks)).cast("int"))


def finished_chunks(spark: SparkSession, path: str, by: list[str]) -> DataFrame | None:
    """The keys of finished chunks, from the manifest beside the output; None before the first."""
    manifest = f"{path.rstrip('/')}-manifest"
    return spark.read.parquet(manifest).select(*[ref(c) for c in by]).distinct() if is_complete(spark, manifest) else None


def _only(df: DataFrame, chunks: DataFrame | None, by: list[str], how: str) -> DataFrame:
    if chunks is None:
        return df.limit(0) if how == "left_semi" else df
    named = chunks.select(*[ref(c).alias(f"_c{i}") for i, c in enumerate(by)])
    return df.join(F.broadcast(named), reduce(Column.__and__, [ref(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(by)]), how)


def finish_chunks(df: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], by: list[str], at_once: int = 8) -> DataFrame:
    """Compute a table chunk by chunk so that a run that died goes on where it was: (result of all chunks).

    ``by`` names the chunk columns (``layer``, ``chunk``; see ``with_chunks``), which ``compute`` must keep. Chunks that the
    manifest lists are not computed again. The others are, ``at_once`` in one job; what an earlier run left of them is
    replaced, not added to, and they enter the manifest only when they are written. Empty chunks are finished as well.
    Few and bounded: the chunks, not the rows, pass the driver and the manifest.
    """
    spark = df.sparkSession
    open_chunks = _only(df.select(*[ref(c) for c in by]).distinct(), finished_chunks(spark, path, by), by, "left_anti")
    waiting = open_chunks.orderBy(*[ref(c) for c in by]).collect()
    for at in range(0, len(waiting), at_once):
        group = spark.createDataFrame(waiting[at:at + at_once], open_chunks.schema)
        part = compute(_only(df, group, by, "left_semi"))
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
        group.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}-manifest")
    return read_finished(spark, path, by)


def read_finished(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The output of finished chunks; what a run that died has left of others is not read."""
    done = finished_chunks(spark, path, by)
    if done is None:
        raise FileNotFoundError(f"no finished chunk of {path}")
    table = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in done.schema.fields}
    return _only(table.withColumns({c: ref(c).cast(kinds[c]) for c in by}), done, by, "left_semi")


def qc_counts(df: DataFrame, rules: dict[str, Column], by: str = "layer") -> DataFrame:
    """Rows (layer, reason, rejected) in one pass: how many rows break each rule."""
    counted = df.groupBy(ref(by)).agg(
        *[F.count_if(F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()]
    )
    cells = [F.struct(F.lit(name).alias("reason"), ref(name).alias("rejected")) for name in rules]
    return counted.select(ref(by), F.explode(F.array(*cells)).alias("_c")).select(by, "_c.*")
