"""GeoJSON feature layers as tables (layer, feature_id, geometry_type, parts, polygon_of, properties).

``polygon_of`` holds the polygon number of every ring of a MultiPolygon and is NULL otherwise. A
GeometryCollection becomes one row per member, whose feature_id has the member's number behind a ``#``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.functions.geometry import PARTS
from rillwork.functions.values import ref
from rillwork.sources.pieces import feature_texts
from rillwork.sources.tables import find_column, path_exists

GEOMETRY = "type: STRING, coordinates: STRING"
FEATURE = (
    f"type STRING, id STRING, geometry STRUCT<{GEOMETRY}, geometries: ARRAY<STRUCT<{GEOMETRY}>>>, "
    "properties MAP<STRING, STRING>"
)
COLLECTION = f"features ARRAY<STRUCT<{FEATURE}>>"

# Lines of a collection that hold no feature: brackets, the head, and members such as name or crs.
FRAME = (
    r'(?s)\s*|[\[\]{}\s]+,?|\{?\s*"type"\s*:\s*"FeatureCollection"[^\[]*\[?'
    r'|"features"\s*:\s*\[|"(?!(type|id|geometry|geometries|coordinates|properties|features)")[^"]*"\s*:.*'
)


def _parts(kind: Column, coordinates: Column) -> Column:
    """Coordinates of any geometry type in one nesting: parts, vertices, [x, y]."""
    wrap = (
        F.when(kind == "Point", F.concat(F.lit("[["), coordinates, F.lit("]]")))
        .when(kind.isin("LineString"), F.concat(F.lit("["), coordinates, F.lit("]")))
        .when(kind.isin("Polygon", "MultiLineString"), coordinates)
    )
    points = F.transform(F.from_json(coordinates, "array<array<double>>"), lambda v: F.array(v))
    many = F.flatten(F.from_json(coordinates, f"array<{PARTS}>"))
    return (
        F.when(kind == "MultiPoint", points)
        .when(kind == "MultiPolygon", many)
        .otherwise(F.from_json(wrap, PARTS))
    )


def _polygon_of(kind: Column, coordinates: Column) -> Column:
    polygons = F.from_json(coordinates, f"array<{PARTS}>")
    numbers = F.transform(polygons, lambda rings, i: F.array_repeat(i, F.size(rings)))
    return F.when(kind == "MultiPolygon", F.flatten(numbers))


def _features(raw: DataFrame, layer: Column, id_property: str | None) -> DataFrame:
    """Feature structs in column ``f`` to the layer schema."""
    whole, member = F.col("f.geometry"), F.col("_m")
    many = whole["type"] == "GeometryCollection"
    content = F.md5(F.concat_ws(
        "|", whole["type"], F.coalesce(whole["coordinates"], F.to_json(whole["geometries"])), F.to_json("f.properties")))
    key = F.try_element_at("f.properties", F.lit(id_property)) if id_property else F.lit(None)
    key = F.coalesce(key.cast("string"), F.col("f.id"), content)
    one = F.array(F.struct(whole["type"].alias("type"), whole["coordinates"].alias("coordinates")))
    members = raw.select("*", key.alias("_key"), F.posexplode_outer(F.when(many, whole["geometries"]).otherwise(one)).alias("_i", "_m"))
    # Members of collections within collections would be lost in silence.
    kind = F.when(
        member["type"] == "GeometryCollection", F.raise_error(F.lit("nested GeometryCollection")).cast("string")
    ).otherwise(member["type"])
    return members.select(
        layer.alias("layer"),
        F.when(F.coalesce(many, F.lit(False)), F.concat_ws("#", "_key", F.col("_i").cast("string"))).otherwise(F.col("_key")).alias("feature_id"),
        kind.alias("geometry_type"),
        _parts(kind, member["coordinates"]).alias("parts"),
        _polygon_of(kind, member["coordinates"]).alias("polygon_of"),
        F.col("f.properties").alias("properties"),
    )


def _read(spark: SparkSession, path: str | list[str], lines: bool) -> DataFrame:
    """Feature structs of files with one feature per line, or of collections in any layout."""
    if not lines:
        found = feature_texts(spark, path).select("text", F.struct(F.col("file").alias("file_path")).alias("_metadata"))
        read = found.withColumn("f", F.from_json("text", FEATURE))
        broken = F.coalesce(*[F.col(f"f.{c}").cast("string") for c in ("type", "id", "geometry", "properties")]).isNull()
        failed = F.raise_error(F.concat(F.lit("not a feature: "), F.left("text", F.lit(80))))
        return read.select(F.when(broken, failed).otherwise(F.col("f")).alias("f"), "_metadata")
    text = F.regexp_replace(F.trim(F.translate("value", "\t\r\ufeff\u001e", "   ")), r",$", "")
    read = spark.read.text(path).select(
        F.trim(text).alias("line"), F.from_json(F.trim(text), f"{FEATURE}, {COLLECTION}").alias("j"), "_metadata")
    feature = F.struct(*[F.col(f"j.{c}").alias(c) for c in ("type", "id", "geometry", "properties")])
    found = (
        F.when(F.col("j.type") == "Feature", F.array(feature))
        .when((F.col("j.type") == "FeatureCollection") & F.col("j.features").isNotNull(), F.col("j.features"))
        .when(F.col("line").rlike(f"^({FRAME})$"), F.filter(F.array(feature), lambda f: F.lit(False)))
        .otherwise(F.raise_error(F.concat(F.lit("not one feature per line, read with lines=False: "), F.left("line", F.lit(80)))))
    )
    return read.select(F.explode(found).alias("f"), "_metadata")


def read_geojson(
    spark: SparkSession, path: str, layer: str, id_property: str | None = None, lines: bool = True
) -> DataFrame:
    """One layer. An absent file gives an empty layer and a warning, not an error.

    Files have one feature per line, bare or within a collection as exports write it, and are split; any
    other line is an error. ``lines=False`` takes collections in any layout, on one line too, which are stored
    once more and shuffled by block, so that many tasks share a file (``sources.pieces``).
    The id of a feature is its ``id_property``, else its own ``id``, else a hash of its content.
    """
    if not path_exists(spark, path):
        warnings.warn(f"layer {layer} is missing at {path}", stacklevel=2)
        return spark.createDataFrame([], S.FEATURE)
    return _features(_read(spark, path, lines), F.lit(layer), id_property)


def read_layers(
    spark: SparkSession, pattern: str, id_property: str | None = None, lines: bool = True
) -> DataFrame:
    """All files of a glob as one table; the layer is the name of the ``.geojson`` file."""
    if not path_exists(spark, pattern):
        warnings.warn(f"no layers at {pattern}", stacklevel=2)
        return spark.createDataFrame([], S.FEATURE)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)\.geojson", 1)
    return _features(_read(spark, pattern, lines), name, id_property)


def read_feature_pages(
    spark: SparkSession, path: str, layer: str, id_property: str | None = None
) -> DataFrame:
    """Stored response pages, one collection per line or file; unreadable pages are skipped
    (``page_counts`` tells how many)."""
    if not path_exists(spark, path):
        warnings.warn(f"no pages for {layer} at {path}", stacklevel=2)
        return spark.createDataFrame([], S.FEATURE)
    pages = _pages(spark, path).where("_bad IS NULL").select(F.explode("features").alias("f"))
    return _features(pages.where("f IS NOT NULL"), F.lit(layer), id_property)


def page_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row (read, skipped): stored pages that ``read_feature_pages`` reads and those it leaves out."""
    # Spark refuses to read the text of broken pages alone, so the features are looked at too.
    bad = F.col("_bad").isNotNull() & (F.coalesce(F.size("features"), F.lit(0)) >= -1)
    return _pages(spark, path).agg(F.count_if(~bad).alias("read"), F.count_if(bad).alias("skipped"))


def _pages(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(f"{COLLECTION}, _bad STRING")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    )


def properties_as_columns(layer: DataFrame, names: list[str]) -> DataFrame:
    rest = [c for c in layer.columns if c != "properties"]
    return layer.select(*rest, *[F.try_element_at("properties", F.lit(n)).alias(n) for n in names])


def name_points(df: DataFrame, out: str = "PASSIVE_NAME", tokens: list[str] = S.SITE_NAME_TOKENS) -> DataFrame:
    """Rename the first column whose name holds a name-like token."""
    hit = find_column(df.columns, tokens=tokens)
    return df.withColumnRenamed(hit, out) if hit else df


def points(layer: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Coordinates of the point features of a layer as two columns."""
    single = layer.where(ref("geometry_type") == "Point")
    first = F.get(F.get("parts", F.lit(0)), F.lit(0))
    return single.withColumns({x: F.get(first, F.lit(0)), y: F.get(first, F.lit(1))})
