"""The supplied tables seen as environmental data: sites, results, hazard layers, watersheds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.operators.nearest import point_segments, shape_segments

# How codes of the supplied tables map to the domain. Prices are divided by a
# large prime, so that means hardly ever lie exactly between two rounded values.
ANALYTE_OF = {
    "AF": "Alkalinity",
    "AO": "Iron",
    "NF": "Manganese",
    "NO": "pH",
    "RF": "Specific conductance",
    "RO": "Sulfate",
}
SITE_TYPES = ["Stream", "Mine Drainage", "Outfall", "Surface Water"]
LAYER_OF = {
    "AML": "AUTOMOBILE",
    "Bituminous": "BUILDING",
    "Anthracite": "FURNITURE",
    "Underground": "HOUSEHOLD",
    "Passive": "MACHINERY",
}
CELL_WIDTH, CELL_HEIGHT = 20001, 19999


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def site_x(key: Column) -> Column:
    return (key * 7919 % 100003).cast("double")


def site_y(key: Column) -> Column:
    return (key * 104729 % 99991).cast("double")


def lon_of(x: Column) -> Column:
    return x / 100003 * 5.8 - 80.5


def lat_of(y: Column) -> Column:
    return y / 99991 * 2.3 + 39.7


def site_id(key: Column) -> Column:
    return F.concat(F.lit("S"), key.cast("string"))


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One laboratory result per lineitem row, typed."""
    li = table(spark, folder, "lineitem")
    key, line, price = F.col("l_partkey"), F.col("l_linenumber"), F.col("l_extendedprice")
    codes = F.create_map(*[F.lit(v) for pair in ANALYTE_OF.items() for v in pair])
    analyte = codes[F.concat("l_returnflag", "l_linestatus")]
    value = (
        F.when(analyte == "pH", F.col("l_quantity") * 0.28)
        .when(analyte == "Iron", price / 9973)
        .when(analyte == "Sulfate", price * 50 / 9973)
        .otherwise(price * 10 / 9973)
    )
    unit = (
        F.when(analyte == "pH", F.lit("std units"))
        .when(analyte == "Specific conductance", pick(line % 3, ["uS/cm", "µS/cm", "mS/cm"]))
        .otherwise(pick(line % 3, ["mg/l", "MG/L as CaCO3", "ug/l"]))
    )
    return li.select(
        F.concat(F.lit("ORG"), (F.col("l_suppkey") % 7).cast("string")).alias("OrganizationIdentifier"),
        site_id(key).alias(S.SITE),
        F.concat(F.lit("Site "), key.cast("string")).alias("MonitoringLocationName"),
        pick(key % 4, SITE_TYPES).alias("MonitoringLocationTypeName"),
        F.col("l_shipdate").cast("date").alias(S.DATE),
        lat_of(site_y(key)).alias(S.LAT),
        lon_of(site_x(key)).alias(S.LON),
        analyte.alias(S.ANALYTE),
        value.alias(S.VALUE),
        unit.alias(S.UNIT),
    )


def raw_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows as they come from a laboratory: numbers and dates as text, some unreadable."""
    li = table(spark, folder, "lineitem")
    line, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    value = (
        F.when(line == 7, F.concat(F.lit("<"), q))
        .when(line == 6, F.concat(F.lit(" "), q, F.lit(".5 ")))
        .when(line == 5, F.concat(q, F.lit("e1")))
        .when(line == 4, F.lit("ND"))
        .when(line == 3, F.concat(F.lit("-"), q))
        .when((line == 2) & (F.col("l_quantity") > 40), F.lit("999999"))
        .when(line == 2, F.concat(q, F.lit("d")))
        .otherwise(q)
    )
    date = F.when(line == 7, F.lit("unknown")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    codes = F.create_map(*[F.lit(v) for pair in ANALYTE_OF.items() for v in pair])
    return li.select(
        F.concat(F.lit(" "), site_id(F.col("l_partkey"))).alias(S.SITE),
        codes[F.concat("l_returnflag", "l_linestatus")].alias(S.ANALYTE),
        date.alias(S.DATE),
        value.alias(S.VALUE),
        F.when(line == 1, "mg/l").otherwise("MG/L as X").alias(S.UNIT),
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("site_key"), site_id(key).alias(S.SITE),
        site_x(key).alias("x_m"), site_y(key).alias("y_m"),
        lon_of(site_x(key)).alias("lon"), lat_of(site_y(key)).alias("lat"),
        pick(key % 4, SITE_TYPES).alias("site_type"),
    )


def mines(spark: SparkSession, folder: str) -> DataFrame:
    """Point features of five layers."""
    key = F.col("c_custkey")
    names = F.create_map(*[F.lit(v) for name, code in LAYER_OF.items() for v in (code, name)])
    return table(spark, folder, "customer").select(
        key.alias("feature_id"), names[F.col("c_mktsegment")].alias("layer"),
        (key * 15485863 % 100003).cast("double").alias("x"),
        (key * 32452843 % 99991).cast("double").alias("y"),
        F.col("c_name").alias("name"),
    )


def mine_layers(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    every = mines(spark, folder)
    return {
        name: point_segments(every.where(F.col("layer") == name), "feature_id", "x", "y", name)
        for name in LAYER_OF
    }


def vertices(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in pairs])


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return vertices((x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1))


def flowlines(spark: SparkSession, folder: str) -> DataFrame:
    """One line of three vertices per supplier."""
    k = F.col("s_suppkey")
    x, y = k * 99991 * 13 % 100003, k * 86028121 % 99991
    bend_x, bend_y = x + (k % 7 - 3) * 1500, y + (k % 5 - 2) * 1200
    line = vertices((x, y), (bend_x, bend_y), (bend_x + 2000, bend_y + (k % 3 - 1) * 900))
    return table(spark, folder, "supplier").select(
        k.alias("feature_id"), F.col("s_name").alias("name"), F.lit("LineString").alias("geometry_type"),
        F.array(line).alias("parts"),
    )


def flow_segments(spark: SparkSession, folder: str) -> DataFrame:
    return shape_segments(flowlines(spark, folder), "feature_id", "Flow")


def watersheds(spark: SparkSession, folder: str, hole: bool = False) -> DataFrame:
    """A 5 x 5 tiling of rectangles, optionally with a rectangular hole in each."""
    k = F.col("n_nationkey")
    x1 = (k % 5) * CELL_WIDTH
    y1 = F.floor(k / 5) * CELL_HEIGHT
    shell = rectangle(x1, y1, x1 + CELL_WIDTH, y1 + CELL_HEIGHT)
    rings = [shell]
    if hole:
        rings.append(rectangle(x1 + 5000, y1 + 5000, x1 + 15000, y1 + 12000))
    return table(spark, folder, "nation").select(
        k.alias("feature_id"), F.lpad(k.cast("string"), 12, "0").alias("huc12"),
        F.col("n_name").alias("name"), F.lit("Polygon").alias("geometry_type"),
        F.array(*rings).alias("parts"),
    )


def basins(spark: SparkSession, folder: str) -> DataFrame:
    """Five strips, each made of five watersheds."""
    k = F.col("r_regionkey")
    strip = rectangle(k * CELL_WIDTH, F.lit(0), (k + 1) * CELL_WIDTH, F.lit(5 * CELL_HEIGHT))
    return table(spark, folder, "region").select(
        k.alias("feature_id"), F.lpad(k.cast("string"), 10, "0").alias("huc10"),
        F.col("r_name").alias("name"), F.lit("Polygon").alias("geometry_type"),
        F.array(strip).alias("parts"),
    )


def pits(spark: SparkSession, folder: str, half: int = 700) -> DataFrame:
    """A square around every mine; squares overlap where mines are close."""
    x, y = F.col("x"), F.col("y")
    return mines(spark, folder).select(
        "feature_id", "layer", "name", F.lit("Polygon").alias("geometry_type"),
        F.array(rectangle(x - half, y - half, x + half, y + half)).alias("parts"),
    )


def treatment(spark: SparkSession, folder: str) -> DataFrame:
    """Inlet and outlet chemistry of treatment systems, one row per lineitem, with gaps."""
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        site_id(F.col("l_partkey")).alias(S.SITE), F.col("l_partkey").alias("site_key"),
        F.when(line % 5 != 0, F.col("l_extendedprice") / 9973).alias("Fe"),
        F.when(line != 7, q * 0.28).alias("pH_in"),
        F.when(~line.isin(6, 7), q * 0.25 + F.col("l_tax") * 10).alias("pH_out"),
        F.when(line != 7, F.col("l_discount") * 1000).alias("CondIn"),
        F.when(line != 7, F.col("l_tax") * 10000).alias("CondOut"),
        F.when(~line.isin(3, 7), q / 5 + 5).alias("TempIn"),
        F.when(~line.isin(4, 7), q / 4 + 6).alias("TempOut"),
        F.when(line % 2 == 1, q / 3 + 4).alias("Temperatur"),
        (F.col("l_discount") * 50).alias("IronIn"),
        F.when(line != 2, F.col("l_tax") * 100).alias("IronOut"),
        F.when(line != 1, F.col("l_extendedprice") * 10 / 9973).alias(S.VALUE),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def vectors(spark: SparkSession, folder: str, size: int = 8) -> tuple[DataFrame, list[str]]:
    """Embedding rows as feature columns, the first few dimensions or all."""
    names = [f"f{i}" for i in range(size)]
    columns = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    return table(spark, folder, "embeddings").select("vec_id", "label", *columns), names
