"""Queries that go through files: each writes what it derives from the tables and reads it back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork import schema as S
from rillwork.catalogue import sql as Q
from rillwork.catalogue.cleaning import short
from rillwork.catalogue.registry import query, rounded
from rillwork.functions import geometry as G
from rillwork.functions import values as V
from rillwork.operators import clean as C
from rillwork.operators import validity as X
from rillwork.plans import domain as D
from rillwork.session import scratch_path
from rillwork.sources import layers as Y
from rillwork.sources import sinks as K
from rillwork.sources import tables as R


@query("csv_scan", f"""
WITH {Q.RESULTS} SELECT analyte, COUNT(*) AS n, round(sum(v), 3) AS total,
  COUNT(DISTINCT site) AS n_sites FROM results GROUP BY analyte""")
def csv_scan(spark, folder):
    """Result CSV written and scanned with an explicit schema."""
    path = scratch_path(spark, "csv_scan")
    K.write_csv(D.results(spark, folder), path)
    typed = C.coerce_numeric(R.read_results(spark, path), [S.VALUE])
    return typed.groupBy(F.col(S.ANALYTE).alias("analyte")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(S.VALUE), 3).alias("total"),
        F.count_distinct(S.SITE).alias("n_sites"),
    )


# What becomes of each row: line 7 has too many fields, 6 too few, 4 a line break inside quotes, and 5 a quote that
# closes six lines on, which is more than the three that the queries take for a record.
_TOLERANT = """
tolerant AS (
  SELECT 'S' || CAST(l_partkey AS VARCHAR) AS site,
    CASE WHEN l_linenumber = 4 THEN 'two' || chr(10) || 'lines, "y"' ELSE 'x, "y"' END AS note,
    CASE WHEN l_linenumber <> 6 THEN CAST(l_linenumber AS VARCHAR) END AS line
  FROM lineitem WHERE l_linenumber NOT IN (5, 7)
  UNION ALL SELECT 'S' || CAST(l_partkey AS VARCHAR), 'plain', CAST(n AS VARCHAR)
  FROM lineitem, (SELECT unnest(range(4)) AS n) WHERE l_linenumber = 5
  UNION ALL SELECT 'S' || CAST(l_partkey AS VARCHAR), 'q', '8' FROM lineitem WHERE l_linenumber = 5)"""


def _tolerant_file(spark, folder):
    path = scratch_path(spark, "csv_tolerant")
    line, key = F.col("l_linenumber"), F.concat(F.lit("S"), F.col("l_partkey").cast("string"))
    number, note = line.cast("string"), F.lit('"x, ""y"""')
    lost = [F.concat_ws(",", key, F.lit('"never closed'), number)]
    lost += [F.concat_ws(",", key, F.lit("plain"), F.lit(str(n))) for n in range(4)] + [F.concat_ws(",", key, F.lit('"q"'), F.lit("8"))]
    text = (
        F.when(line == 7, F.concat_ws(",", key, note, number, F.lit("one,two")))
        .when(line == 6, F.concat_ws(",", key, note))
        .when(line == 5, F.concat_ws("\n", *lost))
        .when(line == 4, F.concat_ws(",", key, F.lit('"two\nlines, ""y"""'), number))
        .otherwise(F.concat_ws(",", key, note, number))
    )
    # Each part begins with the header: its first row has the lowest number of its partition.
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    header = F.when(first, "site,note,line\n").otherwise("")
    D.table(spark, folder, "lineitem").select(F.concat(header, text)).write.text(path)
    return path


@query("csv_tolerant", f"WITH {_TOLERANT} SELECT * FROM tolerant")
def csv_tolerant(spark, folder):
    """Long and broken records are skipped, short ones padded, line breaks inside quotes kept."""
    path = _tolerant_file(spark, folder)
    return R.read_csv_tolerant(spark, [path + "-absent", path], ["site", "note", "line", "absent"], max_lines=3)


@query("csv_tolerant_counts", f"""
WITH {_TOLERANT} SELECT (SELECT COUNT(*) FROM tolerant) AS kept, COUNT(*) AS skipped FROM lineitem WHERE l_linenumber IN (5, 7)""")
def csv_tolerant_counts(spark, folder):
    """Records that tolerant reading keeps and skips."""
    return R.tolerant_counts(spark, _tolerant_file(spark, folder), max_lines=3)


@query("csv_records", f"""
WITH parts AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem)
SELECT l_partkey % 50 AS part, COUNT(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines,
  CAST(sum(2 * (l_linenumber % 3)) AS BIGINT) AS breaks FROM parts GROUP BY 1""")
def csv_records(spark, folder):
    """A strict result file whose notes hold line breaks, none to four, read by all tasks that share it."""
    path = scratch_path(spark, "csv_records")
    breaks = F.repeat(F.lit('\n, "\n'), (F.col("l_linenumber") % 3).cast("int"))
    rows = D.table(spark, folder, "lineitem").select("l_partkey", "l_linenumber", F.concat(F.lit("note"), breaks, F.lit("end")).alias("note"))
    K.write_csv(rows, path)
    read = R.read_results(spark, path, multi_line=True)
    held = F.char_length("note") - F.char_length(F.replace("note", F.lit("\n"), F.lit("")))
    return read.groupBy((V.num(F.col("l_partkey")).cast("long") % 50).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("lines"), F.sum(held).alias("breaks"))


@query("csv_to_parquet", """
SELECT o_orderpriority, COUNT(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def csv_to_parquet(spark, folder):
    """CSV turned into Parquet, text unless listed as numbers."""
    path = scratch_path(spark, "orders_csv")
    D.table(spark, folder, "orders").write.option("header", True).csv(path)
    stored = R.csv_to_parquet(spark, path, scratch_path(spark, "orders_parquet"), ["o_totalprice"])
    return stored.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("cached_table", """
SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type""")
def cached_table(spark, folder):
    """Built once, read the second time; a stored table that fails its test is rebuilt."""
    path = scratch_path(spark, "cached")

    def build():
        return D.events(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    R.cached_table(spark, path, lambda: build().select("event_type"))
    R.cached_table(spark, path, build, valid=lambda t: "n" in t.columns)
    return R.cached_table(spark, path, build)


@query("clean_and_subset", f"""
WITH {Q.RAW}, c AS (SELECT DISTINCT trim(site) AS site, analyte, day_text, {Q.number("value_text")} AS v, unit FROM raw)
SELECT 'clean' AS part, analyte, COUNT(*) AS n, round(sum(v), 6) AS total FROM c GROUP BY analyte
UNION ALL SELECT 'subset', analyte, COUNT(*), round(sum(v), 6) FROM c
WHERE analyte IN ('pH', 'Iron', 'Manganese', 'Aluminum', 'Sulfate', 'Alkalinity', 'Specific conductance')
GROUP BY analyte""")
def clean_and_subset(spark, folder):
    """Cleaned table and its subset, cleaned once and written twice."""
    base = scratch_path(spark, "clean")
    K.write_clean_and_subset(D.raw_results(spark, folder), f"{base}/clean", f"{base}/subset")

    def summary(part):
        table = short(R.read_table(spark, f"{base}/{part}"))
        return table.groupBy(F.lit(part).alias("part"), "analyte").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))

    return summary("clean").unionByName(summary("subset"))


def _mine_features(spark, folder):
    point = F.array(F.array(F.array("x", "y")))
    return D.mines(spark, folder).select(
        "layer", "feature_id", "name", F.lit("Point").alias("geometry_type"), point.alias("parts"))


@query("geojson_points", f"""
WITH {Q.MINES} SELECT CAST(id AS VARCHAR) AS feature_id, layer AS kind, name, mx AS lon, my AS lat FROM mines""")
def geojson_points(spark, folder):
    """Point layer written as GeoJSON lines and read back."""
    path = scratch_path(spark, "points")
    K.write_geojson(_mine_features(spark, folder).withColumnRenamed("layer", "kind"), path)
    layer = Y.read_geojson(spark, path, "mines", id_property="feature_id")
    named = Y.properties_as_columns(Y.points(layer), ["kind", "name"])
    return named.select("feature_id", "kind", "name", "lon", "lat")


@query("geojson_shapes", f"""
WITH {Q.WATERSHEDS}, {Q.FLOW}
SELECT 'area' AS layer, 'Polygon' AS geometry_type, COUNT(*) AS n, COUNT(*) * 2 AS n_parts,
  CAST(sum(wx) AS DOUBLE) AS left_sum FROM watersheds
UNION ALL SELECT 'flow', 'LineString', COUNT(DISTINCT id), COUNT(DISTINCT id),
  sum(CASE WHEN first THEN least(ax, bx, cx) END)
FROM (SELECT id, ax, bx, lead(bx, 1, bx) OVER w AS cx, row_number() OVER w = 1 AS first
  FROM (SELECT id, CAST(x0 AS DOUBLE) AS ax, CAST(x1 AS DOUBLE) AS bx, 1 AS o FROM bends
        UNION ALL SELECT id, x1, x1 + 2000, 2 FROM bends) WINDOW w AS (PARTITION BY id ORDER BY o))
UNION ALL SELECT 'gone', NULL, 0, 0, NULL WHERE false""")
def geojson_shapes(spark, folder):
    """Polygons with holes and lines through GeoJSON; an absent layer is empty."""
    base = scratch_path(spark, "shapes")
    shapes = D.watersheds(spark, folder, hole=True)
    lines = D.flowlines(spark, folder)
    K.write_geojson(shapes, f"{base}/area")
    K.write_geojson(lines, f"{base}/flow")
    layers = [Y.read_geojson(spark, f"{base}/{n}", n, "feature_id") for n in ("area", "flow", "gone")]
    box = G.bounds(F.col("parts"))
    return R.union_by_name(layers).groupBy("layer", "geometry_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("parts")).alias("n_parts"),
        F.sum(box["bx1"]).alias("left_sum"))


@query("geojson_collection", f"""
WITH {Q.MINES} SELECT CAST(id AS VARCHAR) AS feature_id, name, mx AS lon, my AS lat FROM mines""")
def geojson_collection(spark, folder):
    """A point layer exported as one collection, with a feature to a line between head and foot."""
    path = scratch_path(spark, "collection")
    rows = _mine_features(spark, folder)
    # Every part is a collection of its own: features with a comma behind them, and a last one without.
    head = F.array(F.lit('{"type":"FeatureCollection","name":"mines",'), F.lit('"features": ['))
    feature = F.concat(K.feature_text(rows), F.lit(","))
    last = F.array(F.regexp_replace(feature, ",$", ""), F.lit("]}"))
    text = F.when(F.col("feature_id") % 50 == 0, F.concat(last, head)).otherwise(F.array(feature))
    rows.select(F.explode(text).alias("value")).write.text(path)
    layer = Y.read_geojson(spark, path, "mines", "feature_id")
    return Y.properties_as_columns(Y.points(layer), ["name"]).select("feature_id", "name", "lon", "lat")


@query("geojson_one_line", f"""
WITH {Q.MINES} SELECT CAST(id AS VARCHAR) AS feature_id, name || ' {{"}}, \\' AS name, mx AS lon, my AS lat FROM mines""")
def geojson_one_line(spark, folder):
    """Collections on one line each, with braces and quotes in texts and other members around the features."""
    path = scratch_path(spark, "one-line")
    rows = _mine_features(spark, folder).withColumn("name", F.concat("name", F.lit(' {"}, \\')))
    head = '{"name":"a } b","crs":{"type":"name","properties":{"features":[{"type":"Feature"}]}},"features": ['
    foot = '],"list":["a}b", {"type":"Feature","properties":{"feature_id":"none"}}]}'
    many = rows.groupBy(F.floor(F.col("feature_id") / 1000)).agg(
        F.array_join(F.collect_list(K.feature_text(rows)), ",").alias("features"))
    many.select(F.concat(F.lit(head), "features", F.lit(foot))).write.option("lineSep", " ").text(path)
    layer = Y.read_geojson(spark, path, "mines", "feature_id", lines=False)
    return Y.properties_as_columns(Y.points(layer), ["name"]).select("feature_id", "name", "lon", "lat")


@query("geojson_multipolygons", f"""
WITH {Q.WATERSHEDS} SELECT CAST(id AS VARCHAR) AS feature_id, '[0,0,1,1]' AS rings,
  round((20001.0::DOUBLE * 19999 * (wx + 20001 / 2) - 10000.0::DOUBLE * 7000 * (wx + 10000) + 16 * (wx + 30002) - 4 * (wx + 30002))
    / (20001.0::DOUBLE * 19999 - 10000.0::DOUBLE * 7000 + 16 - 4), 4) AS x FROM watersheds""")
def geojson_multipolygons(spark, folder):
    """Two polygons with a hole each, of either winding, written and read back; centroid by role."""
    path = scratch_path(spark, "multi")
    shapes = D.watersheds(spark, folder, hole=True)
    x, y = F.col("feature_id") % 5 * D.CELL_WIDTH + 30000, F.floor(F.col("feature_id") / 5) * D.CELL_HEIGHT
    second = F.array(D.rectangle(x, y, x + 4, y + 4), F.reverse(D.rectangle(x + 1, y + 1, x + 3, y + 3)))
    rings = shapes.select(
        "feature_id", F.lit("MultiPolygon").alias("geometry_type"), F.concat("parts", second).alias("parts"),
        F.array(*[F.lit(n) for n in (0, 0, 1, 1)]).alias("polygon_of"))
    K.write_geojson(rings, path)
    layer = Y.read_geojson(spark, path, "multi", "feature_id")
    middle = G.centroid(F.col("parts"), F.col("polygon_of"))
    return layer.select("feature_id", F.to_json("polygon_of").alias("rings"), F.round(middle["x"], 4).alias("x"))


@query("layer_files", f"""
WITH {Q.MINES} SELECT lower(layer) AS layer, COUNT(*) AS n, round(sum(mx), 3) AS sum_x FROM mines GROUP BY 1""")
def layer_files(spark, folder):
    """One GeoJSON file set per layer, read through a glob; the layer comes from the file name."""
    base = scratch_path(spark, "layers")
    file = F.concat(F.lower("layer"), F.lit(".geojson"))
    rows = _mine_features(spark, folder).withColumn("file", file)
    text = rows.select("file", K.feature_text(rows.drop("file")).alias("value"))
    text.write.partitionBy("file").text(base)
    every = Y.read_layers(spark, f"{base}/*.geojson", "feature_id")
    return Y.points(every).groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("lon"), 3).alias("sum_x"))


def _stored_pages(spark, folder):
    """Response pages of fifty features; every seventh page is cut off."""
    path = scratch_path(spark, "pages")
    rows = _mine_features(spark, folder)
    page = F.floor(F.col("feature_id") / 50)
    features = F.concat_ws(",", F.sort_array(F.collect_list("f")))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), features, F.lit("]}"))
    pages = (
        rows.select(page.alias("page"), K.feature_text(rows).alias("f"))
        .groupBy("page").agg(whole.alias("value"))
        .select(F.when(F.col("page") % 7 == 3, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value"))
                .alias("value"))
    )
    pages.write.text(path)
    return path


@query("feature_pages", f"""
WITH {Q.MINES} SELECT CAST(id AS VARCHAR) AS feature_id, mx AS lon, my AS lat FROM mines WHERE (id // 50) % 7 <> 3""")
def feature_pages(spark, folder):
    """Stored response pages of fifty features; every seventh page is cut off and skipped."""
    path = _stored_pages(spark, folder)
    return Y.points(Y.read_feature_pages(spark, path, "mines", "feature_id")).select("feature_id", "lon", "lat")


@query("page_counts", f"""
WITH {Q.MINES}, p AS (SELECT DISTINCT id // 50 AS page FROM mines)
SELECT COUNT(*) FILTER (WHERE page % 7 <> 3) AS read, COUNT(*) FILTER (WHERE page % 7 = 3) AS skipped FROM p""")
def page_counts(spark, folder):
    """How many stored pages are read and how many are left out."""
    return Y.page_counts(spark, _stored_pages(spark, folder))


@query("latest_files", f"""
WITH {Q.RESULTS} SELECT CASE analyte WHEN 'Specific conductance' THEN 'Specific_Conductance' WHEN 'pH' THEN 'Ph'
  ELSE analyte END AS analyte, lpad(CAST(site_key % 25 AS VARCHAR), 12, '0') AS huc12, COUNT(*) AS n,
  round(avg(v), 6) AS mean FROM results GROUP BY 1, 2""")
def latest_files(spark, folder):
    """One CSV set per analyte, with headers in three orders; the analyte comes from the file name, codes keep their zeros."""
    base = scratch_path(spark, "latest")
    file = F.concat(F.lower(F.replace(S.ANALYTE, F.lit(" "), F.lit("_"))), F.lit("_latest.csv"))
    code = F.substring(S.SITE, 2, 20).cast("long") % 25
    rows = D.results(spark, folder).select(
        S.SITE, S.VALUE, S.LAT, S.LON, F.lit("01010101").alias("HUCEightDigitCode"),
        F.lpad(code.cast("string"), 12, "0").alias("HUCTwelveDigitCode"), file.alias("file"),
    )
    for number in range(3):
        names = [c for c in rows.columns if c != "file"]
        order = [names, names[::-1], [*names[2:], "unused", *names[:2]]][number]
        part = rows.where(F.pmod(F.crc32(F.col("file").cast("binary")), F.lit(3)) == number).withColumn("unused", F.lit("x"))
        part.select(*order, "file").write.mode("append").partitionBy("file").option("header", True).csv(base)
    table = R.read_latest(spark, base)
    return rounded(table.groupBy(F.col(S.ANALYTE).alias("analyte"), F.col("HUC12").alias("huc12")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(S.VALUE).alias("mean")))


@query("dimension_scan", """
SELECT s_suppkey AS site_key, s_name AS name, CAST(NULL AS DOUBLE) AS weight FROM supplier""")
def dimension_scan(spark, folder):
    """A dimension table on file, joined with one that is absent."""
    path = scratch_path(spark, "dimension")
    schema = T.StructType([T.StructField("site_key", T.LongType()), T.StructField("name", T.StringType())])
    K.write_csv(D.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("site_key"), F.col("s_name").alias("name")), path)
    weights = T.StructType([T.StructField("site_key", T.LongType()), T.StructField("weight", T.DoubleType())])
    absent = R.read_dimension(spark, path + "-absent", weights)
    return R.read_dimension(spark, path, schema).join(absent, "site_key", "left")


@query("name_points", 'SELECT s_suppkey AS "PASSIVE_NAME", s_acctbal FROM supplier')
def name_points(spark, folder):
    """The first name-like column of a point layer gets a standard name."""
    table = D.table(spark, folder, "supplier").select(
        "s_acctbal", F.col("s_suppkey").alias("Sys_ID"), F.col("s_name").alias("Site Name"))
    return Y.name_points(table).select("PASSIVE_NAME", "s_acctbal")


@query("append_layers", f"""
WITH {Q.MINES} SELECT layer, COUNT(*) AS n, round(sum(mx + my), 3) AS total FROM mines GROUP BY layer""")
def append_layers(spark, folder):
    """A master table grown layer by layer."""
    path = scratch_path(spark, "master")
    mines = D.mines(spark, folder)
    for layer in D.LAYER_OF:
        K.append_layer(mines.where(F.col("layer") == layer), path)
    total = F.round(F.sum(F.col("x") + F.col("y")), 3)
    return R.read_table(spark, path).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), total.alias("total"))


@query("preview", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000""")
def preview(spark, folder):
    """The first thousand rows in a fixed order, for a look."""
    table = D.table(spark, folder, "orders").withColumn("_down", -F.col("o_totalprice"))
    return K.preview(table, ["_down", "o_orderkey"], 1000).select("o_orderkey", "o_totalprice")


@query("resume_missing", """
SELECT event_id, event_type, round(value * 2, 6) AS doubled FROM events""")
def resume_missing(spark, folder):
    """A partly written output is completed: only missing keys are computed."""
    path = scratch_path(spark, "resume")
    todo = D.events(spark, folder).select(
        "event_id", "event_type", F.round(F.col("value") * 2, 6).alias("doubled"))
    # The first run got as far as the events of one kind.
    K.append_missing(todo.where("event_type <> 'click'"), path, ["event_id"])
    return K.append_missing(todo, path, ["event_id"])


@query("resume_chunks", """
SELECT event_type AS layer, user_id, COUNT(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def resume_chunks(spark, folder):
    """A run over chunks of each kind dies after some of them, half a chunk written; the next one finishes and replaces."""
    path = scratch_path(spark, "chunks")
    events = K.with_chunks(D.events(spark, folder).withColumn("layer", F.col("event_type")), ["user_id"], 6)
    by, runs = ["layer", "chunk"], []

    def totals(part):
        runs.append(1)
        if len(runs) == 3:
            # Half of the group reaches the disk, once with wrong numbers, before the run ends.
            half = part.where("user_id % 2 = 0").groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("n"), F.lit(-1.0).alias("total"))
            for _ in range(2):
                half.write.mode("append").partitionBy(*by).parquet(path)
            raise InterruptedError("the run ends here")
        return part.groupBy(*by, "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))

    try:
        K.finish_chunks(events, path, totals, by, at_once=4)
    except InterruptedError:
        pass
    return K.finish_chunks(events, path, totals, by, at_once=4).select("layer", "user_id", "n", "total")


# Outlines by kind: ring, place of the vertex, x and y from the feature's corner. A square, a bow tie, a ring that touches
# itself, a hole across its shell, a hole that touches its shell in a point, a spike, and a ring with a long side that is a hole's, too.
_OUTLINES = [
    [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]],
    [[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]],
    [[(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5), (0, 0)]],
    [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(5, 5), (15, 5), (15, 8), (5, 8), (5, 5)]],
    [[(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(0, 5), (4, 4), (4, 6), (0, 5)]],
    [[(0, 0), (10, 0), (10, 10), (10, 20), (10, 10), (0, 10), (0, 0)]],
    [[(0, 0), (10, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 0), (8, 0), (5, 4), (2, 0)]],
]
_OUTLINE_ROWS = ", ".join(
    f"({kind}, {ring}, {at}, {x}, {y})" for kind, rings in enumerate(_OUTLINES) for ring, points in enumerate(rings) for at, (x, y) in enumerate(points))


@query("qc_counts", f"""
WITH {Q.MINES}, outline(kind, ring, pos, dx, dy) AS (VALUES {_OUTLINE_ROWS}),
vertex AS (
  SELECT id, layer, ring, pos, mx + dx AS x, my + dy AS y,
    lag(mx + dx) OVER w IS NOT NULL AND lag(mx + dx) OVER w = mx + dx AND lag(my + dy) OVER w = my + dy AS again
  FROM mines JOIN outline ON kind = id % 7 WHERE id % 11 <> 0 AND id % 13 <> 0 WINDOW w AS (PARTITION BY id, ring ORDER BY pos)),
edge AS (
  SELECT id, layer, ring, row_number() OVER w AS pos, count(*) OVER (PARTITION BY id, ring) - 1 AS n, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2
  FROM vertex WHERE NOT again WINDOW w AS (PARTITION BY id, ring ORDER BY pos)),
turned AS (
  SELECT a.id, a.layer, a.ring = b.ring AS same, abs(a.pos - b.pos) IN (1, a.n - 1) AS next,
    sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) AS t1, sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS t2,
    sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) AS t3, sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS t4,
    least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) - greatest(least(a.x1, a.x2), least(b.x1, b.x2)) AS sx,
    least(greatest(a.y1, a.y2), greatest(b.y1, b.y2)) - greatest(least(a.y1, a.y2), least(b.y1, b.y2)) AS sy
  FROM edge a JOIN edge b ON a.id = b.id AND (a.ring, a.pos) < (b.ring, b.pos) AND a.x2 IS NOT NULL AND b.x2 IS NOT NULL),
wrong AS (
  SELECT DISTINCT id, layer FROM turned
  WHERE (t1 * t2 < 0 AND t3 * t4 < 0) OR (t1 = 0 AND t2 = 0 AND t3 = 0 AND t4 = 0 AND least(sx, sy) >= 0 AND greatest(sx, sy) > 0)
    OR (same AND NOT next AND least(sx, sy) >= 0 AND t1 * t2 <= 0 AND t3 * t4 <= 0))
SELECT layer, 'missing' AS reason, COUNT(CASE WHEN id % 11 = 0 THEN 1 END) AS rejected FROM mines GROUP BY 1
UNION ALL SELECT layer, 'invalid', COUNT(CASE WHEN id % 13 = 0 OR id % 11 = 0 THEN 1 END) FROM mines GROUP BY 1
UNION ALL SELECT m.layer, 'crossing', COUNT(wrong.id) FROM mines m LEFT JOIN wrong USING (id) GROUP BY 1
UNION ALL SELECT layer, 'far_east', COUNT(CASE WHEN mx > 90000 THEN 1 END) FROM mines GROUP BY 1""")
def qc_counts(spark, folder):
    """Rejected features per layer and reason; outlines of seven kinds, some of which cross or touch themselves."""
    x, y, key = F.col("x"), F.col("y"), F.col("feature_id")
    outline = F.lit(None)
    for kind, rings in enumerate(_OUTLINES):
        shape = F.array(*[D.vertices(*[(x + dx, y + dy) for dx, dy in points]) for points in rings])
        outline = F.when(key % 7 == kind, shape).otherwise(outline)
    open_ring = F.array(D.vertices((x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10)))
    parts = F.when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, open_ring).otherwise(outline)
    shapes = X.with_crossing(D.mines(spark, folder).withColumn("parts", parts))
    return K.qc_counts(shapes, {
        "missing": F.col("parts").isNull(),
        "invalid": ~G.valid_geometry(F.col("parts"), F.lit("polygon")),
        "crossing": F.col("crossing"),
        "far_east": x > 90000,
    })


@query("union_layers", f"""
WITH {Q.MINES} SELECT layer, name, mx AS x, CAST(NULL AS DOUBLE) AS balance FROM mines
UNION ALL SELECT 'Supplier', s_name, NULL, s_acctbal FROM supplier""")
def union_layers(spark, folder):
    """Tables with different columns united by name."""
    suppliers = D.table(spark, folder, "supplier").select(
        F.lit("Supplier").alias("layer"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    mines = D.mines(spark, folder).select("layer", "name", "x")
    return R.union_by_name([mines, suppliers])


@query("key_value_text", """
SELECT c_custkey, 'c_name: ' || c_name || '<br>c_mktsegment: ' || c_mktsegment AS popup FROM customer""")
def key_value_text(spark, folder):
    """Row as ``name: value`` text."""
    return D.table(spark, folder, "customer").select(
        "c_custkey", V.key_value_text(["c_name", "c_mktsegment"]).alias("popup"))
