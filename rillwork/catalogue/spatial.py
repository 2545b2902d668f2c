"""Queries over spatial joins, projection, and what builds on them."""

from pyspark.sql import functions as F

from rillwork import schema as S
from rillwork.catalogue import sql as Q
from rillwork.catalogue.registry import query, rounded
from rillwork.functions import geometry as G
from rillwork.operators import clean as C
from rillwork.operators import health as H
from rillwork.operators import nearest as N
from rillwork.operators.within import within_join as join_within
from rillwork.plans import domain as D
from rillwork.plans import linking as L
from rillwork.session import scratch_path
from rillwork.sources.layers import read_geojson
from rillwork.sources.sinks import write_geojson, write_table
from rillwork.sources.tables import read_table
from rillwork.sources.tables import to_points as points_of


def _sites(spark, folder):
    return D.sites(spark, folder).select(F.col(S.SITE).alias("site"), "x_m", "y_m")


def _all_mines(spark, folder):
    return N.point_segments(D.mines(spark, folder), "feature_id", "x", "y", "mines")


LON_LAT_SQL = "mx / 100003 * 5.8 - 80.5 AS lon, my / 99991 * 2.3 + 39.7 AS lat"
PAIRS = f"pairs AS (SELECT site, id, layer, {Q.DISTANCE} AS d FROM sites, mines)"


@query("nearest_bounded", f"""
WITH {Q.SITES}, {Q.MINES}, {PAIRS},
near AS (SELECT site, id, d, dense_rank() OVER (PARTITION BY site ORDER BY d) AS r FROM pairs WHERE d <= 1200)
SELECT s.site, n.id AS feature_id, round(n.d, 6) AS dist_m FROM sites s
LEFT JOIN (SELECT * FROM near WHERE r = 1) n ON s.site = n.site""")
def nearest_bounded(spark, folder):
    """Bounded nearest join with all ties; sites without a feature in reach stay."""
    joined = N.nearest_join(_sites(spark, folder), _all_mines(spark, folder), 1200.0, ties="all")
    return rounded(joined.select("site", "feature_id", "dist_m"))


@query("nearest_unbounded", f"""
WITH {Q.SITES}, {Q.MINES}, {PAIRS}
SELECT site, arg_min(id, d) AS feature_id, round(min(d), 6) AS dist_m FROM pairs GROUP BY site""")
def nearest_unbounded(spark, folder):
    """Unbounded nearest join with one winner."""
    joined = N.nearest_join(_sites(spark, folder), _all_mines(spark, folder), None, ties="first")
    return rounded(joined.select("site", "feature_id", "dist_m"))


@query("nearest_samples", f"""
WITH {Q.SITES}, {Q.MINES}, best AS (
  SELECT site_key, min({Q.DISTANCE}) AS d FROM sites, mines WHERE layer = 'Bituminous' GROUP BY site_key)
SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day,
  round(CASE WHEN d <= 3000 THEN d END, 6) AS dist_m
FROM lineitem LEFT JOIN best ON l_partkey = site_key""")
def nearest_samples(spark, folder):
    """Distance for every sample, computed once per distinct location."""
    samples = D.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        D.site_x(F.col("l_partkey")).alias("x_m"), D.site_y(F.col("l_partkey")).alias("y_m"),
    )
    layer = D.mine_layers(spark, folder)["Bituminous"]
    joined = N.nearest_join(samples, layer, 3000.0, ties="first")
    return rounded(joined.select("l_orderkey", "l_linenumber", "day", "dist_m"))


LINE_DISTANCE = """sqrt(pow(x - (ax + t * (ex - ax)), 2) + pow(y - (ay + t * (ey - ay)), 2))"""
FLOW_PAIRS = f"""
along AS (SELECT site, id, x, y, ax, ay, ex, ey, greatest(0.0, least(1.0,
  ((x - ax) * (ex - ax) + (y - ay) * (ey - ay)) / ((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)))) AS t
  FROM sites, flow),
flow_pairs AS (SELECT site, id, {LINE_DISTANCE} AS d FROM along)"""


@query("nearest_line", f"""
WITH {Q.SITES}, {Q.FLOW}, {FLOW_PAIRS}, best AS (SELECT site, min(d) AS d FROM flow_pairs GROUP BY site)
SELECT s.site, round(CASE WHEN d <= 4000 THEN d END, 5) AS dist_m FROM sites s LEFT JOIN best b ON s.site = b.site""")
def nearest_line(spark, folder):
    """Distance to the nearest line within a bound."""
    joined = N.nearest_join(_sites(spark, folder), D.flow_segments(spark, folder), 4000.0, ties="first")
    return rounded(joined.select("site", "dist_m"), 5)


@query("nearest_polygon", f"""
WITH {Q.SITES}, {Q.MINES}, boxes AS (
  SELECT site, id, greatest(abs(x - mx) - 700, 0) AS dx, greatest(abs(y - my) - 700, 0) AS dy FROM sites, mines),
best AS (SELECT site, min(sqrt(dx * dx + dy * dy)) AS d FROM boxes GROUP BY site)
SELECT s.site, round(CASE WHEN d <= 900 THEN d END, 6) AS dist_m FROM sites s LEFT JOIN best b ON s.site = b.site""")
def nearest_polygon(spark, folder):
    """Distance to the nearest polygon: 0 inside, else to its edge."""
    pits = D.pits(spark, folder)
    edges = N.shape_segments(pits, "feature_id", "pits")
    joined = N.nearest_join(
        _sites(spark, folder), edges, 900.0, ties="first", polygons=pits.select("feature_id", "parts")
    )
    return rounded(joined.select("site", "dist_m"))


LAYERS = list(D.LAYER_OF)


@query("attach_layers", f"""
WITH {Q.SITES}, {Q.MINES}, {Q.FLOW}, {FLOW_PAIRS}, {PAIRS},
hits AS (SELECT site, layer, id, d FROM pairs WHERE d <= 2500
  UNION ALL SELECT site, 'Flow', id, d FROM flow_pairs WHERE d <= 2500)
SELECT s.site, {", ".join(
    f'''arg_min(id, d) FILTER (WHERE layer = '{n}') AS "{n}_id",
  round(min(d) FILTER (WHERE layer = '{n}'), 5) AS "{n}_dist_m"''' for n in LAYERS)},
  round(min(d) FILTER (WHERE layer = 'Flow'), 5) AS "Flow_dist_m",
  max(name) AS "AML_name"
FROM sites s LEFT JOIN hits h ON s.site = h.site
LEFT JOIN (SELECT site AS nsite, arg_min(name, d) AS name FROM (SELECT site, name, {Q.DISTANCE} AS d FROM sites, mines
  WHERE layer = 'AML') WHERE d <= 2500 GROUP BY site) a ON a.nsite = s.site
GROUP BY s.site""")
def attach_layers(spark, folder):
    """Nearest feature of each of six layers with attributes; an absent layer is skipped."""
    layers = {**D.mine_layers(spark, folder), "Flow": D.flow_segments(spark, folder), "Gone": None}
    names = D.mines(spark, folder).where("layer = 'AML'").select("feature_id", "name")
    joined = N.attach_nearest(_sites(spark, folder), layers, {"AML": names}, 2500.0)
    return rounded(joined.drop("x_m", "y_m", "Flow_id"), 5)


SQUARES = f"""
squares AS (SELECT site, id, layer, sqrt(power(greatest(abs(x - mx) - 700, 0), 2) + power(greatest(abs(y - my) - 700, 0), 2)) AS d
  FROM sites, mines WHERE layer IN ('AML', 'Bituminous')
  UNION ALL SELECT site, id, layer, {Q.DISTANCE} FROM sites, mines WHERE layer = 'Passive'),
near AS (SELECT *, min(d) OVER (PARTITION BY site, layer) AS least FROM squares WHERE d <= 2500)"""


def _polygon_layers(spark, folder):
    """Two layers of squares that overlap, and one of points."""
    squares = D.pits(spark, folder)
    layers = {n: squares.where(F.col("layer") == n).drop("layer") for n in ("AML", "Bituminous")}
    return {**layers, "Passive": D.mine_layers(spark, folder)["Passive"]}


@query("attach_polygons", f"""
WITH {Q.SITES}, {Q.MINES}, {SQUARES}
SELECT s.site, {", ".join(
    f'''min(id) FILTER (WHERE layer = '{n}' AND d = least) AS "{n}_id",
  round(min(d) FILTER (WHERE layer = '{n}'), 5) AS "{n}_dist_m"''' for n in ("AML", "Bituminous", "Passive"))}
FROM sites s LEFT JOIN near n ON s.site = n.site GROUP BY s.site""")
def attach_polygons(spark, folder):
    """Nearest of two polygon layers and a point layer: 0 inside a polygon, the lowest id of equals."""
    joined = N.attach_nearest(_sites(spark, folder), _polygon_layers(spark, folder), max_m=2500.0)
    return rounded(joined.drop("x_m", "y_m"), 5)


@query("attach_polygons_ties", f"""
WITH {Q.SITES}, {Q.MINES}, {SQUARES}
SELECT s.site, a.id AS "AML_id", b.id AS "Bituminous_id", round(a.d, 5) AS "AML_dist_m", round(b.d, 5) AS "Bituminous_dist_m"
FROM sites s LEFT JOIN near a ON s.site = a.site AND a.layer = 'AML' AND a.d = a.least
LEFT JOIN near b ON s.site = b.site AND b.layer = 'Bituminous' AND b.d = b.least""")
def attach_polygons_ties(spark, folder):
    """Every feature at the smallest distance, here all squares that a site lies in."""
    layers = _polygon_layers(spark, folder)
    del layers["Passive"]
    joined = N.attach_nearest(_sites(spark, folder), layers, max_m=2500.0, ties="all")
    return rounded(joined.drop("x_m", "y_m"), 5)


@query("nearest_overall", f"""
WITH {Q.SITES}, {Q.MINES}, {PAIRS}, best AS (
  SELECT site, arg_min(layer, d) AS t, min(d) AS d FROM pairs WHERE d <= 1000 GROUP BY site)
SELECT s.site, t AS nearest_type, round(d, 6) AS nearest_dist_m FROM sites s LEFT JOIN best b ON s.site = b.site""")
def nearest_overall(spark, folder):
    """Closest of all layers; sites without any layer in reach have none."""
    layers = D.mine_layers(spark, folder)
    joined = N.attach_nearest(_sites(spark, folder), layers, max_m=1000.0)
    found = N.nearest_overall(joined, list(layers))
    return rounded(found.select("site", "nearest_type", "nearest_dist_m"))


INSIDE = "x > wx AND x < wx + 20001 AND y > wy AND y < wy + 19999"
STRIP = "x > b.wx AND x < b.wx + 20001 AND y > 0 AND y < 99995"


@query("within_join", f"""
WITH {Q.SITES}, {Q.WATERSHEDS}, {Q.BASINS}
SELECT s.site, b.huc10 AS "HUC10_ID", b.name AS "HUC10_NAME", w.huc12 AS "HUC12_ID", w.name AS "HUC12_NAME"
FROM sites s LEFT JOIN basins b ON {STRIP}
LEFT JOIN watersheds w ON s.x > w.wx AND s.x < w.wx + 20001 AND s.y > w.wy AND s.y < w.wy + 19999""")
def within_join(spark, folder):
    """Two containment joins in turn."""
    joined = join_within(
        _sites(spark, folder), D.basins(spark, folder), {"huc10": "HUC10_ID", "name": "HUC10_NAME"})
    joined = join_within(joined, D.watersheds(spark, folder), {"huc12": "HUC12_ID", "name": "HUC12_NAME"})
    return joined.drop("x_m", "y_m")


@query("within_join_holes", f"""
WITH {Q.SITES}, {Q.WATERSHEDS}
SELECT site, huc12 FROM sites LEFT JOIN watersheds ON {INSIDE}
  AND NOT (x >= wx + 5000 AND x <= wx + 15000 AND y >= wy + 5000 AND y <= wy + 12000)""")
def within_join_holes(spark, folder):
    """Points in a hole are not inside."""
    rings = D.watersheds(spark, folder, hole=True)
    return join_within(_sites(spark, folder), rings, {"huc12": "huc12"}).drop("x_m", "y_m")


@query("within_join_overlaps", f"""
WITH {Q.SITES}, {Q.MINES}
SELECT site, id AS pit FROM sites LEFT JOIN mines ON abs(x - mx) < 700 AND abs(y - my) < 700""")
def within_join_overlaps(spark, folder):
    """Overlapping polygons multiply rows."""
    pits = D.pits(spark, folder)
    return join_within(_sites(spark, folder), pits, {"feature_id": "pit"}).drop("x_m", "y_m")


def _utm_ctes(source: str, out: str) -> str:
    """CTEs that project a table (key, lon, lat, ...) to ``out`` with columns ux and uy."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    s = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * n**0.5 / (1 + n)
    east = " + ".join(["eta", *[f"{c!r} * cos({2*j} * xi) * sinh({2*j} * eta)" for j, c in enumerate(s, 1)]])
    north = " + ".join(["xi", *[f"{c!r} * sin({2*j} * xi) * cosh({2*j} * eta)" for j, c in enumerate(s, 1)]])
    return f"""
{out}_a AS (SELECT *, sin(radians(lat)) AS sl, radians(lon + 81) AS w FROM {source}),
{out}_b AS (SELECT *, sinh(atanh(sl) - {e!r} * atanh({e!r} * sl)) AS t FROM {out}_a),
{out}_c AS (SELECT *, atan2(t, cos(w)) AS xi, atanh(sin(w) / sqrt(1 + t * t)) AS eta FROM {out}_b),
{out} AS (SELECT *, 500000 + {a!r} * ({east}) AS ux, {a!r} * ({north}) AS uy FROM {out}_c)"""


@query("project_utm", f"""
WITH {Q.SITES}, {_utm_ctes("sites", "utm")}
SELECT site, round(lon, 3) AS lon, round(lat, 3) AS lat, round(ux, 3) AS x_m, round(uy, 3) AS y_m FROM utm""")
def project_utm(spark, folder):
    """Longitude and latitude to UTM metres, beside the degrees."""
    table = D.sites(spark, folder).select(F.col(S.SITE).alias("site"), "lon", "lat")
    return rounded(G.project_utm(table), 3)


@query("nearest_geojson", f"""
WITH {Q.SITES}, {Q.MINES}, places AS (SELECT id, {LON_LAT_SQL} FROM mines), {_utm_ctes("sites", "us")},
{_utm_ctes("places", "um")},
best AS (SELECT site, arg_min(id, d) AS id, min(d) AS d FROM (
  SELECT site, id, sqrt(pow(us.ux - um.ux, 2) + pow(us.uy - um.uy, 2)) AS d FROM us, um
  WHERE abs(us.ux - um.ux) <= 9000 AND abs(us.uy - um.uy) <= 9000) WHERE d <= 9000 GROUP BY site)
SELECT s.site, CAST(id AS VARCHAR) AS feature_id, round(d, 3) AS dist_m FROM sites s LEFT JOIN best b ON s.site = b.site""")
def nearest_geojson(spark, folder):
    """From stored GeoJSON in degrees to distances in metres: read, project, join."""
    path = scratch_path(spark, "nearest_geojson")
    place = F.array(D.lon_of(F.col("x")), D.lat_of(F.col("y")))
    features = D.mines(spark, folder).select(
        "feature_id", F.lit("Point").alias("geometry_type"), F.array(F.array(place)).alias("parts"))
    write_geojson(features, path)
    layer = read_geojson(spark, path, "mines", "feature_id")
    segments = G.project_edges(G.explode_edges(layer))
    points = G.project_utm(D.sites(spark, folder).select(F.col(S.SITE).alias("site"), "lon", "lat"))
    joined = N.nearest_join(points, segments, 9000.0, ties="first")
    return rounded(joined.select("site", "feature_id", "dist_m"), 3)


@query("feature_table", f"""
WITH {Q.SITES}, {Q.WATERSHEDS}
SELECT huc12, COUNT(*) AS n_sites FROM sites JOIN watersheds ON {INSIDE} GROUP BY huc12""")
def feature_table(spark, folder):
    """Polygons stored as a Parquet feature table, read back and joined."""
    path = scratch_path(spark, "features")
    write_table(D.watersheds(spark, folder), path)
    joined = join_within(_sites(spark, folder), read_table(spark, path), {"huc12": "huc12"})
    return joined.where("huc12 IS NOT NULL").groupBy("huc12").agg(F.count(F.lit(1)).alias("n_sites"))


@query("to_points", f"""
WITH {Q.SITES}, t AS (
  SELECT site, CASE WHEN site_type = 'Stream' THEN lat + 60 ELSE lat END AS lat,
    CASE WHEN site_type = 'Outfall' THEN NULL ELSE lon END AS lon FROM sites)
SELECT site, round(lat, 6) AS lat, round(lon, 6) AS lon FROM t WHERE abs(lat) <= 90 AND abs(lon) <= 180""")
def to_points(spark, folder):
    """Point table without bad or missing coordinates."""
    kind = F.col("site_type")
    raw = D.sites(spark, folder).select(
        F.col(S.SITE).alias("site"),
        F.when(kind == "Stream", F.col("lat") + 60).otherwise(F.col("lat")).cast("string").alias(S.LAT),
        F.when(kind == "Outfall", F.lit("n/a")).otherwise(F.col("lon").cast("string")).alias(S.LON),
    )
    return rounded(points_of(raw).select("site", "lat", "lon"))


@query("explode_edges", f"""
WITH {Q.FLOW} SELECT id AS feature_id, ax AS x1, ay AS y1, ex AS x2, ey AS y2 FROM flow""")
def explode_edges(spark, folder):
    return N.shape_segments(D.flowlines(spark, folder), "feature_id", "Flow").drop("layer")


@query("polygon_centroids", f"""
WITH {Q.WATERSHEDS} SELECT huc12, round(wx + 20001 / 2, 6) AS x, round(wy + 19999 / 2, 6) AS y,
  CAST(wx AS DOUBLE) AS bx1, CAST(wy + 19999 AS DOUBLE) AS by2, 'polygon' AS kind FROM watersheds""")
def polygon_centroids(spark, folder):
    """Centroid, bounding box and part type of polygons."""
    c, b = G.centroid(F.col("parts")), G.bounds(F.col("parts"))
    shapes = D.watersheds(spark, folder)
    return rounded(shapes.select(
        "huc12", c["x"].alias("x"), c["y"].alias("y"), b["bx1"].alias("bx1"), b["by2"].alias("by2"),
        G.part_type(F.col("parts")).alias("kind"),
    ))


@query("map_center", f"""
WITH {Q.WATERSHEDS} SELECT round(avg(wx + 20001 / 2), 5) AS center_x, round(avg(wy + 19999 / 2), 5) AS center_y
FROM watersheds""")
def map_center(spark, folder):
    return rounded(L.map_center(D.watersheds(spark, folder)), 5)


def _joined(spark, folder, layer="Bituminous", max_m=4000.0):
    """Treatment rows with watershed and distance of their site."""
    linked = L.link_sites(
        D.sites(spark, folder).withColumnRenamed(S.SITE, "site"), "site",
        {layer: D.mine_layers(spark, folder)[layer]}, watersheds=D.watersheds(spark, folder), max_m=max_m,
    )
    samples = D.treatment(spark, folder).withColumnRenamed(S.SITE, "site")
    return L.link_samples(samples, linked, "site")


def _joined_sql(layer: str) -> str:
    return f"""{Q.SITES}, {Q.MINES}, {Q.WATERSHEDS}, {Q.TREATMENT},
dist AS (SELECT site, min({Q.DISTANCE}) AS d FROM sites, mines WHERE layer = '{layer}' GROUP BY site),
linked AS (SELECT s.site, huc12, CASE WHEN d <= 4000 THEN d END AS dist FROM sites s
  LEFT JOIN watersheds ON {INSIDE} LEFT JOIN dist ON s.site = dist.site),
joined AS (SELECT t.*, huc12, dist FROM treatment t LEFT JOIN linked l ON t.site = l.site)"""


def _norm(c: str) -> str:
    return f"(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0))"


HEALTH_V1 = f"""
WITH {_joined_sql("Bituminous")},
kept AS (SELECT * FROM joined WHERE huc12 IS NOT NULL AND coalesce(dist, Fe, v, Temperatur) IS NOT NULL),
norm AS (SELECT huc12, Fe, v, Temperatur, dist, {_norm("Fe")} AS a, {_norm("v")} AS b,
  {_norm("Temperatur")} AS c, {_norm("dist")} AS dn FROM kept),
scored AS (SELECT *, 0.6 * {Q.row_mean("a", "b", "c")} + 0.4 * (1 - dn) AS si FROM norm),
summary AS (SELECT huc12, avg(Fe) AS f, avg(v) AS m, avg(Temperatur) AS t, avg(dist) AS d, avg(si) AS s
  FROM scored GROUP BY huc12)
SELECT huc12 AS "HUC12_ID", round(f, 6) AS "Mean_Fe", round(m, 6) AS "Mean_Analyte", round(t, 6) AS "Mean_Temp",
  round(d, 6) AS "Mean_Dist_M", round(s, 6) AS "Sickness_Index",
  CASE WHEN s IS NOT NULL THEN CAST(dense_rank() OVER (ORDER BY s DESC NULLS LAST) AS INTEGER) END AS "Rank"
FROM summary"""


@query("health_v1", HEALTH_V1)
def health_v1(spark, folder):
    """Watershed scores from chemistry and distance, ranked."""
    joined = _joined(spark, folder)
    return rounded(L.watershed_health_v1(joined, S.HEALTH_CHEMISTRY, "Bituminous_dist_m", "HUC12_ID"))


@query("health_v2", f"""
WITH {_joined_sql("AML")},
merged AS (SELECT huc12, dist, {Q.row_mean("nullif(IronIn, 0)", "nullif(IronOut, 0)")} AS i,
  {Q.row_mean("nullif(CondIn, 0)", "nullif(CondOut, 0)")} AS c,
  {Q.row_mean("nullif(TempIn, 0)", "nullif(TempOut, 0)")} AS t FROM joined),
med AS (SELECT quantile_cont(i, 0.5) AS mi, quantile_cont(c, 0.5) AS mc, quantile_cont(t, 0.5) AS mt,
  quantile_cont(dist, 0.5) AS md FROM merged),
filled AS (SELECT huc12, dist, i, c, t, coalesce(i, mi) AS fi, coalesce(c, mc) AS fc, coalesce(t, mt) AS ft,
  coalesce(dist, md) AS fd FROM merged, med),
scored AS (SELECT huc12, dist, i, c, t, (0.4 * {_norm("fi")} + 0.4 * {_norm("fc")} + 0.2 * {_norm("ft")})
  * (0.5 + 0.5 * (1 - {_norm("fd")})) AS si FROM filled),
summary AS (SELECT huc12, avg(i) AS i, avg(c) AS c, avg(t) AS t, avg(dist) AS d, avg(si) AS s FROM scored
  WHERE huc12 IS NOT NULL GROUP BY huc12)
SELECT huc12 AS "HUC12_ID", round(i, 6) AS "Iron_mean", round(c, 6) AS "Cond_mean", round(t, 6) AS "Temp_mean",
  round(s, 6) AS "Sickness_Index", round(d, 6) AS "AML_dist_m",
  CAST(dense_rank() OVER (ORDER BY s DESC) AS INTEGER) AS "Rank" FROM summary""")
def health_v2(spark, folder):
    """Watershed scores from merged inlet/outlet analytes and proximity, ranked."""
    joined = _joined(spark, folder, "AML")
    merged = []
    for base in ["Iron", "Cond", "Temp"]:
        joined = C.merge_in_out(joined, base, f"{base}_mean", zero_is_null=True)
        merged.append(f"{base}_mean")
    return rounded(L.watershed_health_v2(joined, merged, "AML_dist_m", "HUC12_ID"))


@query("huc_polygons_join", f"""
WITH {Q.WATERSHEDS}, {Q.SITES}, n AS (SELECT huc12, COUNT(*) AS n_sites FROM sites JOIN watersheds ON {INSIDE}
  WHERE site_type = 'Stream' GROUP BY huc12)
SELECT w.huc12, w.name, n_sites FROM watersheds w LEFT JOIN n ON w.huc12 = n.huc12""")
def huc_polygons_join(spark, folder):
    """Polygons with their summary; polygons without data stay."""
    streams = D.sites(spark, folder).where("site_type = 'Stream'")
    shapes = D.watersheds(spark, folder)
    inside = join_within(streams, shapes, {"huc12": "huc12"}).where("huc12 IS NOT NULL")
    counts = inside.groupBy("huc12").agg(F.count(F.lit(1)).alias("n_sites"))
    return H.join_polygons(shapes, counts, "huc12").select("huc12", "name", "n_sites")


@query("treatment_priority", f"""
SELECT "HUC12_ID", w.name AS "HUC12_NAME", "Sickness_Index" FROM ({HEALTH_V1}) h
JOIN (SELECT lpad(CAST(n_nationkey AS VARCHAR), 12, '0') AS id, n_name AS name FROM nation) w ON h."HUC12_ID" = w.id
WHERE "Sickness_Index" IS NOT NULL ORDER BY "Rank", "HUC12_ID" LIMIT 10""")
def treatment_priority(spark, folder):
    """Ten worst watersheds with their names."""
    joined = _joined(spark, folder)
    summary = L.watershed_health_v1(joined, S.HEALTH_CHEMISTRY, "Bituminous_dist_m", "HUC12_ID")
    shapes = D.watersheds(spark, folder).select(F.col("huc12").alias("HUC12_ID"), F.col("name").alias("HUC12_NAME"))
    merged = H.join_polygons(shapes, summary, "HUC12_ID")
    top = H.top_by(merged, "Sickness_Index", "HUC12_ID")
    return rounded(top.select("HUC12_ID", "HUC12_NAME", "Sickness_Index"))
