"""Planar geometry and map projection as column expressions.

A geometry is ``array<array<array<double>>>``: parts (or rings), vertices, [x, y].
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = "array<array<array<double>>>"


def point_distance(x: Column, y: Column, px: Column, py: Column) -> Column:
    dx, dy = x - px, y - py
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment; a segment of length zero is a point."""
    dx, dy = x2 - x1, y2 - y1
    along = F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    return point_distance(x, y, x1 + t * dx, y1 + t * dy)


def box_near(x: Column, y: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Distance to the nearest place of a box, 0 inside it."""
    zero = F.lit(0.0)
    dx = F.greatest(bx1 - x, zero, x - bx2)
    dy = F.greatest(by1 - y, zero, y - by2)
    return F.sqrt(dx * dx + dy * dy)


def box_far(x: Column, y: Column, bx1: Column, by1: Column, bx2: Column, by2: Column) -> Column:
    """Distance to the farthest corner of a box."""
    dx = F.greatest(F.abs(x - bx1), F.abs(x - bx2))
    dy = F.greatest(F.abs(y - by1), F.abs(y - by2))
    return F.sqrt(dx * dx + dy * dy)


def bounds(parts: Column) -> Column:
    """Bounding box of a geometry as a struct (bx1, by1, bx2, by2)."""
    xs = F.transform(F.flatten(parts), lambda v: v[0])
    ys = F.transform(F.flatten(parts), lambda v: v[1])
    return F.struct(
        F.array_min(xs).alias("bx1"), F.array_min(ys).alias("by1"),
        F.array_max(xs).alias("bx2"), F.array_max(ys).alias("by2"),
    )


def centroid(parts: Column, polygon_of: Column | None = None) -> Column:
    """Area centroid (x, y) of polygon rings by the shoelace sum.

    The first ring of a polygon counts as its shell and the others as holes, whatever their winding.
    ``polygon_of`` gives the polygon number of every ring; without it all rings are one polygon.
    """

    def edges(ring: Column, term) -> Column:
        steps = F.sequence(F.lit(0), F.size(ring) - 2)
        return F.aggregate(steps, F.lit(0.0), lambda total, i: total + term(F.get(ring, i), F.get(ring, i + 1)))

    def cross(p: Column, q: Column) -> Column:
        return p[0] * q[1] - q[0] * p[1]

    def moments(ring: Column, i: Column) -> Column:
        area = edges(ring, cross)
        first = i == 0
        if polygon_of is not None:
            first = first | F.coalesce(F.get(polygon_of, i) != F.get(polygon_of, i - 1), F.lit(False))
        role = F.when(first, F.signum(area)).otherwise(-F.signum(area))
        return F.struct(
            (role * area).alias("a"),
            (role * edges(ring, lambda p, q: (p[0] + q[0]) * cross(p, q))).alias("x"),
            (role * edges(ring, lambda p, q: (p[1] + q[1]) * cross(p, q))).alias("y"),
        )

    rings = F.transform(parts, lambda ring, i: F.when(F.size(ring) >= 2, moments(ring, i)))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(
        F.filter(rings, lambda m: m.isNotNull()), start,
        lambda s, m: F.struct((s["a"] + m["a"]).alias("a"), (s["x"] + m["x"]).alias("x"), (s["y"] + m["y"]).alias("y")),
        lambda s: F.struct(
            F.try_divide(s["x"], 3 * s["a"]).alias("x"), F.try_divide(s["y"], 3 * s["a"]).alias("y")
        ),
    )


def part_type(parts: Column) -> Column:
    """point, line or polygon, told from vertex counts and closure."""
    closed = F.forall(parts, lambda p: (F.size(p) >= 4) & (F.get(p, F.lit(0)) == F.element_at(p, -1)))
    single = F.forall(parts, lambda p: F.size(p) == 1)
    return F.when(single, "point").when(closed, "polygon").otherwise("line")


def valid_geometry(parts: Column, kind: Column) -> Column:
    """Present, not empty, enough vertices for its kind, closed rings, finite coordinates."""
    least = F.when(kind == "point", 1).when(kind == "line", 2).otherwise(4)
    sizes = F.forall(parts, lambda p: F.size(p) >= least)
    closed = F.forall(parts, lambda p: F.get(p, F.lit(0)) == F.element_at(p, -1))
    finite = F.forall(
        F.flatten(parts),
        lambda v: (F.size(v) >= 2) & ~F.isnan(v[0]) & ~F.isnan(v[1])
        & (F.abs(v[0]) < float("inf")) & (F.abs(v[1]) < float("inf")),
    )
    good = parts.isNotNull() & (F.size(parts) >= 1) & sizes & finite & ((kind != "polygon") | closed)
    return F.coalesce(good, F.lit(False))


def valid_lonlat(lon: Column, lat: Column) -> Column:
    return F.coalesce((F.abs(lon) <= 180) & (F.abs(lat) <= 90), F.lit(False))


# GRS80 ellipsoid and the UTM grid constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0


def utm(lon: Column, lat: Column, zone: int = 17) -> tuple[Column, Column]:
    """Transverse Mercator easting and northing in metres (Krüger series, order 3)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SCALE * SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    sin_lat = F.sin(F.radians(lat))
    turn = F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(sin_lat) - e * F.atanh(e * sin_lat))
    xi = F.atan2(t, F.cos(turn))
    eta = F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(series, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + radius * east, radius * north


def project_utm(
    df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x_m", y: str = "y_m", zone: int = 17
) -> DataFrame:
    """Add projected metres beside lon/lat, which stay for output."""
    east, north = utm(F.col(lon), F.col(lat), zone)
    return df.withColumns({x: east, y: north})


def explode_edges(layer: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per segment (x1, y1, x2, y2); a point becomes a segment of length zero."""
    others = [c for c in layer.columns if c != parts]
    per_part = layer.select(*others, F.explode(parts).alias("_part"))
    last = F.size("_part") - 1
    segments = F.transform(
        F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))),
        lambda i: F.struct(
            F.get(F.col("_part"), i).alias("a"), F.get(F.col("_part"), F.least(i + 1, last)).alias("b")
        ),
    )
    return (
        per_part.where(F.size("_part") > 0)
        .select(*others, F.explode(segments).alias("_s"))
        .select(
            *others,
            F.col("_s.a")[0].alias("x1"), F.col("_s.a")[1].alias("y1"),
            F.col("_s.b")[0].alias("x2"), F.col("_s.b")[1].alias("y2"),
        )
    )


def project_edges(edges: DataFrame, zone: int = 17) -> DataFrame:
    """Project the segments of a lon/lat layer to metres."""
    x1, y1 = utm(F.col("x1"), F.col("y1"), zone)
    x2, y2 = utm(F.col("x2"), F.col("y2"), zone)
    return edges.withColumns({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
