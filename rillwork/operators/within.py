"""Point-in-polygon join.

Each polygon picks the grid whose cell is as large as its box and so lies in at most four cells;
points look up one cell per grid size in use. The height of a polygon is halved again and again
into dyadic strips. An edge belongs to the few largest strips that it spans, so n edges give
O(n log n) rows; a point looks up the one strip per level that holds it, and crossings are added up
by partial sums. No list of edges is built, and big rings are never shipped whole.

Polygons of few edges, and those whose edges all lie on their box, carry what the test needs into the cells, so that
pairs of points and polygons are judged where they meet and neither shuffled nor stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.geometry import bounds, explode_edges
from rillwork.functions.values import INFINITY, all_of, finite, ref
from rillwork.operators.locations import attach_locations, distinct_locations
from rillwork.session import broadcast_if_small, stored

FEW_EDGES = 32     # a polygon of so many edges is carried whole into its cells
STRIP_EDGES = 16   # edges per lowest strip aimed at
MAX_LEVELS = 24    # halvings of a polygon's height at most


def _cells(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _prepared(polygons: DataFrame) -> DataFrame:
    """Box, grid exponent and number of halvings per polygon; shapes without an area are left out."""
    edges = F.aggregate("parts", F.lit(0), lambda n, ring: n + F.size(ring))
    return (
        polygons.select("feature_id", "parts", bounds(F.col("parts")).alias("b"), edges.alias("n"))
        .select("feature_id", "parts", "n", "b.*")
        .withColumn("_span", F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1")))
        .where((F.col("bx2") > F.col("bx1")) & (F.col("by2") > F.col("by1")))
        .withColumn("grid", F.ceil(F.log2("_span")).cast("int"))
        .withColumn("levels", F.least(F.ceil(F.log2(F.greatest(F.col("n") / STRIP_EDGES, F.lit(1.0)))), F.lit(MAX_LEVELS)).cast("int"))
        .drop("_span", "n")
    )


def _strip(y: Column) -> Column:
    """Lowest strip of a height; rises with y, so an edge covers all strips between its ends."""
    strips = F.call_function("shiftleft", F.lit(1), F.col("levels"))
    place = F.floor((y - F.col("by1")) / (F.col("by2") - F.col("by1")) * strips)
    return F.greatest(F.lit(0), F.least(place, strips - 1)).cast("int")


def _nodes(first: Column, last: Column) -> Column:
    """The largest dyadic strips (level, node) that make up the strips first..last; at most two a level."""

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1), level)
        low = F.call_function("shiftright", first + size - 1, level)
        high = F.call_function("shiftright", last + 1, level) - 1
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        left = F.when((low <= high) & (low % 2 == 1), node(low))
        right = F.when((low <= high) & (high % 2 == 0), node(high))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.col("levels")), at))


def strip_edges(prepared: DataFrame) -> DataFrame:
    """Edges of each polygon, one row per dyadic strip (feature_id, level, node)."""
    edges = explode_edges(prepared.select("feature_id", "parts", "by1", "by2", "levels"))
    nodes = _nodes(_strip(F.least("y1", "y2")), _strip(F.greatest("y1", "y2")))
    return edges.withColumn("_n", F.explode(nodes)).select("feature_id", "_n.*", "x1", "y1", "x2", "y2")


def _crosses(e: dict[str, Column], x: Column, y: Column) -> Column:
    """Does a ray from the point to the right cross the edge?"""
    straddles = (e["y1"] > y) != (e["y2"] > y)
    at = e["x1"] + (y - e["y1"]) * F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])
    return F.coalesce(straddles & (x < at), F.lit(False))


def _touches(e: dict[str, Column], x: Column, y: Column) -> Column:
    """Does the point lie on the edge?"""
    cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    in_box = (
        (x >= F.least(e["x1"], e["x2"])) & (x <= F.greatest(e["x1"], e["x2"]))
        & (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"]))
    )
    return (cross == 0) & in_box


def _edges(parts: Column) -> Column:
    """The edges of all rings in one list, as ``explode_edges`` gives them."""

    def ring(p: Column) -> Column:
        last = F.size(p) - 1
        return F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.struct(
            F.get(p, i)[0].alias("x1"), F.get(p, i)[1].alias("y1"),
            F.get(p, F.least(i + 1, last))[0].alias("x2"), F.get(p, F.least(i + 1, last))[1].alias("y2")))

    return F.flatten(F.transform(F.filter(parts, lambda p: F.size(p) > 0), ring))


def _judged(edges: Column, x: Column, y: Column) -> Column:
    """Does a point lie inside by these edges?"""
    none = F.struct(F.lit(0).alias("n"), F.lit(False).alias("on"))
    return F.aggregate(
        edges, none,
        lambda held, e: F.struct(
            (held["n"] + F.when(_crosses(e, x, y), 1).otherwise(0)).alias("n"),
            (held["on"] | F.coalesce(_touches(e, x, y), F.lit(False))).alias("on")),
        lambda held: (held["n"] % 2 == 1) & ~held["on"])


def _sorted_out(polygons: DataFrame) -> DataFrame:
    """Prepared polygons with ``carried``: may they be judged by themselves? ``whole`` tells, of a polygon whose edges all lie
    on its box, whether the inside of the box is inside, and ``edges`` are those of the others.

    Rows that share a feature_id are judged together, by strips. A missing feature_id holds nothing.
    """
    named = polygons.where("feature_id IS NOT NULL")
    ids = named.groupBy("feature_id").agg((F.count(F.lit(1)) == 1).alias("_alone"))
    known = _prepared(named).join(ids, "feature_id").withColumn("edges", _edges(F.col("parts")))
    box = [F.col(c) for c in ("bx1", "by1", "bx2", "by2")]
    flat = lambda a, b, low, high: (a == b) & ((a == low) | (a == high))
    sides = F.forall("edges", lambda e: flat(e["x1"], e["x2"], box[0], box[2]) | flat(e["y1"], e["y2"], box[1], box[3]))
    closed = F.forall("parts", lambda p: (F.size(p) > 0) & (F.get(p, F.lit(0)) == F.element_at(p, -1)))
    bounded = all_of([F.abs(c) < INFINITY for c in box])
    middle = [(box[0] + box[2]) / 2, (box[1] + box[3]) / 2]
    whole = F.when(F.coalesce(sides & closed & bounded, F.lit(False)), _judged(F.col("edges"), *middle))
    known = known.withColumn("whole", whole)
    known = known.withColumn("carried", F.col("_alone") & (F.col("whole").isNotNull() | (F.size("edges") <= FEW_EDGES)))
    tested = F.when(F.col("carried") & F.col("whole").isNull(), F.col("edges"))
    slim = {"edges": tested, "parts": F.when(~F.col("carried"), F.col("parts"))}
    return stored(known.withColumns(slim).drop("_alone"), "polygons")


def _grids(known: DataFrame) -> tuple[list[int], list[int]]:
    """Grids of the polygons that are carried, and of the others. Exponents of two: one number per doubling of size."""
    found = [tuple(r) for r in known.select("carried", "grid").distinct().collect()]
    return tuple(sorted(grid for carried, grid in found if carried == which) for which in (True, False))


def _placed(boxes: DataFrame) -> DataFrame:
    """A row for each cell (grid, cx, cy) that a box lies in."""
    size = F.pow(F.lit(2.0), F.col("grid"))
    return boxes.withColumn("cx", F.explode(_cells(F.col("bx1"), F.col("bx2"), size))).withColumn(
        "cy", F.explode(_cells(F.col("by1"), F.col("by2"), size)))


def _carried(known: DataFrame) -> DataFrame:
    """Cells of the polygons that are carried, with what ``_holds`` needs."""
    return _placed(known.where(F.col("carried") & F.coalesce("whole", F.lit(True))).drop("parts", "levels", "carried"))


def _in_box(x: Column, y: Column) -> Column:
    return (x > F.col("bx1")) & (x < F.col("bx2")) & (y > F.col("by1")) & (y < F.col("by2"))


def _holds(x: Column, y: Column) -> Column:
    return _in_box(x, y) & F.coalesce("whole", _judged(F.col("edges"), x, y))


def containing_polygons(locations: DataFrame, polygons: DataFrame) -> DataFrame:
    """Rows (x, y, feature_id) for locations strictly inside a polygon (feature_id, parts).

    Holes count by parity over all rings; a point on a boundary is not inside.
    """
    known = _sorted_out(polygons.select("feature_id", "parts"))
    carried, others = _grids(known)
    if not carried and not others:
        return locations.limit(0).select(
            "x", "y", F.lit(None).cast(polygons.schema["feature_id"].dataType).alias("feature_id")
        )
    found = []
    x, y = F.col("x"), F.col("y")
    size = F.pow(F.lit(2.0), F.col("grid"))

    def probes(grids: list[int]) -> DataFrame:
        return locations.withColumn("grid", F.explode(F.array(*[F.lit(g) for g in grids]))).withColumns({
            "cx": F.floor(x / size), "cy": F.floor(y / size)
        })

    if carried:
        met = probes(carried).join(_carried(known), ["grid", "cx", "cy"])
        found.append(met.where(_holds(x, y)).select("x", "y", "feature_id"))
    if others:
        found.append(_inside_by_strips(probes(others), known.where(~F.col("carried")).drop("edges", "whole", "carried")))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _inside_by_strips(probes: DataFrame, prepared: DataFrame) -> DataFrame:
    """(x, y, feature_id) of locations inside polygons of any size, crossings added up over the strips that hold a location."""
    x, y = F.col("x"), F.col("y")
    candidates = (
        probes.join(_placed(prepared.drop("parts")), ["grid", "cx", "cy"])
        .where(_in_box(x, y))
        .withColumn("strip", _strip(y))
        .select("x", "y", "feature_id", "strip", F.explode(F.sequence(F.lit(0), F.col("levels"))).alias("level"))
        .select("x", "y", "feature_id", "level", F.call_function("shiftright", F.col("strip"), F.col("level")).alias("node"))
    )
    edge = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    return (
        candidates.join(strip_edges(prepared), ["feature_id", "level", "node"])
        .groupBy("x", "y", "feature_id")
        .agg(F.count_if(_crosses(edge, x, y)).alias("_n"), F.count_if(_touches(edge, x, y)).alias("_on"))
        .where((F.col("_n") % 2 == 1) & (F.col("_on") == 0))
        .select("x", "y", "feature_id")
    )


def within_join(
    left: DataFrame,
    polygons: DataFrame,
    names: dict[str, str],
    x: str = "x_m",
    y: str = "y_m",
) -> DataFrame:
    """Left join of points with the polygons that hold them.

    ``names`` maps polygon columns to output names. Overlapping polygons multiply a row; points
    in no polygon stay with NULLs.
    """
    known = _sorted_out(polygons.select("feature_id", "parts"))
    carried, others = _grids(known)
    attributes = polygons.select(
        F.col("feature_id").alias("_id"), *[ref(c).alias(out) for c, out in names.items()]
    )
    if len(carried) == 1 and not others:
        # One cell for each row of the left table: pairs are judged where they meet and go straight to the result.
        side = _carried(known).join(attributes, F.col("feature_id") == F.col("_id"))
        inner = ["cx", "cy", "bx1", "by1", "bx2", "by2", "whole", "edges"]
        side = broadcast_if_small(side.select(*inner, *[ref(out).alias(f"_out{n}") for n, out in enumerate(names.values())]))
        size = 2.0 ** carried[0]
        at = (F.floor(F.col("_px") / size) == F.col("cx")) & (F.floor(F.col("_py") / size) == F.col("cy"))
        clash = set(left.columns) & set(inner)
        kept = left.withColumnsRenamed({c: f"_left_{c}" for c in clash})
        kept = kept.withColumns({p: finite(ref(f"_left_{c}" if c in clash else c).cast("double")) for p, c in (("_px", x), ("_py", y))})
        met = kept.join(side, at & _holds(F.col("_px"), F.col("_py")), "left")
        return met.select(
            *[ref(f"_left_{c}" if c in clash else c).alias(c) for c in left.columns],
            *[F.col(f"_out{n}").alias(out) for n, out in enumerate(names.values())])
    inside = containing_polygons(distinct_locations(left, x, y), polygons)
    found = inside.join(attributes, F.col("feature_id") == F.col("_id"))
    return attach_locations(left, found.select("x", "y", *[ref(out) for out in names.values()]), x, y)
