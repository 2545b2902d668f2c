"""Rings that cross or touch themselves or each other.

The edges of a feature are laid on a line: of four directions the one in which they are shortest for its width. Two
edges can only meet if their intervals there overlap. Edges are numbered by where they begin, and the next
``STRIP_EDGES`` numbers make a strip, so strips are narrow where edges crowd. An edge looks up the strips that begin
within its interval, and meets the edges that begin there; each overlapping pair is met once, and no other.

A pair breaks the rules if the edges cross inside both, run along each other, or belong to one ring, are not
neighbours and touch. Different rings may touch in points. Vertices that repeat one after another count once.
Orientation is judged by the sign of a cross product of doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.functions.values import ref

STRIP_EDGES = 16
# Weights of x and y for the four directions.
_DIRECTIONS = ((1, 0), (0, 1), (1, 1), (1, -1))


def ring_edges(shapes: DataFrame, key: str = "feature_id", parts: str = "parts") -> DataFrame:
    """(id, shape, ring, at, last, x1, y1, x2, y2): edges numbered along their rings; ``shape`` tells rows of one id apart."""
    rings = F.transform(ref(parts), lambda ring: F.filter(
        ring, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(ring, F.greatest(i - 1, F.lit(0))))))
    each = shapes.where(ref(parts).isNotNull()).select(ref(key).alias("id"), F.xxhash64(ref(parts)).alias("shape"), F.posexplode(rings).alias("ring", "p"))
    each = each.where(F.size("p") > 1)
    points = each.select("id", "shape", "ring", (F.size("p") - 2).alias("last"), F.posexplode(F.arrays_zip(
        F.slice("p", F.lit(1), F.size("p") - 1).alias("a"), F.slice("p", F.lit(2), F.size("p") - 1).alias("b"))).alias("at", "e"))
    return points.select("id", "shape", "ring", "at", "last", *[
        F.get(F.col(f"e.{v}"), F.lit(i)).alias(f"{c}{n}") for n, v in ((1, "a"), (2, "b")) for i, c in enumerate("xy")])


def _laid(edges: DataFrame) -> DataFrame:
    """Adds the interval (low, high) of each edge in the direction that suits its feature best."""
    whole = W.partitionBy("id", "shape")
    ends = {d: (p * F.col("x1") + q * F.col("y1"), p * F.col("x2") + q * F.col("y2")) for d, (p, q) in enumerate(_DIRECTIONS)}
    low, high = ({d: pick(*ab) for d, ab in ends.items()} for pick in (F.least, F.greatest))
    cost = F.array(*[
        F.struct(F.coalesce(F.try_divide(F.sum(high[d] - low[d]).over(whole), F.max(high[d]).over(whole) - F.min(low[d]).over(whole)),
                            F.lit(float("inf"))).alias("c"), F.lit(d).alias("d")) for d in ends])
    best = edges.withColumn("best", F.array_min(cost)["d"])
    choose = lambda of: F.element_at(F.array(*of.values()), F.col("best") + 1)
    return best.withColumns({"low": choose(low), "high": choose(high)}).drop("best")


def edge_pairs(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) of edges of one feature whose intervals overlap, each once: (id, shape, a struct, b struct)."""
    # Beginnings and ends in order; an edge reaches as far as the last edge that begins before it ends.
    held = F.struct("ring", "at", "last", "x1", "y1", "x2", "y2").alias("e")
    marks = _laid(edges).select("id", "shape", held, F.explode(F.array(
        F.struct(F.col("low").alias("place"), F.lit(0).alias("end")), F.struct(F.col("high").alias("place"), F.lit(1).alias("end")))).alias("m"))
    order = W.partitionBy("id", "shape").orderBy("m", "e.ring", "e.at").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = marks.withColumn("begun", F.count_if(F.col("m.end") == 0).over(order))
    ranked = counted.groupBy("id", "shape", "e").agg(F.min("begun").alias("rank"), F.max("begun").alias("reach"))
    strip = lambda n: F.floor((F.col(n) - 1) / STRIP_EDGES).cast("long")
    own = ranked.select("id", "shape", strip("rank").alias("strip"), F.col("rank").alias("other"), F.col("e").alias("b"))
    seen = ranked.select("id", "shape", "rank", "reach", F.col("e").alias("a"), F.explode(F.sequence(strip("rank"), strip("reach"))).alias("strip"))
    met = seen.join(own, ["id", "shape", "strip"]).where((F.col("other") > F.col("rank")) & (F.col("other") <= F.col("reach")))
    return met.select("id", "shape", "a", "b")


def _turn(p: tuple[Column, Column], q: tuple[Column, Column], r: tuple[Column, Column]) -> Column:
    return F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))


def breaks_rules(a: Column, b: Column) -> Column:
    """Whether two edges of one feature meet in a way that a valid polygon rules out."""
    a1, a2, b1, b2 = ((e[f"x{n}"], e[f"y{n}"]) for e in (a, b) for n in (1, 2))
    turns = _turn(a1, a2, b1), _turn(a1, a2, b2), _turn(b1, b2, a1), _turn(b1, b2, a2)
    crosses = (turns[0] * turns[1] < 0) & (turns[2] * turns[3] < 0)

    def within(p, q, r) -> Column:
        return r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))

    touches = crosses
    for turn, (p, q, r) in zip(turns, ((a1, a2, b1), (a1, a2, b2), (b1, b2, a1), (b1, b2, a2))):
        touches = touches | ((turn == 0) & within(p, q, r))
    shared = [F.least(F.greatest(a1[i], a2[i]), F.greatest(b1[i], b2[i])) - F.greatest(F.least(a1[i], a2[i]), F.least(b1[i], b2[i])) for i in (0, 1)]
    along = (turns[0] == 0) & (turns[1] == 0) & (turns[2] == 0) & (turns[3] == 0)
    along = along & (shared[0] >= 0) & (shared[1] >= 0) & ((shared[0] > 0) | (shared[1] > 0))
    same = a["ring"] == b["ring"]
    apart = F.abs(a["at"] - b["at"])
    neighbours = same & ((apart == 1) | (apart == a["last"]))
    return crosses | along | (same & ~neighbours & touches)


def with_crossing(shapes: DataFrame, key: str = "feature_id", parts: str = "parts", name: str = "crossing") -> DataFrame:
    """The layer with a column that tells whether rings of a polygon cross, run along or touch themselves against the rules.

    Rows without a shape get false. For layers of polygons; lines may cross themselves.
    """
    found = edge_pairs(ring_edges(shapes, key, parts)).where(breaks_rules(F.col("a"), F.col("b")))
    wrong = found.select(F.col("id").alias("_id"), F.col("shape").alias("_shape")).distinct().withColumn(name, F.lit(True))
    same = ref(key).eqNullSafe(F.col("_id")) & (F.xxhash64(ref(parts)) == F.col("_shape"))
    joined = shapes.join(wrong, same, "left").drop("_id", "_shape")
    return joined.withColumn(name, F.coalesce(ref(name), F.lit(False)))
