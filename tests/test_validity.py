"""Rings that cross or touch themselves, against all pairs of edges in plain Python."""

import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.functions.geometry import PARTS
from rillwork.operators import validity as X


def layer(spark, shapes):
    schema = T.StructType([T.StructField("feature_id", T.StringType()), T.StructField("id", T.IntegerType()), T.StructField("parts", T._parse_datatype_string(PARTS))])
    return spark.createDataFrame([(k, n, [[[float(x), float(y)] for x, y in ring] for ring in rings] if rings is not None else None)
                                  for n, (k, rings) in enumerate(shapes)], schema)


def turn(p, q, r):
    c = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (c > 0) - (c < 0)


def crossing(rings):
    edges = []
    for n, ring in enumerate(rings or []):
        points = [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]
        edges += [(n, i, len(points) - 2, points[i], points[i + 1]) for i in range(len(points) - 1)]
    for k, (r, i, last, a1, a2) in enumerate(edges):
        for s, j, _, b1, b2 in edges[k + 1:]:
            t = turn(a1, a2, b1), turn(a1, a2, b2), turn(b1, b2, a1), turn(b1, b2, a2)
            overlap = [min(max(a1[c], a2[c]), max(b1[c], b2[c])) - max(min(a1[c], a2[c]), min(b1[c], b2[c])) for c in (0, 1)]
            meet = t[0] * t[1] <= 0 and t[2] * t[3] <= 0 and min(overlap) >= 0
            if t[0] * t[1] < 0 and t[2] * t[3] < 0 or not any(t) and meet and max(overlap) > 0 or r == s and abs(i - j) not in (1, last) and meet:
                return True
    return False


def test_rings_against_all_pairs(spark):
    draw = random.Random(3)
    shapes = [("none", None), ("empty", []), ("point", [[(1, 1)]]), ("flat", [[(0, 0), (4, 0), (0, 0)]]),
              ("again", [[(0, 0), (0, 0), (5, 0), (5, 5), (5, 5), (0, 0), (0, 0)]]),
              ("two", [[(0, 0), (5, 0), (5, 5), (0, 0)], [(5, 5), (9, 5), (9, 9), (5, 5)]]),
              ("beside", [[(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)], [(5, 1), (9, 1), (9, 4), (5, 4), (5, 1)]])]
    for n in range(150):
        rings = []
        for _ in range(draw.choice([1, 1, 2])):
            size, middle = draw.randint(3, 9), (draw.randint(0, 6), draw.randint(0, 6))
            points = [(draw.randint(0, 9), draw.randint(0, 9)) for _ in range(size)]
            if n % 2:  # in order of the angle most rings are simple
                points.sort(key=lambda p: (math.atan2(p[1] - middle[1], p[0] - middle[0]), math.dist(p, middle)))
            rings.append([*points, points[0]])
        shapes.append((f"r{n // 2}", rings))  # two shapes share an id
    got = {r["id"]: r["crossing"] for r in X.with_crossing(layer(spark, shapes)).collect()}
    expected = {n: crossing(rings) for n, (_, rings) in enumerate(shapes)}
    assert got == expected and {*expected.values()} == {True, False}
    assert sum(expected.values()) < len(shapes) - 30


def test_pairs_of_a_spiky_ring_grow_with_its_edges(spark):
    """Long parallel sides in any direction, and edges that crowd in a corner, meet few others."""
    for turned in (0.0, 0.25, 0.5):
        def ring(n):
            points = [(i, 0.0 if i % 2 else 1000.0) for i in range(n)] + [(n, -5.0), (0, -5.0)]
            points += [(-1e6, -5.0), (-1e6, 0.5), (-0.5, 0.5)]
            c, s = math.cos(turned * math.pi), math.sin(turned * math.pi)
            return [(x * c - y * s, x * s + y * c) for x, y in [*points, points[0]]]

        counts = [X.edge_pairs(X.ring_edges(layer(spark, [("a", [ring(n)])]))).count() for n in (1000, 4000)]
        assert counts[1] < 5 * counts[0] < 5 * 6 * 1000


def test_no_rows(spark):
    empty = layer(spark, []).withColumn("crossing_", F.lit(1))
    assert X.with_crossing(empty).count() == 0
