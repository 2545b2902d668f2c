"""Spatial joins against brute force and hand-made shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillwork import session
from rillwork.functions import geometry as G
from rillwork.operators import nearest as N
from rillwork.operators import within as Wi
from rillwork.operators.within import within_join


def _sites(spark, points):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)],
                                 "site int, x_m double, y_m double")


def _features(spark, points):
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double")
    return N.point_segments(df, "id", "x", "y", "f")


def _brute(sites, features, bound=None):
    out = set()
    for i, (x, y) in enumerate(sites):
        found = [(math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, (a, b) in enumerate(features)]
        if bound is not None:
            found = [f for f in found if f[0] <= bound]
        best = min((f[0] for f in found), default=None)
        out |= {(i, j) for d, j in found if d == best} if found else {(i, None)}
    return out


def _clustered(rng, n, scale):
    """A third of the points in one tiny spot, some of them equal, the rest spread out."""
    spot = [(5000 + rng.randint(0, 6) / 8, 5000 + rng.randint(0, 6) / 8) for _ in range(n // 3)]
    return spot + [(float(rng.randint(0, scale)), float(rng.randint(0, scale))) for _ in range(n - n // 3)]


@pytest.mark.parametrize("bound", [None, 400.0])
@pytest.mark.parametrize("broadcast", [True, False])
def test_nearest_equals_brute_force(spark, bound, broadcast, monkeypatch):
    if not broadcast:
        # As if every side were too large to be broadcast.
        monkeypatch.setattr(N, "BROADCAST_CELLS", -1)
        monkeypatch.setattr(session, "BROADCAST_ROWS", -1)
    rng = random.Random(1 + broadcast)
    sites, features = _clustered(rng, 150, 10_000), _clustered(rng, 400, 10_000)
    joined = N.nearest_join(_sites(spark, sites), _features(spark, features), bound, ties="all")
    got = {(r.site, r.feature_id) for r in joined.collect()}
    want = _brute(sites, features, bound)
    assert got == want
    first = N.nearest_join(_sites(spark, sites), _features(spark, features), bound, ties="first")
    lowest = {}
    for i, j in want:
        lowest[i] = j if lowest.get(i) is None or (j is not None and j < lowest[i]) else lowest[i]
    assert {r.site: r.feature_id for r in first.collect()} == lowest


def test_crowded_features_are_divided(spark):
    """The grid goes on dividing a spot that holds most features, and stays exact."""
    rng = random.Random(5)
    spot = [(rng.random() * 1e-3, rng.random() * 1e-3) for _ in range(600)]
    features = [*spot, (1e6, 1e6), (0.0, 1e6)]
    grid = N.build_grid(_features(spark, features))
    # The empty levels between the whole area and the spot are skipped.
    assert 2 <= len(grid.steps) <= 6 and grid.steps[-1].level > 30
    assert grid.leaves.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= N.LEAF
    sites = [(rng.random() * 1e-3, rng.random() * 1e-3) for _ in range(40)] + [(9e5, 9e5)]
    joined = N.nearest_join(_sites(spark, sites), _features(spark, features), None, ties="all")
    assert {(r.site, r.feature_id) for r in joined.collect()} == _brute(sites, features)


def test_ties_and_bound(spark):
    features = [(3, 0), (0, 3), (9, 9)]
    all_ties = N.nearest_join(_sites(spark, [(0, 0)]), _features(spark, features), 5.0, ties="all").collect()
    assert sorted((r.feature_id, r.dist_m) for r in all_ties) == [(0, 3.0), (1, 3.0)]
    first = N.nearest_join(_sites(spark, [(0, 0)]), _features(spark, features), 5.0, ties="first").collect()
    assert [(r.feature_id, r.dist_m) for r in first] == [(0, 3.0)]
    at = N.nearest_join(_sites(spark, [(0, 0)]), _features(spark, [(5, 0)]), 5.0).first()
    beyond = N.nearest_join(_sites(spark, [(0, 0)]), _features(spark, [(5.01, 0)]), 5.0).first()
    assert (at.dist_m, beyond.dist_m, beyond.site) == (5.0, None, 0)


def test_rows_are_kept_and_locations_shared(spark):
    sites = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 1.0), (3, 50.0, 50.0), (4, math.nan, 1.0)],
                                  "site int, x_m double, y_m double")
    joined = N.nearest_join(sites, _features(spark, [(1, 2), (math.inf, 1)]), 5.0)
    assert {r.site: r.dist_m for r in joined.collect()} == {0: 1.0, 1: 1.0, 2: None, 3: None, 4: None}


def test_empty_layer_gives_nulls(spark):
    empty = _features(spark, [(1, 1)]).where("false")
    with pytest.warns(UserWarning):
        joined = N.nearest_join(_sites(spark, [(0, 0)]), empty, 5.0)
    assert joined.first().dist_m is None


def test_line_distance(spark):
    line = spark.createDataFrame([(7, [[[0.0, 0.0], [4.0, 0.0]]])], f"id int, parts {G.PARTS}")
    segments = N.shape_segments(line, "id", "flow")
    joined = N.nearest_join(_sites(spark, [(1, 2), (6, 0)]), segments, None, ties="first")
    assert {r.site: r.dist_m for r in joined.collect()} == {0: 2.0, 1: 2.0}


def test_long_lines_equal_brute_force(spark):
    rng = random.Random(8)
    lines = [[[rng.uniform(0, 1e4), rng.uniform(0, 1e4)] for _ in range(4)] for _ in range(120)]
    df = spark.createDataFrame([(i, [p]) for i, p in enumerate(lines)], f"id int, parts {G.PARTS}")
    sites = [(rng.uniform(-100, 1.1e4), rng.uniform(-100, 1.1e4)) for _ in range(80)]

    def segment(x, y, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)

    want = {i: min(segment(x, y, p[k], p[k + 1]) for p in lines for k in range(3)) for i, (x, y) in enumerate(sites)}
    joined = N.nearest_join(_sites(spark, sites), N.shape_segments(df, "id", "l"), None, ties="first")
    assert {r.site: r.dist_m for r in joined.collect()} == {i: pytest.approx(d) for i, d in want.items()}


def test_attach_nearest_skips_missing_layers(spark):
    layers = {"A": _features(spark, [(3, 0)]), "B": None, "C": _features(spark, [(0, 1), (900, 900)])}
    names = spark.createDataFrame([(0, "near"), (1, "far")], "feature_id int, label string")
    with pytest.warns(UserWarning, match="B"):
        joined = N.attach_nearest(_sites(spark, [(0, 0), (900, 899)]), layers, {"C": names}, 250.0)
    got = {r.site: (r.A_id, r.A_dist_m, r.C_id, r.C_label) for r in joined.collect()}
    assert got == {0: (0, 3.0, 0, "near"), 1: (None, None, 1, "far")}
    both = N.nearest_overall(joined, ["A", "C"])
    assert {r.site: (r.nearest_type, r.nearest_dist_m) for r in both.collect()} == {0: ("C", 1.0), 1: ("C", 1.0)}


def test_nearest_overall_ignores_missing(spark):
    rows = spark.createDataFrame([(None, 7.0, 3.0), (None, None, None)],
                                 "a_dist_m double, b_dist_m double, c_dist_m double")
    got = [tuple(r)[3:] for r in N.nearest_overall(rows, ["a", "b", "c"]).collect()]
    assert got == [("c", 3.0), (None, None)]


def _square(a, b):
    return [[a, a], [b, a], [b, b], [a, b], [a, a]]


def test_within_holes_and_boundary(spark):
    shape = [[[float(x), float(y)] for x, y in ring] for ring in (_square(0, 4), _square(1, 2))]
    polygons = spark.createDataFrame([(1, "h", shape)], f"feature_id int, name string, parts {G.PARTS}")
    joined = within_join(_sites(spark, [(3, 3), (1.5, 1.5), (5, 1), (0, 2), (1, 1.5), (4, 4)]), polygons, {"name": "huc"})
    assert {r.site: r.huc for r in joined.collect()} == {0: "h", 1: None, 2: None, 3: None, 4: None, 5: None}


def test_within_equals_brute_force(spark):
    """Star shapes of many sizes with many edges, overlapping."""
    rng = random.Random(4)
    shapes = []
    for i in range(40):
        cx, cy, r = rng.uniform(0, 1000), rng.uniform(0, 1000), 10 ** rng.uniform(0, 3)
        n = rng.choice([3, 9, 60, 300])
        ring = [[cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n),
                 cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)] for k in range(n)]
        shapes.append((i, [[*ring, ring[0]]]))
    sites = [(rng.uniform(0, 1000), rng.uniform(0, 1000)) for _ in range(300)]

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    want = {(s, i) for s, (x, y) in enumerate(sites) for i, [ring] in shapes if inside(x, y, ring)}
    polygons = spark.createDataFrame(shapes, f"feature_id int, parts {G.PARTS}")
    joined = within_join(_sites(spark, sites), polygons, {"feature_id": "poly"})
    assert {(r.site, r.poly) for r in joined.where("poly IS NOT NULL").collect()} == want
    assert {r.site for r in joined.collect()} == set(range(300))


def test_polygon_distance_is_zero_inside(spark):
    polygons = spark.createDataFrame([(1, [[[float(x), float(y)] for x, y in _square(0, 4)]])],
                                     f"feature_id int, parts {G.PARTS}")
    edges = N.shape_segments(polygons, "feature_id", "p")
    joined = N.nearest_join(_sites(spark, [(2, 2), (7, 2), (90, 90)]), edges, 10.0, ties="all", polygons=polygons)
    assert {r.site: r.dist_m for r in joined.collect()} == {0: 0.0, 1: 3.0, 2: None}


def _comb(teeth):
    top = [p for i in range(teeth) for p in ((2.0 * i, 0.0), (2.0 * i, 100.0), (2.0 * i + 1, 100.0), (2.0 * i + 1, 0.0))]
    return [*top, (2.0 * teeth, -1.0), (-1.0, -1.0), (0.0, 0.0)]


def _shore(n):
    rng = random.Random(5)
    return [(0.0, 0.0), *[(1.0 + i, 1e-3 * rng.random() + 1) for i in range(n)], (n + 1.0, 1000.0), (0.0, 1000.0), (0.0, 0.0)]


@pytest.mark.parametrize("shape", [_comb, _shore])
def test_edges_of_hard_rings_are_copied_a_few_times(spark, shape):
    kind = f"feature_id int, parts {G.PARTS}"
    for n in (125, 500, 2000):
        ring = [list(p) for p in shape(n)]
        prepared = Wi._prepared(spark.createDataFrame([(1, [ring])], kind))
        assert Wi.strip_edges(prepared).count() <= 2 * len(ring) * (math.log2(len(ring)) + 1)
    ring = [list(p) for p in shape(125)]
    rng = random.Random(6)
    high = max(p[1] for p in ring)
    points = [(rng.uniform(-2, 260), rng.choice([rng.uniform(-2, high + 2), rng.uniform(0.99, 1.01)])) for _ in range(400)]
    inside = Wi.containing_polygons(spark.createDataFrame(points, "x double, y double"),
                                    spark.createDataFrame([(1, [ring])], kind))
    assert {(r.x, r.y) for r in inside.collect()} == {p for p in points if _in_ring(*p, ring)}


def _in_ring(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def test_long_segments_among_short_ones_do_not_multiply_the_work(spark):
    locations = spark.range(500).select((F.rand(1) * 1e5).alias("x"), (F.rand(2) * 1e5).alias("y"))
    tests = {}
    for n in (4_000, 64_000):
        x, y, turn = F.rand(3) * 1e5, F.rand(4) * 1e5, F.rand(5) * 6.28
        length = F.when(F.col("id") % 4 == 0, 42e3).otherwise(100.0)
        segments = spark.range(n).select("id", x.alias("x1"), y.alias("y1"), turn.alias("t"), length.alias("l")).select(
            F.lit("L").alias("layer"), F.col("id").alias("feature_id"), "x1", "y1",
            (F.col("x1") + F.col("l") * F.cos("t")).alias("x2"), (F.col("y1") + F.col("l") * F.sin("t")).alias("y2"))
        tests[n] = N.candidate_segments(locations, N.build_grid(segments), ["L"]).count() / 500
    assert tests[64_000] < 2 * tests[4_000]


def test_utm_values(spark):
    rows = spark.createDataFrame([(-81.0, 0.0), (-81.0, 40.0)], "lon double, lat double")
    got = [(r.x_m, r.y_m) for r in G.project_utm(rows).collect()]
    assert got[0] == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    assert got[1] == (pytest.approx(500000), pytest.approx(4427757.2186, abs=1e-3))


def test_geometry_checks(spark):
    rows = spark.createDataFrame(
        [(0, [[[0.0, 0.0]]], "point"), (1, [[[0.0, 0.0]]], "line"), (2, [[[0.0, 0.0], [1.0, 1.0]]], "line"),
         (3, [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]], "polygon"),
         (4, [[[float(a), float(b)] for a, b in _square(0, 2)]], "polygon"), (5, None, "point"),
         (6, [[[float("nan"), 1.0]]], "point"), (7, [], "point")],
        f"i int, parts {G.PARTS}, kind string")
    got = {r.i: r.ok for r in rows.select("i", G.valid_geometry(F.col("parts"), F.col("kind")).alias("ok")).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}
    c = rows.where("i = 4").select(G.centroid(F.col("parts")).alias("c")).first().c
    assert (c.x, c.y) == (1.0, 1.0)


def test_inside_a_polygon_the_distance_is_zero(spark):
    square = [[[0.0, 0.0], [100.0, 0.0], [100.0, 100.0], [0.0, 100.0], [0.0, 0.0]]]
    shapes = spark.createDataFrame(
        [(1, "Polygon", square), (2, "Polygon", square)], "feature_id long, geometry_type string, parts array<array<array<double>>>")
    sites = spark.createDataFrame([(1, 50.0, 50.0), (2, 130.0, 50.0), (3, 900.0, 0.0)], "k int, x_m double, y_m double")
    one = {r.k: r.dist_m for r in N.nearest_join(sites, shapes, 100.0, ties="first").collect()}
    assert one == {1: 0.0, 2: 30.0, 3: None}
    every = N.attach_nearest(sites, {"P": shapes}, max_m=100.0, ties="all").collect()
    assert sorted((r.k, r.P_id or 0, r.P_dist_m) for r in every if r.k < 3) == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 30.0), (2, 2, 30.0)]
    assert [(r.P_id, r.P_dist_m) for r in every if r.k == 3] == [(None, None)]


def test_pairs_of_points_and_small_polygons_are_neither_stored_nor_shuffled(spark, monkeypatch):
    """Squares, a triangle, a hole, a ring left open, repeated and missing ids: as by brute force; joined, no pair is stored."""
    rng = random.Random(9)
    square = lambda x, y, r: [[x - r, y - r], [x + r, y - r], [x + r, y + r], [x - r, y + r], [x - r, y - r]]
    shapes = [(i, [square(float(rng.randint(0, 20)), float(rng.randint(0, 20)), 6.0)]) for i in range(40)]
    shapes += [(50, [[[0.0, 0.0], [9.0, 0.0], [0.0, 9.0], [0.0, 0.0]]]), (51, [square(10.0, 10.0, 7.0), square(10.0, 10.0, 3.0)])]
    shapes += [(52, [square(9.0, 9.0, 5.0)[:4]]), (53, [square(5.0, 5.0, 4.0)] * 2), (None, [square(9.0, 9.0, 8.0)])]
    shapes += [(60, [square(8.0, 8.0, 4.0)])] * 2 + [(61, [square(8.0, 8.0, 4.0)])] * 3
    polygons = spark.createDataFrame(shapes, f"feature_id int, parts {G.PARTS}")
    points = spark.createDataFrame([(float(x), float(y)) for x in range(22) for y in range(22)], "x double, y double")
    found = Wi.containing_polygons(points, polygons)
    got = sorted(map(tuple, found.collect()))
    brute = []
    for x, y in [(r.x, r.y) for r in points.collect()]:
        for i, parts in [s for s in shapes if s[0] is not None and s[0] < 60]:
            edges = [(a, b) for ring in parts for a, b in zip(ring, ring[1:])]
            on = any((q[0] - p[0]) * (y - p[1]) == (q[1] - p[1]) * (x - p[0]) and min(p[0], q[0]) <= x <= max(p[0], q[0])
                     and min(p[1], q[1]) <= y <= max(p[1], q[1]) for p, q in edges)
            odd = sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * ((q[0] - p[0]) / (q[1] - p[1])) for p, q in edges) % 2
            xs, ys = zip(*[v for ring in parts for v in ring])
            if odd and not on and min(xs) < x < max(xs) and min(ys) < y < max(ys):
                brute.append((x, y, i))
    assert [r for r in got if r[2] < 60] == sorted(brute)
    # Rows of one id are judged together: two equal rows cancel, three do not.
    assert {r[2] for r in got if r[2] >= 60} == {61}
    alone = polygons.where("feature_id < 50")
    sites = points.withColumnsRenamed({"x": "x_m", "y": "y_m"})
    stored = []
    monkeypatch.setattr(session, "checkpoint", lambda df: stored.append(df.count()) or df)
    joined = within_join(sites, alone, {"feature_id": "pit"})
    inside = sum(1 for r in brute if r[2] < 50)
    assert joined.where("pit IS NOT NULL").count() == inside > 2 * max(stored, default=0)
    assert joined.where("pit IS NULL").count() == 484 - len({r[:2] for r in brute if r[2] < 50})


def test_pieces_of_segments_are_not_stored(spark, monkeypatch):
    """Long segments in about ten pieces each: what is stored are segments and cells."""
    kept = []
    for name in ("checkpoint", "stored"):
        store = getattr(N, name, None)
        monkeypatch.setattr(N, name, lambda df, *a, store=store: kept.append(df.count()) or store(df, *a), raising=False)
    rng = random.Random(8)
    lines = [(i, [[[x := rng.uniform(0, 1e5), y := rng.uniform(0, 1e5)], [x + 5e4, y + rng.uniform(-1, 1)]]]) for i in range(400)]
    grid = N.build_grid(N.shape_segments(spark.createDataFrame(lines, f"id int, parts {G.PARTS}"), "id", "l"))
    assert grid.leaves.count() > 2000 and max(kept) <= 400


def test_ids_multiply_rows_only_at_the_end(spark, monkeypatch):
    """Two layers of ten squares around one place: a hundred rows, one of them stored."""
    square = [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0], [0.0, 9.0], [0.0, 0.0]]]
    layer = spark.createDataFrame([(i, "Polygon", square) for i in range(10)], f"feature_id int, geometry_type string, parts {G.PARTS}")
    stored, store = [], session.checkpoint
    monkeypatch.setattr(session, "checkpoint", lambda df: stored.append(df.count()) or store(df))
    joined = N.attach_nearest(_sites(spark, [(4, 4)]), {"A": layer, "B": layer}, max_m=5.0, ties="all")
    assert {(r.A_id, r.B_id, r.A_dist_m, r.B_dist_m) for r in joined.collect()} == {(i, j, 0.0, 0.0) for i in range(10) for j in range(10)}
    assert joined.count() == 100 and max(stored) < 100
