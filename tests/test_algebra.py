"""Overlay, dissolve, relation and buffer by identities that hold for any input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import encode as E
from terrafold.functions import geometry as G
from terrafold.operators import arrangement as A
from terrafold.operators import build as B
from terrafold.operators import shapes as H
from terrafold.operators import spatial as S


def star(cx, cy, n, rng):
    """A star-shaped polygon, not convex, counter-clockwise."""
    a = [(i + rng.uniform(0.1, 0.9)) * 2 * math.pi / n for i in range(n)]
    r = [rng.uniform(2, 6) for _ in range(n)]
    p = [(cx + q * math.cos(t), cy + q * math.sin(t), None) for q, t in zip(r, a)]
    return p + p[:1]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(7)
    rows = [(f"p{i}", star(0, 0, rng.randint(5, 12), rng), star(rng.uniform(-4, 4), rng.uniform(-4, 4), rng.randint(5, 12), rng)) for i in range(25)]
    d = spark.createDataFrame(rows, f"pair_id string, a {G.RING}, b {G.RING}")
    return d.select("pair_id", G.polygon(F.col("a")).alias("geom_a"), G.polygon(F.col("b")).alias("geom_b")).cache()


def areas(df):
    return {r[0]: r[1] for r in df.collect()}


def test_area_identities(pairs):
    base = {r[0]: (r[1], r[2]) for r in pairs.select("pair_id", G.st_area("geom_a"), G.st_area("geom_b")).collect()}
    got = {op: areas(A.boundary_area(A.overlay_edges(pairs, op), "pair_id").select("pair_id", "area")) for op in ("intersection", "union", "difference", "symdifference")}
    for k, (a, b) in base.items():
        i = got["intersection"].get(k, 0.0)
        assert got["union"][k] + i == pytest.approx(a + b, rel=1e-9)
        assert got["difference"].get(k, 0.0) == pytest.approx(a - i, rel=1e-9, abs=1e-9)
        assert got["symdifference"].get(k, 0.0) == pytest.approx(a + b - 2 * i, rel=1e-9, abs=1e-9)


def test_polygons_have_the_area_of_their_edges(pairs):
    edges = areas(A.boundary_area(A.overlay_edges(pairs, "difference"), "pair_id").select("pair_id", "area"))
    polys = areas(A.st_overlay(pairs, "difference").select("pair_id", G.st_area("geom")))
    assert set(edges) == set(polys)
    for k in edges:
        assert polys[k] == pytest.approx(edges[k], rel=1e-9)


def test_intersection_by_sampling(pairs):
    """Brute force: the share of grid points inside both outlines."""
    rows = pairs.select("pair_id", F.flatten(F.flatten("geom_a.parts")).alias("a"), F.flatten(F.flatten("geom_b.parts")).alias("b")).collect()
    got = areas(A.boundary_area(A.overlay_edges(pairs, "intersection"), "pair_id").select("pair_id", "area"))
    g = (np.arange(600) + 0.5) / 600 * 24 - 12
    xs, ys = np.meshgrid(g, g)

    def inside(ring):
        odd = np.zeros_like(xs, bool)
        for u, v in zip(ring, ring[1:]):
            hit = (u["y"] > ys) != (v["y"] > ys)
            x = u["x"] + (ys - u["y"]) * (v["x"] - u["x"]) / ((v["y"] - u["y"]) or 1)
            odd ^= hit & (xs < x)
        return odd

    for r in rows[:8]:
        want = (inside(r["a"]) & inside(r["b"])).sum() * (24 / 600) ** 2
        assert got.get(r["pair_id"], 0.0) == pytest.approx(want, abs=0.6)


CASES = {
    "cross": ((0, 0, 10, 10), (5, 5, 15, 15), "212101212"), "equal": ((0, 0, 10, 10), (0, 0, 10, 10), "2FFF1FFF2"), "inside": ((0, 0, 10, 10), (2, 2, 4, 4), "212FF1FF2"),
    "edge": ((0, 0, 10, 10), (10, 0, 20, 10), "FF2F11212"), "corner": ((0, 0, 10, 10), (10, 10, 20, 20), "FF2F01212"), "apart": ((0, 0, 1, 1), (5, 5, 6, 6), "FF2FF1212"),
}


def test_relation_matrices(spark):
    rows = [(k, *map(float, a), *map(float, b)) for k, (a, b, _) in CASES.items()]
    d = spark.createDataFrame(rows, "pair_id string, " + ", ".join(f"{s}{i} double" for s in "ab" for i in range(4)))
    d = d.select("pair_id", G.rect("a0", "a1", "a2", "a3").alias("geom_a"), G.rect("b0", "b1", "b2", "b3").alias("geom_b"))
    assert {r["pair_id"]: r["matrix"] for r in A.st_relate(d).collect()} == {k: m for k, (_, _, m) in CASES.items()}


def test_line_relations(spark):
    box = G.rect(*[F.lit(v) for v in (0.0, 0.0, 10.0, 10.0)])
    ln = lambda *p: G.line(F.array(*[G.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in p]))
    rows = {"through": (ln((-5, 5), (15, 5)), box, "101FF0212"), "within": (ln((1, 1), (2, 2)), box, "1FF0FF212"), "rim": (ln((0, 0), (10, 0)), box, "F1FF0F212"),
            "cross": (ln((0, 0), (10, 10)), ln((0, 10), (10, 0)), "0F1FF0102"), "touch": (ln((0, 0), (5, 5)), ln((5, 5), (9, 0)), "FF1F00102"), "same": (ln((0, 0), (5, 5)), ln((0, 0), (5, 5)), "1FFF0FFF2")}
    d = None
    for k, (a, b, _) in rows.items():
        one = spark.range(1).select(F.lit(k).alias("pair_id"), a.alias("geom_a"), b.alias("geom_b"))
        d = one if d is None else d.unionByName(one)
    r = A.st_relate(d)
    got = {x["pair_id"]: x["matrix"] for x in r.collect()}
    assert got == {k: m for k, (_, _, m) in rows.items()}
    crosses = {x[0] for x in r.where(A.st_predicate("crosses", "matrix", "da", "db")).select("pair_id").collect()}
    assert crosses == {"through", "cross"}


@pytest.fixture(scope="module")
def by_box(spark):
    """Lines and polygons beside a rectangle: inside, across, apart, around it, along its sides and through its corners."""
    rng = random.Random(11)
    text = lambda p: ", ".join(f"{x} {y}" for x, y in p)
    path = lambda: [(rng.uniform(-6, 16), rng.uniform(-6, 14)) for _ in range(rng.randint(2, 5))]
    lines = [path() for _ in range(40)] + [[(rng.choice([-2, 0, 3, 10, 12]), rng.choice([-2, 0, 4, 8, 9])) for _ in range(4)] for _ in range(40)]
    lines += [[(2, 2), (4, 4), (2, 4), (2, 2)], [(-1, 1), (1, -1)], [(-1, 1), (1, -1 + 1e-13)], [(1, 1), (1, 1)], [(-3, 8 + 1e-13), (14, 8)]]
    areas = [[(x, y) for x, y, _ in star(rng.uniform(-6, 16), rng.uniform(-6, 14), rng.randint(5, 9), rng)] for _ in range(40)]
    areas += [[(a, b), (a + 4, b), (a + 4, b + 2), (a + 2, b + 2), (a + 2, b + 4), (a, b + 4), (a, b)] for a in (-6, -4, 0, 3, 6, 10) for b in (-4, 0, 2, 4, 8)]
    areas += [[(-9, -9), (19, -9), (19, 19), (-9, 19), (-9, -9)], [(-9, -9), (19, -9), (-9, 19), (-9, -9)], [(-30, -9), (19, -9), (-30, 40), (-30, -9)]]
    rows = [(f"l{i}", f"LINESTRING ({text(p)})") for i, p in enumerate(lines)] + [(f"p{i}", f"POLYGON (({text(p)}))") for i, p in enumerate(areas)]
    return shape_rows(spark, rows, ["g"]).select("id", "g", G.rect(*[F.lit(v) for v in (0.0, 0.0, 10.0, 8.0)]).alias("box")).cache()


@pytest.mark.parametrize("a, b", [("g", "box"), ("box", "g")])
def test_relations_read_off_in_the_row_are_those_of_cut_edges(by_box, monkeypatch, a, b):
    """the edges of every pair were cut, also where a rectangle tells at once."""
    d = by_box.unionByName(by_box.where("id like 'l1%'"))
    label, cut = A.label_pairs, []
    monkeypatch.setattr(A, "label_pairs", lambda p, key: cut.append(p.count()) or label(p, key))
    some = {tuple(r) for r in A.st_relate(d, "id", a, b).select("id", "matrix").collect()}
    monkeypatch.setattr(A, "_clear_matrix", lambda *x: F.lit(None).cast("string"))
    every = {tuple(r) for r in A.st_relate(d, "id", a, b).select("id", "matrix").collect()}
    assert some == every and len({m for _, m in every}) > 8
    assert cut[1] == d.count() and cut[0] < cut[1] - 40


@pytest.mark.parametrize("turned", [False, True])
def test_joins_read_off_in_the_row_are_those_of_cut_edges(by_box, monkeypatch, turned):
    """the shapes of every candidate were carried on and cut."""
    s, b = ("r", "l") if turned else ("l", "r")
    shapes = by_box.select(F.col("id").alias(s + "id"), F.col("g").alias(s + "geom"))
    box = by_box.limit(1).select(F.lit("box").alias(b + "id"), F.col("box").alias(b + "geom"))
    left, right = (box, shapes) if turned else (shapes, box)
    relate, cut = A.st_relate, []
    monkeypatch.setattr(A, "st_relate", lambda p: cut.append(p.count()) or relate(p))
    run = lambda: {n: sorted(map(tuple, A.geometry_join(left, right, n, 7.0).collect())) for n in ("intersects", "contains" if turned else "within")}
    some = run()
    monkeypatch.setattr(A, "_verdict", lambda *x: F.lit(None).cast("boolean"))
    every = run()
    assert some == every and all(every.values())
    assert all(x < y for x, y in zip(cut, cut[2:]))


def shape_rows(spark, rows, names):
    """Rows of WKT as geometry columns."""
    d = spark.createDataFrame(rows, ", ".join(["id string", *(f"{n}_t string" for n in names)]))
    return d.select("id", *[E.geom_from_wkt(f"{n}_t").alias(n) for n in names])


POINT_CASES = {
    "in": ("POINT (2 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "0FFFFF212"), "rim": ("POINT (4 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "F0FFFF212"),
    "out": ("POINT (9 9)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "FF0FFF212"), "holds": ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POINT (2 2)", "0F2FF1FF2"),
    "some": ("MULTIPOINT ((2 2), (9 9))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "0F0FFF212"), "mid": ("POINT (1 0)", "LINESTRING (0 0, 4 0)", "0FFFFF102"),
    "end": ("POINT (0 0)", "LINESTRING (0 0, 4 0)", "F0FFFF102"), "both ends": ("MULTIPOINT ((0 0), (4 0))", "LINESTRING (0 0, 4 0)", "F0FFFF1F2"),
    "same": ("POINT (1 2)", "POINT (1 2)", "0FFFFFFF2"), "other": ("POINT (1 2)", "POINT (1 3)", "FF0FFF0F2"), "part": ("MULTIPOINT ((1 2), (5 5))", "POINT (1 2)", "0F0FFFFF2"),
}


def test_relations_of_points(spark):
    d = shape_rows(spark, [(k, a, b) for k, (a, b, _) in POINT_CASES.items()], ["geom_a", "geom_b"])
    got = A.st_relate(d, "id").cache()
    assert {r["id"]: r["matrix"] for r in got.collect()} == {k: m for k, (_, _, m) in POINT_CASES.items()}
    named = lambda n: {r[0] for r in got.where(A.st_predicate(n, "matrix", "da", "db")).select("id").collect()}
    assert named("touches") == {"rim", "end", "both ends"} and named("crosses") == {"some"}
    assert named("contains") == {"holds", "same", "part"} and named("disjoint") == {"out", "other"}


def test_geometry_join_of_any_kind(spark):
    left = shape_rows(spark, [("l", "POLYGON ((0 0, 20 0, 20 10, 10 10, 10 20, 0 20, 0 0))"), ("tri", "POLYGON ((0 0, 10 0, 0 10, 0 0))"), ("pt", "POINT (15 15)"),
                              ("road", "LINESTRING (-5 5, 30 5)"), ("far", "POLYGON ((90 90, 95 90, 95 95, 90 95, 90 90))"), ("none", "POLYGON EMPTY")], ["lgeom"]).withColumnRenamed("id", "lid")
    right = shape_rows(spark, [("notch", "POLYGON ((12 12, 18 12, 18 18, 12 18, 12 12))"), ("far too", "POLYGON ((90 90, 95 90, 95 95, 90 95, 90 90))"),
                               ("half", "POLYGON ((10 10, 0 10, 10 0, 10 10))")], ["rgeom"]).withColumnRenamed("id", "rid")
    got = {n: {tuple(r) for r in A.geometry_join(left, right, n, 7.0).collect()} for n in ("intersects", "touches", "within", "contains", "overlaps", "crosses", "disjoint")}
    assert got["intersects"] == {("l", "half"), ("tri", "half"), ("pt", "notch"), ("road", "half"), ("far", "far too")}
    assert got["touches"] == {("tri", "half")} and got["within"] == {("pt", "notch"), ("far", "far too")}
    assert got["contains"] == {("l", "half"), ("far", "far too")} and got["overlaps"] == set() and got["crosses"] == {("road", "half")}
    assert got["disjoint"] == set()
    assert {r[0] for r in A.geometry_join(left, right.where("rid = 'notch'"), "disjoint", 7.0).collect()} == {"l", "tri", "road", "far"}


def test_radius_of_zero_pairs_equal_places(spark):
    l = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0)], "lid int, lx double, ly double")
    r = spark.createDataFrame([(7, 1.0, 1.0), (8, 1.0, 2.0)], "rid int, rx double, ry double")
    for geographic in (False, True):
        assert [(x["lid"], x["rid"], x["distance"]) for x in S.radius_join(l, r, 0.0, geographic=geographic).collect()] == [(2, 7, 0.0)]


def test_pattern_must_have_nine_characters():
    with pytest.raises(ValueError):
        A.matches(F.lit("FFFFFFFFF"), "T*")


def test_dissolve_is_idempotent_and_cell_size_free(spark):
    rng = random.Random(3)
    rows = [(("A", "a", "B")[i % 3], star(rng.uniform(0, 20), rng.uniform(0, 20), 7, rng)) for i in range(60)]
    d = spark.createDataFrame(rows, f"key string, p {G.RING}").select("key", G.polygon(F.col("p")).alias("geom")).cache()
    m = lambda x, s: {r["key"]: (round(r["area"], 7), round(r["length"], 7)) for r in A.boundary_area(A.dissolve_edges(x, "key", s), "key").collect()}
    first = m(d, 5.0)
    assert set(first) == {"a", "b"}
    assert m(d, 23.0) == first
    whole = A.dissolve(d, "key", 5.0)
    again = m(whole, 11.0)
    for k in first:
        assert again[k] == pytest.approx(first[k], rel=1e-9)


def test_disc_area_bounds(spark):
    d = spark.range(1).select(F.lit("x").alias("id"), G.point(F.lit(3.0), F.lit(4.0)).alias("geom"))
    a = A.boundary_area(A.buffer_edges(d, "id", 2.0, quadrant_segments=16), "id").first()["area"]
    assert 0.99 * math.pi * 4 < a < math.pi * 4
    with pytest.raises(ValueError):
        A.buffer_pieces(d, "id", float("nan"))


def test_repair_leaves_region_of_larger_wing(spark):
    p = [(0.0, 0.0, None), (4.0, 4.0, None), (4.0, 0.0, None), (0.0, 2.0, None), (0.0, 0.0, None)]
    d = spark.createDataFrame([(1, p)], f"id int, p {G.RING}").select("id", G.polygon(F.col("p")).alias("geom"))
    r = A.repair(d, "id").select("action", G.st_area("repaired").alias("a")).first()
    assert r["a"] == pytest.approx(16 / 3)


def test_repair_keeps_thin_outlines(spark):
    """Of a bow tie and of strips a millionth high, level, upright and slanting, nothing is lost."""
    tie = "POLYGON ((0 0, 4 4, 4 0, 0 2, 0 0))"
    d = shape_rows(spark, [("level", "POLYGON ((0 0, 10 0, 10 0.000001, 0 0.000001, 0 0))"), ("upright", "POLYGON ((0 0, 0.000001 0, 0.000001 10, 0 10, 0 0))"),
                           ("slant", "POLYGON ((0 0, 10 10, 10 10.000001, 0 0.000001, 0 0))"), ("tie", tie)], ["geom"])
    got = {r["id"]: r["a"] for r in A.repair(d, "id").select("id", G.st_area("repaired").alias("a")).collect()}
    assert got == {"level": pytest.approx(1e-5), "upright": pytest.approx(1e-5), "slant": pytest.approx(1e-5), "tie": pytest.approx(16 / 3)}


def test_simplify_keeps_rings_closed_and_simple(spark):
    n = 200
    p = [(10 * math.cos(2 * math.pi * i / n), 10 * math.sin(2 * math.pi * i / n), 1.0) for i in range(n)]
    d = spark.createDataFrame([(1, p + p[:1])], f"id int, p {G.RING}").select("id", G.polygon(F.col("p")).alias("geom"))
    ring = B.simplify(d, 0.2).first()["geom"]["parts"][0][0]
    assert 4 <= len(ring) < 60 and ring[0] == ring[-1] and ring[0]["z"] == 1.0
    xy = np.array([[v["x"], v["y"]] for v in ring])
    turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    sides = list(zip(xy[:-1], xy[1:]))
    assert not any(turn(a, b, c) * turn(a, b, e) < 0 and turn(c, e, a) * turn(c, e, b) < 0 for a, b in sides for c, e in sides)


def test_simplify_keeps_holes_of_other_lengths(spark):
    ring = lambda n, r: [(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n), None) for i in [*range(n), 0]]
    d = spark.createDataFrame([(1, [ring(200, 10), ring(90, 4)]), (2, [ring(200, 10)])], f"id int, p array<{G.RING}>").select("id", G.make_geom(G.POLYGON, F.array("p")).alias("geom"))
    rows = {r["id"]: r["geom"]["parts"][0] for r in B.simplify(d, 0.2).collect()}
    assert [len(rows[1]), len(rows[2])] == [2, 1] and all(4 <= len(r) < 60 and r[0] == r[-1] for p in rows.values() for r in p)


def test_hull_in_two_steps_equals_hull_in_one(spark):
    rng = random.Random(1)
    pts = [(rng.gauss(0, 5), rng.gauss(0, 5)) for _ in range(500)]
    d = spark.createDataFrame([("k", x, y) for x, y in pts], "key string, x double, y double")
    got = H.hull_agg(d, "key", slice_rows=100).select(G.st_area("geom")).first()[0]
    h = H._hull(np.array(pts))
    x, y = h[:, 0], h[:, 1]
    assert got == pytest.approx(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def test_clip_keeps_covered_whole(spark):
    f = spark.createDataFrame([(0, 1.0, 1.0, 2.0, 2.0), (1, 4.0, 1.0, 6.0, 2.0), (2, 8.0, 8.0, 9.0, 9.0)], "id int, a double, b double, c double, d double").select("id", G.rect("a", "b", "c", "d").alias("geom"))
    tri = G.polygon(F.array(*[G.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (5, 0), (5, 5), (0, 5), (0, 0))]))
    b = spark.range(1).select(F.lit("b").alias("boundary_id"), tri.alias("boundary"))
    r = {x["id"]: (x["covered"], x["a"]) for x in A.clip(f, b, "id").select("id", "covered", G.st_area("geom").alias("a")).collect()}
    assert r == {0: (True, 1.0), 1: (False, pytest.approx(1.0))}


def test_nearest_on_segments(spark):
    g = G.line(F.array(G.vertex(F.lit(0.0), F.lit(0.0)), G.vertex(F.lit(10.0), F.lit(0.0))))
    r = spark.range(1).select(S.nearest_on_geometry(g, F.lit(3.0), F.lit(4.0)).alias("n")).first()["n"]
    assert (r["d"], r["x"], r["y"]) == (4.0, 3.0, 0.0)


def test_segments_meet_in_compiled_columns(spark):
    """where two segments meet was worked out by functions over arrays, which are not compiled."""
    at = [(0, 0, 4, 0), (2, -1, 2, 3), (4, 0, 4, 4), (1, 0, 6, 0), (0, 0, 4, 0), (0, 1, 3, 1), (9, 9, 10, 10), (0, 0, 4, 4), (0, 4, 4, 0), (0, 4, 4, 4.0000000000001)]
    d = spark.createDataFrame([(1, i, *map(float, e)) for i, e in enumerate(at)], "k long, lid long, x1 double, y1 double, x2 double, y2 double")
    hit = A.meeting_points(d, d.withColumnRenamed("lid", "oid"), ["k"], "lid", "oid", 3.0, once=True)
    assert "lambda" not in hit._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in hit.distinct().collect():
        got.setdefault((r["lid"], r["oid"]), set()).add((round(r["x"], 9), round(r["y"], 9)))
    want = {(0, 1): {(2, 0)}, (0, 2): {(4, 0)}, (0, 3): {(4, 0), (1, 0)}, (0, 4): {(0, 0), (4, 0)}, (0, 7): {(0, 0)}, (0, 8): {(4, 0)}, (1, 3): {(2, 0)}, (1, 4): {(2, 0)},
            (1, 5): {(2, 1)}, (1, 7): {(2, 2)}, (1, 8): {(2, 2)}, (2, 3): {(4, 0)}, (2, 4): {(4, 0)}, (2, 7): {(4, 4)}, (2, 8): {(4, 0)}, (2, 9): {(4, 4)}, (3, 4): {(1, 0), (4, 0)}, (3, 8): {(4, 0)},
            (4, 7): {(0, 0)}, (4, 8): {(4, 0)}, (5, 7): {(1, 1)}, (5, 8): {(3, 1)}, (7, 8): {(2, 2)}, (7, 9): {(4, 4)}, (8, 9): {(0, 4)}}
    assert got == want


def test_a_piece_is_held_once_by_rectangles_and_other_shapes(spark):
    """every polygon around the middle of a piece was joined to it with its outline."""
    tri = G.polygon(F.array(*[G.vertex(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (12.0, 0.0), (0.0, 12.0), (0.0, 0.0))]))
    boxes = [(1, 1, 3, 3), (2, 2, 4, 4), (2, 2, 4, 4), (-2, 1, 1, 2), (0, 0, 2, 2)]
    d = spark.createDataFrame([("a", *map(float, b)) for b in boxes] + [("b", 0.0, 0.0, 5.0, 5.0)], "key string, minx double, miny double, maxx double, maxy double")
    g = d.select("key", G.rect("minx", "miny", "maxx", "maxy").alias("geom")).unionByName(spark.range(1).select(F.lit("A").alias("key"), tri.alias("geom")))
    e = A.dissolve_edges(g, "key", 4.0)
    got = {r["key"]: (round(r["area"], 9), round(r["length"], 9)) for r in A.boundary_area(e, "key").collect()}
    assert got == {"a": (74.0, round(24 + 288 ** 0.5 + 4, 9)), "b": (25.0, 20.0)}
    assert "LeftSemi" in e._jdf.queryExecution().executedPlan().toString()
