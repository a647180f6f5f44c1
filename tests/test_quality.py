"""Quality rules on small cases with known findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import quality as Q


def squares(spark, rows):
    d = spark.createDataFrame([("PARCEL", f"f{i}", i, *map(float, r)) for i, r in enumerate(rows)], "dataset string, feature_id string, pos long, minx double, miny double, maxx double, maxy double")
    return d.withColumn("geom", G.rect("minx", "miny", "maxx", "maxy"))


@pytest.mark.parametrize("rows,n", [
    ([(0, 0, 10, 10), (5, 0, 15, 10)], 1),
    ([(0, 0, 10, 10), (10, 0, 20, 10)], 0),
    ([(0, 0, 10, 10), (0, 0, 10, 10)], 0),
    ([(0, 0, 10, 10), (2, 2, 4, 4)], 0),
])
def test_overlaps(spark, rows, n):
    assert Q.check_overlaps(squares(spark, rows), 7.0).count() == n


def test_overlap_below_minimum_area(spark):
    d = squares(spark, [(0, 0, 10, 10), (9.9999999, 0, 20, 10)])
    assert Q.check_overlaps(d, 7.0, min_area=1e-3).count() == 0


def outlines(spark, rows):
    """Polygons of rings given as vertex lists, all of one dataset."""
    d = spark.createDataFrame([("PARCEL", k, i, [[(float(x), float(y), None) for x, y in [*r, r[0]]] for r in rings]) for i, (k, rings) in enumerate(rows)],
                              f"dataset string, feature_id string, pos long, p array<{G.RING}>")
    return G.with_envelope(d.withColumn("geom", G.make_geom(G.POLYGON, F.array("p"))).drop("p"))


L_SHAPE = [(0, 0), (20, 0), (20, 10), (10, 10), (10, 20), (0, 20)]


@pytest.mark.parametrize("a,b,area", [
    ([L_SHAPE], [[(12, 12), (18, 12), (18, 18), (12, 18)]], None),  # a square free in the notch
    ([L_SHAPE], [[(8, 8), (18, 8), (18, 18), (8, 18)]], 36.0),
    ([[(0, 0), (10, 0), (0, 10)]], [[(0, 0), (10, 0), (10, 10)]], 25.0),  # two triangles of one envelope
    ([[(0, 0), (10, 0), (0, 10)]], [[(10, 10), (0, 10), (10, 0)]], None),  # two triangles that share a side only
    ([L_SHAPE], [[(2, 2), (4, 2), (3, 4)]], None),  # held inside: no overlap
    ([L_SHAPE], [L_SHAPE[2:] + L_SHAPE[:2]], None),  # equal, started elsewhere
    ([[(0, 0), (20, 0), (20, 20), (0, 20)], [(5, 5), (5, 15), (15, 15), (15, 5)]], [[(6, 6), (14, 6), (14, 14), (6, 14)]], None),  # free in a hole
    ([[(0, 0), (20, 0), (20, 20), (0, 20)], [(5, 5), (5, 15), (15, 15), (15, 5)]], [[(4, 6), (14, 6), (14, 14), (4, 14)]], 8.0),
])
def test_overlaps_of_outlines(spark, a, b, area):
    found = Q.overlap_areas(outlines(spark, [("a", a), ("b", b), ("b2", b)]), 7.0).orderBy("other_id").collect()
    assert [(r["feature_id"], r["other_id"]) for r in found] == ([("a", "b"), ("a", "b2")] if area else [])
    assert all(r["shared_area"] == pytest.approx(area) for r in found)


def test_overlaps_of_outlines_by_sampling(spark):
    """Random quarrels of stars: the area by grid points in both, and a point that lies in both."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(12):
        t = (np.arange(9) + rng.uniform(0.1, 0.9, 9)) * 2 * np.pi / 9
        r, (cx, cy) = rng.uniform(2, 6, 9), rng.uniform(0, 14, 2)
        rows.append((f"s{i:02d}", [list(zip((cx + r * np.cos(t)).tolist(), (cy + r * np.sin(t)).tolist()))]))
    g = (np.arange(700) + 0.5) / 700 * 30 - 8
    xs, ys = np.meshgrid(g, g)

    def inside(ring, x, y):
        n = np.zeros(np.shape(x), int)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            span = (ay <= y) != (by <= y)
            n += span & (x < ax + (y - ay) * (bx - ax) / np.where(span, by - ay, 1.0))
        return n % 2 == 1

    ring = {k: r[0] for k, r in rows}
    held = {k: inside(r, xs, ys) for k, r in ring.items()}
    got = {(r["feature_id"], r["other_id"]): r for r in Q.overlap_areas(outlines(spark, rows), 7.0).collect()}
    for i, a in enumerate(sorted(ring)):
        for b in sorted(ring)[i + 1:]:
            want = (held[a] & held[b]).sum() * (30 / 700) ** 2
            assert want < 0.3 if (a, b) not in got else got[a, b]["shared_area"] == pytest.approx(want, abs=0.3)
    assert len(got) > 5
    for (a, b), r in got.items():
        assert inside(ring[a], r["x"], r["y"]) and inside(ring[b], r["x"], r["y"])


def lines(spark, rows):
    d = spark.createDataFrame([("ROAD", f"l{i}", i, *map(float, r)) for i, r in enumerate(rows)], "dataset string, feature_id string, pos long, a double, b double, c double, d double")
    return d.withColumn("geom", G.line(F.array(G.vertex("a", "b"), G.vertex("c", "d"))))


def test_dangles_of_two_pipes_five_millimetres_apart(spark):
    d = lines(spark, [(0, 0, 10, 0), (10.005, 0, 20, 0)])
    assert Q.check_dangles(d, 0.001).count() == 4
    assert Q.check_dangles(d, 0.01).count() == 2


def test_closed_line_has_no_free_end(spark):
    d = spark.range(1).select(F.lit("ROAD").alias("dataset"), F.lit("a").alias("feature_id"), F.lit(0).alias("pos"), G.line(G.rect_ring(*[F.lit(v) for v in (0.0, 0.0, 1.0, 1.0)])).alias("geom"))
    assert Q.check_dangles(d).count() == 0


@pytest.mark.parametrize("w,h,n", [(100, 0.1, 1), (100, 1, 0), (1000, 0.1, 0), (10, 10, 0)])
def test_slivers(spark, w, h, n):
    # The thin strip sits at the origin so that its area is exactly ten.
    assert Q.check_slivers(squares(spark, [(0, 0, w, h)])).count() == n


def test_thinness_of_strip_and_footpath(spark):
    t = lambda w, h: spark.range(1).select(Q.thinness(F.lit(float(w * h)), F.lit(2.0 * (w + h)))).first()[0]
    assert t(100, 0.1) == pytest.approx(0.0031, abs=1e-4)
    assert t(100, 1) == pytest.approx(0.031, abs=1e-3)


def test_self_contact_long_ring_agrees_with_short_path(spark):
    """A long zigzag that crosses itself once is found by the cell join."""
    pts = [(float(i), float(i % 2)) for i in range(60)] + [(30.0, 5.0), (30.5, -5.0)]
    d = spark.createDataFrame([("a", [(x, y, None) for x, y in pts]), ("b", [(x, y, None) for x, y in pts[:60]])], f"k string, p {G.RING}")
    d = d.select("k", G.line(F.col("p")).alias("geom"))
    assert {r["k"]: r["contact"] for r in Q.self_contacts(d, ["k"]).collect()} == {"a": 2}


def test_isolated_rule_failure_is_one_finding(spark):
    d = squares(spark, [(0, 0, 10, 10), (5, 0, 15, 10)])
    ctx = Q.QaContext(d, spark.createDataFrame([("PARCEL", "EPSG:27700", False)], "dataset string, crs string, is_geographic boolean"))

    def boom(c):
        return Q.finding(c.features.where(F.raise_error(F.lit("x")).isNull()), "B", 1, "Topology", F.lit("m"))

    rules = [Q.Rule("Topology.Overlap", "Topology", lambda c: Q.check_overlaps(c.features, 7.0), True), Q.Rule("Broken", "Topology", boom), Q.Rule("topology.overlap", "Topology", boom)]
    codes = sorted(r["code"] for r in Q.run_qa(ctx, rules, isolate=True).collect())
    assert codes == ["QaQc.RuleFailed", "Topology.Overlap"]
    with pytest.raises(ValueError):
        Q.run_qa(ctx, [])


def test_ceiling_skips_whole_dataset_rules(spark):
    d = squares(spark, [(0, 0, 10, 10), (5, 0, 15, 10)])
    ctx = Q.QaContext(d, spark.createDataFrame([("PARCEL", "EPSG:27700", False)], "dataset string, crs string, is_geographic boolean"))
    rules = [Q.Rule("Topology.Overlap", "Topology", lambda c: Q.check_overlaps(c.features, 7.0), True)]
    assert [r["rule"] for r in Q.run_qa(ctx, rules, ceiling=1).collect()] == ["QaQc.TopologySkipped"]
    assert Q.run_qa(ctx, rules, ceiling=5).count() == 1


def test_cap_keeps_first_and_notes_the_rest(spark):
    d = spark.range(12).select(F.lit("D").alias("dataset"), F.col("id").alias("pos"))
    f = Q.finding(d, "R", 1, "Topology", F.lit("m"), pos=F.col("pos"))
    assert sorted(r["pos"] for r in Q.cap_findings(f, 5).collect() if r["pos"] is not None) == [0, 1, 2, 3, 4]
    assert Q.cap_findings(f, 5).where("code = 'QaQc.FindingsTruncated'").count() == 1
    assert Q.cap_findings(f, 12).where("code = 'QaQc.FindingsTruncated'").count() == 0


def test_required_fields_of_a_dataset_without_fields(spark):
    features = spark.createDataFrame([("d", "f1", 0, {"A": "1"})], "dataset string, feature_id string, pos long, attrs map<string,string>")
    fields = spark.createDataFrame([], "dataset string, name string")
    got = Q.check_required(features, fields, ["A", "B"]).collect()
    assert sorted(r.field for r in got) == ["A", "B"]


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


@pytest.mark.parametrize("rings,contact", [
    ([SQUARE, [(2, 2), (4, 2), (4, 4), (2, 4)]], None),
    ([SQUARE, [(8, 8), (12, 8), (12, 9), (8, 9)]], 2),  # a hole across the shell
    ([[(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)], [(4, 2), (6, 2), (6, 5), (4, 5)]], 2),  # a spike of the shell through a hole
    ([SQUARE, [(0, 5), (3, 4), (3, 6)]], None),  # a hole that touches the shell in one point
    ([SQUARE, [(2, 2), (4, 2), (4, 4), (2, 4)], [(2, 2), (4, 2), (4, 4), (2, 4)]], None),  # equal holes are another fault
    ([SQUARE, [(2, 2), (5, 2), (5, 5), (2, 5)], [(4, 4), (7, 4), (7, 7), (4, 7)]], 2),  # holes that cross
])
def test_rings_that_cross(spark, rings, contact):
    found = Q.self_contacts(outlines(spark, [("a", rings)]), ["feature_id"]).collect()
    assert [r["contact"] for r in found if r["contact"] == 2] == ([contact] if contact else [])


def test_stray_and_nested_holes_are_repaired(spark):
    from terrafold.operators import build as B

    box = lambda a, s: [(a, a), (a + s, a), (a + s, a + s), (a, a + s)]
    rows = [("stray", [box(0, 10), box(20, 2)]), ("nested", [box(0, 10), box(1, 6), box(2, 2)]), ("plain", [box(0, 10), box(2, 3)]), ("across", [box(0, 10), box(8, 4)])]
    f, _ = B.build_features(outlines(spark, rows), B.BuildProfile())
    got = {r["feature_id"]: (r["status"], r["was_repaired"], r["a"]) for r in f.select("feature_id", "status", "was_repaired", G.st_area("geom").alias("a")).collect()}
    assert got == {"stray": ("written", True, 100.0), "nested": ("written", True, 64.0), "plain": ("written", False, 91.0), "across": ("written", True, 96.0)}


def test_short_paths_are_compared_many_at_once():
    """the segments of each path were compared by nested lambdas, pair by pair; the rings of each polygon by a join."""
    rng = np.random.default_rng(5)
    paths = [rng.integers(0, 5, (int(rng.integers(1, 9)), 2)).astype(float) for _ in range(400)]
    paths = [np.concatenate([p, p[:1]]) if rng.random() < 0.5 else p for p in paths]
    ends = np.cumsum([0, *map(len, paths)])
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    on = lambda p, q, r: side(p, q, r) == 0 and (np.minimum(p, q) <= r).all() and (r <= np.maximum(p, q)).all()

    def contact(a, b, c, d):
        lap = [min(max(a[k], b[k]), max(c[k], d[k])) - max(min(a[k], b[k]), min(c[k], d[k])) for k in (0, 1)]
        flat = side(a, b, c) == 0 and side(a, b, d) == 0 and min(lap) >= 0 and max(lap) > 0
        cross = side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0
        return 2 if flat or cross else int(on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b))

    def worst(p):
        n, out = len(p) - 1, 0
        for s in range(n):
            for t in range(s + 1, n):
                k = contact(p[s], p[s + 1], p[t], p[t + 1])
                beside = t - s == 1 or (s == 0 and t == n - 1 and (p[0] == p[-1]).all())
                out = max(out, 0 if beside and k == 1 else k)
        return out

    assert Q._contacts(np.concatenate(paths), ends).tolist() == [worst(p) for p in paths]
    crossed = lambda p, q: any(contact(p[s], p[s + 1], q[t], q[t + 1]) == 2 for s in range(len(p) - 1) for t in range(len(q) - 1))
    pairs = Q._crossed(np.concatenate(paths), ends, np.arange(0, 401, 2))
    assert pairs.tolist() == [crossed(paths[i], paths[i + 1]) for i in range(0, 400, 2)]
