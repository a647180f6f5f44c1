"""Measures against answers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from terrafold.functions import crs as C
from terrafold.functions import curves as K
from terrafold.functions import geodesy as D
from terrafold.functions import geometry as G
from terrafold.operators import shapes as H
from terrafold.operators import spatial as S


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def ring(pts):
    return F.array(*[G.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in pts])


def box(a, b, c, d):
    return G.rect(*[F.lit(float(v)) for v in (a, b, c, d)])


def test_geodesic_answers(spark):
    r = one(spark, D.geodesic_distance(F.lit(-0.1278), F.lit(51.5074), F.lit(2.3522), F.lit(48.8566)), D.geodesic_distance(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)),
            D.geodesic_area(box(0, 0, 1, 1)), D.geodesic_area(box(-180, 0, 180, 90)))
    assert r[0] == pytest.approx(343_600, rel=1e-3)
    assert r[1] == pytest.approx(111_195, rel=1e-5)
    assert r[2] / 1e6 == pytest.approx(12_364, rel=1e-3)
    assert r[3] == pytest.approx(2 * math.pi * D.EARTH_RADIUS_M**2, rel=1e-12)


def test_area_of_collection_counts_members_by_kind(spark):
    g = G.make_geom(G.COLLECTION, F.array(F.array(ring([(0, 0), (2, 0), (2, 2), (0, 0)])), F.array(ring([(0, 0), (5, 0)]))), F.array(F.lit("Polygon"), F.lit("LineString")))
    r = one(spark, G.st_area(g), G.st_length(g))
    assert r[0] == pytest.approx(2.0)
    assert r[1] == pytest.approx(4 + math.sqrt(8) + 5)


def test_empty_geometry(spark):
    e = G.empty_geom(G.POLYGON)
    r = one(spark, G.st_area(e), G.is_empty(e), G.envelope(e), G.st_centroid(e))
    assert r[0] == 0 and r[1] and r[2] is None and r[3] is None


def test_dedupe_keeps_shell_and_drops_hole(spark):
    shell, hole = ring([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), ring([(1, 1), (1.001, 1), (1.001, 1.001), (1, 1)])
    r = one(spark, G.dedupe_vertices(G.polygon(shell, hole), 0.01), G.dedupe_vertices(G.polygon(hole), 0.01))
    assert len(r[0]["parts"][0]) == 1
    assert len(r[1]["parts"][0][0]) == 4


def test_point_in_rings(spark):
    rings = F.array(ring([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), ring([(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]))
    at = lambda x, y: S.point_in_rings(rings, F.lit(float(x)), F.lit(float(y)))
    r = one(spark, at(3, 3), at(1.5, 1.5), at(4, 2), at(2, 1.5), at(5, 5), at(0, 0))
    assert list(r) == [1, -1, 0, 0, -1, 0]


def test_utm_known_values(spark):
    fwd = lambda lon, lat, z: C.transform_xy(F.lit(float(lon)), F.lit(float(lat)), F.lit(4326), F.lit(z))
    r = one(spark, fwd(3, 0, 32631), fwd(3, 45, 32631), fwd(3, -45, 32731), C.transform_xy(F.lit(1.0), F.lit(1.0), F.lit(27700), F.lit(4326)))
    assert (r[0]["x"], r[0]["y"]) == pytest.approx((500000, 0), abs=1e-6)
    # Meridian arc to 45 degrees on WGS 84 is 4,984,944.378 m.
    assert r[1]["y"] == pytest.approx(4_984_944.378 * 0.9996, abs=2e-3)
    assert r[2]["y"] == pytest.approx(10_000_000 - 4_984_944.378 * 0.9996, abs=2e-3)
    assert r[3] is None


def test_circle_closes_and_holds_tolerance(spark):
    p = one(spark, K.circle_path(F.lit(5.0), F.lit(5.0), F.lit(10.0), 0.01))[0]
    assert p[0] == p[-1]
    half = 2 * math.pi / (len(p) - 1) / 2
    assert 10 * (1 - math.cos(half)) <= 0.01


def test_bulge_half_circle(spark):
    a = one(spark, K.bulge_arc(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(1.0)), K.bulge_arc(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(0.0)))
    assert (a[0]["cx"], a[0]["cy"], a[0]["r"], a[0]["sweep"]) == pytest.approx((1, 0, 1, math.pi))
    assert a[1] is None


@pytest.mark.parametrize("rings,area,kind", [
    ([(0, 10), (2, 4)], 84, "Polygon"),
    ([(0, 10), (1, 6), (2, 4)], 100 - 36 + 16, "Polygon"),
    ([(0, 10), (20, 5)], 125, "MultiPolygon"),
])
def test_nested_rings(spark, rings, area, kind):
    rows = [("k", i, float(o), float(s)) for i, (o, s) in enumerate(rings)]
    d = spark.createDataFrame(rows, "key string, ring_id int, o double, s double")
    d = d.select("key", "ring_id", G.rect_ring(F.col("o"), F.col("o"), F.col("o") + F.col("s"), F.col("o") + F.col("s")).alias("ring"))
    r = H.assemble_polygons(d, 5.0).select(F.col("geom.kind").alias("k"), G.st_area("geom").alias("a")).first()
    # Three squares in one another give a shell with a hole and an island in it.
    assert r["a"] == pytest.approx(area)
    if len(rings) == 2:
        assert r["k"] == kind
