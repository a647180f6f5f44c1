"""Queries over overlay, relation, dissolve, clip, repair, buffer, simplification and feature building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import arrangement as A
from ..operators import build as B
from ..operators import quality as Q
from ..operators import spatial as S
from ..operators.common import spread
from . import derive as V
from .derive import with_sql
from .quality import faulty_features
from .registry import load, query
from .spatial import MEET, _zones

ZB = tuple("z" + c for c in S.BOX)


def zone_pairs(spark, sf):
    """Parcels and the zones they meet, as geometry pairs."""
    z = _zones(spark, sf).select("zone", *[F.col(c).alias("z" + c) for c in S.BOX])
    j = S.box_pairs(V.parcels(spark, sf).select("id", *S.BOX), z, 50.0, S.BOX, ZB)
    return j.select(F.concat_ws("|", F.col("id").cast("string"), F.col("zone").cast("string")).alias("pair_id"),
                    G.rect(*S.BOX).alias("geom_a"), G.rect(*ZB).alias("geom_b"))


V.CTE["zp"] = f"""SELECT p.id || '|' || z.zone AS pair_id, p.minx AS ax0, p.miny AS ay0, p.maxx AS ax1, p.maxy AS ay1, z.minx AS bx0, z.miny AS by0, z.maxx AS bx1, z.maxy AS by1
FROM /*parcels*/ parcels p JOIN /*zones*/ zones z ON {MEET}"""


@query("overlay_areas", with_sql("zp", body="""
SELECT pair_id, round(i, 4) AS intersection, round(a + b - i, 4) AS "union", round(a - i, 4) AS difference, round(a + b - 2*i, 4) AS symdifference FROM (
 SELECT pair_id, (ax1-ax0)*(ay1-ay0) AS a, (bx1-bx0)*(by1-by0) AS b, (least(ax1,bx1)-greatest(ax0,bx0))*(least(ay1,by1)-greatest(ay0,by0)) AS i FROM zp)"""))
def overlay_areas(spark, sf):
    pairs = zone_pairs(spark, sf)
    u = A.label_pairs(pairs)[0]
    out = pairs.select("pair_id")
    for op in ("intersection", "union", "difference", "symdifference"):
        a = A.boundary_area(A._emit(u, "pair_id", op), "pair_id").select("pair_id", F.col("area").alias(op))
        out = out.join(a, "pair_id", "left").withColumn(op, F.abs(F.round(F.coalesce(op, F.lit(0.0)), 4)))
    return out


@query("overlay_polygons", with_sql("zp", body="""
SELECT pair_id, round((ax1-ax0)*(ay1-ay0) - i, 4) AS area FROM (
 SELECT *, (least(ax1,bx1)-greatest(ax0,bx0))*(least(ay1,by1)-greatest(ay0,by0)) AS i FROM zp) WHERE NOT (ax0 >= bx0 AND ax1 <= bx1 AND ay0 >= by0 AND ay1 <= by1)"""))
def overlay_polygons(spark, sf):
    o = A.st_overlay(zone_pairs(spark, sf), "difference")
    return o.select("pair_id", F.round(G.st_area("geom"), 4).alias("area"))


IN_AB = "(ax0 >= bx0 AND ax1 <= bx1 AND ay0 >= by0 AND ay1 <= by1)"
IN_BA = "(bx0 >= ax0 AND bx1 <= ax1 AND by0 >= ay0 AND by1 <= ay1)"
INNER = "(ax0 < bx1 AND ax1 > bx0 AND ay0 < by1 AND ay1 > by0)"
V.CTE["zrel"] = f"""SELECT pair_id, CASE WHEN {INNER} THEN '2' ELSE 'F' END || CASE WHEN {INNER} AND NOT {IN_AB} THEN '1' ELSE 'F' END || CASE WHEN {IN_AB} THEN 'F' ELSE '2' END
 || CASE WHEN {INNER} AND NOT {IN_BA} THEN '1' ELSE 'F' END || CASE WHEN ((ax0 IN (bx0,bx1) OR ax1 IN (bx0,bx1)) AND ay0 < by1 AND ay1 > by0) OR ((ay0 IN (by0,by1) OR ay1 IN (by0,by1)) AND ax0 < bx1 AND ax1 > bx0) THEN '1'
   WHEN (ax0 > bx0 AND ax1 < bx1 AND ay0 > by0 AND ay1 < by1) OR (bx0 > ax0 AND bx1 < ax1 AND by0 > ay0 AND by1 < ay1) THEN 'F' ELSE '0' END
 || CASE WHEN {IN_AB} THEN 'F' ELSE '1' END || CASE WHEN {IN_BA} THEN 'F' ELSE '2' END || CASE WHEN {IN_BA} THEN 'F' ELSE '1' END || '2' AS matrix FROM /*zp*/ zp"""


@query("relation_matrix", with_sql("zrel", body="""
SELECT pair_id, matrix, matrix LIKE 'F%' AS touches, matrix LIKE '2_F__F___' AS within, matrix LIKE '2_2___2__' AS overlaps FROM zrel"""))
def relation_matrix(spark, sf):
    r = A.st_relate(zone_pairs(spark, sf))
    p = lambda n: A.st_predicate(n, "matrix", "da", "db")
    return r.select("pair_id", "matrix", p("touches").alias("touches"), p("within").alias("within"), p("overlaps").alias("overlaps"))


# A plot as closed rectangles that cover it: below, left of, right of and above its hole.
V.CTE["plotcover"] = """SELECT id, minx AS x0, miny AS y0, maxx AS x1, miny + (maxx-minx)/8 AS y1 FROM /*parcels*/ parcels
 UNION ALL SELECT id, minx, miny, minx + (maxx-minx)/8, maxy FROM parcels
 UNION ALL SELECT id, minx + (maxx-minx)/4, miny, maxx, miny + (maxx-minx)/2 FROM parcels
 UNION ALL SELECT id, minx, miny + (maxx-minx)/4, minx + (maxx-minx)/2, maxy FROM parcels"""


def plots_in_zones(spark, sf, predicate):
    z = _zones(spark, sf).select(F.col("zone").alias("rid"), G.rect(*S.BOX).alias("rgeom"))
    return A.geometry_join(V.plots(spark, sf).select(F.col("id").alias("lid"), F.col("geom").alias("lgeom")), z, predicate, 50.0).select(
        F.col("lid").alias("id"), F.col("rid").alias("zone"))


@query("geometry_join_intersects", with_sql("plotcover", "zones", body="""
SELECT DISTINCT p.id, z.zone FROM plotcover p JOIN zones z
 ON p.x0 <= z.maxx + 1e-9 AND p.x1 >= z.minx - 1e-9 AND p.y0 <= z.maxy + 1e-9 AND p.y1 >= z.miny - 1e-9"""))
def geometry_join_intersects(spark, sf):
    return plots_in_zones(spark, sf, "intersects")


@query("geometry_join_within", with_sql("parcels", "zones", body="""
SELECT p.id, z.zone FROM parcels p JOIN zones z ON p.minx >= z.minx - 1e-9 AND p.maxx <= z.maxx + 1e-9 AND p.miny >= z.miny - 1e-9 AND p.maxy <= z.maxy + 1e-9"""))
def geometry_join_within(spark, sf):
    return plots_in_zones(spark, sf, "within")


@query("line_relations")
def line_relations(spark, sf):
    """Road lines against the zones they meet: named predicates of a line and a polygon."""
    lines = G.with_envelope(V.line_geoms(spark, sf).select("id", "geom"))
    z = _zones(spark, sf).select("zone", *[F.col(c).alias("z" + c) for c in S.BOX])
    j = S.box_pairs(lines, z, 50.0, S.BOX, ZB)
    pairs = j.select(F.concat_ws("|", F.col("id").cast("string"), F.col("zone").cast("string")).alias("pair_id"), F.col("geom").alias("geom_a"), G.rect(*ZB).alias("geom_b"))
    r = A.st_relate(pairs)
    return r.select("pair_id", "matrix", *[A.st_predicate(n, "matrix", "da", "db").alias(n) for n in ("crosses", "within", "touches", "intersects")])


def lattice(spark, sf):
    """Parcels moved to whole units so that their union can be counted square by square."""
    p = V.parcels(spark, sf)
    x, y, s = F.floor("minx").cast("double"), F.floor("miny").cast("double"), F.col("maxx") - F.col("minx")
    s = F.round(s, 0)
    return p.select("id", F.col("o_orderpriority").alias("key"), G.rect(x, y, x + s, y + s).alias("geom"))


V.CTE["squares"] = """SELECT DISTINCT key, x + dx AS cx, y + dy AS cy FROM (
 SELECT lower(o_orderpriority) AS key, floor(minx)::BIGINT AS x, floor(miny)::BIGINT AS y, unnest(range(0, 1 + id % 17)) AS dx, 1 + id % 17 AS s FROM /*parcels*/ parcels), LATERAL (SELECT unnest(range(0, s)) AS dy)"""


@query("dissolved_measures", with_sql("squares", body="""
SELECT key, count(*)::DOUBLE AS area, (4*count(*) - 2*(SELECT count(*) FROM squares b JOIN squares c ON b.key = c.key AND b.cy = c.cy AND b.cx + 1 = c.cx WHERE b.key = a.key)
 - 2*(SELECT count(*) FROM squares b JOIN squares c ON b.key = c.key AND b.cx = c.cx AND b.cy + 1 = c.cy WHERE b.key = a.key))::DOUBLE AS length FROM squares a GROUP BY key"""))
def dissolved_measures(spark, sf):
    m = A.boundary_area(A.dissolve_edges(lattice(spark, sf), "key", 25.0), "key")
    return m.select("key", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"))


@query("dissolved_polygons", with_sql("squares", body="SELECT key, count(*)::DOUBLE AS area, 'MultiPolygon' AS kind FROM squares GROUP BY key"))
def dissolved_polygons(spark, sf):
    d = A.dissolve(lattice(spark, sf), "key", 25.0)
    return d.select("key", F.round(G.st_area("geom"), 4).alias("area"), F.col("geom.kind").alias("kind"))


@query("union_of_all", with_sql("squares", body="SELECT count(DISTINCT (cx, cy))::DOUBLE AS area FROM squares"))
def union_of_all(spark, sf):
    return A.boundary_area(A.union_all_geom(lattice(spark, sf), 25.0), "key").select(F.round("area", 4).alias("area"))


@query("coverage_dissolve", """
WITH c AS (SELECT o_custkey % 7 AS key, o_orderkey % 300 AS x, o_orderkey // 300 AS y FROM orders)
SELECT key::VARCHAR AS key, count(*)*100.0::DOUBLE AS area, (40*count(*) - 20*(SELECT count(*) FROM c b JOIN c d ON b.key = d.key AND b.y = d.y AND b.x + 1 = d.x WHERE b.key = a.key)
 - 20*(SELECT count(*) FROM c b JOIN c d ON b.key = d.key AND b.x = d.x AND b.y + 1 = d.y WHERE b.key = a.key))::DOUBLE AS length FROM c a GROUP BY key""")
def coverage_dissolve(spark, sf):
    k = F.col("o_orderkey")
    x, y = (k % 300) * 10.0, F.floor(k / 300) * 10.0
    d = load(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("key"), G.rect(x, y, x + 10, y + 10).alias("geom"))
    return A.boundary_area(A.coverage_edges(d, "key"), "key").select("key", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"))


@query("clip_to_polygons", with_sql("parcels", body="""
SELECT id, minx >= 300 AND maxx <= 900 AND miny >= 300 AND maxy <= 900 AS covered, round((least(maxx, 900) - greatest(minx, 300))*(least(maxy, 900) - greatest(miny, 300)), 4) AS area
FROM parcels WHERE minx < 900 AND maxx > 300 AND miny < 900 AND maxy > 300"""))
def clip_to_polygons(spark, sf):
    b = spark.range(1).select(F.lit("city").alias("boundary_id"), G.rect(F.lit(300.0), F.lit(300.0), F.lit(900.0), F.lit(900.0)).alias("boundary"))
    c = A.clip(V.parcel_geoms(spark, sf), b, "id")
    return c.select("id", "covered", F.round(G.st_area("geom"), 4).alias("area"))


@query("geometry_distance", with_sql("parcels", "zones", body="""
SELECT p.id || '|' || z.zone AS pair_id, round(sqrt(pow(greatest(0, z.minx - p.maxx, p.minx - z.maxx), 2) + pow(greatest(0, z.miny - p.maxy, p.miny - z.maxy), 2)), 6) AS distance
FROM parcels p JOIN zones z ON p.minx - 5 <= z.maxx AND p.maxx + 5 >= z.minx AND p.miny - 5 <= z.maxy AND p.maxy + 5 >= z.miny
WHERE NOT (p.minx >= z.minx AND p.maxx <= z.maxx AND p.miny >= z.miny AND p.maxy <= z.maxy)"""))
def geometry_distance(spark, sf):
    z = _zones(spark, sf).select("zone", *[F.col(c).alias("z" + c) for c in S.BOX])
    p = V.parcels(spark, sf).select("id", *S.BOX)
    reach = tuple(e for e in G.extent_expand(*S.BOX, 5.0))
    j = S.box_pairs(p, z, 50.0, reach, ZB).where(~S.box_predicate("within", S.BOX, ZB))
    pair = j.select("id", "zone", F.concat_ws("|", F.col("id").cast("string"), F.col("zone").cast("string")).alias("pair_id"))
    pair = pair.withColumnsRenamed({"id": "id_a", "zone": "id_b"})
    a = p.select(F.col("id").alias("id_a"), G.rect(*S.BOX).alias("geom_a"))
    b = z.select(F.col("zone").alias("id_b"), G.rect(*ZB).alias("geom_b"))
    return S.segment_distance(a, b, pair, keys=["pair_id"]).select("pair_id", F.round("d", 6).alias("distance"))


@query("repaired_polygons", """
SELECT o_orderkey AS id, 'rebuilt outline' AS action, CASE o_orderkey % 2 WHEN 0 THEN round(s*s*25.0::DOUBLE/6 * 2, 3) ELSE round(s*s*8.0::DOUBLE, 3) END AS area FROM (SELECT o_orderkey, 1.0::DOUBLE + o_orderkey % 9 AS s FROM orders)""".replace(
    "CASE o_orderkey % 2 WHEN 0 THEN round(s*s*25.0::DOUBLE/6 * 2, 3) ELSE round(s*s*8.0::DOUBLE, 3) END", "CASE o_orderkey % 2 WHEN 0 THEN round(s*s*16/3.0::DOUBLE, 3) ELSE round(s*s*8.0::DOUBLE, 3) END"))
def repaired_polygons(spark, sf):
    k = F.col("o_orderkey")
    s = 1.0 + k % 9
    x, y = (k % 100) * 1.0, (k % 77) * 1.0
    at = lambda a, b: G.vertex(x + s * a, y + s * b)
    # A bow-tie of unequal wings keeps the larger one; a ring that doubles back over a square keeps its region once.
    tie = F.array(at(0, 0), at(4, 4), at(4, 0), at(0, 2), at(0, 0))
    over = F.array(at(0, 0), at(2, 0), at(2, 2), at(1, 2), at(1, 1), at(4, 1), at(4, 2.5), at(1, 2.5), at(0, 2.5), at(0, 0))
    d = load(spark, sf, "orders").select(k.alias("id"), G.polygon(F.when(k % 2 == 0, tie).otherwise(over)).alias("geom"))
    r = A.repair(d, "id")
    return r.select("id", "action", F.round(G.st_area("repaired"), 3).alias("area"))


@query("repaired_lines", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'removed repeated vertices' END AS action, CASE WHEN o_orderkey % 3 <> 0 THEN 2 END AS n FROM orders""")
def repaired_lines(spark, sf):
    k = F.col("o_orderkey")
    v = lambda dx: G.vertex(k.cast("double") + dx, F.lit(1.0))
    path = F.when(k % 3 == 0, F.array(v(0), v(0), v(0))).otherwise(F.array(v(0), v(0), v(2), v(2)))
    d = load(spark, sf, "orders").select(k.alias("id"), G.line(path).alias("geom"))
    d = d.withColumn("r", A.repair_lines("geom"))
    return d.select("id", F.when(F.col("r").isNull(), "failed").otherwise("removed repeated vertices").alias("action"),
                    F.when(F.col("r").isNotNull(), F.size(G.vertices("r")).cast("long")).alias("n"))


@query("buffered_points", """
SELECT s_suppkey::VARCHAR AS id, round(64*sin(2*pi()/32)/2*32/4.0::DOUBLE, 4) AS area FROM supplier""")
def buffered_points(spark, sf):
    k = F.col("s_suppkey")
    d = load(spark, sf, "supplier").select(k.alias("id"), G.point(k * 20.0, F.lit(0.0)).alias("geom"))
    m = A.boundary_area(A.buffer_edges(d, "id", 4.0), "id")
    return m.select("id", F.round("area", 4).alias("area"))


@query("buffered_lines", """
SELECT s_suppkey::VARCHAR AS id, 96.0::DOUBLE AS area, 64.0::DOUBLE AS shrunk FROM supplier""")
def buffered_lines(spark, sf):
    """Bent lines with flat caps and mitred corners, and squares shrunk by one unit."""
    k = F.col("s_suppkey")
    x = k * 40.0
    bent = G.line(F.array(G.vertex(x, F.lit(0.0)), G.vertex(x + 12, F.lit(0.0)), G.vertex(x + 12, F.lit(12.0))))
    s = load(spark, sf, "supplier")
    grown = A.boundary_area(A.buffer_edges(s.select(k.alias("id"), bent.alias("geom")), "id", 2.0, cap="flat", join="mitre"), "id")
    box = G.rect(x, F.lit(0.0), x + 10, F.lit(10.0))
    less = A.boundary_area(A.buffer_edges(s.select(k.alias("id"), box.alias("geom")), "id", -1.0, join="mitre"), "id")
    j = grown.join(less.select("id", F.col("area").alias("shrunk")), "id")
    return j.select("id", F.round("area", 4).alias("area"), F.round("shrunk", 4).alias("shrunk"))


@query("simplified_lines", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 6 END AS n FROM orders""")
def simplified_lines(spark, sf):
    k = F.col("o_orderkey")
    h = F.when(k % 2 == 0, 0.05).otherwise(3.0)
    v = lambda a, b: G.vertex(k * 1.0 + a, h * b)
    # A zigzag: flat ones lose every inner vertex, steep ones keep each turn but the midpoints on the way.
    path = F.array(v(0, 0), v(1, 0.5), v(2, 1), v(3, 0.5), v(4, 0), v(5, 0.5), v(6, 1), v(7, 0.5), v(8, 0), v(10, 1))
    d = spread(load(spark, sf, "orders").select("o_orderkey")).select(k.alias("id"), G.line(path).alias("geom"))
    return B.simplify(d, 0.1).select("id", F.size(G.vertices("geom")).cast("long").alias("n"))


def bumped_shapes(spark, sf):
    return bumps_of(load(spark, sf, "orders"))


def bumps_of(orders):
    """Squares of ten units with a low bump (0), one that holds a hole (1), a high bump (2), a dent that holds a part of its own (3)."""
    k = F.col("o_orderkey")
    x, y = (k % 1000) * 20.0, F.floor(k / 1000) * 20.0
    v = lambda a, b: G.vertex(x + a, y + b)
    ring = lambda *p: F.array(*[v(a, b) for a, b in p])
    side = lambda tip: ring((0, 0), (10, 0), (10, 4.5), (tip, 5), (10, 5.5), (10, 10), (0, 10), (0, 0))
    inner = ring((10.125, 4.875), (10.25, 5), (10.125, 5.125), (10.125, 4.875))
    island = ring((9.625, 5), (9.875, 4.9375), (9.875, 5.0625), (9.625, 5))
    low, high, dent = side(10.5), side(13), side(9.5)
    geom = (F.when(k % 4 == 0, G.polygon(low)).when(k % 4 == 1, G.polygon(low, inner)).when(k % 4 == 2, G.polygon(high))
            .otherwise(G.make_geom(G.MULTI[G.POLYGON], F.array(F.array(dent), F.array(island)))))
    return spread(orders.select("o_orderkey")).select(F.lit("BUMPS").alias("dataset"), k.cast("string").alias("feature_id"), k.alias("pos"), geom.alias("geom"))


# A low bump goes; with a hole in it, or a part in a dent, the tip stays; a high bump loses nothing but is left as it was.
@query("simplified_polygons", """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 8 ELSE 10 END::BIGINT AS n,
 CASE o_orderkey % 4 WHEN 0 THEN 100.0 WHEN 1 THEN 102.5 - 0.015625 WHEN 2 THEN 101.5 ELSE 97.5 + 0.015625 END::DOUBLE AS area,
 (o_orderkey % 2)::INT AS limited, 0::BIGINT AS faults FROM orders""")
def simplified_polygons(spark, sf):
    from ..operators.common import cut_lineage

    d = cut_lineage(B.simplify(bumped_shapes(spark, sf), 1.0, refused="held"))
    faults = Q.check_geometry(d).groupBy("pos").agg(F.count("*").alias("faults"))
    out = d.join(faults, "pos", "left")
    return out.select(F.col("pos").alias("id"), F.size(G.vertices("geom")).cast("long").alias("n"), F.round(G.st_area("geom"), 9).alias("area"),
                      (F.col("held") > 0).cast("int").alias("limited"), F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


@query("simplified_build", """
SELECT o_orderkey AS id, 'written' AS status, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 WHEN 2 THEN 8 ELSE 10 END::BIGINT AS n,
 CASE WHEN o_orderkey % 2 = 1 THEN 'Gis.SimplificationLimited' END AS code FROM orders""")
def simplified_build(spark, sf):
    """The whole build with a tolerance: no fault but the note on what had to stay."""
    f, notes = B.build_features(bumped_shapes(spark, sf), B.BuildProfile(simplify_tol=1.0))
    n = notes.select(F.col("pos").alias("p"), "code")
    return f.join(n, F.col("pos") == F.col("p"), "left").select(F.col("pos").alias("id"), "status", F.size(G.vertices("geom")).cast("long").alias("n"), "code")


@query("interior_points", with_sql("plots", body="SELECT id, true AS inside FROM plots"))
def interior_points(spark, sf):
    d = G.pin(V.plots(spark, sf).select("id", "geom"), p=B.point_on_surface("geom"))
    return d.select("id", (S.point_in_polygon("geom", "p.x", "p.y") > 0).alias("inside"))


@query("snapped_to_reference", with_sql("lines", body="""
SELECT id, (id % 300)*10.0::DOUBLE AS x1, x3, y3 FROM lines"""))
def snapped_to_reference(spark, sf):
    grid = V.lines(spark, sf)
    ref = grid.select(F.col("id").alias("fid"), G.point((F.col("id") % 300) * 10.0, "y1").alias("geom"))
    f = V.line_geoms(spark, sf).select(F.col("id").alias("feature_id"), "geom")
    s = B.snap_to(f, ref, 0.01)
    v = G.vertices("geom")
    return s.select(F.col("feature_id").alias("id"), F.get(v, F.lit(0))["x"].alias("x1"), F.element_at(v, -1)["x"].alias("x3"), F.element_at(v, -1)["y"].alias("y3"))


BUILD = B.BuildProfile(orientation="Clockwise", promote=True, precision_scale=1000.0)


@query("feature_build", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 12 IN (0, 1, 2, 3) THEN 'empty' ELSE 'written' END AS status, o_orderkey % 12 IN (4, 6, 7, 10) AS repaired_outline, CASE o_orderkey % 12 WHEN 5 THEN 'MultiLineString' WHEN 9 THEN 'MultiLineString'
 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'Polygon' WHEN 2 THEN 'Polygon' WHEN 3 THEN 'Polygon' ELSE 'MultiPolygon' END AS kind FROM orders""")
def feature_build(spark, sf):
    e = faulty_features(spark, sf)
    f, _ = B.build_features(e, BUILD)
    return f.select(F.col("pos").alias("id"), "status", F.col("was_repaired").alias("repaired_outline"), F.col("geom.kind").alias("kind"))


@query("build_outcome", """
SELECT 'MIXED' AS dataset, count(*) FILTER (o_orderkey % 12 NOT IN (0,1,2,3)) AS written, count(*) FILTER (o_orderkey % 12 IN (0,1,2,3)) AS skipped, count(*) FILTER (o_orderkey % 12 IN (4, 6, 7, 10)) AS repaired FROM orders""")
def build_outcome(spark, sf):
    e = faulty_features(spark, sf)
    f, _ = B.build_features(e, B.BuildProfile(drop_unusable=True))
    return B.outcome(f, ["dataset"])


@query("failure_breaker", """
WITH e AS (SELECT event_type AS layer, event_id AS pos, user_id % 3 <> 0 AS failed FROM events),
i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY layer ORDER BY pos) AS isl FROM e),
r AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY layer, isl ORDER BY pos) AS run FROM i),
c AS (SELECT layer, min(pos) AS cut FROM r WHERE failed AND run >= 9 GROUP BY 1)
SELECT layer, pos, coalesce(pos = cut, false) AS abandoned FROM r LEFT JOIN c USING (layer) WHERE cut IS NULL OR pos <= cut""")
def failure_breaker(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("layer"), F.col("event_id").alias("pos"), (F.col("user_id") % 3 != 0).alias("failed"))
    return B.failure_breaker(e, 9, block=64).select("layer", "pos", "abandoned")


TEETH = 1250  # of a comb with four edges each
COMB = (301.23, 302.53, 437.57, 897.53)  # left, bottom, top of the back, top of the teeth


def comb(spark):
    """A boundary of 5,002 edges: a back with teeth a quarter wide every half."""
    x, y, back, top = COMB
    i = F.col("id")
    tooth = spark.range(TEETH).select(i, F.array(*[F.struct((F.lit(x) + i * 0.5 + a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.25, back), (0.25, top), (0.0, top), (0.0, back))]).alias("v"))
    ring = tooth.groupBy().agg(F.sort_array(F.collect_list(F.struct((-i).alias("n"), "v"))).alias("t"))
    right = x + TEETH * 0.5
    body = F.transform(F.flatten(F.transform("t", lambda e: e["v"])), lambda v: G.vertex(v["x"], v["y"]))
    path = F.concat(F.array(G.vertex(F.lit(x), F.lit(y)), G.vertex(F.lit(right), F.lit(y)), G.vertex(F.lit(right), F.lit(back))), body, F.array(G.vertex(F.lit(x), F.lit(y))))
    return ring.select(F.lit("comb").alias("boundary_id"), G.polygon(path).alias("boundary"))


V.CTE["comb"] = f"""SELECT {COMB[0]}::DOUBLE AS tx0, {COMB[0] + TEETH * 0.5}::DOUBLE AS tx1, {COMB[1]}::DOUBLE AS ty0, {COMB[2]}::DOUBLE AS ty1, true AS back
UNION ALL SELECT {COMB[0]}::DOUBLE + i*0.5::DOUBLE, {COMB[0]}::DOUBLE + i*0.5::DOUBLE + 0.25::DOUBLE, {COMB[2]}::DOUBLE, {COMB[3]}::DOUBLE, false FROM range({TEETH}) t(i)"""


CLIPPED = with_sql("parcels", "lines", "comb", "sites", body="""
SELECT id, bool_or(whole) AS covered, round(sum(m), 5) AS measure FROM (
 SELECT 'P' || id AS id, back AND minx >= tx0 AND maxx <= tx1 AND miny >= ty0 AND maxy <= ty1 AS whole, greatest(0, least(maxx, tx1) - greatest(minx, tx0)) * greatest(0, least(maxy, ty1) - greatest(miny, ty0)) AS m
 FROM parcels, comb WHERE minx < tx1 AND maxx > tx0 AND miny < ty1 AND maxy > ty0
 UNION ALL SELECT 'L' || id, back AND x1 >= tx0 AND x3 <= tx1 AND y1 >= ty0 AND greatest(y1, y3) <= ty1, CASE WHEN y1 >= ty0 AND y1 <= ty1 THEN greatest(0, least(x2, tx1) - greatest(x1, tx0)) ELSE 0 END
  + CASE WHEN y3 = y2 THEN CASE WHEN y1 >= ty0 AND y1 <= ty1 THEN greatest(0, least(x3, tx1) - greatest(x2, tx0)) ELSE 0 END
    ELSE greatest(0, least(x3, tx1, x2 + ty1 - y2) - greatest(x2, tx0, x2 + ty0 - y2)) * sqrt(2) END
 FROM lines, comb WHERE x1 < tx1 AND x3 > tx0 AND y1 <= ty1 AND greatest(y1, y3) >= ty0
 UNION ALL SELECT 'S' || lid, true, 1.0 FROM sites, comb WHERE px >= tx0 AND px <= tx1 AND py >= ty0 AND py <= ty1) GROUP BY id HAVING sum(m) > 0""")


@query("clip_shapes", CLIPPED)
def clip_shapes(spark, sf):
    """Polygons, lines and points by one long outline."""
    from .spatial import _sites

    named = lambda d, c, g: d.select(F.concat(F.lit(c), F.col(g[0]).cast("string")).alias("id"), F.col(g[1]).alias("geom"))
    f = named(V.parcel_geoms(spark, sf), "P", ("id", "geom")).unionByName(named(V.line_geoms(spark, sf), "L", ("id", "geom"))).unionByName(named(_sites(spark, sf), "S", ("lid", "lgeom")))
    return measured(A.clip(f, comb(spark), "id"))


def measured(c):
    kind = G.base_kind("geom")
    return c.select("id", "covered", F.round(F.when(kind == G.POINT, 1.0).when(kind == G.LINE, G.st_length("geom")).otherwise(G.st_area("geom")), 5).alias("measure"))
