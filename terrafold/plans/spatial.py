"""Queries over spatial joins, nearest neighbours, clipping and snapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import nearness as N
from ..operators import spatial as S
from . import derive as V
from .derive import with_sql
from .measures import HAV
from .registry import load, query

LB = ("lminx", "lminy", "lmaxx", "lmaxy")


def _left(df, *cols):
    return df.select(F.col("id").alias("lid"), *[F.col(c).alias("l" + c) for c in S.BOX], *cols)


def _zones(spark, sf):
    """Rectangular zones from parts: 40 by 25 units on a jittered grid."""
    k = F.col("p_partkey")
    x = ((k * 3571) % 19600) / 10.0
    y = ((k * 6151) % 19700) / 10.0
    return load(spark, sf, "part").select(
        k.alias("zone"), x.alias("minx"), y.alias("miny"), (x + 40.0).alias("maxx"), (y + 25.0).alias("maxy"))


V.CTE["zones"] = """SELECT p_partkey AS zone, ((p_partkey*3571) % 19600)/10.0 AS minx, ((p_partkey*6151) % 19700)/10.0 AS miny,
 ((p_partkey*3571) % 19600)/10.0 + 40.0::DOUBLE AS maxx, ((p_partkey*6151) % 19700)/10.0 + 25.0::DOUBLE AS maxy FROM part"""

# DuckDB runs the check faster with a band equality than as a pure range join.
MEET = "p.minx <= z.maxx AND p.maxx >= z.minx AND p.miny <= z.maxy AND p.maxy >= z.miny"
INNER = "p.minx < z.maxx AND p.maxx > z.minx AND p.miny < z.maxy AND p.maxy > z.miny"
IN_Z = "p.minx >= z.minx AND p.maxx <= z.maxx AND p.miny >= z.miny AND p.maxy <= z.maxy"
Z_IN = "z.minx >= p.minx AND z.maxx <= p.maxx AND z.miny >= p.miny AND z.maxy <= p.maxy"


def _pred_query(name, where):
    @query(f"spatial_join_{name}", with_sql("parcels", "zones", body=f"""
SELECT z.zone, count(*) AS n, min(p.id) AS first_id, max(p.id) AS last_id FROM parcels p JOIN zones z ON {where} GROUP BY 1"""))
    def run(spark, sf):
        j = S.spatial_join(_left(V.parcels(spark, sf)), _zones(spark, sf), name, 50.0, LB, S.BOX)
        return j.groupBy("zone").agg(
            F.count("*").alias("n"), F.min("lid").alias("first_id"), F.max("lid").alias("last_id"))

    return run


_pred_query("intersects", MEET)
_pred_query("touches", f"({MEET}) AND NOT ({INNER})")
_pred_query("within", IN_Z)


@query("spatial_join_contains", with_sql("parcels", "zones", body=f"""
SELECT z.zone, p.id FROM parcels p JOIN zones z ON {IN_Z}"""))
def spatial_contains(spark, sf):
    z = _zones(spark, sf).select("zone", *[F.col(c).alias("z" + c) for c in S.BOX])
    j = S.spatial_join(z, V.parcels(spark, sf), "contains", 50.0, tuple("z" + c for c in S.BOX), S.BOX)
    return j.select("zone", "id")


_pred_query("overlaps", f"({INNER}) AND NOT ({IN_Z}) AND NOT ({Z_IN})")


@query("spatial_join_disjoint", with_sql("parcels", "zones", body=f"""
SELECT id FROM parcels p WHERE id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM zones z WHERE z.zone % 10 = 0 AND {MEET})""".replace(
    "WHERE id % 4 = 0 AND", "WHERE").replace("z.zone % 10 = 0 AND ", "")))
def spatial_disjoint(spark, sf):
    d = S.spatial_join(_left(V.parcels(spark, sf)), _zones(spark, sf), "disjoint", 50.0, LB, S.BOX)
    return d.select(F.col("lid").alias("id"))


@query("disjoint_from_box", with_sql("parcels", body="""
SELECT id FROM parcels WHERE NOT (minx <= 900 AND maxx >= 100 AND miny <= 1500 AND maxy >= 200)"""))
def disjoint_from_box(spark, sf):
    return S.disjoint_from(V.parcels(spark, sf), (100, 200, 900, 1500)).select("id")


@query("point_in_polygon_join", with_sql("plots", "zones", body="""
SELECT p.id, z.zone, CASE WHEN ((qx = x OR qx = x+s) AND qy BETWEEN y AND y+s) THEN 'other' ELSE 'inside' END AS place
FROM plots p JOIN (SELECT zone, minx AS qx, miny AS qy FROM zones) z
 ON qx > x AND qx < x+s AND qy > y AND qy < y+s AND (qx < x+s/2 OR qy < y+s/2)
 AND NOT (qx > x+s/8 AND qx < x+s/4 AND qy > y+s/8 AND qy < y+s/4)
WHERE NOT (qx IN (x+s/8, x+s/4) AND qy BETWEEN y+s/8 AND y+s/4) AND NOT (qy IN (y+s/8, y+s/4) AND qx BETWEEN x+s/8 AND x+s/4)"""))
def point_in_polygon_join(spark, sf):
    z = _zones(spark, sf).select("zone", F.col("minx").alias("qx"), F.col("miny").alias("qy"))
    p = G.with_envelope(V.plots(spark, sf).select("id", "geom"))
    j = S.spatial_join(p, z, "contains", 50.0, S.BOX, ("qx", "qy", "qx", "qy"),
                       exact=S.point_in_polygon("geom", "qx", "qy") > 0)
    return j.select("id", "zone", F.lit("inside").alias("place"))


@query("bbox_query", with_sql("parcels", "zones", body=f"""
SELECT z.zone, p.id FROM parcels p JOIN zones z ON {MEET}"""))
def bbox_query(spark, sf):
    return S.bbox_join(_left(V.parcels(spark, sf)), _zones(spark, sf), 50.0, LB, S.BOX).select(
        "zone", F.col("lid").alias("id"))


def _cs(spark, sf):
    p = V.points(spark, sf)
    side = lambda s, n: p.where(F.col("src") == s).select(
        F.col("id").alias(f"{n}id"), F.col("lon").alias(f"{n}x"), F.col("lat").alias(f"{n}y"))
    return side("C", "l"), side("S", "r")


@query("radius_geodesic", with_sql("points", body=f"""
SELECT lid, rid, metres FROM (SELECT a.id AS lid, b.id AS rid, round({HAV.format(a1='a.lon', b1='a.lat', a2='b.lon', b2='b.lat')}, 3) AS metres
 FROM points a JOIN points b ON a.src='C' AND b.src='S') WHERE metres <= 750000"""))
def radius_geodesic(spark, sf):
    l, r = _cs(spark, sf)
    return S.radius_join(l, r, 750000.0, geographic=True, out="m").select(
        "lid", "rid", F.round("m", 3).alias("metres"))


@query("radius_planar", with_sql("parcels", "zones", body="""
SELECT a.id, b.zone, round(sqrt((a.minx-b.minx)*(a.minx-b.minx)+(a.miny-b.miny)*(a.miny-b.miny)), 6) AS distance
FROM parcels a JOIN zones b ON abs(a.minx-b.minx) <= 7.5 AND abs(a.miny-b.miny) <= 7.5
WHERE sqrt((a.minx-b.minx)*(a.minx-b.minx)+(a.miny-b.miny)*(a.miny-b.miny)) <= 7.5"""))
def radius_planar(spark, sf):
    l = V.parcels(spark, sf).select("id", F.col("minx").alias("lx"), F.col("miny").alias("ly"))
    r = _zones(spark, sf).select("zone", F.col("minx").alias("rx"), F.col("miny").alias("ry"))
    return S.radius_join(l, r, 7.5).select("id", "zone", F.round("distance", 6).alias("distance"))


@query("nearest_neighbours", with_sql("points", body=f"""
SELECT lid, rid, rank, metres FROM (
 SELECT a.id AS lid, b.id AS rid, row_number() OVER (PARTITION BY a.id ORDER BY (a.lon-b.lon)*(a.lon-b.lon)+(a.lat-b.lat)*(a.lat-b.lat), b.id) AS rank,
  round({HAV.format(a1='a.lon', b1='a.lat', a2='b.lon', b2='b.lat')}, 3) AS metres
 FROM points a JOIN points b ON a.src='C' AND b.src='S') WHERE rank <= 3"""))
def nearest_neighbours(spark, sf):
    l, r = _cs(spark, sf)
    j = S.knn_join(l, r, 3, 2.0, geographic=True)
    return j.select("lid", "rid", F.col("rank").cast("long").alias("rank"), F.round("distance", 3).alias("metres"))


@query("point_to_line_distance", with_sql("lines", body="""
SELECT id, round(least(
  sqrt(pow(x1 + greatest(0, least(1, ((1000.0-x1)*(x2-x1)+(700.0-y1)*(y2-y1))/nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1),0)))*(x2-x1) - 1000.0, 2)
   + pow(y1 + greatest(0, least(1, ((1000.0-x1)*(x2-x1)+(700.0-y1)*(y2-y1))/nullif((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1),0)))*(y2-y1) - 700.0, 2)),
  sqrt(pow(x2 + greatest(0, least(1, ((1000.0-x2)*(x3-x2)+(700.0-y2)*(y3-y2))/nullif((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2),0)))*(x3-x2) - 1000.0, 2)
   + pow(y2 + greatest(0, least(1, ((1000.0-x2)*(x3-x2)+(700.0-y2)*(y3-y2))/nullif((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2),0)))*(y3-y2) - 700.0, 2))), 6) AS distance
FROM lines"""))
def point_to_line_distance(spark, sf):
    return V.line_geoms(spark, sf).select(
        "id", F.round(S.point_distance("geom", F.lit(1000.0), F.lit(700.0)), 6).alias("distance"))


@query("clip_to_box", with_sql("parcels", body="""
SELECT id, (minx >= 250 AND maxx <= 1250 AND miny >= 125 AND maxy <= 1700) AS covered,
 round((least(maxx,1250)-greatest(minx,250))*(least(maxy,1700)-greatest(miny,125)), 6) AS area
FROM parcels WHERE minx < 1250 AND maxx > 250 AND miny < 1700 AND maxy > 125"""))
def clip_to_box(spark, sf):
    c = S.clip_to_box(V.parcels(spark, sf), (250, 125, 1250, 1700))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return c.select("id", "covered", F.round(area, 6).alias("area"))


# --- distances between shapes of any kind ----------------------------------------------------------

V.CTE["shape_segments"] = """
SELECT 'L' || id AS rid, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM /*lines*/ lines UNION ALL SELECT 'L' || id, x2, y2, x3, y3 FROM lines
UNION ALL SELECT 'P' || id, e.ax, e.ay, e.bx, e.by_ FROM (SELECT id, unnest([
  {ax: x, ay: y, bx: x+s, by_: y}, {ax: x+s, ay: y, bx: x+s, by_: y+s/2}, {ax: x+s, ay: y+s/2, bx: x+s/2, by_: y+s/2}, {ax: x+s/2, ay: y+s/2, bx: x+s/2, by_: y+s},
  {ax: x+s/2, ay: y+s, bx: x, by_: y+s}, {ax: x, ay: y+s, bx: x, by_: y}, {ax: x+s/8, ay: y+s/8, bx: x+s/4, by_: y+s/8}, {ax: x+s/4, ay: y+s/8, bx: x+s/4, by_: y+s/4},
  {ax: x+s/4, ay: y+s/4, bx: x+s/8, by_: y+s/4}, {ax: x+s/8, ay: y+s/4, bx: x+s/8, by_: y+s/8}]) AS e FROM /*plots*/ plots)"""
V.CTE["sites"] = """
SELECT s_suppkey AS lid, (((s_suppkey*7919) % 20000)/10.0)::DOUBLE AS px, (((s_suppkey*104729) % 20000)/10.0)::DOUBLE AS py FROM supplier"""
IN_PLOT = """px >= x AND py >= y AND ((px <= x+s AND py <= y+s/2) OR (px <= x+s/2 AND py <= y+s))
 AND NOT (px > x+s/8 AND px < x+s/4 AND py > y+s/8 AND py < y+s/4)"""
V.CTE["site_distances"] = f"""
SELECT lid, rid, min(d) AS d FROM (
 SELECT lid, rid, sqrt((fx-px)*(fx-px)+(fy-py)*(fy-py)) AS d FROM (SELECT lid, rid, px, py, ax + t*(bx-ax) AS fx, ay + t*(by_-ay) AS fy FROM (
  SELECT *, coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/nullif((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay), 0))), 0.0::DOUBLE) AS t
  FROM /*sites*/ sites CROSS JOIN /*shape_segments*/ shape_segments))
 UNION ALL SELECT lid, 'P' || id, 0.0::DOUBLE FROM sites JOIN /*plots*/ plots ON {IN_PLOT}) GROUP BY lid, rid"""


def _shapes(spark, sf):
    """Bent lines and L-shaped plots with a hole."""
    lines = V.line_geoms(spark, sf).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("rid"), F.col("geom").alias("rgeom"))
    return lines.unionByName(V.plots(spark, sf).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("rid"), F.col("geom").alias("rgeom")))


def _sites(spark, sf):
    k = F.col("s_suppkey")
    return load(spark, sf, "supplier").select(k.alias("lid"), G.point(((k * 7919) % 20000) / 10.0, ((k * 104729) % 20000) / 10.0).alias("lgeom"))


@query("nearest_shapes", with_sql("site_distances", body="""
SELECT lid, rid, rank, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d, rid)::INT AS rank FROM site_distances) WHERE rank <= 4"""))
def nearest_shapes(spark, sf):
    return N.nearest(_sites(spark, sf), _shapes(spark, sf), 4).select("lid", "rid", "rank", F.round("distance", 6).alias("distance"))


@query("radius_shapes", with_sql("site_distances", body="SELECT lid, rid, round(d, 6) AS distance FROM site_distances WHERE d <= 12.5"))
def radius_shapes(spark, sf):
    return N.within_distance(_sites(spark, sf), _shapes(spark, sf), 12.5).select("lid", "rid", F.round("distance", 6).alias("distance"))


@query("containing_shapes", with_sql("plots", body=f"""
SELECT p.lid, plots.id AS rid FROM (SELECT id AS lid, x + s*CASE WHEN id % 2 = 0 THEN 0.1875 ELSE 0.0625 END::DOUBLE AS px, y + s*CASE WHEN id % 2 = 0 THEN 0.1875 ELSE 0.0625 END::DOUBLE AS py FROM plots) p
JOIN plots ON {IN_PLOT}"""))
def containing_shapes(spark, sf):
    """A radius of zero: the plots around a point, which stands in its own plot's hole or beside it."""
    p = V.plots(spark, sf)
    at = F.col("s") * F.when(F.col("id") % 2 == 0, 0.1875).otherwise(0.0625)
    probes = p.select(F.col("id").alias("lid"), G.point(F.col("minx") + at, F.col("miny") + at).alias("lgeom"))
    return N.within_distance(probes, p.select(F.col("id").alias("rid"), F.col("geom").alias("rgeom")), 0.0).select("lid", "rid")


SNAP_TARGETS = """
targets AS (
 SELECT id AS fid, 0 AS rank, 0 AS pos, x1 AS x, y1 AS y FROM lines UNION ALL SELECT id, 0, 1, x3, y3 FROM lines
 UNION ALL SELECT id, 1, 0, x1, y1 FROM lines UNION ALL SELECT id, 1, 1, x2, y2 FROM lines UNION ALL SELECT id, 1, 2, x3, y3 FROM lines
 UNION ALL SELECT id, 2, 0, (x1+x2)/2, (y1+y2)/2 FROM lines UNION ALL SELECT id, 2, 1, (x2+x3)/2, (y2+y3)/2 FROM lines),
probes AS (SELECT zone AS pid, minx*1.5 AS px, floor(miny*2.5/10)*10 + 0.25 AS py FROM zones),
foot AS (SELECT pid, fid, min(struct_pack(d := d, x := fx, y := fy)) AS n FROM (
  SELECT pid, fid, sqrt((fx-px)*(fx-px)+(fy-py)*(fy-py)) AS d, fx, fy FROM (
   SELECT pid, px, py, fid, ax + t*(bx-ax) AS fx, ay + t*(by_-ay) AS fy FROM (
    SELECT pid, px, py, fid, ax, ay, bx, by_, greatest(0.0, least(1.0, ((px-ax)*(bx-ax)+(py-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) AS t
    FROM probes JOIN (SELECT id AS fid, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM lines UNION ALL SELECT id, x2, y2, x3, y3 FROM lines) s
     ON px + 4.0 >= least(ax,bx) AND px - 4.0 <= greatest(ax,bx) AND py + 4.0 >= least(ay,by_) AND py - 4.0 <= greatest(ay,by_)))) GROUP BY pid, fid),
cand AS (SELECT pid, d, fid, rank, pos, x, y FROM (SELECT pid, sqrt((px-x)*(px-x)+(py-y)*(py-y)) AS d, fid, rank, pos, x, y FROM probes JOIN targets
   ON abs(px-x) <= 4.0 AND abs(py-y) <= 4.0) WHERE d <= 4.0
 UNION ALL SELECT pid, n.d, fid, 3, 0, n.x, n.y FROM foot WHERE n.d > 0 AND n.d <= 4.0)
SELECT pid, ['endpoint','vertex','midpoint','edge'][rank+1] AS mode, round(x, 6) AS x, round(y, 6) AS y, round(d, 6) AS distance, fid
FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, fid, rank, pos) AS rn FROM cand) WHERE rn = 1"""


@query("snap_points", with_sql("lines", "zones", body="X").replace(" X", ", " + SNAP_TARGETS.strip()))
def snap_points(spark, sf):
    probes = _zones(spark, sf).select(
        F.col("zone").alias("pid"), (F.col("minx") * 1.5).alias("px"),
        (F.floor(F.col("miny") * 2.5 / 10) * 10 + 0.25).alias("py"))
    feats = V.line_geoms(spark, sf).select(F.col("id").alias("fid"), "geom")
    s = S.snap_join(probes, feats, 4.0, size=10.0)
    return s.select("pid", "mode", *[F.round(c, 6).alias(c) for c in ("x", "y", "distance")], "fid")
