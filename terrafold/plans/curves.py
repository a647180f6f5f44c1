"""Queries over curves, ring assembly, axis ordering, hulls and footprints."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import geometry as G
from ..operators import shapes as H
from . import derive as V
from .derive import with_sql
from .registry import load, query


def curve_rows(spark, sf):
    k = F.col("p_partkey")
    return load(spark, sf, "part").select(
        k.alias("curve_id"), F.when(k % 3 == 0, "circle").when(k % 3 == 1, "arc").otherwise("ellipse").alias("kind"),
        (k % 100).cast("double").alias("cx"), (k % 77).cast("double").alias("cy"), F.when(k % 40 == 0, 0.0).otherwise(F.col("p_size") / 2.0).alias("radius"),
        (F.col("p_size") / 5.0).alias("minor"), F.lit(0.0).alias("rotation"), ((k % 12) * math.pi / 6).alias("start"), (((k + 5) % 12) * math.pi / 6).alias("end"),
        F.lit(None).cast("double").alias("elevation"))


V.CTE["curve_n"] = """SELECT *, CASE WHEN r <= 0 THEN 0 ELSE greatest(4, least(512, ceil(sweep / (CASE WHEN 0.01/r >= 1 THEN pi() ELSE 2*acos(1 - 0.01/r) END))))::BIGINT END AS n FROM (
 SELECT p_partkey AS id, p_partkey % 3 AS kind, (p_partkey % 100)::DOUBLE AS cx, (p_partkey % 77)::DOUBLE AS cy, CASE WHEN p_partkey % 40 = 0 THEN 0.0::DOUBLE ELSE p_size/2.0::DOUBLE END AS r,
  p_size/5.0::DOUBLE AS minor, (p_partkey % 12)*pi()/6 AS a0, CASE WHEN p_partkey % 3 = 0 THEN 2*pi() ELSE 5*pi()/6 END AS sweep FROM part)"""


@query("curve_densification", with_sql("curve_n", body="""
SELECT id AS curve_id, k AS pos, round(CASE WHEN n = 0 THEN cx ELSE cx + r*cos(CASE WHEN kind = 0 THEN sweep*(k % n)/n ELSE a0 + sweep*k/n END) END, 5) AS x,
 round(CASE WHEN n = 0 THEN cy ELSE cy + (CASE WHEN kind = 2 THEN minor ELSE r END)*sin(CASE WHEN kind = 0 THEN sweep*(k % n)/n ELSE a0 + sweep*k/n END) END, 5) AS y
FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM curve_n)"""))
def curve_densification(spark, sf):
    d = H.densify_curves(curve_rows(spark, sf), 0.01)
    return d.select("curve_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 5) + 0.0).alias("x"), (F.round("y", 5) + 0.0).alias("y"))


@query("bulge_polylines", with_sql("parcels", body="""
SELECT id, CASE WHEN id % 2 = 0 THEN 5 ELSE 4 + ceil(pi()/(2*acos(1 - 0.01/((maxx-minx)/2))))::BIGINT END AS n,
 round(CASE WHEN id % 2 = 0 THEN 4*(maxx-minx) ELSE 3*(maxx-minx) + pi()*(maxx-minx)/2 END, 0) AS length FROM parcels"""))
def bulge_polylines(spark, sf):
    v = lambda x, y, b: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), b.cast("double").alias("bulge"))
    z = F.lit(0.0)
    ring = F.array(v("minx", "miny", z), v("maxx", "miny", F.when(F.col("id") % 2 == 0, 0.0).otherwise(1.0)), v("maxx", "maxy", z), v("minx", "maxy", z))
    d = V.parcels(spark, sf).select("id", C.polyline_path(ring, F.lit(True), 0.01).alias("p"))
    return d.select("id", F.size("p").cast("long").alias("n"), F.round(G.ring_length(F.col("p")), 0).alias("length"))


@query("survey_arcs", with_sql("parcels", body="""
SELECT id, CASE WHEN id % 2 = 0 THEN 19 ELSE 55 END AS n, round(CASE WHEN id % 2 = 0 THEN s*36*sin(pi()/72) ELSE s*108*sin(pi()/72) END, 4) AS length
FROM (SELECT id, maxx - minx AS s FROM parcels)"""))
def survey_arcs(spark, sf):
    # A quarter turn one way and three quarters the other, about the parcel's corner.
    s = F.col("maxx") - F.col("minx")
    start, centre, end = G.vertex(F.col("minx") + s, "miny"), G.vertex("minx", "miny"), G.vertex("minx", F.col("miny") + s)
    d = V.parcels(spark, sf).select("id", start.alias("a"), centre.alias("c"), end.alias("b"), (F.col("id") % 2 == 1).alias("cw"))
    d = d.select("id", C.survey_arc("a", "c", "b", "cw").alias("p"))
    return d.select("id", F.size("p").cast("long").alias("n"), F.round(G.ring_length(F.col("p")), 4).alias("length"))


def nested_rings(spark, sf):
    """Squares of each order nested up to five deep, some of them degenerate, plus an island beside them."""
    o = load(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    x, y = ((k * 7919) % 20000) / 10.0, ((k * 104729) % 20000) / 10.0
    d = o.select(k.alias("key"), x.alias("x"), y.alias("y"), F.explode(F.sequence(F.lit(0), (k % 5).cast("int"))).alias("ring_id"))
    i = F.col("ring_id").cast("double")
    sq = lambda a, b, c, e: G.rect_ring(a, b, c, e)
    ring = F.when((F.col("ring_id") == 4), sq(F.col("x") + 20, F.col("y"), F.col("x") + 22, F.col("y") + 2)).otherwise(
        sq(F.col("x") + i, F.col("y") + i, F.col("x") + 10 - i, F.col("y") + 10 - i))
    ring = F.when((F.col("key") % 7 == 0) & (F.col("ring_id") == 1), F.array(G.vertex("x", "y"), G.vertex(F.col("x") + 1, "y"), G.vertex("x", "y"))).otherwise(ring)
    return d.select("key", "ring_id", ring.alias("ring"))


@query("ring_assembly", """
SELECT o_orderkey AS key, CASE WHEN r >= 4 THEN 'MultiPolygon' WHEN bad AND r >= 3 THEN 'MultiPolygon' WHEN NOT bad AND r >= 2 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
 round(100.0::DOUBLE + CASE WHEN bad THEN -CASE WHEN r >= 2 THEN 36 ELSE 0 END + CASE WHEN r >= 3 THEN 16 ELSE 0 END
  ELSE -CASE WHEN r >= 1 THEN 64 ELSE 0 END + CASE WHEN r >= 2 THEN 36 ELSE 0 END - CASE WHEN r >= 3 THEN 16 ELSE 0 END END + CASE WHEN r >= 4 THEN 4 ELSE 0 END, 6) AS area
FROM (SELECT o_orderkey, o_orderkey % 5 AS r, o_orderkey % 7 = 0 AS bad FROM orders)""")
def ring_assembly(spark, sf):
    a = H.assemble_polygons(nested_rings(spark, sf), 40.0)
    return a.select("key", F.col("geom.kind").alias("kind"), F.round(G.st_area("geom"), 6).alias("area"))


@query("principal_axis_order", """
WITH p AS (SELECT c_nationkey AS key, c_custkey AS pid, c_acctbal AS x, (c_custkey % 100)*20.0::DOUBLE + c_acctbal/3 AS y FROM customer),
c AS (SELECT key, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1),
a AS (SELECT key, atan2(2*sum((x-cx)*(y-cy)), sum((x-cx)*(x-cx)) - sum((y-cy)*(y-cy)))/2 AS angle FROM p JOIN c USING (key) GROUP BY 1)
SELECT key, pid, row_number() OVER (PARTITION BY key ORDER BY (x-cx)*cos(angle) + (y-cy)*sin(angle), (y-cy)*cos(angle) - (x-cx)*sin(angle), pid) AS rank
FROM p JOIN c USING (key) JOIN a USING (key)""")
def principal_axis_order(spark, sf):
    p = load(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("pid"), F.col("c_acctbal").alias("x"),
                                           ((F.col("c_custkey") % 100) * 20.0 + F.col("c_acctbal") / 3).alias("y"))
    return H.order_along_axis(p, "key", "pid", block=16).select("key", "pid", "rank")


def outline_vertices(spark, sf):
    """Outlines of three kinds by order: a square, a straight run, one repeated place."""
    k = F.col("o_orderkey")
    o = load(spark, sf, "orders").select(k.alias("key"), F.posexplode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 4), (4, 4), (4, 0))])).alias("pos", "c"))
    kind = F.col("key") % 4
    tie = kind == 1
    x = F.when(kind == 3, F.lit(0.0)).when(kind == 2, F.col("pos") * 1.0).when(tie, F.when(F.col("pos").isin(1, 2), 4.0).otherwise(0.0)).otherwise(F.col("c.a") * 1.0)
    y = F.when(kind == 3, F.lit(0.0)).when(kind == 2, F.col("pos") * 2.0).when(tie, (F.col("pos") % 2) * 4.0).otherwise(F.col("c.b") * 1.0)
    return o.select("key", "pos", (x + F.col("key")).alias("x"), y.cast("double").alias("y"))


@query("footprints", """
SELECT o_orderkey AS key, ['outline','hull','line','point'][o_orderkey % 4 + 1] AS source, [16.0::DOUBLE, 16.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE][o_orderkey % 4 + 1] AS area,
 [16.0::DOUBLE, 16.0::DOUBLE, round(3*sqrt(5.0::DOUBLE), 6), 0.0::DOUBLE][o_orderkey % 4 + 1] AS length FROM orders""")
def footprints(spark, sf):
    f = H.footprints(outline_vertices(spark, sf), "key")
    return f.select("key", "source", F.round(G.st_area("geom"), 6).alias("area"), F.round(G.st_length("geom"), 6).alias("length"))


@query("convex_hulls", with_sql("plots", body="SELECT id, round(s*s*7/8, 6) AS area, round(3*s + sqrt(s*s/2), 6) AS perimeter FROM plots"))
def convex_hulls(spark, sf):
    h = H.convex_hull(V.plots(spark, sf))
    return h.select("id", F.round(G.st_area("hull"), 6).alias("area"), F.round(G.st_length("hull"), 6).alias("perimeter"))


@query("hull_by_key")
def hull_by_key(spark, sf):
    p = V.parcels(spark, sf).select(F.col("o_orderpriority").alias("layer"), F.col("minx").alias("x"), F.col("miny").alias("y"))
    return H.hull_agg(p, "layer").select("layer", F.round(G.st_area("geom"), 4).alias("area"), F.size(G.vertices("geom")).cast("long").alias("corners"))
