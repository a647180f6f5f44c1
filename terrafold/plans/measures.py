"""Queries over geometry measures, vertex operators, extents and planar measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geodesy as D
from ..functions import geometry as G
from ..operators import geometry as OG
from . import derive as V
from .derive import with_sql
from .registry import query

R = lambda c, n=6: F.round(c, n)


@query("measure_area_length", with_sql("plots", body="""
SELECT id, round(s*s*3/4 - s*s/64, 6) AS area, round(4*s + s/2, 6) AS perimeter FROM plots"""))
def area_length(spark, sf):
    return V.plots(spark, sf).select(
        "id", R(G.st_area("geom")).alias("area"), R(G.st_length("geom")).alias("perimeter")
    )


HAV = ("2*6371008.8*asin(least(1.0, sqrt(pow(sin((radians({b2})-radians({b1}))/2),2)"
       "+cos(radians({b1}))*cos(radians({b2}))*pow(sin(radians({a2}-({a1}))/2),2))))")


@query("geodesic_distance", with_sql("points", body=f"""
SELECT id, round({HAV.format(a1='lon', b1='lat', a2='-0.1278', b2='51.5074')}, 3) AS metres FROM points"""))
def geodesic_distance(spark, sf):
    return V.points(spark, sf).select(
        "id", R(D.geodesic_distance("lon", "lat", F.lit(-0.1278), F.lit(51.5074)), 3).alias("metres")
    )


GEO_BOX = "SELECT id, lon, lat, lon + 0.5 AS lon2, lat + 0.25 AS lat2 FROM points"


def _geo_boxes(spark, sf):
    return V.points(spark, sf).select(
        "id", G.rect("lon", "lat", F.col("lon") + 0.5, F.col("lat") + 0.25).alias("geom")
    )


@query("geodesic_length", with_sql("points", body=f"""
SELECT id, round({HAV.format(a1='lon', b1='lat', a2='lon2', b2='lat')} + {HAV.format(a1='lon2', b1='lat', a2='lon2', b2='lat2')}
 + {HAV.format(a1='lon2', b1='lat2', a2='lon', b2='lat2')} + {HAV.format(a1='lon', b1='lat2', a2='lon', b2='lat')}, 3) AS metres
FROM ({GEO_BOX})"""))
def geodesic_length(spark, sf):
    return _geo_boxes(spark, sf).select("id", R(D.geodesic_length("geom"), 3).alias("metres"))


GEO_AREA = ("abs((radians(lon2)-radians(lon))*(2+2*sin(radians(lat)))"
            " + (radians(lon)-radians(lon2))*(2+2*sin(radians(lat2))))*6371008.8*6371008.8/2")


@query("geodesic_area", with_sql("points", body=f"""
SELECT id, round({GEO_AREA}/1e6, 3) AS km2 FROM ({GEO_BOX})"""))
def geodesic_area(spark, sf):
    return _geo_boxes(spark, sf).select("id", R(D.geodesic_area("geom") / 1e6, 3).alias("km2"))


@query("crs_aware_measure", with_sql("points", body=f"""
SELECT id, CASE WHEN src='C' THEN round({GEO_AREA}/1e6, 3) ELSE round(0.125/1e6, 3) END AS value_m,
 CASE WHEN src='C' THEN 'square metre' ELSE 'square US survey foot' END AS unit, src='C' AS is_geodetic
FROM (SELECT id, src, lon, lat, lon + 0.5 AS lon2, lat + 0.25 AS lat2 FROM points)"""))
def crs_aware_measure(spark, sf):
    wkt = F.when(F.col("src") == "S", F.lit('PROJCS["x",UNIT["US survey foot",0.3048006096]]')).otherwise(
        F.lit('GEOGCS["WGS 84"]'))
    d = V.points(spark, sf).select(
        "id", "src", G.rect("lon", "lat", F.col("lon") + 0.5, F.col("lat") + 0.25).alias("geom"), wkt.alias("wkt")
    )
    m = D.measure("geom", "area", F.col("src") == "C", D.unit_name("wkt"))
    return d.withColumn("m", m).select(
        "id", R(F.col("m.value") / 1e6, 3).alias("value_m"), F.col("m.unit").alias("unit"),
        F.col("m.is_geodetic").alias("is_geodetic"),
    )


@query("centroid_and_box", with_sql("plots", body="""
SELECT id, round(x + (s*s/2*s/2 + s*s/4*s/4 - s*s/64*s*3/16)/(s*s*3/4 - s*s/64), 6) AS cx,
 round(y + (s*s/2*s/4 + s*s/4*s*3/4 - s*s/64*s*3/16)/(s*s*3/4 - s*s/64), 6) AS cy,
 x AS minx, y AS miny, x + s AS maxx, y + s AS maxy FROM plots"""))
def centroid_and_box(spark, sf):
    d = V.plots(spark, sf).select("id", "geom", G.st_centroid("geom").alias("c"))
    return G.with_envelope(d).select("id", R("c.x").alias("cx"), R("c.y").alias("cy"), "minx", "miny", "maxx", "maxy")


@query("orient_rings", with_sql("plots", body="""
SELECT id, id % 2 <> 0 AS shell_was_ccw, round(s*s*3/4, 6) AS shell_signed, round(-s*s/64, 6) AS hole_signed FROM plots"""))
def orient_rings(spark, sf):
    d = V.plots(spark, sf).withColumn("o", G.orient_rings("geom", "CounterClockwise"))
    ring = lambda g, i: F.get(G.rings(g), F.lit(i))
    return d.select(
        "id", (G.ring_signed_area(ring("geom", 0)) > 0).alias("shell_was_ccw"),
        R(G.ring_signed_area(ring("o", 0))).alias("shell_signed"),
        R(G.ring_signed_area(ring("o", 1))).alias("hole_signed"),
    )


@query("map_geometry", with_sql("lines", body="""
SELECT id, CASE WHEN id % 3 = 0 THEN 'MultiPolygon' ELSE 'MultiLineString' END AS kind,
 CASE WHEN id % 3 = 0 THEN 'Polygon' ELSE 'Line' END AS feature_kind,
 CASE WHEN id % 3 = 0 THEN 4 ELSE 3 END AS n_vertices FROM lines"""))
def map_geometry(spark, sf):
    path = F.array(G.vertex("x1", "y1"), G.vertex("x2", F.col("y2") + 7), G.vertex("x3", "y3"))
    closed = F.when(F.col("id") % 3 == 0, F.concat(path, F.slice(path, 1, 1))).otherwise(path)
    d = V.lines(spark, sf).select("id", G.line(closed).alias("geom"))
    d = d.withColumn("geom", G.map_geometry("geom", True, "Clockwise", True))
    return d.select(
        "id", F.col("geom.kind").alias("kind"), G.geometry_kind("geom").alias("feature_kind"),
        F.size(G.vertices("geom")).alias("n_vertices"),
    )


@query("explode_collections", with_sql("lines", body="""
SELECT id, 0 AS member, 'Point' AS kind FROM lines UNION ALL SELECT id, 1, 'LineString' FROM lines"""))
def explode_collections(spark, sf):
    member = F.array(F.array(F.array(G.vertex("x1", "y1"))),
                     F.array(F.array(G.vertex("x1", "y1"), G.vertex("x3", "y3"))))
    g = G.make_geom(G.COLLECTION, member, F.array(F.lit("Point"), F.lit("LineString")))
    d = V.lines(spark, sf).select("id", g.alias("geom"))
    return G.explode_parts(d).select("id", "member", F.col("geom.kind").alias("kind"))


@query("segments", with_sql("lines", body="""
SELECT id, 0 AS pos, round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)), 6) AS length FROM lines
UNION ALL SELECT id, 1, round(sqrt((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)), 6) FROM lines"""))
def segments(spark, sf):
    s = G.segment_table(V.line_geoms(spark, sf), ["id"])
    d = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return s.select("id", "pos", R(d).alias("length"))


@query("dedupe_vertices", with_sql("lines", body="""
SELECT id, CASE WHEN id % 4 = 0 THEN 2 ELSE 3 END AS kept, CASE WHEN id % 4 = 0 THEN x1 ELSE x2 END AS second_x FROM (
 SELECT id, x1, CASE WHEN id % 4 = 0 THEN x3 ELSE x1 + 1.5 END AS x2, x3 FROM (
  SELECT id, 0.0::DOUBLE AS x0, x3 AS x1, x3, x1 AS a FROM lines))""".replace("SELECT id, x1, CASE", "SELECT id, a AS x1, CASE")
 .replace("CASE WHEN id % 4 = 0 THEN x1 ELSE x2 END AS second_x", "CASE WHEN id % 4 = 0 THEN x3 ELSE x1 + 1.5 END AS second_x")))
def dedupe_vertices(spark, sf):
    x = F.col("x1")
    step = F.when(F.col("id") % 4 == 0, 0.0).otherwise(1.5)
    path = F.array(
        G.vertex(x, "y1"), G.vertex(x + 0.4, "y1"), G.vertex(x + 0.8 * F.signum(step), "y1"),
        G.vertex(x + step, "y1"), G.vertex("x3", F.col("y3") + 50),
    )
    d = V.lines(spark, sf).select("id", "x1", G.line(path).alias("geom"))
    v = G.vertices(G.dedupe_vertices("geom", 1.0))
    return d.select("id", F.size(v).alias("kept"), F.get(v, F.lit(1))["x"].alias("second_x"))


@query("snap_to_grid", with_sql("parcels", body="""
SELECT id, floor(minx/3 + 0.5)*3 AS minx, floor(miny/3 + 0.5)*3 AS miny, floor(maxx/3 + 0.5)*3 AS maxx, floor(maxy/3 + 0.5)*3 AS maxy,
 CASE WHEN floor(minx/3 + 0.5) = floor(maxx/3 + 0.5) OR floor(miny/3 + 0.5) = floor(maxy/3 + 0.5) THEN 'collapsed' ELSE 'ok' END AS status,
FROM parcels""".replace("AS status,\nFROM", "AS status FROM")
    .replace("SELECT id, floor(minx/3 + 0.5)*3 AS minx, floor(miny/3 + 0.5)*3 AS miny, floor(maxx/3 + 0.5)*3 AS maxx, floor(maxy/3 + 0.5)*3 AS maxy,",
             "SELECT id, CASE WHEN floor(minx/3+0.5) < floor(maxx/3+0.5) AND floor(miny/3+0.5) < floor(maxy/3+0.5) THEN "
             "(floor(maxx/3+0.5)-floor(minx/3+0.5))*(floor(maxy/3+0.5)-floor(miny/3+0.5))*9 END AS area,")))
def snap_to_grid(spark, sf):
    d = V.parcel_geoms(spark, sf).select("id", G.snap_to_grid("geom", 3.0).alias("g"))
    return d.select(
        "id", R(F.when(F.col("g").isNotNull(), G.st_area("g"))).alias("area"),
        F.when(F.col("g").isNull(), "collapsed").otherwise("ok").alias("status"),
    )


@query("reduce_precision", with_sql("points", body="""
SELECT id, floor(lon*1.7*10 + 0.5)/10 AS x, floor(lat*1.3*10 + 0.5)/10 AS y FROM points"""))
def reduce_precision(spark, sf):
    d = V.points(spark, sf).select("id", G.point(F.col("lon") * 1.7, F.col("lat") * 1.3).alias("geom"))
    # Same grid as scale 10, stated through the shared vertex expression.
    v = F.get(G.vertices(G.snap_to_grid("geom", 0.1)), F.lit(0))
    return d.select("id", v["x"].alias("x"), v["y"].alias("y"))


@query("stride_decimation", with_sql("parcels", body="""
SELECT id, least(3 + id % 30, 12) + 1 AS n, round(cos(2*pi()*floor(least(3 + id % 30, 12) - 1) * (CASE WHEN 3 + id % 30 <= 12 THEN 1 ELSE 0 END) / (3 + id % 30)
 + CASE WHEN 3 + id % 30 > 12 THEN 2*pi()*floor(11*(3 + id % 30)/12.0::DOUBLE)/(3 + id % 30) ELSE 0 END), 6) AS last_x FROM parcels"""))
def stride_decimation(spark, sf):
    n = (F.lit(3) + F.col("id") % 30).cast("int")
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: G.vertex(
        F.cos(i * 2 * 3.141592653589793 / n), F.sin(i * 2 * 3.141592653589793 / n)))
    ring = F.concat(ring, F.slice(ring, 1, 1))
    d = V.parcels(spark, sf).select("id", ring.alias("ring"))
    d = d.select("id", G.stride_decimate(F.col("ring"), 12).alias("r"))
    return d.select("id", F.size("r").cast("long").alias("n"), R(F.element_at("r", -2)["x"]).alias("last_x"))


@query("extent_by_key", with_sql("parcels", body="""
SELECT o_orderpriority AS layer, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS n
FROM parcels GROUP BY 1"""))
def extent_by_key(spark, sf):
    d = V.parcels(spark, sf).withColumnRenamed("o_orderpriority", "layer")
    return OG.extent_agg(d, ["layer"])


@query("extent_helpers", with_sql("parcels", body="""
SELECT id, (minx+maxx)/2 AS cx, (miny+maxy)/2 AS cy, maxx-minx AS width, minx-2.5 AS ex,
 500.0 BETWEEN minx AND maxx AND 700.0 BETWEEN miny AND maxy AS holds, (minx <= 900 AND maxx >= 100 AND miny <= 800 AND maxy >= 200) AS hits,
 round(greatest(maxx-minx, maxy-miny)/least(maxx-minx, maxy-miny), 6) AS aspect FROM parcels"""))
def extent_helpers(spark, sf):
    box = ("minx", "miny", "maxx", "maxy")
    c = F.col
    q = tuple(F.lit(v) for v in (100.0, 200.0, 900.0, 800.0))
    return V.parcels(spark, sf).select(
        "id", ((c("minx") + c("maxx")) / 2).alias("cx"), ((c("miny") + c("maxy")) / 2).alias("cy"),
        (c("maxx") - c("minx")).alias("width"), G.extent_expand(*box, 2.5)[0].alias("ex"),
        G.extent_contains(box, F.lit(500.0), F.lit(700.0)).alias("holds"),
        G.extent_intersects(box, q).alias("hits"), R(G.extent_aspect(*box)).alias("aspect"),
    )


@query("bearing_and_path", with_sql("lines", body="""
SELECT id, round(CASE WHEN degrees(atan2(x3-x1, y3-y1)) < 0 THEN degrees(atan2(x3-x1, y3-y1)) + 360 ELSE degrees(atan2(x3-x1, y3-y1)) END, 6) AS bearing,
 round(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) + sqrt((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)), 6) AS length,
 round(abs((x2-x1)*(y3-y1)-(x3-x1)*(y2-y1))/2, 6) AS area,
 printf('X: %.3f, Y: %.3f', x1, y1) AS at FROM lines"""))
def bearing_and_path(spark, sf):
    path = F.array(G.vertex("x1", "y1"), G.vertex("x2", "y2"), G.vertex("x3", "y3"))
    return V.lines(spark, sf).select(
        "id", R(G.bearing("x1", "y1", "x3", "y3")).alias("bearing"), R(G.path_length(path)).alias("length"),
        R(G.path_area(path)).alias("area"), G.fmt_coordinate("x1", "y1").alias("at"),
    )


@query("merge_to_multi", with_sql("elements", body="""
SELECT layer, CASE WHEN count(DISTINCT geometry_kind) > 1 THEN 'GeometryCollection' WHEN min(geometry_kind) = 'Point' THEN 'MultiPoint'
 WHEN min(geometry_kind) = 'Line' THEN 'MultiLineString' ELSE 'MultiPolygon' END AS kind, count(*) AS n_parts,
 sum(CASE geometry_kind WHEN 'Point' THEN 1 WHEN 'Line' THEN 2 ELSE 5 END)::BIGINT AS n_vertices
FROM (SELECT layer || '-' || (CASE WHEN element_id % 2 = 0 THEN 'all' ELSE geometry_kind END) AS layer, geometry_kind FROM elements) GROUP BY 1"""))
def merge_to_multi(spark, sf):
    e = V.elements(spark, sf)
    x = F.col("element_id").cast("double")
    geom = (
        F.when(F.col("geometry_kind") == "Point", G.point(x, x))
        .when(F.col("geometry_kind") == "Line", G.line(F.array(G.vertex(x, x), G.vertex(x + 1, x))))
        .otherwise(G.rect(x, x, x + 1, x + 1))
    )
    tag = F.when(F.col("element_id") % 2 == 0, "all").otherwise(F.col("geometry_kind"))
    d = e.select(F.concat_ws("-", "layer", tag).alias("layer"), "element_id", geom.alias("geom"))
    m = OG.merge_geom(d, ["layer"], order="element_id")
    return m.select(
        "layer", F.col("geom.kind").alias("kind"), F.size("geom.parts").cast("long").alias("n_parts"),
        F.size(G.vertices("geom")).cast("long").alias("n_vertices"),
    )
