"""Queries over output rows, report rows, text parsing of survey and bridge inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import geometry as G
from ..operators import quality as Q
from ..operators.common import checkpoint_dir
from ..sinks import formats as K
from ..sinks import report as R
from ..sources import bridge, landxml
from ..sources import points as P
from . import derive as V
from .derive import with_sql
from .quality import FAULTS, event_findings, faulty_features
from .registry import load, query

ks = lambda c: c.cast("string")
# A number as the outputs state it: no trailing ``.0``.
N = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
n = N.format


def shapes(spark, sf):
    k = F.col("id")
    g = F.when(k % 4 == 0, G.point("minx", "miny")).when(k % 4 == 1, G.line(F.array(G.vertex("minx", "miny", F.lit(5.0)), G.vertex("maxx", "maxy", F.lit(6.5))))) \
        .when(k % 4 == 2, G.rect(*("minx", "miny", "maxx", "maxy"))).otherwise(G.empty_geom(G.POLYGON))
    return V.parcels(spark, sf).select(
        k.alias("feature_id"), g.alias("geom"), F.concat(F.lit('PLOT "'), ks(k), F.lit('", <é>')).alias("plot"), k.alias("num"),
        F.when(k % 3 != 0, F.col("minx")).alias("x"), F.when(k % 5 != 0, k % 2 == 0).alias("active"), "o_orderpriority")


RING = f"'['||{n('minx')}||','||{n('miny')}||'],['||{n('maxx')}||','||{n('miny')}||'],['||{n('maxx')}||','||{n('maxy')}||'],['||{n('minx')}||','||{n('maxy')}||'],['||{n('minx')}||','||{n('miny')}||']'"


@query("geojson_features", with_sql("parcels", body=f"""
SELECT '{{"type":"Feature","id":"' || id || '","properties":{{"plot":"PLOT \\"' || id || '\\", <é>","num":' || id || CASE WHEN id % 3 <> 0 THEN ',"x":' || {n('minx')} ELSE '' END
 || CASE WHEN id % 5 <> 0 THEN ',"active":' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END ELSE '' END || '}},"geometry":' ||
 CASE id % 4 WHEN 0 THEN '{{"type":"Point","coordinates":[' || {n('minx')} || ',' || {n('miny')} || ']}}'
  WHEN 1 THEN '{{"type":"LineString","coordinates":[[' || {n('minx')} || ',' || {n('miny')} || ',5],[' || {n('maxx')} || ',' || {n('maxy')} || ',6.5]]}}'
  WHEN 2 THEN '{{"type":"Polygon","coordinates":[[' || {RING} || ']]}}' ELSE 'null' END || '}}' AS value FROM parcels"""))
def geojson_features(spark, sf):
    return K.geojson_rows(shapes(spark, sf), ["plot", "num", "x", "active"])


WKT_RING = RING.replace("'['||", "").replace("||','||", "||' '||").replace("||'],['||", "||', '||").replace("||']'", "")


@query("csv_with_wkt", with_sql("parcels", body=f"""
SELECT CAST(id AS VARCHAR) AS id, CASE id % 4 WHEN 0 THEN 'POINT (' || {n('minx')} || ' ' || {n('miny')} || ')' WHEN 1 THEN 'LINESTRING (' || {n('minx')} || ' ' || {n('miny')} || ', ' || {n('maxx')} || ' ' || {n('maxy')} || ')'
 WHEN 2 THEN 'POLYGON ((' || {WKT_RING} || '))' ELSE 'POLYGON EMPTY' END AS "WKT", CAST(id AS VARCHAR) AS num, CASE WHEN id % 3 <> 0 THEN {n('minx')} ELSE '' END AS x,
 CASE WHEN id % 5 = 0 THEN '' WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS active FROM parcels"""))
def csv_with_wkt(spark, sf):
    return K.csv_rows(shapes(spark, sf), ["num", "x", "active"])


@query("wkt_lines", with_sql("parcels", body=f"""
SELECT CASE id % 4 WHEN 0 THEN 'POINT (' || {n('minx')} || ' ' || {n('miny')} || ')' WHEN 1 THEN 'LINESTRING (' || {n('minx')} || ' ' || {n('miny')} || ' 5, ' || {n('maxx')} || ' ' || {n('maxy')} || ' 6.5)'
 WHEN 2 THEN 'POLYGON ((' || {WKT_RING} || '))' ELSE 'POLYGON EMPTY' END AS value FROM parcels"""))
def wkt_lines(spark, sf):
    return K.wkt_rows(shapes(spark, sf))


@query("wkb_column", with_sql("parcels", body="""
SELECT id, CASE id % 4 WHEN 0 THEN 21 WHEN 1 THEN 57 WHEN 2 THEN 93 ELSE 9 END::BIGINT AS bytes, CASE id % 4 WHEN 0 THEN '0101000000' WHEN 1 THEN '01EA030000' ELSE '0103000000' END AS head FROM parcels"""))
def wkb_column(spark, sf):
    d = K.with_wkb(shapes(spark, sf))
    return d.select(F.col("feature_id").alias("id"), F.length("wkb").cast("long").alias("bytes"), F.substring(F.hex("wkb"), 1, 10).alias("head"))


@query("wkt_round_trip", with_sql("parcels", body="""
SELECT id, CASE id % 4 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' ELSE 'Polygon' END AS kind, true AS same FROM parcels"""))
def wkt_round_trip(spark, sf):
    d = shapes(spark, sf).withColumn("text", E.to_wkt("geom", z=True))
    d = d.withColumn("back", E.geom_from_wkt("text"))
    return d.select(F.col("feature_id").alias("id"), F.col("back.kind").alias("kind"), (E.to_wkt("back", z=True) == F.col("text")).alias("same"))


KML_RING = f"{n('minx')}||','||{n('miny')}||' '||{n('maxx')}||','||{n('miny')}||' '||{n('maxx')}||','||{n('maxy')}||' '||{n('minx')}||','||{n('maxy')}||' '||{n('minx')}||','||{n('miny')}"


@query("kml_placemarks", with_sql("parcels", body=f"""
SELECT '<Placemark id="' || id || '"><ExtendedData><Data name="plot"><value>PLOT &quot;' || id || '&quot;, &lt;é&gt;</value></Data><Data name="active"><value>' ||
 CASE WHEN id % 5 = 0 THEN '' WHEN id % 2 = 0 THEN 'true' ELSE 'false' END || '</value></Data></ExtendedData>' ||
 CASE id % 4 WHEN 0 THEN '<Point><coordinates>' || {n('minx')} || ',' || {n('miny')} || '</coordinates></Point>'
  WHEN 1 THEN '<LineString><coordinates>' || {n('minx')} || ',' || {n('miny')} || ',5 ' || {n('maxx')} || ',' || {n('maxy')} || ',6.5</coordinates></LineString>'
  WHEN 2 THEN '<Polygon><outerBoundaryIs><LinearRing><coordinates>' || {KML_RING} || '</coordinates></LinearRing></outerBoundaryIs></Polygon>' ELSE '' END || '</Placemark>' AS value FROM parcels"""))
def kml_placemarks(spark, sf):
    return K.kml_rows(shapes(spark, sf), ["plot", "active"])


@query("element_geojson", with_sql("elements", body="""
SELECT '{"type":"Feature","id":"' || element_id || '","properties":{"layer":"' || layer || '","geometryKind":"' || geometry_kind || '","nativeType":"' || native_type || '","text":"' || text || '","Color":"' || color
 || '","Layer":' || CASE WHEN element_id % 2 = 0 THEN 'null' ELSE '"' || layer || '"' END || '},"geometry":{"type":"Point","coordinates":[' || CASE WHEN element_id % 3 = 0 THEN (element_id // 3)::VARCHAR ELSE round(element_id/3.0::DOUBLE, 7)::VARCHAR END || ',0]}}' AS value FROM elements"""))
def element_geojson(spark, sf):
    e = V.elements(spark, sf)
    attrs = F.create_map(F.lit("Color"), F.try_element_at("attrs", F.lit("Color")), F.lit("Layer"), F.when(F.col("element_id") % 2 != 0, F.col("layer")))
    return K.elements_geojson_rows(e.withColumns({"attrs": attrs, "geom": G.point(F.col("element_id") / 3.0, F.lit(0.0))}))


# --- report rows ---------------------------------------------------------------------------------------

@query("report_csv", with_sql("findings", body="""
SELECT ['Information','Warning','Error','Critical'][severity + 1] AS severity, 'Topology' AS category, code, 'm' || pos AS message, dataset AS layer, CAST(pos AS VARCHAR) AS "featureId", '' AS field, '' AS x, '' AS y,
 '' AS remediation, '' AS "detectedUtc" FROM findings WHERE severity >= 2"""))
def report_csv(spark, sf):
    return R.csv_rows(event_findings(spark, sf), 2)


@query("report_json", with_sql("findings", body="""
SELECT '{"severity":"' || ['Information','Warning','Error','Critical'][severity + 1] || '","category":"Topology","code":"' || code || '","message":"m' || pos || '","layer":"' || dataset || '","featureId":"' || pos || '"}' AS value FROM findings"""))
def report_json(spark, sf):
    return R.json_rows(event_findings(spark, sf))


@query("report_json_summary", with_sql("findings", body="""
SELECT '{"total":' || count(*) || ',"highestSeverity":"Critical","acceptable":false,"information":' || count(*) FILTER (severity=0) || ',"warning":' || count(*) FILTER (severity=1) || ',"error":' || count(*) FILTER (severity=2)
 || ',"critical":' || count(*) FILTER (severity=3) || '}' AS value FROM findings"""))
def report_json_summary(spark, sf):
    return R.json_summary(event_findings(spark, sf))


@query("report_html", f"""
SELECT code AS section, '<tr><td class="sev ' || s || '">' || s || '</td><td>' || feature_id || '</td><td></td><td>' ||
 CASE WHEN code IN ('Geometry.Null', 'Geometry.Empty') OR code LIKE '%SelfIntersect%' THEN '' ELSE (feature_id * 13 % 1000) || ', ' || (feature_id * 17 % 1000) END || '</td><td>' || code || ' on feature ' || feature_id || '</td></tr>' AS value
FROM (SELECT *, ['Information','Warning','Error','Critical'][severity + 1] AS s FROM ({FAULTS}))""")
def report_html(spark, sf):
    return R.html_rows(Q.check_geometry(faulty_features(spark, sf)))


# --- text inputs ----------------------------------------------------------------------------------------------

def point_lines(spark, sf):
    """Survey files from customers: one per market segment, some lines blank or unreadable."""
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    semi = F.col("c_mktsegment") == "BUILDING"
    join = lambda *c: F.when(semi, F.concat_ws(";", *c)).otherwise(F.concat_ws(",", *c))
    body = F.when(k % 40 == 3, "   ").when(k % 40 == 7, join(F.lit("x"), ks(k), F.lit("1"), F.lit("n"))).otherwise(
        join(F.format_string(" %.1f ", k * 1.5), ks(k), F.when(k % 3 == 0, "").otherwise(F.lit("2.5")), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" L"), ks(k % 4))), F.col("c_name")))
    rows = c.select(F.col("c_mktsegment").alias("path"), (k + 2).alias("line_no"), body.alias("line"))
    head = c.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("path"), F.lit(1).cast("long").alias("line_no"), F.when(semi, "EAST;n; Elev ;Code;Name").when(
        F.col("c_mktsegment") == "MACHINERY", "a,b,c").otherwise("Easting,Northing,Z,Layer,Name").alias("line"))
    return rows.unionByName(head)


@query("delimited_points", """
SELECT c_mktsegment AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN 'Points' ELSE 'L' || (c_custkey % 4) END AS layer, CAST(c_custkey + 2 AS VARCHAR) AS element_id, c_custkey*1.5::DOUBLE AS x, c_custkey::DOUBLE AS y,
 CASE WHEN c_custkey % 3 <> 0 THEN 2.5::DOUBLE END AS z, c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey % 40 NOT IN (3, 7)""")
def delimited_points(spark, sf):
    e, _ = P.parse_points(point_lines(spark, sf))
    v = F.get(G.vertices("geom"), F.lit(0))
    return e.select("doc_id", "layer", "element_id", v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), F.try_element_at("attrs", F.lit("Name")).alias("name"))


@query("delimited_point_warnings", """
SELECT c_mktsegment AS path, c_custkey + 2 AS line_no, 'Reader.UnreadableCoordinates' AS code FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_custkey % 40 = 7
UNION ALL SELECT 'MACHINERY', 1, 'Reader.NoCoordinateColumns'""")
def delimited_point_warnings(spark, sf):
    return P.parse_points(point_lines(spark, sf))[1]


@query("survey_coordinate_lists", with_sql("parcels", body="""
SELECT id, CASE WHEN id % 3 = 0 THEN 2 ELSE 3 END AS n, minx AS x1, miny AS y1, 4 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n_path FROM parcels"""))
def survey_coordinate_lists(spark, sf):
    t = lambda y, x: F.concat_ws(" ", ks(F.col(y)), ks(F.col(x)))
    lst = F.concat(t("miny", "minx"), F.lit(" 1.0\n  "), F.when(F.col("id") % 3 == 0, "north 2 3").otherwise(F.lit("7 8 9")), F.lit(" "), t("maxy", "maxx"), F.lit(" 4 99"))
    seg = lambda a, b: F.concat(F.lit("<Line><Start>"), t(*a), F.lit("</Start><End>"), t(*b), F.lit("</End></Line>"))
    geo = F.concat(seg(("miny", "minx"), ("miny", "maxx")), seg(("miny", "maxx"), ("maxy", "maxx")), seg(("maxy", "maxx"), ("maxy", "minx")),
                   F.when(F.col("id") % 2 == 0, seg(("maxy", "minx"), ("miny", "minx"))).otherwise(""))
    d = V.parcels(spark, sf).select("id", lst.alias("l"), geo.alias("g"))
    d = G.pin(d, v=landxml.parse_list("l"), p=landxml.coord_geom("g"))
    return d.select("id", F.size("v").cast("long").alias("n"), F.get("v", F.lit(0))["x"].alias("x1"), F.get("v", F.lit(0))["y"].alias("y1"), F.size("p").cast("long").alias("n_path"))


def bridge_documents(spark, sf):
    """One document per brand, a layer per second word, the parts as elements, through their JSON text."""
    p = load(spark, sf, "part")
    k = F.col("p_partkey")
    wkt = F.when(k % 10 == 0, "POINT (1 2").when(k % 10 == 1, "").otherwise(F.concat(F.lit("POINT ("), ks(k), F.lit(" 5)")))
    kind = F.when(k % 6 == 0, "POINT").when(k % 6 == 1, "line").when(k % 6 == 2, "Solid").otherwise("Annotation")
    e = F.struct(ks(k).alias("id"), kind.alias("geometryKind"), wkt.alias("geometryWkt"), F.col("p_type").alias("nativeType"), F.col("p_name").alias("text"), F.create_map(F.lit("size"), ks(F.col("p_size"))).alias("attributes"))
    lay = p.select("p_brand", F.get(F.split("p_name", " "), F.lit(1)).alias("name"), e.alias("e")).groupBy("p_brand", "name").agg(F.collect_list("e").alias("s"))
    lay = lay.select("p_brand", F.struct("name", (F.col("name") != "rod").alias("isVisible"), F.col("s").alias("elements")).alias("l"))
    doc = lay.groupBy("p_brand").agg(F.collect_list("l").alias("s"))
    js = F.to_json(F.struct(F.col("p_brand").alias("location"), F.lit("revit").alias("formatKey"), F.array(F.lit("Partial")).alias("warnings"), F.col("s").alias("layers")))
    return doc.select(F.from_json(js, bridge.DOCUMENT).alias("d")).select("d.*")


@query("bridge_elements", """
SELECT p_brand AS doc_id, split_part(p_name, ' ', 2) AS layer, CAST(p_partkey AS VARCHAR) AS element_id, CASE p_partkey % 6 WHEN 0 THEN 'Point' WHEN 1 THEN 'Line' WHEN 2 THEN 'Unknown' ELSE 'Annotation' END AS geometry_kind,
 CASE WHEN p_partkey % 10 > 1 THEN p_partkey::DOUBLE END AS x, CAST(p_size AS VARCHAR) AS size, split_part(p_name, ' ', 2) <> 'rod' AS is_visible FROM part""")
def bridge_elements(spark, sf):
    e, _ = bridge.parse_documents(bridge_documents(spark, sf))
    return e.select("doc_id", "layer", "element_id", "geometry_kind", F.get(G.vertices("geom"), F.lit(0))["x"].alias("x"), F.try_element_at("attrs", F.lit("size")).alias("size"), "is_visible")


@query("bridge_warnings", """
SELECT p_brand AS doc_id, CAST(p_partkey AS VARCHAR) AS element_id, 'Reader.UnreadableGeometry' AS code FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT DISTINCT p_brand, NULL, 'Partial' FROM part""")
def bridge_warnings(spark, sf):
    return bridge.parse_documents(bridge_documents(spark, sf))[1]


@query("class_deliveries", """
SELECT regexp_replace(regexp_replace(p_brand || '. ' || p_type, '[. ]', '_', 'g'), '^_+|_+$', '', 'g') AS class_file, count(*) AS n_features, count(*) AS n_written,
 'ok' AS status, 'Export.KmlRequiresWgs84' AS code, count(*) AS n_read, count(DISTINCT p_partkey) AS n_ids FROM part GROUP BY 1""")
def class_deliveries(spark, sf):
    """Products as placemarks of one class each brand and type, written in one job and read back from the folders."""
    k = F.col("p_partkey")
    d = load(spark, sf, "part").select(k.alias("feature_id"), F.concat_ws(". ", "p_brand", "p_type").alias("feature_class"), "p_name", G.point(k % 360 - 180.0, k % 180 - 90.0).alias("geom"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/classes-{uuid.uuid4().hex}"
    status = K.write_classes(d, path, "kml", ["p_name"], crs="EPSG:27700")
    # Names that read as numbers stay names.
    back = spark.read.schema("value string, class_file string").text(path)
    read = back.groupBy("class_file").agg(F.count("*").alias("n_read"), F.countDistinct(F.regexp_extract("value", r'^<Placemark id="([^"]*)"', 1)).alias("n_ids"))
    return status.join(read, "class_file", "left")
