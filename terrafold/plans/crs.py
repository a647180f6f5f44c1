"""Queries over coordinate systems: ids, transformation, catalogue, search, suggestion and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geometry as G
from ..operators import crs as O
from . import derive as V
from .derive import with_sql
from .registry import load, query

ks = lambda c: c.cast("string")


@query("crs_identifiers", """
SELECT id, CASE WHEN ok THEN upper(auth) END AS authority, CASE WHEN ok THEN n END AS code, CASE WHEN ok THEN upper(auth) = 'EPSG' AND n BETWEEN 4000 AND 4999 END AS is_geographic
FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'epsg' WHEN 1 THEN 'EPSG' WHEN 2 THEN 'Esri' ELSE 'EPSG' END AS auth, 3900 + p_partkey AS n, p_partkey % 5 < 4 AND p_partkey % 17 <> 5 AS ok FROM part)""")
def crs_identifiers(spark, sf):
    k = F.col("p_partkey")
    code = ks(k + 3900)
    text = F.when(k % 17 == 5, "EPSG:none").when(k % 5 == 0, F.concat(F.lit(" epsg : "), code)).when(k % 5 == 1, code).when(k % 5 == 2, F.concat(F.lit("Esri:"), code)) \
        .when(k % 5 == 3, F.concat(F.lit("EPSG:+"), code)).otherwise(F.concat(F.lit("EPSG:-"), code))
    d = load(spark, sf, "part").select(k.alias("id"), C.parse_crs(text).alias("p"))
    return d.select("id", "p.authority", F.col("p.code").cast("long").alias("code"), "p.is_geographic")


@query("crs_from_definition", """
SELECT page_id, CASE WHEN page_id % 4 <> 3 THEN CASE page_id % 4 WHEN 0 THEN 'EPSG:' || (27700 + page_id) WHEN 1 THEN 'ESRI:' || (100 + page_id) ELSE 'EPSG:' || page_id END END AS crs FROM pages""")
def crs_from_definition(spark, sf):
    k = F.col("page_id")
    datum = F.lit('PROJCS["x",GEOGCS["y",DATUM["z",AUTHORITY["EPSG","6277"]],PRIMEM["Greenwich",0,authority["EPSG","8901"]]],')
    text = F.when(k % 4 == 0, F.concat(datum, F.lit('AUTHORITY["EPSG","'), ks(k + 27700), F.lit('"]]'))) \
        .when(k % 4 == 1, F.concat(datum, F.lit('ID [ "esri" , '), ks(k + 100), F.lit(' ]]'))) \
        .when(k % 4 == 2, F.concat(datum, F.lit('Id["EPSG","'), ks(k), F.lit('"],ID["EPSG",none]]'))).otherwise(F.lit('LOCAL_CS["grid"]'))
    return load(spark, sf, "pages").select("page_id", C.crs_from_wkt(text).alias("crs"))


@query("custom_crs_code", """
SELECT p_partkey AS id, ((list_reduce(list_concat([2166136261::HUGEINT], list_transform(string_split(p_name || 'é' || p_type, ''), lambda c: ord(c)::HUGEINT)),
 lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) % 2147483648)::BIGINT | 1) AS code FROM part""")
def custom_crs_code(spark, sf):
    text = F.concat("p_name", F.lit("é"), "p_type")
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), C.custom_code(text).cast("long").alias("code"))


V.CTE["tm"] = f"""SELECT id, lon, lat, zone, lat < 0 AS south, atan2(t, cos(lam)) AS xi, asinh(sin(lam)/sqrt(t*t + cos(lam)*cos(lam))) AS eta FROM (
 SELECT id, lon, lat, zone, lam, sinh(atanh(sin(radians(lat))) - {C._E!r}::DOUBLE*atanh({C._E!r}::DOUBLE*sin(radians(lat)))) AS t FROM (
  SELECT id, lon, lat, least(60, floor((lon + 180)/6) + 1)::INT AS zone, radians(lon - (least(60, floor((lon + 180)/6) + 1)*6 - 183)) AS lam FROM /*points*/ points))"""


def _sum(fmt, coef):
    return " + ".join(fmt.format(c=repr(a), k=2 * (j + 1)) for j, a in enumerate(coef))


UTM_SQL = f"""SELECT id, round(500000 + {C.K0 * C.RECT!r}::DOUBLE*(eta + {_sum('{c}::DOUBLE*cos({k}*xi)*sinh({k}*eta)', C.ALPHA)}), 3) AS easting,
 round({C.K0 * C.RECT!r}::DOUBLE*(xi + {_sum('{c}::DOUBLE*sin({k}*xi)*cosh({k}*eta)', C.ALPHA)}) + CASE WHEN south THEN 10000000 ELSE 0 END, 3) AS northing, round(lon, 6) AS lon, round(lat, 6) AS lat FROM tm"""


def _utm_code():
    zone = F.least(F.lit(60), F.floor((F.col("lon") + 180) / 6) + 1).cast("int")
    return zone + F.when(F.col("lat") < 0, 32700).otherwise(32600)


@query("reproject_utm", with_sql("tm", body=UTM_SQL))
def reproject_utm(spark, sf):
    d = V.points(spark, sf).withColumn("code", _utm_code()).withColumn("geom", G.point("lon", "lat"))
    d = G.pin(d, u=C.reproject("geom", F.lit(4326), "code"))
    d = G.pin(d, back=C.reproject("u", "code", F.lit(4326)))
    at = lambda g: F.get(G.vertices(g), F.lit(0))
    return d.select("id", F.round(at("u")["x"], 3).alias("easting"), F.round(at("u")["y"], 3).alias("northing"),
                    (F.round(at("back")["x"], 6) + 0.0).alias("lon"), (F.round(at("back")["y"], 6) + 0.0).alias("lat"))


@query("reproject_mercator", with_sql("points", body="""
SELECT id, round(radians(lon)*6378137, 3) AS x, round(ln(tan(radians(lat)/2 + pi()/4))*6378137, 3) AS y, CASE WHEN src = 'S' THEN 'Crs.NoTransformation' END AS fault FROM points"""))
def reproject_mercator(spark, sf):
    d = V.points(spark, sf).withColumn("geom", G.point("lon", "lat"))
    d = G.pin(d, m=C.reproject("geom", F.lit(4326), F.lit(3857)), other=C.reproject("geom", F.lit(4326), F.when(F.col("src") == "S", 27700).otherwise(3857)))
    v = F.get(G.vertices("m"), F.lit(0))
    return d.select("id", (F.round(v["x"], 3) + 0.0).alias("x"), (F.round(v["y"], 3) + 0.0).alias("y"),
                    F.when(F.col("other").isNull(), "Crs.NoTransformation").alias("fault"))


@query("reproject_extent", with_sql("points", body="""
SELECT id, round(radians(lon)*6378137, 3) AS minx, round(radians(lon + 2)*6378137, 3) AS maxx, round(ln(tan(radians(lat + 1)/2 + pi()/4))*6378137, 3) AS maxy FROM points"""))
def reproject_extent(spark, sf):
    box = (F.col("lon"), F.col("lat"), F.col("lon") + 2, F.col("lat") + 1)
    d = G.pin(V.points(spark, sf), e=C.reproject_extent(box, F.lit(4326), F.lit(3857)))
    return d.select("id", *[(F.round(f"e.{n}", 3) + 0.0).alias(n) for n in ("minx", "maxx", "maxy")])


def crs_tables(spark, sf):
    """Registry tables from parts and suppliers: a projected system per part, a geodetic one per supplier."""
    p, s = load(spark, sf, "part"), load(spark, sf, "supplier")
    k, g = F.col("p_partkey"), F.col("s_suppkey")
    geod = s.select((g + 4000).cast("int").alias("code"), F.concat(F.lit("Datum "), "s_name").alias("name"),
                    F.when(g % 4 != 0, F.when(g % 4 == 1, "geographic 2D").otherwise("geocentric")).alias("type"), F.col("s_nationkey").alias("datum_code"), F.lit(6400).alias("cs_code"), (g % 9 == 0).alias("deprecated"))
    proj = p.select((k + 20000).cast("int").alias("code"), F.concat_ws(" / ", "p_name", "p_brand").alias("name"), (k % 130 + 4000).cast("int").alias("geodetic_code"),
                    (k % 8).cast("int").alias("conversion_code"), F.when(k % 5 == 0, 4400).otherwise(9999).alias("cs_code"), (k % 11 == 0).alias("deprecated"))
    n = load(spark, sf, "nation")
    datum = n.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    conv = p.select(k.cast("int").alias("code"), F.concat(F.lit("Method "), "p_type").alias("name"))
    axis = n.where("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, 4400).otherwise(6400).alias("cs_code"), F.explode(F.array(F.lit(1), F.lit(2))).alias("axis_order"),
                                             F.when(F.col("n_nationkey") == 0, 9001).otherwise(9122).alias("unit_code"))
    unit = n.where("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, 9001).otherwise(9122).alias("code"), F.when(F.col("n_nationkey") == 0, "metre").otherwise("degree").alias("name"))
    usage = p.select((k + 20000).cast("int").alias("object_code"), F.explode(F.array(F.col("p_size"), k.cast("int"))).alias("extent_code")).unionByName(
        s.where(g % 3 != 0).select((g + 4000).cast("int").alias("object_code"), g.cast("int").alias("extent_code")))
    e = F.col("p_partkey")
    extent = p.select(e.cast("int").alias("code"), F.concat(F.lit("Area "), "p_name").alias("name"), (e % 17 * 5 - 60.0).alias("south"), (e % 17 * 5 - 60.0 + e % 7 * 4 + 3).alias("north"),
                                                 ((e * 37) % 340 - 175.0).alias("west"), F.when(e % 10 == 0, -170.0).otherwise((e * 37) % 340 - 175.0 + e % 5 * 6 + 2).alias("east"))
    return {"projected": proj, "geodetic": geod, "datum": datum, "conversion": conv, "axis": axis, "unit": unit, "usage": usage, "extent": extent}


V.CTE["ext"] = """SELECT p_partkey AS code, 'Area ' || p_name AS name, p_partkey % 17 * 5 - 60.0::DOUBLE AS south, p_partkey % 17 * 5 - 60.0::DOUBLE + p_partkey % 7 * 4 + 3 AS north,
 (p_partkey*37) % 340 - 175.0::DOUBLE AS west, CASE WHEN p_partkey % 10 = 0 THEN -170.0::DOUBLE ELSE (p_partkey*37) % 340 - 175.0::DOUBLE + p_partkey % 5 * 6 + 2 END AS east FROM part"""
V.CTE["usage_"] = """SELECT p_partkey + 20000 AS object_code, p_size::BIGINT AS extent_code FROM part UNION ALL SELECT p_partkey + 20000, p_partkey FROM part
UNION ALL SELECT s_suppkey + 4000, s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0"""
V.CTE["area_"] = """SELECT object_code, min(south) AS south, max(north) AS north, min(west) AS west, max(east) AS east, min_by(name, code) AS area_name
FROM /*usage_*/ usage_ JOIN /*ext*/ ext ON extent_code = code GROUP BY 1"""
V.CTE["geod"] = """SELECT s_suppkey + 4000 AS code, 'Datum ' || s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'geographic' WHEN 1 THEN 'geographic 2D' ELSE 'geocentric' END AS kind, n_name AS datum, s_suppkey % 9 = 0 AS dead
FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
V.CTE["catalog"] = """SELECT c.code, c.name, c.kind, datum, method, units, area_name, south, north, west, east FROM (
 SELECT p_partkey + 20000 AS code, p_name || ' / ' || p_brand AS name, 'projected' AS kind, g.datum, (SELECT 'Method ' || q.p_type FROM part q WHERE q.p_partkey = part.p_partkey % 8) AS method,
  CASE WHEN p_partkey % 5 = 0 THEN 'metre' END AS units FROM part LEFT JOIN /*geod*/ geod g ON g.code = p_partkey % 130 + 4000 WHERE p_partkey % 11 <> 0
 UNION ALL SELECT code, name, kind, datum, NULL, 'degree' FROM geod WHERE NOT dead) c LEFT JOIN /*area_*/ area_ ON object_code = c.code"""


def catalog(spark, sf):
    return O.build_crs_catalog(crs_tables(spark, sf))


@query("crs_catalogue", with_sql("catalog", body="SELECT code, name, kind, datum, method, units, area_name, south, north, west, east FROM catalog"))
def crs_catalogue(spark, sf):
    return catalog(spark, sf).select(F.col("code").cast("long").alias("code"), "name", "kind", "datum", "method", "units", "area_name", "south", "north", "west", "east")


def crs_queries(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, ks(k + 20000)).when(k % 4 == 1, F.upper(F.concat_ws(" ", F.lit("metre"), "p_name"))).when(k % 4 == 2, F.concat(F.col("p_name"), F.lit(" / B"))).otherwise(F.lit("nowhere-land"))
    return load(spark, sf, "part").select(k.alias("query_id"), text.alias("query"))


HAY = "lower(concat_ws(' ', code, name, coalesce(area_name,''), coalesce(datum,''), coalesce(method,''), coalesce(units,'')))"


@query("crs_search", with_sql("catalog", body=f"""
SELECT query_id, code, score FROM (SELECT query_id, code, score, row_number() OVER (PARTITION BY query_id ORDER BY score, length(name), code) AS rn FROM (
 SELECT query_id, code, name, CASE WHEN q = code::VARCHAR THEN 0 WHEN starts_with(lower(name), q) THEN 1 ELSE 2 END AS score FROM (SELECT *, {HAY} AS hay FROM catalog) JOIN (
  SELECT p_partkey AS query_id, CASE p_partkey % 4 WHEN 0 THEN (p_partkey + 20000)::VARCHAR WHEN 1 THEN 'metre ' || p_name WHEN 2 THEN p_name || ' / b' ELSE 'nowhere-land' END AS q, p_name FROM part)
 ON q = code::VARCHAR OR (contains(hay, split_part(q, ' ', 1)) AND contains(hay, split_part(p_name, ' ', 2)) AND contains(hay, split_part(p_name, ' ', 1)) AND query_id % 4 IN (1, 2))
  OR (query_id % 4 = 0 AND contains(hay, q)))) WHERE rn <= 20"""))
def crs_search(spark, sf):
    s = O.search_crs(crs_queries(spark, sf), catalog(spark, sf), 20)
    return s.select("query_id", F.col("code").cast("long").alias("code"), "score")


@query("crs_by_location", with_sql("catalog", "points", body="""
SELECT id, code, rank FROM (SELECT id, code, row_number() OVER (PARTITION BY id ORDER BY greatest(0, north - south)*CASE WHEN west <= east THEN east - west ELSE east - west + 360 END, code) AS rank
 FROM points JOIN catalog ON kind = 'projected' AND lat BETWEEN south AND north AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END) WHERE rank <= 20"""))
def crs_by_location(spark, sf):
    areas = catalog(spark, sf).select("code", "is_projected", "south", "north", "west", "east")
    c = O.crs_for_points(V.points(spark, sf).select("id", "lon", "lat"), areas, 20, "id")
    return c.select("id", F.col("code").cast("long").alias("code"), F.col("rank").cast("long").alias("rank"))


def document_extents(spark, sf):
    k = F.col("c_custkey")
    x = F.when(k % 4 == 0, (k % 300) - 160.0).when(k % 4 == 1, 200000.0 + k * 37 % 600000).when(k % 4 == 2, 5e6 + k).otherwise(F.lit(None).cast("double"))
    y = F.when(k % 4 == 0, (k % 140) - 70.0).when(k % 4 == 1, (k * 911 % 8000000).cast("double")).when(k % 4 == 2, 3e7 + k).otherwise(F.lit(None).cast("double"))
    return load(spark, sf, "customer").select(k.alias("doc_id"), x.alias("minx"), y.alias("miny"), (x + 5).alias("maxx"), (y + 5).alias("maxy"),
                                              F.when(k % 9 == 0, F.concat(F.lit("epsg:"), ks(k % 2500 + 20000))).alias("declared"))


V.CTE["docs_ext"] = """SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 300 - 160.0::DOUBLE WHEN 1 THEN 200000.0::DOUBLE + c_custkey*37 % 600000 WHEN 2 THEN 5e6 + c_custkey END + 2.5::DOUBLE AS cx,
 CASE c_custkey % 4 WHEN 0 THEN c_custkey % 140 - 70.0::DOUBLE WHEN 1 THEN (c_custkey*911 % 8000000)::DOUBLE WHEN 2 THEN 3e7 + c_custkey END + 2.5::DOUBLE AS cy, c_custkey % 4 AS m, c_custkey % 9 = 0 AND EXISTS (SELECT 1 FROM /*catalog*/ catalog WHERE code = c_custkey % 2500 + 20000) AS dec FROM customer"""
V.CTE["zones_"] = """SELECT doc_id, zone, area_size, row_number() OVER (PARTITION BY doc_id ORDER BY area_size, zone) AS rn FROM (
 SELECT doc_id, zone, area_name, greatest(0, north - south)*CASE WHEN west <= east THEN east - west ELSE east - west + 360 END AS area_size,
  row_number() OVER (PARTITION BY doc_id, zone ORDER BY greatest(0, north - south)*CASE WHEN west <= east THEN east - west ELSE east - west + 360 END, code) AS k FROM (
  SELECT doc_id, zone, cy/111132.0::DOUBLE AS lat, zone*6 - 183 + (cx - 500000)/(greatest(0.2, cos(radians(cy/111132.0::DOUBLE)))*111320.0::DOUBLE) AS lon
  FROM /*docs_ext*/ docs_ext, (SELECT unnest(range(1, 61)) AS zone) WHERE m = 1) JOIN catalog ON kind = 'projected' AND lon BETWEEN -180 AND 180 AND lat BETWEEN south AND north
   AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END) WHERE k = 1"""


@query("crs_suggestions", with_sql("zones_", body="""
SELECT doc_id, crs, confidence, reason FROM (
 SELECT doc_id, 'EPSG:' || (doc_id % 2500 + 20000) AS crs, 0.98::DOUBLE AS confidence, 'declared' AS reason FROM docs_ext WHERE dec
 UNION ALL SELECT doc_id, NULL, 0.0::DOUBLE, 'empty' FROM docs_ext WHERE m = 3 AND NOT dec
 UNION ALL SELECT doc_id, 'EPSG:4326', 0.90::DOUBLE, 'geographic' FROM docs_ext WHERE m = 0
 UNION ALL SELECT doc_id, NULL, 0.55::DOUBLE, 'local' FROM docs_ext WHERE m = 2
 UNION ALL SELECT doc_id, NULL, 0.30::DOUBLE, 'local' FROM docs_ext WHERE m = 1
 UNION ALL SELECT doc_id, 'EPSG:' || (32600 + zone), 0.55::DOUBLE, 'zone' FROM zones_ WHERE rn <= 6)"""))
def crs_suggestions(spark, sf):
    s = O.suggest_crs(document_extents(spark, sf), catalog(spark, sf))
    return s.select("doc_id", "crs", "confidence", F.get(F.split("reason", " "), F.lit(0)).alias("reason"))


@query("crs_validation", """
WITH r AS (SELECT c_custkey AS id, c_custkey % 6 AS m, c_custkey % 3 AS u FROM customer)
SELECT id, 'Input CRS' AS "check", CASE WHEN m = 5 THEN 'Error' ELSE 'Information' END AS severity FROM r
UNION ALL SELECT id, 'Output CRS', 'Information' FROM r
UNION ALL SELECT id, 'Input vs output', 'Warning' FROM r WHERE m = 1
UNION ALL SELECT id, 'Units', CASE WHEN u = 0 THEN 'Warning' WHEN (m IN (0, 3)) = (u = 1) THEN 'Information' ELSE 'Warning' END FROM r WHERE m <> 5
UNION ALL SELECT id, CASE WHEN m = 4 THEN 'Local engineering grid' ELSE 'Coordinate range' END, CASE m WHEN 0 THEN 'Information' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Information' WHEN 3 THEN 'Error' ELSE 'Warning' END FROM r WHERE m <> 5
UNION ALL SELECT id, 'Area of use', CASE WHEN m = 0 THEN 'Information' ELSE 'Warning' END FROM r WHERE m IN (0, 3)
UNION ALL SELECT id, 'Projection change', 'Information' FROM r WHERE m IN (0, 3, 2, 4)
UNION ALL SELECT id, 'Transformation', CASE WHEN m = 4 THEN 'Error' ELSE 'Information' END FROM r WHERE m <> 5
UNION ALL SELECT id, 'Transformed extent', 'Information' FROM r WHERE m IN (0, 2, 3)""")
def crs_validation(spark, sf):
    k = F.col("c_custkey")
    m = k % 6
    # 0 geographic to Mercator, 1 no geometry and same system, 2 UTM to geographic, 3 geographic with metric values, 4 unsupported local grid, 5 nothing chosen.
    req = load(spark, sf, "customer").select(
        k.alias("request_id"), F.when(m.isin(0, 3), "EPSG:4326").when(m == 1, "3857").when(m == 2, "EPSG:32640").when(m == 4, "EPSG:27700").alias("input_crs"),
        F.when(m.isin(0, 1), "epsg:3857").when(m == 3, "EPSG:32631").otherwise("EPSG:4326").alias("output_crs"), F.when(k % 3 == 1, "degrees").when(k % 3 == 2, "Metre").otherwise("").alias("units"),
        F.when(m == 0, 3.0).when(m.isin(2, 3), 400000.0).when(m == 4, 500.0).alias("minx"), F.when(m == 0, 4.0).when(m.isin(2, 3), 2e6).when(m == 4, 500.0).alias("miny"),
        F.when(m == 0, 4.0).when(m.isin(2, 3), 400100.0).when(m == 4, 900.0).alias("maxx"), F.when(m == 0, 5.0).when(m.isin(2, 3), 2.0001e6).when(m == 4, 900.0).alias("maxy"))
    rows = [(4326, "WGS 84", "geographic 2D", "degree", -90.0, 90.0, -180.0, 180.0, False, True), (3857, "Web Mercator", "projected", "metre", None, None, None, None, True, False),
            (32640, "UTM 40N", "projected", "metre", None, None, None, None, True, False), (32631, "UTM 31N", "projected", "metre", 0.0, 84.0, 0.0, 6.0, True, False),
            (27700, "National Grid", "projected", "metre", 49.0, 61.0, -9.0, 2.0, True, False)]
    cat = spark.createDataFrame(rows, "code int, name string, kind string, units string, south double, north double, west double, east double, is_projected boolean, is_geographic boolean")
    v = O.validate_crs(req, cat.withColumn("area_name", F.lit("area")))
    return v.select(F.col("request_id").alias("id"), "check", "severity")


@query("crs_detection", """
SELECT doc_id, 'EPSG:27700' AS crs, 'ApplicationDefault' AS crs_source, 1.0::DOUBLE AS crs_confidence,
 CASE doc_id % 4 WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.85::DOUBLE WHEN 2 THEN 0.50::DOUBLE ELSE 0.0::DOUBLE END AS source_confidence FROM documents""")
def crs_detection(spark, sf):
    k = F.col("doc_id")
    src = F.when(k % 4 == 0, "PrjSidecar").when(k % 4 == 1, "UserSupplied").when(k % 4 == 2, "ExtentHeuristic").otherwise("None")
    return O.detect_crs(load(spark, sf, "documents").select("doc_id", O.source_confidence(src).alias("source_confidence")), "27700")
