"""Queries over export profiles, comparisons, logs and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import profiling as P
from . import derive as V
from .derive import with_sql
from .registry import load, query

ks = lambda c: c.cast("string")


def exported(spark, sf):
    """Orders as exported features with named, instance and type properties."""
    k = F.col("o_orderkey")
    props = F.map_filter(F.create_map(
        F.lit("UniqueId"), F.concat(F.lit("U"), ks(k % 9000)), F.lit("Category"), F.when(k % 4 != 0, F.col("o_orderpriority")).otherwise(""),
        F.lit("Level"), F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("#"), F.lit("p_Mark"), F.when(k % 2 == 0, ks(F.col("o_custkey"))).otherwise("#"),
        F.lit("tp_Model"), F.when(k % 5 == 0, F.lit("M1")).otherwise("#")), lambda a, v: v != "#")
    return load(spark, sf, "orders").select(k.alias("feature_id"), props.alias("props"), (F.length("o_orderpriority") + k % 10).alias("bytes"),
                                            F.when(k % 6 != 0, F.when(k % 2 == 0, G.point(k, k)).otherwise(G.rect(k, k, k + 1, k + 1))).alias("geom"))


V.CTE["ex"] = """SELECT o_orderkey AS k, 'U' || (o_orderkey % 9000) AS uid, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '' END AS cat, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS lev,
 CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS mark, o_orderkey % 5 = 0 AS typed, length(o_orderpriority) + o_orderkey % 10 AS bytes,
 2 + (o_orderkey % 3 = 0)::INT + (o_orderkey % 2 = 0)::INT + (o_orderkey % 5 = 0)::INT AS n FROM orders"""


@query("field_statistics", with_sql("ex", body="""
SELECT 'UniqueId' AS field, count(*) AS present, 0 AS missing, 0 AS empty, count(DISTINCT uid) AS "distinct", 100.0::DOUBLE AS coverage FROM ex
UNION ALL SELECT 'Category', count(*) FILTER (cat <> ''), 0, count(*) FILTER (cat = ''), count(DISTINCT nullif(cat, '')), round(count(*) FILTER (cat <> '')*100.0::DOUBLE/count(*), 6) FROM ex
UNION ALL SELECT 'Level', count(lev), count(*) - count(lev), 0, count(DISTINCT lev), round(count(lev)*100.0::DOUBLE/count(*), 6) FROM ex
UNION ALL SELECT 'Absent', 0, count(*), 0, 0, 0.0 FROM ex"""))
def field_statistics(spark, sf):
    return P.field_stats(exported(spark, sf), ["UniqueId", "Category", "Level", "Absent"]).withColumn("coverage", F.round("coverage", 6))


@query("duplicate_identifiers", with_sql("ex", body="SELECT uid AS value, count(*) AS n FROM ex GROUP BY 1 HAVING count(*) > 1"))
def duplicate_identifiers(spark, sf):
    d = exported(spark, sf).select(F.try_element_at("props", F.lit("UniqueId")).alias("uid"))
    return P.duplicate_ids(d, "uid", None)


@query("duplicate_identifiers_top", "SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 5")
def duplicate_identifiers_top(spark, sf):
    return P.duplicate_ids(load(spark, sf, "orders").select(ks(F.col("o_custkey")).alias("v")), "v", 5)


@query("property_profile", with_sql("ex", body="""
SELECT count(*) AS features, round(avg(n), 9) AS average, min(n) AS least, max(n) AS most, max(k) FILTER (n = 5) AS largest, 1 AS largest_instance, 1 AS largest_type, 3 AS largest_named,
 count(mark) AS with_instance, count(*) FILTER (typed) AS with_type FROM ex"""))
def property_profile(spark, sf):
    return P.property_profile(exported(spark, sf)).withColumn("average", F.round("average", 9))


@query("export_comparison", with_sql("ex", body="""
SELECT a.f AS new_features, round(a.p, 9) AS new_properties, a.b AS new_bytes, c.f AS base_features, round(c.p, 9) AS base_properties, c.b AS base_bytes, a.f = c.f AS same_count,
 round((a.b - c.b)*100.0::DOUBLE/c.b, 6) AS size_change FROM (SELECT count(*) AS f, avg(n) AS p, sum(bytes)::BIGINT AS b FROM ex) a, (SELECT count(*) AS f, avg(n) AS p, sum(bytes)::BIGINT AS b FROM ex WHERE k % 7 <> 0) c"""))
def export_comparison(spark, sf):
    e = exported(spark, sf)
    c = P.compare_exports(e, e.where(F.col("feature_id") % 7 != 0))
    return c.withColumns({"new_properties": F.round("new_properties", 9), "base_properties": F.round("base_properties", 9), "size_change": F.round("size_change", 6)})


def log_lines(spark, sf):
    k = F.col("event_id")
    ms = F.format_string("%.2f", F.col("value"))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("12:00 INFO Stage Read "), ks(k % 4), F.lit(" completed in "), ms, F.lit(" ms"))) \
        .when((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0), F.concat(F.lit("Batch finished in "), ms, F.lit(" ms."))) \
        .when(F.col("event_type") == "error", F.concat(F.lit("Reader metadata SemanticSkipped.Read:"), ks(k % 2), F.lit(" = "), ks(k))).otherwise("unrelated 12 ms")
    return load(spark, sf, "events").select(ks(F.col("user_id")).alias("path"), k.alias("line_no"), line.alias("line"))


@query("run_log_durations", """
WITH s AS (SELECT user_id, event_id % 4 AS st, max_by(round(value, 2), event_id)/1000 AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
b AS (SELECT user_id, max_by(round(value, 2), event_id)/1000 AS v FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 GROUP BY 1)
SELECT CAST(u.user_id AS VARCHAR) AS path, round(coalesce(b.v, (SELECT sum(v) FROM s WHERE s.user_id = u.user_id)), 6) AS duration, CASE WHEN b.v IS NOT NULL THEN 'batch' WHEN EXISTS (SELECT 1 FROM s WHERE s.user_id = u.user_id) THEN 'stages' END AS source,
 (SELECT count(*) FROM s WHERE s.user_id = u.user_id) AS stages, (SELECT max(event_id) FROM events e WHERE e.user_id = u.user_id AND event_type = 'error' AND event_id % 2 = 0) AS skipped
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN b USING (user_id)""")
def run_log_durations(spark, sf):
    p = P.parse_run_logs(log_lines(spark, sf))
    return p.select("path", F.round("duration", 6).alias("duration"), "source", "stages", F.try_element_at("skips", F.lit("Read:0")).alias("skipped"))


@query("reason_counts", "SELECT event_type AS stage, CAST(user_id % 5 AS VARCHAR) AS reason, count(*) AS n FROM events WHERE user_id % 5 <> 4 GROUP BY 1, 2")
def reason_counts(spark, sf):
    r = F.when(F.col("user_id") % 5 != 4, ks(F.col("user_id") % 5))
    return P.reason_counts(load(spark, sf, "events").select(F.col("event_type").alias("stage"), r.alias("reason")))


@query("export_inspection", with_sql("ex", body="""
SELECT 'type' AS what, 'Point' AS value, count(*) FILTER (k % 6 IN (2, 4)) AS n FROM ex UNION ALL SELECT 'type', 'Polygon', count(*) FILTER (k % 2 = 1) FROM ex
UNION ALL SELECT 'key', 'UniqueId', count(*) FROM ex UNION ALL SELECT 'key', 'Category', count(*) FROM ex UNION ALL SELECT 'key', 'Level', count(lev) FROM ex UNION ALL SELECT 'key', 'p_Mark', count(mark) FROM ex
UNION ALL SELECT 'key', 'tp_Model', count(*) FILTER (typed) FROM ex UNION ALL SELECT 'total', 'null_geometry', count(*) FILTER (k % 6 = 0) FROM ex"""))
def export_inspection(spark, sf):
    t, h = P.inspect_export(exported(spark, sf))
    return h.unionByName(t.select(F.lit("total").alias("what"), F.lit("null_geometry").alias("value"), F.col("null_geometry").alias("n")))
