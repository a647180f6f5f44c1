"""Queries over the attribute table, filters and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import classify as C
from ..operators import selection as S
from . import derive as V
from .classification import RULES
from .derive import with_sql
from .registry import query


def table(spark, sf):
    e = V.elements(spark, sf)
    d = C.decide(e, RULES)
    f = d.select("element_id", F.col("label").alias("feature_class"), F.when(F.col("provider") == "RuleEngine", F.col("label")).otherwise("").alias("classification"), "confidence", "rule_name")
    f = f.join(e.select("element_id", F.col("geometry_kind").alias("geometry_type")), "element_id")
    return S.attribute_table(f, e)


V.CTE["tab"] = """SELECT e.element_id, CAST(e.element_id AS VARCHAR) AS handle, e.layer, e.native_type AS entity_type, e.geometry_kind AS geometry_type, coalesce(d.label, 'Unclassified') AS feature_class,
 coalesce(d.label, '') AS classification, coalesce(d.confidence, 0.0::DOUBLE) AS confidence, CASE WHEN d.label IS NULL THEN 'Unclassified' ELSE 'Classified' END AS status, e.length, e.area, e.color, d.rule_name,
 e.element_id || ' ' || e.layer || ' ' || e.native_type || ' ' || e.geometry_kind || ' ' || coalesce(d.label, 'Unclassified') || ' ' || coalesce(d.label, '') || ' ' || coalesce(d.rule_name, '') || ' ' || CASE WHEN d.label IS NULL THEN 'Unclassified' ELSE 'Classified' END AS search_text
FROM /*elements*/ elements e LEFT JOIN /*decided*/ decided d USING (element_id)"""


@query("attribute_table", with_sql("tab", body="SELECT handle, layer, entity_type, geometry_type, feature_class, classification, confidence, status, length, area, color, search_text FROM tab"))
def attribute_table(spark, sf):
    return table(spark, sf).select(*S.EXPORT_COLUMNS, "search_text")


@query("feature_filter", with_sql("tab", body="SELECT element_id FROM tab WHERE layer IN ('BOLT','RING','GEAR') AND entity_type IN ('SMALL','LARGE') AND contains(lower(search_text), 'classified') AND element_id % 5 <> 0"))
def feature_filter(spark, sf):
    t = table(spark, sf)
    return S.filter_features(t, ["bolt", "Ring", "GEAR"], ["small", "LARGE"], " Classified ", t.where(F.col("element_id") % 5 == 0)).select("element_id")


SEED = "SELECT layer, entity_type FROM tab WHERE element_id IN (3, 10, 11)"


@query("select_similar", with_sql("tab", body=f"SELECT element_id FROM tab WHERE (layer, entity_type) IN ({SEED})"))
def select_similar(spark, sf):
    t = table(spark, sf)
    return S.select_similar(t, t.where(F.col("element_id").isin(3, 10, 11))).select("element_id")


@query("selection_algebra", with_sql("tab", body=f"""
SELECT 'invert' AS how, element_id FROM tab WHERE (layer, entity_type) NOT IN ({SEED}) UNION ALL SELECT 'union', element_id FROM tab WHERE (layer, entity_type) IN ({SEED}) OR geometry_type = 'Point'
UNION ALL SELECT 'intersect', element_id FROM tab WHERE (layer, entity_type) IN ({SEED}) AND geometry_type = 'Point' UNION ALL SELECT 'except', element_id FROM tab WHERE (layer, entity_type) IN ({SEED}) AND geometry_type <> 'Point'"""))
def selection_algebra(spark, sf):
    t = table(spark, sf)
    a = S.select_similar(t, t.where(F.col("element_id").isin(3, 10, 11)))
    b = t.where(F.col("geometry_type") == "Point")
    out = S.invert(t, a).select(F.lit("invert").alias("how"), "element_id")
    for how in ("union", "intersect", "except"):
        out = out.unionByName(S.combine(a, b, how).select(F.lit(how).alias("how"), "element_id"))
    return out


@query("map_statistics", with_sql("tab", body="""
SELECT 'class' AS what, feature_class AS value, count(*) AS n FROM tab WHERE layer = 'BOLT' GROUP BY 2 UNION ALL SELECT 'type', entity_type, count(*) FROM tab WHERE layer = 'BOLT' GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM tab WHERE layer = 'BOLT' GROUP BY 2"""))
def map_statistics(spark, sf):
    t = table(spark, sf)
    return S.map_stats(t, t.where("layer = 'BOLT'"))


@query("classified_share", with_sql("tab", body="SELECT round(count(*) FILTER (status = 'Classified')::DOUBLE/count(*), 9) AS classified_share FROM tab"))
def classified_share(spark, sf):
    return S.classified_share(table(spark, sf)).select(F.round("classified_share", 9).alias("classified_share"))


@query("selection_export", with_sql("tab", body="""
SELECT '{"type":"Feature","id":"' || handle || '","properties":{"layer":"' || layer || '","featureClass":"' || feature_class || '"},"geometry":{"type":"Point","coordinates":[' || element_id || ',0]}}' AS value FROM tab WHERE layer = 'RING'"""))
def selection_export(spark, sf):
    t = table(spark, sf).withColumn("geom", G.point(F.col("element_id"), F.lit(0)))
    return S.export_selection(t, t.where("layer = 'RING'"), "geojson")


@query("selection_export_csv", with_sql("tab", body="SELECT handle, layer, entity_type, geometry_type, feature_class, classification, confidence, status, length, area, color FROM tab WHERE layer = 'RING'"))
def selection_export_csv(spark, sf):
    t = table(spark, sf)
    return S.export_selection(t, t.where("layer = 'RING'"))
