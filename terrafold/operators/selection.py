"""Attribute table, filters, selection algebra, map statistics and selection export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode as E

UNCLASSIFIED = "unclassified"


def attribute_table(features: DataFrame, elements: DataFrame) -> DataFrame:
    """One display row per feature with a concatenated search text.

    ``features`` carries ``element_id, feature_class, classification, confidence, rule_name, geometry_type``.
    """
    e = elements.select("element_id", "layer", F.coalesce("native_type", "geometry_kind").alias("entity_type"),
                        F.try_element_at("attrs", F.lit("Color")).alias("color"), "length", "area")
    d = features.join(e, "element_id", "left").withColumn("handle", F.col("element_id").cast("string"))
    none = F.coalesce(F.length(F.trim("classification")), F.lit(0)) == 0
    status = F.when(none | (F.lower("classification") == UNCLASSIFIED), "Unclassified").otherwise("Classified")
    d = d.withColumn("status", status)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    search = F.concat_ws(" ", *[text(c) for c in ("handle", "layer", "entity_type", "geometry_type", "feature_class", "classification", "rule_name", "status")])
    return d.withColumn("search_text", search)


def filter_features(df: DataFrame, layers: list[str] = (), entity_types: list[str] = (), text: str = "", hidden: DataFrame | None = None) -> DataFrame:
    """Rows of the named layers and types whose search text holds ``text``, without hidden ids."""
    if layers:
        df = df.where(F.lower("layer").isin(*[v.lower() for v in layers]))
    if entity_types:
        df = df.where(F.lower("entity_type").isin(*[v.lower() for v in entity_types]))
    if text.strip():
        df = df.where(F.lower("search_text").contains(text.strip().lower()))
    return df if hidden is None else df.join(hidden.select("element_id"), "element_id", "left_anti")


def select_similar(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows that share a layer and entity type with a seed row."""
    like = seeds.select(F.lower("layer").alias("_l"), F.lower("entity_type").alias("_t")).distinct()
    return df.withColumns({"_l": F.lower("layer"), "_t": F.lower("entity_type")}).join(like, ["_l", "_t"], "left_semi").drop("_l", "_t")


def invert(df: DataFrame, selected: DataFrame) -> DataFrame:
    return df.join(selected.select("element_id"), "element_id", "left_anti")


def isolate(df: DataFrame, selected: DataFrame) -> DataFrame:
    return df.join(selected.select("element_id"), "element_id", "left_semi")


def combine(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Ids of two selections: union, intersect or except."""
    x, y = a.select("element_id"), b.select("element_id")
    return {"union": lambda: x.union(y).distinct(), "intersect": lambda: x.intersect(y), "except": lambda: x.exceptAll(y).distinct()}[how]()


def save_selection(selected: DataFrame, path: str, name: str) -> None:
    """Named sets live in one partitioned table; saving a name again replaces it."""
    selected.select("element_id").distinct().write.mode("overwrite").parquet(f"{path.rstrip('/')}/selection={name}")


def selection_set(spark, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/selection={name}")


def map_stats(df: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """``what, value, n`` for classes and entity types, with the classified share in one more row."""
    d = df if selected is None else isolate(df, selected)
    e = F.explode(F.array(F.struct(F.lit("class").alias("what"), F.col("feature_class").alias("value")), F.struct(F.lit("type").alias("what"), F.col("entity_type").alias("value")),
                          F.struct(F.lit("status").alias("what"), F.col("status").alias("value"))))
    return d.select(e.alias("e")).groupBy("e.what", "e.value").agg(F.count("*").alias("n"))


def classified_share(df: DataFrame) -> DataFrame:
    return df.agg((F.count_if(F.col("status") == "Classified") / F.count("*")).alias("classified_share"))


EXPORT_COLUMNS = ("handle", "layer", "entity_type", "geometry_type", "feature_class", "classification", "confidence", "status", "length", "area", "color")


def export_selection(table: DataFrame, selected: DataFrame, fmt: str = "csv") -> DataFrame:
    """Selected rows as the fixed eleven columns, or as GeoJSON features of the selected ids."""
    d = isolate(table, selected)
    if fmt == "csv":
        return d.select(*EXPORT_COLUMNS)
    text = F.concat(F.lit('{"type":"Feature","id":"'), F.col("handle"), F.lit('","properties":'),
                    F.to_json(F.struct("layer", F.col("feature_class").alias("featureClass"))), F.lit(',"geometry":'), E.to_geojson("geom"), F.lit("}"))
    return d.select(text.alias("value"))
