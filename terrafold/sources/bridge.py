"""Host-application documents as nested JSON: document, layers, elements with WKT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.encode import geom_from_wkt
from .json_case import either_case

DOCUMENT = """struct<location:string, formatKey:string, declaredCrs:string, units:string, metadata:map<string,string>, warnings:array<string>,
layers:array<struct<name:string, isVisible:boolean, metadata:map<string,string>, elements:array<struct<id:string, geometryKind:string,
geometryWkt:string, nativeType:string, text:string, attributes:map<string,string>>>>>>"""
KINDS = ("Unknown", "Point", "Line", "Polygon", "Annotation")


def read_bridge_json(spark: SparkSession, path, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Elements and warnings of documents, one JSON object per line, or per file with ``multiline``.

    Keys may start in lower or upper case.  Bad WKT keeps the element without geometry; an unknown kind
    is ``Unknown``.
    """
    text = spark.read.text(path, wholetext=multiline).where(F.length(F.trim("value")) > 0)
    return parse_documents(G.pin(text, d=either_case("value", DOCUMENT, "layers")).select("d.*"))


def parse_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    layers = docs.select(F.col("location").alias("doc_id"), F.posexplode("layers").alias("_lp", "l"))
    # What an element needs of its layer is taken first: otherwise every element row carries the whole layer.
    layers = layers.select("doc_id", "_lp", F.col("l.name").alias("layer"), F.coalesce("l.isVisible", F.lit(True)).alias("is_visible"), F.col("l.elements").alias("_els"))
    el = layers.select("doc_id", "_lp", "layer", "is_visible", F.posexplode("_els").alias("_ep", "e"))
    # The elements of one document are read by many tasks.
    el = el.repartition("doc_id", "_lp", "_ep").withColumn("_g", geom_from_wkt("e.geometryWkt"))
    kind = F.coalesce(*[F.when(F.lower("e.geometryKind") == k.lower(), F.lit(k)) for k in KINDS], F.lit("Unknown"))
    read = F.col("_g.kind").isNotNull()
    said = F.length(F.trim("e.geometryWkt")) > 0
    out = el.select("doc_id", "layer", "is_visible", F.col("e.id").alias("element_id"), kind.alias("geometry_kind"), F.when(read, F.col("_g")).alias("geom"),
                    F.col("e.nativeType").alias("native_type"), F.col("e.text").alias("text"), F.col("e.attributes").alias("attrs"), F.struct("_lp", "_ep").alias("pos"))
    warn = el.where(said & ~read).select("doc_id", F.col("e.id").alias("element_id"), F.lit("Reader.UnreadableGeometry").alias("code"))
    own = docs.select(F.col("location").alias("doc_id"), F.lit(None).cast("string").alias("element_id"), F.explode("warnings").alias("code"))
    return out, warn.unionByName(own)


def document_table(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("location").alias("doc_id"), F.col("formatKey").alias("format_key"), F.col("declaredCrs").alias("declared_crs"), "units", "metadata")
