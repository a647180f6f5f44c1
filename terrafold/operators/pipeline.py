"""Conversion of many documents in one job, and the registries of user extensions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify as C
from .build import BuildProfile, build_features

READERS: dict[str, Callable] = {}
CLASSIFIERS: dict[str, Callable] = {}
EXTRACTORS: dict[str, Callable] = {}


def register_reader(key: str, fn: Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]) -> None:
    """``fn(spark, path) -> (elements, warnings)``; the first registration of a key wins."""
    READERS.setdefault(key.lower(), fn)


def register_classifier(key: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """``fn(subjects) -> results`` with ``subject_id, label, confidence``, for instance through ``mapInPandas``."""
    CLASSIFIERS.setdefault(key.lower(), fn)


def register_extractor(key: str, fn: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    """``fn(elements) -> (semantic, rels)``."""
    EXTRACTORS.setdefault(key.lower(), fn)


def read(spark: SparkSession, fmt: str, path: str) -> tuple[DataFrame, DataFrame]:
    return READERS[fmt.lower()](spark, path)


@dataclass
class Settings:
    rules: list[C.MappingRule] = field(default_factory=list)
    profile: BuildProfile = field(default_factory=BuildProfile)
    class_kind: str = "Polygon"
    continue_on_error: bool = True


@dataclass
class Conversion:
    """Frames of one batch, all lazy: features, findings, and one status row per document."""

    features: DataFrame
    findings: DataFrame
    documents: DataFrame


def convert(elements: DataFrame, warnings: DataFrame, settings: Settings) -> Conversion:
    """Classify, group into feature classes and build; documents that gave no element are failed."""
    d = C.decide(elements, settings.rules) if settings.rules else None
    e = C.group_virtual_layers(elements, d.where(F.col("provider") == "RuleEngine")) if d is not None else elements.withColumn("feature_class", F.col("layer"))
    e = e.withColumnsRenamed({"element_id": "feature_id"}).withColumn("dataset", F.col("feature_class"))
    features, findings = build_features(e, settings.profile, settings.class_kind)
    docs = elements.groupBy("doc_id").agg(F.count("*").alias("elements"))
    bad = warnings.groupBy("doc_id").agg(F.count("*").alias("warnings"))
    n = docs.join(bad, "doc_id", "full_outer").withColumns({"elements": F.coalesce("elements", F.lit(0)), "warnings": F.coalesce("warnings", F.lit(0))})
    status = F.when(F.col("elements") == 0, "Failed").when(F.col("warnings") > 0, "SucceededWithWarnings").otherwise("Succeeded")
    return Conversion(features, findings, n.withColumn("status", status))


def convert_batch(spark: SparkSession, sources: dict[str, str], settings: Settings) -> Conversion:
    """Convert every document under ``{format: path}`` in one plan per format.

    A format that cannot be planned is a failed document row and the rest go on, or the error is raised
    when the settings say to stop.
    """
    el, wr, lost = None, None, []
    for fmt, path in sources.items():
        try:
            e, w = read(spark, fmt, path)
        except Exception as x:  # noqa: BLE001 - one unreadable source must not stop the batch
            if not settings.continue_on_error:
                raise
            lost.append((path, f"{type(x).__name__}"))
            continue
        e = e.withColumn("pos", F.col("pos").cast("string"))
        w = w.select(F.col("path" if "path" in w.columns else "doc_id").alias("doc_id"), "code")
        el = e if el is None else el.unionByName(e, allowMissingColumns=True)
        wr = w if wr is None else wr.unionByName(w)
    if el is None:
        raise RuntimeError(f"no source could be read: {lost}")
    c = convert(el, wr, settings)
    if lost:
        rows = spark.createDataFrame(lost, "doc_id string, code string").select("doc_id", F.lit(0).cast("long").alias("elements"), F.lit(1).cast("long").alias("warnings"), F.lit("Failed").alias("status"))
        c.documents = c.documents.unionByName(rows)
    return c
