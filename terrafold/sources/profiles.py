"""Rule and conversion profiles from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.classify import MappingRule
from .json_case import either_case

RULE = """struct<ruleName:string, priority:int, targetFeatureClass:string, featureClass:string, layerNames:array<string>, entityTypes:array<string>,
geometryTypes:array<string>, blockNames:array<string>, textPattern:string, colors:array<string>, lineTypes:array<string>, xData:array<string>,
attributes:map<string,string>, minimumArea:double, maximumArea:double, minimumLength:double, maximumLength:double, requiredCRS:string, conditions:map<string,string>>"""
PROFILE = f"struct<profileId:string, name:string, version:string, author:string, supportedCRS:string, rules:array<{RULE}>, _corrupt:string>"


def load_profiles(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Rules, one row each with file and position, and the files that did not read."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    raw = G.pin(text, p=either_case("value", PROFILE, "rules")).select("file", "p.*")
    broken = F.col("_corrupt").isNotNull() | (F.col("profileId").isNull() & F.col("rules").isNull())
    rules = raw.where(~broken).select("file", F.col("profileId").alias("profile_id"), F.col("name").alias("profile"), F.posexplode("rules").alias("rule_pos", "r"))
    rules = rules.select("file", "profile_id", "profile", "rule_pos", F.col("r.ruleName").alias("name"), F.coalesce("r.targetFeatureClass", "r.featureClass").alias("target"),
                         F.coalesce("r.priority", F.lit(0)).alias("priority"), F.col("r.layerNames").alias("layers"), F.col("r.entityTypes").alias("entity_types"),
                         F.col("r.geometryTypes").alias("geometry_types"), F.col("r.blockNames").alias("blocks"), F.col("r.textPattern").alias("text_pattern"),
                         F.col("r.minimumArea").alias("min_area"), F.col("r.maximumArea").alias("max_area"), F.col("r.minimumLength").alias("min_length"),
                         F.col("r.maximumLength").alias("max_length"), "r.colors", F.col("r.lineTypes").alias("linetypes"), F.col("r.xData").alias("xdata"), "r.attributes", "r.conditions")
    return rules, raw.where(broken).select("file", F.lit("Profile.Unreadable").alias("code"))


MAX_RULES = 5000


def as_rules(rules: DataFrame) -> list[MappingRule]:
    """Rules as plan-time configuration.  They become column predicates, so their number is checked."""
    rows = rules.orderBy("file", "rule_pos").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: split the profile and classify once per part")
    t = lambda v: tuple(v or ())
    return [MappingRule(r["name"], r["target"], r["priority"], t(r["layers"]), t(r["entity_types"]), t(r["geometry_types"]), t(r["blocks"]), t(r["colors"]),
                        t(r["linetypes"]), t(r["xdata"]), r["text_pattern"], r["min_area"], r["max_area"], r["min_length"], r["max_length"],
                        dict(r["attributes"] or {}), dict(r["conditions"] or {}), r["profile"] or "") for r in rows]


def sidecar_crs(spark: SparkSession, path) -> DataFrame:
    """CRS code of each ``.prj`` file by file stem."""
    from ..functions.crs import crs_from_wkt

    f = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), "value")
    return f.select(F.regexp_replace("f", r"\.[^.]*$", "").alias("stem"), crs_from_wkt("value").alias("crs"))
