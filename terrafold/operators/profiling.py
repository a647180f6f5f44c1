"""Profiles of exported features: fields, identifiers, property counts, comparisons, logs and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def field_stats(features: DataFrame, fields: list[str], props: str = "props", approximate: bool = False) -> DataFrame:
    """Per field: present, missing, null or empty, distinct values and coverage in percent."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    e = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.map_contains_key(props, f).alias("has"), F.try_element_at(props, F.lit(f)).alias("v")) for f in fields]))
    d = features.select(e.alias("e")).select("e.*")
    full = F.col("has") & (F.length("v") > 0)
    return d.groupBy("field").agg(
        F.count_if(full).alias("present"), F.count_if(~F.col("has")).alias("missing"), F.count_if(F.col("has") & ~F.coalesce(full, F.lit(False))).alias("empty"),
        distinct(F.when(full, F.col("v"))).alias("distinct"), (F.count_if(full) * 100.0 / F.count("*")).alias("coverage"))


def duplicate_ids(df: DataFrame, value: str, top: int | None = 5) -> DataFrame:
    """Values that occur more than once with their counts, most frequent first."""
    d = df.where(F.length(value) > 0).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n")).where("n > 1")
    d = d.orderBy(F.col("n").desc(), "value")
    return d.limit(top) if top else d


INSTANCE, TYPE = "p_", "tp_"


def property_profile(features: DataFrame, fid: str = "feature_id", props: str = "props") -> DataFrame:
    """Average, least and most properties per feature, the largest feature and its split, and parameter coverage."""
    keys = F.map_keys(props)
    part = lambda p: F.size(F.filter(keys, lambda k: k.startswith(p)))
    d = features.select(F.col(fid).alias("id"), F.size(keys).alias("n"), part(INSTANCE).alias("instance"), part(TYPE).alias("type"))
    d = d.agg(F.count("*").alias("features"), F.avg("n").alias("average"), F.min("n").alias("least"), F.max("n").alias("most"),
              F.max(F.struct("n", "id", "instance", "type")).alias("_l"), F.count_if(F.col("instance") > 0).alias("with_instance"), F.count_if(F.col("type") > 0).alias("with_type"))
    return d.select("features", "average", "least", "most", F.col("_l.id").alias("largest"), F.col("_l.instance").alias("largest_instance"), F.col("_l.type").alias("largest_type"),
                    (F.col("most") - F.col("_l.instance") - F.col("_l.type")).alias("largest_named"), "with_instance", "with_type")


def distinct_keys(features: DataFrame, props: str = "props") -> DataFrame:
    return features.select(F.explode(F.map_keys(props)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def compare_exports(new: DataFrame, base: DataFrame, props: str = "props", size: str = "bytes") -> DataFrame:
    """Feature count, properties per feature and size of two exports and their changes."""
    side = lambda d, p: d.agg(F.count("*").alias(p + "features"), F.avg(F.size(F.map_keys(props))).alias(p + "properties"), F.sum(size).alias(p + "bytes"))
    both = side(new, "new_").withColumn("_k", F.lit(1)).join(side(base, "base_").withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.withColumns({"same_count": F.col("new_features") == F.col("base_features"), "size_change": (F.col("new_bytes") - F.col("base_bytes")) * 100.0 / F.col("base_bytes")})


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """Per log (``path, line_no, line``): duration in seconds with its source, and skip counters as a map."""
    ext = lambda p, g=1: F.regexp_extract("line", p, g)
    d = lines.select("path", "line_no", ext(r"Stage (.+?) completed in ([\d.]+) ms").alias("stage"), ext(r"Stage (.+?) completed in ([\d.]+) ms", 2).alias("stage_ms"),
                     ext(r"Batch finished in ([\d.]+) ms").alias("batch_ms"), ext(r"Reader metadata SemanticSkipped\.([\w.:]+) = (\d+)").alias("skip"),
                     ext(r"Reader metadata SemanticSkipped\.([\w.:]+) = (\d+)", 2).alias("skips"))
    d = d.where((F.length("stage") > 0) | (F.length("batch_ms") > 0) | (F.length("skip") > 0))
    sec = lambda c: F.col(c).try_cast("double") / 1000.0
    # A stage named twice counts once, by its last line, and so does a skip counter.
    last = lambda name, v: d.where(F.length(name) > 0).groupBy("path", name).agg(F.max_by(v, "line_no").alias("v"))
    stages = last("stage", sec("stage_ms")).groupBy("path").agg(F.sum("v").alias("_s"), F.count("*").alias("stages"))
    skips = last("skip", F.col("skips").try_cast("bigint")).groupBy("path").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("skip", "v")))).alias("skips"))
    batch = d.where(F.length("batch_ms") > 0).groupBy("path").agg(F.max_by(sec("batch_ms"), "line_no").alias("_b"))
    p = lines.select("path").distinct()
    j = p.join(stages, "path", "left").join(batch, "path", "left").join(skips, "path", "left")
    return j.select("path", F.coalesce("_b", "_s").alias("duration"), F.when(F.col("_b").isNotNull(), "batch").when(F.col("_s").isNotNull(), "stages").alias("source"),
                    F.coalesce("stages", F.lit(0)).alias("stages"), "skips")


def reason_counts(df: DataFrame, cols=("stage", "reason")) -> DataFrame:
    return df.where(F.col(cols[-1]).isNotNull()).groupBy(*cols).agg(F.count("*").alias("n"))


def inspect_export(features: DataFrame, geom: str = "geom", props: str = "props") -> tuple[DataFrame, DataFrame]:
    """Totals with null and non-null geometries, and the histogram of geometry types and keys as ``what, value, n``."""
    empty = F.col(geom).isNull() | G.is_empty(geom)
    totals = features.agg(F.count("*").alias("total"), F.count_if(empty).alias("null_geometry"), F.count_if(~empty).alias("with_geometry"))
    kinds = features.where(~empty).groupBy(F.lit("type").alias("what"), F.col(f"{geom}.kind").alias("value")).agg(F.count("*").alias("n"))
    keys = distinct_keys(features, props).select(F.lit("key").alias("what"), F.col("key").alias("value"), "n")
    return totals, kinds.unionByName(keys)
