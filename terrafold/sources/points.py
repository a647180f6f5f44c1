"""Delimited survey points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions.values import as_double

# Header names, compared ignoring case.
X_NAMES = ("x", "easting", "east", "e", "lon", "longitude")
Y_NAMES = ("y", "northing", "north", "n", "lat", "latitude")
Z_NAMES = ("z", "elevation", "elev", "height", "level")
LAYER_NAMES = ("layer", "code", "class", "feature")
DELIMITERS = (",", ";", "\t", "|")


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """``path, line_no, line`` with physical line numbers, from files read in splits.

    Lines rank inside their split by scan order and are offset by the lines of earlier splits of the
    file, so no file is sorted or read whole.
    """
    raw = spark.read.text(path, wholetext=False).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    splits = raw.groupBy("path", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return raw.join(splits, ["path", "_start"]).select(
        "path", (F.col("_off") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line")


def detect_delimiter(line) -> F.Column:
    """Most frequent delimiter of a header; a tie keeps the earlier one and none means a comma."""
    count = lambda d: F.length(line) - F.length(F.replace(line, F.lit(d), F.lit("")))
    ranked = F.array(*[F.struct(count(d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)])
    return F.array_max(ranked)["d"]


def read_points(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Elements and warnings of delimited point files; a file without coordinate columns is one warning."""
    return parse_points(numbered_lines(spark, path))


def parse_points(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    head = lines.where("line_no = 1").select("path", F.regexp_replace("line", "^﻿", "").alias("line"))
    head = head.withColumn("_d", detect_delimiter(F.col("line")))
    cut = lambda line: F.split(line, F.concat(F.lit("\\Q"), F.col("_d"), F.lit("\\E")), -1)
    head = head.withColumn("_h", F.transform(cut(F.col("line")), lambda h: F.trim(h)))
    # First header, left to right, that is one of the names.
    index = lambda names: F.array_min(F.filter(F.transform("_h", lambda h, i: F.when(F.lower(h).isin(*names), i)), lambda i: i.isNotNull()))
    head = head.withColumns({"_x": index(X_NAMES), "_y": index(Y_NAMES), "_z": index(Z_NAMES), "_l": index(LAYER_NAMES)}).drop("line")
    bad = head.where(F.col("_x").isNull() | F.col("_y").isNull()).select("path", F.lit(1).cast("long").alias("line_no"), F.lit("Reader.NoCoordinateColumns").alias("code"))
    body = lines.where((F.col("line_no") > 1) & (F.length(F.trim("line")) > 0)).join(
        head.where(F.col("_x").isNotNull() & F.col("_y").isNotNull()), "path")
    body = G.pin(body, _f=cut(F.col("line")))
    at = lambda i: F.get("_f", F.col(i))
    body = G.pin(body, x=as_double(at("_x")), y=as_double(at("_y")), z=as_double(at("_z")))
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    warn = body.where(~ok).select("path", "line_no", F.lit("Reader.UnreadableCoordinates").alias("code"))
    pairs = F.zip_with("_h", "_f", lambda h, v: F.struct(h.alias("key"), F.trim(v).alias("value")))
    spare = F.filter(pairs, lambda e, i: e["value"].isNotNull() & e["key"].isNotNull() & ~F.coalesce(F.array_contains(F.array_compact(F.array("_x", "_y", "_z", "_l")), i), F.lit(False)))
    layer = F.coalesce(F.when(F.length(F.trim(at("_l"))) > 0, F.trim(at("_l"))), F.lit("Points"))
    el = body.where(ok).select(
        F.col("path").alias("doc_id"), layer.alias("layer"), F.col("line_no").cast("string").alias("element_id"), F.lit("Point").alias("geometry_kind"),
        G.point("x", "y", "z").alias("geom"), F.lit("POINT").alias("native_type"), F.lit(None).cast("string").alias("text"),
        F.map_from_entries(F.array_distinct(spare)).alias("attrs"), F.col("line_no").alias("pos"))
    return el, warn.unionByName(bad)
