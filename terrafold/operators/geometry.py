"""Grouped geometry operators that stay inside built-in aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def extent_agg(df: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Union of row envelopes per key; rows without geometry carry nulls and do not count in it."""
    return df.groupBy(*keys).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.count("*").alias(count),
    )


def merge_geom(df: DataFrame, keys: list[str], order: str, geom: str = "geom") -> DataFrame:
    """Collect single-part geometries of a key into one multi-part row, losing nothing.

    A multi-part geometry is one value, so its size is the size of the answer; use ``dissolve_edges``
    where a group is too large to be one row.
    """
    k = F.col(geom)["kind"]
    d = df.where(~G.is_empty(geom)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col(geom)["parts"].alias("p"), k.alias("k")))).alias("m"),
        F.min(k).alias("lo"), F.max(k).alias("hi"),
    )
    same = (F.col("lo") == F.col("hi")) & F.col("lo").isin(*G.MULTI)
    kind = F.when(same, F.concat(F.lit("Multi"), F.col("lo"))).otherwise(G.COLLECTION)
    members = F.flatten(F.transform("m", lambda e: F.transform(e["p"], lambda _: e["k"])))
    parts = F.flatten(F.transform("m", lambda e: e["p"]))
    return d.select(*keys, G.make_geom(kind, parts, F.when(~same, members)).alias(geom))
