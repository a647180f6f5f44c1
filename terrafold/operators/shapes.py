"""Curves to vertices, rings to polygons with holes, ordering along an axis and footprints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import curves as C
from ..functions import geometry as G
from . import spatial as S
from .common import GROWS, cut_lineage, spread
from .quality import segment_contact


def densify_curves(curves: DataFrame, tol: float) -> DataFrame:
    """Long vertices ``curve_id, pos, x, y, z`` of arcs, circles and ellipses.

    ``curves`` carries ``curve_id, kind, cx, cy, radius, minor, rotation, start, end, elevation``; angles
    in radians, arcs run counter-clockwise.
    """
    # A row per vertex before its coordinates: plain columns are compiled, array lambdas are not.
    frame = C.ellipse_frame("radius", F.when(F.col("kind") == "ellipse", F.col("minor")).otherwise(F.col("radius")), F.when(F.col("kind") == "ellipse", F.col("rotation")).otherwise(0.0),
                            F.when(F.col("kind") == "circle", 0.0).otherwise(F.col("start")), F.when(F.col("kind") == "circle", 2 * math.pi).otherwise(C.ccw_sweep(F.col("start"), F.col("end"))), tol)
    d = G.pin(spread(curves), _f=frame).select("curve_id", "kind", "cx", "cy", "elevation", "_f.*")
    d = d.withColumn("pos", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(0)))))
    step = F.when((F.col("kind") == "circle") & (F.col("pos") == F.col("n")), 0).otherwise(F.col("pos"))
    d = d.withColumn("_t", F.col("t0") + F.col("sw") / F.col("n") * step)
    d = d.withColumns({"_x": F.col("a") * F.cos("_t"), "_y": F.col("b") * F.sin("_t")})
    at = lambda c, on: F.when(F.col("n").isNotNull(), on).otherwise(F.col(c)).cast("double")
    return d.select("curve_id", "pos", at("cx", F.col("cx") + F.col("_x") * F.col("c") - F.col("_y") * F.col("s")).alias("x"),
                    at("cy", F.col("cy") + F.col("_x") * F.col("s") + F.col("_y") * F.col("c")).alias("y"), F.col("elevation").cast("double").alias("z"))


def clean_ring(ring: Column) -> Column:
    """Ring without exact repeats, closed; null when fewer than three corners or no area remain."""
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    d = F.aggregate(G.tail(ring), F.slice(ring, 1, 1), lambda acc, v: F.when(same(F.element_at(acc, -1), v), acc).otherwise(F.concat(acc, F.array(v))))
    body = G.let(d, lambda r: F.when((F.size(r) > 1) & same(F.get(r, F.lit(0)), F.element_at(r, -1)), G.head(r)).otherwise(r))
    closed = G.let(body, lambda r: F.concat(r, F.slice(r, 1, 1)))
    return F.when(F.size(ring) >= 3, G.let(closed, lambda r: F.when((F.size(r) >= 4) & (G.ring_signed_area(r) != 0), r)))


def is_convex(ring: Column) -> Column:
    """Whether every corner of a closed ring turns the same way."""
    nxt = F.concat(G.tail(ring), F.slice(ring, 2, 1))
    after = F.slice(nxt, 2, F.greatest(F.size(nxt) - 1, F.lit(0)))
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    legs = F.zip_with(G.head(ring), G.head(nxt), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    signs = F.filter(F.zip_with(legs, after, lambda e, c: turn(e["a"], e["b"], c)), lambda v: v != 0)
    return F.size(F.array_distinct(signs)) <= 1


def ring_covers(outer: Column, inner: Column, convex: Column) -> Column:
    """Whether the polygon of one ring covers another ring, touching allowed; corners decide for a convex one."""
    outside = lambda vs: F.exists(vs, lambda v: S.point_in_rings(F.array(outer), v["x"], v["y"]) < 0)
    middle = G.edges_of(inner, lambda a, b: F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"), a["z"].alias("z")))
    pair = lambda r: G.edges_of(r, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cut = lambda segs: F.exists(pair(inner), lambda s: F.exists(segs, lambda t: (
        segment_contact(s["a"], s["b"], t["a"], t["b"]) == 2) & ~_parallel(s, t)))
    return F.when(outside(inner), F.lit(False)).when(convex, F.lit(True)).when(outside(middle), F.lit(False)).otherwise(~G.let(pair(outer), cut))


def _parallel(s, t) -> Column:
    return ((s["b"]["x"] - s["a"]["x"]) * (t["b"]["y"] - t["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (t["b"]["x"] - t["a"]["x"])) == 0


def ring_depths(rings: DataFrame, size: float, key: str = "key", ring_id: str = "ring_id", ring: str = "ring") -> DataFrame:
    """Clean rings with ``depth``, the number of rings around each, and ``parent``, the tightest of them."""
    d = G.pin(rings.select(key, ring_id, F.col(ring).alias("_raw")), ring=clean_ring(F.col("_raw"))).drop("_raw").where(F.col("ring").isNotNull())
    d = G.pin(d, _env=G.envelope(G.polygon(F.col("ring"))), _area=F.abs(G.ring_signed_area(F.col("ring"))), _cv=is_convex(F.col("ring")))
    d = d.select(key, ring_id, "ring", "_area", "_cv", *[F.col(f"_env.{c}").alias(c) for c in S.BOX])
    ob = tuple("o_" + c for c in S.BOX)
    o = d.select(F.col(key).alias("_ok"), F.col(ring_id).alias("_outer"), F.col("ring").alias("_or"), F.col("_cv").alias("_ocv"),
                 F.col("_area").alias("_oa"), *[F.col(c).alias("o_" + c) for c in S.BOX])
    # The key is part of the join, so cells shared by many keys are no hot spot.
    j = S.box_pairs(o, d.drop("_cv"), size, ob, S.BOX, split_above=None).where((F.col("_ok") == F.col(key)) & (F.col("_outer") != F.col(ring_id)))
    holds = (F.col("o_minx") <= F.col("minx")) & (F.col("o_miny") <= F.col("miny")) & (F.col("o_maxx") >= F.col("maxx")) & (F.col("o_maxy") >= F.col("maxy"))
    held = j.where(holds & (F.col("_oa") >= F.col("_area")) & ring_covers(F.col("_or"), F.col("ring"), F.col("_ocv")))
    n = held.groupBy(key, ring_id).agg(F.count("*").alias("depth"), F.min(F.struct("_oa", "_outer")).alias("_p"))
    return d.select(key, ring_id, "ring").hint(GROWS).join(n, [key, ring_id], "left").select(
        key, ring_id, "ring", F.coalesce("depth", F.lit(0)).alias("depth"), F.col("_p._outer").alias("parent"))


def assemble_polygons(rings: DataFrame, size: float, key: str = "key", ring_id: str = "ring_id", ring: str = "ring") -> DataFrame:
    """One polygon or multi-polygon per key: even depth is a shell, its holes lie one level deeper."""
    d = ring_depths(rings, size, key, ring_id, ring)
    shell = F.col("depth") % 2 == 0
    part = d.groupBy(key, F.when(shell, F.col(ring_id)).otherwise(F.col("parent")).alias("_owner")).agg(
        F.min(F.when(shell, F.struct("ring"))).alias("_shell"), F.min(F.struct(ring_id, "ring")).alias("_any"),
        F.sort_array(F.collect_list(F.when(~shell, F.struct(ring_id, "ring")))).alias("_holes"))
    whole = F.concat(F.array(F.col("_shell.ring")), F.transform("_holes", lambda e: e["ring"]))
    g = part.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("_shell").isNotNull(), F.struct("_owner", whole.alias("p"))))).alias("_ps"), F.min("_any").alias("_any"))
    # Rings that only enclose each other leave no shell: the first ring stands alone.
    parts = F.when(F.size("_ps") > 0, F.transform("_ps", lambda e: e["p"])).otherwise(F.array(F.array(F.col("_any.ring"))))
    return g.select(key, G.make_geom(F.when(F.size("_ps") > 1, "MultiPolygon").otherwise("Polygon"), parts).alias("geom"))


# --- ordering along the principal axis ---------------------------------------------------------------

def order_along_axis(points: DataFrame, key: str, pid: str, x: str = "x", y: str = "y", block: int = 65536) -> DataFrame:
    """Rank of each point along its key's principal axis, then across it; fewer than three keep their order.

    Sums give the axis without collecting a key.  Ranks are taken inside slices of the axis and offset by
    the sizes of earlier slices, so that a huge key is never one window.
    """
    c = points.groupBy(key).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"), F.count("*").alias("_n"))
    d = points.join(c, key)
    dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
    s = d.groupBy(key).agg(F.sum(dx * dx).alias("_sxx"), F.sum(dy * dy).alias("_syy"), F.sum(dx * dy).alias("_sxy"))
    d = d.join(s, key).withColumn("angle", F.atan2(F.col("_sxy") * 2, F.col("_sxx") - F.col("_syy")) / 2)
    d = d.withColumns({"along": dx * F.cos("angle") + dy * F.sin("angle"), "across": dy * F.cos("angle") - dx * F.sin("angle")})
    d = d.withColumn("along", F.when(F.col("_n") < 3, F.lit(0.0)).otherwise(F.col("along"))).withColumn(
        "across", F.when(F.col("_n") < 3, F.lit(0.0)).otherwise(F.col("across")))
    reach = F.sqrt(F.col("_sxx") + F.col("_syy"))
    slices = F.greatest(F.lit(1), F.ceil(F.col("_n") / block)).cast("long")
    pos = F.floor((F.col("along") + reach) / F.nullif(reach * 2, F.lit(0.0)) * slices)
    d = d.withColumn("_sl", F.coalesce(F.least(F.greatest(pos, F.lit(0)), slices - 1), F.lit(0)).cast("long"))
    sizes = d.groupBy(key, "_sl").agg(F.count("*").alias("_m"))
    before = W.partitionBy(key).orderBy("_sl").rowsBetween(W.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    rank = F.row_number().over(W.partitionBy(key, "_sl").orderBy("along", "across", pid))
    return d.join(offs, [key, "_sl"]).withColumn("rank", F.col("_off") + rank).select(key, pid, x, y, "angle", "rank")


# --- hulls and footprints --------------------------------------------------------------------------------

def _hull(pts: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull, open; fewer than three rows when the points are collinear."""
    p = np.unique(pts, axis=0)
    if len(p) < 3:
        return p[:0]

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    ring = half(p) + half(p[::-1])
    return np.array(ring) if len(ring) >= 3 else p[:0]


_XY = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


@F.pandas_udf(_XY)
def hull_of(points: pd.Series) -> pd.Series:
    return points.map(lambda ps: [] if ps is None else [
        {"x": float(a), "y": float(b)} for a, b in _hull(np.array([[v["x"], v["y"]] for v in ps], dtype=float).reshape(-1, 2))])


def close_xy(ring: Column) -> Column:
    return G.let(ring, lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), lambda v: G.vertex(v["x"], v["y"])))


def convex_hull(df: DataFrame, geom: str = "geom", out: str = "hull") -> DataFrame:
    """Hull of each geometry; a collinear one is the line between its extreme vertices, one place a point."""
    d = df.withColumn("_h", hull_of(F.transform(G.vertices(geom), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))))
    v = F.array_sort(F.array_distinct(F.transform(G.vertices(geom), lambda p: G.vertex(p["x"], p["y"]))))
    flat = F.when(F.size(v) == 0, F.lit(None).cast(G.GEOM)).when(F.size(v) == 1, G.make_geom(G.POINT, F.array(F.array(v)))).otherwise(
        G.line(F.array(F.get(v, F.lit(0)), F.element_at(v, -1))))
    return d.withColumn(out, F.when(F.size("_h") >= 3, G.polygon(close_xy(F.col("_h")))).otherwise(flat)).drop("_h")


def hull_agg(points: DataFrame, key: str, x: str = "x", y: str = "y", slice_rows: int = 65536) -> DataFrame:
    """Hull per key in steps: corners of each batch before any shuffle, then of slices of ``slice_rows`` points a key.

    Steps end when every key fits one slice, or when nearly all points are corners, which are the result itself.
    """
    schema = f"`{key}` {points.schema[key].dataType.simpleString()}, x double, y double"

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(float)
        h = _hull(p)
        h = h if len(h) else np.unique(p, axis=0)[[0, -1]]
        return pd.DataFrame({key: pdf[key].iloc[0], "x": h[:, 0], "y": h[:, 1]})

    def of_batches(batches):
        for b in batches:
            parts = [corners(g) for _, g in b.groupby(key, dropna=False, sort=False)]
            if parts:
                yield pd.concat(parts)

    d = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = cut_lineage(d.mapInPandas(of_batches, schema))
    left = d.count()
    while True:
        sizes = d.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count("*") / slice_rows).alias("_n"))
        if sizes.where("_n > 1").limit(1).isEmpty():
            break
        sliced = d.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.col("_n")))
        d = cut_lineage(sliced.groupBy(key, "_s").applyInPandas(corners, schema))
        before, left = left, d.count()
        if left > 0.9 * before:
            break
    g = d.groupBy(key).agg(F.collect_set(F.struct("x", "y")).alias("_p"))
    return g.select(key, hull_of("_p").alias("_h")).select(key, F.when(F.size("_h") >= 3, G.polygon(close_xy(F.col("_h")))).alias("geom"))


DEGENERATE = 1e-7  # fixed value: area at or below which an outline is no polygon


def footprints(vertices: DataFrame, key: str) -> DataFrame:
    """Footprint per element from its outline vertices: outline, else hull, else line, else point.

    ``vertices`` carries ``key, pos, x, y`` in outline order, a bounded list per element.
    """
    d = vertices.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))), lambda v: G.vertex(v["x"], v["y"])).alias("_v"))
    d = d.withColumn("_ring", clean_ring(F.col("_v")))
    d = d.withColumn("_flat", F.col("_ring").isNull() | (F.abs(G.ring_signed_area(F.col("_ring"))) <= DEGENERATE))
    empty = F.array().cast("array<struct<x:double,y:double>>")
    d = d.withColumn("_h", hull_of(F.when(F.col("_flat"), F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))).otherwise(empty)))
    hull = close_xy(F.col("_h"))
    solid = (F.size("_h") >= 3) & (G.ring_signed_area(hull) > DEGENERATE)
    line = G.dedupe_ring(F.array_sort(F.col("_v")), 0.0)
    geom = (
        F.when(~F.col("_flat"), G.polygon(G.orient_ring(F.col("_ring"), F.lit(True)))).when(solid, G.polygon(hull))
        .when(F.size(line) >= 2, G.line(line)).otherwise(G.make_geom(G.POINT, F.array(F.array(F.slice("_v", 1, 1))))))
    how = F.when(~F.col("_flat"), "outline").when(solid, "hull").when(F.size(line) >= 2, "line").otherwise("point")
    return d.select(key, how.alias("source"), geom.alias("geom"))
