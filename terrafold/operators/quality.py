"""Dataset quality rules.  Every rule returns a findings table of one layout.

Features carry ``dataset, feature_id, pos, geom`` and, for attribute rules, ``attrs`` (map of canonical
strings); ``fields`` carries ``dataset, name, data_type, ordinal``.  All datasets of a delivery are
checked in one pass, keyed by ``dataset``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import geometry as G
from . import spatial as S
from .common import GROWS, join_dealt

SEVERITIES = ("Information", "Warning", "Error", "Critical")  # rank order
CATEGORIES = ("Unspecified", "Geometry", "Attribute", "Topology", "Crs", "Classification", "SourceIntegrity", "Export")
INFO, WARN, ERROR, CRITICAL = range(4)

FINDING = (
    ("dataset", "string"), ("rule", "string"), ("severity", "int"), ("category", "string"), ("code", "string"),
    ("message", "string"), ("feature_id", "string"), ("field", "string"), ("x", "double"), ("y", "double"),
    ("remediation", "string"), ("pos", "long"),
)


def finding(df: DataFrame, rule_id: str, severity, category, message: Column, code=None, **cols) -> DataFrame:
    """Project rows onto the findings layout; columns not given are null."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    given = {"rule": F.lit(rule_id), "severity": lit(severity), "category": lit(category),
             "code": lit(code if code is not None else rule_id), "message": message, **cols}
    if "dataset" in df.columns:
        given.setdefault("dataset", F.col("dataset"))
    return df.select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FINDING])


def severity_name(rank) -> Column:
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), G._c(rank))


def attr(attrs, name: str) -> Column:
    """Attribute value by name, ignoring case."""
    hit = F.filter(F.map_entries(G._c(attrs)), lambda e: F.lower(e["key"]) == name.lower())
    return F.get(hit, F.lit(0))["value"]


def _nonempty(v) -> Column:
    return F.coalesce(F.length(v) > 0, F.lit(False))


# --- geometry --------------------------------------------------------------------------------------

def _segs(ring: Column) -> Column:
    n = F.size(ring) - 1
    return F.zip_with(
        F.zip_with(G.head(ring), G.tail(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i"), n.alias("n")))


def _turn(a, b, c) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _within(a, b, p) -> Column:
    return p["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & p["y"].between(
        F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def segment_contact(a, b, c, d) -> Column:
    """How segments ``ab`` and ``cd`` meet: 0 not at all, 1 in one point on an end, 2 by crossing or sharing length."""
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    cross = (t1 * t2 < 0) & (t3 * t4 < 0)
    flat = (t1 == 0) & (t2 == 0)
    lap = lambda k: F.least(F.greatest(a[k], b[k]), F.greatest(c[k], d[k])) - F.greatest(F.least(a[k], b[k]), F.least(c[k], d[k]))
    share = flat & (lap("x") >= 0) & (lap("y") >= 0) & ((lap("x") > 0) | (lap("y") > 0))
    end = ((t1 == 0) & _within(a, b, c)) | ((t2 == 0) & _within(a, b, d)) | ((t3 == 0) & _within(c, d, a)) | ((t4 == 0) & _within(c, d, b))
    return F.when(cross | share, 2).when(end, 1).otherwise(0)


def _pair_contact(s, t, closed) -> Column:
    """Contact of two segments of one path, ignoring the vertex that neighbours share."""
    adjacent = (t["i"] - s["i"] == 1) | (closed & (s["i"] == 0) & (t["i"] == s["n"] - 1))
    c = segment_contact(s["a"], s["b"], t["a"], t["b"])
    return F.when(adjacent & (c == 1), 0).otherwise(c)


SMALL_RING = 32


def _without_repeats(path: Column) -> Column:
    """Path without vertices equal to the one before, so that neighbours stay neighbours."""
    prev = F.concat(F.array(F.lit(None).cast(G.VERTEX)), G.head(path))
    pairs = F.zip_with(path, prev, lambda v, u: F.struct(v.alias("v"), u.alias("u")))
    new = F.filter(pairs, lambda e: e["u"].isNull() | (e["u"]["x"] != e["v"]["x"]) | (e["u"]["y"] != e["v"]["y"]))
    return F.transform(new, lambda e: e["v"])


def _segment_contacts(a, b, c, d) -> tuple[np.ndarray, np.ndarray]:
    """``segment_contact`` of arrays: whether segments ``ab`` and ``cd`` cross or share length, and whether they meet on an end."""
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    between = lambda p, q, r: np.logical_and(*[(np.minimum(u, v) <= w) & (w <= np.maximum(u, v)) for u, v, w in zip(p, q, r)])
    u, v = (np.minimum(np.maximum(a[k], b[k]), np.maximum(c[k], d[k])) - np.maximum(np.minimum(a[k], b[k]), np.minimum(c[k], d[k])) for k in (0, 1))
    t1, t2, t3, t4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    share = (t1 == 0) & (t2 == 0) & (u >= 0) & (v >= 0) & ((u > 0) | (v > 0))
    end = ((t1 == 0) & between(a, b, c)) | ((t2 == 0) & between(a, b, d)) | ((t3 == 0) & between(c, d, a)) | ((t4 == 0) & between(c, d, b))
    return ((t1 * t2 < 0) & (t3 * t4 < 0)) | share, end


def _blocks(n: np.ndarray):
    """Rows of one count, some at a time, with all pairs of so many things."""
    for size in np.unique(n[n > 1]):
        s, t = np.triu_indices(size, 1)
        rows, step = np.flatnonzero(n == size), max(1, 200_000 // len(s))
        yield from ((int(size), s, t, rows[k:k + step]) for k in range(0, len(rows), step))


def _contacts(xy: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Worst self-contact of each path, paths of one length side by side; path ``p`` has the vertices ``ends[p]`` to ``ends[p + 1]``."""
    out = np.zeros(len(ends) - 1, np.int32)
    for size, s, t, rows in _blocks(np.diff(ends) - 1):
        x, y = (xy[ends[rows][:, None] + np.arange(size + 1), k] for k in (0, 1))
        two, end = _segment_contacts(*((x[:, i], y[:, i]) for i in (s, s + 1, t, t + 1)))
        closed = (x[:, 0] == x[:, -1]) & (y[:, 0] == y[:, -1])
        adjacent = (t - s == 1)[None] | (closed[:, None] & ((s == 0) & (t == size - 1))[None])
        out[rows] = np.where(two, 2, np.where(end & ~adjacent, 1, 0)).max(1)
    return out


def _crossed(xy: np.ndarray, ring_ends: np.ndarray, feature_ends: np.ndarray) -> np.ndarray:
    """Which features have two rings that cross or share a stretch."""
    n = np.maximum(np.diff(ring_ends) - 1, 0)
    ring = np.repeat(np.arange(len(n)), n)
    at = ring_ends[:-1][ring] + np.arange(len(ring)) - (np.cumsum(n) - n)[ring]
    ends = np.concatenate([[0], np.cumsum(n)])[feature_ends]
    out = np.zeros(len(ends) - 1, bool)
    for size, s, t, rows in _blocks(np.diff(ends)):
        seg = ends[rows][:, None] + np.arange(size)
        v, r = at[seg], ring[seg]
        two, _ = _segment_contacts(*((xy[u, 0], xy[u, 1]) for u in (v[:, s], v[:, s] + 1, v[:, t], v[:, t] + 1)))
        out[rows] = (two & (r[:, s] != r[:, t])).any(1)
    return out


def _level(a: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of a list array, where a missing list is an empty one, and what its lists hold."""
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]), a.flatten()


def _plane(v: pa.Array) -> np.ndarray:
    # A missing coordinate compares as no number does.
    return np.stack([pc.cast(pc.struct_field(v, c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1).astype(float)


@F.arrow_udf(T.IntegerType())
def self_contact_small(paths: pa.Array) -> pa.Array:
    """Worst self-contact of a short path, compared in place without a shuffle."""
    ends, v = _level(paths)
    with np.errstate(invalid="ignore", over="ignore"):
        return pa.array(_contacts(_plane(v), ends))


@F.arrow_udf(T.BooleanType())
def rings_cross_small(rings: pa.Array) -> pa.Array:
    """Whether two rings of a small feature cross or share a stretch, compared in place."""
    feature_ends, paths = _level(rings)
    ring_ends, v = _level(paths)
    with np.errstate(invalid="ignore", over="ignore"):
        return pa.array(_crossed(_plane(v), ring_ends, feature_ends))


def self_contacts(features: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """``keys, contact`` for features whose paths touch (1) or cross (2) themselves, or whose rings cross (2).

    Short paths are compared in place.  A long path is cut into cells of its own envelope and its
    segments are joined per cell, so no task sees all pairs of one path.
    """
    paths = features.select(*keys, F.posexplode(F.transform(G.rings(geom), _without_repeats)).alias("_r", "_path"))
    small = paths.where(F.size("_path").between(3, SMALL_RING)).withColumn("contact", self_contact_small("_path"))
    small = small.where(F.col("contact") > 0).select(*keys, "contact")
    big = paths.where(F.size("_path") > SMALL_RING)
    xs, ys = F.transform("_path", lambda v: v["x"]), F.transform("_path", lambda v: v["y"])
    span = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    big = big.withColumn("_size", F.greatest(span / F.ceil(F.sqrt(F.size("_path").cast("double"))), F.lit(1e-12)))
    big = big.withColumn("_closed", G.is_closed(F.col("_path")))
    segs = _in_cells(big.select(*keys, "_r", "_size", "_closed", F.explode(_segs(F.col("_path"))).alias("s")))
    other = segs.select(*keys, "_r", "_cx", "_cy", F.col("s").alias("t"))
    j = segs.hint(GROWS).join(other, [*keys, "_r", "_cx", "_cy"]).where(F.col("t.i") > F.col("s.i"))
    j = j.withColumn("contact", _pair_contact(F.col("s"), F.col("t"), F.col("_closed"))).where(F.col("contact") > 0)
    found = small.unionByName(j.select(*keys, "contact")).unionByName(_ring_crossings(features, keys, geom))
    return found.groupBy(*keys).agg(F.max("contact").alias("contact"))


def _in_cells(segs: DataFrame) -> DataFrame:
    """Segments ``s`` once per cell of width ``_size`` that their envelope meets."""
    lo = lambda k: F.floor(F.least(F.col("s.a")[k], F.col("s.b")[k]) / F.col("_size")).cast("long")
    hi = lambda k: F.floor(F.greatest(F.col("s.a")[k], F.col("s.b")[k]) / F.col("_size")).cast("long")
    return segs.withColumn("_cx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("_cy", F.explode(F.sequence(lo("y"), hi("y"))))


def _ring_crossings(features: DataFrame, keys: list[str], geom: str) -> DataFrame:
    """``keys, contact`` (2) of polygons two of whose rings cross or share a stretch; equal rings are another fault."""
    rings = F.array_distinct(F.transform(G.rings(geom), _without_repeats))
    d = features.where((G.base_kind(geom) == G.POLYGON) & (F.size(G.rings(geom)) > 1)).select(*keys, rings.alias("_rs"))
    vs = F.flatten("_rs")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    small = F.size(vs) <= 2 * SMALL_RING
    few = d.where(small & known).withColumn("_hit", rings_cross_small("_rs")).where("_hit").select(*keys, F.lit(2).alias("contact"))
    d = d.where(~small)
    span = lambda k: F.array_max(F.transform(vs, lambda v: v[k])) - F.array_min(F.transform(vs, lambda v: v[k]))
    d = d.withColumn("_size", F.greatest(F.greatest(span("x"), span("y")) / F.ceil(F.sqrt(F.size(vs).cast("double"))), F.lit(1e-12)))
    segs = _in_cells(d.select(*keys, "_size", F.posexplode("_rs").alias("_r", "_path")).select(*keys, "_r", "_size", F.explode(_segs(F.col("_path"))).alias("s")))
    other = segs.select(*keys, F.col("_r").alias("_q"), "_cx", "_cy", F.col("s").alias("t"))
    j = segs.hint(GROWS).join(other, [*keys, "_cx", "_cy"]).where(F.col("_q") > F.col("_r"))
    return few.unionByName(j.where(segment_contact(F.col("s.a"), F.col("s.b"), F.col("t.a"), F.col("t.b")) == 2).select(*keys, F.lit(2).alias("contact")))


def hole_outside(part: Column) -> Column:
    """Whether a hole has a vertex outside its shell."""
    shell = F.get(part, F.lit(0))
    return F.exists(G.tail(part), lambda h: F.exists(h, lambda v: S.point_in_rings(F.array(shell), v["x"], v["y"]) < 0))


def holes_nested(part: Column) -> Column:
    """Whether a hole lies inside another one."""
    holes = G.tail(part)
    return F.exists(holes, lambda h: F.exists(holes, lambda o: (h != o) & ~F.exists(h, lambda v: S.point_in_rings(F.array(o), v["x"], v["y"]) <= 0)))


def check_geometry(features: DataFrame, vertex_tol: float = 1e-8, min_length: float = 1e-6, min_area: float = 1e-9,
                   self_intersection: bool = True) -> DataFrame:
    """Null, empty, zero length or area, ring validity and repeated vertices, one row per fault."""
    g = F.col("geom")
    kind = G.base_kind("geom")
    fault = lambda sev, code: F.struct(F.lit(sev).alias("severity"), F.lit(f"Geometry.{code}").alias("code"))
    bad = lambda r: F.exists(r, lambda v: F.isnan(v["x"]) | F.isnan(v["y"]) | (F.abs(v["x"]) == math.inf) | (F.abs(v["y"]) == math.inf))

    def repeats(path):
        return F.size(F.filter(G.edges_of(path, G.planar), lambda d: d <= vertex_tol))

    def line_faults(part):
        path = F.get(part, F.lit(0))
        return F.array(
            F.when(G.ring_length(path) <= min_length, fault(ERROR, "ZeroLength")),
            F.when(repeats(path) > 0, fault(WARN, "DuplicateVertices")))

    def poly_faults(part):
        shell = F.get(part, F.lit(0))
        holes = G.tail(part)
        same_box = lambda r: F.struct(F.array_min(F.transform(r, lambda v: v["x"])), F.array_min(F.transform(r, lambda v: v["y"])),
                                      F.array_max(F.transform(r, lambda v: v["x"])), F.array_max(F.transform(r, lambda v: v["y"])),
                                      F.abs(G.ring_signed_area(r)))
        outside, nested = hole_outside(part), holes_nested(part)
        dup_rings = F.size(F.array_distinct(F.transform(part, same_box))) < F.size(part)
        first = (
            F.when(F.exists(part, bad), fault(CRITICAL, "InvalidCoordinate"))
            .when(F.exists(part, lambda r: ~G.is_closed(r)), fault(ERROR, "RingNotClosed"))
            .when(F.exists(part, lambda r: F.size(r) < 4), fault(ERROR, "TooFewPoints"))
            .when(dup_rings, fault(WARN, "DuplicateRings"))
            .when(outside, fault(ERROR, "HoleOutsideShell")).when(nested, fault(ERROR, "NestedHoles")))
        # Consecutive repeats over all rings joined; one per ring is allowed.
        return F.array(
            F.when(G.part_area(part) <= min_area, fault(ERROR, "ZeroArea")), first,
            F.when(F.size(shell) < 4, fault(ERROR, "DegenerateRing")),
            F.when(repeats(F.flatten(part)) > F.size(part), fault(WARN, "DuplicateVertices")))

    per_part = F.flatten(F.transform(
        g["parts"], lambda p: F.when(kind == G.LINE, line_faults(p)).when(kind == G.POLYGON, poly_faults(p)).otherwise(
            F.array().cast("array<struct<severity:int,code:string>>"))))
    whole = F.array(F.when((g["kind"].startswith("Multi")) & (repeats(G.vertices(g)) > 0), fault(WARN, "DuplicateVertices")))
    faults = (
        F.when(g.isNull(), F.array(fault(ERROR, "Null"))).when(G.is_empty("geom"), F.array(fault(WARN, "Empty")))
        .otherwise(F.array_compact(F.concat(per_part, whole))))
    v0 = F.get(G.vertices("geom"), F.lit(0))
    d = features.select("dataset", "feature_id", "pos", v0["x"].alias("vx"), v0["y"].alias("vy"), F.explode(faults).alias("f"))
    out = finding(d, "Geometry.Check", F.col("f.severity"), "Geometry", F.concat(F.col("f.code"), F.lit(" on feature "), F.col("feature_id")),
                  F.col("f.code"), feature_id=F.col("feature_id"), x=F.col("vx"), y=F.col("vy"), pos=F.col("pos"))
    if not self_intersection:
        return out
    sized = features.where(g.isNotNull() & (kind != G.POINT))
    c = self_contacts(sized.withColumn("_k", kind), ["dataset", "feature_id", "pos", "_k"])
    is_line = F.col("_k") == G.LINE
    code = F.when(is_line, "Geometry.SelfIntersectingLine").when(F.col("contact") == 2, "Geometry.SelfIntersection").otherwise("Geometry.RingSelfIntersection")
    return out.unionByName(finding(
        c, "Geometry.Check", F.when(is_line, WARN).otherwise(ERROR), "Geometry",
        F.concat(code, F.lit(" on feature "), F.col("feature_id")), code, feature_id=F.col("feature_id"), pos=F.col("pos")))


# --- topology ---------------------------------------------------------------------------------------

def _shared_regions(pairs: DataFrame, min_area: float) -> DataFrame:
    """``pair_id, shared_area, x, y`` of polygon pairs that overlap: neither covers the other, and they share area.

    The point lies inside the shared region: on a level half way between two vertex heights near the
    middle, in the widest stretch.
    """
    from . import arrangement as A
    from .common import cut_lineage

    u = cut_lineage(A.label_pairs(pairs)[0])
    has_a, has_b = F.col("fa") + F.col("ra") > 0, F.col("fb") + F.col("rb") > 0
    against = has_a & has_b & (F.col("fa") != F.col("fb"))
    beyond = u.groupBy("pair_id").agg(
        F.max((has_a & ~has_b & ~F.col("inside")) | (has_b & ~has_a & F.col("inside")) | against).alias("_a"),
        F.max((has_b & ~has_a & ~F.col("inside")) | (has_a & ~has_b & F.col("inside")) | against).alias("_b")).where("_a and _b")
    e = A._emit(u, "pair_id", "intersection").hint(GROWS).join(beyond.select("pair_id"), "pair_id", "left_semi")
    span = e.groupBy("pair_id").agg(F.min("x1").alias("_ox"), F.min("y1").alias("_oy"), F.max("y1").alias("_my"))
    e = e.hint(GROWS).join(span, "pair_id")
    x1, y1, x2, y2 = F.col("x1") - F.col("_ox"), F.col("y1") - F.col("_oy"), F.col("x2") - F.col("_ox"), F.col("y2") - F.col("_oy")
    mid = (F.col("_oy") + F.col("_my")) / 2
    size = e.groupBy("pair_id").agg((F.sum(x1 * y2 - x2 * y1) / 2).alias("shared_area"), F.max(F.when(F.col("y1") <= mid, F.col("y1"))).alias("_lo"),
                                    F.min(F.when(F.col("y1") > mid, F.col("y1"))).alias("_hi")).where(F.col("shared_area") > min_area)
    d = e.hint(GROWS).join(size.withColumn("y", (F.col("_lo") + F.col("_hi")) / 2), "pair_id").where((F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y")))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    cut = d.groupBy("pair_id", "shared_area", "y").agg(F.sort_array(F.collect_list(at)).alias("_xs"))
    width = lambda i: F.struct((F.get("_xs", 2 * i + 1) - F.get("_xs", 2 * i)).alias("w"), ((F.get("_xs", 2 * i + 1) + F.get("_xs", 2 * i)) / 2).alias("x"))
    best = F.array_max(F.transform(F.sequence(F.lit(0), (F.size("_xs") / 2).cast("int") - 1), width))
    return cut.select("pair_id", "shared_area", best["x"].alias("x"), "y")


def overlap_areas(features: DataFrame, size: float, min_area: float = 1e-6, **kw) -> DataFrame:
    """Overlapping polygon pairs of one dataset with the shared area and a point in it.

    Equal shapes never overlap each other, so copies collapse to one row before the join and are expanded
    only against the shapes they really overlap.  Envelopes bring candidates together; two rectangles (or
    features given by ``minx..maxy`` alone) are decided by their sides, any other pair by its cut outlines.
    """
    from .common import cut_lineage, row_id

    known = features.where(F.col("minx").isNotNull())
    if "geom" in features.columns:
        known = known.where(~G.is_empty("geom") & (G.base_kind("geom") == G.POLYGON)).withColumn("_plain", S.is_rectangle())
        known = known.withColumn("_g", F.when(F.col("_plain"), row_id("dataset", *S.BOX)).otherwise(row_id("dataset", "geom")))
        mixed = not known.where(~F.col("_plain")).isEmpty()
    else:
        known = known.withColumns({"_plain": F.lit(True), "_g": row_id("dataset", *S.BOX)})
        mixed = False
    shapes = known.groupBy("_g", "dataset", "_plain", *S.BOX).agg(F.min(F.struct("pos", "feature_id")).alias("_rep"), F.count("*").alias("_n"))
    side = lambda t: shapes.select(F.col("dataset").alias(f"ds_{t}"), *[F.col(c).alias(f"{t}_{c}") for c in S.BOX], F.col("_rep").alias(f"_r{t}"),
                                   F.col("_g").alias(f"_g{t}"), F.col("_plain").alias(f"_p{t}"))
    ab, bb = tuple("a_" + c for c in S.BOX), tuple("b_" + c for c in S.BOX)
    j = S.box_pairs(side("a"), side("b"), size, ab, bb, **kw).where((F.col("ds_a") == F.col("ds_b")) & (F.col("_ga") < F.col("_gb")))
    x0, y0 = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
    x1, y1 = F.least("a_maxx", "b_maxx"), F.least("a_maxy", "b_maxy")
    area = (x1 - x0) * (y1 - y0)
    j = j.where((x1 > x0) & (y1 > y0) & (area > min_area))
    kept = ["ds_a", "_ga", "_gb", "_ra", "_rb", "shared_area", "x", "y"]
    plain = F.col("_pa") & F.col("_pb")
    found = j.where(plain & S.box_predicate("overlaps", ab, bb)).withColumns({"shared_area": area, "x": (x0 + x1) / 2, "y": (y0 + y1) / 2}).select(*kept)
    if mixed:
        outline = known.select("_g", "geom").dropDuplicates(["_g"])
        pairs = j.where(~plain).select("ds_a", "_ga", "_gb", "_ra", "_rb", row_id("_ga", "_gb").alias("pair_id"))
        pairs = pairs.hint(GROWS).join(outline.select(F.col("_g").alias("_ga"), F.col("geom").alias("geom_a")), "_ga")
        pairs = cut_lineage(pairs.hint(GROWS).join(outline.select(F.col("_g").alias("_gb"), F.col("geom").alias("geom_b")), "_gb"))
        found = found.unionByName(pairs.hint(GROWS).join(_shared_regions(pairs, min_area), "pair_id").select(*kept))
    # Only copies need the way back to their members; a shape of its own is its representative.
    copies = known.hint(GROWS).join(shapes.where("_n > 1").select("_g"), "_g", "left_semi")
    member = lambda t: copies.select(F.col("_g").alias(f"_g{t}"), F.struct("pos", "feature_id").alias(f"_m{t}"))
    j = found.hint(GROWS).join(member("a"), "_ga", "left").hint(GROWS).join(member("b"), "_gb", "left")
    own = lambda t: F.coalesce(f"_m{t}", f"_r{t}")
    j = j.withColumns({"pos_a": own("a")["pos"], "id_a": own("a")["feature_id"], "pos_b": own("b")["pos"], "id_b": own("b")["feature_id"]})
    swap = F.col("pos_a") > F.col("pos_b")
    return j.select(
        F.col("ds_a").alias("dataset"), F.when(swap, F.col("id_b")).otherwise(F.col("id_a")).alias("feature_id"),
        F.when(swap, F.col("id_a")).otherwise(F.col("id_b")).alias("other_id"),
        F.least("pos_a", "pos_b").alias("pos"), "shared_area", "x", "y")


def check_overlaps(features: DataFrame, size: float, min_area: float = 1e-6, **kw) -> DataFrame:
    o = overlap_areas(features, size, min_area, **kw)
    msg = F.concat(F.lit("Feature "), F.col("feature_id").cast("string"), F.lit(" shares area with "), F.col("other_id").cast("string"), F.lit(": "), F.col("shared_area").cast("string"))
    return finding(o, "Topology.Overlap", ERROR, "Topology", msg, feature_id=F.col("feature_id"), x=F.col("x"), y=F.col("y"),
                   pos=F.col("pos"), remediation=F.lit("Snap the common boundary or clip one of the two."))


def free_ends(features: DataFrame, tol: float = 0.001) -> DataFrame:
    """Ends of open paths that no other feature's end lies within ``tol`` of."""
    d = features.where(G.base_kind("geom") == G.LINE).select("dataset", "feature_id", "pos", F.explode("geom.parts").alias("p"))
    path = F.get("p", F.lit(0))
    d = d.where((F.size(path) >= 2) & ~G.is_closed(path))
    end = lambda v, w: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.lit(w).alias("which"))
    ends = d.select("dataset", "feature_id", "pos", F.explode(F.array(
        end(F.get(path, F.lit(0)), "start"), end(F.element_at(path, -1), "end"))).alias("e")).select("dataset", "feature_id", "pos", "e.*")
    # One row per place: two features there connect each other, however many meet.
    place = ends.groupBy("dataset", "x", "y").agg(F.min("feature_id").alias("lo"), F.max("feature_id").alias("hi"))
    lone = place.where(F.col("lo") == F.col("hi")).select("dataset", "x", "y", F.col("lo").alias("own"))
    span = lambda v: F.sequence(S._cell(v - tol, tol), S._cell(v + tol, tol))
    probe = lone.withColumn("_cx", F.explode(span(F.col("x")))).withColumn("_cy", F.explode(span(F.col("y"))))
    near = place.select(F.col("dataset"), F.col("x").alias("nx"), F.col("y").alias("ny"), "lo", "hi",
                        S._cell("x", tol).alias("_cx"), S._cell("y", tol).alias("_cy"))
    dx, dy = F.col("x") - F.col("nx"), F.col("y") - F.col("ny")
    met = probe.join(near, ["dataset", "_cx", "_cy"]).where(
        ((F.col("lo") != F.col("own")) | (F.col("hi") != F.col("own"))) & (F.sqrt(dx * dx + dy * dy) <= tol))
    free = lone.join(met.select("dataset", "x", "y"), ["dataset", "x", "y"], "left_anti")
    return ends.join(free.select("dataset", "x", "y"), ["dataset", "x", "y"], "left_semi")


def check_dangles(features: DataFrame, tol: float = 0.001) -> DataFrame:
    e = free_ends(features, tol)
    msg = F.format_string("The %s of feature %s meets no other line", F.col("which"), F.col("feature_id").cast("string"))
    return finding(e, "Topology.Dangle", WARN, "Topology", msg, feature_id=F.col("feature_id"), x=F.col("x"), y=F.col("y"),
                   pos=F.col("pos"), remediation=F.lit("Snap the end to the line it should join."))


def thinness(area, perimeter) -> Column:
    return 4.0 * math.pi * area / (perimeter * perimeter)


def check_slivers(features: DataFrame, max_thinness: float = 0.01, max_area: float = 10.0) -> DataFrame:
    d = features.where(G.base_kind("geom") == G.POLYGON)
    d = G.pin(d, _a=G.st_area("geom"), _p=G.st_length("geom"))
    d = d.where((F.col("_a") > 0) & (F.col("_p") > 0) & (F.col("_a") <= max_area))
    d = d.withColumn("_t", thinness(F.col("_a"), F.col("_p"))).where(F.col("_t") <= max_thinness)
    c = G.st_centroid("geom")
    msg = F.format_string("Feature %s is a sliver: area %.6f, thinness %.6f", F.col("feature_id").cast("string"), F.col("_a"), F.col("_t"))
    return finding(d, "Topology.Sliver", WARN, "Topology", msg, feature_id=F.col("feature_id"), x=c["x"], y=c["y"], pos=F.col("pos"),
                   remediation=F.lit("Snap the neighbouring boundaries."))


# --- attributes ---------------------------------------------------------------------------------------

def check_required(features: DataFrame, fields: DataFrame, required: list[str]) -> DataFrame:
    """One finding per missing schema field, else one per feature whose value is null or empty."""
    rule = "Attribute.RequiredField"
    named = fields.groupBy("dataset").agg(F.collect_set(F.lower("name")).alias("_named"))
    every = features.select("dataset").union(fields.select("dataset")).distinct()  # a dataset without fields lacks them all
    have = every.join(named, "dataset", "left").select("dataset", F.coalesce("_named", F.array().cast("array<string>")).alias("_have"))
    wanted = F.array(*[F.lit(r) for r in required]).cast("array<string>")
    absent = have.select("dataset", F.explode(F.filter(wanted, lambda r: ~F.array_contains(F.col("_have"), F.lower(r)))).alias("f"))
    schema = finding(absent, rule, ERROR, "Attribute", F.concat(F.lit("Required field is not in the schema: "), F.col("f")), field=F.col("f"),
                     remediation=F.lit("Map a source attribute onto this field."))
    blank = F.filter(F.array(*[F.struct(F.lit(r).alias("name"), (~_nonempty(attr("attrs", r))).alias("blank")) for r in required]),
                     lambda e: e["blank"])
    rows = features.select("dataset", "feature_id", "pos", F.explode(blank).alias("e"))
    rows = join_dealt(rows, have, "dataset", ["feature_id", "pos"])
    rows = rows.where(F.array_contains("_have", F.lower("e.name")))
    per_row = finding(rows, rule, ERROR, "Attribute", F.concat(F.lit("No value for required field "), F.col("e.name")),
                      feature_id=F.col("feature_id"), field=F.col("e.name"), pos=F.col("pos"))
    return schema.unionByName(per_row)


def repeated_values(values: DataFrame) -> DataFrame:
    """Rows of ``dataset, feature_id, pos, field, value`` after the first of a value, with the ``first`` and how many ``copies`` follow it."""
    owner = values.groupBy("dataset", "field", "value").agg(
        (F.count("*") - 1).alias("copies"), F.min(F.struct("pos", "feature_id")).alias("first")).where(F.col("copies") > 0)
    return values.join(owner, ["dataset", "field", "value"]).where(F.struct("pos", "feature_id") != F.col("first"))


def check_unique(features: DataFrame, unique: list[str]) -> DataFrame:
    """Later rows that repeat a non-empty value, each with the first owner; values compare by case."""
    pairs = F.filter(F.array(*[F.struct(F.lit(u).alias("field"), attr("attrs", u).alias("value")) for u in unique]),
                     lambda e: _nonempty(e["value"]))
    long = features.select("dataset", "feature_id", "pos", F.explode(pairs).alias("e")).select("dataset", "feature_id", "pos", "e.*")
    dup = repeated_values(long)
    msg = F.concat(F.lit("Value "), F.col("value"), F.lit(" already belongs to "), F.col("first.feature_id"))
    return finding(dup, "Attribute.DuplicateValue", ERROR, "Attribute", msg, feature_id=F.col("feature_id"), field=F.col("field"),
                   pos=F.col("pos"), remediation=F.lit("Renumber one feature or drop the uniqueness requirement."))


def check_format_limits(features: DataFrame, fields: DataFrame, name_limit: int = 10, text_limit: int = 254) -> DataFrame:
    """Names longer than the target allows, names that become equal when cut, and long text values."""
    rule = "Export.FormatLimit"
    long_name = fields.where(F.length("name") > name_limit)
    out = finding(long_name, rule, WARN, "Export", F.concat(F.lit("Field name is too long: "), F.col("name")), field=F.col("name"),
                  pos=F.col("ordinal"))
    cut = fields.withColumn("_k", F.lower(F.substring("name", 1, name_limit)))
    w = W.partitionBy("dataset", "_k").orderBy("ordinal", "name")
    clash = cut.withColumn("_o", F.first("name").over(w)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > 1)
    out = out.unionByName(finding(
        clash, rule, ERROR, "Export", F.concat(F.lit("Merges with field "), F.col("_o"), F.lit(" after truncation")), field=F.col("name"),
        pos=F.col("ordinal"), remediation=F.lit("Rename one of the two fields.")))
    wide = F.filter(F.map_entries("attrs"), lambda e: F.length(e["value"]) > text_limit)
    rows = features.select("dataset", "feature_id", "pos", F.explode(wide).alias("e"))
    text = fields.where(F.col("data_type") == "Text").select("dataset", F.lower("name").alias("_f"))
    rows = rows.withColumn("_f", F.lower("e.key")).join(text, ["dataset", "_f"], "left_semi")
    return out.unionByName(finding(
        rows, rule, WARN, "Export", F.format_string("Text of %d characters would be cut", F.length("e.value")),
        feature_id=F.col("feature_id"), field=F.col("e.key"), pos=F.col("pos"),
        remediation=F.lit("Shorten the value or deliver in a format without the limit.")))


def check_sparse(features: DataFrame, fields: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Fields empty on at least ``threshold`` of the features; a threshold of one or more disables it."""
    if threshold >= 1.0:
        fields = fields.limit(0)
    filled = F.array_distinct(F.transform(F.filter(F.map_entries("attrs"), lambda e: F.length(e["value"]) > 0), lambda e: F.lower(e["key"])))
    # One pass: each feature counts for itself (no name) and for every name it fills.
    names = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(filled, F.array().cast("array<string>")))
    seen = features.select("dataset", F.explode(names).alias("_f")).groupBy("dataset", "_f").agg(F.count("*").alias("_c"))
    named = F.filter(F.collect_list(F.struct("_f", "_c")), lambda e: e["_f"].isNotNull())
    seen = seen.groupBy("dataset").agg(F.sum(F.when(F.col("_f").isNull(), F.col("_c"))).alias("_n"), F.map_from_entries(named).alias("_by"))
    d = fields.withColumn("_f", F.lower("name")).join(seen, "dataset").withColumn("_filled", F.try_element_at("_by", F.col("_f")))
    ratio = (F.col("_n") - F.coalesce("_filled", F.lit(0))) / F.col("_n")
    d = d.withColumn("_r", ratio).where(F.col("_r") >= threshold)
    return finding(d, "Dataset.Integrity", INFO, "Attribute", F.format_string("Field %s is empty on %.4f of features", F.col("name"), F.col("_r")),
                   "Attribute.SparseField", field=F.col("name"), pos=F.col("ordinal"),
                   remediation=F.lit("Check the attribute mapping."))


# --- coordinate ranges, integrity, hosts -----------------------------------------------------------------

def check_crs_range(features: DataFrame, datasets: DataFrame, sample: int = 5) -> DataFrame:
    """Geographic extents beyond the globe, and projected extents centred on the origin.

    ``datasets`` carries ``dataset, crs, is_geographic``.
    """
    rule = "Crs.CoordinateOutOfRange"
    f = G.with_envelope(features.select("dataset", "feature_id", "pos", "geom")).where(F.col("minx").isNotNull())
    ext = f.groupBy("dataset").agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
    ext = ext.join(datasets, "dataset")
    over = (F.abs("minx") > 180) | (F.abs("maxx") > 180) | (F.abs("miny") > 90) | (F.abs("maxy") > 90)
    out = finding(ext.where(F.col("is_geographic") & over), rule, CRITICAL, "Crs",
                  F.concat(F.col("crs"), F.lit(" is geographic but the extent leaves the globe")),
                  remediation=F.lit("Set the true source system."))
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    near = ~F.col("is_geographic") & (F.abs(cx) < 1000) & (F.abs(cy) < 1000)
    out = out.unionByName(finding(ext.where(near), rule, ERROR, "Crs", F.concat(F.lit("The extent is centred on the origin of "), F.col("crs")),
                                  x=cx, y=cy, remediation=F.lit("The drawing was probably never georeferenced.")))
    bad = f.where(over).join(datasets.where("is_geographic"), "dataset")
    first = F.get(F.filter(G.vertices("geom"), lambda v: (F.abs(v["x"]) > 180) | (F.abs(v["y"]) > 90)), F.lit(0))
    top = bad.withColumn("_rn", F.row_number().over(W.partitionBy("dataset").orderBy("pos"))).where(F.col("_rn") <= sample)
    return out.unionByName(finding(
        top, rule, CRITICAL, "Crs", F.concat(F.lit("Out-of-range coordinate on feature "), F.col("feature_id")),
        feature_id=F.col("feature_id"), x=first["x"], y=first["y"], pos=F.col("pos")))


HOSTED = ("Door", "Window", "IfcDoor", "IfcWindow")  # fixed values, exact case


def check_missing_host(semantic: DataFrame, rels: DataFrame) -> DataFrame:
    """Doors and windows that own no BelongsTo edge; ``semantic`` carries ``dataset, feature_id, category``."""
    hosted = rels.where(F.col("rel_type") == "BelongsTo").select(F.col("owner_id").alias("feature_id"))
    d = semantic.where(F.col("category").isin(*HOSTED)).join(hosted, "feature_id", "left_anti")
    return finding(d, "Semantic.MissingHost", WARN, "Attribute", F.concat(F.col("category"), F.lit(" has no host: "), F.col("feature_id")),
                   feature_id=F.col("feature_id"))


def check_integrity(features: DataFrame, datasets: DataFrame, unclassified: str = "Unclassified") -> DataFrame:
    """Empty dataset, count of features without geometry, unclassified dataset."""
    n = features.groupBy("dataset").agg(
        F.count("*").alias("n"), F.count_if(F.col("geom").isNull() | G.is_empty("geom")).alias("bare"))
    d = datasets.select("dataset").join(n, "dataset", "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "bare": F.coalesce("bare", F.lit(0))})
    e = lambda sev, cat, code, msg: F.struct(F.lit(sev).alias("s"), F.lit(cat).alias("cat"), F.lit(code).alias("code"), msg.alias("m"))
    rule = "Dataset.Integrity"
    faults = F.when(F.col("n") == 0, F.array(e(WARN, "SourceIntegrity", rule, F.lit("The dataset has no features")))).otherwise(F.array_compact(F.array(
        F.when(F.col("bare") > 0, e(WARN, "SourceIntegrity", rule, F.format_string("%d of %d features have no geometry", "bare", "n"))),
        F.when(F.lower("dataset") == unclassified.lower(), e(WARN, "Classification", "Classification.Unclassified",
                                                             F.format_string("%d features were not classified", "n"))))))
    d = d.select("dataset", F.explode(faults).alias("e"))
    return finding(d, rule, F.col("e.s"), F.col("e.cat"), F.col("e.m"), F.col("e.code"))


# --- engine policy ------------------------------------------------------------------------------------------

def cap_findings(findings: DataFrame, n: int = 500) -> DataFrame:
    """First ``n`` findings per (rule, dataset) and one notice where more existed.

    The rank filter is pushed below the shuffle, so each task sends at most ``n + 1`` rows per group (for
    limits up to ``spark.sql.optimizer.windowGroupLimitThreshold``); the row past the limit is itself the
    proof that more existed and becomes the notice.
    """
    w = W.partitionBy("rule", "dataset").orderBy(F.col("pos").asc_nulls_first(), "code", "feature_id", "message")
    d = findings.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n + 1)
    notice = {"severity": F.lit(INFO), "code": F.lit("QaQc.FindingsTruncated"), "message": F.concat(F.lit("Findings suppressed after the limit for "), F.col("rule")),
              "dataset": F.col("dataset"), "rule": F.col("rule"), "category": F.col("category")}
    over = F.col("_rn") == n + 1
    return d.select(*[F.when(over, notice.get(c, F.lit(None)).cast(t)).otherwise(F.col(c)).alias(c) for c, t in FINDING])


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def at_or_above(findings: DataFrame, severity: int) -> DataFrame:
    return findings.where(F.col("severity") >= severity)


def in_report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.col("severity").desc(), "code")


def report_summary(findings: DataFrame, fail_at: int = CRITICAL, keys: list[str] | None = None) -> DataFrame:
    """Counts by severity, the highest one and whether it stays below ``fail_at``."""
    keys = keys or []
    out = findings.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == i).alias(s.lower()) for i, s in enumerate(SEVERITIES)],
        F.coalesce(F.max("severity"), F.lit(0)).alias("highest"))
    return out.withColumn("acceptable", (F.col("total") == 0) | (F.col("highest") < fail_at))


def summary_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity, by severity and category, and in total, in one pass."""
    return findings.rollup("severity", "category").agg(F.count("*").alias("n"))


def active_rules(rules: DataFrame, disabled: list[str]) -> DataFrame:
    """First declaration of each id, ignoring case, without disabled ones, in id order."""
    off = [d.lower() for d in disabled]
    w = W.partitionBy(F.lower("rule_id")).orderBy("pos")
    d = rules.where(~F.lower("rule_id").isin(*off)) if off else rules
    return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn").orderBy("rule_id")


@dataclass
class QaContext:
    """Frames a rule may read."""

    features: DataFrame
    datasets: DataFrame
    fields: DataFrame | None = None
    semantic: DataFrame | None = None
    rels: DataFrame | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Rule:
    """A validation rule: an id, a category, whether it needs the whole dataset, and a function of the context."""

    rule_id: str
    category: str
    validate: Callable[[QaContext], DataFrame]
    whole_dataset: bool = False


def default_rules(size: float = 50.0) -> list[Rule]:
    opt = lambda c, k, v: c.options.get(k, v)
    return [
        Rule("Geometry.Check", "Geometry", lambda c: check_geometry(c.features)),
        Rule("Topology.Overlap", "Topology", lambda c: check_overlaps(
            G.with_envelope(c.features), size, opt(c, "min_overlap", 1e-6)), True),
        Rule("Topology.Dangle", "Topology", lambda c: check_dangles(c.features, opt(c, "dangle_tolerance", 0.001)), True),
        Rule("Topology.Sliver", "Topology", lambda c: check_slivers(c.features)),
        Rule("Attribute.RequiredField", "Attribute", lambda c: check_required(c.features, c.fields, opt(c, "required", []))),
        Rule("Attribute.DuplicateValue", "Attribute", lambda c: check_unique(c.features, opt(c, "unique", [])), True),
        Rule("Export.FormatLimit", "Export", lambda c: check_format_limits(c.features, c.fields)),
        Rule("Crs.CoordinateOutOfRange", "Crs", lambda c: check_crs_range(c.features, c.datasets)),
        Rule("Dataset.Integrity", "SourceIntegrity", lambda c: check_integrity(c.features, c.datasets).unionByName(
            check_sparse(c.features, c.fields)), True),
        Rule("Semantic.MissingHost", "Attribute", lambda c: check_missing_host(c.semantic, c.rels), True),
    ]


def run_qa(ctx: QaContext, rules: list[Rule], disabled: list[str] = (), limit: int = 500, ceiling: int | None = None,
           isolate: bool = False) -> DataFrame:
    """Run rules in id order over all datasets and cap their findings.

    A rule that cannot be planned becomes an error finding and the others still run.  ``isolate`` also
    materialises each rule alone so that a failure at run time is contained the same way.  ``ceiling``
    skips whole-dataset rules on datasets above that many features and says so; Spark needs none.
    """
    if not rules:
        raise ValueError("no validation rules are registered")
    off = {d.lower() for d in disabled}
    chosen: dict[str, Rule] = {}
    for r in rules:
        if r.rule_id.lower() not in off:
            chosen.setdefault(r.rule_id.lower(), r)
    from .common import cut_lineage

    spark = ctx.features.sparkSession
    small = ctx
    parts = []
    if ceiling is not None:
        n = ctx.features.groupBy("dataset").agg(F.count("*").alias("_n"))
        over = n.where(F.col("_n") > ceiling)
        parts.append(finding(over, "QaQc.TopologySkipped", INFO, "Topology", F.format_string("%d features exceed the ceiling", "_n")))
        drop = lambda df: df.join(over, "dataset", "left_anti") if df is not None and "dataset" in df.columns else df
        small = QaContext(drop(ctx.features), drop(ctx.datasets), drop(ctx.fields), drop(ctx.semantic), ctx.rels, ctx.options)
    for r in sorted(chosen.values(), key=lambda r: r.rule_id):
        try:
            out = r.validate(small if r.whole_dataset else ctx)
            parts.append(cut_lineage(out) if isolate else out)
        except Exception as e:  # noqa: BLE001 - a broken rule must not lose the others' findings
            one = spark.range(1).select(F.lit("*").alias("dataset"))
            parts.append(finding(one, r.rule_id, ERROR, r.category, F.lit(f"Rule failed: {type(e).__name__}"), "QaQc.RuleFailed"))
    return cap_findings(union_findings(*parts), limit)
