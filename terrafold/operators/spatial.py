"""Spatial joins written as equi-joins on grid cells.

Each side is exploded into the cells its envelope touches, joined on the cell and refined.  A pair is
kept only in the cell that holds the lower-left corner of the two envelopes' intersection, so no
``distinct`` follows.  Cells whose pair count is high are split into finer ones before the join, by a
count per cell that reads envelopes only; piles at one location are left to adaptive skew joins or,
where the operator allows it, collapsed to one row per location beforehand.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geodesy as D
from ..functions import geometry as G
from .common import GROWS

BOX = ("minx", "miny", "maxx", "maxy")


def _cell(c, size) -> Column:
    return F.floor(G._c(c) / size).cast("long")


def cells(df: DataFrame, size: float, box=BOX) -> DataFrame:
    """One row per (row, touched cell) as ``_cx, _cy``; rows without an envelope vanish."""
    a, b, c, d = (G._c(v) for v in box)
    return (
        df.where(a.isNotNull() & b.isNotNull())
        .withColumn("_cx", F.explode(F.sequence(_cell(a, size), _cell(c, size))))
        .withColumn("_cy", F.explode(F.sequence(_cell(b, size), _cell(d, size))))
    )


def _hot_cells(left, right, size, lbox, rbox, target, max_level) -> DataFrame:
    """Cells whose candidate pairs exceed ``target`` squared, with the split depth each needs."""
    count = lambda df, box, name: cells(df.select(*[G._c(v).alias(n) for v, n in zip(box, BOX)]), size) \
        .groupBy("_cx", "_cy").agg(F.count("*").alias(name))
    n = count(left, lbox, "_nl").join(count(right, rbox, "_nr"), ["_cx", "_cy"])
    pairs = F.col("_nl").cast("double") * F.col("_nr")
    level = F.ceil(F.log2(F.sqrt(pairs) / target) / 2.0).cast("int")
    return n.where(pairs > float(target) ** 2).select(
        "_cx", "_cy", F.least(F.lit(max_level), F.greatest(F.lit(1), level)).alias("_lv"))


def _split(cell_rows: DataFrame, hot: DataFrame, size: float, box) -> DataFrame:
    """Move rows of hot cells into sub-cells ``(_lv, _sx, _sy)``; other cells keep level 0."""
    d = cell_rows.join(hot, ["_cx", "_cy"], "left").withColumn("_lv", F.coalesce("_lv", F.lit(0)))
    n = F.pow(F.lit(2.0), F.col("_lv")).cast("long")
    sub = F.lit(float(size)) / n
    a, b, c, e = (G._c(v) for v in box)
    span = lambda lo, hi, base: F.sequence(
        F.greatest(F.floor(lo / sub).cast("long"), base * n), F.least(F.floor(hi / sub).cast("long"), base * n + n - 1))
    return (
        d.withColumn("_sx", F.explode(span(a, c, F.col("_cx"))))
        .withColumn("_sy", F.explode(span(b, e, F.col("_cy"))))
    )


def box_pairs(left: DataFrame, right: DataFrame, size: float, lbox=BOX, rbox=BOX,
              split_above: int | None = 4096, max_level: int = 8, met: Column | None = None) -> DataFrame:
    """Every (left, right) pair whose envelopes intersect, edges included, each exactly once.

    The two sides must not share column names.  ``split_above`` is the number of rows per side at
    which a cell is split; ``None`` skips the counting pass.  ``met``, a test of a pair, asks for the left rows only that have
    such a pair in a cell, once per cell: a row is done with its first one, so no pairs are made.
    """
    l, r = cells(left, size, lbox), cells(right, size, rbox).withColumnsRenamed({"_cx": "_rx", "_cy": "_ry"})
    la, lb, lc, ld = (G._c(v) for v in lbox)
    ra, rb, rc, rd = (G._c(v) for v in rbox)
    cornerx, cornery = F.greatest(la, ra), F.greatest(lb, rb)
    touch = (la <= rc) & (lc >= ra) & (lb <= rd) & (ld >= rb)
    if split_above is None:
        on = (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))
        if met is not None:
            return l.hint(GROWS).join(r, on & touch & met, "left_semi").drop("_cx", "_cy")
        own = (_cell(cornerx, size) == F.col("_cx")) & (_cell(cornery, size) == F.col("_cy"))
        return l.hint(GROWS).join(r, on & touch & own).drop("_cx", "_cy", "_rx", "_ry")
    hot = _hot_cells(left, right, size, lbox, rbox, split_above, max_level)
    ls = _split(l, hot, size, lbox)
    rs = _split(r.withColumnsRenamed({"_rx": "_cx", "_ry": "_cy"}), hot, size, rbox).withColumnsRenamed(
        {"_cx": "_rx", "_cy": "_ry", "_lv": "_rl", "_sx": "_tx", "_sy": "_ty"})
    sub = F.lit(float(size)) / F.pow(F.lit(2.0), F.col("_lv"))
    on = (
        (F.col("_lv") == F.col("_rl")) & (F.col("_sx") == F.col("_tx")) & (F.col("_sy") == F.col("_ty"))
    )
    if met is not None:
        return ls.hint(GROWS).join(rs, on & touch & met, "left_semi").drop("_cx", "_cy", "_lv", "_sx", "_sy")
    own = (F.floor(cornerx / sub).cast("long") == F.col("_sx")) & (F.floor(cornery / sub).cast("long") == F.col("_sy"))
    return ls.hint(GROWS).join(rs, on & touch & own).drop(
        "_cx", "_cy", "_rx", "_ry", "_lv", "_rl", "_sx", "_sy", "_tx", "_ty")


# --- predicates ----------------------------------------------------------------------------------

PREDICATES = ("intersects", "touches", "within", "contains", "overlaps", "crosses", "disjoint")


def box_predicate(name: str, a: tuple, b: tuple) -> Column:
    """Named predicate between two axis-aligned rectangles of positive area; ``a`` is the left operand."""
    ax0, ay0, ax1, ay1 = (G._c(v) for v in a)
    bx0, by0, bx1, by1 = (G._c(v) for v in b)
    meet = (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)
    inner = (ax0 < bx1) & (ax1 > bx0) & (ay0 < by1) & (ay1 > by0)
    a_in_b = (ax0 >= bx0) & (ax1 <= bx1) & (ay0 >= by0) & (ay1 <= by1)
    b_in_a = (bx0 >= ax0) & (bx1 <= ax1) & (by0 >= ay0) & (by1 <= ay1)
    return {
        "intersects": meet, "touches": meet & ~inner, "within": a_in_b, "contains": b_in_a,
        "overlaps": inner & ~a_in_b & ~b_in_a, "crosses": F.lit(False), "disjoint": ~meet,
    }[name]


def is_rectangle(geom: str = "geom", box=BOX) -> Column:
    """One ring of five vertices that follows the sides of its envelope."""
    x0, y0, x1, y1 = (G._c(c) for c in box)
    part = F.get(F.col(geom)["parts"], F.lit(0))
    ring = F.get(part, F.lit(0))
    corner = lambda v: ((v["x"] == x0) | (v["x"] == x1)) & ((v["y"] == y0) | (v["y"] == y1))
    side = lambda a, b: (a["x"] == b["x"]) != (a["y"] == b["y"])
    return F.coalesce(
        (F.size(F.col(geom)["parts"]) == 1) & (F.size(part) == 1) & (F.size(ring) == 5) & G.is_closed(ring) & F.forall(ring, corner)
        & F.forall(G.edges_of(ring, side), lambda e: e) & (G.ring_signed_area(ring) != 0), F.lit(False))


def point_in_rings(rings: Column, x, y) -> Column:
    """``1`` inside, ``0`` on the boundary, ``-1`` outside, by the even-odd rule over all rings."""
    x, y = G._c(x), G._c(y)

    def edge(a, b):
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        on = (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) \
            & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        up = (a["y"] <= y) & (b["y"] > y) & (cross > 0)
        down = (b["y"] <= y) & (a["y"] > y) & (cross < 0)
        return F.when(on, F.lit(1000000)).when(up | down, F.lit(1)).otherwise(F.lit(0))

    hits = F.aggregate(
        F.flatten(F.transform(rings, lambda r: G.edges_of(r, edge))), F.lit(0), lambda s, v: s + v)
    return G.let(hits, lambda n: F.when(n >= 1000000, 0).when(n % 2 == 1, 1).otherwise(-1))


def point_in_polygon(g, x, y) -> Column:
    return point_in_rings(G.rings(G._c(g)), x, y)


def spatial_join(left: DataFrame, right: DataFrame, predicate: str, size: float,
                 lbox=BOX, rbox=BOX, exact: Column | None = None, **kw) -> DataFrame:
    """Pairs for which ``left predicate right`` holds.

    For rows that are rectangles; ``arrangement.geometry_join`` answers for any geometry.  ``exact`` replaces
    the rectangle test by any column over the candidate pair.  ``disjoint`` is not a pair join: it returns the
    left rows that meet no right row.
    """
    if predicate == "disjoint":
        keyed = left.where(G._c(lbox[0]).isNotNull())
        met = box_pairs(keyed, right, size, lbox, rbox, met=exact if exact is not None else box_predicate("intersects", lbox, rbox), **kw)
        return keyed.join(met.select(left.columns[0]).distinct(), left.columns[0], "left_anti")
    pairs = box_pairs(left, right, size, lbox, rbox, **kw)
    return pairs.where(exact if exact is not None else box_predicate(predicate, lbox, rbox))


def bbox_join(left: DataFrame, boxes: DataFrame, size: float, lbox=BOX, rbox=BOX, **kw) -> DataFrame:
    return box_pairs(left, boxes, size, lbox, rbox, **kw)


def disjoint_from(df: DataFrame, box: tuple[float, float, float, float], cols=BOX) -> DataFrame:
    """Rows disjoint from one query rectangle: a plain filter."""
    return df.where(G._c(cols[0]).isNotNull() & box_predicate("disjoint", cols, tuple(F.lit(float(v)) for v in box)))


# --- radius --------------------------------------------------------------------------------------

def radius_join(left: DataFrame, right: DataFrame, radius: float, lxy=("lx", "ly"), rxy=("rx", "ry"),
                geographic: bool = False, out: str = "distance") -> DataFrame:
    """Point pairs no farther apart than ``radius`` (metres when geographic), with the distance.

    A radius of zero pairs points of equal coordinates.
    """
    lx, ly, rx, ry = (G._c(c) for c in (*lxy, *rxy))
    if not radius >= 0:
        raise ValueError("the radius must not be negative")
    if radius == 0:
        return left.join(right, (lx == rx) & (ly == ry)).withColumn(out, F.lit(0.0))
    if not geographic:
        l = left.withColumn("_cx", F.explode(F.sequence(_cell(lx - radius, radius), _cell(lx + radius, radius)))) \
                .withColumn("_cy", F.explode(F.sequence(_cell(ly - radius, radius), _cell(ly + radius, radius))))
        r = right.withColumn("_rx", _cell(rx, radius)).withColumn("_ry", _cell(ry, radius))
        dist = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry))
        j = l.join(r, (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry")))
        return j.withColumn(out, dist).where(F.col(out) <= radius).drop("_cx", "_cy", "_rx", "_ry")
    # Latitude bands of one radius; each band has its own whole number of longitude cells, so the
    # cells a search touches stay few at any latitude and wrap at the antimeridian.
    ang = radius / D.EARTH_RADIUS_M
    dlat = math.degrees(ang) * (1 + 1e-9) + 1e-12
    band = lambda lat: F.floor((lat + 90.0) / dlat).cast("long")

    def n_cells(b):
        far = F.greatest(F.abs(b * dlat - 90.0), F.abs((b + 1) * dlat - 90.0))
        return F.greatest(F.lit(1.0), F.floor(360.0 / dlat * F.cos(F.radians(F.least(far, F.lit(90.0)))))).cast("long")

    cell = lambda lon, n: F.floor((lon + 180.0) / 360.0 * n).cast("long")
    reach = F.when(F.abs(ly) + dlat >= 90.0, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(ang, math.pi / 2)) / F.cos(F.radians(ly))))) * (1 + 1e-9) + 1e-9)
    l = (
        left.withColumn("_b", F.explode(F.sequence(band(ly - dlat), band(ly + dlat))))
        .withColumn("_n", n_cells(F.col("_b"))).withColumn("_w", reach)
        .withColumn("_lo", cell(lx - F.col("_w"), F.col("_n")))
        .withColumn("_hi", F.least(cell(lx + F.col("_w"), F.col("_n")), F.col("_lo") + F.col("_n") - 1))
        .withColumn("_c", F.explode(F.transform(F.sequence("_lo", "_hi"), lambda i: F.pmod(i, F.col("_n")))))
        .drop("_n", "_w", "_lo", "_hi")
    )
    rb = band(ry)
    r = right.withColumn("_rb", rb).withColumn("_rc", F.pmod(cell(rx, n_cells(F.col("_rb"))), n_cells(F.col("_rb"))))
    j = l.join(r, (F.col("_b") == F.col("_rb")) & (F.col("_c") == F.col("_rc")))
    return (
        j.withColumn(out, D.geodesic_distance(lx, ly, rx, ry)).where(F.col(out) <= radius)
        .drop("_b", "_c", "_rb", "_rc")
    )


# --- k nearest -------------------------------------------------------------------------------------

def knn_join(left: DataFrame, right: DataFrame, k: int, size: float, lid: str = "lid", rid: str = "rid",
             lxy=("lx", "ly"), rxy=("rx", "ry"), geographic: bool = False, cell_rows: int | None = None) -> DataFrame:
    """Exact k nearest right points of every left point, ties by ``rid``.

    A pyramid of right counts gives each left cell the smallest ancestor with ``k`` points, hence a
    distance no answer can exceed.  Ancestor neighbours are opened into children, nearest first, until
    every cell left holds at most ``cell_rows`` rows.  Search is planar; ``geographic`` reports the
    sphere's distance, as the planar index of a geographic system does.
    """
    cell_rows = cell_rows or max(64, 4 * k)
    lx, ly, rx, ry = (F.col(c) for c in (*lxy, *rxy))
    pile = W.partitionBy(rx, ry).orderBy(rid)
    right = right.withColumn("_p", F.row_number().over(pile)).where(F.col("_p") <= k).drop("_p")
    fine = right.groupBy(_cell(rx, size).alias("x"), _cell(ry, size).alias("y")).agg(F.count("*").alias("n"))
    lim = fine.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    llim = left.agg(F.min(_cell(lx, size)), F.min(_cell(ly, size)), F.max(_cell(lx, size)), F.max(_cell(ly, size))).first()
    if lim[0] is None or llim[0] is None:
        return left.join(right, F.lit(False)).withColumn("distance", F.lit(None).cast("double")).withColumn(
            "rank", F.lit(None).cast("int"))
    x0, y0 = min(lim[0], llim[0]), min(lim[1], llim[1])
    top = max(1, math.ceil(math.log2(max(lim[2], llim[2], lim[3], llim[3], x0 + 1, y0 + 1) - min(x0, y0) + 1)) + 1)
    up = lambda v, base, lv: F.floor((v - base) / F.pow(F.lit(2.0), lv)).cast("long")
    ladder = fine.withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(top))))
    pyramid = ladder.groupBy(
        "lv", up(F.col("x"), x0, F.col("lv")).alias("px"), up(F.col("y"), y0, F.col("lv")).alias("py")
    ).agg(F.sum("n").alias("n"))

    lcell = left.select(lid, lx.alias("_x"), ly.alias("_y"), _cell(lx, size).alias("x"), _cell(ly, size).alias("y"))
    chain = lcell.select("x", "y").distinct().withColumn("lv", F.explode(F.sequence(F.lit(0), F.lit(top))))
    chain = chain.withColumn("px", up(F.col("x"), x0, F.col("lv"))).withColumn("py", up(F.col("y"), y0, F.col("lv")))
    start = chain.join(pyramid, ["lv", "px", "py"]).where(F.col("n") >= k).groupBy("x", "y").agg(F.min("lv").alias("lv"))
    frontier = lcell.join(start, ["x", "y"], "left").withColumn("lv", F.coalesce("lv", F.lit(top)))
    reach = F.when(F.col("lv") < top, 2).otherwise(0)
    around = lambda v, base: F.sequence(up(F.col(v), base, F.col("lv")) - reach, up(F.col(v), base, F.col("lv")) + reach)
    frontier = (
        frontier.withColumn("px", F.explode(around("x", x0))).withColumn("py", F.explode(around("y", y0)))
        .join(pyramid, ["lv", "px", "py"]).select(lid, "_x", "_y", "lv", "px", "py", "n")
    )

    def prune(f):
        """Drop cells nearer cells already outbid: k points lie within the bound."""
        s = F.pow(F.lit(2.0), F.col("lv")) * size
        ox, oy = (F.col("px") * s + x0 * size), (F.col("py") * s + y0 * size)
        gap = lambda v, o: F.greatest(o - v, v - o - s, F.lit(0.0))
        far = lambda v, o: F.greatest(F.abs(v - o), F.abs(v - o - s))
        f = f.withColumn("_lo", gap(F.col("_x"), ox) ** 2 + gap(F.col("_y"), oy) ** 2)
        f = f.withColumn("_hi", far(F.col("_x"), ox) ** 2 + far(F.col("_y"), oy) ** 2)
        run = W.partitionBy(lid).orderBy("_hi", "lv", "px", "py").rowsBetween(W.unboundedPreceding, 0)
        f = f.withColumn("_cum", F.sum("n").over(run))
        f = f.withColumn("_bound", F.min(F.when(F.col("_cum") >= k, F.col("_hi"))).over(W.partitionBy(lid)))
        ok = F.col("_bound").isNull() | (F.col("_lo") <= F.col("_bound") * (1 + 1e-9))
        return f.where(ok).drop("_lo", "_hi", "_cum", "_bound")

    frontier = prune(frontier)
    from .common import cut_lineage

    for _ in range(top):
        big = (F.col("n") > cell_rows) & (F.col("lv") > 0)
        frontier = cut_lineage(frontier)
        if frontier.where(big).limit(1).isEmpty():
            break
        kids = (
            frontier.where(big).drop("n").withColumn("lv", F.col("lv") - 1)
            .withColumn("px", F.explode(F.array(F.col("px") * 2, F.col("px") * 2 + 1)))
            .withColumn("py", F.explode(F.array(F.col("py") * 2, F.col("py") * 2 + 1)))
            .join(pyramid, ["lv", "px", "py"])
        )
        frontier = prune(frontier.where(~big).unionByName(kids.select(*frontier.columns)))

    # Frontier cells back to finest cells, so right rows are never copied per level.
    wanted = frontier.select("lv", "px", "py").distinct()
    fine_of = ladder.drop("n").withColumn("px", up(F.col("x"), x0, F.col("lv"))).withColumn("py", up(F.col("y"), y0, F.col("lv")))
    fine_of = fine_of.join(wanted, ["lv", "px", "py"], "left_semi")
    near = frontier.join(fine_of, ["lv", "px", "py"]).select(lid, "_x", "_y", F.col("x").alias("_fx"), F.col("y").alias("_fy"))
    keyed = right.withColumn("_fx", _cell(rx, size)).withColumn("_fy", _cell(ry, size))
    cand = near.join(keyed, ["_fx", "_fy"])
    d2 = (F.col("_x") - rx) * (F.col("_x") - rx) + (F.col("_y") - ry) * (F.col("_y") - ry)
    rank = F.row_number().over(W.partitionBy(lid).orderBy("_d2", rid))
    best = cand.withColumn("_d2", d2).withColumn("rank", rank).where(F.col("rank") <= k)
    dist = D.geodesic_distance(F.col("_x"), F.col("_y"), rx, ry) if geographic else F.sqrt("_d2")
    best = best.withColumn("distance", dist)
    return best.withColumnsRenamed({"_x": lxy[0], "_y": lxy[1]}).drop("_fx", "_fy", "_d2")


# --- distance between geometries --------------------------------------------------------------------

def point_segment(x, y, a, b) -> Column:
    """``struct<d, x, y>`` of the nearest point on segment ``a-b``."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / F.nullif(len2, F.lit(0.0)))))

    def at(s):
        px, py = a["x"] + s * dx, a["y"] + s * dy
        return F.struct(F.sqrt((px - x) * (px - x) + (py - y) * (py - y)).alias("d"), px.alias("x"), py.alias("y"))

    return G.let(t, at)


def nearest_on_geometry(g, x, y) -> Column:
    """Nearest point of a geometry to ``(x, y)`` as ``struct<d, x, y>``; distance 0 inside a polygon."""
    g, x, y = G._c(g), G._c(x), G._c(y)
    dot = lambda v: F.struct(
        F.sqrt((v["x"] - x) * (v["x"] - x) + (v["y"] - y) * (v["y"] - y)).alias("d"), v["x"].alias("x"), v["y"].alias("y"))
    seg = F.flatten(F.transform(G.rings(g), lambda r: G.edges_of(r, lambda a, b: point_segment(x, y, a, b))))
    best = F.array_min(F.when(G.base_kind(g) == G.POINT, F.transform(G.vertices(g), dot)).otherwise(seg))
    inside = (G.base_kind(g) == G.POLYGON) & (point_in_polygon(g, x, y) >= 0)
    return F.when(inside, F.struct(F.lit(0.0).alias("d"), x.alias("x"), y.alias("y"))).otherwise(best)


def point_distance(g, x, y, geographic: bool = False) -> Column:
    """Distance from a point; geographic systems measure on the sphere to the planar nearest point."""
    x, y = G._c(x), G._c(y)
    n = nearest_on_geometry(g, x, y)
    if not geographic:
        return F.when(~G.is_empty(g), n["d"])
    return F.when(~G.is_empty(g), G.let(n, lambda p: D.geodesic_distance(x, y, p["x"], p["y"])))


def segment_distance(a: DataFrame, b: DataFrame, pair: DataFrame, ga: str = "geom_a", gb: str = "geom_b",
                     keys: list[str] | None = None) -> DataFrame:
    """Planar distance and nearest points of the outlines of geometry pairs ``(id_a, id_b)``."""
    from .nearness import pair_distance

    keys = keys or ["id_a", "id_b"]
    one, two = a.select("id_a", F.col(ga).alias("_ga")), b.select("id_b", F.col(gb).alias("_gb"))
    j = pair.hint(GROWS).join(one, "id_a").hint(GROWS).join(two, "id_b").where(~G.is_empty("_ga") & ~G.is_empty("_gb"))
    found = j.select(*keys, pair_distance("_ga", "_gb").alias("n")).where(F.col("n").isNotNull())
    return found.groupBy(*keys).agg(F.min("n").alias("n")).select(*keys, "n.*")


def closest_points(p1: dict, p2: dict, q1: dict, q2: dict) -> Column:
    """``struct<d, ax, ay, bx, by>`` of segments ``p1-p2`` and ``q1-q2``."""
    pick = lambda n, fx, fy, sx, sy: F.struct(n["d"].alias("d"), fx.alias("ax"), fy.alias("ay"), sx.alias("bx"), sy.alias("by"))
    to_b = lambda p: G.let(point_segment(p["x"], p["y"], q1, q2), lambda n: pick(n, p["x"], p["y"], n["x"], n["y"]))
    to_a = lambda q: G.let(point_segment(q["x"], q["y"], p1, p2), lambda n: pick(n, n["x"], n["y"], q["x"], q["y"]))
    den = (p2["x"] - p1["x"]) * (q2["y"] - q1["y"]) - (p2["y"] - p1["y"]) * (q2["x"] - q1["x"])
    s = ((q1["x"] - p1["x"]) * (q2["y"] - q1["y"]) - (q1["y"] - p1["y"]) * (q2["x"] - q1["x"])) / F.nullif(den, F.lit(0.0))
    t = ((q1["x"] - p1["x"]) * (p2["y"] - p1["y"]) - (q1["y"] - p1["y"]) * (p2["x"] - p1["x"])) / F.nullif(den, F.lit(0.0))
    cx, cy = p1["x"] + s * (p2["x"] - p1["x"]), p1["y"] + s * (p2["y"] - p1["y"])
    crossing = F.when(s.between(0, 1) & t.between(0, 1), F.struct(
        F.lit(0.0).alias("d"), cx.alias("ax"), cy.alias("ay"), cx.alias("bx"), cy.alias("by")))
    return F.array_min(F.array_compact(F.array(crossing, to_b(p1), to_b(p2), to_a(q1), to_a(q2))))


def as_segments(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """Segments of lines and polygons; a point becomes a segment of no length."""
    dot = lambda v: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), v["x"].alias("x2"), v["y"].alias("y2"))
    pair = lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    segs = F.when(G.base_kind(geom) == G.POINT, F.transform(G.vertices(geom), dot)).otherwise(
        F.flatten(F.transform(G.rings(geom), lambda r: G.edges_of(r, pair))))
    return df.select(*keys, F.explode(segs).alias("_s")).select(*keys, "_s.*")


# --- clip ------------------------------------------------------------------------------------------

def clip_to_box(df: DataFrame, box: tuple[float, float, float, float], cols=BOX) -> DataFrame:
    """Rectangles cut by one rectangle; outside or edge-touching rows are dropped, covered rows kept."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
    a, b, c, d = (F.col(v) for v in cols)
    kept = df.where((a < x1) & (c > x0) & (b < y1) & (d > y0))
    covered = (a >= x0) & (c <= x1) & (b >= y0) & (d <= y1)
    return kept.withColumns({
        "covered": covered, cols[0]: F.greatest(a, x0), cols[1]: F.greatest(b, y0),
        cols[2]: F.least(c, x1), cols[3]: F.least(d, y1),
    })


# --- snapping ----------------------------------------------------------------------------------------

SNAP_RANK = {"endpoint": 0, "vertex": 1, "midpoint": 2, "edge": 3}  # order of tests within one feature


def snap_join(probes: DataFrame, features: DataFrame, tol: float, modes=("endpoint", "vertex", "midpoint", "edge"),
              pid: str = "pid", pxy=("px", "py"), fid: str = "fid", geom: str = "geom",
              size: float | None = None) -> DataFrame:
    """Nearest snap target of each probe within ``tol``: ``pid, mode, x, y, distance, fid``.

    Targets at one location collapse to the first feature and mode before the join, so a junction
    shared by many features costs one row.
    """
    size = size or tol
    px, py = F.col(pxy[0]), F.col(pxy[1])
    flat = features.select(fid, G.vertices(geom).alias("_v"), G.base_kind(geom).alias("_k"))
    n = F.size("_v")
    last, first = F.element_at("_v", -1), F.get("_v", F.lit(0))
    at = lambda rank, pos, v: F.struct(F.lit(rank).alias("rank"), pos.cast("int").alias("pos"), v["x"].alias("x"), v["y"].alias("y"))
    sets = []
    if "endpoint" in modes:
        sets.append(F.array(at(0, F.lit(0), first), at(0, F.lit(1), last)))
    if "vertex" in modes:
        sets.append(F.transform("_v", lambda v, i: at(1, i, v)))
    if "midpoint" in modes:
        mids = F.zip_with(G.head(F.col("_v")), G.tail(F.col("_v")), lambda a, b: F.struct(
            ((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))
        sets.append(F.transform(mids, lambda v, i: at(2, i, v)))
    found = []
    probe = probes.select(pid, px.alias("_px"), py.alias("_py"))
    box = lambda by: probe.withColumn("_cx", F.explode(F.sequence(_cell(F.col("_px") - by, size), _cell(F.col("_px") + by, size)))) \
        .withColumn("_cy", F.explode(F.sequence(_cell(F.col("_py") - by, size), _cell(F.col("_py") + by, size))))
    if sets:
        dots = flat.where(n > 0).select(fid, F.explode(F.concat(*sets)).alias("t")).select(fid, "t.*")
        dots = dots.groupBy("x", "y").agg(F.min(F.struct(F.col(fid), "rank", "pos")).alias("o"))
        dots = dots.withColumn("_cx", _cell("x", size)).withColumn("_cy", _cell("y", size))
        dx, dy = F.col("_px") - F.col("x"), F.col("_py") - F.col("y")
        hit = box(tol).join(dots, ["_cx", "_cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= tol)
        found.append(hit.select(pid, "d", F.col("o")[fid].alias("f"), "o.rank", "o.pos", "x", "y"))
    if "edge" in modes:
        segs = as_segments(features, [fid], geom).withColumns({
            "minx": F.least("x1", "x2"), "maxx": F.greatest("x1", "x2"),
            "miny": F.least("y1", "y2"), "maxy": F.greatest("y1", "y2")})
        j = box(tol).join(cells(segs, size), ["_cx", "_cy"])
        A, B = {"x": F.col("x1"), "y": F.col("y1")}, {"x": F.col("x2"), "y": F.col("y2")}
        j = j.select(pid, "_px", "_py", fid, point_segment(F.col("_px"), F.col("_py"), A, B).alias("n"))
        # The foot on a feature is its nearest one; a probe on the feature has distance 0 and no foot.
        foot = j.groupBy(pid, "_px", "_py", fid).agg(F.min("n").alias("n")).where((F.col("n.d") > 0) & (F.col("n.d") <= tol))
        areal = features.where(G.base_kind(geom) == G.POLYGON).select(F.col(fid).alias("_f"), F.col(geom).alias("_g"))
        inside = foot.join(areal, F.col(fid) == F.col("_f")).where(point_in_polygon("_g", "_px", "_py") >= 0).select(pid, fid)
        foot = foot.join(inside, [pid, fid], "left_anti")
        found.append(foot.select(pid, "n.d", F.col(fid).alias("f"), F.lit(3).alias("rank"), F.lit(0).alias("pos"), "n.x", "n.y"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy(pid).agg(F.min(F.struct("d", "f", "rank", "pos", "x", "y")).alias("b"))
    names = F.create_map(*[F.lit(v) for m, r in SNAP_RANK.items() for v in (r, m)])
    return best.select(pid, names[F.col("b.rank")].alias("mode"), "b.x", "b.y", F.col("b.d").alias("distance"), F.col("b.f").alias(fid))
