"""Curves to vertex arrays: arcs, circles, ellipses, bulged polylines and survey arcs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

MIN_SEGMENTS, MAX_SEGMENTS, SURVEY_PER_CIRCLE = 4, 512, 72  # fixed values
STRAIGHT = 1e-9


def segment_count(radius: Column, sweep: Column, tol: float, lo: int = MIN_SEGMENTS, hi: int = MAX_SEGMENTS) -> Column:
    """Segments so that no chord leaves the arc by more than ``tol``."""
    ratio = F.lit(float(tol)) / F.nullif(radius, F.lit(0.0))
    step = F.when(ratio >= 1, F.lit(math.pi)).otherwise(F.acos(1 - F.least(ratio, F.lit(1.0))) * 2)
    need = F.when(step > 0, F.ceil(F.abs(sweep) / F.nullif(step, F.lit(0.0)))).otherwise(F.lit(hi))
    ok = (radius > 0) & (F.abs(sweep) > 0) & ~F.isnan(radius) & ~F.isnan(sweep) & (radius != math.inf) & (F.abs(sweep) != math.inf)
    return F.when(ok, F.greatest(F.lit(lo), F.least(F.lit(hi), need))).otherwise(F.lit(lo)).cast("int")


def ccw_sweep(start: Column, end: Column) -> Column:
    turn = 2 * math.pi
    s = F.pmod(end, F.lit(turn)) - F.pmod(start, F.lit(turn))
    return F.when(s <= 0, s + turn).otherwise(s)


def ellipse_path(cx, cy, major, minor, rotation, start, sweep, tol: float, z=None) -> Column:
    cx, cy, major, minor, rotation, start, sweep = (G._c(v) for v in (cx, cy, major, minor, rotation, start, sweep))
    frame = F.struct(segment_count(major, sweep, tol).alias("n"), start.cast("double").alias("t0"), sweep.cast("double").alias("sw"),
                     F.cos(rotation).alias("c"), F.sin(rotation).alias("s"))

    def path(f):
        def at(k):
            return G.let(f["t0"] + f["sw"] / f["n"] * k, lambda t: G.let(F.struct((major * F.cos(t)).alias("x"), (minor * F.sin(t)).alias("y")), lambda p: G.vertex(
                cx + p["x"] * f["c"] - p["y"] * f["s"], cy + p["x"] * f["s"] + p["y"] * f["c"], z)))

        return F.transform(F.sequence(F.lit(0), f["n"]), at)

    good = (major > 0) & (minor > 0) & (major != math.inf) & ~F.isnan(major)
    return F.when(good, G.let(frame, path)).otherwise(F.array(G.vertex(cx, cy, z)))


def ellipse_frame(major, minor, rotation, start, sweep, tol: float) -> Column:
    """What the vertices of ``ellipse_path`` are worked out from, as ``struct<n, t0, sw, c, s, a, b>``; without ``n`` it is one place."""
    major, minor, rotation, start, sweep = (G._c(v) for v in (major, minor, rotation, start, sweep))
    good = (major > 0) & (minor > 0) & (major != math.inf) & ~F.isnan(major)
    return F.struct(F.when(good, segment_count(major, sweep, tol)).alias("n"), start.cast("double").alias("t0"), sweep.cast("double").alias("sw"),
                    F.cos(rotation).alias("c"), F.sin(rotation).alias("s"), major.alias("a"), minor.alias("b"))


def arc_path(cx, cy, radius, start, sweep, tol: float, z=None) -> Column:
    return ellipse_path(cx, cy, radius, radius, F.lit(0.0), start, sweep, tol, z)


def circle_path(cx, cy, radius, tol: float, z=None) -> Column:
    """Closed exactly: the last vertex is the first."""
    p = arc_path(cx, cy, radius, F.lit(0.0), F.lit(2 * math.pi), tol, z)
    return G.let(p, lambda r: F.when(F.size(r) > 1, F.concat(G.head(r), F.slice(r, 1, 1))).otherwise(r))


def bulge_arc(x1, y1, x2, y2, bulge) -> Column:
    """``struct<cx, cy, r, start, sweep>`` of a bulged segment; null when it is straight."""
    dx, dy = x2 - x1, y2 - y1
    chord = F.sqrt(dx * dx + dy * dy)
    sag = bulge * chord / 2
    radius = (chord * chord / 4 + sag * sag) / F.nullif(sag * 2, F.lit(0.0))
    off = radius - sag
    cx = (x1 + x2) / 2 - dy / F.nullif(chord, F.lit(0.0)) * off
    cy = (y1 + y2) / 2 + dx / F.nullif(chord, F.lit(0.0)) * off
    ok = (F.abs(bulge) >= STRAIGHT) & ~F.isnan(bulge) & (F.abs(bulge) != math.inf) & (chord > 0) & radius.isNotNull()
    return F.when(ok, F.struct(cx.alias("cx"), cy.alias("cy"), F.abs(radius).alias("r"), F.atan2(y1 - cy, x1 - cx).alias("start"), (F.atan(bulge) * 4).alias("sweep")))


def bulge_path(x1, y1, x2, y2, bulge, tol: float, z=None) -> Column:
    """Vertices from the first point up to, not including, the second."""
    x1, y1, x2, y2, bulge = (G._c(v) for v in (x1, y1, x2, y2, bulge))
    start = F.array(G.vertex(x1, y1, z))
    return G.let(bulge_arc(x1, y1, x2, y2, bulge), lambda a: F.when(a.isNull(), start).otherwise(
        G.head(arc_path(a["cx"], a["cy"], a["r"], a["start"], a["sweep"], tol, z))))


def polyline_path(vertices, closed, tol: float) -> Column:
    """Bulged polyline (``array<struct<x, y, bulge>>``) to vertices; a closed one repeats its first."""
    v, closed = G._c(vertices), G._c(closed)
    n = F.size(v)
    nxt = F.concat(F.slice(v, 2, F.greatest(n - 1, F.lit(0))), F.slice(v, 1, 1))
    arcs = F.zip_with(v, nxt, lambda a, b: bulge_path(a["x"], a["y"], b["x"], b["y"], a["bulge"], tol))
    dot = lambda p: F.array(G.vertex(p["x"], p["y"]))
    every = F.flatten(arcs)
    open_ = F.flatten(F.slice(arcs, 1, F.greatest(n - 1, F.lit(0))))
    return F.when(n == 0, F.array().cast(G.RING)).when(n == 1, dot(F.get(v, F.lit(0)))).otherwise(
        F.when(closed, G.let(every, lambda e: F.concat(e, F.slice(e, 1, 1)))).otherwise(F.concat(open_, dot(F.element_at(v, -1)))))


def survey_arc(start, centre, end, clockwise) -> Column:
    """Arc between stated ends, seventy-two segments to the circle; the ends are exact."""
    s, c, e, cw = (G._c(v) for v in (start, centre, end, clockwise))
    r = F.sqrt((s["x"] - c["x"]) ** 2 + (s["y"] - c["y"]) ** 2)
    a0 = F.atan2(s["y"] - c["y"], s["x"] - c["x"])
    raw = F.atan2(e["y"] - c["y"], e["x"] - c["x"]) - a0
    turn = 2 * math.pi
    sweep = F.when(cw, F.when(raw > 0, raw - turn).otherwise(raw)).otherwise(F.when(raw < 0, raw + turn).otherwise(raw))
    n = F.greatest(F.lit(2), F.ceil(F.abs(sweep) / turn * SURVEY_PER_CIRCLE).cast("int"))
    frame = F.struct(r.alias("r"), a0.alias("a"), sweep.alias("w"), n.alias("n"))
    mid = G.let(frame, lambda f: F.transform(F.sequence(F.lit(1), f["n"] - 1), lambda k: G.vertex(
        c["x"] + f["r"] * F.cos(f["a"] + f["w"] * k / f["n"]), c["y"] + f["r"] * F.sin(f["a"] + f["w"] * k / f["n"]))))
    return F.when(r > 0, F.concat(F.array(s), mid, F.array(e))).otherwise(F.array(s, e))
