"""Geometry column and the measures that built-in expressions can state.

A geometry is ``struct<kind, parts, members>``: parts -> rings (or paths) -> vertices.  ``members``
names the kind of each part of a heterogeneous collection and is null otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERTEX = "struct<x:double,y:double,z:double>"
RING = f"array<{VERTEX}>"
PARTS = f"array<array<{RING}>>"
GEOM = f"struct<kind:string,parts:{PARTS},members:array<string>>"

POINT, LINE, POLYGON = "Point", "LineString", "Polygon"
MULTI = {POINT: "MultiPoint", LINE: "MultiLineString", POLYGON: "MultiPolygon"}
COLLECTION = "GeometryCollection"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it many times; lambda bodies are not shared by the optimiser."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def vertex(x, y, z=None) -> Column:
    zc = F.lit(None).cast("double") if z is None else _c(z).cast("double")
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"), zc.alias("z"))


def make_geom(kind, parts, members=None) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    m = F.lit(None).cast("array<string>") if members is None else members
    return F.struct(k.alias("kind"), parts.alias("parts"), m.alias("members"))


def point(x, y, z=None) -> Column:
    return make_geom(POINT, F.array(F.array(F.array(vertex(x, y, z)))))


def line(vertices: Column) -> Column:
    return make_geom(LINE, F.array(F.array(vertices)))


def polygon(*rings: Column) -> Column:
    return make_geom(POLYGON, F.array(F.array(*rings)))


def empty_geom(kind: str) -> Column:
    return make_geom(kind, F.array().cast(PARTS))


def rect_ring(minx, miny, maxx, maxy) -> Column:
    a, b, c, d = _c(minx), _c(miny), _c(maxx), _c(maxy)
    return F.array(vertex(a, b), vertex(c, b), vertex(c, d), vertex(a, d), vertex(a, b))


def rect(minx, miny, maxx, maxy) -> Column:
    return polygon(rect_ring(minx, miny, maxx, maxy))


def rings(g) -> Column:
    return F.flatten(_c(g)["parts"])


def vertices(g) -> Column:
    return F.flatten(rings(g))


def is_empty(g) -> Column:
    return F.size(vertices(g)) == 0


def base_kind(g) -> Column:
    return F.regexp_replace(_c(g)["kind"], "^Multi", "")


def geometry_kind(g) -> Column:
    """Feature-level kind: Point, Line, Polygon or Unknown; a collection takes its first member."""
    g = _c(g)
    first = F.when(g["kind"] == COLLECTION, F.get(g["members"], F.lit(0))).otherwise(g["kind"])
    b = F.regexp_replace(first, "^Multi", "")
    return (
        F.when(b == POINT, "Point").when(b == LINE, "Line").when(b == POLYGON, "Polygon").otherwise("Unknown")
    )


def head(ring: Column) -> Column:
    return F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))


def tail(ring: Column) -> Column:
    return F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))


def edges_of(ring: Column, fn) -> Column:
    """Apply ``fn(a, b)`` to each consecutive vertex pair of one ring."""
    return F.zip_with(head(ring), tail(ring), fn)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def ring_signed_area(ring: Column) -> Column:
    """Shoelace sum about the ring's first vertex, positive when counter-clockwise."""
    o = F.get(ring, F.lit(0))
    terms = edges_of(
        ring, lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
    )
    return total(terms) / 2.0


def planar(a, b) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def ring_length(ring: Column) -> Column:
    return total(edges_of(ring, planar))


def _part_kinds(g: Column) -> Column:
    """Kind of every part, so collections measure each member by its own kind."""
    return F.coalesce(
        F.transform(g["members"], lambda m: F.regexp_replace(m, "^Multi", "")),
        F.transform(g["parts"], lambda _: base_kind(g)),
    )


def _sum_parts(g: Column, fn) -> Column:
    return total(F.zip_with(g["parts"], _part_kinds(g), fn))


def part_area(part: Column, measure=ring_signed_area) -> Column:
    shell = F.abs(measure(F.get(part, F.lit(0))))
    holes = total(F.transform(tail(part), lambda r: F.abs(measure(r))))
    return F.coalesce(shell, F.lit(0.0)) - holes


def st_area(g) -> Column:
    return _sum_parts(_c(g), lambda p, k: F.when(k == POLYGON, part_area(p)).otherwise(F.lit(0.0)))


def st_length(g, measure=ring_length) -> Column:
    return _sum_parts(
        _c(g), lambda p, k: F.when(k != POINT, total(F.transform(p, measure))).otherwise(F.lit(0.0))
    )


def envelope(g) -> Column:
    """``struct<minx,miny,maxx,maxy,minz,maxz>``; null for an empty geometry."""
    def box(v):
        lo = lambda k: F.array_min(F.transform(v, lambda p: p[k]))
        hi = lambda k: F.array_max(F.transform(v, lambda p: p[k]))
        return F.when(F.size(v) > 0, F.struct(
            lo("x").alias("minx"), lo("y").alias("miny"), hi("x").alias("maxx"), hi("y").alias("maxy"),
            lo("z").alias("minz"), hi("z").alias("maxz")))

    return let(vertices(g), box)


def pin(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of working out again.

    The optimiser copies a projected expression into every filter pushed below it; a generated row is
    not copied, and costs neither a shuffle nor a scan.
    """
    kept = [c for c in df.columns if c not in cols]
    row = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.withColumn("_pin", row).select(*kept, *[F.col(f"_pin.{n}").alias(n) for n in cols])


def with_envelope(df: DataFrame, geom: str = "geom") -> DataFrame:
    names = ("minx", "miny", "maxx", "maxy")
    kept = [c for c in df.columns if c not in names]
    return pin(df.select(*kept), _env=envelope(geom)).select(*kept, *[F.col(f"_env.{n}").alias(n) for n in names])


def _moments(edges: Column, ox, oy) -> Column:
    """Sum ``(w, mx, my)`` structs and shift the moments back by the local origin."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    add = lambda s, e: F.struct(
        (s["w"] + e["w"]).alias("w"), (s["mx"] + e["mx"]).alias("mx"), (s["my"] + e["my"]).alias("my"))
    return F.aggregate(edges, zero, add, lambda t: F.struct(
        t["w"].alias("w"), (t["mx"] + t["w"] * ox).alias("mx"), (t["my"] + t["w"] * oy).alias("my")))


def _ring_moment(ring: Column) -> Column:
    o = F.get(ring, F.lit(0))

    def term(a, b):
        cross = (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
        return F.struct(
            (cross / 2).alias("w"), (cross * (a["x"] + b["x"] - 2 * o["x"]) / 6).alias("mx"),
            (cross * (a["y"] + b["y"] - 2 * o["y"]) / 6).alias("my"))

    return _moments(edges_of(ring, term), o["x"], o["y"])


def _path_moment(path: Column) -> Column:
    def term(a, b):
        d = planar(a, b)
        return F.struct(
            d.alias("w"), (d * (a["x"] + b["x"]) / 2).alias("mx"), (d * (a["y"] + b["y"]) / 2).alias("my"))

    return _moments(edges_of(path, term), F.lit(0.0), F.lit(0.0))


def st_centroid(g) -> Column:
    """Area-weighted for polygons, length-weighted for lines, mean of points otherwise."""
    g = _c(g)
    unit = lambda v: F.struct(F.lit(1.0).alias("w"), v["x"].alias("mx"), v["y"].alias("my"))

    def signed(m, i):
        s = F.signum(m["w"]) * F.when(i == 0, 1.0).otherwise(-1.0)
        return F.struct((m["w"] * s).alias("w"), (m["mx"] * s).alias("mx"), (m["my"] * s).alias("my"))

    whole = lambda ms: _moments(ms, F.lit(0.0), F.lit(0.0))
    area_m = whole(F.flatten(F.transform(
        g["parts"], lambda p: F.transform(F.transform(p, _ring_moment), signed))))
    line_m = whole(F.transform(rings(g), _path_moment))
    point_m = whole(F.transform(vertices(g), unit))
    heavy = lambda c: F.transform(F.array(c), lambda m: F.when(m["w"] > 0, m))
    # A degenerate area falls back to its outline and a degenerate line to its vertices.
    order = F.concat(
        F.when(base_kind(g) == POLYGON, heavy(area_m)).otherwise(F.array()),
        F.when(base_kind(g) != POINT, heavy(line_m)).otherwise(F.array()),
        heavy(point_m),
    )
    first = F.get(F.filter(order, lambda m: m.isNotNull()), F.lit(0))
    return let(first, lambda m: F.when(m.isNotNull(), F.struct(
        (m["mx"] / m["w"]).alias("x"), (m["my"] / m["w"]).alias("y"))))


def orient_ring(ring: Column, ccw) -> Column:
    return F.when((ring_signed_area(ring) > 0) == ccw, ring).otherwise(F.reverse(ring))


def _map_rings(g: Column, fn) -> Column:
    """Rebuild a geometry ring by ring; ``fn(ring, index)`` sees index 0 for shells."""
    return make_geom(
        g["kind"], F.transform(g["parts"], lambda p: F.transform(p, lambda r, i: fn(r, i))), g["members"]
    )


def orient_rings(g, rule: str = "CounterClockwise") -> Column:
    """Shell follows the rule and holes wind the opposite way; ``Preserve`` leaves both."""
    g = _c(g)
    if rule == "Preserve":
        return g
    ccw = rule == "CounterClockwise"
    turned = _map_rings(g, lambda r, i: orient_ring(r, F.when(i == 0, F.lit(ccw)).otherwise(F.lit(not ccw))))
    return F.when(base_kind(g) == POLYGON, turned).otherwise(g)


def is_closed(ring: Column) -> Column:
    a, b = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return (F.size(ring) > 0) & (a["x"] == b["x"]) & (a["y"] == b["y"])


def map_geometry(g, closed_to_polygon=False, orientation="Preserve", promote=False) -> Column:
    """Closed line of four or more points to polygon, ring orientation, then promotion to multi."""
    g = _c(g)
    if closed_to_polygon:
        path = F.get(F.get(g["parts"], F.lit(0)), F.lit(0))
        as_poly = (g["kind"] == LINE) & is_closed(path) & (F.size(path) >= 4)
        g = make_geom(F.when(as_poly, F.lit(POLYGON)).otherwise(g["kind"]), g["parts"], g["members"])
    g = orient_rings(g, orientation)
    if promote:
        kind = F.when(g["kind"].isin(*MULTI), F.concat(F.lit("Multi"), g["kind"])).otherwise(g["kind"])
        g = make_geom(kind, g["parts"], g["members"])
    return F.when(~is_empty(g), g)


def dedupe_ring(ring: Column, tol: float) -> Column:
    """Keep a vertex when it lies farther than ``tol`` from the last vertex kept."""
    def step(acc, v):
        last = F.get(acc, F.size(acc) - 1)
        return F.when(planar(last, v) > tol, F.concat(acc, F.array(v))).otherwise(acc)

    return F.when(F.size(ring) == 0, ring).otherwise(
        F.aggregate(tail(ring), F.slice(ring, 1, 1), step)
    )


def _close(ring: Column) -> Column:
    return F.when(is_closed(ring), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def dedupe_vertices(g, tol: float) -> Column:
    """Drop near-repeats; a shell that would fall under four vertices is kept, a hole is dropped."""
    g = _c(g)
    if tol <= 0:
        return g

    def fix_line(r):
        d = dedupe_ring(r, tol)
        return F.when(F.size(d) >= 2, d).otherwise(r)

    def fix_part(p):
        done = F.transform(p, lambda r: dedupe_ring(r, tol))
        shell_ok = F.size(F.get(done, F.lit(0))) >= 4
        keep = F.transform(F.filter(done, lambda r: F.size(r) >= 4), _close)
        return F.when(shell_ok, keep).otherwise(p)

    k = base_kind(g)
    lines = F.transform(g["parts"], lambda p: F.transform(p, fix_line))
    polys = F.transform(g["parts"], fix_part)
    return make_geom(
        g["kind"], F.when(k == LINE, lines).when(k == POLYGON, polys).otherwise(g["parts"]), g["members"]
    )


def _grid(v: Column, size: float) -> Column:
    # Half-way values round up, the usual rule of a fixed precision grid.
    scale = round(1.0 / size)
    if size <= 1.0 and abs(scale * size - 1.0) < 1e-9:
        snap = lambda c: F.floor(c * scale + 0.5) / F.lit(float(scale))
    else:
        snap = lambda c: F.floor(c / size + 0.5) * F.lit(float(size))
    return F.struct(snap(v["x"]).alias("x"), snap(v["y"]).alias("y"), v["z"].alias("z"))


def snap_to_grid(g, size: float) -> Column:
    """Move vertices to a grid, drop exact repeats; null when nothing keeps its dimension."""
    g = _c(g)
    if size <= 0:
        return g
    moved = _map_rings(g, lambda r, i: F.transform(r, lambda v: _grid(v, size)))
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    squeeze = lambda r: F.aggregate(
        tail(r), F.slice(r, 1, 1),
        lambda acc, v: F.when(same(F.get(acc, F.size(acc) - 1), v), acc).otherwise(F.concat(acc, F.array(v))),
    )
    k = base_kind(g)
    need = F.when(k == POLYGON, 4).when(k == LINE, 2).otherwise(1)
    parts = F.transform(
        moved["parts"],
        lambda p: F.filter(F.transform(p, squeeze), lambda r: F.size(r) >= need),
    )
    parts = F.filter(parts, lambda p: (F.size(p) > 0) & ((k != POLYGON) | (part_area(p) > 0)))
    return F.when(F.size(parts) > 0, make_geom(moved["kind"], parts, moved["members"]))


def reduce_precision(g, scale: float) -> Column:
    return snap_to_grid(g, 1.0 / scale)


def stride_decimate(ring: Column, limit: int) -> Column:
    """Keep ``limit`` evenly spaced vertices of a longer ring; a closed ring is closed again."""
    closed = F.when(is_closed(ring), 1).otherwise(0)
    n = F.size(ring) - closed

    def keep(r):
        picked = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.get(r, F.floor(i * n / F.lit(float(limit))).cast("int")))
        return F.when(closed == 1, F.concat(picked, F.slice(picked, 1, 1))).otherwise(picked)

    return ring if limit < 4 else F.when(n <= limit, ring).otherwise(keep(ring))


def explode_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per member of a heterogeneous collection; multi-part geometries stay whole."""
    g = F.col(geom)
    members = F.zip_with(
        g["parts"], g["members"], lambda p, m: make_geom(m, F.array(p))
    )
    out = F.when(g["kind"] == COLLECTION, members).otherwise(F.array(g))
    cols = [c for c in df.columns if c != geom]
    return df.select(*cols, F.posexplode_outer(out).alias("member", geom))


def vertex_table(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """Long table ``keys, part, ring, pos, x, y, z``."""
    d = df.select(*keys, F.posexplode(F.col(geom)["parts"]).alias("part", "_rings"))
    d = d.select(*keys, "part", F.posexplode("_rings").alias("ring", "_path"))
    d = d.select(*keys, "part", "ring", F.posexplode("_path").alias("pos", "_v"))
    return d.select(*keys, "part", "ring", "pos", "_v.x", "_v.y", "_v.z")


def segment_table(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """Consecutive vertex pairs ``keys, part, ring, pos, x1, y1, x2, y2`` without a shuffle."""
    pair = lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
    )
    d = df.select(*keys, F.posexplode(F.col(geom)["parts"]).alias("part", "_rings"))
    d = d.select(*keys, "part", F.posexplode("_rings").alias("ring", "_path"))
    d = d.select(*keys, "part", "ring", F.posexplode(edges_of(F.col("_path"), pair)).alias("pos", "_s"))
    return d.select(*keys, "part", "ring", "pos", "_s.x1", "_s.y1", "_s.x2", "_s.y2")


# --- extents -------------------------------------------------------------------------------------

def extent_expand(minx, miny, maxx, maxy, by) -> list[Column]:
    return [_c(minx) - by, _c(miny) - by, _c(maxx) + by, _c(maxy) + by]


def extent_contains(box: tuple, x, y) -> Column:
    a, b, c, d = (_c(v) for v in box)
    return (_c(x) >= a) & (_c(x) <= c) & (_c(y) >= b) & (_c(y) <= d)


def extent_intersects(p: tuple, q: tuple) -> Column:
    a, b, c, d = (_c(v) for v in p)
    e, f, g, h = (_c(v) for v in q)
    return (a <= g) & (c >= e) & (b <= h) & (d >= f)


def extent_aspect(minx, miny, maxx, maxy) -> Column:
    w, h = _c(maxx) - _c(minx), _c(maxy) - _c(miny)
    return F.greatest(w, h) / F.nullif(F.least(w, h), F.lit(0.0))


# --- planar measurement of vertex paths --------------------------------------------------------

def bearing(x1, y1, x2, y2) -> Column:
    """Clockwise from north in [0, 360)."""
    deg = F.degrees(F.atan2(_c(x2) - _c(x1), _c(y2) - _c(y1)))
    return F.when(deg < 0, deg + 360.0).otherwise(deg)


def path_length(path: Column) -> Column:
    return ring_length(path)


def path_area(path: Column) -> Column:
    return F.when(F.size(path) < 3, F.lit(0.0)).otherwise(F.abs(ring_signed_area(_close(path))))


def fmt_coordinate(x, y) -> Column:
    return F.format_string("X: %.3f, Y: %.3f", _c(x), _c(y))


def fmt_distance(d) -> Column:
    return F.format_string("%.3f m", _c(d))


def fmt_area(a) -> Column:
    return F.format_string("%.3f m²", _c(a))


def fmt_bearing(b) -> Column:
    return F.format_string("%.2f°", _c(b))
