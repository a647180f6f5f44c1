"""Coordinate system ids and the closed-form transformations: geographic, Web Mercator and WGS 84 UTM.

Codes are columns, so one plan serves rows in different systems.  UTM uses the transverse Mercator
series in the third flattening, good to well under a millimetre inside a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

# WGS 84 and the UTM grid.
A, INV_F = 6378137.0, 298.257223563
K0, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0
_n = 1 / (2 * INV_F - 1)
_E = math.sqrt(1 - (1 - 1 / INV_F) ** 2)
RECT = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
         61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)
BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360, _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
        17 * _n**3 / 480 - 37 * _n**4 / 840, 4397 * _n**4 / 161280)
DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45, 7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
         56 * _n**3 / 15 - 136 * _n**4 / 35, 4279 * _n**4 / 630)


def parse_crs(c) -> Column:
    """``struct<authority, code, is_geographic>`` of ``EPSG:n`` or bare ``n``; null when unreadable."""
    t = F.trim(G._c(c))
    cut = F.instr(t, ":")
    auth = F.when(cut == 0, F.lit("EPSG")).otherwise(F.upper(F.trim(F.substr(t, F.lit(1), F.greatest(cut - 1, F.lit(0))))))
    text = F.when(cut == 0, t).otherwise(F.trim(F.substr(t, cut + 1)))
    code = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int"))
    return F.when((F.length(auth) > 0) & (code > 0), F.struct(
        auth.alias("authority"), code.alias("code"), ((auth == "EPSG") & code.between(4000, 4999)).alias("is_geographic")))


def crs_id(p: Column) -> Column:
    return F.concat_ws(":", p["authority"], p["code"].cast("string"))


def crs_from_wkt(c) -> Column:
    """Code of the outermost system: the last authority clause of a definition."""
    pattern = r'(?i)(?:AUTHORITY|ID)\s*\[\s*"([A-Za-z]+)"\s*,\s*"?([0-9]+)"?\s*\]'
    last = lambda i: F.element_at(F.regexp_extract_all(G._c(c), F.lit(pattern), F.lit(i)), -1)
    some = F.size(F.regexp_extract_all(G._c(c), F.lit(pattern), F.lit(1))) > 0
    return F.when(some, F.concat_ws(":", F.upper(last(1)), last(2)))


def fnv1a(c) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    text = F.hex(F.encode(G._c(c), "UTF-16BE"))
    units = F.when(F.length(text) > 0, G.let(text, lambda h: F.transform(
        F.sequence(F.lit(0), (F.length(h) / 4 - 1).cast("int")), lambda i: F.conv(F.substr(h, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("bigint")))).otherwise(
        F.array().cast("array<bigint>"))
    return F.aggregate(units, F.lit(2166136261).cast("bigint"),
                       lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(4294967295).cast("bigint")))


def custom_code(wkt) -> Column:
    """Stable positive code of a custom definition."""
    return fnv1a(wkt).bitwiseAND(F.lit(0x7FFFFFFF).cast("bigint")).bitwiseOR(F.lit(1).cast("bigint")).cast("int")


def _xy(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def mercator_forward(lon, lat) -> Column:
    return _xy(F.radians(lon) * A, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * A)


def mercator_inverse(x, y) -> Column:
    return _xy(F.degrees(x / A), F.degrees(F.atan(F.exp(y / A)) * 2 - math.pi / 2))


def utm_forward(lon, lat, zone, south) -> Column:
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))

    def series(p):
        xi, eta = p["xi"], p["eta"]
        n = xi + sum(a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA))
        e = eta + sum(a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(ALPHA))
        return _xy(F.lit(FALSE_EASTING) + e * (K0 * RECT), n * (K0 * RECT) + F.when(south, FALSE_NORTHING).otherwise(0.0))

    p = G.let(t, lambda v: F.struct(F.atan2(v, F.cos(lam)).alias("xi"), F.asinh(F.sin(lam) / F.sqrt(v * v + F.cos(lam) * F.cos(lam))).alias("eta")))
    return G.let(p, series)


def utm_inverse(x, y, zone, south) -> Column:
    xi0 = (y - F.when(south, FALSE_NORTHING).otherwise(0.0)) / (K0 * RECT)
    eta0 = (x - FALSE_EASTING) / (K0 * RECT)

    def unseries(p):
        xi, eta = p["a"], p["b"]
        return F.struct(
            (xi - sum(b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(BETA))).alias("a"),
            (eta - sum(b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(BETA))).alias("b"))

    def angles(q):
        chi = F.asin(F.sin(q["a"]) / F.cosh(q["b"]))
        lam = F.atan2(F.sinh(q["b"]), F.cos(q["a"]))
        return G.let(chi, lambda c: _xy(
            F.degrees(lam) + (zone * 6 - 183), F.degrees(c + sum(d * F.sin(2 * (j + 1) * c) for j, d in enumerate(DELTA)))))

    return G.let(G.let(F.struct(xi0.alias("a"), eta0.alias("b")), unseries), angles)


GEOGRAPHIC, WEB_MERCATOR = 4326, 3857


def _utm(code):
    return code.between(32601, 32660) | code.between(32701, 32760)


def supported(code) -> Column:
    code = G._c(code)
    return (code == GEOGRAPHIC) | (code == WEB_MERCATOR) | _utm(code)


def to_geographic(x, y, code) -> Column:
    zone, south = code % 100, code > 32700
    return F.when(code == GEOGRAPHIC, _xy(x, y)).when(code == WEB_MERCATOR, mercator_inverse(x, y)).when(_utm(code), utm_inverse(x, y, zone, south))


def from_geographic(lon, lat, code) -> Column:
    zone, south = code % 100, code > 32700
    return F.when(code == GEOGRAPHIC, _xy(lon, lat)).when(code == WEB_MERCATOR, mercator_forward(lon, lat)).when(_utm(code), utm_forward(lon, lat, zone, south))


def transform_xy(x, y, src, dst) -> Column:
    """``struct<x, y>``; same system is a copy, an unsupported pair is null."""
    x, y, src, dst = (G._c(v) for v in (x, y, src, dst))
    ok = supported(src) & supported(dst)
    moved = G.let(to_geographic(x, y, src), lambda p: from_geographic(p["x"], p["y"], dst))
    return F.when(src == dst, _xy(x, y)).when(ok, moved)


def reproject(g, src, dst) -> Column:
    """Move every vertex, keeping heights; null for an unsupported pair."""
    g, src, dst = G._c(g), G._c(src), G._c(dst)

    def move(v):
        return G.let(transform_xy(v["x"], v["y"], src, dst), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), v["z"].alias("z")))

    ok = (src == dst) | (supported(src) & supported(dst)) | G.is_empty(g)
    return F.when(ok, F.when((src == dst) | G.is_empty(g), g).otherwise(G._map_rings(g, lambda r, i: F.transform(r, move))))


def reproject_extent(box, src, dst) -> Column:
    """Envelope of the four transformed corners."""
    a, b, c, d = (G._c(v) for v in box)
    corners = F.array(*[transform_xy(x, y, src, dst) for x, y in ((a, b), (c, b), (a, d), (c, d))])
    return G.let(corners, lambda k: F.when(F.get(k, F.lit(0)).isNotNull(), F.struct(
        F.array_min(F.transform(k, lambda p: p["x"])).alias("minx"), F.array_min(F.transform(k, lambda p: p["y"])).alias("miny"),
        F.array_max(F.transform(k, lambda p: p["x"])).alias("maxx"), F.array_max(F.transform(k, lambda p: p["y"])).alias("maxy"))))
