"""Text and binary forms of geometries: WKT, GeoJSON, KML and WKB."""

from __future__ import annotations

import re
import struct

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import geometry as G

EMPTY_NAMES = {k: k.upper() for k in ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")}


def plain_number(c: Column) -> Column:
    """Decimal text without exponent and without a trailing ``.0``."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    text = c.cast("string")
    long = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(whole, c.cast("bigint").cast("string")).when(text.contains("E"), long).otherwise(text)


def _pos(v: Column, sep: str, z: bool, digits: int | None) -> Column:
    n = lambda c: plain_number(F.round(c, digits) if digits is not None else c)
    parts = [n(v["x"]), n(v["y"])] + ([F.when(v["z"].isNotNull() & ~F.isnan(v["z"]), n(v["z"]))] if z else [])
    return F.concat_ws(sep, *parts)


def _wrap(items: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(items, ", "), F.lit(")"))


def to_wkt(g, z: bool = False) -> Column:
    g = G._c(g)
    path = lambda r: _wrap(F.transform(r, lambda v: _pos(v, " ", z, None)))
    dot = lambda p: _wrap(F.transform(F.flatten(p), lambda v: _pos(v, " ", z, None)))
    first = lambda p: F.get(p, F.lit(0))
    solid = lambda p: _wrap(F.transform(p, path))
    up = lambda k: F.upper(k)
    kind_of = lambda k, p: F.when(k == G.POINT, F.concat(up(k), F.lit(" "), dot(p))).when(k == G.LINE, F.concat(up(k), F.lit(" "), path(first(p)))).otherwise(
        F.concat(up(k), F.lit(" "), solid(p)))
    parts, k = g["parts"], g["kind"]
    body = (
        F.when(k.isin(G.POINT, G.LINE, G.POLYGON), kind_of(k, first(parts)))
        .when(k == "MultiPoint", F.concat(up(k), F.lit(" "), _wrap(F.transform(parts, dot))))
        .when(k == "MultiLineString", F.concat(up(k), F.lit(" "), _wrap(F.transform(parts, lambda p: path(first(p))))))
        .when(k == "MultiPolygon", F.concat(up(k), F.lit(" "), _wrap(F.transform(parts, solid))))
        .otherwise(F.concat(up(k), F.lit(" "), _wrap(F.zip_with(parts, g["members"], lambda p, m: kind_of(m, p))))))
    return F.when(g.isNull(), None).when(G.is_empty(g), F.concat(up(k), F.lit(" EMPTY"))).otherwise(body)


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def to_geojson(g, digits: int | None = None) -> Column:
    """Geometry object as text; null or empty reads ``null``; a height only where a vertex has one."""
    g = G._c(g)
    pos = lambda v: F.concat(F.lit("["), _pos(v, ",", True, digits), F.lit("]"))
    path = lambda r: _json_list(F.transform(r, pos))
    first = lambda p: F.get(p, F.lit(0))
    dot = lambda p: pos(first(first(p)))
    solid = lambda p: _json_list(F.transform(p, path))
    obj = lambda k, c: F.concat(F.lit('{"type":"'), k, F.lit('","coordinates":'), c, F.lit("}"))
    simple = lambda k, p: obj(k, F.when(k == G.POINT, dot(p)).when(k == G.LINE, path(first(p))).otherwise(solid(p)))
    k, parts = g["kind"], g["parts"]
    body = (
        F.when(k.isin(G.POINT, G.LINE, G.POLYGON), simple(k, first(parts)))
        .when(k == "MultiPoint", obj(k, _json_list(F.transform(parts, dot))))
        .when(k == "MultiLineString", obj(k, _json_list(F.transform(parts, lambda p: path(first(p))))))
        .when(k == "MultiPolygon", obj(k, _json_list(F.transform(parts, solid))))
        .otherwise(F.concat(F.lit('{"type":"GeometryCollection","geometries":'), _json_list(F.zip_with(parts, g["members"], lambda p, m: simple(m, p))), F.lit("}"))))
    return F.when(g.isNull() | G.is_empty(g), F.lit("null")).otherwise(body)


def xml_escape(c) -> Column:
    t = F.replace(F.replace(F.replace(G._c(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(t, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def to_kml(g, digits: int = 7) -> Column:
    """Geometry element; multi-part geometries share one ``MultiGeometry``."""
    g = G._c(g)
    tag = lambda n, *c: F.concat(F.lit(f"<{n}>"), *c, F.lit(f"</{n}>"))
    coords = lambda r: tag("coordinates", F.array_join(F.transform(r, lambda v: _pos(v, ",", True, digits)), " "))
    first = lambda p: F.get(p, F.lit(0))
    solid = lambda p: tag("Polygon", tag("outerBoundaryIs", tag("LinearRing", coords(first(p)))), F.array_join(
        F.transform(G.tail(p), lambda h: tag("innerBoundaryIs", tag("LinearRing", coords(h)))), ""))
    one = lambda k, p: F.when(k == G.POINT, tag("Point", coords(first(p)))).when(k == G.LINE, tag("LineString", coords(first(p)))).otherwise(solid(p))
    kinds = F.coalesce(g["members"], F.transform(g["parts"], lambda _: G.base_kind(g)))
    many = tag("MultiGeometry", F.array_join(F.zip_with(g["parts"], kinds, lambda p, k: one(k, p)), ""))
    return F.when(g.isNull() | G.is_empty(g), F.lit("")).when(g["kind"].isin(G.POINT, G.LINE, G.POLYGON), one(g["kind"], first(g["parts"]))).otherwise(many)


_CODE = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}  # fixed values


def _wkb(g) -> bytes | None:
    if g is None:
        return None

    def has_z(parts):
        return any(v["z"] is not None for p in parts for r in p for v in r)

    def run(r, z):
        return struct.pack("<I", len(r)) + b"".join(struct.pack("<ddd", v["x"], v["y"], float("nan") if v["z"] is None else v["z"]) if z else struct.pack("<dd", v["x"], v["y"]) for v in r)

    def one(kind, part):
        z = has_z([part])
        head = struct.pack("<BI", 1, _CODE[kind] + (1000 if z else 0))
        if kind == "Point":
            v = part[0][0]
            return head + (struct.pack("<ddd", v["x"], v["y"], v["z"]) if z else struct.pack("<dd", v["x"], v["y"]))
        if kind == "LineString":
            return head + run(part[0], z)
        return head + struct.pack("<I", len(part)) + b"".join(run(r, z) for r in part)

    kind, parts = g["kind"], list(g["parts"])
    if kind in ("Point", "LineString", "Polygon"):
        if not parts:
            return struct.pack("<BI", 1, 1) + struct.pack("<dd", float("nan"), float("nan")) if kind == "Point" else struct.pack("<BII", 1, _CODE[kind], 0)
        return one(kind, parts[0])
    kinds = list(g["members"]) if g["members"] is not None else [kind.removeprefix("Multi")] * len(parts)
    return struct.pack("<BII", 1, _CODE[kind] + (1000 if has_z(parts) else 0), len(parts)) + b"".join(one(k, p) for k, p in zip(kinds, parts))


@F.arrow_udf(T.BinaryType())
def wkb_of(kind: pa.Array, parts: pa.Array, members: pa.Array) -> pa.Array:
    """Rings of different lengths have no numpy form, so the batch stays in Arrow."""
    rows = zip(kind.to_pylist(), parts.to_pylist(), members.to_pylist())
    return pa.array([None if k is None else _wkb({"kind": k, "parts": p, "members": m}) for k, p, m in rows], pa.binary())


def to_wkb(g) -> Column:
    g = G._c(g)
    return wkb_of(g["kind"], g["parts"], g["members"])


_GEOM = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"]))))),
    T.StructField("members", T.ArrayType(T.StringType()))])
_NAMES = {k.upper(): k for k in _CODE}
_TOKEN = re.compile(r"[(),]|[^\s(),]+")


def _read_wkt(text):
    """One geometry from its text; ``None`` when it does not read."""
    if text is None:
        return None
    toks = _TOKEN.findall(text)
    at = 0

    def take(want=None):
        nonlocal at
        t = toks[at]
        if want is not None and t != want:
            raise ValueError(t)
        at += 1
        return t

    def listing(item):
        take("(")
        out = [item()]
        while toks[at] == ",":
            take(",")
            out.append(item())
        take(")")
        return out

    def vertex():
        nums = []
        while toks[at] not in "(),":
            nums.append(float(take()))
        if len(nums) < 2:
            raise ValueError("vertex")
        return {"x": nums[0], "y": nums[1], "z": nums[2] if len(nums) > 2 else None}

    def loose():
        return listing(vertex)[0] if toks[at] == "(" else vertex()

    def body():
        kind = _NAMES[take().upper()]
        while toks[at].upper() in ("Z", "M", "ZM"):
            take()
        if toks[at].upper() == "EMPTY":
            take()
            return kind, [], []
        path = lambda: listing(vertex)
        if kind == "Point":
            return kind, [[path()]], None
        if kind == "LineString":
            return kind, [[path()]], None
        if kind == "Polygon":
            return kind, [listing(path)], None
        if kind == "MultiPoint":
            return kind, [[[v]] for v in listing(loose)], None
        if kind == "MultiLineString":
            return kind, [[p] for p in listing(path)], None
        if kind == "MultiPolygon":
            return kind, listing(lambda: listing(path)), None
        subs = listing(body)
        return kind, [p for _, ps, _ in subs for p in ps], [k.removeprefix("Multi") for k, ps, _ in subs for _ in ps]

    try:
        kind, parts, members = body()
        if at != len(toks):
            return None
        return {"kind": kind, "parts": parts, "members": members or None}
    except (ValueError, KeyError, IndexError):
        return None


@F.pandas_udf(_GEOM)
def parse_wkt(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read_wkt(t) or {"kind": None, "parts": None, "members": None} for t in text], columns=["kind", "parts", "members"])


def geom_from_wkt(c) -> Column:
    """Geometry of a WKT text, whose kind is null when it does not read."""
    return parse_wkt(G._c(c))
