"""Catalogue of coordinate systems: build, search, lookup by place, suggestion, validation and detection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import crs as C
from ..functions import geometry as G
from . import spatial as S
from .common import GROWS, spread, stored

AREA_ALIASES = {  # fixed values: alias and the text it stands for
    "united arab emirates": "uae", "emirates": "uae", "usa": "united states", "america": "united states",
    "uk": "united kingdom", "britain": "united kingdom", "korea": "republic of korea", "russia": "russian federation",
}
AREA = ("west", "south", "east", "north")
PIECE = 5  # characters of a token by which a search meets entries


def build_crs_catalog(t: dict[str, DataFrame]) -> DataFrame:
    """One row per live EPSG code with datum, method, unit and area box.

    Tables: ``projected`` and ``geodetic`` (``code, name, type, datum_code, geodetic_code, conversion_code,
    cs_code, deprecated``), ``datum``, ``conversion``, ``unit`` (``code, name``), ``axis`` (``cs_code,
    axis_order, unit_code``), ``usage`` (``object_code, extent_code``), ``extent`` (``code, name`` and box).
    """
    name = lambda table, alias: t[table].select(F.col("code").alias(f"_{alias}"), F.col("name").alias(alias))
    geo = t["geodetic"]
    p = t["projected"].where("NOT deprecated").join(
        geo.select(F.col("code").alias("_g"), F.col("datum_code").alias("_dc")), F.col("geodetic_code") == F.col("_g"), "left")
    p = p.join(name("conversion", "method"), F.col("conversion_code") == F.col("_method"), "left")
    cols = ["code", "name", "kind", "_dc", "method", "cs_code"]
    p = p.withColumn("kind", F.lit("projected")).select(*cols)
    g = geo.where("NOT deprecated").withColumns({
        "kind": F.coalesce("type", F.lit("geographic")), "_dc": F.col("datum_code"), "method": F.lit(None).cast("string")}).select(*cols)
    axis = t["axis"].where("axis_order = 1").select(F.col("cs_code").alias("_cs"), "unit_code")
    d = p.unionByName(g).join(name("datum", "datum"), F.col("_dc") == F.col("_datum"), "left")
    d = d.join(axis, F.col("cs_code") == F.col("_cs"), "left").join(name("unit", "units"), F.col("unit_code") == F.col("_units"), "left")
    box = t["usage"].join(t["extent"].withColumnRenamed("name", "area_name"), F.col("extent_code") == F.col("code")).groupBy("object_code").agg(
        F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"),
        F.min_by("area_name", "extent_code").alias("area_name"))
    d = d.join(box, F.col("code") == F.col("object_code"), "left")
    return d.select("code", "name", "kind", "datum", "method", "units", "area_name", "south", "north", "west", "east",
                    F.lower("kind").contains("projected").alias("is_projected"), F.lower("kind").contains("geographic").alias("is_geographic"))


def haystack() -> Column:
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("code", "name", "area_name", "datum", "method", "units")]))
    found = lambda t: F.array_compact(F.array(*[F.when(t.contains(means), F.lit(alias)) for alias, means in AREA_ALIASES.items()]))
    return G.let(text, lambda t: F.concat_ws(" ", t, found(t)))


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))


def search_crs(queries: DataFrame, catalog: DataFrame, n: int = 50) -> DataFrame:
    """``query_id, rank, code, name, score``: every token inside the entry's text, or the exact code.

    Equal texts are searched once. They meet entries on one piece of the longest token, five characters or three where it has
    them, so no text is compared with the whole catalogue; the texts are written first, so that few go to the index, not the
    index to them.
    """
    cat = spread(G.pin(catalog, _hay=haystack()).select("code", "name", "_hay"))
    pieces = F.array_distinct(F.concat(*[_grams(F.col("_hay"), k) for k in (1, 2, 3, PIECE)]))
    index = cat.select("code", "name", "_hay", F.explode(pieces).alias("_piece"))
    q = queries.withColumn("_q", F.trim("query")).where(F.length("_q") > 0).select("query_id", "_q", F.lower("_q").alias("_low")).distinct()
    texts = q.select("_low").distinct().withColumn("_tokens", F.filter(F.split("_low", "[ ,/-]"), lambda t: F.length(t) > 0))
    longest = F.array_max(F.transform("_tokens", lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))))["t"]
    texts = stored(texts.withColumn("_piece", G.let(longest, lambda t: F.substring(t, F.lit(1), F.when(F.length(t) >= PIECE, PIECE).otherwise(3)))))
    by_text = texts.where(F.size("_tokens") > 0).join(index, "_piece").where(F.forall("_tokens", lambda t: F.col("_hay").contains(t)))
    cols = ["_low", "code", "name"]
    exact = texts.join(cat, F.col("_low") == F.col("code").cast("string"))
    score = F.when(F.col("_low") == F.col("code").cast("string"), 0).when(F.startswith(F.lower("name"), F.col("_low")), 1).otherwise(2)
    every = by_text.select(*cols).unionByName(exact.select(*cols)).distinct().withColumn("score", score)
    first = lambda d, key: d.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("score", F.length("name"), "code"))).where(F.col("rank") <= n)
    best = first(every, "_low").drop("rank")
    # An id may come with several texts.
    return first(q.join(best, "_low"), "query_id").select("query_id", "rank", "code", "name", "score")


def find_crs(requests: DataFrame, catalog: DataFrame, col: str, prefix: str) -> DataFrame:
    """Left join of a CRS id column to its catalogue entry; columns gain ``prefix``."""
    p = C.parse_crs(col)
    d = requests.withColumn("_p", p).withColumn("_code", F.when(F.col("_p.authority") == "EPSG", F.col("_p.code")))
    c = catalog.select(*[F.col(x).alias(prefix + x) for x in catalog.columns])
    return d.join(c, F.col("_code") == F.col(prefix + "code"), "left").drop("_p", "_code")


def crs_for_points(points: DataFrame, catalog: DataFrame, k: int = 20, pid: str = "pid", lon: str = "lon", lat: str = "lat",
                   size: float = 10.0) -> DataFrame:
    """Projected entries whose area holds each point, smallest area first; areas may cross the antimeridian.

    Each cell keeps its own short list of areas, so a point does not meet every area that holds it; crowded cells with long
    lists are split.
    """
    box = catalog.where(F.col("is_projected") & F.col("south").isNotNull() & F.col("north").isNotNull() & F.col("west").isNotNull() & F.col("east").isNotNull())
    width = F.when(F.col("west") <= F.col("east"), F.col("east") - F.col("west")).otherwise(F.col("east") - F.col("west") + 360)
    box = box.withColumn("area_size", F.greatest(F.lit(0.0), F.col("north") - F.col("south")) * width)
    span = lambda a, b: F.struct(a.cast("double").alias("w"), b.cast("double").alias("e"))
    pieces = F.when(F.col("west") <= F.col("east"), F.array(span(F.col("west"), F.col("east")))).otherwise(
        F.array(span(F.col("west"), F.lit(180.0)), span(F.lit(-180.0), F.col("east"))))
    box = box.withColumn("_s", F.explode(pieces)).withColumns({"_w": F.col("_s.w"), "_e": F.col("_s.e")}).drop("_s")
    box = box.where(F.col("south") <= F.col("north"))
    fine = 2 ** SPLITS
    at = points.withColumns({"_fx": S._cell(F.col(lon), size / fine), "_fy": S._cell(F.col(lat), size / fine)})
    lists, places = _short_lists(box, at, k, size)
    at = at.join(places, ["_fx", "_fy"]).withColumns({c: _above(f, F.lit(SPLITS) - F.col("_lv")) for c, f in CELL_OF.items()}).drop(*CELL_OF.values())
    j = at.hint(GROWS).join(lists, ["_lv", *CELL_OF]).where(F.col(lon).between(F.col("_w"), F.col("_e")) & F.col(lat).between(F.col("south"), F.col("north")))
    w = W.partitionBy(pid).orderBy("area_size", "code")
    # Dealt by point before the ranks: a task that joins would sort all its pairs.
    j = j.drop("_lv", *CELL_OF, "_w", "_e").repartition(pid)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


CELL_OF = {"_cx": "_fx", "_cy": "_fy"}
#: A cell is split, at most so often, where it holds so many points and its list of areas is long.
SPLITS, CROWD = 6, 64


def _above(c: str, levels) -> Column:
    """The cell that holds a cell so many levels up."""
    return F.floor(F.col(c) / F.pow(F.lit(2.0), levels)).cast("long")


def _short_lists(box: DataFrame, at: DataFrame, k: int, size: float) -> tuple[DataFrame, DataFrame]:
    """``_lv, _cx, _cy`` with the areas that can be among the ``k`` smallest of a point there, and ``_fx, _fy, _lv`` of the points' cells.

    In a cell, an area comes after ``k`` smaller ones that cover the whole cell, or after ``k`` that cover the same part of it, is no
    point's answer. Crowded cells with long lists are split, list by list, so that large areas never meet the finest cells.
    """
    few = max(64, 4 * k)
    crowd = stored(at.where("_fx IS NOT NULL AND _fy IS NOT NULL").groupBy("_fx", "_fy").agg(F.count("*").alias("_n")))
    todo, lists, places = S.cells(box, size, ("_w", "south", "_e", "north")), None, None
    more = lambda d, e: e if d is None else d.unionByName(e)
    for lv in range(SPLITS + 1):
        step = size / 2 ** lv
        crowd = crowd.withColumns({c: _above(f, F.lit(SPLITS - lv)) for c, f in CELL_OF.items()})
        there = crowd.groupBy(*CELL_OF).agg(F.sum("_n").alias("_n"))
        low, high = {c: F.col(c) * step for c in CELL_OF}, {c: (F.col(c) + 1) * step for c in CELL_OF}
        clip = [F.greatest("_w", low["_cx"]), F.least("_e", high["_cx"]), F.greatest("south", low["_cy"]), F.least("north", high["_cy"])]
        full = (F.col("_w") <= low["_cx"]) & (F.col("_e") >= high["_cx"]) & (F.col("south") <= low["_cy"]) & (F.col("north") >= high["_cy"])
        order = ["area_size", "code"]
        todo = todo.join(there.select(*CELL_OF), [*CELL_OF], "left_semi").repartition(*CELL_OF)
        todo = todo.withColumn("_pile", F.row_number().over(W.partitionBy(*CELL_OF, *clip).orderBy(*order))).where(F.col("_pile") <= k).drop("_pile")
        smaller = W.partitionBy(*CELL_OF).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        todo = todo.withColumn("_over", F.coalesce(F.sum(full.cast("int")).over(smaller), F.lit(0))).where(F.col("_over") < k).drop("_over")
        todo = stored(todo)
        long = todo.groupBy(*CELL_OF).agg(F.count("*").alias("_m")).where(F.col("_m") > few).join(there, [*CELL_OF]).where(F.col("_n") >= CROWD)
        last = lv == SPLITS
        hot = None if last else stored(long.select(*CELL_OF))
        last = last or hot.isEmpty()
        rest = lambda d: d if last else d.join(hot, [*CELL_OF], "left_anti")
        lists = more(lists, rest(todo).withColumn("_lv", F.lit(lv)))
        places = more(places, rest(crowd).select("_fx", "_fy", F.lit(lv).alias("_lv")))
        if last:
            return lists, stored(places)
        crowd = stored(crowd.join(hot, [*CELL_OF], "left_semi"))
        half = step / 2
        child = lambda c, a, b: F.explode(F.sequence(F.greatest(F.col(c) * 2, S._cell(a, half)), F.least(F.col(c) * 2 + 1, S._cell(b, half))))
        todo = todo.join(hot, [*CELL_OF], "left_semi").withColumn("_cx", child("_cx", "_w", "_e")).withColumn("_cy", child("_cy", "south", "north"))


# Fixed values of the zone guess.
UTM_EAST, UTM_NORTH = (100_000.0, 900_000.0), (-1_000_000.0, 10_100_000.0)


def suggest_crs(extents: DataFrame, catalog: DataFrame, parity: bool = False,
                metres_per_lat: float = 111_132.0, metres_per_lon: float = 111_320.0) -> DataFrame:
    """Ranked systems per document: declared, geographic by range, UTM zones by place, or a local grid.

    ``extents`` carries ``doc_id, minx, miny, maxx, maxy, declared``.  ``parity`` always names northern
    zones; otherwise a southern latitude names its southern zone.
    """
    row = lambda d, crs, conf, why: d.select("doc_id", crs.alias("crs"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"), F.lit(0.0).alias("_a"))
    none = F.lit(None).cast("string")
    dec = find_crs(extents.where(F.length(F.trim("declared")) > 0), catalog.select("code"), "declared", "c_").where(F.col("c_code").isNotNull())
    out = row(dec, F.concat(F.lit("EPSG:"), F.col("c_code").cast("string")), 0.98, "declared")
    empty = extents.where(F.col("minx").isNull())
    out = out.unionByName(row(empty.join(dec.select("doc_id"), "doc_id", "left_anti"), none, 0.0, "empty"))
    full = extents.where(F.col("minx").isNotNull()).withColumns({"_x": (F.col("minx") + F.col("maxx")) / 2, "_y": (F.col("miny") + F.col("maxy")) / 2})
    geo = (F.col("minx") >= -180) & (F.col("maxx") <= 180) & (F.col("miny") >= -90) & (F.col("maxy") <= 90) & \
        (F.col("maxx") - F.col("minx") <= 20) & (F.col("maxy") - F.col("miny") <= 20)
    utm = (F.col("_x") > UTM_EAST[0]) & (F.col("_x") < UTM_EAST[1]) & (F.col("_y") > UTM_NORTH[0]) & (F.col("_y") < UTM_NORTH[1])
    out = out.unionByName(row(full.where(geo), F.lit("EPSG:4326"), 0.90, "geographic"))
    out = out.unionByName(row(full.where(~geo & ~utm), none, 0.55, "local"))
    u = full.where(~geo & utm)
    out = out.unionByName(row(u, none, 0.30, "local"))
    north = F.col("_y") < C.FALSE_NORTHING
    lat = F.when(north, F.col("_y") / metres_per_lat).otherwise((F.col("_y") - C.FALSE_NORTHING) / metres_per_lat)
    u = u.withColumn("_lat", lat)
    dlon = (F.col("_x") - C.FALSE_EASTING) / (F.greatest(F.lit(0.2), F.cos(F.radians("_lat"))) * metres_per_lon)
    z = u.withColumn("_dl", dlon).withColumn("_zone", F.explode(F.sequence(F.lit(1), F.lit(60))))
    z = z.withColumn("_lon", F.col("_zone") * 6 - 183 + F.col("_dl")).where(F.col("_lon").between(-180, 180))
    z = z.withColumn("_pid", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("_zone").cast("string")))
    areas = catalog.select("code", "is_projected", "area_name", "south", "north", "west", "east")
    hit = crs_for_points(z.select("_pid", "doc_id", "_zone", "_lon", "_lat"), areas, 1, "_pid", "_lon", "_lat")
    hit = hit.where(F.length("area_name") > 0)
    base = F.when(F.lit(parity) | (F.col("_lat") >= 0), 32600).otherwise(32700)
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("area_size", "_zone"))
    top = hit.withColumn("_rn", rank).where(F.col("_rn") <= 6)
    zones = top.select("doc_id", F.concat(F.lit("EPSG:"), (base + F.col("_zone")).cast("string")).alias("crs"), F.lit(0.55).alias("confidence"),
                       F.concat(F.lit("zone in "), F.col("area_name")).alias("reason"), F.col("_rn").cast("double").alias("_a"))
    out = out.unionByName(zones)
    order = F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("confidence").desc(), "_a", F.col("crs").asc_nulls_last()))
    return out.withColumn("rank", order).drop("_a")


def validate_crs(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """``request_id, severity, check`` per (document, input, output).

    ``requests`` carries ``request_id, input_crs, output_crs, units, minx, miny, maxx, maxy``.
    """
    d = find_crs(find_crs(requests, catalog, "input_crs", "i_"), catalog, "output_crs", "o_")
    d = d.withColumns({"_i": C.parse_crs("input_crs"), "_o": C.parse_crs("output_crs")})
    has_i, has_o = F.col("_i").isNotNull(), F.col("_o").isNotNull()
    both = has_i & has_o
    f = lambda sev, check: F.struct(F.lit(sev).alias("severity"), F.lit(check).alias("check"))
    when = lambda cond, sev, check: F.when(cond, f(sev, check))
    empty = F.col("minx").isNull()
    same = (F.col("_i.authority") == F.col("_o.authority")) & (F.col("_i.code") == F.col("_o.code"))
    lacks = F.coalesce(F.length(F.trim("units")) == 0, F.lit(True)) | F.coalesce(F.length("i_units") == 0, F.lit(True))
    ang = lambda c: F.lower(c).contains("degree")
    in_range = (F.col("minx") >= -180) & (F.col("maxx") <= 180) & (F.col("miny") >= -90) & (F.col("maxy") <= 90)
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    geo = F.coalesce("i_is_geographic", F.col("_i.is_geographic"))
    local = ~geo & (F.abs(cx) < 100_000) & (F.abs(cy) < 100_000)
    has_area = F.col("i_south").isNotNull() & F.col("i_north").isNotNull() & F.col("i_west").isNotNull() & F.col("i_east").isNotNull()
    box = ("minx", "miny", "maxx", "maxy")
    d = d.withColumns({"_w": C.reproject_extent(box, F.col("_i.code"), F.lit(C.GEOGRAPHIC)), "_t": C.reproject_extent(box, F.col("_i.code"), F.col("_o.code"))})
    wx, wy = (F.col("_w.minx") + F.col("_w.maxx")) / 2, (F.col("_w.miny") + F.col("_w.maxy")) / 2
    across = F.when(F.col("i_west") <= F.col("i_east"), wx.between(F.col("i_west"), F.col("i_east"))).otherwise((wx >= F.col("i_west")) | (wx <= F.col("i_east")))
    inside = wy.between(F.col("i_south"), F.col("i_north")) & across
    can_area = has_area & ~empty & F.col("_w").isNotNull()
    change = F.col("i_code").isNotNull() & F.col("o_code").isNotNull() & (F.col("i_is_projected") != F.col("o_is_projected"))
    can = same | (C.supported(F.col("_i.code")) & C.supported(F.col("_o.code")))
    o_geo = F.coalesce(F.col("o_is_geographic"), F.lit(False))
    off = o_geo & ((F.col("_t.minx") < -180) | (F.col("_t.maxx") > 180) | (F.col("_t.miny") < -90) | (F.col("_t.maxy") > 90))
    faults = F.array_compact(F.array(
        F.when(has_i, f("Information", "Input CRS")).otherwise(f("Error", "Input CRS")),
        F.when(has_o, f("Information", "Output CRS")).otherwise(f("Error", "Output CRS")),
        when(both & same, "Warning", "Input vs output"),
        F.when(both, F.when(lacks | (ang("units") != ang("i_units")), f("Warning", "Units")).otherwise(f("Information", "Units"))),
        F.when(both, F.when(empty, f("Warning", "Coordinate range")).when(geo & ~in_range, f("Error", "Coordinate range"))
               .when(~geo & in_range, f("Warning", "Coordinate range")).when(local, f("Warning", "Local engineering grid")).otherwise(f("Information", "Coordinate range"))),
        F.when(both & can_area, F.when(inside, f("Information", "Area of use")).otherwise(f("Warning", "Area of use"))),
        when(both & change, "Information", "Projection change"),
        F.when(both & ~empty, F.when(can, f("Information", "Transformation")).otherwise(f("Error", "Transformation"))),
        F.when(both & ~empty & can, F.when(off, f("Warning", "Transformed extent")).otherwise(f("Information", "Transformed extent"))),
        F.when(both & empty, F.when(can, f("Information", "Transformation")).otherwise(f("Warning", "Transformation")))))
    return d.select("request_id", F.explode(faults).alias("e")).select("request_id", "e.severity", "e.check")


SOURCE_CONFIDENCE = {  # fixed values
    "PrjSidecar": 0.95, "EmbeddedGeoData": 0.95, "VendorExtendedData": 0.95, "UserSupplied": 0.85, "ExtentHeuristic": 0.50, "ApplicationDefault": 0.30}


def detect_crs(documents: DataFrame, assumed: str | None = None) -> DataFrame:
    """The assumed system, else WGS 84, with the default's own certainty; the declared one is not read."""
    crs = C.parse_crs(F.lit(assumed)) if assumed else F.lit(None)
    named = C.crs_id(crs) if assumed else F.lit(None).cast("string")
    return documents.withColumns({
        "crs": F.coalesce(F.when(crs.isNotNull(), named), F.lit("EPSG:4326")), "crs_source": F.lit("ApplicationDefault"), "crs_confidence": F.lit(1.0)})


def source_confidence(c) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SOURCE_CONFIDENCE.items() for x in kv])
    return F.coalesce(F.try_element_at(table, G._c(c)), F.lit(0.0))
