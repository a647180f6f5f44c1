"""BIM and survey relations: attributes through relation tables, placement chains, blocks, faces, pipes and edges."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from .common import cut_lineage, stored

# --- parent chains ----------------------------------------------------------------------------------


def follow_chain(df: DataFrame, node: str, parent: str, sums: list[str] = (), rounds: int | None = None) -> DataFrame:
    """Root of every node and the sums of ``sums`` along its chain, itself included.

    Each round doubles the distance covered: a node adds what its current ancestor has gathered and
    points to that ancestor's ancestor.  Rounds stop when every pointer is resolved, or when they have
    covered more nodes than there are, so that what is left runs into a cycle and keeps a root on it.
    ``rounds`` sets a limit.  A parent that does not exist ends the chain.  Output adds ``root``.
    """
    d = df.select(F.col(node).alias("_id"), F.col(parent).alias("_up"), *sums)
    ids = d.select(F.col("_id").alias("_k"))
    d = d.join(ids, F.col("_up") == F.col("_k"), "left").withColumn("_up", F.when(F.col("_k").isNotNull(), F.col("_up"))).drop("_k")
    d = d.withColumn("root", F.col("_id"))
    nodes = None
    for done in itertools.count():
        d = stored(d)
        if done == 8:
            nodes = d.count()
        if done == rounds or (nodes is not None and 1 << done > nodes):
            break
        open_ = d.where(F.col("_up").isNotNull())
        if open_.limit(1).isEmpty():
            break
        anc = d.select(F.col("_id").alias("_k"), F.col("_up").alias("_next"), F.col("root").alias("_r"), *[F.col(s).alias("_s_" + s) for s in sums])
        step = open_.join(anc, F.col("_up") == F.col("_k")).select(
            "_id", F.col("_next").alias("_up"), *[(F.col(s) + F.col("_s_" + s)).alias(s) for s in sums], F.col("_r").alias("root"))
        d = d.where(F.col("_up").isNull()).unionByName(step)
    return d.select(F.col("_id").alias(node), *sums, "root")


def resolve_placements(placements: DataFrame) -> DataFrame:
    """Absolute point per placement: the sum of local offsets up the chain; rotation is ignored.

    ``placements`` carries ``id, parent_id, x, y, z``; a null offset adds nothing, a chain without any
    offset has no point, and a zero height is two-dimensional.
    """
    d = placements.select("id", "parent_id", *[F.coalesce(F.nanvl(c, F.lit(0.0)) if c == "z" else F.col(c), F.lit(0.0)).alias(c) for c in "xyz"],
                          F.when(F.col("x").isNotNull(), 1).otherwise(0).alias("located"))
    r = follow_chain(d, "id", "parent_id", ["x", "y", "z", "located"], rounds=8)  # 256 levels at most
    ok = F.col("located") > 0
    return r.select("id", F.when(ok, F.col("x")).alias("x"), F.when(ok, F.col("y")).alias("y"), F.when(ok & (F.col("z") != 0), F.col("z")).alias("z"))


# --- properties and relations to attributes ----------------------------------------------------------

QUANTITY = {"area": "Area", "length": "Length", "volume": "Volume"}  # fixed values


def flatten_properties(props: DataFrame) -> DataFrame:
    """Leaves of property sets as ``element_id, pos, name, value``.

    ``props`` carries ``prop_id, parent_id, element_id, pos, kind, name, value, values``; only top
    properties name their element.  Enumerations and lists are joined, complex ones are opened.
    """
    owner = props.where(F.col("parent_id").isNull()).select(F.col("prop_id").alias("root"), F.col("element_id").alias("_owner"))
    roots = follow_chain(props.where(F.col("parent_id").isNotNull() | (F.col("kind") == "complex")), "prop_id", "parent_id").select("prop_id", "root")
    nested = props.join(roots, "prop_id").join(owner, "root").where(F.col("kind") != "complex").drop("element_id").withColumnRenamed("_owner", "element_id")
    flat = props.where(F.col("parent_id").isNull() & (F.col("kind") != "complex"))
    cols = ["element_id", "pos", "kind", "name", "value", "values"]
    d = flat.select(*cols).unionByName(nested.select(*cols))
    text = F.when(F.col("kind").isin("enum", "list"), F.when(F.size("values") > 0, F.array_join("values", ", "))).otherwise(F.col("value"))
    q = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in QUANTITY.items()], F.col("name"))
    return d.select("element_id", "pos", q.alias("name"), text.alias("value")).where(F.col("value").isNotNull())


def first_relation(rel: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """First relation of each element by position."""
    return rel.groupBy(key).agg(F.min(F.struct("rel_pos", *cols)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def _long(df: DataFrame, rank: int, values: dict[str, Column]) -> DataFrame:
    e = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in values.items()]), lambda x: x["value"].isNotNull())
    return df.select("element_id", F.lit(rank).alias("rank"), F.lit(0).cast("long").alias("pos"), F.explode(e).alias("e")).select(
        "element_id", "rank", "pos", "e.name", "e.value")


def attach_bim_relations(products: DataFrame, rels: dict[str, DataFrame]) -> DataFrame:
    """Long attributes from relation tables; a later source overwrites a name, ignoring case.

    Order: spatial parent, container, host through its opening, material, classification, type, type
    properties, instance properties.  Every table is optional.
    """
    ent = products.select(F.col("element_id").alias("_e"), F.col("name").alias("_n"), F.col("ifc_type").alias("_t"),
                          (F.col("elevation") if "elevation" in products.columns else F.lit(None).cast("double")).alias("_z"))
    out = []

    def named(rel, target):
        return rel.join(ent, F.col(target) == F.col("_e"))

    if "decomposes" in rels:
        spatial = products.where("is_spatial").select("element_id")
        d = named(first_relation(rels["decomposes"], "element_id", ["parent_id"]), "parent_id").join(spatial, "element_id", "left_semi")
        out.append(_long(d, 1, {"ParentId": F.col("parent_id"), "ParentName": F.col("_n")}))
    if "contained" in rels:
        d = named(first_relation(rels["contained"], "element_id", ["container_id"]), "container_id")
        st = lambda c: F.when(F.col("_t") == "IfcBuildingStorey", c)
        out.append(_long(d, 2, {"BuildingStorey": st(F.col("_n")), "ContainedInStoreyId": st(F.col("container_id")), "Elevation": st(F.col("_z")),
                                "SpatialContainer": F.when(F.col("_t") != "IfcBuildingStorey", F.col("_n"))}))
    if "fills" in rels:
        voids = rels["voids"].groupBy("opening_id").agg(F.min("host_id").alias("host_id"))
        hosted = rels["fills"].join(voids, "opening_id").groupBy("element_id").agg(F.min_by("host_id", "rel_pos").alias("host_id"))
        out.append(_long(named(hosted, "host_id"), 3, {"HostId": F.col("host_id"), "HostName": F.col("_n"), "HostType": F.col("_t")}))
    if "material" in rels:
        out.append(_long(first_relation(rels["material"], "element_id", ["material"]), 4, {"Material": F.when(F.length(F.trim("material")) > 0, F.col("material"))}))
    if "classification" in rels:
        out.append(_long(first_relation(rels["classification"], "element_id", ["code", "class_name", "system"]), 5, {
            "ClassificationCode": F.col("code"), "ClassificationName": F.col("class_name"), "ClassificationSystem": F.col("system")}))
    if "typed" in rels:
        t = first_relation(rels["typed"], "element_id", ["type_id"]).join(rels["types"], "type_id")
        out.append(_long(t, 6, {"TypeName": F.col("type_name"), "TypeGlobalId": F.col("type_id"), "TypeIfcClass": F.col("type_class")}))
        if "type_props" in rels:
            p = t.select("element_id", "type_id").join(rels["type_props"], "type_id")
            out.append(p.select("element_id", F.lit(7).alias("rank"), "pos", "name", "value"))
    if "props" in rels:
        out.append(rels["props"].select("element_id", F.lit(8).alias("rank"), "pos", "name", "value"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    win = every.groupBy("element_id", F.lower("name").alias("_k")).agg(F.max(F.struct("rank", "pos", "name", "value")).alias("w"))
    return win.select("element_id", "w.name", "w.value")


SEMANTIC = {  # attribute behind each semantic column, per source system; fixed values
    "ifc": {"category": None, "family": "ObjectType", "type": "PredefinedType", "level": "BuildingStorey", "material": "Material"},
    "revit": {"category": "Category", "family": "Family", "type": "Type", "level": "Level", "material": "Material"},
    "civil3d": {"category": None, "layer": "Layer", "type": "Style"},
}
SEMANTIC_NUMBERS = ("Elevation", "Area", "Volume", "Length")


def _attr(attrs, name: str) -> Column:
    return F.get(F.filter(F.map_entries(attrs), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def semantic_features(elements: DataFrame, system: str) -> DataFrame:
    """Promote raw attributes to typed semantic columns by source system."""
    spec = SEMANTIC[system]
    col = {}
    for name in ("layer", "category", "family", "type", "level", "material"):
        source = spec.get(name, "")
        c = F.lit(None).cast("string") if source == "" else F.col("native_type") if source is None else _attr("attrs", source)
        col[name] = F.coalesce(c, F.col("native_type")) if (system, name) == ("revit", "category") else c
    from ..functions.values import as_double

    return elements.select("element_id", *[c.alias(n) for n, c in col.items()],
                           *[as_double(_attr("attrs", n)).alias(n.lower()) for n in SEMANTIC_NUMBERS])


def enrich_semantics(features: DataFrame, semantic: DataFrame) -> DataFrame:
    """Add the non-empty category, family and level of each feature's semantic row to its attributes."""
    s = semantic.select("element_id", *[F.col(c).alias("_" + c) for c in ("category", "family", "level")])
    pairs = F.filter(F.array(*[F.struct(F.lit(f"Semantic{c.title()}").alias("key"), F.col("_" + c).alias("value")) for c in ("category", "family", "level")]),
                     lambda e: F.length(e["value"]) > 0)
    kept = F.filter(F.map_entries("attrs"), lambda e: ~F.exists("_new", lambda n: F.lower(n["key"]) == F.lower(e["key"])))
    return features.join(s, "element_id", "left").withColumn("_new", pairs).withColumn(
        "attrs", F.map_from_entries(F.concat(kept, "_new"))).drop("_new", "_category", "_family", "_level")


def standard_attributes(elements: DataFrame) -> DataFrame:
    """Measures of the geometry and the joined names of extended data: ``area, length, closed, xdata``."""
    k = G.base_kind("geom")
    path = F.get(G.rings("geom"), F.lit(0))
    single_line = F.col("geom.kind") == G.LINE
    return elements.withColumns({
        "area": F.when(k == G.POLYGON, G.st_area("geom")), "length": F.when(single_line, G.st_length("geom")),
        "closed": F.when(k == G.POLYGON, F.lit(True)).when(single_line, G.is_closed(path)).when(F.col("geom").isNotNull(), F.lit(False)),
        "xdata": F.when(F.size("xdata_apps") > 0, F.array_join("xdata_apps", ","))})


def bim_named_attributes(elements: DataFrame, lookups: dict[str, DataFrame], materials: DataFrame | None = None) -> DataFrame:
    """Names behind element references, one left join per lookup.

    ``lookups`` maps an id column such as ``phase_id`` to a table ``id, name`` whose further columns are
    carried as ``<prefix>_<column>``.  ``materials`` carries ``element_id, material_pos, material_id,
    material_name``; names and ids are joined in order beside their count.
    """
    d = elements
    for ref, table in lookups.items():
        prefix = ref.removesuffix("_id")
        t = table.select(F.col("id").alias("_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in table.columns if c != "id"])
        d = d.join(t, F.col(ref) == F.col("_id"), "left").drop("_id")
    if materials is not None:
        m = materials.groupBy("element_id").agg(F.sort_array(F.collect_list(F.struct("material_pos", "material_name", "material_id"))).alias("_m"))
        joined = lambda f: F.nullif(F.array_join(F.filter(F.transform("_m", lambda e: e[f]), lambda v: F.length(v) > 0), "; "), F.lit(""))
        d = d.join(m, "element_id", "left").withColumns({
            "material": joined("material_name"), "material_ids": joined("material_id"), "material_count": F.size("_m")}).drop("_m")
    return d


NOT_MODEL = ("View", "BasePoint", "ProjectInfo", "Material")  # fixed values


def filter_model_elements(elements: DataFrame) -> DataFrame:
    """Rows with a model category that are not view-specific, not descriptive, and occupy space."""
    return elements.where(
        F.col("category").isNotNull() & (F.col("category_type") == "Model") & ~F.coalesce("view_specific", F.lit(False))
        & ~F.coalesce(F.col("element_class").isin(*NOT_MODEL), F.lit(False)) & F.col("minx").isNotNull())


# --- edges -----------------------------------------------------------------------------------------------

EDGE_RULES = {  # (attribute, category must contain, edges as (type, from, to, owner)); fixed values
    "ifc": (("ContainedInStoreyId", None, (("Contains", "ref", "self", "ref"),)),
            ("HostId", None, (("Hosts", "ref", "self", "ref"), ("BelongsTo", "self", "ref", "self")))),
    "revit": (("HostId", None, (("Hosts", "ref", "self", "ref"), ("BelongsTo", "self", "ref", "self"))),
              ("LevelId", None, (("Contains", "ref", "self", "ref"),))),
    "civil3d": (("StartNodeId", "Pipe", (("Connects", "self", "ref", "self"),)), ("EndNodeId", "Pipe", (("Connects", "self", "ref", "self"),)),
                ("AlignmentId", "Corridor", (("BelongsTo", "self", "ref", "self"),))),
}


def resolve_relationships(elements: DataFrame, system: str) -> DataFrame:
    """Edges ``owner_id, rel_type, src_id, dst_id`` from id attributes; a reference to no element adds none."""
    ids = elements.select(F.col("element_id").alias("ref")).distinct()
    refs = []
    for name, needs, edges in EDGE_RULES[system]:
        e = F.array(*[F.struct(F.lit(t).alias("rel_type"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(o).alias("o")) for t, a, b, o in edges])
        v = _attr("attrs", name)
        ok = F.length(v) > 0
        ok = ok & F.col("native_type").contains(needs) if needs else ok
        refs.append(F.when(ok, F.struct(v.alias("ref"), e.alias("edges"))))
    d = elements.select("element_id", F.explode(F.array_compact(F.array(*refs))).alias("r")).select("element_id", "r.ref", "r.edges")
    d = d.join(ids, "ref").select("element_id", "ref", F.explode("edges").alias("e"))
    pick = lambda side: F.when(F.col(f"e.{side}") == "self", F.col("element_id")).otherwise(F.col("ref"))
    return d.select(pick("o").alias("owner_id"), "e.rel_type", pick("a").alias("src_id"), pick("b").alias("dst_id"))


def targets(rels: DataFrame, rel_type: str) -> DataFrame:
    """``src_id, dst_id`` of edges that their own source holds."""
    return rels.where((F.col("rel_type") == rel_type) & (F.col("owner_id") == F.col("src_id"))).select("src_id", "dst_id")


def sources(rels: DataFrame, rel_type: str, of: DataFrame) -> DataFrame:
    """Owners of an edge of the type that points at one of ``of`` (``element_id``)."""
    e = rels.where(F.col("rel_type") == rel_type).select("owner_id", F.col("dst_id").alias("element_id"))
    return e.join(of.select("element_id"), "element_id", "left_semi").select("owner_id", F.col("element_id").alias("dst_id"))


REFERENCES = ("ParentId", "HostId", "ContainedInStoreyId")


def check_invariants(elements: DataFrame, attrs: DataFrame, semantic: DataFrame, rels: DataFrame) -> DataFrame:
    """Violations of the model's own integrity as ``code, element_id``."""
    ids = elements.select("element_id").where(F.length("element_id") > 0).distinct()
    missing = elements.where(F.coalesce(F.length("element_id"), F.lit(0)) == 0).select(F.lit("Id.Missing").alias("code"), "element_id")
    dup = elements.where(F.length("element_id") > 0).groupBy("element_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("Id.Duplicate").alias("code"), "element_id")
    ref = attrs.where(F.col("name").isin(*REFERENCES) & (F.length("value") > 0))
    lost = ref.join(ids.withColumnRenamed("element_id", "value"), "value", "left_anti").select(F.concat(F.lit("Dangling."), "name").alias("code"), "element_id")
    bare = semantic.where(F.coalesce(F.length(F.trim("category")), F.lit(0)) == 0).select(F.lit("Category.Missing").alias("code"), "element_id")
    ends = rels.select(F.explode(F.array("src_id", "dst_id")).alias("element_id"))
    edge = ends.join(ids, "element_id", "left_anti").select(F.lit("Edge.Dangling").alias("code"), "element_id")
    nums = F.array(*[F.col(c.lower()) for c in SEMANTIC_NUMBERS])
    wild = semantic.where(F.exists(nums, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).select(F.lit("Quantity.NotFinite").alias("code"), "element_id")
    out = missing
    for p in (dup, lost, bare, edge, wild):
        out = out.unionByName(p)
    return out


COVERED = {"storey": "ContainedInStoreyId", "parent": "ParentId", "type": "TypeName", "material": "Material",
           "classification": "ClassificationCode", "host": "HostId"}


def coverage(attrs: DataFrame) -> DataFrame:
    """How many elements carry each kind of link."""
    low = F.lower("name")
    per = attrs.where(F.length("value") > 0).groupBy("element_id").agg(
        *[F.bool_or(low == a.lower()).alias(n) for n, a in COVERED.items()])
    return per.agg(F.count("*").alias("elements"), *[F.count_if(n).alias(n) for n in COVERED])


# --- layer filters, blocks --------------------------------------------------------------------------------

def filter_layers(elements: DataFrame, layers: DataFrame, include_invisible: bool = False, include_frozen: bool = False,
                  max_elements: int = 0) -> DataFrame:
    """Elements of readable layers, the first ``max_elements`` by position when that feature is asked for."""
    ok = layers
    if not include_invisible:
        ok = ok.where("is_visible")
    if not include_frozen:
        ok = ok.where("NOT is_frozen")
    keyed = elements.withColumn("_k", F.lower("layer"))
    out = keyed.join(ok.select(F.lower("layer").alias("_k")), "_k", "left_semi").drop("_k")
    return out.orderBy("pos").limit(max_elements) if max_elements > 0 else out


def element_limit_warning(elements: DataFrame, layers: DataFrame, max_elements: int, **readable) -> DataFrame:
    """``code, message``: one row where ``filter_layers`` stops at ``max_elements`` and leaves elements unread."""
    n = filter_layers(elements, layers, **readable).agg(F.count("*").alias("_n")).where((F.col("_n") > max_elements) & (F.lit(max_elements) > 0))
    return n.select(F.lit("Reader.ElementLimit").alias("code"), F.format_string("Read %d of %d elements: raise the limit to read all", F.lit(max_elements), F.col("_n")).alias("message"))


def unsupported_types(elements: DataFrame, supported: list[str]) -> DataFrame:
    """One row per entity type that has no converter."""
    return elements.where(~F.lower("native_type").isin(*[s.lower() for s in supported])).groupBy("native_type").agg(F.count("*").alias("n"))


FRAME = ("ox", "oy", "oz", "sx", "sy", "sz", "rot")


def _compose(outer: dict, pos: dict) -> dict:
    """Insert placed inside an outer frame: scale, rotate, translate; angles add and scales multiply."""
    c, s = F.cos(outer["rot"]), F.sin(outer["rot"])
    px, py = pos["x"] * outer["sx"], pos["y"] * outer["sy"]
    return {"ox": outer["ox"] + px * c - py * s, "oy": outer["oy"] + px * s + py * c, "oz": outer["oz"] + pos["z"] * outer["sz"],
            "sx": outer["sx"] * pos["sx"], "sy": outer["sy"] * pos["sy"], "sz": outer["sz"] * pos["sz"], "rot": outer["rot"] + F.radians(pos["rotation"])}


def apply_frame(g: Column, f: dict) -> Column:
    c, s = F.cos(f["rot"]), F.sin(f["rot"])

    def move(v):
        x, y = v["x"] * f["sx"], v["y"] * f["sy"]
        return F.struct((f["ox"] + x * c - y * s).alias("x"), (f["oy"] + x * s + y * c).alias("y"), (f["oz"] + v["z"] * f["sz"]).alias("z"))

    return G._map_rings(g, lambda r, i: F.transform(r, move))


INSERT_COLS = ("x", "y", "z", "sx", "sy", "sz", "rotation")


def explode_blocks(inserts: DataFrame, block_entities: DataFrame, max_depth: int = 8, explode: bool = True) -> DataFrame:
    """Entities of inserted blocks in drawing coordinates.

    ``inserts`` carries ``insert_id, block, x..rotation, attrs``; ``block_entities`` carries ``block,
    child_pos, native_type, geom`` and, for nested inserts, ``child_block`` with the insert columns and
    ``attrs``.  The outermost insert names the block and wins its tags.  Past ``max_depth``, or when not
    exploding, an insert is one point.
    """
    I = lambda p="": {c: F.col(p + c) for c in INSERT_COLS}
    unit = {k: F.lit(1.0 if k[0] == "s" else 0.0) for k in FRAME}
    here = _compose(unit, I())
    base = inserts.select(
        "insert_id", F.col("block").alias("block_name"), "block", "attrs", F.array().cast("array<int>").alias("path"),
        *[here[k].alias(k) for k in FRAME], F.col("x").alias("px"), F.col("y").alias("py"), F.col("rotation"), F.col("sx").alias("scale_x"), F.col("sy").alias("scale_y"))
    point = lambda d, depth: d.select(
        "insert_id", "path", "block_name", F.lit("INSERT").alias("native_type"), G.point("px", "py").alias("geom"), "attrs",
        F.col("rotation").alias("block_rotation"), F.lit(depth).alias("depth"))
    if not explode:
        return point(base, 0)
    out, frontier = None, base
    for depth in range(1, max_depth + 1):
        e = block_entities.withColumnsRenamed({**{c: "n_" + c for c in INSERT_COLS}, "attrs": "n_attrs", "block": "_b"})
        j = cut_lineage(frontier.drop("px", "py", "rotation", "scale_x", "scale_y").join(e, F.col("block") == F.col("_b")))
        f = {k: F.col(k) for k in FRAME}
        path = F.concat("path", F.array(F.col("child_pos").cast("int")))
        leaf = j.where(F.col("child_block").isNull()).select(
            "insert_id", path.alias("path"), "block_name", "native_type", apply_frame(F.col("geom"), f).alias("geom"), "attrs",
            F.lit(None).cast("double").alias("block_rotation"), F.lit(depth).alias("depth"))
        out = leaf if out is None else out.unionByName(leaf)
        nested = j.where(F.col("child_block").isNotNull())
        if nested.limit(1).isEmpty():
            return out
        inner = _compose(f, I("n_"))
        tags = F.map_concat(F.map_filter(F.coalesce("n_attrs", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("attrs", k)), "attrs")
        frontier = nested.select(
            "insert_id", "block_name", F.col("child_block").alias("block"), tags.alias("attrs"), path.alias("path"), *[inner[k].alias(k) for k in FRAME],
            inner["ox"].alias("px"), inner["oy"].alias("py"), F.col("n_rotation").alias("rotation"), F.col("n_sx").alias("scale_x"), F.col("n_sy").alias("scale_y"))
    return out.unionByName(point(frontier, max_depth))


# --- survey surfaces and pipes ------------------------------------------------------------------------------

def tin_faces(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles from id triples: counter-clockwise ring and mean finite height, 0 when there is none.

    ``points`` carries ``surface, point_id, pos, x, y, z`` (the last definition of an id wins);
    ``faces`` carries ``surface, face_id, ids`` and whatever else should be kept.
    """
    p = points.groupBy("surface", "point_id").agg(F.max(F.struct("pos", "x", "y", "z")).alias("v"))
    d = faces.where(F.size("ids") >= 3)
    for i in range(3):
        side = p.select(F.col("surface").alias("_s"), F.col("point_id").alias("_p"), F.col("v").alias(f"_v{i}"))
        d = d.join(side, (F.col("surface") == F.col("_s")) & (F.get("ids", F.lit(i)) == F.col("_p"))).drop("_s", "_p")
    v = [F.col(f"_v{i}") for i in range(3)]
    dot = lambda a: G.vertex(a["x"], a["y"], a["z"])
    twice = (v[1]["x"] - v[0]["x"]) * (v[2]["y"] - v[0]["y"]) - (v[2]["x"] - v[0]["x"]) * (v[1]["y"] - v[0]["y"])
    ring = F.when(twice < 0, F.array(dot(v[0]), dot(v[2]), dot(v[1]), dot(v[0]))).otherwise(F.array(dot(v[0]), dot(v[1]), dot(v[2]), dot(v[0])))
    z = F.filter(F.array(*[a["z"] for a in v]), lambda h: h.isNotNull() & ~F.isnan(h) & (F.abs(h) != float("inf")))
    height = F.when(F.size(z) > 0, G.total(z) / F.size(z)).otherwise(F.lit(0.0))
    return d.withColumns({"geom": G.polygon(ring), "elevation": height}).drop("_v0", "_v1", "_v2")


def pipe_lines(pipes: DataFrame, structures: DataFrame) -> DataFrame:
    """Pipe paths: a 3D list of two or more points, else a coordinate path, else start to end structure.

    ``pipes`` carries ``network, pipe_id, start_id, end_id, list3d, path`` (arrays of vertices or null);
    ``structures`` carries ``network, structure_id, centre`` (a vertex).
    """
    s = lambda side: structures.select(F.col("network").alias(f"_n{side}"), F.col("structure_id").alias(f"_i{side}"), F.col("centre").alias(f"_c{side}"))
    d = pipes.join(s("a"), (F.col("network") == F.col("_na")) & (F.col("start_id") == F.col("_ia")), "left")
    d = d.join(s("b"), (F.col("network") == F.col("_nb")) & (F.col("end_id") == F.col("_ib")), "left")
    long = lambda c: F.when(F.size(c) >= 2, F.col(c))
    straight = F.when(F.col("_ca").isNotNull() & F.col("_cb").isNotNull(), F.array("_ca", "_cb"))
    how = F.when(long("list3d").isNotNull(), "list3d").when(long("path").isNotNull(), "path").when(straight.isNotNull(), "structures")
    d = d.withColumn("source", how).where(F.col("source").isNotNull())
    return d.withColumn("geom", G.line(F.coalesce(long("list3d"), long("path"), straight))).drop("_na", "_ia", "_ca", "_nb", "_ib", "_cb")
