"""Queries over BIM relations, placements, properties, edges, blocks, faces and pipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import relations as R
from . import derive as V
from .derive import with_sql
from .registry import load, query

ks = lambda c: c.cast("string")


@query("placement_chain", """
SELECT c.p_partkey AS id, CASE WHEN c.p_partkey // 100 % 5 <> 4 THEN round(sum(p.p_size), 6)::DOUBLE END AS x,
 CASE WHEN c.p_partkey // 100 % 5 <> 4 THEN round(sum(p.p_retailprice), 6) END AS y, CASE WHEN c.p_partkey // 100 % 5 NOT IN (3, 4) THEN count(*)::DOUBLE END AS z
FROM part c JOIN part p ON p.p_partkey // 100 = c.p_partkey // 100 AND p.p_partkey <= c.p_partkey GROUP BY c.p_partkey""")
def placement_chain(spark, sf):
    k = F.col("p_partkey")
    grp = F.floor(k / 100) % 5
    d = load(spark, sf, "part").select(
        k.alias("id"), F.when(k % 100 != 0, k - 1).alias("parent_id"), F.when(grp != 4, F.col("p_size").cast("double")).alias("x"),
        F.when(grp != 4, F.col("p_retailprice")).alias("y"), F.when(grp == 3, 0.0).otherwise(1.0).alias("z"))
    return R.resolve_placements(d).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "z")


def property_rows(spark, sf):
    """Line items as properties: every fifth is complex and the next two of its order nest inside it."""
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    grp = F.floor(k / 5)
    kind = F.when(k % 5 == 0, "complex").when(k % 5 == 1, "single").when(k % 5 == 2, "complex").when(k % 5 == 3, "enum").otherwise("area")
    parent = F.when(k % 5 == 1, k - 1).when(k % 5 == 2, k - 2).when(k % 5 == 3, k - 1)
    return o.select(
        k.alias("prop_id"), parent.alias("parent_id"), F.when(k % 5 == 0, grp).when(k % 5 == 4, grp).alias("element_id"), k.alias("pos"), kind.alias("kind"),
        F.col("o_orderstatus").alias("name"), ks(F.col("o_custkey")).alias("value"), F.array(ks(F.col("o_custkey")), F.lit("x")).alias("values"))


@query("property_sets", """
SELECT o_orderkey // 5 AS element_id, o_orderkey AS pos, CASE o_orderkey % 5 WHEN 4 THEN 'Area' ELSE o_orderstatus END AS name,
 CASE o_orderkey % 5 WHEN 3 THEN o_custkey || ', x' ELSE CAST(o_custkey AS VARCHAR) END AS value FROM orders WHERE o_orderkey % 5 IN (1, 3, 4)""")
def property_sets(spark, sf):
    return R.flatten_properties(property_rows(spark, sf))


def bim_tables(spark, sf):
    b = V.bim_elements(spark, sf)
    prod = b.select("element_id", "name", F.col("category").alias("ifc_type"), F.col("category").isin("IfcSite", "IfcBuildingStorey").alias("is_spatial"), "elevation")
    c = load(spark, sf, "customer")
    k = F.col("c_custkey")
    eid = F.concat(F.lit("C"), ks(k)).alias("element_id")
    li = F.explode(F.array(F.lit(0), F.lit(1))).alias("rel_pos")
    rels = {
        "decomposes": b.where(F.col("parent_id").isNotNull()).select("element_id", F.lit(0).alias("rel_pos"), "parent_id"),
        "contained": c.select(eid, li, "c_nationkey").select("element_id", "rel_pos", F.when(F.col("rel_pos") == 0, F.concat(
            F.when(F.col("c_nationkey") < 20, "N").otherwise("R"), ks(F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).otherwise(F.col("c_nationkey") - 20))))
            .otherwise("N0").alias("container_id")),
        "fills": b.where(F.col("host_id").isNotNull()).select("element_id", F.lit(0).alias("rel_pos"), F.concat(F.lit("O"), "element_id").alias("opening_id")),
        "voids": b.where(F.col("host_id").isNotNull()).select(F.concat(F.lit("O"), "element_id").alias("opening_id"), "host_id"),
        "material": c.select(eid, F.lit(0).alias("rel_pos"), F.when(k % 4 != 0, F.col("c_mktsegment")).otherwise("  ").alias("material")),
        "classification": c.where(k % 3 == 0).select(eid, F.lit(0).alias("rel_pos"), F.concat(F.lit("Pr_"), ks(k % 50)).alias("code"), F.col("c_mktsegment").alias("class_name"), F.lit("Uniclass").alias("system")),
        "typed": c.select(eid, F.lit(0).alias("rel_pos"), F.concat(F.lit("T"), ks(F.floor(k / 20))).alias("type_id")),
        "types": c.select(F.concat(F.lit("T"), ks(k)).alias("type_id"), F.col("c_name").alias("type_name"), F.lit("IfcWallType").alias("type_class")),
        "type_props": c.select(F.concat(F.lit("T"), ks(k)).alias("type_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), F.col("c_mktsegment")).select(
            "type_id", "pos", F.when(F.col("pos") == 0, "FireRating").otherwise("LoadBearing").alias("name"), F.col("c_mktsegment").alias("value")),
        "props": c.select(eid, F.lit(0).alias("pos"), F.when(k % 2 == 0, "fireRating").otherwise("Material").alias("name"), F.lit("inst").alias("value")),
    }
    return prod, rels


V.CTE["bim_attrs"] = """SELECT element_id, 'ParentId' AS name, parent_id AS value FROM /*bim*/ bim WHERE category IN ('IfcSite','IfcBuildingStorey') AND parent_id IS NOT NULL
UNION ALL SELECT b.element_id, 'ParentName', p.name FROM bim b JOIN bim p ON p.element_id = b.parent_id WHERE b.category IN ('IfcSite','IfcBuildingStorey')
UNION ALL SELECT 'C' || c_custkey, 'BuildingStorey', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey < 20
UNION ALL SELECT 'C' || c_custkey, 'ContainedInStoreyId', 'N' || c_nationkey FROM customer WHERE c_nationkey < 20
UNION ALL SELECT 'C' || c_custkey, 'Elevation', CAST(c_nationkey*3.5::DOUBLE AS VARCHAR) FROM customer WHERE c_nationkey < 20
UNION ALL SELECT 'C' || c_custkey, 'SpatialContainer', r_name FROM customer JOIN region ON r_regionkey = c_nationkey - 20 WHERE c_nationkey >= 20
UNION ALL SELECT b.element_id, 'HostId', b.host_id FROM bim b JOIN bim h ON h.element_id = b.host_id
UNION ALL SELECT b.element_id, 'HostName', h.name FROM bim b JOIN bim h ON h.element_id = b.host_id
UNION ALL SELECT b.element_id, 'HostType', h.category FROM bim b JOIN bim h ON h.element_id = b.host_id
UNION ALL SELECT 'C' || c_custkey, 'Material', CASE WHEN c_custkey % 2 = 1 THEN 'inst' ELSE c_mktsegment END FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 4 <> 0
UNION ALL SELECT 'C' || c_custkey, 'ClassificationCode', 'Pr_' || (c_custkey % 50) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'C' || c_custkey, 'ClassificationName', c_mktsegment FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'C' || c_custkey, 'ClassificationSystem', 'Uniclass' FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'C' || c.c_custkey, 'TypeName', t.c_name FROM customer c JOIN customer t ON t.c_custkey = c.c_custkey // 20
UNION ALL SELECT 'C' || c_custkey, 'TypeGlobalId', 'T' || (c_custkey // 20) FROM customer
UNION ALL SELECT 'C' || c_custkey, 'TypeIfcClass', 'IfcWallType' FROM customer
UNION ALL SELECT 'C' || c.c_custkey, CASE WHEN c.c_custkey % 2 = 0 THEN 'fireRating' ELSE 'FireRating' END, CASE WHEN c.c_custkey % 2 = 0 THEN 'inst' ELSE t.c_mktsegment END
 FROM customer c JOIN customer t ON t.c_custkey = c.c_custkey // 20
UNION ALL SELECT 'C' || c.c_custkey, 'LoadBearing', t.c_mktsegment FROM customer c JOIN customer t ON t.c_custkey = c.c_custkey // 20"""


@query("bim_relations", with_sql("bim_attrs", body="SELECT * FROM bim_attrs"))
def bim_relations(spark, sf):
    return R.attach_bim_relations(*bim_tables(spark, sf))


@query("attribute_coverage", with_sql("bim_attrs", body="""
SELECT count(*) AS elements, count(*) FILTER (s) AS storey, count(*) FILTER (p) AS parent, count(*) FILTER (t) AS type, count(*) FILTER (m) AS material,
 count(*) FILTER (c) AS classification, count(*) FILTER (h) AS host FROM (SELECT element_id, bool_or(name='ContainedInStoreyId') AS s, bool_or(name='ParentId') AS p,
 bool_or(name='TypeName') AS t, bool_or(name='Material') AS m, bool_or(name='ClassificationCode') AS c, bool_or(name='HostId') AS h FROM bim_attrs GROUP BY 1)"""))
def attribute_coverage(spark, sf):
    return R.coverage(R.attach_bim_relations(*bim_tables(spark, sf)))


def raw_bim(spark, sf):
    """Elements whose attributes hold the raw ids, as a reader leaves them."""
    b = V.bim_elements(spark, sf)
    attrs = F.map_filter(F.create_map(
        F.lit("ContainedInStoreyId"), F.col("storey_id"), F.lit("HostId"), F.col("host_id"), F.lit("ParentId"), F.col("parent_id"),
        F.lit("LevelId"), F.col("storey_id"), F.lit("StartNodeId"), F.col("parent_id"), F.lit("EndNodeId"), F.col("host_id"), F.lit("AlignmentId"), F.col("storey_id"),
        F.lit("ObjectType"), F.col("name"), F.lit("Elevation"), ks(F.col("elevation")), F.lit("area"), F.when(F.col("elevation") > 0, ks(F.col("elevation"))).otherwise("n/a"),
        F.lit("BuildingStorey"), F.col("storey_id"), F.lit("Family"), F.col("parent_id")), lambda k, v: v.isNotNull())
    nt = F.when(F.col("category") == "Door", "AeccDbPipe").when(F.col("category") == "IfcWall", "AeccDbCorridor").otherwise(F.col("category"))
    return b.select("element_id", "category", F.col("category").alias("ifc_type"), nt.alias("civil_type"), "name", attrs.alias("attrs"))


V.CTE["edges"] = """SELECT s.element_id AS owner_id, 'Contains' AS rel_type, s.element_id AS src_id, b.element_id AS dst_id FROM /*bim*/ bim b JOIN bim s ON s.element_id = b.storey_id
UNION ALL SELECT h.element_id, 'Hosts', h.element_id, b.element_id FROM bim b JOIN bim h ON h.element_id = b.host_id
UNION ALL SELECT b.element_id, 'BelongsTo', b.element_id, h.element_id FROM bim b JOIN bim h ON h.element_id = b.host_id"""


def ifc_edges(spark, sf):
    return R.resolve_relationships(raw_bim(spark, sf).withColumnRenamed("ifc_type", "native_type"), "ifc")


@query("relationship_edges", with_sql("edges", body="SELECT * FROM edges"))
def relationship_edges(spark, sf):
    return ifc_edges(spark, sf)


@query("relationship_edges_civil", with_sql("bim", body="""
SELECT b.element_id AS owner_id, 'Connects' AS rel_type, b.element_id AS src_id, p.element_id AS dst_id FROM bim b JOIN bim p ON p.element_id IN (b.parent_id, b.host_id) WHERE b.category = 'Door'
UNION ALL SELECT b.element_id, 'BelongsTo', b.element_id, p.element_id FROM bim b JOIN bim p ON p.element_id = b.storey_id WHERE b.category = 'IfcWall'"""))
def relationship_edges_civil(spark, sf):
    return R.resolve_relationships(raw_bim(spark, sf).withColumnRenamed("civil_type", "native_type"), "civil3d")


@query("edge_targets", with_sql("edges", body="SELECT src_id, count(*) AS n FROM edges WHERE rel_type = 'Contains' AND owner_id = src_id GROUP BY 1"))
def edge_targets(spark, sf):
    return R.targets(ifc_edges(spark, sf), "Contains").groupBy("src_id").agg(F.count("*").alias("n"))


@query("edge_sources", with_sql("edges", body="SELECT owner_id, dst_id FROM edges WHERE rel_type = 'Hosts'"))
def edge_sources(spark, sf):
    doors = raw_bim(spark, sf)
    return R.sources(ifc_edges(spark, sf), "Hosts", doors)


@query("missing_hosts", with_sql("bim", body="""
SELECT b.element_id AS feature_id, 1 AS severity FROM bim b WHERE category IN ('Door','IfcDoor','IfcWindow','Window') AND NOT EXISTS (SELECT 1 FROM bim h WHERE h.element_id = b.host_id)"""))
def missing_hosts(spark, sf):
    from ..operators.quality import check_missing_host

    s = raw_bim(spark, sf).select(F.lit("MODEL").alias("dataset"), F.col("element_id").alias("feature_id"), "category")
    return check_missing_host(s, ifc_edges(spark, sf)).select("feature_id", "severity")


@query("model_invariants", with_sql("bim", body="""
SELECT 'Dangling.ParentId' AS code, element_id FROM bim b WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bim p WHERE p.element_id = b.parent_id)
UNION ALL SELECT 'Dangling.HostId', element_id FROM bim b WHERE host_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bim p WHERE p.element_id = b.host_id)
UNION ALL SELECT 'Id.Duplicate', 'R' || r_regionkey FROM region UNION ALL SELECT 'Id.Missing', '' FROM region
UNION ALL SELECT 'Quantity.NotFinite', element_id FROM bim WHERE category = 'IfcSite'
UNION ALL SELECT 'Category.Missing', element_id FROM bim WHERE category = 'IfcBuildingStorey'"""))
def model_invariants(spark, sf):
    e = raw_bim(spark, sf)
    sites = e.where(F.col("category") == "IfcSite")
    elements = e.select("element_id").unionByName(sites.select("element_id")).unionByName(sites.select(F.lit("").alias("element_id")))
    attrs = e.select("element_id", F.explode("attrs").alias("name", "value"))
    site = F.col("category") == "IfcSite"
    sem = e.select("element_id", F.when(F.col("category") == "IfcBuildingStorey", " ").otherwise(F.col("category")).alias("category"),
                   F.when(site, float("nan")).otherwise(0.0).alias("elevation"), F.lit(None).cast("double").alias("area"),
                   F.lit(1.0).alias("volume"), F.lit(1.0).alias("length"))
    return R.check_invariants(elements, attrs, sem, ifc_edges(spark, sf))


@query("semantic_projection", with_sql("bim", body="""
SELECT element_id, category, name AS family, storey_id AS level, elevation, CASE WHEN elevation > 0 THEN elevation END AS area FROM bim"""))
def semantic_projection(spark, sf):
    s = R.semantic_features(raw_bim(spark, sf).withColumnRenamed("ifc_type", "native_type"), "ifc")
    return s.select("element_id", "category", "family", "level", "elevation", "area")


@query("semantic_enrichment", with_sql("bim", body="""
SELECT element_id, category AS cat, CASE WHEN parent_id IS NULL THEN NULL ELSE parent_id END AS fam, CASE WHEN storey_id IS NOT NULL THEN storey_id END AS level,
 (2 + CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END + CASE WHEN storey_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS n_attrs FROM bim"""))
def semantic_enrichment(spark, sf):
    e = raw_bim(spark, sf)
    sem = e.select("element_id", "category", R._attr("attrs", "Family").alias("family"), R._attr("attrs", "BuildingStorey").alias("level"))
    f = e.select("element_id", F.create_map(F.lit("semanticcategory"), F.lit("old"), F.lit("NAME"), F.col("name")).alias("attrs"))
    r = R.enrich_semantics(f, sem)
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    return r.select("element_id", at("SemanticCategory").alias("cat"), at("SemanticFamily").alias("fam"), at("SemanticLevel").alias("level"), F.size("attrs").cast("long").alias("n_attrs"))


@query("standard_attributes", with_sql("parcels", body="""
SELECT id, CASE WHEN id % 3 = 0 THEN round((maxx-minx)*(maxy-miny), 6) END AS area, CASE WHEN id % 3 = 1 THEN round(maxx-minx, 6) END AS length, id % 3 = 0 AS closed,
 CASE WHEN id % 5 = 0 THEN 'ACAD,' || o_orderpriority END AS xdata FROM parcels"""))
def standard_attributes(spark, sf):
    k = F.col("id")
    g = F.when(k % 3 == 0, G.rect("minx", "miny", "maxx", "maxy")).when(k % 3 == 1, G.line(F.array(G.vertex("minx", "miny"), G.vertex("maxx", "miny")))).otherwise(G.point("minx", "miny"))
    d = V.parcels(spark, sf).select("id", g.alias("geom"), F.when(k % 5 == 0, F.array(F.lit("ACAD"), F.col("o_orderpriority"))).alias("xdata_apps"))
    return R.standard_attributes(d).select("id", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"), "closed", "xdata")


@query("bim_named_attributes", """
SELECT c_custkey AS element_id, n_name AS level_name, n_nationkey*3.0::DOUBLE AS level_elevation, r_name AS phase_name,
 (SELECT string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS material,
 coalesce(nullif((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0), NULL)::BIGINT AS material_count
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = c_custkey % 7""")
def bim_named_attributes(spark, sf):
    k = F.col("c_custkey")
    e = load(spark, sf, "customer").select(k.alias("element_id"), F.col("c_nationkey").alias("level_id"), (k % 7).cast("int").alias("phase_id"))
    levels = load(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 3.0).alias("elevation"))
    phases = load(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    m = load(spark, sf, "orders").select(F.col("o_custkey").alias("element_id"), F.col("o_orderkey").alias("material_pos"),
                                         ks(F.col("o_orderkey")).alias("material_id"), F.col("o_orderpriority").alias("material_name"))
    r = R.bim_named_attributes(e, {"level_id": levels, "phase_id": phases}, m)
    return r.select("element_id", "level_name", "level_elevation", "phase_name", "material", F.col("material_count").cast("long").alias("material_count"))


@query("model_element_filter", """
SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0 AND p_size % 4 <> 1 AND p_partkey % 5 <> 2 AND p_type NOT IN ('SMALL') AND p_partkey % 11 <> 3""")
def model_element_filter(spark, sf):
    k = F.col("p_partkey")
    d = load(spark, sf, "part").select(
        k.alias("id"), F.when(k % 7 != 0, F.col("p_name")).alias("category"), F.when(F.col("p_size") % 4 == 1, "Annotation").otherwise("Model").alias("category_type"),
        F.when(k % 5 == 2, F.lit(True)).alias("view_specific"), F.when(F.col("p_type") == "SMALL", "BasePoint").otherwise(F.col("p_type")).alias("element_class"),
        F.when(k % 11 != 3, k.cast("double")).alias("minx"))
    return R.filter_model_elements(d).select("id")


@query("layer_filter", with_sql("elements", body="SELECT element_id, layer FROM elements WHERE layer NOT IN ('ANVIL', 'GEAR', 'ROD')"))
def layer_filter(spark, sf):
    e = V.elements(spark, sf)
    layers = e.select(F.lower("layer").alias("layer")).distinct().select(
        "layer", (~F.col("layer").isin("anvil", "gear")).alias("is_visible"), (F.col("layer") == "rod").alias("is_frozen"))
    return R.filter_layers(e, layers).select("element_id", "layer")


@query("unsupported_types", with_sql("elements", body="SELECT native_type, count(*) AS n FROM elements WHERE native_type NOT IN ('SMALL','LARGE','MEDIUM') GROUP BY 1"))
def unsupported_types(spark, sf):
    return R.unsupported_types(V.elements(spark, sf), ["small", "Large", "MEDIUM"])


def block_tables(spark, sf):
    """Blocks from parts: a chain of nested inserts per hundred parts, one line in each block; orders insert them."""
    k = F.col("p_partkey")
    p = load(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    blk = F.concat(F.lit("B"), ks(k))
    line = p.select(blk.alias("block"), F.lit(0).alias("child_pos"), F.lit("LINE").alias("native_type"),
                    G.line(F.array(G.vertex(F.lit(0.0), F.lit(0.0), F.lit(1.0)), G.vertex(F.col("p_size").cast("double"), F.lit(0.0), F.lit(1.0)))).alias("geom"),
                    F.lit(None).cast("string").alias("child_block"), *[F.lit(None).cast("double").alias(c) for c in R.INSERT_COLS], F.lit(None).cast("map<string,string>").alias("attrs"))
    nest = p.where(k % 10 != 9).join(p.select((k - 1).alias("_prev")), k == F.col("_prev"), "left_semi").select(
        blk.alias("block"), F.lit(1).alias("child_pos"), F.lit("INSERT").alias("native_type"), F.lit(None).cast(G.GEOM).alias("geom"),
        F.concat(F.lit("B"), ks(k + 1)).alias("child_block"), F.lit(10.0).alias("x"), F.lit(5.0).alias("y"), F.lit(1.0).alias("z"),
        F.lit(2.0).alias("sx"), F.lit(2.0).alias("sy"), F.lit(1.0).alias("sz"), F.lit(0.0).alias("rotation"), F.create_map(F.lit("TAG"), F.col("p_type"), F.lit("INNER"), F.lit("1")).alias("attrs"))
    o = load(spark, sf, "orders")
    i = o.select(F.col("o_orderkey").alias("insert_id"), F.concat(F.lit("B"), ks(F.col("o_orderkey") % 500)).alias("block"),
                 (F.col("o_orderkey") % 97).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy"), F.lit(1.0).alias("sz"),
                 F.when(F.col("o_orderkey") % 2 == 0, 90.0).otherwise(0.0).alias("rotation"), F.create_map(F.lit("TAG"), F.col("o_orderstatus")).alias("attrs"))
    return i, line.unionByName(nest)


@query("block_instances", """
WITH part_n AS (SELECT max(p_partkey) AS top FROM part),
ins AS (SELECT o_orderkey AS id, o_orderkey % 500 AS b, o_orderkey % 97 AS x, o_orderkey % 2 = 0 AS turned, o_orderstatus FROM orders),
lev AS (SELECT unnest(range(0, 5)) AS d),
leaf AS (SELECT id, b, x, turned, o_orderstatus, d, p_size, pow(2, d) AS s, 10*(pow(2, d)-1) AS dx, 5*(pow(2, d)-1) AS dy FROM ins JOIN lev ON d <= 3 AND (b % 10) + d <= 9 JOIN part ON p_partkey = b + d)
SELECT id AS insert_id, (d + 1)::BIGINT AS depth, 'LINE' AS native_type, 'B' || b AS block_name, o_orderstatus AS tag, round(CASE WHEN turned THEN x - dy ELSE x + dx END, 6) AS x1,
 round(CASE WHEN turned THEN dx + s*p_size ELSE dy END, 6) AS y2, (d + 1)::DOUBLE AS z FROM leaf
UNION ALL SELECT id, 4, 'INSERT', 'B' || b, o_orderstatus, round(CASE WHEN turned THEN x - 5*15 ELSE x + 10*15 END, 6), round(CASE WHEN turned THEN 10*15 ELSE 5*15 END, 6)::DOUBLE, NULL
 FROM ins WHERE (b % 10) + 4 <= 9 AND b + 4 <= (SELECT top FROM part_n)""")
def block_instances(spark, sf):
    i, e = block_tables(spark, sf)
    d = R.explode_blocks(i, e, max_depth=4)
    v = G.vertices("geom")
    return d.select("insert_id", F.col("depth").cast("long").alias("depth"), "native_type", "block_name", F.try_element_at("attrs", F.lit("TAG")).alias("tag"),
                    F.round(F.get(v, F.lit(0))["x"], 6).alias("x1"), F.round(F.element_at(v, -1)["y"], 6).alias("y2"), F.get(v, F.lit(0))["z"].alias("z"))


def tin_tables(spark, sf):
    o = load(spark, sf, "orders")
    k = F.col("o_orderkey")
    pts = o.select(F.lit("EG").alias("surface"), ks(k).alias("point_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"), "o_orderkey").select(
        "surface", "point_id", "pos", ((k % 120) * 10 + F.col("pos") * 0.0).alias("x"), (F.floor(k / 120) * 10.0).alias("y"),
        F.when(k % 50 == 0, float("nan")).otherwise((k % 7) + F.col("pos") * 10.0).alias("z"))
    ids = F.when(k % 40 == 0, F.array(ks(k), ks(k + 1))).when(k % 2 == 0, F.array(ks(k), ks(k + 1), ks(k + 120))).otherwise(F.array(ks(k), ks(k + 120), ks(k + 1)))
    faces = o.where(k % 120 != 119).select(F.lit("EG").alias("surface"), k.alias("face_id"), ids.alias("ids"), (k % 9 == 0).alias("invisible"))
    return pts, faces


@query("tin_faces", """
WITH z AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey % 7 + 10.0::DOUBLE END AS z FROM orders)
SELECT a.k AS face_id, a.k % 9 = 0 AS invisible, 50.0::DOUBLE AS signed_area,
 round(coalesce((coalesce(a.z,0)+coalesce(b.z,0)+coalesce(c.z,0))/nullif((a.z IS NOT NULL)::INT+(b.z IS NOT NULL)::INT+(c.z IS NOT NULL)::INT, 0), 0), 6) AS elevation
FROM z a JOIN z b ON b.k = a.k + 1 JOIN z c ON c.k = a.k + 120 WHERE a.k % 120 <> 119 AND a.k % 40 <> 0""")
def tin_faces(spark, sf):
    f = R.tin_faces(*tin_tables(spark, sf))
    return f.select("face_id", "invisible", G.ring_signed_area(F.get(G.rings("geom"), F.lit(0))).alias("signed_area"), F.round("elevation", 6).alias("elevation"))


@query("pipe_network", """
SELECT o_orderkey AS pipe_id, CASE WHEN o_orderkey % 4 = 0 THEN 'list3d' WHEN o_orderkey % 4 = 1 THEN 'path' ELSE 'structures' END AS source,
 round(CASE WHEN o_orderkey % 4 = 0 THEN 5 WHEN o_orderkey % 4 = 1 THEN 7 ELSE abs(a.s_nationkey - b.s_nationkey)*10 END, 6)::DOUBLE AS length
FROM orders LEFT JOIN supplier a ON a.s_suppkey = o_orderkey % 130 LEFT JOIN supplier b ON b.s_suppkey = o_custkey % 110
WHERE o_orderkey % 4 < 2 OR (a.s_suppkey IS NOT NULL AND b.s_suppkey IS NOT NULL)""")
def pipe_network(spark, sf):
    k = F.col("o_orderkey")
    at = lambda x: G.vertex(F.lit(float(x)), F.lit(0.0), F.lit(0.0))
    null = F.lit(None).cast(G.RING)
    pipes = load(spark, sf, "orders").select(
        F.lit("N").alias("network"), k.alias("pipe_id"), (k % 130).alias("start_id"), (F.col("o_custkey") % 110).alias("end_id"),
        F.when(k % 4 == 0, F.array(at(0), at(5))).when(k % 4 == 1, F.array(at(1))).otherwise(null).alias("list3d"),
        F.when(k % 4 <= 1, F.array(at(0), at(7))).otherwise(null).alias("path"))
    st = load(spark, sf, "supplier").select(F.lit("N").alias("network"), F.col("s_suppkey").alias("structure_id"),
                                            G.vertex(F.col("s_nationkey") * 10, F.lit(0.0), F.lit(0.0)).alias("centre"))
    p = R.pipe_lines(pipes, st)
    return p.select("pipe_id", "source", F.round(G.st_length("geom"), 6).alias("length"))
