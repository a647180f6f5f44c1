"""Queries over rule, semantic and lexical classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import lexical as L
from . import derive as V
from .derive import with_sql
from .registry import load, query

RULES = [
    C.MappingRule("Bolts", "Fastener", 100, layers=("bolt",)),
    C.MappingRule("Bolt lines", "Fastener line", 100, layers=("BOLT", "RING"), geometry_types=("line",)),
    C.MappingRule("Large plates", "Plate", 80, layers=("PLATE",), geometry_types=("Polygon",), min_area=950.0, max_area=1080.0),
    C.MappingRule("Blocks", "Symbol", 60, blocks=("blk_standard", "BLK_PROMO")),
    C.MappingRule("Red parts", "Red", 60, text_pattern="^RED "),
    C.MappingRule("Dashed small", "Hidden", 50, entity_types=("small",), linetypes=("dashed",)),
    C.MappingRule("Survey", "Surveyed", 40, xdata=("survey",), min_length=10.0),
    C.MappingRule("Brand one", "Branded", 40, attributes={"Color": "Brand#1"}),
    C.MappingRule("Brand two", "Branded", 40, conditions={"color": "BRAND#2", "linetype": "continuous"}),
    C.MappingRule("Nothing", "Never", 200),
]

# One SQL row per rule match, in rule order; the scores follow the number of conditions.
MATCH = """SELECT element_id, pos, 0 AS rule_pos, 'Bolts' AS rule_name, 'Fastener' AS label, 100 AS priority, {c1} AS confidence FROM E WHERE layer = 'BOLT'
UNION ALL SELECT element_id, pos, 1, 'Bolt lines', 'Fastener line', 100, {c2} FROM E WHERE layer IN ('BOLT','RING') AND geometry_kind = 'Line'
UNION ALL SELECT element_id, pos, 2, 'Large plates', 'Plate', 80, {c3} FROM E WHERE layer = 'PLATE' AND geometry_kind = 'Polygon' AND area BETWEEN 950 AND 1080
UNION ALL SELECT element_id, pos, 3, 'Blocks', 'Symbol', 60, {c1} FROM E WHERE block IN ('BLK_STANDARD','BLK_PROMO')
UNION ALL SELECT element_id, pos, 4, 'Red parts', 'Red', 60, {c1} FROM E WHERE text LIKE 'red %'
UNION ALL SELECT element_id, pos, 5, 'Dashed small', 'Hidden', 50, {c2} FROM E WHERE native_type = 'SMALL' AND linetype = 'DASHED'
UNION ALL SELECT element_id, pos, 6, 'Survey', 'Surveyed', 40, {c2} FROM E WHERE xdata LIKE '%SURVEY%' AND length >= 10
UNION ALL SELECT element_id, pos, 7, 'Brand one', 'Branded', 40, {c1} FROM E WHERE color = 'Brand#1'
UNION ALL SELECT element_id, pos, 8, 'Brand two', 'Branded', 40, {c2} FROM E WHERE color = 'Brand#2' AND linetype = 'CONTINUOUS'"""
V.CTE["cand"] = MATCH.format(c1="0.85::DOUBLE", c2="0.90::DOUBLE", c3="0.98::DOUBLE").replace("FROM E ", "FROM /*elements*/ elements ")
V.CTE["ranked"] = """SELECT *, row_number() OVER w AS rank, lead(confidence) OVER w AS runner_up, count(*) OVER (PARTITION BY element_id) AS nc
 FROM /*cand*/ cand WINDOW w AS (PARTITION BY element_id ORDER BY priority DESC, confidence DESC, rule_pos)"""
V.CTE["decided"] = """SELECT element_id, label, confidence, rule_name FROM /*ranked*/ ranked WHERE rank = 1 AND (nc = 1 OR confidence - runner_up >= 0.05::DOUBLE)"""


@query("rule_candidates", with_sql("ranked", body="SELECT element_id, rank, label, confidence, rule_name, priority FROM ranked"))
def rule_candidates(spark, sf):
    d = C.classify_rules(V.elements(spark, sf), RULES)
    return d.select("element_id", F.col("rank").cast("long").alias("rank"), "label", "confidence", "rule_name", "priority")


@query("candidate_ranking", with_sql("ranked", body="SELECT element_id, rank, rule_name, runner_up FROM ranked"))
def candidate_ranking(spark, sf):
    long = C.classify_rules(V.elements(spark, sf), RULES).drop("rank")
    return C.rank_candidates(long).select("element_id", F.col("rank").cast("long").alias("rank"), "rule_name", "runner_up")


def semantic_elements(spark, sf):
    e = V.elements(spark, sf)
    k = F.col("element_id")
    return e.select(
        "*", F.when(k % 3 == 0, F.col("layer")).alias("s_layer"), F.when(k % 5 == 0, F.lit("SMALL")).alias("category"),
        F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("s_block"),
        F.when(k % 4 == 1, "Brand#1").alias("s_color"), F.lit(None).cast("string").alias("s_linetype"),
        F.when(k % 6 == 2, 0.0).when(k % 6 == 5, 1000.0).alias("s_area"), F.lit(None).cast("double").alias("s_length"))


V.CTE["sem_elements"] = """SELECT element_id, pos, layer, geometry_kind, block, text, linetype, xdata, length,
 CASE WHEN element_id % 6 = 2 THEN NULL WHEN element_id % 6 = 5 THEN 1000.0::DOUBLE ELSE area END AS area,
 CASE WHEN element_id % 5 = 0 THEN 'SMALL' ELSE native_type END AS native_type, native_type AS own_type, color,
 element_id % 4 = 1 AS s_brand1 FROM /*elements*/ elements"""


@query("semantic_rule_candidates", with_sql("sem_elements", body="""
SELECT element_id, rule_name, confidence FROM (""" + MATCH.format(c1="0.88::DOUBLE", c2="0.93::DOUBLE", c3="0.99::DOUBLE").replace("FROM E ", "FROM sem_elements ") + ")"))
def semantic_rule_candidates(spark, sf):
    return C.classify_rules(semantic_elements(spark, sf), RULES, semantic=True).select("element_id", "rule_name", "confidence")


@query("classification_decision", with_sql("elements", "decided", body="""
SELECT e.element_id, coalesce(d.label, 'Unclassified') AS label, coalesce(d.confidence, 0.0::DOUBLE) AS confidence,
 CASE WHEN d.label IS NULL THEN 'Fallback' ELSE 'RuleEngine' END AS provider, d.rule_name, d.label IS NOT NULL AS accepted
FROM elements e LEFT JOIN decided d USING (element_id)"""))
def classification_decision(spark, sf):
    return C.decide(V.elements(spark, sf), RULES).drop("n_candidates")


LABELS = ["Rings", "Gear Wheel", "Anvil", "Blue Bolt", "Steel Rod Bar", "Plates", "Widget", "Old-Thing", "Boltes"]


def name_subjects(spark, sf):
    p = load(spark, sf, "part")
    k = F.col("p_partkey")
    meta = F.when(k % 11 == 0, F.create_map(F.lit("Category"), F.when(k % 2 == 0, "anvil").otherwise("Sun Path"))) \
        .when(k % 13 == 0, F.create_map(F.lit("builtInCategory"), F.lit("OST_Roads"))).otherwise(F.create_map().cast("map<string,string>"))
    return p.select(k.cast("string").alias("subject_id"), F.upper(F.regexp_replace("p_name", " ", "-")).alias("name"), meta.alias("metadata"))


# The eight second words and first words of part names against the labels, worked out per token.
V.CTE["lex_tokens"] = """SELECT DISTINCT p_name AS name, upper(replace(p_name,' ','-')) AS shown, unnest(string_split(p_name,' ')) AS token FROM part"""
V.CTE["lex_labels"] = """SELECT label, ord, token, n FROM (VALUES ('Rings',0,'rings',1),('Gear Wheel',0,'gear',2),('Gear Wheel',1,'wheel',2),('Anvil',0,'anvil',1),
 ('Blue Bolt',0,'blue',2),('Blue Bolt',1,'bolt',2),('Steel Rod Bar',0,'steel',3),('Steel Rod Bar',1,'rod',3),('Steel Rod Bar',2,'bar',3),('Plates',0,'plates',1),
 ('Widget',0,'widget',1),('Old-Thing',0,'old',2),('Old-Thing',1,'thing',2),('Boltes',0,'boltes',1)) t(label, ord, token, n)"""
V.CTE["lex_scores"] = """SELECT t.name, l.label, count(DISTINCT l.ord)::DOUBLE / l.n * 0.70::DOUBLE AS confidence FROM /*lex_tokens*/ lex_tokens t JOIN /*lex_labels*/ lex_labels l
 ON t.token = l.token OR t.token || 's' = l.token OR t.token || 'es' = l.token OR l.token || 's' = t.token OR l.token || 'es' = t.token GROUP BY t.name, l.label, l.n"""
V.CTE["lex_best"] = """SELECT *, row_number() OVER (PARTITION BY name ORDER BY confidence DESC, label) AS rn FROM /*lex_scores*/ lex_scores"""


@query("lexical_classification", with_sql("lex_best", body="""
SELECT CAST(p_partkey AS VARCHAR) AS subject_id,
 CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Anvil' ELSE 'Unclassified' END WHEN p_partkey % 13 = 0 THEN 'Widget'
  WHEN p_name LIKE '%gizmo' THEN 'Gear Wheel' WHEN b.confidence >= 0.25 THEN b.label ELSE 'Unclassified' END AS label,
 round(CASE WHEN p_partkey % 11 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END WHEN p_partkey % 13 = 0 THEN 0.95::DOUBLE
  WHEN p_name LIKE '%gizmo' THEN 0.8::DOUBLE WHEN b.confidence >= 0.25 THEN b.confidence ELSE 0.0::DOUBLE END, 6) AS confidence,
 CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_name NOT LIKE '%gizmo' AND b.confidence >= 0.25 THEN
  (SELECT count(*) FROM lex_best x WHERE x.name = p_name AND x.rn BETWEEN 2 AND 4) ELSE 0 END AS n_alternatives
FROM part LEFT JOIN lex_best b ON b.name = p_name AND b.rn = 1"""))
def lexical_classification(spark, sf):
    opts = L.LexicalOptions(keyword_rules={"NUT": "Anvil", "Gizmo": "gear wheel", "gizmos": "Nowhere"}, category_rules={"OST_Roads": "WIDGET"})
    r = L.classify_lexical(name_subjects(spark, sf), LABELS, opts)
    return r.select("subject_id", "label", F.round("confidence", 6).alias("confidence"), F.size("alternatives").cast("long").alias("n_alternatives"))


@query("keyword_rules", """
SELECT CAST(p_partkey AS VARCHAR) AS subject_id, CASE WHEN p_name LIKE '% bolt' THEN 'Blue Bolt' ELSE 'Widget' END AS label FROM part
WHERE p_name LIKE '% bolt' OR p_name LIKE 'old %'""")
def keyword_rules(spark, sf):
    opts = L.LexicalOptions(keyword_rules={"bolt": "blue bolt", "old": "widget"})
    s = name_subjects(spark, sf)
    return L.classify_names(s, LABELS, opts).where(F.col("source") == "keyword").select("subject_id", "label")


@query("category_unmapped", "SELECT 'Sun Path' AS category, count(*) AS n FROM part WHERE p_partkey % 11 = 0 AND p_partkey % 2 = 1")
def category_unmapped(spark, sf):
    opts = L.LexicalOptions(category_rules={"ost_roads": "Nowhere"})
    return L.unmapped_categories(L.classify_category(name_subjects(spark, sf), LABELS, opts))


@query("acceptance_levels", """
SELECT vec_id, c AS confidence, c >= 0.65::DOUBLE AS accepted, CASE WHEN c >= 0.95::DOUBLE THEN 'Automatic' WHEN c >= 0.80::DOUBLE THEN 'Review' WHEN c >= 0.60::DOUBLE THEN 'NeedsAttention' ELSE 'Unclassified' END AS level
FROM (SELECT vec_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((vec_id * 37) % 130)::DOUBLE / 100 - 0.1::DOUBLE)) AS c FROM embeddings)""")
def acceptance_levels(spark, sf):
    c = C.confidence(((F.col("vec_id") * 37) % 130).cast("double") / 100 - 0.1)
    return C.with_acceptance(load(spark, sf, "embeddings").select("vec_id", c.alias("confidence")))


def conversation_answers(spark, sf):
    c = load(spark, sf, "conversations")
    return c.select(F.concat(F.lit("Conv-"), F.col("conv_id").cast("string")).alias("subject_id"), F.col("role").alias("label"),
                    (F.length("text") % 100 / 100.0).alias("confidence"), F.col("turn").alias("pos"))


@query("reconciled_answers", """
SELECT 'CONV-' || s.id AS subject_id, coalesce(a.role, 'Unclassified') AS label, coalesce(a.c, 0.0::DOUBLE) AS confidence, a.role IS NOT NULL AS answered,
 coalesce(a.c >= 0.65::DOUBLE, false) AS accepted FROM (SELECT o_orderkey AS id FROM orders) s LEFT JOIN
 (SELECT conv_id, max_by(role, turn) AS role, max_by((length(text) % 100)::DOUBLE / 100, turn) AS c FROM conversations GROUP BY 1) a ON a.conv_id = s.id""")
def reconciled_answers(spark, sf):
    s = load(spark, sf, "orders").select(F.concat(F.lit("CONV-"), F.col("o_orderkey").cast("string")).alias("subject_id"))
    return C.reconcile(s, conversation_answers(spark, sf))


def block_elements(spark, sf):
    e = V.elements(spark, sf)
    return e.withColumn("native_type", F.when(F.col("geometry_kind") == "Point", F.concat(F.lit("BlockRef-"), F.col("native_type"))).otherwise(F.col("native_type")))


V.CTE["layer_text"] = """SELECT layer, text, min(pos) AS p, row_number() OVER (PARTITION BY layer ORDER BY min(pos)) AS rn FROM /*elements*/ elements GROUP BY layer, text"""
V.CTE["layer_block"] = """SELECT layer, block, min(pos) AS p, row_number() OVER (PARTITION BY layer ORDER BY min(pos)) AS rn FROM /*elements*/ elements WHERE block IS NOT NULL GROUP BY layer, block"""
V.CTE["layer_kind"] = """SELECT layer, geometry_kind, count(*) AS n, min(pos) AS p FROM /*elements*/ elements GROUP BY 1, 2"""


@query("layer_profiles", with_sql("layer_text", "layer_block", "layer_kind", body="""
SELECT layer, sum(n)::BIGINT AS entity_count, max_by(geometry_kind, n*1000000000 - p) AS dominant,
 string_agg(geometry_kind || ':' || n, ',' ORDER BY geometry_kind) AS mix,
 (SELECT string_agg(text, '|' ORDER BY p) FROM layer_text t WHERE t.layer = k.layer AND rn <= 4) AS texts,
 (SELECT string_agg(block, '|' ORDER BY p) FROM layer_block b WHERE b.layer = k.layer AND rn <= 4) AS blocks
FROM layer_kind k WHERE layer <> 'ANVIL' GROUP BY layer"""))
def layer_profiles(spark, sf):
    e = block_elements(spark, sf)
    layers = e.select("doc_id", "layer").distinct().withColumn("is_visible", F.col("layer") != "ANVIL")
    s = C.layer_subjects(e, layers, 4)
    mix = F.array_join(F.transform(F.array_sort(F.map_entries("geometry_profile")), lambda x: F.concat_ws(":", x["key"], x["value"])), ",")
    return s.select("layer", "entity_count", F.col("dominant_geometry").alias("dominant"), mix.alias("mix"),
                    F.array_join("sample_texts", "|").alias("texts"), F.array_join("block_names", "|").alias("blocks"))


@query("dominant_geometry", with_sql("layer_kind", body="""
SELECT layer, coalesce(max_by(geometry_kind, n*1000000000 - p) FILTER (geometry_kind <> 'Line'), 'Point') AS geometry FROM layer_kind GROUP BY layer"""))
def dominant_geometry(spark, sf):
    e = V.elements(spark, sf).withColumn("geometry_kind", F.when(F.col("geometry_kind") == "Line", "Unknown").otherwise(F.col("geometry_kind")))
    return C.dominant_geometry(e, ["layer"])


@query("output_classes", with_sql("elements", "decided", body="""
SELECT coalesce(d.label, e.layer) AS feature_class, count(*) AS n FROM elements e LEFT JOIN decided d USING (element_id) GROUP BY 1"""))
def output_classes(spark, sf):
    e = V.elements(spark, sf)
    ruled = C.decide(e, RULES).where(F.col("provider") == "RuleEngine")
    return C.group_virtual_layers(e, ruled).groupBy("feature_class").agg(F.count("*").alias("n"))


@query("entity_type_counts", """
SELECT l_returnflag AS layer, min(t) AS entity_type, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_partkey % 10 = 0 THEN NULL
 WHEN l_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END AS nt, p_type, coalesce(CASE WHEN l_partkey % 10 = 0 THEN NULL
 WHEN l_partkey % 2 = 0 THEN p_type ELSE lower(p_type) END, 'Line') AS t FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, lower(t)""")
def entity_type_counts(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_type")
    k = F.col("l_partkey")
    e = load(spark, sf, "lineitem").select("l_partkey", F.col("l_returnflag").alias("layer")).join(p, k == F.col("p_partkey")).select(
        "layer", F.when(k % 10 == 0, None).when(k % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type")).alias("native_type"), F.lit("Line").alias("geometry_kind"))
    return C.entity_type_counts(e, ["layer"])


@query("classification_statistics", with_sql("elements", "ranked", body="""
SELECT layer, count(*) AS total, count(*) FILTER (r.label IS NULL) AS unclassified, round(coalesce(avg(r.confidence), 0), 9) AS mean_confidence
FROM elements e LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (element_id) GROUP BY 1"""))
def classification_statistics(spark, sf):
    e = V.elements(spark, sf)
    top = C.with_candidates(e, RULES).select("layer", F.get("candidates", F.lit(0)).alias("w")).select("layer", "w.label", "w.rule_name", "w.confidence")
    return C.classification_stats(top, ["layer"]).withColumn("mean_confidence", F.round("mean_confidence", 9))


@query("class_and_rule_usage", with_sql("ranked", body="""
SELECT 'class' AS kind, label AS value, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY 2 UNION ALL SELECT 'rule', rule_name, count(*) FROM ranked WHERE rank = 1 GROUP BY 2"""))
def class_and_rule_usage(spark, sf):
    top = C.with_candidates(V.elements(spark, sf), RULES).select(F.get("candidates", F.lit(0)).alias("w")).select("w.label", "w.rule_name")
    return C.usage_counts(top)


@query("rule_simulation", with_sql("elements", "ranked", "cand", body="""
SELECT 'all' AS profile_id, count(*) AS total, count(*) FILTER (r.label IS NULL) AS unclassified, sum(coalesce(r.nc, 0))::BIGINT AS candidates
FROM elements e LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (element_id)
UNION ALL SELECT 'short', count(*), count(*) FILTER (r.n IS NULL), sum(coalesce(r.n, 0))::BIGINT
FROM elements e LEFT JOIN (SELECT element_id, count(*) AS n FROM cand WHERE rule_pos < 4 GROUP BY 1) r USING (element_id)"""))
def rule_simulation(spark, sf):
    s = C.simulate(V.elements(spark, sf), {"all": RULES, "short": RULES[:4]})
    return s.groupBy("profile_id").agg(F.count("*").alias("total"), F.count_if(F.col("rule_name").isNull()).alias("unclassified"),
                                       F.sum("n_candidates").alias("candidates"))


def rule_rows(spark, sf):
    """A rule table from parts: profile by brand, with duplicate names, empty targets and repeated conditions."""
    k = F.col("p_partkey")
    w = F.split("p_name", " ")
    none = F.lit(None).cast("array<string>")
    return load(spark, sf, "part").select(
        F.col("p_brand").alias("profile"), k.cast("int").alias("rule_pos"), F.col("p_name").alias("name"),
        F.when(k % 17 == 0, " ").otherwise(F.col("p_type")).alias("target"), (k % 3).cast("int").alias("priority"),
        F.when(k % 19 == 0, none).otherwise(F.array(F.get(w, F.lit(0)), F.get(w, F.lit(1)))).alias("layers"), none.alias("entity_types"),
        F.when(k % 19 != 0, F.array("p_type")).alias("geometry_types"), none.alias("blocks"), F.lit(None).cast("string").alias("text_pattern"),
        F.when(k % 23 == 0, F.lit(5.0)).alias("min_area"), F.when(k % 23 == 0, F.lit(4.0)).alias("max_area"),
        F.lit(1.0).alias("min_length"), F.when(k % 29 == 0, F.lit(0.5)).alias("max_length"), none.alias("colors"), none.alias("linetypes"), none.alias("xdata"))


V.CTE["rule_rows"] = """SELECT p_brand AS profile, p_partkey AS pos, p_name AS name, p_partkey % 3 AS priority,
 CASE WHEN p_partkey % 19 = 0 THEN '-' ELSE p_name || '/' || p_type END || '/' || CASE WHEN p_partkey % 23 = 0 THEN 'r' ELSE '' END AS cond FROM part"""


@query("rule_lint", with_sql("rule_rows", body="""
SELECT profile, name AS rule_name, 'Error' AS severity, 'DuplicateName' AS code, NULL AS other FROM (SELECT *, row_number() OVER (PARTITION BY profile, name ORDER BY pos) AS rn FROM rule_rows) WHERE rn > 1
UNION ALL SELECT profile, name, 'Error', 'MissingTarget', NULL FROM rule_rows WHERE pos % 17 = 0
UNION ALL SELECT profile, name, 'Warning', 'NoCondition', NULL FROM rule_rows WHERE pos % 19 = 0
UNION ALL SELECT profile, name, 'Error', 'EmptyAreaRange', NULL FROM rule_rows WHERE pos % 23 = 0
UNION ALL SELECT profile, name, 'Error', 'EmptyLengthRange', NULL FROM rule_rows WHERE pos % 29 = 0
UNION ALL SELECT a.profile, CASE WHEN a.priority = b.priority OR a.priority < b.priority THEN a.name ELSE b.name END, CASE WHEN a.priority = b.priority THEN 'Warning' ELSE 'Info' END,
 CASE WHEN a.priority = b.priority THEN 'Conflict' ELSE 'Shadowed' END, CASE WHEN a.priority = b.priority OR a.priority < b.priority THEN b.name ELSE a.name END
 FROM rule_rows a JOIN rule_rows b ON a.profile = b.profile AND a.cond = b.cond AND a.pos < b.pos"""))
def rule_lint(spark, sf):
    return C.lint_rules(rule_rows(spark, sf), keys=["profile"])


@query("drafted_rules", with_sql("elements", body="""
SELECT 'selection ' || geometry_kind AS source, min_by(layer, pos) AS target, string_agg(DISTINCT lower(layer), ',' ORDER BY lower(layer)) AS layers, 50 AS priority FROM elements GROUP BY geometry_kind
UNION ALL SELECT 'layer', CASE WHEN layer LIKE '%RING' THEN 'Tree' WHEN layer LIKE '%BOLT' THEN 'Road' ELSE 'Building' END,
 CASE WHEN layer LIKE '%RING' THEN 'TREERING' WHEN layer LIKE '%BOLT' THEN 'C-ROADBOLT' ELSE 'BLDG-ROD' END, CASE WHEN layer LIKE '%RING' THEN 10 WHEN layer LIKE '%BOLT' THEN 20 ELSE 30 END
 FROM (SELECT DISTINCT layer FROM elements WHERE layer IN ('RING','BOLT','ROD'))"""))
def drafted_rules(spark, sf):
    e = V.elements(spark, sf)
    sel = e.select("geometry_kind", F.col("layer").alias("feature_class"), "layer", F.col("native_type").alias("entity_type"), "pos")
    a = C.draft_rule_from_selection(sel, ["geometry_kind"]).select(
        F.concat(F.lit("selection "), "geometry_kind").alias("source"), "target", F.array_join("layers", ",").alias("layers"), "priority")
    names = e.select("layer").distinct().select(F.concat(
        F.when(F.col("layer") == "RING", "Tree").when(F.col("layer") == "BOLT", "c-Road").when(F.col("layer") == "ROD", "bldg-").otherwise("X"),
        F.col("layer"), F.lit(" (12)")).alias("layer"))
    b = C.draft_rules_from_layers(names).select(F.lit("layer").alias("source"), "target", F.upper("layer").alias("layers"), "priority")
    return a.unionByName(b)
