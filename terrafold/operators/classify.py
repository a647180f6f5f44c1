"""Rule classification of elements and semantic features, decisions, statistics, lint and drafts.

Rules are configuration: each becomes one column predicate, so that a scan of the elements tests every
rule without a join, and ranking the few matches of a row needs no shuffle either.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import GROWS

UNCLASSIFIED = "Unclassified"


@dataclass(frozen=True)
class MappingRule:
    name: str
    target: str
    priority: int = 0
    layers: tuple[str, ...] = ()
    entity_types: tuple[str, ...] = ()
    geometry_types: tuple[str, ...] = ()
    blocks: tuple[str, ...] = ()
    colors: tuple[str, ...] = ()
    linetypes: tuple[str, ...] = ()
    xdata: tuple[str, ...] = ()
    text_pattern: str | None = None
    min_area: float | None = None
    max_area: float | None = None
    min_length: float | None = None
    max_length: float | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    conditions: dict[str, str] = field(default_factory=dict)
    profile: str = ""

    def n_conditions(self) -> int:
        groups = (self.layers, self.entity_types, self.geometry_types, self.blocks, self.colors, self.linetypes, self.xdata,
                  (self.text_pattern or "").strip())
        ranges = ((self.min_area, self.max_area), (self.min_length, self.max_length))
        return sum(bool(g) for g in groups) + sum(any(v is not None for v in r) for r in ranges) + len(self.attributes) + len(self.conditions)


CONFIDENCE = {False: (0.85, 0.90, 0.98), True: (0.88, 0.93, 0.99)}  # fixed values: one, two, three or more conditions


def _raw(name: str) -> Column:
    return F.try_element_at("_raw", F.lit(name.lower()))


def _in(c: Column, values) -> Column:
    return F.coalesce(F.lower(c).isin(*[v.lower() for v in values]), F.lit(False))


def _range(c: Column, lo, hi) -> Column:
    ok = c.isNotNull()
    ok = ok & (c >= lo) if lo is not None else ok
    return ok & (c <= hi) if hi is not None else ok


def rule_predicate(r: MappingRule, semantic: bool = False) -> Column | None:
    """Conjunction of every condition group the rule states; ``None`` when it states none."""
    if r.n_conditions() == 0:
        return None
    either = lambda name, raw, vals: (_in(F.col(name), vals) | _in(_raw(raw), vals)) if semantic else _in(_raw(raw), vals)
    out = []
    if r.layers:
        out.append(either("s_layer", "layer", r.layers))
    if r.entity_types:
        t = _in(F.col("native_type"), r.entity_types)
        out.append(_in(F.col("category"), r.entity_types) | _in(F.col("family"), r.entity_types) | t if semantic else t)
    if r.geometry_types:
        out.append(_in(F.col("geometry_kind"), r.geometry_types))
    if r.blocks:
        out.append(either("s_block", "blockname", r.blocks))
    if r.colors:
        out.append(either("s_color", "color", r.colors))
    if r.linetypes:
        out.append(either("s_linetype", "linetype", r.linetypes))
    if r.xdata:
        x = F.lower(_raw("xdata"))
        out.append(reduce(lambda a, b: a | b, [F.coalesce(x.contains(v.lower()), F.lit(False)) for v in r.xdata]))
    if (r.text_pattern or "").strip():
        out.append(F.coalesce((F.length(F.trim("text")) > 0) & F.col("text").rlike("(?i)" + r.text_pattern), F.lit(False)))
    for lo, hi, name in ((r.min_area, r.max_area, "area"), (r.min_length, r.max_length, "length")):
        if lo is not None or hi is not None:
            # A semantic measure of zero counts as missing.
            v = F.nullif(F.coalesce("s_" + name, name), F.lit(0.0)) if semantic else F.col(name)
            out.append(_range(v, lo, hi))
    out += [F.coalesce(_raw(k) == v, F.lit(False)) for k, v in r.attributes.items()]
    out += [F.coalesce(F.lower(_raw(k)) == v.lower(), F.lit(False)) for k, v in r.conditions.items()]
    return reduce(lambda a, b: a & b, out)


CANDIDATE = "array<struct<priority:int,confidence:double,rule_pos:int,rule_name:string,label:string>>"


def _lower_keys(m) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def with_candidates(elements: DataFrame, rules: list[MappingRule], semantic: bool = False) -> DataFrame:
    """Add ``candidates``: matches by priority, then confidence, both descending, then rule order."""
    hits = []
    for i, r in enumerate(rules):
        p = rule_predicate(r, semantic)
        if p is not None:
            score = CONFIDENCE[semantic][min(r.n_conditions(), 3) - 1]
            hits.append(F.when(p, F.struct(
                F.lit(r.priority).alias("priority"), F.lit(score).alias("confidence"), F.lit(i).alias("rule_pos"),
                F.lit(r.name).alias("rule_name"), F.lit(r.target).alias("label"))))
    d = elements.withColumn("_raw", _lower_keys("attrs"))
    found = F.array_compact(F.array(*hits)) if hits else F.array()

    def order(a, b):
        cmp = lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0)
        p, c = cmp(a["priority"], b["priority"]), cmp(a["confidence"], b["confidence"])
        return F.when(p != 0, p).when(c != 0, c).otherwise(cmp(b["rule_pos"], a["rule_pos"]))

    return d.withColumn("_found", found.cast(CANDIDATE)).withColumn("candidates", F.array_sort("_found", order)).drop("_raw", "_found")


def classify_rules(elements: DataFrame, rules: list[MappingRule], semantic: bool = False) -> DataFrame:
    """Long candidate table ``element_id, rank, label, confidence, rule_name, priority``."""
    d = with_candidates(elements, rules, semantic)
    d = d.select("element_id", F.posexplode("candidates").alias("rank", "c"))
    return d.select("element_id", (F.col("rank") + 1).alias("rank"), "c.label", "c.confidence", "c.rule_name", "c.priority", "c.rule_pos")


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Rank an already long candidate table: priority, then confidence, then rule order."""
    w = W.partitionBy("element_id").orderBy(F.col("priority").desc(), F.col("confidence").desc(), "rule_pos")
    return candidates.withColumns({"rank": F.row_number().over(w), "runner_up": F.lead("confidence").over(w)})


def decide(elements: DataFrame, rules: list[MappingRule], second: DataFrame | None = None, margin: float = 0.05,
           semantic: bool = False) -> DataFrame:
    """One result per element: the top rule unless none matched or the runner-up is within ``margin``.

    The margin is signed and follows priority order.  Undecided elements take the ``second`` stage's
    answer (``element_id, label, confidence, provider, accepted``), else ``Unclassified``.
    """
    d = with_candidates(elements, rules, semantic)
    top, two = F.get("candidates", F.lit(0)), F.get("candidates", F.lit(1))
    d = d.withColumn("_ruled", (F.size("candidates") == 1) | ((F.size("candidates") > 1) & (top["confidence"] - two["confidence"] >= margin)))
    pick = d.select(
        "element_id", "_ruled", F.size("candidates").alias("n_candidates"),
        F.when(F.col("_ruled"), top["label"]).alias("label"), F.when(F.col("_ruled"), top["confidence"]).alias("confidence"),
        F.when(F.col("_ruled"), top["rule_name"]).alias("rule_name"))
    if second is None:
        s = pick.withColumns({"_l": F.lit(None).cast("string"), "_c": F.lit(None).cast("double"),
                              "_p": F.lit(None).cast("string"), "_a": F.lit(None).cast("boolean")})
    else:
        ans = second.select("element_id", F.col("label").alias("_l"), F.col("confidence").alias("_c"),
                            F.col("provider").alias("_p"), F.col("accepted").alias("_a"))
        s = pick.join(ans, "element_id", "left")
    return s.select(
        "element_id", "n_candidates", F.coalesce("label", "_l", F.lit(UNCLASSIFIED)).alias("label"),
        F.coalesce("confidence", "_c", F.lit(0.0)).alias("confidence"),
        F.when(F.col("_ruled"), "RuleEngine").otherwise(F.coalesce("_p", F.lit("Fallback"))).alias("provider"), "rule_name",
        F.when(F.col("_ruled"), F.lit(True)).otherwise(F.coalesce("_a", F.lit(False))).alias("accepted"))


def confidence(c) -> Column:
    """Clamp to [0, 1]; not a number reads as 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def confidence_level(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 0.95, "Automatic").when(c >= 0.80, "Review").when(c >= 0.60, "NeedsAttention").otherwise("Unclassified")


def with_acceptance(df: DataFrame, threshold: float = 0.65) -> DataFrame:
    return df.withColumns({"accepted": F.col("confidence") >= threshold, "level": confidence_level("confidence")})


def reconcile(subjects: DataFrame, answers: DataFrame, threshold: float = 0.65, unknown: str = UNCLASSIFIED) -> DataFrame:
    """Every subject with its last answer, ids compared ignoring case; no answer is unknown and refused."""
    last = answers.groupBy(F.lower("subject_id").alias("_k")).agg(F.max_by(F.struct("label", "confidence"), "pos").alias("_a"))
    j = subjects.withColumn("_k", F.lower("subject_id")).join(last, "_k", "left").drop("_k")
    c = F.coalesce(confidence(F.col("_a.confidence")), F.lit(0.0))
    got = F.col("_a").isNotNull()
    return j.withColumns({
        "label": F.coalesce("_a.label", F.lit(unknown)), "confidence": c, "answered": got, "accepted": got & (c >= threshold)}).drop("_a")


# --- subjects and groups -------------------------------------------------------------------------------------

def layer_subjects(elements: DataFrame, layers: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """One subject per visible, non-empty layer with geometry counts and first distinct texts and blocks."""
    if layers is not None:
        elements = elements.join(layers.where("is_visible").select("doc_id", "layer"), ["doc_id", "layer"], "left_semi")
    keys = ["doc_id", "layer"]
    kinds = elements.groupBy(*keys, "geometry_kind").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    base = kinds.groupBy(*keys).agg(
        F.sum("n").alias("entity_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("geometry_kind", "n")))).alias("geometry_profile"),
        F.max_by("geometry_kind", F.struct("n", -F.col("first"))).alias("dominant_geometry"))

    def first_distinct(df, value, name):
        d = df.where(F.length(F.trim(value)) > 0).groupBy(*keys, F.lower(F.trim(value)).alias("_l")).agg(
            F.min(F.struct("pos", F.trim(value).alias("v"))).alias("f"))
        w = W.partitionBy(*keys).orderBy("f.pos", "f.v")
        d = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
        return d.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["v"]).alias(name))

    block = F.try_element_at(_lower_keys("attrs"), F.lit("blockname"))
    texts = first_distinct(elements, F.col("text"), "sample_texts")
    blocks = first_distinct(elements.where(F.lower("native_type").contains("block")), block, "block_names")
    empty = F.array().cast("array<string>")
    return base.join(texts, keys, "left").join(blocks, keys, "left").withColumns({
        "sample_texts": F.coalesce("sample_texts", empty), "block_names": F.coalesce("block_names", empty)})


def dominant_geometry(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent known kind per key; first seen wins a tie and nothing known is ``Point``."""
    k = elements.groupBy(*keys, "geometry_kind").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    known = F.when(F.col("geometry_kind") != "Unknown", F.struct("n", -F.col("first")))
    return k.groupBy(*keys).agg(F.coalesce(F.max_by("geometry_kind", known), F.lit("Point")).alias("geometry"))


def group_virtual_layers(elements: DataFrame, classifications: DataFrame) -> DataFrame:
    """Add ``feature_class``: the assigned label, else the element's own layer; labels compare by case."""
    c = classifications.select("element_id", F.col("label").alias("_l"))
    return elements.join(c, "element_id", "left").withColumn("feature_class", F.coalesce("_l", "layer")).drop("_l")


def entity_type_counts(elements: DataFrame, keys: list[str] = ()) -> DataFrame:
    kind = F.coalesce("native_type", "geometry_kind")
    return elements.groupBy(*keys, F.lower(kind).alias("_k")).agg(
        F.min(kind).alias("entity_type"), F.count("*").alias("n")).drop("_k").orderBy(*keys, F.col("n").desc(), "entity_type")


def classification_stats(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Total, unmatched and mean confidence of matched rows; ``rule_name`` is null where nothing matched."""
    hit = F.col("rule_name").isNotNull()
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(~hit).alias("unclassified"),
        F.coalesce(F.avg(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("mean_confidence"))


def usage_counts(results: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Counts per class and per rule in one pass, as ``kind, value, n``."""
    hit = results.where(F.col("rule_name").isNotNull())
    e = F.explode(F.array(F.struct(F.lit("class").alias("kind"), F.coalesce("label", F.lit("Unknown")).alias("value")),
                          F.struct(F.lit("rule").alias("kind"), F.col("rule_name").alias("value"))))
    return hit.select(*keys, e.alias("e")).groupBy(*keys, "e.kind", "e.value").agg(F.count("*").alias("n"))


def simulate(elements: DataFrame, profiles: dict[str, list[MappingRule]]) -> DataFrame:
    """Winner, runner-up count and rejected rules of every element under every profile variant."""
    out = None
    for pid, rules in profiles.items():
        d = with_candidates(elements, rules).select(
            F.lit(pid).alias("profile_id"), "element_id", F.get("candidates", F.lit(0)).alias("w"), F.size("candidates").alias("n_candidates"))
        d = d.select("profile_id", "element_id", F.col("w.label").alias("label"), F.col("w.rule_name").alias("rule_name"),
                     F.col("w.confidence").alias("confidence"), "n_candidates", (F.lit(len(rules)) - F.col("n_candidates")).alias("n_rejected"))
        out = d if out is None else out.unionByName(d)
    return out


# --- rule tables -------------------------------------------------------------------------------------------------

RULE_TABLE = ("rule_pos int, name string, target string, priority int, layers array<string>, entity_types array<string>, "
              "geometry_types array<string>, blocks array<string>, text_pattern string, min_area double, max_area double, "
              "min_length double, max_length double, colors array<string>, linetypes array<string>, xdata array<string>")


def lint_rules(rules: DataFrame, full: bool = False, keys: list[str] = (), block: int = 1000) -> DataFrame:
    """``rule_name, severity, code, other`` for duplicate names, missing targets, no condition, empty
    ranges, and pairs with identical conditions (a conflict, or one shadowed by a higher priority).

    ``full`` also counts colours, line types, extended data and lengths as conditions.
    """
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    arrays = ["layers", "entity_types", "geometry_types", "blocks"] + (["colors", "linetypes", "xdata"] if full else [])
    some = reduce(lambda a, b: a | b, [has(c) for c in arrays]) | F.col("text_pattern").isNotNull()
    if full:
        some = some | F.coalesce("min_area", "max_area", "min_length", "max_length").isNotNull()
    dup = F.row_number().over(W.partitionBy(*keys, "name").orderBy("rule_pos")) > 1
    e = lambda sev, code: F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"))
    d = rules.withColumn("_dup", dup)
    single = F.array_compact(F.array(
        F.when(F.col("_dup"), e("Error", "DuplicateName")),
        F.when(F.coalesce(F.length(F.trim("target")), F.lit(0)) == 0, e("Error", "MissingTarget")), F.when(~some, e("Warning", "NoCondition")),
        F.when(F.col("min_area") > F.col("max_area"), e("Error", "EmptyAreaRange")),
        F.when(F.col("min_length") > F.col("max_length"), e("Error", "EmptyLengthRange"))))
    one = d.select(*keys, F.col("name").alias("rule_name"), F.explode(single).alias("e"), F.lit(None).cast("string").alias("other"))
    one = one.select(*keys, "rule_name", "e.severity", "e.code", "other")
    # Equal conditions meet on one key: sorted distinct lists with their size, pattern and ranges.
    norm = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.size(c), F.array_sort(F.array_distinct(F.col(c)))))
    parts = [norm(c) for c in arrays] + [F.col("text_pattern"), F.col("min_area"), F.col("max_area")]
    if full:
        parts += [F.col("min_length"), F.col("max_length")]
    k = rules.select(*keys, "rule_pos", "name", "priority", F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])).alias("_k"))
    # A group of many rules of one condition is dealt to blocks; each pair of blocks is compared by itself.
    k = k.withColumn("_blocks", F.ceil(F.count("*").over(W.partitionBy(*keys, "_k")) / block).cast("int"))
    k = k.withColumn("_lb", F.pmod(F.xxhash64("rule_pos", "name"), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    o = k.select(*keys, "_k", F.col("rule_pos").alias("o_pos"), F.col("name").alias("o_name"), F.col("priority").alias("o_pri"), F.col("_lb").alias("_rb"), every.alias("_lb"))
    # Both sides are sent by block: the count left them gathered by condition, which would do for a join.
    at = [*keys, "_k", "_lb", "_rb"]
    j = k.withColumn("_rb", every).repartition(*at).hint(GROWS).join(o.repartition(*at), at).where(F.col("rule_pos") < F.col("o_pos"))
    equal = F.col("priority") == F.col("o_pri")
    lower = F.when(F.col("priority") < F.col("o_pri"), F.col("name")).otherwise(F.col("o_name"))
    higher = F.when(F.col("priority") > F.col("o_pri"), F.col("name")).otherwise(F.col("o_name"))
    two = j.select(*keys, F.when(equal, F.col("name")).otherwise(lower).alias("rule_name"), F.when(equal, "Warning").otherwise("Info").alias("severity"),
                   F.when(equal, "Conflict").otherwise("Shadowed").alias("code"), F.when(equal, F.col("o_name")).otherwise(higher).alias("other"))
    return one.unionByName(two)


def draft_rule_from_selection(features: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Draft from what a selection shares: distinct layers and entity types, class of its first row."""
    return features.groupBy(*keys).agg(
        F.min_by("feature_class", "pos").alias("target"), F.array_sort(F.collect_set(F.lower("layer"))).alias("layers"),
        F.array_sort(F.collect_set(F.lower("entity_type"))).alias("entity_types"), F.count("*").alias("n_selected")).withColumn("priority", F.lit(50))


LAYER_HINTS = (("TREE", "Tree", 10), ("ROAD", "Road", 20), ("BLDG", "Building", 30))  # fixed values, first hit wins


def draft_rules_from_layers(layers: DataFrame) -> DataFrame:
    """One drafted rule per layer whose first word holds a known hint."""
    word = F.get(F.split("layer", " "), F.lit(0))
    hit = F.coalesce(*[F.when(F.upper(word).contains(h), F.struct(F.lit(t).alias("target"), F.lit(p).alias("priority"))) for h, t, p in LAYER_HINTS])
    return layers.withColumn("_h", hit).where(F.col("_h").isNotNull()).select(word.alias("layer"), "_h.target", "_h.priority")
