"""Classification of names by shared vocabulary, keyword rules and declared categories."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Token separators and abbreviation expansions.
SEPARATORS = " -_.:/\\|()[]+,#*\t"
ABBREVIATIONS = {
    "bldg": "building", "bld": "building", "rd": "road", "hwy": "highway", "ctr": "centre", "cl": "centreline",
    "bdy": "boundary", "bnd": "boundary", "parc": "parcel", "wtr": "water", "swr": "sewer", "storm": "stormwater",
    "elec": "electrical", "telco": "telecommunication", "comm": "telecommunication", "veg": "vegetation",
    "topo": "topography", "cont": "contour", "ctour": "contour", "pvmt": "pavement", "kerb": "curb", "fnc": "fence",
    "utl": "utility", "mh": "manhole", "pt": "point", "txt": "text", "anno": "annotation",
}
_CLASS = "[" + re.escape(SEPARATORS) + "]"


@dataclass
class LexicalOptions:
    keyword_rules: dict[str, str] = field(default_factory=dict)
    category_rules: dict[str, str] = field(default_factory=dict)
    abbreviations: dict[str, str] = field(default_factory=dict)
    keyword_confidence: float = 0.80
    category_confidence: float = 0.95
    similarity_ceiling: float = 0.70
    minimum_score: float = 0.25
    unknown: str = "Unclassified"


def _expansions(opts: LexicalOptions) -> dict[str, str]:
    return {**ABBREVIATIONS, **{k.lower(): v.lower() for k, v in opts.abbreviations.items()}}


def tokens(c, opts: LexicalOptions) -> Column:
    """Distinct lower-case tokens of a name, each followed by its expansion."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.filter(F.transform(F.split(F.lower(c), _CLASS), lambda t: F.trim(t)), lambda t: F.length(t) > 0)
    table = F.create_map(*[F.lit(x) for kv in _expansions(opts).items() for x in kv])
    return F.array_distinct(F.array_compact(F.concat(raw, F.transform(raw, lambda t: F.try_element_at(table, t)))))


def label_tokens(label: str, opts: LexicalOptions) -> list[str]:
    exp = _expansions(opts)
    out: dict[str, None] = {}
    for t in re.split(_CLASS, label.lower()):
        if t.strip():
            out[t.strip()] = None
            if t.strip() in exp:
                out[exp[t.strip()]] = None
    return list(out)


def _forms(token: str) -> set[str]:
    """Every subject token that denotes ``token``: itself and the regular plural either way."""
    out = {token, token + "s", token + "es"}
    out |= {token[: -len(s)] for s in ("s", "es") if token.endswith(s) and len(token) > len(s)}
    return out


def label_table(spark, labels: list[str], opts: LexicalOptions) -> DataFrame:
    """``form, label, part, n_parts``: part -1 stands for the whole label run together."""
    rows = set()
    for label in labels:
        toks = label_tokens(label, opts)
        if not toks:
            continue
        whole = re.sub(_CLASS, "", label.lower())
        rows |= {(f, label, -1, len(toks)) for f in _forms(whole)}
        rows |= {(f, label, i, len(toks)) for i, t in enumerate(toks) for f in _forms(t)}
    return spark.createDataFrame(sorted(rows), "form string, label string, part int, n_parts int")


def _declared(meta: str) -> Column:
    """Declared category of a subject: the built-in name first, then the display name."""
    value = lambda key: F.get(F.filter(F.map_entries(meta), lambda e: (F.lower(e["key"]) == key) & (F.length(F.trim(e["value"])) > 0)), F.lit(0))["value"]
    return F.trim(F.coalesce(value("builtincategory"), value("category")))


def _literal_map(pairs: dict[str, str]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k.lower(), v)])


RESULT = ("subject_id", "label", "confidence", "source", "alternatives")


def classify_category(subjects: DataFrame, labels: list[str], opts: LexicalOptions) -> DataFrame:
    """Subjects that declare a category: mapped, named exactly by a label, or unknown; never guessed."""
    by_name = {}
    for label in labels:
        by_name.setdefault(label.lower(), label)
    known = _literal_map(by_name)
    d = subjects.withColumn("category", _declared("metadata")).where(F.col("category").isNotNull())
    d = d.withColumn("_mapped", F.try_element_at(_literal_map(opts.category_rules), F.lower("category")))
    target = F.try_element_at(known, F.lower(F.coalesce("_mapped", "category")))
    return d.select(
        "subject_id", F.coalesce(target, F.lit(opts.unknown)).alias("label"),
        F.when(target.isNotNull(), opts.category_confidence).otherwise(0.0).alias("confidence"), F.lit("category").alias("source"),
        F.array().cast("array<struct<label:string,confidence:double>>").alias("alternatives"), "category",
        (F.col("_mapped").isNull() & target.isNull()).alias("unmapped"))


def unmapped_categories(categorised: DataFrame) -> DataFrame:
    return categorised.where("unmapped").groupBy(F.lower("category").alias("_k")).agg(
        F.min("category").alias("category"), F.count("*").alias("n")).drop("_k")


def score_names(names: DataFrame, labels: list[str], opts: LexicalOptions) -> DataFrame:
    """Best label and up to three alternatives of each distinct ``name`` by shared vocabulary."""
    spark = names.sparkSession
    t = names.select("name", F.explode(tokens("name", opts)).alias("form"))
    hits = t.join(label_table(spark, labels, opts), "form").groupBy("name", "label", "n_parts").agg(
        F.bool_or(F.col("part") == -1).alias("whole"), F.count_distinct(F.when(F.col("part") >= 0, F.col("part"))).alias("m"))
    raw = F.when(F.col("whole"), 1.0).otherwise(F.col("m") / F.col("n_parts"))
    hits = hits.withColumn("confidence", raw * opts.similarity_ceiling).where(F.col("confidence") > 0)
    rank = F.row_number().over(W.partitionBy("name").orderBy(F.col("confidence").desc(), "label"))
    top = hits.withColumn("_rn", rank).where(F.col("_rn") <= 4)
    return top.groupBy("name").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_rn", "label", "confidence"))),
        lambda e: F.struct(e["label"].alias("label"), e["confidence"].alias("confidence"))).alias("scored"))


def classify_names(subjects: DataFrame, labels: list[str], opts: LexicalOptions) -> DataFrame:
    """Keyword rules first, then vocabulary scores.  Each distinct name is scored once."""
    by_name = {}
    for label in labels:
        by_name.setdefault(label.lower(), label)
    names = subjects.select("name").distinct()
    names = names.withColumn("_t", tokens("name", opts))
    rules = [(k.lower(), by_name[v.lower()]) for k, v in opts.keyword_rules.items() if v.lower() in by_name]
    keyword = F.lit(None).cast("string")
    for k, label in reversed(rules):
        keyword = F.when(F.array_contains("_t", k), F.lit(label)).otherwise(keyword)
    scored = score_names(names, labels, opts)
    d = names.withColumn("_kw", keyword).drop("_t").join(scored, "name", "left")
    best = F.get("scored", F.lit(0))
    good = F.coalesce(best["confidence"] >= opts.minimum_score, F.lit(False))
    none = F.array().cast("array<struct<label:string,confidence:double>>")
    d = d.select(
        "name", F.coalesce("_kw", F.when(good, best["label"]), F.lit(opts.unknown)).alias("label"),
        F.when(F.col("_kw").isNotNull(), opts.keyword_confidence).when(good, best["confidence"]).otherwise(0.0).alias("confidence"),
        F.when(F.col("_kw").isNotNull(), "keyword").when(good, "similarity").otherwise("none").alias("source"),
        F.when(F.col("_kw").isNull() & good, F.slice("scored", 2, 3)).otherwise(none).alias("alternatives"))
    return subjects.select("subject_id", "name").join(d, "name").select(*RESULT)


def classify_lexical(subjects: DataFrame, labels: list[str], opts: LexicalOptions | None = None) -> DataFrame:
    """``subject_id, label, confidence, source, alternatives`` for every subject."""
    opts = opts or LexicalOptions()
    declared = classify_category(subjects, labels, opts)
    rest = subjects.where(_declared("metadata").isNull())
    return declared.select(*RESULT).unionByName(classify_names(rest, labels, opts))
