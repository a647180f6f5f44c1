"""Queries over subject texts, hashed features, scores, prompts, answers and fallback."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import scoring as S
from . import derive as V
from .classification import block_elements
from .derive import with_sql
from .registry import load, query

ks = lambda c: c.cast("string")


def subjects(spark, sf):
    """A subject per part: name, counts, texts and blocks from its columns."""
    k = F.col("p_partkey")
    texts = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), (k % 9 + 1).cast("int")), lambda i: F.concat(F.lit(" t\n"), ks(i), F.lit(" "), F.repeat("p_name", 4))))
    return load(spark, sf, "part").select(
        ks(k).alias("subject_id"), k.alias("pos"), F.upper(F.col("p_name")).alias("name"), F.lit("Line").alias("dominant_geometry"), (F.col("p_size") + 3).alias("entity_count"),
        F.when(k % 2 == 0, F.create_map(F.lit("Polygon"), F.lit(3), F.lit("Line"), F.col("p_size"))).otherwise(F.create_map(F.lit("Line"), F.col("p_size"))).alias("geometry_profile"),
        F.when(k % 3 == 0, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("block_names"), texts.alias("sample_texts"),
        F.create_map(F.lit("zone"), F.col("p_type"), F.lit("Brand"), F.col("p_brand")).alias("metadata"))


V.CTE["described"] = """SELECT p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS subject_id, 'name=' || upper(p_name) || '; geometry=Line; entities=' || (p_size + 3)
 || CASE WHEN p_partkey % 2 = 0 THEN '; mix=Line:' || p_size || ',Polygon:3' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '; blocks=[' || p_type || '|' || p_brand || ']' ELSE '' END
 || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '; text=[' || array_to_string(list_transform(range(1, least(5, p_partkey % 9 + 1) + 1), lambda i: left('t ' || i || ' ' || repeat(p_name, 4), 40)), '|')
   || CASE WHEN p_partkey % 9 + 1 > 5 THEN '|+' || (p_partkey % 9 + 1 - 5) ELSE '' END || ']' END || '; Brand=' || p_brand || '; zone=' || p_type AS descriptor FROM part"""


@query("subject_descriptors", with_sql("described", body="SELECT subject_id, descriptor FROM described"))
def subject_descriptors(spark, sf):
    return S.describe_subjects(subjects(spark, sf)).select("subject_id", "descriptor")


@query("hashed_features")
def hashed_features(spark, sf):
    """Per subject: filled buckets and the squared length of the vector, over all descriptors."""
    h = S.hash_features(S.describe_subjects(subjects(spark, sf)))
    return h.groupBy("subject_id").agg(F.count("*").alias("buckets"), F.round(F.sum(F.col("value").cast("double") * F.col("value")), 4).alias("length2"))


MODEL_LABELS = [f"class_{i}" for i in range(10)]
WANTED = ["CLASS_1", "class_3", "Class_4", "class_7", "class_9", "other"]


@query("model_scores", """
WITH z AS (SELECT vec_id, i, 'class_' || i AS label, embedding[i + 1]::DOUBLE AS z FROM embeddings, (SELECT unnest(range(64)) AS i)),
s AS (SELECT vec_id, label, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x FROM z), c AS (SELECT vec_id, label, x/sum(x) OVER (PARTITION BY vec_id) AS c FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS rn FROM c)
SELECT vec_id AS subject_id, max(label) FILTER (rn = 1) AS label, round(max(c) FILTER (rn = 1), 9) AS confidence, string_agg(label, ',' ORDER BY rn) FILTER (rn BETWEEN 2 AND 4) AS alternatives FROM r GROUP BY 1""")
def model_scores(spark, sf):
    d = load(spark, sf, "embeddings").select(F.col("vec_id").alias("subject_id"), F.col("embedding").alias("logits"))
    labels = [f"class_{i}" for i in range(64)]
    s = S.softmax_scores(d, labels, [*(n.upper() for n in labels), "other"])
    return s.select("subject_id", "label", F.round("confidence", 9).alias("confidence"), F.array_join(F.transform("alternatives", lambda a: a["label"]), ",").alias("alternatives"))


def _weights():
    w = (np.arange(512 * 10).reshape(512, 10) * 37 % 101 - 50) / 25.0
    return S.linear_model(w, np.zeros(10))


@query("model_classification")
def model_classification(spark, sf):
    """Descriptors through a fixed weight matrix: hashing, scoring and softmax end to end."""
    z = S.model_logits(S.describe_subjects(subjects(spark, sf)), _weights)
    return S.softmax_scores(z, MODEL_LABELS, WANTED).select("subject_id", "label", F.round("confidence", 6).alias("confidence"))


@query("request_cache_keys", with_sql("described", body="""
SELECT (pos // 7) AS chunk, 'rulebased:' || sha256('rulebased' || chr(31) || 'civil' || chr(31) || 'metre' || chr(31) || 'Unclassified' || chr(31) || 'Road' || chr(31) || 'Tree' || chr(31)
 || string_agg(subject_id || '=' || descriptor || chr(31), '' ORDER BY pos)) AS key FROM described GROUP BY 1"""))
def request_cache_keys(spark, sf):
    p = S.prompt_batches(S.describe_subjects(subjects(spark, sf)), ["Road", "Tree"], 7, "civil", "metre")
    return p.select("chunk", S.cache_key("rulebased", "civil", "metre", "Unclassified", ["Road", "Tree"], F.col("entries")).alias("key"))


@query("prompt_batches", with_sql("described", body="""
SELECT pos // 25 AS chunk, 'PROJECT DOMAIN: civil' || chr(10) || 'ALLOWED LABELS:' || chr(10) || '- Road' || chr(10) || '- Tree' || chr(10) || chr(10) || 'LAYERS TO CLASSIFY:' || chr(10)
 || string_agg('- id=' || subject_id || ' | ' || descriptor, chr(10) ORDER BY pos) AS "user" FROM described GROUP BY 1"""))
def prompt_batches(spark, sf):
    return S.prompt_batches(S.describe_subjects(subjects(spark, sf)), ["Road", "Tree"], 25, "civil").select("chunk", "user")


def answer_texts(spark, sf):
    """A model text per conversation turn: prose around one JSON object, now and then broken or with strangers."""
    c = load(spark, sf, "conversations")
    k = F.col("conv_id") * 10 + F.col("turn")
    conf = F.when(k % 4 == 0, "85").when(k % 4 == 1, '"0.5"').when(k % 4 == 2, "0.25").otherwise("500")
    label = F.when(k % 5 == 0, "Invented").when(k % 5 == 1, " road ").otherwise(F.col("role"))
    j = F.concat(F.lit('{"results":[{"id":"C'), ks(F.col("conv_id")), F.lit('","label":"'), label, F.lit('","confidence":'), conf,
                 F.lit(',"alternatives":[{"label":"tree","confidence":"10"},{"label":"nothing","confidence":1}]},{"id":"stranger","label":"road"}]}'))
    return c.select(k.alias("pos"), F.when(k % 11 == 0, F.concat(F.lit("{ no"), "text")).otherwise(F.concat(F.lit("Sure, here: "), j, F.lit(" as asked."))).alias("content"))


@query("parsed_answers", """
SELECT 'C' || conv_id AS subject_id, CASE k % 5 WHEN 0 THEN 'Unclassified' WHEN 1 THEN 'road' ELSE CASE WHEN role IN ('user','assistant') THEN role ELSE 'Unclassified' END END AS label,
 CASE k % 4 WHEN 0 THEN 0.85::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS confidence, 1 AS n_alternatives, 0.1::DOUBLE AS alternative FROM (SELECT *, conv_id*10 + turn AS k FROM conversations) WHERE k % 11 <> 0""")
def parsed_answers(spark, sf):
    s = load(spark, sf, "conversations").select(F.concat(F.lit("c"), ks(F.col("conv_id"))).alias("subject_id"))
    p = S.parse_answers(answer_texts(spark, sf), s, ["Road", "User", "assistant", "Tree"])
    return p.select("subject_id", "label", "confidence", F.size("alternatives").alias("n_alternatives"), F.get("alternatives", F.lit(0))["confidence"].alias("alternative"))


@query("provider_fallback", """
SELECT CAST(p_partkey AS VARCHAR) AS subject_id, CASE WHEN p_partkey // 50 % 4 = 1 THEN 'rulebased' ELSE 'chat' END AS provider, CASE WHEN p_partkey // 50 % 4 = 1 THEN lower(p_type) ELSE p_type END AS label FROM part""")
def provider_fallback(spark, sf):
    k = F.col("p_partkey")
    p = load(spark, sf, "part").select(ks(k).alias("subject_id"), F.floor(k / 50).alias("batch_id"), F.col("p_type").alias("label"))
    b = p.select("batch_id").distinct().withColumn("ok", F.col("batch_id") % 4 != 1)
    return S.with_fallback(p, p.withColumn("label", F.lower("label")), b, "chat", "rulebased").select("subject_id", "provider", "label")


@query("response_cache", """
WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT key, seq, rn, false AS hit, ts + INTERVAL 240 MINUTE AS until FROM e WHERE rn = 1
 UNION ALL SELECT e.key, e.seq, e.rn, e.ts < f.until, CASE WHEN e.ts < f.until THEN f.until ELSE e.ts + INTERVAL 240 MINUTE END FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT key, seq, hit FROM f""")
def response_cache(spark, sf):
    r = load(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return S.cached_requests(r).select("key", "seq", "hit")
