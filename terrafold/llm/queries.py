"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.common import checkpoint_dir

from . import caps, chat, classifier, mixing, negatives, packing, periods, phrases, quality, simhash, suffix, tokens, wrappers
from .oracles import ORACLES  # noqa: F401
from .shared import keep, load

QUERIES = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = keep(packing.token_pieces(load(spark, sf, "documents"), tokenizer_path(), end_id=1, capacity=4096))
    return packing.pack(pieces, 4096)


@query
def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    tokens.write_token_files(load(spark, sf, "documents"), path, tokenizer_path(), end_id=2)
    return tokens.read_token_files(spark, path)


@query
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    scored = quality.score_quality(load(spark, sf, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.simhash_components(load(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


@query
def op5_chat(spark: SparkSession, sf: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.chat_digests(load(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(probe))


@query
def op6_suffix(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix.remove_repeats(load(spark, sf, "documents"), 100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op7_phrases(spark: SparkSession, sf: str) -> DataFrame:
    found = phrases.remove_passages(load(spark, sf, "documents"), 50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_sizes(load(spark, sf, "documents"))


@query
def op9_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return classifier.score_documents(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op10_caps(spark: SparkSession, sf: str) -> DataFrame:
    return caps.vector_components(load(spark, sf, "embeddings"), 0.93)


@query
def op11_periods(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents")
    return periods.run_digests(docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text")))


@query
def op12_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract_text(load(spark, sf, "pages"))


@query
def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(negatives.quantised(rows, 256, label), every=50, positives=5, negatives=3, low=50, high=95)
