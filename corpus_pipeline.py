"""A training corpus from raw documents: rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; ``run`` writes each stage's rows
to the shared folder and reads them again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrafold.llm import mixing, packing, phrases, quality, simhash
from terrafold.llm.queries import tokenizer_path
from terrafold.llm.shared import keep, load


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Links are fingerprints of three bits at most, found by vantage-point trees, and sets of five-word shingles of a similarity of
    0.8 or more, which move more bits than a tree can search.
    """
    return simhash.keep_one_of_each(docs, simhash.SIMILAR, trees=simhash.CLOSE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document holds go; documents that lose every word go."""
    return phrases.drop_passages(docs, 50)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document may come twice."""
    return mixing.mix_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens."""
    return packing.pack(keep(packing.token_pieces(docs, tokenizer_path(), end_id=1, capacity=4096)), 4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packed_sequences", packed_sequences),
]

#: Fingerprints, passages and token ids have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
