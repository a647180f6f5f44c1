"""Operators that run batch by batch over a stream."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.operators import build as B
from terrafold.streaming import features as T
from terrafold.streaming.drain import drain, drain_batches


def test_tables_of_many_batches(spark, tmp_path):
    d = spark.range(40).withColumn("v", F.col("id") * 2)
    d.repartition(4).write.parquet(f"{tmp_path}/in")
    split = lambda b: {"even": b.where("id % 2 = 0"), "count": b.groupBy().agg(F.count("*").alias("n"))}
    made = drain_batches(T.landing(spark, f"{tmp_path}/in", d.schema, files_per_batch=1), split)
    assert sorted(r.id for r in made["even"].collect()) == list(range(0, 40, 2))
    assert made["count"].count() == 4 and made["count"].agg(F.sum("n")).first()[0] == 40


def test_tables_of_no_batch(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/none")
    made = drain_batches(T.landing(spark, f"{tmp_path}/none", spark.range(0).schema), lambda b: {"all": b})
    assert made["all"].count() == 0 and made["all"].columns == ["id"]


@pytest.mark.parametrize("block, limit", [(16, 12), (64, 5), (4096, 12)])
def test_failure_breaker_on_shuffled_files(spark, tmp_path, block, limit):
    """One shuffled file a batch: the same rows as the batch operator, whatever batch a run of failures falls into."""
    rng = random.Random(block)
    rows = [(f"l{k % 3}", p, rng.random() < 0.7 or 200 <= p < 215, 1_700_000_000 + p) for k in range(3) for p in range(k, 600, 1 + k)]
    rows += [("all", p, True, 1_700_000_000 + p) for p in range(0, 90, 4)] + [("none", p, False, 1_700_000_000 + p) for p in range(40)] + [("null", p, None, 1_700_000_000 + p) for p in range(20)]
    rng.shuffle(rows)
    schema = "layer string, pos long, failed boolean, s long"
    for i in range(6):
        d = spark.createDataFrame(rows[i::6], schema)
        d.withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = spark.read.parquet(f"{tmp_path}/in")
    stream = T.landing(spark, f"{tmp_path}/in", whole.schema, files_per_batch=1, glob="*.parquet")
    blocks = drain(T.stream_breaker(stream, limit, late="1 day", block=block), "update", ["layer", "blk"])
    got = T.rows_until_cut(whole, T.breaker_cuts(blocks, limit)).select("layer", "pos", "abandoned").collect()
    want = B.failure_breaker(whole.withColumn("failed", F.coalesce("failed", F.lit(False))), limit).select("layer", "pos", "abandoned").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(r["abandoned"] for r in got)
