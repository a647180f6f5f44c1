"""What several operators of this package use: kept tables, row keys, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.operators.common import checkpoint_dir

#: One word is a run of anything but ASCII white space.
WHITE = "[\\x20\\x09-\\x0D]+"
#: Rows and bytes of one Arrow batch, so that very long texts never meet in one batch.
BATCH_ROWS, BATCH_BYTES = "1024", str(16 << 20)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again: later steps do not repeat it when executors go."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def row_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart; repeated rows share it and get one result each."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def in_batches(df: DataFrame) -> DataFrame:
    """``df`` for Python code in Arrow batches of bounded rows and bytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` of every node in ``edges (a, b)``: root is the smallest id that can be reached.

    Each round hooks a node to its smallest neighbour, follows hooks twice and contracts the edges; a table of
    hooks per round is kept and the rounds are composed at the end. The smallest id of a component never hooks away, so
    it is the root. Hot nodes only meet in ``min`` (combined before the shuffle) and in joins that Spark can split.
    """
    live = keep(edges.filter("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct())
    rounds = []
    while not live.isEmpty():
        both = live.union(live.selectExpr("b", "a"))
        hook = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")))
        for _ in range(2):
            up = hook.select(F.col("id").alias("root"), F.col("root").alias("top"))
            hook = hook.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        hook = keep(hook)
        rounds.append(hook)
        a, b = (hook.select(F.col("id").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        live = keep(live.join(a, "a").join(b, "b").filter("ra <> rb").selectExpr("least(ra, rb) a", "greatest(ra, rb) b").distinct())
    if not rounds:
        return edges.selectExpr("a id", "b root").limit(0)
    out = rounds[0]
    for later in rounds[1:]:
        up = later.select(F.col("id").alias("root"), F.col("root").alias("top"))
        out = out.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return out


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")
