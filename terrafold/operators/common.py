"""Shared helpers: lineage cuts and distributed row positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Hint on a join whose sides both grow with the data. Spark's size estimate counts an array as one element and no rows of an
#: explode, so at some size it would collect millions of rows on the driver as a "small" side.
GROWS = "merge"

#: Groups that the rows of one key are dealt to where few keys may hold all rows.
DEALT = 256


def checkpoint_dir(spark) -> str:
    """The cluster's shared checkpoint folder; one is set only where the session names none."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="terrafold-")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iterative step in the shared folder so that lost executors replay one step."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: like ``cut_lineage``, with its true size.

    A checkpoint keeps the size estimated for its plan. In a loop of joins that estimate squares itself each round, until small
    tables are no longer broadcast and, after some twenty rounds, the number itself overflows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_dealt(df: DataFrame, small: DataFrame, key: str, by: list[str], parts: int = DEALT) -> DataFrame:
    """Inner join to a table of few rows a key, such as a schema by layer, where a key may hold most rows of ``df``.

    The rows of a key are dealt by ``by`` to ``parts`` groups and the few rows of ``small`` are copied to each, so that no task
    gets all rows of a key. The rows are sent before the join only, and rows equal in ``key`` and ``by`` stay together.
    """
    dealt = df.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).repartition(key, "_deal")
    copies = small.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.hint(GROWS).join(copies, [key, "_deal"]).drop("_deal")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to many tasks before work that makes much of each: a table of few bytes is read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def row_id(*cols) -> Column:
    """128-bit content id: stable across retries, and free of collisions at any row count met in practice."""
    return F.struct(F.xxhash64(*cols).alias("h"), F.xxhash64(F.lit("second"), *cols).alias("k"))


def dense_position(df: DataFrame, pos: str, out: str, keys: list[str] | None = None, block: int = 65536,
                   ties: tuple[str, ...] = ()) -> DataFrame:
    """Zero-based rank of an integer ``pos`` (then ``ties``) per key, without a window over the whole key.

    Rows rank inside blocks of ``block`` consecutive positions; block sizes, one row per block, are
    summed up in a second, small window.
    """
    keys = keys or []
    b = df.withColumn("_blk", F.floor(F.col(pos) / block).cast("long"))
    sizes = b.groupBy(*keys, "_blk").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if keys:
        cond = None
        o = offs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_blk").alias("_ob"), "_off")
        cond = F.col("_blk") == F.col("_ob")
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        j = b.join(o, cond).drop("_ob", *[f"_k{i}" for i in range(len(keys))])
    else:
        j = b.join(offs, "_blk")
    rank = F.row_number().over(W.partitionBy(*keys, "_blk").orderBy(pos, *ties)) - 1
    return j.withColumn(out, F.col("_off") + rank).drop("_blk", "_off")
