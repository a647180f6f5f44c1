"""Run a stream over everything that is there and read the result back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str = "append", keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Process all available input and return the sink's rows.

    Output and progress live in the shared checkpoint folder.  In update mode the last row of each key,
    by epoch and then ``order``, is the result.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    w = stream.writeStream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    if mode == "append":
        w.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def put(batch: DataFrame, epoch: int) -> None:
        # The epoch names its directory, so a repeated epoch replaces itself.
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w.outputMode(mode).foreachBatch(put).start().awaitTermination()
    d = spark.read.parquet(out)
    last = F.struct("epoch", *([order] if order else []), *[c for c in stream.columns if c not in (keys or []) and c != order])
    rest = [c for c in stream.columns if c not in keys]
    return d.groupBy(*keys).agg(F.max(last).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def drain_batches(stream: DataFrame, operator) -> dict[str, DataFrame]:
    """Process all available input batch by batch with ``operator`` (a micro-batch to named tables) and return the tables."""
    from .features import each_batch

    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    layout = {}

    def noted(batch: DataFrame) -> dict[str, DataFrame]:
        made = operator(batch)
        layout.update({name: d.schema for name, d in made.items()})
        return made

    w = stream.writeStream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True)
    w.foreachBatch(each_batch(noted, f"{base}/out")).start().awaitTermination()
    if layout:
        return {name: spark.read.schema(schema).parquet(f"{base}/out/{name}").select(*schema.names) for name, schema in layout.items()}
    # A stream without input has its tables all the same.
    return {name: spark.createDataFrame([], d.schema) for name, d in operator(spark.createDataFrame([], stream.schema)).items()}
