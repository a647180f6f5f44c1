"""Structured Streaming forms of the feature, run and cache operators.

Stateless chains reuse the batch projections; keyed state follows the batch folds, so a drained stream
equals the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions import geometry as G
from ..operators import arrangement as A
from ..operators import build as B
from ..operators import classify as C
from ..operators import quality as Q
from ..operators import spatial as S
from ..operators.build import BuildProfile


def _instant(c: str):
    """A zone-free time read as UTC: watermarks need an instant, and days must not move with the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c).cast("timestamp_ntz")).cast("timestamp")


def landing(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000, glob: str = "*") -> DataFrame:
    """Stream of a landing directory; the batch size bounds what one trigger takes."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob).format(fmt).load(path)


def stream_features(stream: DataFrame, profile: BuildProfile) -> DataFrame:
    """Row-local part of feature building: mapping, reprojection and precision; unusable rows are marked."""
    from ..functions import crs as R

    here = F.col("geom").isNotNull() & ~G.is_empty("geom")
    d = stream.withColumn("geom", F.when(here, G.map_geometry("geom", profile.closed_to_polygon, profile.orientation, profile.promote)))
    if profile.source_crs and profile.target_crs and profile.source_crs != profile.target_crs:
        d = d.withColumn("geom", R.reproject("geom", F.lit(profile.source_crs), F.lit(profile.target_crs)))
    if profile.precision_scale > 0:
        d = d.withColumn("geom", G.reduce_precision("geom", profile.precision_scale))
    return d.withColumn("status", F.when(F.col("geom").isNull(), "empty").otherwise("written"))


def stream_clip(stream: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return S.clip_to_box(stream, box)


def build_batch(profile: BuildProfile):
    """Operator of a micro-batch: the whole build, with its checks, repair, simplification and findings; every step looks at one feature."""
    def run(batch: DataFrame) -> dict[str, DataFrame]:
        features, findings = B.build_features(batch, profile)
        return {"features": features, "findings": findings}

    return run


def clip_batch(boundary: DataFrame, key: str, **how):
    """Operator of a micro-batch: features of any kind cut by stored boundaries (``boundary_id, boundary``)."""
    return lambda batch: {"clipped": A.clip(batch, boundary, key, **how)}


def each_batch(operator, path: str):
    """``foreachBatch`` function: a table per name that ``operator`` gives; an epoch that is repeated replaces its own part."""
    def run(batch: DataFrame, epoch: int) -> None:
        for name, made in operator(batch).items():
            made.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")

    return run


def stream_classify(stream: DataFrame, rules: list[C.MappingRule]) -> DataFrame:
    """Rule decisions on a stream: rules are plan-time predicates, so there is no join and no state."""
    return C.decide(stream, rules)


def stream_qa(stream: DataFrame) -> DataFrame:
    """Findings that one row shows by itself: geometry checks and slivers."""
    return Q.check_geometry(stream, self_intersection=False).unionByName(Q.check_slivers(stream))


def overlaps_against(stored_path: str, size: float):
    """``foreachBatch`` function: overlaps of a micro-batch with itself and with what is already stored."""
    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = G.with_envelope(batch.withColumn("_new", F.lit(True)))
        out = f"{stored_path}/findings/epoch={epoch}"
        base = f"{stored_path}/features"
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        exists = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm)
        every = new
        if exists:
            # Earlier epochs only, so that a replayed epoch sees what it saw the first time.
            old = spark.read.parquet(base).where(F.col("epoch") < epoch).drop("epoch").withColumn("_new", F.lit(False))
            every = G.with_envelope(old).unionByName(new)
        o = Q.overlap_areas(every, size)
        fresh = new.select("feature_id")
        hit = o.join(fresh, "feature_id", "left_semi").unionByName(o.join(fresh.withColumnRenamed("feature_id", "other_id"), "other_id", "left_semi")).dropDuplicates(["feature_id", "other_id"])
        hit.write.mode("overwrite").parquet(out)
        batch.write.mode("overwrite").parquet(f"{base}/epoch={epoch}")

    return run


# --- keyed state --------------------------------------------------------------------------------------------

_AT = T.StructField("at_ms", T.LongType())

class FailureRuns(StatefulProcessor):
    """Runs of failures of one layer inside one block of positions, kept as two bits a position.

    Every batch gives the block's summary anew: summaries add up, whatever order the rows came in. A block whose latest row the
    watermark has passed is closed: its bits go, and rows that still come for it are dropped.
    """

    def __init__(self, limit: int, block: int):
        self.limit, self.block = limit, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bits = handle.getValueState("bits", T.StructType([T.StructField("seen", T.BinaryType()), T.StructField("failed", T.BinaryType()), _AT]))
        self.closed = handle.getValueState("closed", T.StructType([T.StructField("closed", T.BooleanType())]))

    def _summary(self, seen: np.ndarray, failed: np.ndarray, start: int) -> dict:
        at = np.flatnonzero(seen)
        f = failed[at].astype(bool)
        n = len(at)
        fine = np.flatnonzero(~f)
        runs = np.arange(n) - np.maximum.accumulate(np.where(f, -1, np.arange(n)))
        full = np.flatnonzero(f & (runs >= self.limit))
        head = int(fine[0]) if len(fine) else n
        return {"n": n, "tail": n - 1 - int(fine[-1]) if len(fine) else n, "whole": not len(fine), "cut": start + int(at[full[0]]) if len(full) else None,
                "head": [start + int(i) for i in at[:min(head, self.limit)]]}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer: TimerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            return
        start = int(key[1]) * self.block
        held = self.bits.get() if self.bits.exists() else None
        seen, failed = (np.unpackbits(np.frombuffer(h, dtype=np.uint8))[: self.block] if held else np.zeros(self.block, dtype=np.uint8) for h in (held or (None, None))[:2])
        latest = int(held[2]) if held else 0
        for r in rows:
            at = r["pos"].to_numpy() - start
            seen[at] = 1
            failed[at] = r["failed"].to_numpy().astype(np.uint8)
            latest = max(latest, int(r["at_ms"].max()))
        self.bits.update((np.packbits(seen).tobytes(), np.packbits(failed).tobytes(), latest))
        self.handle.registerTimer(latest)
        yield pd.DataFrame([{"layer": key[0], "blk": int(key[1]), **self._summary(seen, failed, start)}])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bits.exists() and self.bits.get()[2] <= timerValues.getCurrentWatermarkInMs():
            self.bits.clear()
            self.closed.update((True,))
        return iter(())

    def close(self) -> None:
        pass


def stream_breaker(stream: DataFrame, limit: int = 1000, late: str = "1 hour", block: int = 4096) -> DataFrame:
    """Summaries of blocks of positions, as updates by ``layer, blk``, from ``layer, pos, failed, at``; ``breaker_cuts`` reads them.

    A null ``failed`` counts as no failure and a null ``at`` as the beginning of time.
    """
    d = stream.select("layer", F.floor(F.col("pos") / block).cast("long").alias("blk"), "pos", F.coalesce("failed", F.lit(False)).alias("failed"), _instant("at").alias("at"))
    d = d.withWatermark("at", late).withColumn("at_ms", F.coalesce(F.unix_millis("at"), F.lit(0)))
    return d.groupBy("layer", "blk").transformWithStateInPandas(
        statefulProcessor=FailureRuns(limit, block), outputStructType="layer string, blk long, n long, tail long, whole boolean, cut long, head array<long>",
        outputMode="Update", timeMode="EventTime")


def breaker_cuts(blocks: DataFrame, limit: int = 1000) -> DataFrame:
    """``layer, cut``: the position at which a layer has failed ``limit`` times in a row, from the latest summary of each block."""
    before = W.partitionBy("layer").orderBy("blk")
    d = blocks.withColumn("_isl", F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(before.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_reach", F.sum("tail").over(W.partitionBy("layer", "_isl").orderBy("blk").rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_carry", F.coalesce(F.lag("_reach").over(before), F.lit(0)))
    # A carry of the limit or more was cut in an earlier block.
    joined = F.when(F.col("_carry") < limit, F.get("head", (F.lit(limit - 1) - F.col("_carry")).cast("int")))
    return d.groupBy("layer").agg(F.min(F.least(joined, "cut")).alias("cut")).where("cut IS NOT NULL")


def rows_until_cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows of each layer up to its cut, with a flag on the row there."""
    d = rows.join(cuts, "layer", "left").where(F.col("cut").isNull() | (F.col("pos") <= F.col("cut")))
    return d.withColumn("abandoned", F.coalesce(F.col("pos") == F.col("cut"), F.lit(False))).drop("cut")




def _in_order(held: list[tuple], at: int, watermark: int) -> tuple[list[tuple], int]:
    """Held rows in their order, and how many at the start are final: the watermark has passed their time, field ``at``."""
    held = sorted(held)
    return held, next((i for i, r in enumerate(held) if r[at] > watermark), len(held))


class ResponseCache(StatefulProcessor):
    """One expiry time per key, compared with event time so that a replay decides alike.

    Requests that the watermark has not passed are held and decided again with what comes between them; an expiry time
    that it has passed is forgotten.
    """

    def __init__(self, minutes: float):
        self.ms = int(minutes * 60000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", T.StructType([T.StructField("ms", T.LongType())]))
        self.held = handle.getListState("held", T.StructType([_AT, T.StructField("seq", T.LongType())]))

    def _settle(self, held: list[tuple], watermark: int) -> list[tuple]:
        """``seq, hit`` of the held requests; those that are final leave only their expiry time."""
        held, final = _in_order(held, 0, watermark)
        until = kept = self.until.get()[0] if self.until.exists() else None
        out = []
        for n, (at, seq) in enumerate(held, 1):
            hit = until is not None and at < until
            until = until if hit else at + self.ms
            kept = until if n <= final else kept
            out.append((seq, hit))
        if kept is not None and kept > watermark:
            self.until.update((kept,))
        else:
            self.until.clear()
        self.held.put(held[final:]) if held[final:] else self.held.clear()
        wake = held[-1][0] if held[final:] else kept if kept is not None and kept > watermark else None
        if wake is not None:
            self.handle.registerTimer(wake)
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer: TimerValues) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        held = [tuple(r) for r in held] + [(int(at), int(seq)) for r in rows for at, seq in zip(r["at_ms"], r["seq"])]
        out = self._settle(held, timer.getCurrentWatermarkInMs())
        yield pd.DataFrame({"key": int(key[0]), "seq": [o[0] for o in out], "hit": [o[1] for o in out]})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle([tuple(r) for r in self.held.get()] if self.held.exists() else [], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def stream_cache(requests: DataFrame, ttl_minutes: float = 240.0, late: str = "1 hour") -> DataFrame:
    """Requests (``key, seq, at``) marked as hits or calls; only calls go on to the scorer.

    A request's mark may change, as an update of ``key, seq``, until the watermark has passed it.
    """
    d = requests.select("key", "seq", _instant("at").alias("at")).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return d.groupBy("key").transformWithStateInPandas(
        statefulProcessor=ResponseCache(ttl_minutes), outputStructType="key long, seq long, hit boolean", outputMode="Update", timeMode="EventTime")


class RunFold(StatefulProcessor):
    """Run status from its events: queued, running, then one terminal state; refused moves are counted.

    Events that the watermark has not passed are held and folded again in the order of ``seq`` with what comes between
    them, so that the status does not depend on how events fall into batches.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("status", T.StringType()), T.StructField("illegal", T.LongType())]))
        self.held = handle.getListState("held", T.StructType([T.StructField("seq", T.LongType()), T.StructField("status", T.StringType()), _AT]))

    @staticmethod
    def _move(status: str, illegal: int, to: str) -> tuple[str, int]:
        if to == "Queued":
            return status, illegal
        if (status == "Queued" and to in ("Running", "Failed", "Cancelled")) or (status == "Running" and to != "Running") \
                or (status in ("Failed", "Cancelled") and to == "Failed"):
            return to, illegal
        return status, illegal + 1

    def _settle(self, held: list[tuple], watermark: int) -> tuple[str, int]:
        held, final = _in_order(held, 2, watermark)
        now = self.state.get() if self.state.exists() else ("Queued", 0)
        now = (now[0], int(now[1]))
        for n, (_, to, _) in enumerate(held, 1):
            now = self._move(*now, to)
            if n == final:
                self.state.update(now)
        if held[final:]:
            self.held.put(held[final:])
            self.handle.registerTimer(max(r[2] for r in held))
        else:
            self.held.clear()
        return now

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer: TimerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        held += [(int(q), to, int(at)) for r in rows for q, to, at in zip(r["seq"], r["status"], r["at_ms"])]
        status, illegal = self._settle(held, timer.getCurrentWatermarkInMs())
        yield pd.DataFrame({"run_id": [int(key[0])], "status": [status], "illegal": [illegal]})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle([tuple(r) for r in self.held.get()] if self.held.exists() else [], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def stream_runs(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Live status per run from ``run_id, seq, status, at``; repeated deliveries inside the watermark are dropped."""
    d = events.withColumn("at", _instant("at")).withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "seq"])
    d = d.withColumn("at_ms", F.coalesce(F.unix_millis("at"), F.lit(0)))
    return d.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunFold(), outputStructType="run_id long, status string, illegal long", outputMode="Update", timeMode="EventTime")


def runs_per_window(runs: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Finished runs per window and status, final once the watermark has passed."""
    d = runs.withColumn("finished_at", _instant("finished_at")).withWatermark("finished_at", late)
    g = d.groupBy(F.window("finished_at", width).alias("w"), "status").agg(F.count("*").alias("n"))
    start = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("w.start").cast("timestamp_ntz"))
    return g.select(start.alias("window_start"), "status", "n")
