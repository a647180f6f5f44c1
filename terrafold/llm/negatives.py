"""Hard negatives by the threshold algorithm over sorted lists.

Components become integers, so scores are exact. Rows are dealt to shards of bounded size and anchors to blocks; each pair of
a block and a shard is one task. A shard keeps one list of its rows per dimension, sorted by that component. An anchor reads every
list from the end that its component's sign asks for, scores the rows it meets (random access), and stops once the
threshold, the score that a row at the present depth of every list would have, is strictly below the ``k``-th score of what it
looks for: the best rows of its label first, then, for each of these positives, the best rows of other labels within a window
of scores. Ties are told by id, which is why the bound is strict. A window that stays short is settled when the threshold is
below its lower end. What shards find is merged by rank.

Positives look through shards of the anchor's own label, so small labels are small searches; a label of any size is split.
Only rows with an id, a label and a vector of finite components take part; exact repeats of a row count once, rows that share an id
otherwise count each. Shorter vectors are taken as padded with zeros; components from 2**54 on, and scores beyond 64 bits,
are an error. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import keep

#: Components of a shard, rows it has at least, and anchors of a block, about; the depth at which an anchor first looks up.
SHARD_VALUES, SHARD_LEAST, ANCHORS, DEPTH = 1 << 20, 256, 1024, 32


def quantised(embeddings: DataFrame, scale: int = 256, label: Column | None = None) -> DataFrame:
    """``id, label, v, key`` of the rows that take part; ``key`` tells rows of one id apart."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    v = F.transform(x, lambda c: F.when(F.abs(c) < 2.0 ** 54, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large"))).cast("long"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("id"), (embeddings["label"] if label is None else label).cast("long").alias("label"), embeddings["embedding"])
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select("id", "label", v.alias("v"))
    return rows.withColumn("key", F.xxhash64("label", "v")).dropDuplicates(["id", "label", "v"])


class Lists:
    """The sorted lists of a shard."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.order = np.argsort(v, axis=0, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(v, self.order, 0)

    def search(self, a: np.ndarray, offer, settled) -> int:
        """Call ``offer(rows, scores)`` with what anchor ``a`` meets until ``settled(threshold)``; the depth reached."""
        n, up, down = len(self.v), np.nonzero(a > 0)[0], np.nonzero(a < 0)[0]
        seen, left = np.zeros(n, bool), n
        done, depth = 0, min(DEPTH, n)
        while left:
            met = np.concatenate([self.order[n - depth:n - done, up].ravel(), self.order[done:depth, down].ravel()])
            met = np.unique(met[~seen[met]]) if len(up) + len(down) else np.arange(n)
            seen[met] = True
            left -= len(met)
            offer(met, self.v[met] @ a)
            if settled((self.value[n - depth, up] * a[up]).sum() + (self.value[depth - 1, down] * a[down]).sum()):
                break
            done, depth = depth, min(2 * depth, n)
        return depth


class Best:
    """The ``k`` best of what was offered, of scores from ``low`` to ``high``: highest first, ties by ``ids`` and ``keys``."""

    def __init__(self, k: int, ids: np.ndarray, keys: np.ndarray, low: int | None = None, high: int | None = None):
        self.k, self.ids, self.keys, self.low, self.high = k, ids, keys, low, high
        self.rows, self.scores = np.zeros(0, np.int64), None

    def offer(self, rows: np.ndarray, scores: np.ndarray) -> None:
        if self.low is not None:
            fit = (scores >= self.low) & (scores <= self.high)
            rows, scores = rows[fit], scores[fit]
        elif self.scores is not None and len(self.rows) == self.k:
            fit = scores >= self.scores[-1]
            rows, scores = rows[fit], scores[fit]
        if not len(rows):
            return
        rows = np.concatenate([self.rows, rows])
        scores = scores if self.scores is None else np.concatenate([self.scores, scores])
        if len(rows) > 4 * self.k and scores.dtype != object:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]], self.keys[rows[i]]))[:self.k]
        self.rows, self.scores = rows[order], scores[order]

    def settled(self, threshold) -> bool:
        if len(self.rows) == self.k and threshold < self.scores[-1]:
            return True
        return self.low is not None and threshold < self.low


def _matrix(table: pa.Table) -> np.ndarray:
    """Vectors as rows, padded with zeros: doubles where every score is exact in them, else Python integers."""
    lists = table.column("v").combine_chunks()
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    width = max(1, int(ends.max(initial=1)))
    top = max(abs(int(flat.max(initial=0))), abs(int(flat.min(initial=0))))
    out = np.zeros((len(ends), width), np.float64 if top * top * width < 1 << 53 else object)
    out[np.arange(width)[None, :] < ends[:, None]] = flat if out.dtype != object else [int(x) for x in flat]
    return out


def _blocks(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def _block(blocks: str, salt: str) -> Column:
    return F.pmod(F.xxhash64("id", "key", F.lit(salt)), F.col(blocks)).cast("int")


def _pairs(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows and anchors under ``shard, block``: every block of anchors beside every shard, of ``shards`` and ``blocks`` each row names."""
    def dealt(df, mine, others, a, b, salt, anchor):
        return df.withColumn(a, _block(mine, salt)).withColumn(b, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).withColumn("anchor", F.lit(anchor))

    left = dealt(rows, "shards", "blocks", "shard", "block", "row", False)
    right = dealt(anchors, "blocks", "shards", "block", "shard", "anchor", True)
    names = ["shard", "block", "anchor", "id", "label", "key", "v"]
    return left.select(*names, F.lit(None).cast("array<long>").alias("windows")).union(right.select(*names, "windows"))


def _found(hits: list[tuple]) -> pa.Table:
    columns = list(zip(*hits)) if hits else [()] * 6
    return pa.table({c: pa.array([int(y) for y in x], pa.int64()) for c, x in zip(("id", "key", "positive", "other", "other_key", "score"), columns)})


_FOUND = "id long, key long, positive long, other long, other_key long, score long"


def _groups(table: pa.Table):
    """A pair of a shard and a block: matrix, ids, keys, labels, windows, rows of the shard and of the anchors, in a fixed order."""
    table = table.sort_by([("anchor", "ascending"), ("id", "ascending"), ("key", "ascending")])
    m = _matrix(table)
    ids, keys, labels = (table.column(c).to_numpy() for c in ("id", "key", "label"))
    n = len(table) - int(np.count_nonzero(table.column("anchor").to_numpy(zero_copy_only=False)))
    return m, ids, keys, labels, table.column("windows").to_pylist()[n:], n


def _positives(k: int):
    def compare(table: pa.Table) -> pa.Table:
        m, ids, keys, _, _, n = _groups(table)
        hits = []
        if n and n < len(ids):
            lists = Lists(m[:n])
            for i in range(n, len(ids)):
                best = Best(k, ids, keys)

                def offer(rows, scores, i=i, best=best):
                    other = (ids[rows] != ids[i]) | (keys[rows] != keys[i])
                    best.offer(rows[other], scores[other])

                lists.search(m[i], offer, best.settled)
                hits += [(ids[i], keys[i], 0, ids[r], keys[r], s) for r, s in zip(best.rows, best.scores if len(best.rows) else ())]
        return _found(hits)

    return compare


def _negatives(k: int, low: int, high: int):
    def compare(table: pa.Table) -> pa.Table:
        m, ids, keys, labels, windows, n = _groups(table)
        hits = []
        if n and n < len(ids):
            lists = Lists(m[:n])
            for i, scores_of in zip(range(n, len(ids)), windows):
                # Scores from ``low`` to ``high`` hundredths of the positive's.
                open_ = {p: Best(k, ids, keys, -(-low * p // 100), high * p // 100) for p in scores_of if p >= 0}
                if not open_:
                    continue

                def offer(rows, scores, i=i, open_=open_):
                    other = labels[rows] != labels[i]
                    for b in open_.values():
                        b.offer(rows[other], scores[other])

                lists.search(m[i], offer, lambda t, open_=open_: all(b.settled(t) for b in open_.values()))
                hits += [(ids[i], keys[i], p, ids[r], keys[r], s) for p, b in open_.items() for r, s in zip(b.rows, b.scores if len(b.rows) else ())]
        return _found(hits)

    return compare


def mine_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``rows (id, label, v, key)``.

    Anchors are rows whose id is divisible by ``every``; a negative scores from ``low`` to ``high`` hundredths of its positive.
    """
    rows = keep(rows)
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("a"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("d")).first()
    size = max(SHARD_LEAST, SHARD_VALUES // max(1, total["d"]))
    anchors = rows.filter(F.col("id") % every == 0)
    by_label = rows.groupBy("label").agg(_blocks(F.count("*"), size).alias("shards"), _blocks(F.count_if(F.col("id") % every == 0), ANCHORS).alias("blocks")).filter("blocks > 0")

    pairs = _pairs(rows.join(by_label, "label"), anchors.join(by_label, "label").withColumn("windows", F.lit(None).cast("array<long>")))
    found = pairs.groupBy("label", "shard", "block").applyInArrow(_positives(positives), _FOUND)
    ordered = W.partitionBy("id", "key").orderBy(F.desc("score"), "other", "other_key")
    chosen = keep(found.withColumn("n", F.row_number().over(ordered)).filter(F.col("n") <= positives).select("id", "key", "other", "other_key", "score"))

    windows = chosen.groupBy("id", "key").agg(F.array_sort(F.collect_set("score")).alias("windows"))
    counts = {"shards": F.lit(max(1, -(-total["n"] // size))), "blocks": F.lit(max(1, -(-total["a"] // ANCHORS)))}
    pairs = _pairs(rows.withColumns(counts), anchors.join(windows, ["id", "key"]).withColumns(counts))
    found = pairs.groupBy("shard", "block").applyInArrow(_negatives(negatives, low, high), _FOUND)
    ordered = W.partitionBy("id", "key", "positive").orderBy(F.desc("score"), "other", "other_key")
    ranked = found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= negatives)
    ranked = ranked.select("id", "key", F.col("positive").alias("score"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = chosen.select("id", "key", "other", "score").join(ranked, ["id", "key", "score"])
    return out.select(F.col("id").alias("anchor_id"), F.col("other").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
