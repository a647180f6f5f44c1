"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes those whose cap it lies in (inner product of ``threshold`` standard deviations or
more). Directions form a product code: the rotated space is cut in two halves with random codewords each, and a filter is a
pair of codewords, so the filters that a vector exceeds are decoded from two short lists of scores. Vectors of one label
that pass a common filter are compared exactly in double precision, each pair in its first common filter only. With more
vectors of a label the caps get smaller and the code larger, so that a vector meets about as many others.

Equal vectors are compared once. A filter that many vectors pass is compared in pairs of blocks. Nulls, zero vectors and
vectors with null or non-finite components link with nothing; lengths must agree; null labels link with nothing.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, in_batches, keep
from .simhash import Groups

#: Filters that a vector passes, on average and at least; vectors of a label that it meets in one filter, about; vectors in one block.
LIST, LEAST, MEET, BLOCK, MIN_THRESHOLD = 20, 20, 32, 1024, 2.4


def code(dim: int, vectors: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rotation, codewords of both halves, threshold in standard deviations."""
    share = min(1 - NormalDist().cdf(MIN_THRESHOLD), MEET / max(1, vectors))
    threshold = NormalDist().inv_cdf(1 - share)
    words = max(2, math.ceil(math.sqrt(LIST / share)))
    rng = np.random.default_rng([seed, dim])
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    cut = dim // 2
    halves = []
    for size in (cut, dim - cut):
        c = rng.normal(size=(words, max(1, size)))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(max(1, size)))
    return turn, halves[0], halves[1], threshold


def decode(unit: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray, float]) -> list[np.ndarray]:
    """For each unit vector, the numbers of all filters that it exceeds (of its ``LEAST`` best if it exceeds fewer), ascending."""
    turn, first, second, threshold = coded
    dim = unit.shape[1]
    x = unit @ turn
    cut = dim // 2
    a = x[:, :cut] @ first[:, :cut].T if cut else np.zeros((len(x), len(first)))
    b = x[:, cut:] @ second.T
    out = []
    for s, t in zip(a, b):
        # The best LEAST codewords of each half hold the best LEAST pairs.
        i, j = np.argsort(-s)[:LEAST], np.argsort(-t)[:LEAST]
        best = np.sort((s[i][:, None] + t[j][None, :]).ravel())
        cap = min(threshold, best[-min(LEAST, len(best))])
        near = np.nonzero(s >= cap - t.max())[0]  # codewords with any partner over the threshold
        i, j = np.nonzero(s[near, None] + t[None, :] >= cap)
        out.append(near[i] * len(second) + j)
    return out


def clean_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, label, dim, vec`` of every row: ``vec`` is the components as doubles, null for what cannot link."""

    def run(batches):
        for b in batches:
            vecs = []
            for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = np.array(v, float) if label is not None and v and None not in v else np.zeros(0)
                vecs.append((x + 0.0).tobytes() if x.any() and np.isfinite(x).all() else None)  # -0.0 is 0.0
            dims = pa.array([v and len(v) // 8 for v in vecs], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), dims, pa.array(vecs, pa.binary())], names=["vec_id", "label", "dim", "vec"])

    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return in_batches(named).mapInArrow(run, "vec_id long, label string, dim int, vec binary")


def near_links(classes: DataFrame, cosine: float) -> DataFrame:
    """``a, b, links`` for a stored table ``cid, label, dim, vec, n``: links of each ``a`` (``b`` null), and edges that join groups."""
    sizes = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # one row per dimension
    codes = {r["dim"]: code(r["dim"], r["n"]) for r in sizes}

    def unit_of(x: list[bytes]) -> np.ndarray:
        v = np.array([np.frombuffer(y) for y in x])
        big = np.abs(v).max(1, keepdims=True)
        v = v / big
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def send(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                t = b.filter(pa.array(dims == dim))
                lists = decode(unit_of(t.column("vec").to_pylist()), codes[int(dim)])
                row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                packed = pa.array([x.astype("<i8").tobytes() for x in lists], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int64)), *(t.column(c).take(pa.array(row)) for c in ("label", "dim", "cid", "n", "vec")), packed.take(pa.array(row))],
                                                 names=["filter", "label", "dim", "cid", "n", "vec", "passed"])

    sent = in_batches(classes.select("label", "dim", "cid", "n", "vec")).mapInArrow(send, "filter long, label string, dim int, cid long, n long, vec binary, passed binary")
    sent = keep(sent)
    cells = sent.groupBy("label", "dim", "filter").count().filter("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    rows = sent.join(cells, ["label", "dim", "filter"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    keys = ["label", "dim", "filter", "lo", "hi"]
    rows = rows.select(*keys, "own", "cid", "n", "vec", "passed").repartition(*keys).sortWithinPartitions(*keys, "cid")

    def compare(t: pa.Table):
        """One pair of blocks of one filter."""
        f, lo, hi = (t.column(c)[0].as_py() for c in ("filter", "lo", "hi"))
        own, cid, n = (t.column(c).to_numpy() for c in ("own", "cid", "n"))
        u = unit_of(t.column("vec").to_pylist())
        near = u @ u.T >= cosine
        near &= own[:, None] < own[None, :] if lo < hi else np.arange(len(u))[:, None] < np.arange(len(u))[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            return None
        lists = [np.frombuffer(x, "<i8") for x in t.column("passed").to_pylist()]
        # A pair counts in its first common filter: filters below ``f`` must not be shared.
        table = np.full((len(lists), max(1, max(int(np.searchsorted(x, f)) for x in lists))), -1)
        for k, x in enumerate(lists):
            below = x[:np.searchsorted(x, f)]
            table[k, :len(below)] = below
        first = np.ones(len(i), bool)
        step = max(1, (1 << 22) // table.shape[1] ** 2)
        for a in range(0, len(i), step):
            x, y = table[i[a:a + step]], table[j[a:a + step]]
            first[a:a + step] = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any((1, 2))
        links = np.bincount(i[first], n[j[first]], len(u)) + np.bincount(j[first], n[i[first]], len(u))
        groups = Groups(len(u))
        groups.link(i[first], j[first])
        node, some = np.nonzero(groups.root != np.arange(len(u)))[0], np.nonzero(links)[0]
        return cid[node], cid[groups.root[node]], cid[some], links[some].astype(np.int64)

    def work(batches):
        def done(t: pa.Table):
            at, found = 0, []
            cols = [t.column(c).to_numpy(zero_copy_only=False) for c in keys]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0), [True]])
            for end in np.nonzero(new)[0][1:]:
                if end - at > 1 and (x := compare(t.slice(at, end - at))):
                    found.append(x)
                at = end
            if not found:
                return
            a, b, c, s = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, c])), pa.concat_arrays([pa.array(b), pa.nulls(len(c), pa.int64())]), pa.array(np.concatenate([np.zeros(len(a), np.int64), s]))], names=["a", "b", "links"])

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if held.num_rows < 2 * BLOCK:
                continue
            held = held.combine_chunks()
            last = [held.column(c)[held.num_rows - 1].as_py() for c in keys]
            tail = np.all([held.column(c).to_numpy(zero_copy_only=False) == v for c, v in zip(keys, last)], axis=0)
            cut = int(np.argmax(tail))  # the last cell may go on in the next batch
            if cut:
                yield from done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from done(held.combine_chunks())

    return in_batches(rows).mapInArrow(work, "a long, b long, links long")


def vector_components(rows: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows (vec_id, embedding, label)``."""
    every = keep(clean_vectors(rows).withColumn("cid", F.xxhash64("label", "vec")))
    valid = every.filter("vec is not null")
    classes = keep(valid.groupBy("label", "dim", "vec", "cid").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")))
    found = keep(near_links(classes, cosine))
    links = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null").select("a", "b")).select(F.col("id").alias("cid"), "root")
    linked = classes.select("cid", "n", "first").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    linked = keep(linked)
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_class = linked.join(lowest, "root").select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    named = valid.select("vec_id", "cid").join(by_class, "cid").select("vec_id", "n_links", "component_id")
    rest = every.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
