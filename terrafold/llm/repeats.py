"""Places of a corpus that occur in it before, found by anchors.

Any ``n`` consecutive units (bytes, or words by their hash) hold an anchor: of the ``k``-unit grams in them, the one with
the smallest hash. Copies have the same anchor at the same place, so occurrences meet in the group of their anchor, one row
for about ``(n - k) / 2`` units. Around an anchor, a context reaches over every run of ``n`` units that holds it. Occurrences
with equal contexts (a class) share their fate: all but the earliest are covered by it. Only the first of each class, in
groups of several classes, need their units compared; their contexts are fetched and given to a solver.

Equal contexts are combined inside each batch before the shuffle, so copies of one text do not meet in one task. A group
with more classes than ``GROUP`` is split in blocks that are solved alike; what a block holds first is then compared with
the other blocks by a 128-bit hash in an aggregate, which Spark combines before its shuffle.

A row is told from others by its id and the 64-bit hash of its text. Rows of one id are one document: of equal runs that start at the
same unit in several of them none is earlier. Null ids are one id, the smallest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import in_batches, keep, row_key

#: Units of one text hashed at once; classes of a group solved in one task; contexts solved at once.
CHUNK, GROUP, AT_ONCE = 1 << 18, 2048, 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NULL_ID = -(1 << 63)


@dataclass(frozen=True)
class Unit:
    """``split``: text to (one 64-bit value a unit, pieces); ``context``: pieces, from, to, to bytes; ``windows``: solver's units of a context."""

    n: int
    k: int
    split: Callable
    context: Callable
    windows: Callable
    same_document: bool


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(max(n, CHUNK * 2), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values))[0], out=out[1:])
    return out


def run_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the units from ``lo`` to ``hi``, wherever they stand."""
    return mix((sums[hi] - sums[lo]) * _powers(len(sums))[1][lo] + (hi - lo).astype(np.uint64))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    size, y, out = 1, x, len(x) - w + 1
    while 2 * size <= w:
        y = np.minimum(y[:-size], y[size:])
        size *= 2
    return np.minimum(y[:out], y[w - size:w - size + out])


def anchors(values: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors of a text, the hashes of their grams and of their contexts."""
    m, w, side = len(values), n - k + 1, n - k
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    last = -1
    for first in range(0, max(0, m - n + 1), CHUNK):
        # Runs that start from ``first`` on, with the contexts of their anchors.
        lo, hi = max(0, first - side), min(m, first + CHUNK - 1 + n + side)
        sums = prefix_sums(values[lo:hi])
        at = np.arange(first - lo, min(first + CHUNK - 1 + n, m) - lo - k + 1)
        gram = run_hash(sums, at, at + k)
        places = np.uint64((1 << 20) - 1)
        least = _least((gram & ~places) | np.arange(len(at), dtype=np.uint64), w)
        pick = np.unique((least & places).astype(np.int64))
        pos = at[pick]
        new = pos + lo > last
        pos, gram = pos[new], gram[pick][new]
        if len(pos):
            last = int(pos[-1]) + lo
            a, b = np.maximum(pos - side, 0), np.minimum(pos + n, hi - lo)
            found.append((pos + lo, gram, mix(run_hash(sums, a, b) + (pos - a).astype(np.uint64) * BASE)))
    return tuple(np.concatenate(x) for x in zip(*found))


def scan(docs: DataFrame, unit: Unit) -> DataFrame:
    """``h, c, doc, key, at, till``: anchors (``till`` 0), and what an equal context of the same batch covers, from ``at`` to ``till``."""
    n, side = unit.n, unit.n - unit.k

    def run(batches):
        for b in batches:
            parts = []
            for doc, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                values, _ = unit.split(text)
                pos, h, c = anchors(values, n, unit.k)
                if len(pos):
                    parts.append((h.view(np.int64), c.view(np.int64), np.full(len(pos), doc), np.full(len(pos), key), pos, np.full(len(pos), len(values))))
            if not parts:
                continue
            h, c, doc, key, at, size = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((key, at, doc, c, h))
            h, c, doc, key, at, size = h[order], c[order], doc[order], key[order], at[order], size[order]
            start = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            first = np.maximum.accumulate(np.where(start, np.arange(len(h)), 0))
            later = (doc != doc[first]) | ((at != at[first]) & unit.same_document)
            till = np.where(later, np.minimum(at + n, size), 0)
            at = np.where(later, np.maximum(at - side, 0), at)
            # Neighbouring covers of one row become one.
            cover = np.nonzero(later)[0]
            cover = cover[np.lexsort((at[cover], key[cover], doc[cover]))]
            d, k, a, t = doc[cover], key[cover], at[cover], till[cover]
            if len(cover):
                joins = (d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (a[1:] <= t[:-1])
                head = np.nonzero(np.concatenate([[True], ~joins]))[0]
                tail = np.concatenate([head[1:], [len(cover)]]) - 1
                d, k, a, t = d[head], k[head], a[head], t[tail]
            rest = ~later
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (
                (h[rest], mix((d ^ k ^ a).view(np.uint64)).view(np.int64)), (c[rest], np.zeros(len(d), np.int64)), (doc[rest], d), (key[rest], k), (at[rest], a), (np.zeros(rest.sum(), np.int64), t))], names=["h", "c", "doc", "key", "at", "till"])

    return in_batches(_keyed(docs)).mapInArrow(run, "h long, c long, doc long, key long, at long, till long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), row_key(docs["text"]).alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def rank_runs(m: np.ndarray, n: int) -> np.ndarray:
    """Equal numbers for equal runs of ``n`` along each row, in suffix order, by doubling."""
    rank, size = m.astype(np.int64), 1
    while size < n:
        step = min(size, n - size)
        a, b = rank[:, :rank.shape[1] - step], rank[:, step:]
        pair = a * (int(rank.max()) + 1) + b
        size += step
        rank = pair if size <= 4 and rank.max() < 1 << 15 else np.unique(pair, return_inverse=True)[1].reshape(pair.shape)
    return rank


def covered(hit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, from, to)`` of the unions of ``n``-unit runs that start where ``hit`` is true."""
    edge = np.zeros((hit.shape[0], hit.shape[1] + n + 1), np.int32)
    edge[:, 1:hit.shape[1] + 1] += hit
    edge[:, n + 1:] -= hit[:, :hit.shape[1]]
    inside = np.cumsum(edge, 1) > 0
    row, lo = np.nonzero(inside[:, 1:] & ~inside[:, :-1])
    _, hi = np.nonzero(~inside[:, 1:] & inside[:, :-1])
    return row, lo, hi


def repeated_runs(docs: DataFrame, unit: Unit, solve: Callable, group: int = GROUP) -> DataFrame:
    """``doc, key, lo, hi``: runs of units to remove; ``hi`` may pass the end of the text.

    ``solve(anchor, doc, lo, contexts)`` returns a boolean matrix for contexts of whole blocks, with the place of the anchor in
    each, its document and where it begins there: does the run that starts there occur earlier.
    """
    n, side = unit.n, unit.n - unit.k
    rows = scan(docs, unit).withColumn("cover", F.col("till") > 0).repartition("h", "cover")
    same = W.partitionBy("h", "cover", "c").orderBy("doc", "at", "key")
    whole = W.partitionBy("h", "cover")
    first_doc, first_at = F.first("doc").over(same), F.first("at").over(same)
    later = (F.col("doc") != F.col("_d")) | ((F.col("at") != F.col("_a")) & F.lit(unit.same_document))
    # Where repetitions inside a document do not count, one document alone needs no comparison.
    apart = F.lit(True) if unit.same_document else F.min("doc").over(whole) != F.max("doc").over(whole)
    blocks = F.ceil(F.sum(F.when(F.col("later"), 0).otherwise(1)).over(whole) / group).cast("int")
    found = (rows.withColumns({"_d": first_doc, "_a": first_at}).withColumn("later", F.col("cover") | later)
             .withColumns({"mixed": (F.min("c").over(whole) != F.max("c").over(whole)) & apart, "blocks": blocks}).filter(F.col("later") | F.col("mixed")))
    found = keep(found.select("h", "doc", "key", "at", "till", "later", "blocks"))
    place = F.col("at")
    covers = found.filter("later").select("doc", "key", F.when(F.col("till") > 0, place).otherwise(F.greatest(place - side, F.lit(0))).alias("lo"),
                                          F.when(F.col("till") > 0, F.col("till")).otherwise(place + n).alias("hi"))
    wanted = found.filter("not later").groupBy("doc", "key").agg(F.collect_list(F.struct(place.alias("pos"), "h", "blocks")).alias("want"))
    texts = _keyed(docs)

    def fetch(batches):
        for b in batches:
            out = []
            for doc, key, text, want in zip(*(b.column(i).to_pylist() for i in range(4))):
                _, pieces = unit.split(text)
                for x in want:
                    lo = max(0, x["pos"] - side)
                    out.append((x["h"], x["blocks"], doc, key, lo, x["pos"] - lo, unit.context(pieces, lo, x["pos"] + n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["h", "blocks", "doc", "key", "lo", "anchor", "context"])

    joined = texts.join(wanted, ["doc", "key"]).select("doc", "key", "text", "want")
    contexts = in_batches(joined).mapInArrow(fetch, "h long, blocks int, doc long, key long, lo long, anchor int, context binary")
    contexts = contexts.withColumn("block", F.pmod(F.xxhash64("doc", "key", "lo"), F.col("blocks")).cast("int"))

    def work(batches):
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table):
            doc, key, lo, blocks = (t.column(c).to_numpy() for c in ("doc", "key", "lo", "blocks"))
            contexts = t.column("context").to_pylist()
            hit = solve(t.column("anchor").to_numpy(), doc, lo, contexts)
            row, a, b = covered(hit, n)
            first = []  # of split groups: what other blocks may hold before
            for i in np.nonzero(blocks > 1)[0].tolist():
                for j, x in enumerate(unit.windows(contexts[i])):
                    if not hit[i, j]:
                        d = xxhash.xxh3_128_digest(x)
                        first.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), int(doc[i]), int(key[i]), int(lo[i]) + j))
            x, y, d, w, p = zip(*first) if first else ([],) * 5
            none = pa.nulls(len(row), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([u, pa.array(v, pa.int64())]) for u, v in (
                (none, x), (none, y), (pa.array(doc[row]), d), (pa.array(key[row]), w), (pa.array(lo[row] + a), p), (pa.array(lo[row] + b), [q + n for q in p]))], names=["x", "y", "doc", "key", "lo", "hi"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            h, block = t.column("h").to_numpy(), t.column("block").to_numpy()
            cut = int(np.argmax((h == h[-1]) & (block == block[-1])))  # the last block may go on in the next batch
            if cut:
                yield from done(t.slice(0, cut))
                t = t.slice(cut)
            held = t.to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    dealt = contexts.repartition("h", "block").sortWithinPartitions("h", "block", "doc", "lo", "key")
    solved = keep(in_batches(dealt).mapInArrow(work, "x long, y long, doc long, key long, lo long, hi long"))
    runs = solved.filter("x is not null").select("x", "y", "doc", "key", F.col("lo").alias("at")).distinct()
    firsts = runs.groupBy("x", "y").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    beyond = F.col("doc") > F.col("first.doc")
    if unit.same_document:
        beyond = beyond | ((F.col("doc") == F.col("first.doc")) & (F.col("at") > F.col("first.at")))
    hot = runs.join(firsts, ["x", "y"]).filter(beyond).select("doc", "key", F.col("at").alias("lo"), (F.col("at") + n).alias("hi"))
    return covers.union(solved.filter("x is null").select("doc", "key", "lo", "hi")).union(hot)


def merged(spans: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Unions of ``(lo, hi)`` spans within a text."""
    if not len(spans):
        return []
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    head = np.nonzero(np.concatenate([[True], spans[1:, 0] > top[:-1]]))[0]
    tail = np.concatenate([head[1:], [len(spans)]]) - 1
    return [(int(a), int(min(b, size))) for a, b in zip(spans[head, 0], top[tail])]


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``row`` (each of ``docs`` as it is), ``text`` and ``spans``, its rows of ``found`` (null if there are none)."""
    spans = found.groupBy("doc", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"].alias("text"),
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), row_key(docs["text"]).alias("key"))
    return rows.join(spans, ["doc", "key"], "left").select("row", "text", "spans")
