"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Pieces of one length are alike, so the packing is worked out on the table of lengths (at most ``capacity`` rows, however
many documents there are): a bin is filled greedily, then its smallest piece gives way to two unpacked pieces whose sum
fits the expanded gap more tightly. A bin's pattern is repeated as often as its lengths last, which uses one of them
up, so there are few patterns. Each piece finds its place by its rank among the pieces of its length; ranks are counted
in blocks, so that no length gathers in one task.

Null texts are empty (id 1 alone); repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import in_batches, keep
from .tokens import encoder

#: Pieces in one block of ranks, about.
RANK_BLOCK = 20_000


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only beyond ``capacity``."""
    end = struct.pack("<I", end_id)

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = memoryview(enc.encode(t) + end)
                for i, s in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[s:s + 4 * capacity]
                    rows.append((d, i, s // 4, len(x) // 4, zlib.crc32(x)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return in_batches(texts).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _best_two(mask: int, left: list[int], taken: dict[int, int], gap: int, above: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum over ``above`` that fit ``gap``."""
    best, pair = above, None
    below = mask & ((1 << gap) - 1)
    while below:
        a = below.bit_length() - 1
        if 2 * a <= best:
            break
        below ^= 1 << a
        fits = mask & ((1 << (min(a, gap - a) + 1)) - 1)
        b = fits.bit_length() - 1
        if b == a and left[a] - taken.get(a, 0) < 2:
            b = (fits ^ (1 << a)).bit_length() - 1
        if b > 0 and a + b > best:
            best, pair = a + b, (a, b)
            if best == gap:
                break
    return pair


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots ``(length, first rank, first sequence, pieces of this length in a sequence, offset)`` and the number of sequences."""
    left, used = [0] * (capacity + 1), [0] * (capacity + 1)
    mask = 0
    for n, c in counts.items():
        left[n], mask = c, mask | (1 << n)
    slots, sequence = [], 0
    while mask:
        taken: dict[int, int] = {}
        free, gap = mask, capacity
        while fits := free & ((1 << (gap + 1)) - 1):
            n = fits.bit_length() - 1
            k = min(left[n], gap // n)
            taken[n], gap = k, gap - k * n
            free ^= 1 << n
        if len(taken) > 1 or sum(taken.values()) > 1:
            small = min(taken)
            taken[small] -= 1
            open_ = free
            for n, k in taken.items():
                if k < left[n]:
                    open_ |= 1 << n
            pair = _best_two(open_, left, taken, gap + small, small)
            for n in pair or (small,):
                taken[n] = taken.get(n, 0) + 1
        taken = {n: k for n, k in taken.items() if k}
        times = min(left[n] // k for n, k in taken.items())
        offset = 0
        for n in sorted(taken, reverse=True):
            slots.append((n, used[n], sequence, taken[n], offset))
            offset += n * taken[n]
            left[n] -= times * taken[n]
            used[n] += times * taken[n]
            if not left[n]:
                mask ^= 1 << n
        sequence += times
    return slots, sequence


def pack(pieces: DataFrame, capacity: int = 4096, order: tuple[str, ...] = ("doc_id", "piece", "start", "ids_crc32")) -> DataFrame:
    """``pieces`` (a stored table with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    blocks = max(32, pieces.count() // RANK_BLOCK)
    rows = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    cells = rows.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    cells = keep(cells.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    # At most ``capacity`` rows.
    counts = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, _ = plan_bins(counts, capacity)
    slots = np.array(sorted(slots), np.int64).reshape(-1, 5)
    shift = 44  # ranks of one length
    keys = (slots[:, 0] << shift) + slots[:, 1]
    inside = W.partitionBy("length", "_b").orderBy(*order)
    ranked = (rows.withColumn("_r", F.row_number().over(inside)).join(cells.select("length", "_b", "_off"), ["length", "_b"])
              .withColumn("_r", F.col("_r") - 1 + F.col("_off")).select(*pieces.columns, "_r"))
    names = list(pieces.columns)
    at, n_at = len(names), names.index("length")

    def place(batches):
        for b in batches:
            rank, n = b.column(at).to_numpy(), b.column(n_at).to_numpy()
            s = slots[np.searchsorted(keys, (n << shift) + rank, "right") - 1]
            turn, k = np.divmod(rank - s[:, 1], s[:, 3])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array(s[:, 2] + turn), pa.array(s[:, 4] + k * n)],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return in_batches(ranked).mapInArrow(place, schema + ", sequence_id long, offset long")
