"""Removal of byte runs that occur earlier, by longest-previous-factor arrays.

Contexts that share an anchor are sorted as suffixes; of the suffixes that agree with one for ``n`` bytes, the nearest
before and after it with a smaller position hold its earlier matches. Suffixes that agree are put in order of position, so the
previous one is the previous smaller, the next smaller does not exist, and a longest previous factor reaches ``n`` bytes
exactly where such a neighbour stands at an earlier place.

Bytes are UTF-8; matches never cross documents; the first occurrence (smallest ``doc_id``, then start) stays. Null texts are
empty; null ids come first; rows of one id are one document, and of equal starts in several of them none is earlier; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Unit, merged, mix, rank_runs, repeated_runs, with_spans
from .shared import in_batches

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_unit(n: int = 100, k: int = 32) -> Unit:
    def split(text):
        raw = text.encode("utf-8", "surrogatepass")
        return _VALUES[np.frombuffer(raw, np.uint8)], raw

    return Unit(n, k, split, lambda raw, lo, hi: raw[lo:hi], lambda x: (x[i:i + n] for i in range(len(x) - n + 1)), True)


def previous_factor_reaches(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """True where the longest previous factor is a whole run: an equal ``rank`` at a smaller ``position``."""
    order = np.lexsort((position, rank))  # suffix order, equal suffixes by position
    r, p = rank[order], position[order]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    smaller = np.concatenate([[False], (p[1:] > p[:-1]) & ~new[1:]])
    # Contexts overlap, so one place may stand several times in a row: it has the neighbour of the first.
    step = np.cumsum(smaller)
    base = np.maximum.accumulate(np.where(new, step, 0))
    out = np.empty(len(rank), bool)
    out[order] = step > base
    return out


def suffix_solver(n: int):
    def solve(anchor, doc, lo, contexts):
        width = max(len(x) for x in contexts)
        m = np.zeros((len(contexts), max(width, n)), np.int64)
        size = np.array([len(x) for x in contexts])
        for i, x in enumerate(contexts):
            m[i, :len(x)] = np.frombuffer(x, np.uint8)
            m[i, :len(x)] += 1
        rank = rank_runs(m, n)
        valid = np.arange(rank.shape[1])[None, :] + n <= size[:, None]
        number = np.unique(doc, return_inverse=True)[1].astype(np.int64)
        place = (number[:, None] << 32) + lo[:, None] + np.arange(rank.shape[1])[None, :]
        hit = np.zeros(rank.shape, bool)
        hit[valid] = previous_factor_reaches(rank[valid], place[valid])
        return hit

    return solve


def remove_repeats(docs: DataFrame, n: int = 100) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) for every row of ``docs (doc_id, text)``."""
    unit = byte_unit(n)
    rows = with_spans(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), repeated_runs(docs, unit, suffix_solver(n)))

    def run(batches):
        for b in batches:
            out = []
            for d, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                gone = merged(np.array([(s["lo"], s["hi"]) for s in spans or ()], np.int64).reshape(-1, 2), len(raw))
                edges = [0, *(x for s in gone for x in s), len(raw)]
                out.append((d, len(raw), sum(y - x for x, y in gone), len(gone), b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return in_batches(rows.select("row.doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
