"""Periodic runs of words, by seeds that are extended along diagonals.

A run of ``least`` words or more that repeats its first ``q`` words ``times`` times or more agrees with itself, ``q`` words on, for
``least * (times - 1) / times`` words at least: the shortest overlap any run guarantees, and the length of the first grams.
Lags above that length have twice their lag as overlap, so grams of twice the length serve the next lags, and so on: a gram is
never shorter than its lag and never longer than the overlap. Inside a run of smallest period ``q`` such a gram next occurs
exactly ``q`` words on (a smaller distance would be a smaller period), so pairs of *neighbouring* occurrences in a document
hold a seed of every run, and there are no more of them than words. A seed is extended both ways word by word; a table of
the furthest place covered on each diagonal drops the seeds that an earlier extension went over. The documents of a batch lie
in one array, parted by values that occur once; a gram is looked for at the next length only where both its halves recur.

Null and empty texts have no words and no runs; very long texts are one row each and are handled in linear space; rows with
equal or null ids get a result each; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repeats import mix, prefix_sums, run_hash
from .shared import in_batches, words

#: Words compared in one step when an extension begins; each step is twice as long.
STEP = 32


def planted(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document (by ``crc32``) with a period from some word on; null ids and wordless texts stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewrite(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # Bound once, so that the words are not split again for every word.
    made = F.get(F.transform(F.filter(F.array(words(text)), lambda w: F.size(w) > 0), rewrite), 0)
    return F.when(h % 10 == 0, F.coalesce(made, text)).otherwise(text)


def _agree(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many values from ``a`` and ``b`` on (with a ``step`` of -1: back) agree."""
    size, done = STEP, 0
    while True:
        m = min(size, len(ids) - b - done) if step > 0 else min(size, a + 1 - done)
        if m <= 0:
            return done
        if step > 0:
            apart = ids[a + done:a + done + m] != ids[b + done:b + done + m]
        else:
            apart = (ids[a - done - m + 1:a - done + 1] != ids[b - done - m + 1:b - done + 1])[::-1]
        first = int(apart.argmax())
        if apart[first]:
            return done + first
        done, size = done + m, size * 2


def runs_of(ids: np.ndarray, doc: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of ``ids``, the words of many documents parted by values that occur once."""
    found: list[tuple[int, int, int]] = []
    k = least * (times - 1) // times
    low, at = 0, np.arange(max(0, len(ids) - k + 1))
    sums = prefix_sums(mix(ids.astype(np.uint64) + np.uint64(1)))
    recurs = np.zeros(len(ids), bool)
    while len(at):
        h = run_hash(sums, at, at + k)
        order = np.argsort(h, kind="stable")
        h, at = h[order], at[order]
        same = (h[1:] == h[:-1]) & (doc[at[1:]] == doc[at[:-1]])
        first, lag = at[:-1][same], (at[1:] - at[:-1])[same]
        recurs[:] = False
        recurs[first] = recurs[first + lag] = True
        mine = (lag > low) & (lag <= k)
        first, lag = first[mine], lag[mine]
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        # A seed one word after another on its diagonal lies in that one's extension.
        head = np.ones(len(first), bool)
        head[1:] = (lag[1:] != lag[:-1]) | (first[1:] != first[:-1] + 1)
        furthest: dict[int, int] = {}
        for i, q in zip(first[head].tolist(), lag[head].tolist()):
            if i < furthest.get(q, 0):
                continue
            ahead = _agree(ids, i, i + q, 1)
            furthest[q] = i + max(ahead, 1)
            if ahead < k:  # equal hashes of different grams
                continue
            start = i - _agree(ids, i - 1, i + q - 1, -1)
            length = i + ahead + q - start
            if length >= max(least, times * q):
                found.append((start, length, q))
        at = np.nonzero(recurs[:-k] & recurs[k:])[0] if len(ids) > k else at[:0]
        low, k = k, 2 * k
        at = at[at + k <= len(ids)]
    return found


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of runs by start and period, the first with the greatest exact length over period."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``doc_id, n_words, n_runs, start, length, period, exponent_milli, runs, collapsed`` for every row of ``docs (doc_id, text)``.

    ``runs`` are ``start,length,period`` lines by start, then period; the four fields are those of the run with the greatest
    exponent; ``collapsed`` is the text without the words of any run after its first period, joined by one space.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed binary"

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in b.column(1).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = np.cumsum(sizes + 1) - sizes - 1
            total = int(sizes.sum())
            ids = np.empty(total + len(texts), np.int64)
            part = np.zeros(len(ids), bool)
            part[starts + sizes] = True
            flat = np.empty(total, object)
            flat[:] = [w for t in texts for w in t]
            codes = pd.factorize(flat)[0] if total else np.zeros(0, np.int64)
            ids[~part], ids[part] = codes, total + np.arange(len(texts))
            doc = np.repeat(np.arange(len(texts)), sizes + 1)
            runs: dict[int, list[tuple[int, int, int]]] = {}
            for s, n, q in runs_of(ids, doc, least, times):
                d = int(doc[s])
                runs.setdefault(d, []).append((s - int(starts[d]), n, q))
            out = []
            for d, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), texts)):
                mine = sorted(runs.get(d, ()), key=lambda r: (r[0], r[2]))
                best, kept = (None,) * 4, text
                if mine:
                    s, n, q = _best(mine)
                    best = (s, n, q, 1000 * n // q)
                    gone = np.zeros(len(text) + 1, np.int32)
                    for s, n, q in mine:
                        gone[s + q] += 1
                        gone[s + n] -= 1
                    kept = [text[i] for i in np.nonzero(np.cumsum(gone[:-1]) == 0)[0].tolist()]
                out.append((doc_id, len(text), len(mine), *best, "".join(f"{s},{n},{q}\n" for s, n, q in mine), b" ".join(kept)))
            types = (*(pa.int64(),) * 7, pa.string(), pa.binary())
            columns = zip(*out) if out else ((),) * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in schema.split(", ")])

    return in_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))).mapInArrow(run, schema)


def run_digests(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``collapse_runs`` with hex digests in place of the lists and texts."""
    found = collapse_runs(docs, least, times)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(F.encode("runs", "UTF-8"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
