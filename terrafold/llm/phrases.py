"""Removal of passages that an earlier document holds, by repeated-phrase automata.

Phrases that recur in several documents are confirmed by grouping anchors (see ``repeats``). Each shard compiles its phrases
into an Aho-Corasick automaton and streams through it the segments of the documents that hold them, one of each set of
equal segments, to locate every occurrence; the passages of ``n`` words around the occurrences are then compared word by
word, and those that stand in a document with a smaller id are removed.

Words are runs of anything but ASCII white space, unchanged. A repetition inside one document is no repetition. Null texts
have no words; null ids come first; rows of one id count as one document; an empty table gives an empty one; other columns
pass through ``drop_passages`` whatever their names.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .repeats import Unit, merged, mix, prefix_sums, rank_runs, repeated_runs, run_hash, with_spans
from .shared import in_batches

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
#: Words of a phrase: lines shorter than this may be as common as they like.
PHRASE = 25
#: Bytes of a text hashed at once.
PART = 1 << 18


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_WHITE[b]
    edge = np.diff(inside)
    return np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]


def _word_hashes(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    values, at = [np.zeros(0, np.uint64)], 0
    while at < len(lo):  # words of bounded bytes together, or one word
        end = max(at + 1, int(np.searchsorted(hi, lo[at] + PART)))
        a, b = int(lo[at]), int(hi[end - 1])
        values.append(run_hash(prefix_sums(_VALUES[np.frombuffer(raw, np.uint8, b - a, a)]), lo[at:end] - a, hi[at:end] - a))
        at = end
    return np.concatenate(values)


def word_unit(n: int = 50, k: int = PHRASE) -> Unit:
    def split(text):
        raw = text.encode("utf-8", "surrogatepass")
        lo, hi = _words(raw)
        return _word_hashes(raw, lo, hi), (raw, lo, hi)

    def context(pieces, a, b):
        raw, lo, hi = pieces
        return b" ".join([raw[x:y] for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist())])

    def windows(context):
        w = context.split(b" ")
        return (b" ".join(w[i:i + n]) for i in range(len(w) - n + 1))

    return Unit(n, k, split, context, windows, False)


def _recurring(doc: np.ndarray, contexts: list[bytes], n: int) -> np.ndarray:
    """Contexts with a run of ``n`` words whose hash stands in another document too."""
    raw = b"\n".join(contexts)
    lo, hi = _words(raw)
    sums = prefix_sums(_word_hashes(raw, lo, hi))
    first = np.searchsorted(lo, np.cumsum([0] + [len(x) + 1 for x in contexts]))
    size = np.diff(first)
    at = np.arange(max(1, int(size.max()) - n + 1))[None, :]
    valid = at + n <= size[:, None]
    start = (first[:-1, None] + at)[valid]
    d = np.broadcast_to(doc[:, None], valid.shape)[valid]
    order = np.lexsort((d, h := run_hash(sums, start, start + n)))
    same, other = h[order][1:] == h[order][:-1], d[order][1:] != d[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    many = np.zeros(len(start), bool)
    many[order] = np.bincount(group[1:], same & other, group[-1] + 1)[group] > 0
    out = np.zeros(valid.shape, bool)
    out[valid] = many
    return out.any(1)


def automaton_solver(n: int, k: int = PHRASE):
    def solve(anchor, doc, lo, contexts):
        hit = np.zeros((len(contexts), max(n, *(x.count(b" ") + 1 for x in contexts)) - n + 1), bool)
        some = np.nonzero(_recurring(doc, contexts, n))[0]
        if len(some):
            found = locate(anchor[some], doc[some], [contexts[i].decode("latin-1").split(" ") for i in some])
            hit[some, :found.shape[1]] = found
        return hit

    def locate(anchor, doc, split):
        # The phrase at its anchor is what the confirmed segments of a group have in common.
        machine = ahocorasick.Automaton()
        for phrase in {" ".join(w[a:a + k]) for a, w in zip(anchor.tolist(), split)}:
            machine.add_word(f" {phrase} ", k)
        machine.make_automaton()
        width = max(n, *(len(w) for w in split))
        m, near, number = np.zeros((len(split), width), np.int64), np.zeros((len(split), width - n + 1), bool), {}
        for i, w in enumerate(split):
            m[i, :len(w)] = [number.setdefault(x, len(number) + 1) for x in w]
            ends = np.cumsum([len(x) + 1 for x in w])
            for stop, size in machine.iter(f" {' '.join(w)} "):
                last = int(np.searchsorted(ends, stop))  # the phrase's last word
                near[i, max(0, last - n + 1):max(0, last - size + 2)] = True
            near[i, max(0, len(w) - n + 1):] = False
        rank = rank_runs(m, n)
        hit = np.zeros(rank.shape, bool)
        r, d = rank[near], np.broadcast_to(doc[:, None], rank.shape)[near]
        if len(r):
            order = np.lexsort((d, r))
            new = np.concatenate([[True], r[order][1:] != r[order][:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
            later = np.empty(len(r), bool)
            later[order] = d[order] > d[order][first]
            hit[near] = later
        return hit

    return solve


def _cleaned(docs: DataFrame, n: int) -> DataFrame:
    unit = word_unit(n)
    return with_spans(docs, repeated_runs(docs, unit, automaton_solver(n)))


def _keep_words(text: str, spans) -> tuple[int, int, str]:
    raw = text.encode("utf-8", "surrogatepass")
    lo, hi = _words(raw)
    gone = merged(np.array([(s["lo"], s["hi"]) for s in spans or ()], np.int64).reshape(-1, 2), len(lo))
    left = np.ones(len(lo), bool)
    for a, b in gone:
        left[a:b] = False
    kept = b" ".join([raw[x:y] for x, y in zip(lo[left].tolist(), hi[left].tolist())])
    return len(lo), int(len(lo) - left.sum()), kept.decode("utf-8", "surrogatepass")


def remove_passages(docs: DataFrame, n: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (words joined by one space) for every row of ``docs (doc_id, text)``."""

    def run(batches):
        for b in batches:
            out = [(d, *_keep_words(t, s)) for d, t, s in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = _cleaned(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), n)
    return in_batches(rows.select("row.doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def drop_passages(docs: DataFrame, n: int = 50) -> DataFrame:
    """``docs`` with shortened texts: rows that lose nothing are unchanged, rows that lose every word go; ``n_chars`` follows the text."""

    def run(batches):
        for b in batches:
            new = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words, removed, kept = _keep_words(t or "", s) if s else (0, 0, "")
                new.append((t if not removed else kept, not removed or removed < words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in new], pa.string())], names=["row", "text"]).filter(pa.array([k for _, k in new], pa.bool_()))

    rows = _cleaned(docs, n)
    # The row travels without its old text.
    others = [c for c in docs.columns if c != "text"]
    bare = rows.withColumn("row", F.struct(*(F.col(f"row.`{c}`") for c in others)))
    out = in_batches(bare).mapInArrow(run, T.StructType([T.StructField("row", bare.schema["row"].dataType), T.StructField("text", T.StringType())]))
    text = {"text": F.col("text")}
    if "n_chars" in others:
        text["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(text[c].alias(c) if c in text else F.col(f"row.`{c}`") for c in docs.columns))
