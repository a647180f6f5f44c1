"""Quality scores from random-indexing word vectors and a two-layer network.

A word (run of letters, of digits or of other signs) falls in a bucket; a bucket has a sparse random index vector, and its
word vector adds up the index vectors of the words beside it, over all documents. A document is the mean and spread of its
words' vectors with its length and share of distinct words. The network is trained on a bounded sample of labelled rows
outside the held-out fold and its logits are divided by a temperature fitted on rows that it was not trained on.

Null texts are empty and get a score; rows with a null quality are not learnt from; a null id falls in the fold of the
empty string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import mix, prefix_sums, run_hash
from .shared import in_batches, keep

BUCKETS, DIM, NONZERO, WINDOW = 8192, 64, 4, 2
#: Most labelled rows that the network is fitted on.
TRAIN_ROWS = 20_000
#: Rows of the vector table that travel together; partial sums are added in two steps.
BLOCK, SALTS = 512, 16
PART = 1 << 18

_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
_KIND = np.full(256, 3, np.int8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO], rng.choice([-1, 1], (BUCKETS, NONZERO))


def word_buckets(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kind = np.concatenate([[0], _KIND[raw], [0]])
    edge = np.nonzero(kind[1:] != kind[:-1])[0]
    word = kind[1:][edge[:-1]] > 0
    lo, hi = edge[:-1][word], edge[1:][word]
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(lo):
        end = max(at + 1, int(np.searchsorted(hi, lo[at] + PART)))
        a, b = int(lo[at]), int(hi[end - 1])
        out.append((run_hash(prefix_sums(_VALUES[raw[a:b]]), lo[at:end] - a, hi[at:end] - a) % np.uint64(BUCKETS)).astype(np.int64))
        at = end
    return np.concatenate(out)


def gather_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, a row of unit length per bucket: sums over all documents, of one fixed size."""
    places, signs = index_vectors()

    def run(batches):
        table = np.zeros(BUCKETS * DIM)
        for b in batches:
            gap = np.full(WINDOW, -1)
            parts = [x for t in b.column(0).to_pylist() if t for x in (word_buckets(t), gap)]
            if not parts:
                continue
            w = np.concatenate(parts)
            for lo in range(0, len(w), PART):  # sums in pieces of bounded size
                for step in range(1, WINDOW + 1):
                    x, y = w[lo:lo + PART], w[lo + step:lo + PART + step]
                    x = x[:len(y)]
                    both = (x >= 0) & (y >= 0)
                    x, y = x[both], y[both]
                    for k in range(NONZERO):
                        table += np.bincount(x * DIM + places[y, k], signs[y, k], BUCKETS * DIM)
                        table += np.bincount(y * DIM + places[x, k], signs[x, k], BUCKETS * DIM)
        blocks = table.astype("<i8").reshape(-1, BLOCK * DIM)
        used = np.nonzero(blocks.any(1))[0]
        salt = int(abs(blocks).sum()) % SALTS
        yield pa.RecordBatch.from_pydict({"block": pa.array(used.astype(np.int32)), "salt": pa.array([salt] * len(used), pa.int32()), "sums": pa.array([blocks[i].astype("<i4").tobytes() if abs(blocks[i]).max() < 1 << 31 else blocks[i].tobytes() for i in used], pa.binary())})

    def numbers(x):
        return np.frombuffer(x, "<i4" if len(x) == BLOCK * DIM * 4 else "<i8").astype(np.int64)

    def add(batches):
        total, at = None, None
        for b in batches:
            for block, salt, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if at is not None and at != (block, salt):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([at[0]], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})
                    total = None
                at = (block, salt)
                total = numbers(x.as_py()) if total is None else total + numbers(x.as_py())
        if at is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([at[0]], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, salt int, sums binary"
    sums = in_batches(docs.select("text")).mapInArrow(run, schema)
    for _ in range(2):
        sums = sums.repartition("block", "salt").sortWithinPartitions("block", "salt").mapInArrow(add, schema)
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIM))
    for r in sums.collect():  # BUCKETS rows of vectors, whatever the corpus
        table[r["block"]] += np.frombuffer(r["sums"], "<i8")
    table = table.reshape(BUCKETS, DIM)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    own = np.zeros((BUCKETS, DIM))
    np.put_along_axis(own, places, signs / np.sqrt(NONZERO), 1)
    return (table + own).astype(np.float32)


def pool(text: str, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread, length and distinct share of a document's word vectors."""
    w = word_buckets(text)
    out = np.zeros(2 * DIM + 2, np.float32)
    if len(w):
        count = np.bincount(w, minlength=BUCKETS)
        seen = np.nonzero(count)[0]
        share = (count[seen] / len(w)).astype(np.float32)
        v = vectors[seen]
        mean = share @ v
        out[:DIM], out[DIM:2 * DIM] = mean, np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        out[-2:] = np.log1p(len(w)), len(seen) / min(len(w), BUCKETS)
    return out


def document_features(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pool(t or "", vectors).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "features"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, features binary")


def _fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 80, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights by Adam on four fifths of the rows, temperature on the rest."""
    rng = np.random.default_rng(seed)
    if not len(x):
        x, y = np.zeros((1, 2 * DIM + 2)), np.full(1, 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    order = rng.permutation(len(z))
    rest = order[:len(z) // 5] if len(z) >= 20 else order
    fit = order[len(z) // 5:] if len(z) >= 20 else order
    p = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(rounds):
        for lo in range(0, len(fit), 256):
            i = fit[lo:lo + 256]
            h = np.tanh(z[i] @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-(h @ p["w2"] + p["b2"]))) - y[i]) / len(i)
            back = d[:, None] * p["w2"] * (1 - h * h)
            g = {"w2": h.T @ d, "b2": d.sum(keepdims=True), "w1": z[i].T @ back, "b1": back.sum(0)}
            t += 1
            for k in p:
                step = g[k] + (1e-4 * p[k] if k[0] == "w" else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * step, 0.999 * v[k] + 0.001 * step * step
                p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        fit = rng.permutation(fit)
    logits = np.tanh(z[rest] @ p["w1"] + p["b1"]) @ p["w2"] + p["b2"]
    heat = np.geomspace(0.25, 16, 97)
    loss = [np.mean(np.logaddexp(0, logits / q) - y[rest] * logits / q) for q in heat]
    return p | {"mean": mean, "scale": scale, "heat": np.array(heat[int(np.argmin(loss))])}


def predict(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    logits = np.tanh((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]
    return 1 / (1 + np.exp(-np.clip(logits / net["heat"], -30, 30)))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text)``."""
    features = keep(document_features(docs, gather_vectors(docs)))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality is not null and doc_id is not null").filter(_fold(F.col("doc_id")) != 1)
    total = known.count()
    if total > train_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * 0.97 * train_rows / total))
    # Rows that repeat a labelled id must not lift the bound.
    known = keep(features.join(known, "doc_id").select("doc_id", "features", "quality").distinct())
    total = known.count()
    if total > train_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", "features", "quality"), F.lit(1 << 30)) < int((1 << 30) * 0.97 * train_rows / total))
    rows = sorted((r["doc_id"], bytes(r["features"]), float(r["quality"])) for r in known.collect())
    net = train_network(np.array([np.frombuffer(f, np.float32) for _, f, _ in rows], float).reshape(len(rows), 2 * DIM + 2), np.array([q for _, _, q in rows]))

    def run(batches):
        for b in batches:
            x = np.array([np.frombuffer(f, np.float32) for f in b.column(1).to_pylist()], float).reshape(b.num_rows, 2 * DIM + 2)
            p = predict(net, x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = in_batches(features).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (_fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
