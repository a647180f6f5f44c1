"""Token ids of whole texts, and files of fixed-width bit-packed ids.

A block holds whole documents in ascending id order: a header, the document ids, the position of each document's
first id, and the ids at ``bits`` bits each (the fewest that hold the vocabulary). Eight ids take ``bits`` bytes, so any
document is found by arithmetic and unpacked by a few numpy operations. Blocks are rows of Parquet files that Spark
writes and commits, so a lost executor leaves no half-written file; ``shard`` and ``block`` give their order.

Null texts are empty (the end id alone); null ids come first; rows of one id are ordered by their text.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import in_batches

MAGIC = b"TFB1"
HEADER = struct.Struct("<4sBxxxIQ")
MARKS = ".,;:!?"
#: White space of ``str.split()`` that is none to the tokenizer, and the words of a text that holds some.
CONTROLS, WORDS = re.compile("[\x1c-\x1f]").search, re.compile(r"[\S\x1c-\x1f]+").findall
#: Ids in a block; a longer document is a block of its own.
BLOCK_IDS = 1 << 19


class WordEncoder:
    """Ids of a text by a ``tokenizers`` file, as little-endian unsigned 32-bit bytes.

    For tokenizers that drop white space and never join across it (``word_bpe_49k.json``), ids of a text are those of
    its words in turn. Words are encoded once and remembered, up to ``limit`` of them.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.wide = re.compile("[^\x00-ɏ]|<\\|").search

    def encode(self, text: str) -> bytes:
        # Latin letters have one lower case whatever stands around them; special tokens are matched before lower-casing.
        line = text if self.wide(text) else text.lower()
        parts = WORDS(line) if CONTROLS(line) else line.split()
        known = self.known
        try:
            return b"".join([known[w] for w in parts])
        except KeyError:
            new = [w for w in dict.fromkeys(parts) if w not in known]
            # A final mark is a token of its own; what stands before it is often known.
            own, rest = {}, []
            for w in new:
                if w[-1] in MARKS and w[-2:-1].isalpha() and (x := known.get(w[:-1])) and (y := known.get(w[-1])):
                    own[w] = x + y
                else:
                    rest.append(w)
            own |= self._learn(rest) if rest else {}
            return b"".join([known.get(w) or own[w] for w in parts])

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        line = " ".join(new)
        e = self.tokenizer.encode(line, add_special_tokens=False)
        at = np.cumsum([0] + [len(w) + 1 for w in new])
        first = np.fromiter((a for a, _ in e.offsets), np.int64, len(e.offsets))
        cut = np.searchsorted(first, at).tolist()
        raw = np.asarray(e.ids, "<u4").tobytes()
        own = {w: raw[4 * cut[i]:4 * cut[i + 1]] for i, w in enumerate(new)}
        for w, x in own.items():
            if len(self.known) >= self.limit:
                break
            if x and len(w) <= 64:
                self.known[w] = x
        return own


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker, as a worker serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, lowest bit first; padded with zeros to a multiple of eight ids."""
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(lanes), bits + 8), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = lanes[:, j] << np.uint64(shift)
        for k in range((shift + bits + 7) // 8):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out[:, :bits].tobytes()


def unpack_bits(data: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """``n`` ids from position ``start``, reading only the bytes that hold them."""
    lo, hi = start // 8, -(-(start + n) // 8)
    cols = np.frombuffer(data, np.uint8, (hi - lo) * bits, lo * bits).reshape(-1, bits)
    out = np.empty((hi - lo, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(8):
        byte, shift = divmod(j * bits, 8)
        value = np.zeros(hi - lo, np.uint64)
        for k in range(min((shift + bits + 7) // 8, bits - byte)):
            value |= cols[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[start - 8 * lo:start - 8 * lo + n]


def make_block(doc_ids: list, ids: list[bytes], bits: int) -> bytes:
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4")
    head = HEADER.pack(MAGIC, bits, len(ids), len(flat))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([head, known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes(), pack_bits(flat, bits)])


class Block:
    """Random access to one block's documents."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at, n = HEADER.size, self.n_docs
        known = np.frombuffer(data, np.uint8, n, at)
        ids = np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.starts = np.frombuffer(data, "<i8", n + 1, at + 9 * n)
        self.payload = memoryview(data)[at + 9 * n + 8 * (n + 1):]

    def ids(self, i: int) -> np.ndarray:
        a, b = int(self.starts[i]), int(self.starts[i + 1])
        return unpack_bits(self.payload, self.bits, a, b - a)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Write ``(doc_id, text)`` to ``path`` in ascending ``doc_id`` order."""
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    end = struct.pack("<I", end_id)

    def run(batches):
        enc, shard, block = encoder(tokenizer), TaskContext.get().partitionId(), 0
        bits, names, ids, size = bits_for(max(enc.vocabulary, end_id + 1)), [], [], 0

        def flush():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                                               "n_ids": pa.array([size], pa.int64()), "data": pa.array([make_block(names, ids, bits)], pa.binary())})

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = enc.encode(t) + end
                if names and size + len(x) // 4 > block_ids:
                    yield flush()
                    block, names, ids, size = block + 1, [], [], 0
                names.append(d)
                ids.append(x)
                size += len(x) // 4
        if names:
            yield flush()

    in_batches(rows).mapInArrow(run, "shard int, block int, n_ids long, data binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, unpacked from the files."""
    blocks = spark.read.parquet(path)

    def run(batches):
        for b in batches:
            for shard, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = Block(data.as_py())
                flat = unpack_bits(x.payload, x.bits, 0, x.n_ids).astype("<u4")
                cuts = x.starts.tolist()
                crc = [zlib.crc32(flat[p:q]) for p, q in zip(cuts, cuts[1:])]
                n = x.n_docs
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * n, pa.int32()), "block": pa.array([block] * n, pa.int32()), "doc_id": pa.array(x.doc_ids, pa.int64()),
                                                  "at": pa.array(cuts[:-1], pa.int64()), "n_tokens": pa.array(np.diff(x.starts), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = in_batches(blocks).select("shard", "block", "data").mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    inside = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b0"))
    # One row per shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    places = inside.join(shards, "shard")
    return docs.join(places, ["shard", "block"]).select("doc_id", (F.col("s0") + F.col("b0") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
