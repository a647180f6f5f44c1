"""SimHash near-duplicates by vantage-point trees.

Fingerprints of 64 bits are linked when at most three bits differ. Two such fingerprints differ by at most one bit in
their low or in their high half, so there is a tree over each half, with that bound of one. A tree's upper levels come
from a bounded sample: a vantage point and a radius per node. A fingerprint has its home in one shard (inside the radius
or outside) and is also sent to every shard that the triangle bound cannot rule out; each shard goes on dividing its own
fingerprints in the same way and compares what is left exactly. A shard gives links to one member of each of its
connected groups, never all pairs. The sample decides the balance only; every link is found.

Similarity of 0.8 on shingles moves some 15 % of the bits, which no tree searches in a time that grows with the rows, so
``SIMILAR`` finds candidates by equality: the shingle set has ``BANDS`` keys, each of the least hashes of the set under ``ROWS``
functions, and two sets of similarity s share one with a chance of 1 - (1 - s**ROWS)**BANDS (0.9995 at 0.8). Only keys and
ids are shuffled for it. Pairs that meet are compared by fingerprints of ``512`` bits (the farthest of 3,600 simulated pairs of
0.80 to 0.82 stood at 106, the limit is 128) and confirmed by the similarity of their shingle sets: each set with the nearest first
of its keys, then with the other firsts it is not joined to yet, and last, where a key holds sets of several components,
the sets outside its largest component with all others. No pair is left out and no group is expanded into all its pairs.

Copies share a fingerprint (of ``SIMILAR``: a shingle set) and are compared once. Null texts have no words: fingerprint
zero, linked like any other; no words are similar to no words only. Rows without an id are told apart by their texts; an
empty table gives an empty one; other columns pass through ``keep_one_of_each`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import mix
from .shared import components, in_batches, keep, row_key

BITS = 64
#: Fingerprints with their home in one shard, about; sampled fingerprints per shard; pairs compared at once.
SHARD, SAMPLE_PER_SHARD, PAIRS_AT_ONCE = 4096, 64, 1 << 18
#: The sample never exceeds this many fingerprints (16 MB on the driver).
SAMPLE = 1 << 19
#: Shingle sets, and their shingles, of a block whose pairs are compared in one task, about.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Least hashes of a key, and keys of a shingle set.
ROWS, BANDS = 7, 32
#: Fingerprints of a leaf in one task, about; a leaf of more is compared in pairs of blocks.
LEAF = 1 << 16


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, 64-bit words of a fingerprint, differing bits of a link, and the parts (word, mask) that trees stand over.

    With ``least``, a fraction, fingerprints are of distinct shingles, there are no trees and links need that similarity of the two shingle sets.
    """

    shingle: int
    words: int
    most: int
    parts: tuple[tuple[int, int], ...]
    reach: int = 1
    shard: int = SHARD
    least: tuple[int, int] | None = None

    @property
    def names(self) -> list[str]:
        return [f"f{i}" for i in range(self.words)]


CLOSE = Scheme(3, 1, 3, tuple((0, 0xFFFFFFFF << s) for s in (0, 32)))
SIMILAR = Scheme(5, 8, 128, (), least=(4, 5))
_MULTIPLY, _ADD = (mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(k)) | np.uint64(1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def shingles(text: str, n: int) -> np.ndarray:
    """Hashes of the shingles of ``n`` words in turn; a shorter text is one shingle."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    view = memoryview(line)
    ends = ends[min(n, len(parts)) - 1:]
    return np.array([digest(view[a:b], 42) for a, b in zip(starts, ends)], np.uint64)


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is one if it is set in over half of the hashes of the shingles; words beyond the first take hashes of the hashes."""
    count = np.zeros(BITS * words, np.int64)
    for lo in range(0, len(hashes), 1 << 13):
        h = hashes[lo:lo + (1 << 13)].astype("<u8")
        h = np.stack([h, *(mix(h + np.uint64(k)) for k in range(1, words))], axis=1)
        count += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of a shingle set; each stands for its place among the keys too."""
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for lo in range(0, len(hashes), 1 << 12):
        np.minimum(least, (mix(hashes[lo:lo + (1 << 12)])[:, None] * _MULTIPLY + _ADD).min(0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs["text"]).alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``doc_id, key, id, f0, …`` (64 bits each, as signed longs) of every whole text; rows of one ``id`` need no comparison.

    With ``scheme.least`` also ``size, bands`` of the shingle set.
    """
    fields = ["doc_id long", "key long", "id long", *(f"{c} long" for c in scheme.names), *(["size long", "bands array<long>"] if scheme.least else [])]

    def run(batches):
        for b in batches:
            n = b.num_rows
            fp, ids, sizes, bands = np.zeros((n, scheme.words), np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros((n, BANDS), np.uint64)
            for i, text in enumerate(b.column(2).to_pylist()):
                h = shingles(text, scheme.shingle)
                h = np.unique(h) if scheme.least else h
                fp[i] = majority(h, scheme.words)
                ids[i] = xxhash.xxh3_64_intdigest(h.tobytes()) if scheme.least else fp[i, 0]
                if scheme.least:
                    sizes[i], bands[i] = len(h), band_keys(h)
            fp = fp.view(np.int64)
            columns = [b.column(0), b.column(1), pa.array(ids.view(np.int64)), *(pa.array(fp[:, i].copy()) for i in range(scheme.words))]
            if scheme.least:
                columns += [pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in fields])

    return in_batches(_texts(docs)).mapInArrow(run, ", ".join(fields))


def build_tree(sample: np.ndarray, half: np.uint64, depth: int, seed: int) -> list[tuple[int, int]]:
    """Vantage point and radius of each inner node of a full binary tree, in heap order."""
    rng = np.random.default_rng(seed)
    nodes, parts = [], [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            if len(part):
                # Of a few points, the one whose distances spread most gives the sharpest cut.
                tries = part[rng.integers(0, len(part), 4)]
                d = max((np.bitwise_count((part ^ v) & half).astype(np.int64) for v in tries), key=lambda x: x.std())
                v = next(v for v in tries if np.array_equal(np.bitwise_count((part ^ v) & half).astype(np.int64), d))
                mu = int(np.median(d)) if d.max() > np.median(d) else int(d.max()) - 1
            else:
                v, mu, d = np.uint64(rng.integers(0, 1 << 63)), 16, np.zeros(0, np.int64)
            nodes.append((int(v), mu))
            below += [part[d <= mu], part[d > mu]]
        parts = below
    return nodes


def route(fp: np.ndarray, nodes: list[tuple[int, int]], half: np.uint64, depth: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, leaf, own)`` for each leaf that a fingerprint lives in or may have a partner in."""
    row, at, own = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool)
    vantage, radius = np.array([v for v, _ in nodes] or [0], np.uint64), np.array([r for _, r in nodes] or [0])
    for level in range(depth):
        node = (1 << level) - 1 + at
        d = np.bitwise_count((fp[row] ^ vantage[node]) & half).astype(np.int64)
        inside = d <= radius[node]
        left, right = inside | (d - reach <= radius[node]), ~inside | (d + reach > radius[node])
        row, at, own = (np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1]),
                        np.concatenate([(own & inside)[left], (own & ~inside)[right]]))
    return row, at, own


class Groups:
    """Connected groups of numbers 0..n-1, linked in blocks of numpy arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            low = np.minimum(ra, rb)
            if np.array_equal(ra, rb):
                return
            np.minimum.at(root, ra, low)
            np.minimum.at(root, rb, low)
            while not np.array_equal(up := root[root], root):
                root[:] = up


def search(own: np.ndarray, every: np.ndarray, fp: np.ndarray, part: tuple[int, int], reach: int, most: int, groups: Groups, rng: np.random.Generator) -> None:
    """Link the pairs of ``own`` and ``every`` (rows of ``fp``) that the part's triangle bound leaves and that differ in at most ``most`` bits."""
    word, mask = fp[:, part[0]], np.uint64(part[1])
    todo = [(own, every, 0)]
    while todo:
        own, every, tries = todo.pop()
        if not len(own) or not len(every):
            continue
        if len(own) > 32 and len(own) * len(every) > 1 << 15 and tries < 3:
            v = word[own[rng.integers(len(own))]]
            d, e = (np.bitwise_count((word[x] ^ v) & mask).astype(np.int64) for x in (own, every))
            mu = int(np.median(d))
            mu = mu if d.max() > mu else mu - 1
            if (d <= mu).any() and (d > mu).any():
                todo += [(own[d <= mu], every[e - reach <= mu], 0), (own[d > mu], every[e + reach > mu], 0)]
            else:
                todo.append((own, every, tries + 1))
            continue
        step = max(1, PAIRS_AT_ONCE // len(every))
        for lo in range(0, len(own), step):
            # Most pairs go by the part alone.
            i, j = np.nonzero(np.bitwise_count((word[own[lo:lo + step], None] ^ word[None, every]) & mask) <= reach + 1)
            i, j = own[lo + i], every[j]
            near = np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= most
            groups.link(i[near], j[near])


def fingerprint_links(found: DataFrame, scheme: Scheme) -> DataFrame:
    """``(a, b)`` links that join each connected group of the distinct fingerprints ``found (id, f0, …)``, a stored table."""
    n, parts, names, reach, most = found.count(), scheme.parts, scheme.names, scheme.reach, scheme.most
    depth = max(0, int(np.ceil(np.log2(max(1, n / scheme.shard)))))
    bound = min(SAMPLE, SAMPLE_PER_SHARD << depth)
    sample = np.array([tuple(r) for r in found.select(*names).orderBy(F.xxhash64("id")).limit(bound).collect()], np.int64).reshape(-1, len(names)).view(np.uint64)
    trees = [build_tree(sample[:, w], np.uint64(m), depth, k) for k, (w, m) in enumerate(parts)]

    def routed(b: pa.RecordBatch):
        """``(row, leaf, own)`` by part; leaves of all parts have numbers of their own."""
        for k, (w, m) in enumerate(parts):
            row, leaf, own = route(b.column(w + 1).to_numpy().view(np.uint64), trees[k], np.uint64(m), depth, reach)
            yield row, leaf * len(parts) + k, own

    def count(batches):
        for b in batches:
            leaf, size = np.unique(np.concatenate([x[1] for x in routed(b)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(size)], names=["leaf", "size"])

    columns = ", ".join(f"{c} long" for c in ("id", *names))
    source = found.select("id", *names)
    sizes = in_batches(source).mapInArrow(count, "leaf long, size long").groupBy("leaf").agg(F.sum("size").alias("size"))
    # Some thousand rows at most, as a leaf is large.
    large = {r["leaf"]: -(-r["size"] // LEAF) for r in sizes.filter(F.col("size") > LEAF).collect()}

    def send(batches):
        for b in batches:
            part = mix(b.column(0).to_numpy().view(np.uint64))
            for row, leaf, own in routed(b):
                blocks = np.array([large.get(x, 1) for x in leaf.tolist()], np.int64)
                mine = (part[row] % blocks.astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine, rows = mine[at], pa.array(row[at])
                yield pa.RecordBatch.from_arrays([*map(pa.array, (leaf[at], np.minimum(mine, other), np.maximum(mine, other), mine <= other, own[at])), *(b.column(i).take(rows) for i in range(len(names) + 1))],
                                                 names=["leaf", "lo", "hi", "low", "own", "id", *names])

    def compare(key, table):
        """A leaf, or a pair of blocks of one."""
        table = table.sort_by("id")  # the same links whatever the order of arrival
        leaf, lo, hi = (k.as_py() for k in key)
        ids = table.column("id").to_numpy()
        fp = np.stack([table.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
        own, low = (table.column(c).to_numpy(zero_copy_only=False) for c in ("own", "low"))
        groups, rng = Groups(len(fp)), np.random.default_rng(leaf)
        sides = [(own, np.ones(len(fp), bool))] if lo == hi else [(own & low, ~low), (own & ~low, low)]
        for a, b in sides:
            search(np.nonzero(a)[0], np.nonzero(b)[0], fp, parts[leaf % len(parts)], reach, most, groups, rng)
        at = np.nonzero(groups.root != np.arange(len(fp)))[0]
        return pa.table({"a": pa.array(ids[at]), "b": pa.array(ids[groups.root[at]])})

    sent = in_batches(source).mapInArrow(send, f"leaf long, lo long, hi long, low boolean, own boolean, {columns}")
    return sent.groupBy("leaf", "lo", "hi").applyInArrow(compare, "a long, b long")


def similar_pairs(own: np.ndarray, sets: list[np.ndarray], least: tuple[int, int], groups: Groups) -> None:
    """Link ``sets`` (sorted, distinct) whose similarity is ``least`` or more: those of a true ``own`` with all others."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    member = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    top, bottom = least
    for i in np.nonzero(own)[0]:
        open_ = groups.root != groups.root[i]
        open_ &= bottom * np.minimum(sizes, sizes[i]) >= top * np.maximum(sizes, sizes[i])
        j = np.nonzero(open_)[0]
        if not len(j):
            continue
        mine = codes[ends[i] - sizes[i]:ends[i]]
        member[mine] = True
        if 2 * len(j) < len(sets):
            both = np.array([np.count_nonzero(member[codes[ends[k] - sizes[k]:ends[k]]]) for k in j.tolist()], np.int64)
        else:
            sums = np.concatenate([[0], np.cumsum(member[codes])])
            both = sums[ends[j]] - sums[ends[j] - sizes[j]]
        member[mine] = False
        j = j[bottom * both >= top * (sizes[i] + sizes[j] - both)]
        groups.link(np.full(len(j), i), j)


def _apart(names: list[str], a: str, b: str) -> F.Column:
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in names[1:]), F.bit_count(F.col(f"{a}.{names[0]}").bitwiseXOR(F.col(f"{b}.{names[0]}"))))


def key_members(groups: DataFrame) -> DataFrame:
    """``band, first, id`` of the keys that several ids of ``groups (id, bands)`` share; keys of the same ids count once."""
    held = groups.select("id", F.explode("bands").alias("band"))
    shared = held.groupBy("band").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    members = keep(held.join(shared.select("band", "first"), "band"))
    same = members.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = same.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
    return keep(members.join(one, "band").select("band", "first", "id"))


def shingle_sets(docs: DataFrame, rows: DataFrame, scheme: Scheme) -> DataFrame:
    """``id, shingles`` (sorted 64-bit hashes, as bytes) of ``rows (id, row)``, read from the text of one of its rows."""
    wanted = rows.select("id", F.col("row.doc_id").alias("_doc"), F.col("row.key").alias("_key"))
    texts = _texts(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("id", "text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingles(t, scheme.shingle)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])

    found = in_batches(texts).mapInArrow(run, "id long, shingles binary")
    return keep(found.groupBy("id").agg(F.first("shingles").alias("shingles")))  # rows may be repeated


def confirmed(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs (a, b)`` whose ``sets`` have the similarity: the set of ``a`` passes by all its partners, in parts."""
    top, bottom = least
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    right = pairs.join(parts, "a").join(sets, pairs["b"] == sets["id"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "shingles")
    left = parts.join(sets, parts["a"] == sets["id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    rows = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches):
        at, mine = None, None
        for batch in batches:
            out = []
            for a, part, b, s in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = np.frombuffer(s, np.uint64)
                if b is None:
                    at, mine = (a, part), s
                    continue
                assert at == (a, part)
                both = len(np.intersect1d(mine, s, assume_unique=True)) if bottom * min(len(s), len(mine)) >= top * max(len(s), len(mine)) else 0
                if bottom * both >= top * (len(s) + len(mine) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    return in_batches(rows).mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members (band, id, root)`` of keys with several roots, under pairs of blocks: those outside a key's largest root beside all."""
    rows = members.join(groups.select("id", "size"), "id")
    of = rows.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    largest = F.max_by("root", F.struct("n", "root"))
    keys = of.groupBy("band").agg(largest.alias("largest"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("n").alias("most"), F.max_by("size", F.struct("n", "root")).alias("most_size")).filter("most < n")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES), F.lit(1)).cast("int")
    keys = keys.select("band", "largest", blocks(F.col("n"), F.col("size")).alias("all"), blocks(F.col("n") - F.col("most"), F.col("size") - F.col("most_size")).alias("few"))
    rows = rows.select("band", "id", "root").join(keys, "band")
    own = rows.filter("root <> largest").withColumns({"lo": F.pmod(F.xxhash64("id"), F.col("few")).cast("int"), "hi": F.explode(F.sequence(F.lit(0), F.col("all") - 1)), "own": F.lit(True)})
    other = rows.withColumns({"hi": F.pmod(F.xxhash64("id"), F.col("all")).cast("int"), "lo": F.explode(F.sequence(F.lit(0), F.col("few") - 1)), "own": F.lit(False)})
    names = ["band", "lo", "hi", "own", "id", "root"]
    return own.select(*names).union(other.select(*names))


def _near_ones(scheme: Scheme):
    """Of a pair of blocks, the rows with a partner of another root and few enough differing bits."""
    top, bottom = scheme.least

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy(zero_copy_only=False)
        root, size = table.column("root").to_numpy(), table.column("size").to_numpy()
        fp = np.stack([table.column(c).to_numpy() for c in scheme.names], axis=1).view(np.uint64)
        a, b = np.nonzero(own)[0], np.nonzero(~own)[0]
        hit = np.zeros(len(own), bool)
        step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
        for lo in range(0, len(a), step):
            x = a[lo:lo + step]
            near = (root[x][:, None] != root[b]) & (bottom * np.minimum(size[x][:, None], size[b]) >= top * np.maximum(size[x][:, None], size[b]))
            i, j = np.nonzero(near)
            far = np.bitwise_count(fp[x[i]] ^ fp[b[j]]).sum(1, dtype=np.int64) > scheme.most
            near[i[far], j[far]] = False
            hit[x] |= near.any(1)
            hit[b] |= near.any(0)
        return table.filter(pa.array(hit)).select(["band", "lo", "hi", "own", "id", "root"])

    return run


def _block_links(scheme: Scheme):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("own", "descending"), ("id", "ascending")])
        ids, root = table.column("id").to_numpy(), table.column("root").to_numpy()
        # What is joined already, a row on both sides included, is one group from the start.
        first = np.unique(root, return_index=True, return_inverse=True)
        groups = Groups(len(ids))
        groups.link(np.arange(len(ids)), first[1][first[2]])
        before = groups.root.copy()
        similar_pairs(table.column("own").to_numpy(zero_copy_only=False), [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()], scheme.least, groups)
        at = np.nonzero(groups.root != before)[0]
        return pa.table({"a": pa.array(root[at]), "b": pa.array(root[groups.root[at]])})

    return run


def similar_roots(docs: DataFrame, groups: DataFrame, scheme: Scheme) -> DataFrame:
    """``id, root`` of the shingle sets ``groups (id, f0, …, size, bands, row)`` that are linked to others."""
    members = key_members(groups)
    sets = shingle_sets(docs, groups.join(members.select("id").distinct(), "id"), scheme)
    prints = groups.select("id", F.struct(*scheme.names).alias("f"))
    pairs = members.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    pairs = pairs.join(prints.toDF("a", "fa"), "a").join(prints.toDF("b", "fb"), "b").withColumn("bits", _apart(scheme.names, "fa", "fb"))
    pairs = keep(pairs.filter(F.col("bits") <= scheme.most).select("a", "b", "bits"))

    nearest = pairs.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b")
    links = keep(confirmed(nearest, sets, scheme.least))
    roots = keep(components(links))
    ra, rb = (roots.select(F.col("id").alias(c), F.col("root").alias("r" + c)) for c in "ab")
    open_ = pairs.join(ra, "a", "left").join(rb, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    links = keep(links.union(confirmed(open_, sets, scheme.least)))

    roots = keep(components(links))
    members = members.join(roots, "id", "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    dealt = _in_blocks(members, groups).join(groups.select("id", "size", *scheme.names), "id").repartition("band", "lo", "hi")
    near = dealt.groupBy("band", "lo", "hi").applyInArrow(_near_ones(scheme), "band long, lo int, hi int, own boolean, id long, root long")
    left = keep(near).join(sets, "id").repartition("band", "lo", "hi").groupBy("band", "lo", "hi").applyInArrow(_block_links(scheme), "a long, b long")
    joined = keep(left)
    return components(links.union(joined)) if not joined.isEmpty() else roots


def _components(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of every row, and ``id, root, row`` of every ``id``: its component and its first ``(no_id, doc_id, key)``."""
    prints = keep(fingerprints(docs, scheme))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    if scheme.least:
        groups = keep(prints.groupBy("id", "size", *scheme.names).agg(F.min(row).alias("row"), F.any_value("bands").alias("bands")))
        roots = similar_roots(docs, groups, scheme)
    else:
        groups = keep(prints.groupBy("id", *scheme.names).agg(F.min(row).alias("row")))
        roots = components(fingerprint_links(groups, scheme))
    return prints, keep(groups.select("id", "row").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))


def simhash_components(docs: DataFrame, scheme: Scheme = CLOSE) -> DataFrame:
    """``doc_id, f0, …, component_id`` for every row."""
    prints, linked = _components(docs, scheme)
    lowest = linked.groupBy("root").agg(F.min("row.doc_id").alias("component_id"))
    names = linked.join(lowest, "root").select("id", "component_id")
    return prints.join(names, "id").select("doc_id", *scheme.names, "component_id")


def _joined(docs: DataFrame, scheme: Scheme, trees: Scheme) -> DataFrame:
    """``root, row`` of the groups of ``scheme``, those that links of ``trees`` connect under one root."""
    prints, linked = _components(docs, scheme)
    close, met = _components(docs, trees)
    of = lambda p, c, root: p.join(c.select("id", F.col("root").alias(root)), "id").select("doc_id", "key", root).distinct()
    a, b = of(prints, linked, "root"), of(close, met, "tree").toDF("_doc", "_key", "tree")
    both = keep(a.join(b, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key"))).select("root", "tree").distinct())
    first = both.groupBy("tree").agg(F.min("root").alias("a"))
    tops = components(both.join(first, "tree").select("a", F.col("root").alias("b")))
    tops = tops.select(F.col("id").alias("root"), F.col("root").alias("top"))
    return linked.join(tops, "root", "left").select(F.coalesce("top", "root").alias("root"), "row")


def keep_one_of_each(docs: DataFrame, scheme: Scheme = SIMILAR, trees: Scheme | None = None) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the smallest ``doc_id`` and ``row_key``, nulls last.

    Of rows that repeat both, the one with the smallest hash of all columns stays. ``trees`` is a second scheme whose links
    connect rows too.
    """
    linked = _joined(docs, scheme, trees) if trees else _components(docs, scheme)[1]
    first = keep(linked.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.doc_id").alias("id"), F.col("row.key").alias("key")))
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc"), row_key(docs["text"]).alias("text_key"))
    rows = whole.join(first, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).select("id", "key", "row")
    return rows.groupBy("id", "key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
