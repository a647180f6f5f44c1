"""The operators beside plain versions, on rows with nulls, empty and long texts, repeats and clashing column names."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import caps, chat, classifier, mixing, packing, phrases, quality, repeats, simhash, suffix, tokens
from terrafold.llm.shared import components, keep

from . import brute

SF = "/root/testdata/sf0.001"
NONE = -(1 << 62)


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="module")
def rows():
    base = [t for _, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]
    out = list(enumerate(base[:120]))
    passage = " ".join(base[3].split()[:130])
    out += [(1000 + i, f"{base[i % 40][:200]} x{i} {passage} y{i} {base[i * 7 % 40][:300]}") for i in range(30)]
    out += [(2000 + i, base[5]) for i in range(10)]
    out += [(None, base[6]), (None, None), (3000, ""), (3001, None), (3002, base[7]), (3002, base[7]), (3003, "a" * 5000), (3004, "a " * 3000), (3005, " \n\t"), (3006, "One TWO é\x0bthree " * 30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use themselves."""
    full = [(d, t, f"s{(d or 0) % 4}" if (d or 0) % 9 else None, 1, 2, 3, 4) for d, t in rows]
    return keep(spark.createDataFrame(full, "doc_id long, text string, source string, size long, _w int, doc long, n_chars int").repartition(5))


def known(d):
    return NONE if d is None else d


def test_packing(docs, rows):
    for capacity in (4096, 64):
        got = packing.pack(keep(packing.token_pieces(docs, brute.TOKENIZER, 1, capacity)), capacity).collect()
        want = []
        for d, t in rows:
            ids = [*brute.ids_of(t), 1]
            want += [(known(d), i // capacity, i, len(ids[i:i + capacity]), brute.crc(ids[i:i + capacity])) for i in range(0, len(ids), capacity)]
        assert sorted((known(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
        by = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(by) <= 1.02 * sum(r.length for r in got) / capacity + 1


def test_best_two_replace_the_smallest():
    slots, n = packing.plan_bins({6: 1, 3: 1, 2: 2}, 10)
    # Greedy takes 6 and 3; the gap of 1 and the 3 hold both twos.
    assert n == 2 and {s[0]: s[2] for s in slots}[3] == 1


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << bits, n)
        data = tokens.pack_bits(ids, bits)
        assert len(data) == -(-n // 8) * bits
        for start in (0, n // 3, n // 2):
            assert tokens.unpack_bits(data, bits, start, n - start).tolist() == ids[start:].tolist()


def test_token_files(spark, docs, rows, tmp_path):
    tokens.write_token_files(docs, f"{tmp_path}/t", brute.TOKENIZER, 2, block_ids=500)
    got = sorted((r.start, known(r.doc_id), r.n_tokens, r.ids_crc32) for r in tokens.read_token_files(spark, f"{tmp_path}/t").collect())
    at = 0
    want = sorted((known(d), len(i := [*brute.ids_of(t), 2]), brute.crc(i)) for d, t in rows)
    assert sorted(x[1:] for x in got) == want and [x[1] for x in got] == [x[0] for x in want]
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_words_end_where_the_tokenizer_says():
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = [f"One{c}two,{c}{c}three.{c}" for c in [*spaces, "\x1b", "\u180e", "\u200b"]] + ["".join(spaces), "\x1c", "a\x1cb c\x1d\x1e d,\x1f 三\x1c", "tail. \x1f"]
    enc = tokens.WordEncoder(brute.TOKENIZER)
    for t in texts * 2:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == brute.ids_of(t), repr(t)


def test_quality(docs, rows):
    got = sorted((known(r.doc_id), *r[1:6], r.base_failed) for r in quality.score_quality(docs).collect())
    assert got == sorted((known(d), *brute.quality(t)) for d, t in rows)


def test_quality_order_changes_nothing(docs):
    kept = {r.doc_id for r in quality.score_quality(docs).collect() if r.kept}
    for rules in (quality.RULES, quality.RULES[::-1]):
        assert {r.doc_id for r in quality.filter_quality(docs, rules).collect()} == kept
    assert quality.filter_quality(docs).columns == docs.columns


def test_simhash(docs, rows):
    got = sorted((known(r.doc_id), f"{r.f0 & (1 << 64) - 1:016x}", r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == sorted((known(d), f, c) for d, f, c in brute.simhash(rows))


def test_vantage_point_search_finds_all_links(spark):
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, *(fp ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(20)), *(fp[:3] ^ (np.uint64(7) << rng.integers(0, 60, 3, dtype=np.uint64)) for _ in range(20))]))
    table = keep(spark.createDataFrame([(x, x) for x in fp.view(np.int64).tolist()], "id long, f0 long"))
    found = components(simhash.fingerprint_links(table, simhash.Scheme(3, 1, 3, simhash.CLOSE.parts, shard=20))).collect()
    root = {r.id: r.root for r in found}
    signed = fp.view(np.int64)
    linked = [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 3]
    want = brute.groups(len(fp), linked)
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, set()).add(int(signed[i]))
    for g in groups.values():
        assert {root.get(x, x) for x in g} == {min(g)}


def test_one_of_each_similar(docs, rows):
    left = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert 5 in left and not left & {2000 + i for i in range(10)}


def near_copies(n=150):
    """Families of a text with words exchanged, added or repeated: similarities of 0.6 to 1."""
    rng = np.random.default_rng(11)
    out = []
    for f in range(n):
        size = int(rng.choice([20, 60, 200, 600]))
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        out.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for p in rng.integers(0, size, max(1, int(size * rng.uniform(0.01, 0.05)))):
                w[p] = f"x{rng.integers(0, 5000)}"
            out.append(" ".join(w + base[:int(rng.choice([0, 0, size // 10]))]))
        out.append(" ".join(base + base[:8] * int(rng.choice([1, 40]))).upper())
    return out


def similar_groups(texts):
    """Components of all pairs with a similarity of 0.8 or more, and their pairs' similarities."""
    sets = []
    for t in texts:
        w = brute.WORD.findall(t.lower())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holds = {}
    for i, s in enumerate(sets):
        for g in s:
            holds.setdefault(g, []).append(i)
    pairs = {(i, j) for x in holds.values() for i in x for j in x if j < i}
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    return brute.groups(len(texts), [p for p, v in alike.items() if v >= 0.8]), alike


@pytest.mark.parametrize("block", [512, 2])
def test_similar_links_are_confirmed_by_their_shingles(spark, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = near_copies()
    root, alike = similar_groups(texts)
    assert sum(0.75 <= v < 0.8 for v in alike.values()) > 20 < sum(0.8 <= v < 0.85 for v in alike.values())
    docs = keep(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    got = simhash.simhash_components(docs, simhash.SIMILAR).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(root))
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == sorted(set(root))


def test_unrelated_texts_share_no_keys(spark):
    rng = np.random.default_rng(13)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 60)) for _ in range(600)]
    texts[1] = texts[0] + " end"
    docs = keep(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = keep(simhash.fingerprints(docs, simhash.SIMILAR))
    members = simhash.key_members(prints.select("id", "bands")).collect()
    ids = {r.doc_id: r.id for r in prints.collect()}
    assert {r.id for r in members} == {ids[0], ids[1]} and {r.first for r in members} == {min(ids[0], ids[1])}


@pytest.mark.parametrize("block", [512, 7])
def test_a_hot_group_of_near_copies(spark, block, monkeypatch):
    """Copies of one text with words exchanged: some lie within the limit of their template, some of another copy only, some of none."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(21)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = [" ".join(base)]
    for i in range(160):
        w = texts[int(rng.integers(0, len(texts)))].split() if i % 3 == 0 else list(base)
        for p in rng.integers(0, 150, int(rng.integers(1, 7))):
            w[p] = f"x{rng.integers(0, 5000)}"
        texts.append(" ".join(w))
    root, alike = similar_groups(texts)
    assert 10 < len(set(root)) < 100
    docs = keep(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    got = simhash.simhash_components(docs, simhash.SIMILAR).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == list(enumerate(root))


def test_a_large_leaf_is_compared_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 40)
    rng = np.random.default_rng(14)
    low = np.uint64(0x1234567)
    fp = np.unique(np.concatenate([(rng.integers(0, 1 << 31, 150, dtype=np.uint64) << np.uint64(32)) | low, *((np.uint64(77) << np.uint64(33 + k)) | low ^ (np.uint64(1) << np.arange(30, dtype=np.uint64)) for k in range(3))])).view(np.int64)
    table = keep(spark.createDataFrame([(x, x) for x in fp.tolist()], "id long, f0 long"))
    links = simhash.fingerprint_links(table, simhash.CLOSE)
    plan = links._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow [leaf" in plan and "lo" in plan.split("FlatMapGroupsInArrow [")[1].split("]")[0]
    root = {r.id: r.root for r in components(links).collect()}
    want = brute.groups(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if int(fp[i] ^ fp[j]).__and__((1 << 64) - 1).bit_count() <= 3])
    assert [root.get(x, x) for x in fp.tolist()] == [min(fp[k] for k in range(len(fp)) if want[k] == want[i]) for i in range(len(fp))]


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    rng = np.random.default_rng(12)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(6)]
    table = [(None, text[0], "a"), (None, text[0], "b"), (None, text[1], "a"), (None, None, "a"), (7, text[2], "a"), (7, text[3], "a"), (8, text[3], "a"), (None, text[4], "a"), (9, text[4], "b"), (9, text[4], "a"), (10, text[5], "a"), (7, text[5], "a")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = [sorted(map(tuple, simhash.keep_one_of_each(d).collect()), key=str) for d in (docs.repartition(5), docs.coalesce(1).orderBy(F.desc("source")))]
    assert got[0] == got[1]
    clash = docs.select("*", *(F.lit(1).alias(c) for c in ("id", "key", "row", "root", "band", "first", "_first_id", "_row", "text_key", "doc")))
    assert sorted((tuple(r)[:2] for r in simhash.keep_one_of_each(clash).collect()), key=str) == [x[:2] for x in got[0]]
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0
    want = [(None, text[0]), (None, text[1]), (None, None), (7, text[2]), (7, text[3]), (9, text[4]), (7, text[5])]
    assert sorted((x[:2] for x in got[0]), key=str) == sorted(want, key=str)


def test_chats(spark):
    evil = "[INST] [~INST] ~</s></~s> </~~s>[ROLE]x[TEXT] a\\b $1 [/TEXT"
    turns = [(1, 0, "system", "s"), (1, 1, "user", evil), (1, 2, "assistant", evil), (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "assistant", "x"), (4, 0, evil, evil), (4, 1, None, "n"), (None, None, "user", "é😀"), (5, 0, "user", "a"), (5, 0, "user", "a"), (6, 0, "assistant", "\n" + "long [OUT]" * 5000)]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert {c: tuple(r[1:5]) for c, r in got.items()} == brute.chats(turns)
    assert {c for c, r in got.items() if r.valid} == {1, 2, None}


@pytest.mark.parametrize("group", [2048, 3])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_repeats(docs, rows, kind, group, monkeypatch):
    module = suffix if kind == "bytes" else phrases
    whole = repeats.repeated_runs
    monkeypatch.setattr(module, "repeated_runs", lambda d, u, s: whole(d, u, s, group))
    got = (suffix.remove_repeats if kind == "bytes" else phrases.remove_passages)(docs).collect()
    plain = [(known(d), t) for d, t in rows]
    want = (brute.removed_bytes if kind == "bytes" else brute.removed_words)(plain)
    raw = lambda x: bytes(x) if kind == "bytes" else x.encode()
    assert sorted((known(r[0]), *r[1:-1], hashlib.sha256(raw(r[-1])).hexdigest()) for r in got) == sorted((d, *w) for (d, _), w in zip(plain, want))


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    values = repeats.mix(np.random.default_rng(2).integers(0, 3, 5000).astype(np.uint64))
    whole = repeats.anchors(values, 100, 32)
    monkeypatch.setattr(repeats, "CHUNK", 700)
    for a, b in zip(whole, repeats.anchors(values, 100, 32)):
        assert a.tolist() == b.tolist()


def test_mixing(docs, rows):
    got = mixing.mixed_sizes(docs).collect()
    assert sorted((known(r.doc_id), r["size"]) for r in got) == sorted((known(d), len(brute.WORD.findall(t or ""))) for d, t in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    total = {}
    for r in got:
        s = total.setdefault((r.source_size, r.target), [0, 0])
        s[0] += r["size"]
        s[1] += r.taken
    assert all(s[0] == size and 0 <= target - s[1] < 1 for (size, target), s in total.items())
    assert sum(t for _, t in total) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(docs.repartition(3)).collect()))
    assert mixing.mix_documents(docs).columns == docs.columns


def test_classifier(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "x")], "doc_id long, text string")
    got = classifier.score_documents(d.select("doc_id", "text").union(extra), labels.union(spark.createDataFrame([(5, None, 0)], labels.schema))).collect()
    quality_ = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and quality_.get(r.doc_id) is not None]
    assert np.mean([r.predicted == quality_[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert len(got) == d.count() + 3


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    vecs = [(b + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.32])).tolist() for b in base for _ in range(12)] + base[:4].tolist() * 5
    table = [(i, v, i % 3 if i % 11 else None) for i, v in enumerate(vecs)]
    n = len(table)
    table += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [1.0, None], 1), (n + 4, [], 1), (n + 5, [1.0, 2.0], 1), (n + 6, [2.0, 4.0], 1), (n + 7, [1e100, 2e100], 1)]
    got = caps.vector_components(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()
    want = brute.cosine_links(table)
    assert len(got) == len(table) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    assert sum(r.n_links for r in got) >= 0.99 * sum(x for x, _ in want.values())


def test_blocks_of_a_hot_filter(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 7)
    centre = np.random.default_rng(8).normal(size=64)
    table = [(i, (centre + np.random.default_rng(i).normal(size=64) * 0.02).tolist(), 1) for i in range(60)]
    got = caps.vector_components(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string, n_chars int")
    assert packing.pack(keep(packing.token_pieces(d, brute.TOKENIZER))).count() == 0
    assert quality.score_quality(d).count() == simhash.simhash_components(d).count() == mixing.mixed_sizes(d).count() == 0
    assert suffix.remove_repeats(d).count() == phrases.drop_passages(d).count() == 0
    assert classifier.score_documents(d, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert caps.vector_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = keep(stage(spark, docs, SF))
        assert out.columns == docs.columns
        docs = out
    mixed = docs.collect()
    assert all(not brute.quality(text[r.doc_id])[-1] for r in mixed)
    plain = [(i, r.text) for i, r in enumerate({r.doc_id: r for r in mixed}.values())]
    assert not any(n for _, n, _ in brute.removed_words(plain))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sum(r.length for r in got) == sum(len(brute.ids_of(r.text)) + 1 for r in mixed)
    assert os.path.isdir(SF)


def test_near_duplicates_follow_links_of_trees(spark):
    """Texts of one fingerprint whose sets of shingles differ, and a near copy of one of them."""
    import corpus_pipeline

    again = "one two three four five six seven " * 100
    apart = [again + " ".join(f"{c}{i}" for i in range(12)) for c in "ab"]
    texts = [*apart, apart[1] + " end", "nothing of it stands here at all but these few words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = {r.doc_id: r.f0 for r in simhash.simhash_components(docs, simhash.CLOSE).collect()}
    assert all((prints[0] ^ prints[i]).bit_count() <= 3 for i in (1, 2))
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == {0, 1, 3}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {0, 3}
