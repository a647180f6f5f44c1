"""Periodic runs, page text and hard negatives beside plain versions."""

import math
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import classifier, mixing, negatives, periods, phrases, suffix, tokens, wrappers
from terrafold.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"
NONE = -(1 << 62)


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.mark.parametrize("least,times", [(24, 3), (12, 3), (40, 5)])
def test_runs_of_random_words(least, times):
    rnd = random.Random(least)
    for _ in range(150):
        n, letters = rnd.choice([10, 30, 60, 120, 250]), rnd.choice([1, 2, 2, 3, 5, 40])
        w = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randrange(4)):
            a = rnd.randrange(n)
            p, e = rnd.randint(1, max(1, (n - a) // 3)), rnd.randint(a, n)
            for i in range(a, e):
                w[i] = w[a + (i - a) % p]
            if rnd.random() < 0.3:
                w[rnd.randrange(n)] = rnd.randrange(letters)
        # The same words once more as a second document: nothing may run on from one to the other.
        ids, doc = np.array([*w, 1000, *w, 1001]), np.repeat([0, 1], n + 1)
        want = brute.word_runs(w, least, times)
        assert sorted(periods.runs_of(ids, doc, least, times)) == sorted(want + [(s + n + 1, m, q) for s, m, q in want])


def test_periods(spark):
    texts = [t for _, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]
    rows = [(i, t if len(t) < 6000 else t[:6000]) for i, t in enumerate(texts)]
    rows += [(None, "a b " * 30), (None, None), (900, ""), (901, None), (902, " \t"), (903, "x " * 4000), (904, "x y z " * 9 + "w " + "x y z " * 9), (904, "x y z " * 9)]
    rows += [(905, "é\x1cb c\xa0d " * 12), (906, " ".join(f"w{i % 7}" for i in range(23)))]
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, start int, runs string").repartition(4)
    found = periods.run_digests(docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"), "start", "runs"))
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted((brute.periods(d, t) for d, t in rows), key=repr)
    assert sum(r[1] for r in got) > 20
    assert periods.run_digests(docs.limit(0)).count() == 0
    same = QUERIES["op11_periods"](spark, SF)
    assert same.columns == found.columns and same.count() == len(texts)


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    rows = [(i, int(rng.integers(0, 4)), (0.2 * centres[rng.integers(0, 4)] + rng.normal(size=12) * 0.1).tolist()) for i in range(400)]
    rows += [rows[50], rows[100], (1000, 1, [0.5] * 12), (1050, 1, [0.0] * 12), (1100, None, [0.5] * 12), (None, 1, [0.5] * 12), (1150, 2, None), (1200, 2, [float("nan")] * 12), (1250, 2, [None] * 12)]
    rows += [(1300, 2, [float("inf")] * 12), (1350, 99, [0.1] * 12), (1400, 3, [0.2] * 5), (1450, 3, [])] + [(2000 + i, 1, [0.25] * 12) for i in range(30)]
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<float>, score int, key string").repartition(5)
    plain = [(i, l, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, l, v in rows]
    for shard, anchors, depth in ((1 << 20, 1024, 32), (256, 3, 1)):
        monkeypatch.setattr(negatives, "SHARD_VALUES", shard)
        monkeypatch.setattr(negatives, "SHARD_LEAST", 8)
        monkeypatch.setattr(negatives, "ANCHORS", anchors)
        monkeypatch.setattr(negatives, "DEPTH", depth)
        got = sorted(tuple(r) for r in negatives.mine_negatives(negatives.quantised(table)).collect())
        assert got == brute.hard_negatives(plain) and len(got) > 50
    assert negatives.mine_negatives(negatives.quantised(table.limit(0))).count() == 0


def test_threshold_stops_early_and_right():
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(5000, 6)) * np.array([1000, 300, 100, 30, 10, 3]))
    lists, ids = negatives.Lists(v), np.arange(5000)
    deep = 0
    for a in np.round(rng.normal(size=(20, 6)) * 100):
        best = negatives.Best(3, ids, ids)
        deep = max(deep, lists.search(a, best.offer, best.settled))
        assert best.rows.tolist() == sorted(range(5000), key=lambda i: (-(v[i] @ a), i))[:3]
    assert deep < 5000


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, 0, [2.0 ** 30, 1.0]), (1, 0, [2.0 ** 30, 2.0]), (2, 0, [2.0 ** 30, 1.5]), (3, 1, [2.0 ** 29, 3.0]), (4, 1, [2.0 ** 29 + 1, 4.0]), (5, 1, [2.0 ** 29 + 1, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in negatives.mine_negatives(negatives.quantised(table, scale=1)).collect())
    assert got == brute.hard_negatives(rows, scale=1) and len(got) == 6


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, part int").repartition(4)


def _texts(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract_text(_pages(spark, rows)).collect()}


def test_pages_of_the_table(spark):
    got = sorted(tuple(r) for r in QUERIES["op12_wrappers"](spark, SF).collect())
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet' ORDER BY page_id").fetchall()
    assert got == [(i, u, brute.article(h), len(brute.article(h))) for i, u, h in rows]


def test_pages_without_article(spark):
    def page(i):
        body = "".join(f"<h2>Part {i} {j}</h2><p>Text {i * 7 + j} with <b>bold</b> and <a href='/x'>a link</a>.</p>" for j in range(2 + i % 3))
        return (f"<html><body class='has-sidebar'><div><a href='/'>Home</a> <a href='/a'>All</a></div><div id=top><p>Welcome to our site</p></div><div><div><h1>Title {i}</h1>{body}"
                f"<div><p>Tell your friends</p></div></div><div class='comments'><p>reader {i} says no</p></div></div><div class='side sidebar'><p>other {i}</p></div>"
                f"<form><p>mail {i}</p></form><div class=copyright>&copy; {i}</div></body></html>")

    got = _texts(spark, [(i, "https://a.example/x", page(i)) for i in range(9)])
    for i in range(9):
        parts = [x for j in range(2 + i % 3) for x in (f"Part {i} {j}", f"Text {i * 7 + j} with bold and a link.")]
        assert got[i] == "\n".join([f"Title {i}", *parts])


def test_odd_markup(spark):
    rows = [
        (0, "http://x.example/0", None), (1, "http://x.example/1", ""), (2, None, "plain &lt;text&gt; &amp; more\n here"),
        (3, "not an address", "<p>one<p>two &amp;copy; &#233;&#x20AC; &nbsp; end<br>three"),
        (4, "http://y.example/", "<article><p>a<script>var x='</p><p>no</p>'</script>b</p><!-- <p>no</p> --><style>p{}</style><ul><li>one<li>two</ul><p>c <a title='x > y' href=q>d</a></p></article><p>out</p>"),
        (5, "http://y.example/", "<article><p>unfinished <b>bold</p><div>d1<p>d2</p>d3</div><p>tail <a href='"),
        (6, "http://z.example/", "<div>" * 500 + "deep" + "</div>" * 500),
        (7, "http://z.example/", "<article>" + "<p>word</p>" * 20000 + "</article>"),
        (8, "http://w.example/", "<header><h1>Site</h1></header><article><header><h1>Own</h1><p>by me</p></header><p>x</p><footer>f</footer><section id='comments'><article><p>no</p></article></section></article>"),
        (9, "http://w.example/", "<main><p>x</p><aside>y</aside></main><p>z</p>"), (10, "http://v.example/", "<nav>n</nav>"), (11, "http://v.example/", "1 < 2 and <3"), (12, "http://v.example/", "<title>t</title><p hidden>h</p><p>v</p>"),
    ]
    got = _texts(spark, rows + [rows[3]])
    assert got == {0: "", 1: "", 2: "plain <text> & more here", 3: "one\ntwo &copy; é€ end three", 4: "ab\none\ntwo\nc d", 5: "unfinished bold\nd1\nd2\nd3\ntail", 6: "deep",
                   7: "\n".join(["word"] * 20000), 8: "Own\nx", 9: "x", 10: "", 11: "1 < 2 and <3", 12: "v"}
    assert wrappers.extract_text(_pages(spark, rows).limit(0)).count() == 0


def test_constants_go_where_the_rest_varies(spark):
    page = "<article><h1>News</h1><div class=lead>Read our terms</div><p>{}</p><ul><li><a href=1>More</a><li><a href=2>News</a><li><a href=3>Here</a></ul></article>"
    rows = [(i, "http://n.example/", page.format(f"story {i}")) for i in range(12)]
    assert set(_texts(spark, rows).values()) == {f"News\nstory {i}" for i in range(12)}
    # Copies of one page prove nothing about constants.
    assert set(_texts(spark, [(i, "http://n.example/", page.format("same")) for i in range(12)]).values()) == {"News\nRead our terms\nsame"}


def test_wrapper_folds_and_aligns():
    def wrapper(*pages):
        trees = sorted((wrappers.page_wrapper(p)[0] for p in pages), key=wrappers.shape)
        root = trees[0]
        for t in trees[1:]:
            root = wrappers._joined(root, t, False)
        return wrappers.shape(root)

    assert wrapper("<p>a<p>b<p>c") == "< p< # >+ >"
    assert wrapper("<h2>a</h2><p>b</p>" * 3) == "< ()< h2< # > p< # > >+ >"
    assert wrapper("<h1>a</h1><p>b", "<h1>a</h1><ul><li>x</ul><p>b") == "< h1< # > ul< li< # > >? p< # > >"
    text = wrapper("<div class='a b1'><p>x</div>", "<div class='a b2'><p>x<p>y</div><hr>z")
    assert text == wrappers.shape(wrappers.read(text)) == "< div.a.b0< p< # >+ > #? >"


def test_hot_host_meets_its_wrapper_in_parts(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "HOT_PAGES", 10)
    rows = [(i, "http://hot.example/", f"<nav>n</nav><div><p>text {i}</p></div>") for i in range(200)]
    assert _texts(spark, rows) == {i: f"text {i}" for i in range(200)}


def test_rows_without_an_id_are_told_apart_by_their_whole_key(spark):
    """Two texts whose hashes share their low 32 bits: one repeats itself, the other repeats nothing."""
    rng = np.random.default_rng(9)
    word = lambda n: " ".join(f"{x:x}" for x in rng.integers(1 << 40, 1 << 50, n))
    twice, once = word(60), word(130)
    low = {xxhash.xxh64_intdigest(f"{twice} {i} {twice}", 42) & 0xFFFFFFFF: i for i in range(150_000)}
    j, i = next((j, low[h]) for j in range(1_000_000) if (h := xxhash.xxh64_intdigest(f"{once} {j}", 42) & 0xFFFFFFFF) in low)
    shared = word(70)
    texts = [f"{twice} {i} {twice}", f"{once} {j}", *(f"x{k} {shared}" for k in range(3)), *(f"{k} {k}" for k in range(3000))]
    rows = [(None, t) for t in texts] + [(5, shared), (5, shared), (6, f"{once} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(docs).collect()}
    plain = [(NONE if d is None else d, t) for d, t in rows]
    assert got == {(d, *w[:3]) for (d, _), w in zip(rows, brute.removed_bytes(plain))}
    assert (None, len(texts[1]), 0, 0) in got
    got = {(r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_passages(docs).collect()}
    assert got == {(d, *w[:2]) for (d, _), w in zip(rows, brute.removed_words(plain))}
    left = sorted(r.text for r in phrases.drop_passages(docs).collect() if r.doc_id is None)
    assert left == sorted(texts)


CLASHES = ["row", "text_key", "doc", "key", "id", "low", "spans", "_spans", "_doc", "_low", "_copy", "copy", "copies", "number", "at", "_d", "_h", "_n", "block", "slot", "ticket", "size", "_row", "_t", "_w", "_l",
           "_first_id", "root", "band", "first", "row_hash", "target", "words"]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_take_rows_of_any_kind(spark, stage):
    """Columns named like the stage's own, null and repeated ids, repeated rows, null, empty and long texts, an empty table."""
    texts = [t for _, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()][:60]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, texts[1]), (None, None), (None, None), (3, texts[3]), (3, texts[4]), (70, ""), (71, None), (72, "word " * 20000)]
    rows = [(d, t, f"s{(d or 0) % 3}" if d != 7 else None, len(t or ""), *(f"{c}{k % 2}" for c in CLASHES)) for k, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3)
    out = stage[1](spark, docs, SF)
    assert out.columns == docs.columns
    got = out.collect()
    assert 0 < len(got) and {tuple(r)[4:] for r in got} <= {r[4:] for r in rows}
    assert {(r.doc_id, r.source) for r in got} <= {(r[0], r[2]) for r in rows}
    plain = stage[1](spark, docs.select("doc_id", "text", "source", "n_chars"), SF).collect()
    assert sorted(((r.doc_id, r.text, r.source, r.n_chars) for r in got), key=repr) == sorted(map(tuple, plain), key=repr)
    empty = stage[1](spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_repeated_rows_do_not_overshoot_the_mix(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "a")] * 300 + [(k, "x " * 10, "b") for k in range(300)], "doc_id long, text string, source string")
    by = {r["source"]: r["n"] for r in mixing.mix_documents(docs, weights=(1,), share=0.5, repeats=2).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert set(by) == {"a", "b"} and all(abs(n - 1500) <= 10 for n in by.values())


@pytest.mark.parametrize("slices, few", [(256, 50_000), (4, 3), (3, 40)])
def test_the_mix_is_cut_in_order_of_virtual_time(spark, monkeypatch, slices, few):
    """Against one sorted list of all words, for slices of any number and size."""
    monkeypatch.setattr(mixing, "SLICES", slices)
    monkeypatch.setattr(mixing, "SORTED_WORDS", few)
    rows = [("a", 0, 7, 30, 20.5), ("a", 7, 23, 30, 20.5), ("b", 0, 400, 405, 333.25), ("b", 400, 5, 405, 333.25), (None, 0, 1, 1, 2.0), ("c", 0, 0, 0, 0.0)]
    queued = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "slot long, source string, begins long, size long, source_size long, target double")
    got = {(r["slot"], r["copy"]): r["words"] for r in mixing.schedule(queued).collect()}
    words = sorted((p / t, s is None, s or "", p, (i, c)) for i, (s, b, n, whole, t) in enumerate(rows) for c in range(2) if t for p in range(b + c * whole + 1, b + c * whole + n + 1))
    budget = sum(math.floor(t) for t in {s: t for s, _, _, _, t in rows}.values())
    want = {}
    for w in words[:budget]:
        want[w[-1]] = want.get(w[-1], 0) + 1
    assert got == want


def test_empty_token_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokens.write_token_files(docs, f"{tmp_path}/none", brute.TOKENIZER, 2)
    assert tokens.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_training_rows_stay_bounded_when_ids_repeat(spark, monkeypatch):
    seen = []
    whole = classifier.train_network
    monkeypatch.setattr(classifier, "train_network", lambda x, y, *a, **k: (seen.append(len(x)), whole(x, y, *a, **k))[1])
    docs = spark.createDataFrame([(i % 5, f"text number {i} of many words {i * i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    assert classifier.score_documents(docs, labels, 100).count() == 600
    assert 0 < seen[0] <= 100
