"""Work whose rows once met in one task, or were carried or sorted whole, spreads and keeps its results."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrafold.functions import curves as K
from terrafold.operators import classify as C
from terrafold.operators import crs as O
from terrafold.operators import quality as Q
from terrafold.operators import schema as P
from terrafold.operators import scoring as M
from terrafold.operators import shapes as H
from terrafold.operators import spatial as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_inferred_schema_sorts_no_rows(spark):
    """a text in an aggregate's buffer had all rows sorted; the first spelling still names the field."""
    rows = [("L", "a", 5, "Width", "1"), ("L", "b", 2, "WIDTH", "2.5"), ("L", "c", None, "width", "007"), ("L", "d", 2, "Height", ""), ("L", "e", 9, "height", "3")]
    d = spark.createDataFrame(rows, "layer string, element_id string, pos long, name string, value string")
    got = {r["name"]: (r["data_type"], r["max_length"], r["nullable"]) for r in P.infer_schema(d).collect()}
    assert got == {"width": ("Text", 3, False), "Height": ("Long", 1, True)}
    aggregates = [line for line in plan(P.infer_schema(d)).splitlines() if "Aggregate(" in line]
    assert "HashAggregate(" in aggregates[-1] and "Sort" not in aggregates[-1]


def dealt_rows(spark, df, key):
    """Most rows of one task of the join on a hot key."""
    counts = df.groupBy(F.spark_partition_id()).count().collect()
    return max(r["count"] for r in counts), sum(r["count"] for r in counts)


@pytest.fixture
def eight_tasks(spark):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def test_attributes_of_one_layer_meet_many_tasks(spark, eight_tasks):
    """the join to the fields of a layer sent the layer to one task."""
    d = spark.range(4000).select(F.lit("L").alias("layer"), F.col("id").cast("string").alias("element_id"), F.col("id").alias("pos"), F.lit("A").alias("name"), (F.col("id") % 7).cast("string").alias("value"))
    fields = spark.createDataFrame([("L", "a", "Long"), ("M", "b", "Text")], "layer string, name string, data_type string")
    m = P.map_attributes(d, fields)
    assert m.agg(F.count("*"), F.sum("as_long")).first() == (4000, sum(i % 7 for i in range(4000)))
    most, every = dealt_rows(spark, m, "layer")
    assert every == 4000 and most < 2000


def test_required_fields_of_one_dataset_meet_many_tasks(spark, eight_tasks):
    """the join to the fields of a dataset sorted the dataset in one task."""
    d = spark.range(4000).select(F.lit("D").alias("dataset"), F.col("id").alias("feature_id"), F.col("id").alias("pos"), F.create_map(F.lit("a"), F.lit("")).alias("attrs"))
    fields = spark.createDataFrame([("D", "A")], "dataset string, name string")
    out = Q.check_required(d, fields, ["a", "b"])
    assert out.where("feature_id IS NULL").count() == 1
    most, every = dealt_rows(spark, out.where("feature_id IS NOT NULL"), "dataset")
    assert every == 4000 and most < 2000


@pytest.mark.parametrize("name", ["required_fields", "sparse_fields", "first_duplicate_owner"])
def test_items_travel_in_one_row(spark, name):
    """seven rows an item were sent to be put together again."""
    assert "Generate explode(array(struct(name, QTY" not in plan(entry.queries()[name](spark, SF))


def test_sparse_fields_read_features_once(spark):
    d = spark.createDataFrame([("D", i, {"a": "x" if i == 0 else "", "B": "1"}) for i in range(40)] + [("E", 99, None)], "dataset string, feature_id long, attrs map<string,string>")
    fields = spark.createDataFrame([("D", "A", 0), ("D", "b", 1), ("D", "c", 2), ("E", "a", 0)], "dataset string, name string, ordinal int")
    got = {(r["dataset"], r["field"]) for r in Q.check_sparse(d, fields).collect()}
    assert got == {("D", "A"), ("D", "c"), ("E", "a")}
    assert plan(Q.check_sparse(d, fields)).count("attrs") and plan(Q.check_sparse(d, fields)).count("Scan ExistingRDD[dataset") <= 2


def test_type_parameters_fill_the_room_that_is_left(spark):
    """long type values were ranked beside all other values of their element; some elements have several rows, or no id."""
    rng = random.Random(3)
    inst = [(e, rng.randrange(50), f"n{rng.randrange(6)}", "v") for e in [*range(40), None] for _ in range(rng.randrange(7))]
    types = [(f"t{t}", p, f"m{p}", f"{t}-{p}") for t in range(4) for p in range(t * 2)]
    el = [(e, f"t{e % 5}") for e in range(45)] + [(3, "t3"), (3, "t2"), (7, "t1"), (None, "t3")]
    d = lambda rows, k: spark.createDataFrame(rows, f"{k}, pos long, name string, value string")
    got = P.flatten_parameters(d(inst, "element_id long"), d(types, "type_id string"), spark.createDataFrame(el, "element_id long, type_id string"), 5).collect()
    want = []
    for e in {x[0] for x in el} | {x[0] for x in inst}:
        first = {}
        for _, p, n, v in sorted((x for x in inst if x[0] == e), key=lambda x: x[1]):
            first.setdefault("p_" + n, (p, v))
        own = sorted((p, k) for k, (p, _) in first.items())[:5]
        more = sorted((p, "tp_" + n) for a, t in el if a == e for i, (u, p, n, _) in enumerate(x for x in types if x[0] == t) if i < 5)
        want += [(e, k) for _, k in (own + more)[:5]]
    order = lambda rows: sorted((-1 if e is None else e, k) for e, k in rows)
    assert order((r["element_id"], r["key"]) for r in got) == order(want)
    assert plan(P.flatten_parameters(d(inst, "element_id long"), d(types, "type_id string"), spark.createDataFrame(el, "element_id long, type_id string"), 5)).count("_src") == 0


def test_parameters_are_flattened_whole(spark):
    """at most 200 parameters of an element were kept, and no call gave the rest."""
    d = lambda rows, k: spark.createDataFrame(rows, f"{k}, pos long, name string, value string")
    inst = d([(1, p, f"n{p}", "v") for p in range(300)], "element_id long")
    types = d([("t", p, f"m{p}", "w") for p in range(250)] + [("t", 900, "m1", "late")], "type_id string")
    el = spark.createDataFrame([(1, "t"), (2, "t"), (3, None)], "element_id long, type_id string")
    got = {(r["element_id"], r["key"], r["value"]) for r in P.flatten_parameters(inst, types, el).collect()}
    assert got == {(1, f"p_n{p}", "v") for p in range(300)} | {(e, f"tp_m{p}", "w") for e in (1, 2) for p in range(250)}
    f = entry.queries()["flatten_parameters"](spark, SF)
    assert f.agg(F.max("n")).first()[0] > 12


def test_rows_that_meet_nothing_are_found_without_pairs(spark):
    """every pair that meets was made to find the rows without one."""
    box = lambda n, p: spark.range(n).select(F.col("id").alias(p + "id"), *[(F.col("id") % 10 + a).cast("double").alias(p + c) for c, a in zip(S.BOX, (0, 0, 2, 2))])
    left = box(3000, "l").unionByName(spark.createDataFrame([(-1, 500.0, 500.0, 501.0, 501.0), (-2, 12.0, 0.0, 13.0, 1.0)], box(1, "l").schema))
    lb, rb = tuple("l" + c for c in S.BOX), tuple("r" + c for c in S.BOX)
    for split in (4096, 8, None):
        d = S.spatial_join(left, box(2000, "r"), "disjoint", 4.0, lb, rb, split_above=split)
        assert {r["lid"] for r in d.collect()} == {-1, -2} and d.columns == left.columns
        assert "LeftSemi" in plan(d) and "Inner" not in plan(d).split("LeftSemi")[0].split("LeftAnti")[1]
    odd = S.spatial_join(left, box(2000, "r"), "disjoint", 4.0, lb, rb, F.col("lid") % 2 == 1)
    assert odd.count() == 1502


def test_rules_of_one_condition_are_compared_in_blocks(spark, eight_tasks):
    """all rules of one condition were compared in one task."""
    rules = spark.range(300).select(F.lit("p").alias("profile"), F.col("id").cast("int").alias("rule_pos"), F.col("id").cast("string").alias("name"), F.lit("T").alias("target"), (F.col("id") % 3).cast("int").alias("priority"),
                                    *[F.lit(None).cast("array<string>").alias(c) for c in ("layers", "entity_types", "geometry_types", "blocks", "colors", "linetypes", "xdata")], F.lit("x").alias("text_pattern"),
                                    *[F.lit(None).cast("double").alias(c) for c in ("min_area", "max_area", "min_length", "max_length")])
    pairs = C.lint_rules(rules, keys=["profile"], block=40).where("other IS NOT NULL")
    assert sorted(tuple(sorted((int(r["rule_name"]), int(r["other"])))) for r in pairs.collect()) == [(a, b) for a in range(300) for b in range(a + 1, 300)]
    most, every = dealt_rows(spark, pairs, "profile")
    assert every == 300 * 299 // 2 and most < every / 2


def test_points_of_one_place_meet_short_lists(spark):
    """every point of a cell met each area that crosses the cell; a task sorted all these pairs."""
    rng = random.Random(5)
    areas = []
    for code in range(1500):
        # Half of them end on the same borders, half on their own; some cross the antimeridian.
        w, s = (rng.choice([2.0, 3.0, 4.0]), rng.choice([1.0, 2.0])) if code % 2 else (rng.uniform(-1, 5), rng.uniform(-1, 5))
        e = -170.0 if code % 50 == 0 else w + (4.0 if code % 2 else rng.uniform(0.5, 6))
        areas.append((code, True, s, s + (3.0 if code % 2 else rng.uniform(0.5, 6)), w, e))
    points = [(i, rng.uniform(2, 6), rng.uniform(1, 5)) for i in range(600)] + [(600, 4.0, 2.0), (601, None, 2.0), (602, -175.0, 2.0), (602, -175.0, 2.0)]
    cat = spark.createDataFrame(areas, "code int, is_projected boolean, south double, north double, west double, east double")
    at = spark.createDataFrame(points, "pid int, lon double, lat double")
    size = lambda a: (a[3] - a[2]) * (a[5] - a[4] + (0 if a[4] <= a[5] else 360))
    holds = lambda a, x, y: a[2] <= y <= a[3] and (a[4] <= x <= a[5] if a[4] <= a[5] else x >= a[4] or x <= a[5])
    want = []
    for pid in {p[0] for p in points}:
        found = sorted((size(a), a[0]) for p in points if p[0] == pid and p[1] is not None for a in areas if holds(a, p[1], p[2]))
        want += [(pid, code, i + 1) for i, (_, code) in enumerate(found[:4])]
    got = O.crs_for_points(at, cat, 4)
    assert sorted((r["pid"], r["code"], r["rank"]) for r in got.collect()) == sorted(want)
    box = cat.withColumns({"_w": F.col("west"), "_e": F.col("east"), "area_size": (F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))}).where("west <= east")
    fine = at.withColumns({"_fx": F.floor(F.col("lon") / (10.0 / 64)).cast("long"), "_fy": F.floor(F.col("lat") / (10.0 / 64)).cast("long")})
    lists, places = O._short_lists(box, fine, 4, 10.0)
    met = fine.join(places, ["_fx", "_fy"]).selectExpr("pid", "_lv", "floor(_fx / pow(2, 6 - _lv)) AS _cx", "floor(_fy / pow(2, 6 - _lv)) AS _cy").join(lists, ["_lv", "_cx", "_cy"])
    assert met.count() < 604 * 300


def test_texts_are_hashed_row_by_row_in_many_tasks(spark, eight_tasks):
    """vectors were sorted and joined back to their texts, and a small file was hashed in one task."""
    texts = ["name=A; mix=1", "name=B", "", None, "name=A; mix=1"]
    d = spark.createDataFrame([(f"s{i}", texts[i % 5]) for i in range(40)], "subject_id string, descriptor string").coalesce(1)
    h = M.hash_features(d)
    assert "Join" not in plan(h)
    assert h.select(F.spark_partition_id()).distinct().count() > 1
    got = {}
    for r in h.collect():
        got.setdefault(r["subject_id"], []).append((r["bucket"], r["value"]))
    for i in range(40):
        idx, values = M.hash_vector(texts[i % 5] or "", 512)
        assert sorted(got.get(f"s{i}", [])) == [(int(a), float(b)) for a, b in zip(idx, values)]


def test_curves_of_a_small_file_are_cut_in_many_tasks(spark):
    """a file of few bytes is read by one task, which made all vertices with array lambdas."""
    rows = [(i, ("circle", "arc", "ellipse")[i % 3], 1.0, None if i == 7 else 2.0, (0.0, 3.0, None, -1.0, float("inf"))[i % 5], 2.0, 0.3, 0.5, 4.0, (None, 9.0)[i % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "curve_id int, kind string, cx double, cy double, radius double, minor double, rotation double, start double, end double, elevation double").coalesce(1)
    v = H.densify_curves(d, 0.01)
    assert v.select(F.spark_partition_id()).distinct().count() > 1
    sweep = K.ccw_sweep(F.col("start"), F.col("end"))
    path = F.when(F.col("kind") == "circle", K.circle_path("cx", "cy", "radius", 0.01, F.col("elevation"))).when(
        F.col("kind") == "ellipse", K.ellipse_path("cx", "cy", "radius", "minor", "rotation", "start", sweep, 0.01, F.col("elevation"))).otherwise(
        K.arc_path("cx", "cy", "radius", "start", sweep, 0.01, F.col("elevation")))
    want = d.select("curve_id", F.posexplode(path).alias("pos", "v")).select("curve_id", "pos", "v.*")
    assert v.columns == want.columns
    assert sorted(map(str, v.collect())) == sorted(map(str, want.collect()))


def test_equal_texts_are_searched_once(spark, monkeypatch):
    """every query met all entries that share three characters with it."""
    entries = [(c, f"Grid {w} {c}", *[None] * 8) for c in range(4000, 4060) for w in ("north", "southern")] + [(7, "Plain of 4003", *[None] * 8)]
    names = ("code", "name", "area_name", "datum", "method", "units", "south", "north", "west", "east")
    cat = spark.createDataFrame(entries, "code int, name string, area_name string, datum string, method string, units string, south double, north double, west double, east double")
    asked = ["4003", " 4003", "Grid SOUTHERN", "grid southern", "southe, 401", "ri", "g", "nowhere", "", "/", None]
    d = spark.createDataFrame([(i % 400, asked[i % len(asked)]) for i in range(2200)], "query_id int, query string")

    def plain(q):
        low = q.strip().lower()
        tokens = [t for t in low.replace(",", " ").replace("/", " ").replace("-", " ").split(" ") if t]
        hay = lambda e: f"{e[0]} {e[1]}".lower()
        return {(0 if low == str(e[0]) else 1 if e[1].lower().startswith(low) else 2, len(e[1]), e[0], e[1]) for e in entries
                if low == str(e[0]) or (tokens and all(t in hay(e) for t in tokens))}

    want = {}
    for i in range(2200):
        if (asked[i % len(asked)] or "").strip():
            want.setdefault(i % 400, set()).add((asked[i % len(asked)]))
    kept = []
    written = O.stored
    monkeypatch.setattr(O, "stored", lambda t: kept.append(t.count()) or written(t))
    got = {}
    for r in O.search_crs(d, cat.select(*names), 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.code))
    for k, qs in want.items():
        # Spellings of one text are ranked side by side, as the ids they share.
        rows = sorted(x for t in {q.strip() for q in qs} for x in plain(t))[:5]
        assert [(s, c) for _, s, c in sorted(got.get(k, []))] == [(x[0], x[2]) for x in rows], (k, qs)
    assert kept == [8 - 1]
