"""Results do not depend on cells, partitions or hot spots, and plans stay free of pairwise scans."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from terrafold.functions import geometry as G
from terrafold.operators import quality as Q
from terrafold.operators import spatial as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["spatial_join_intersects", "radius_geodesic", "snap_points", "overlaps", "dangles", "lexical_classification", "crs_by_location", "crs_search",
                                  "bim_relations", "relationship_edges", "reconciled_answers", "unique_fields", "tin_faces"])
def test_no_pairwise_scan(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_projection_reaches_the_scan(spark):
    text = plan(entry.queries()["overlaps"](spark, SF))
    assert "o_totalprice" not in text and "ReadSchema: struct<o_orderkey:bigint>" in text


def test_cap_limits_below_the_shuffle(spark):
    d = spark.range(5000)
    many = Q.finding(d.withColumn("dataset", (F.col("id") % 3).cast("string")), "R", 1, "Topology", F.lit("m"), pos=F.col("id"))
    one = Q.finding(d.withColumn("dataset", F.lit("D")), "R", 1, "Topology", F.lit("m"), pos=F.col("id"))
    assert "WindowGroupLimit" in plan(Q.cap_findings(many, 500))
    assert "TakeOrderedAndProject" in plan(Q.cap_findings(one, 500))


def test_rules_need_no_shuffle(spark):
    assert "Exchange" not in plan(entry.queries()["rule_candidates"](spark, SF))


@pytest.fixture(scope="module")
def boxes(spark):
    """A third of the rectangles are one and the same, another third crowd one corner."""
    rng = random.Random(2)
    rows = []
    for i in range(900):
        x, y = (5.0, 5.0) if i % 3 == 0 else (rng.uniform(0, 6), rng.uniform(0, 6)) if i % 3 == 1 else (rng.uniform(0, 500), rng.uniform(0, 500))
        w = 2.0 if i % 3 == 0 else rng.uniform(0.5, 3)
        rows.append(("D", i, i, x, y, x + w, y + w))
    return rows, spark.createDataFrame(rows, "dataset string, feature_id long, pos long, minx double, miny double, maxx double, maxy double").cache()


def test_overlaps_with_hot_spot_match_brute_force(boxes):
    rows, d = boxes
    want = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            inner = a[3] < b[5] and a[5] > b[3] and a[4] < b[6] and a[6] > b[4]
            ab = a[3] >= b[3] and a[5] <= b[5] and a[4] >= b[4] and a[6] <= b[6]
            ba = b[3] >= a[3] and b[5] <= a[5] and b[4] >= a[4] and b[6] <= a[6]
            if inner and not ab and not ba:
                want.add((a[1], b[1]))
    for size, split in ((7.0, 4096), (50.0, 8), (3.0, None)):
        got = [(r["feature_id"], r["other_id"]) for r in Q.overlap_areas(d, size, split_above=split).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_nearest_with_piles_matches_brute_force(spark):
    rng = random.Random(4)
    right = [(f"r{i:04d}", *((50.0, 50.0) if i % 3 == 0 else (rng.uniform(49, 51), rng.uniform(49, 51)) if i % 3 == 1 else (rng.uniform(0, 1000), rng.uniform(0, 1000)))) for i in range(600)]
    left = [(i, rng.uniform(-50, 1100), rng.uniform(-50, 1100)) for i in range(60)] + [(100, 50.0, 50.0), (101, 48.0, 50.0)]
    r = spark.createDataFrame(right, "rid string, rx double, ry double")
    lf = spark.createDataFrame(left, "lid long, lx double, ly double")
    got = {}
    for x in S.knn_join(lf, r, 4, 5.0, cell_rows=16).collect():
        got.setdefault(x["lid"], []).append((x["rank"], x["rid"]))
    for i, x, y in left:
        best = sorted(((x - a) ** 2 + (y - b) ** 2, rid) for rid, a, b in right)[:4]
        assert [rid for _, rid in sorted(got[i])] == [rid for _, rid in best]


def test_fewer_points_than_asked(spark):
    r = spark.createDataFrame([("a", 0.0, 0.0), ("b", 900.0, 3.0)], "rid string, rx double, ry double")
    lf = spark.createDataFrame([(1, 10.0, 10.0)], "lid long, lx double, ly double")
    assert [x["rid"] for x in S.knn_join(lf, r, 5, 2.0).orderBy("rank").collect()] == ["a", "b"]


def test_radius_at_poles_and_antimeridian(spark):
    pts = [(i, lon, lat) for i, (lon, lat) in enumerate([(179.99, 0.0), (-179.99, 0.0), (0.0, 89.99), (180.0, 89.99), (10.0, -89.999), (-120.0, -89.999), (0.0, 60.0), (0.05, 60.0)])]
    a = spark.createDataFrame(pts, "l int, lx double, ly double")
    b = spark.createDataFrame(pts, "r int, rx double, ry double")
    got = {(x["l"], x["r"]) for x in S.radius_join(a, b, 5000.0, geographic=True).where("l < r").collect()}
    assert got == {(0, 1), (2, 3), (4, 5), (6, 7)}


def test_dangles_of_a_crowded_node(spark):
    """Three hundred lines that meet in one place are connected there and free at their far ends."""
    d = spark.range(300).select(F.lit("R").alias("dataset"), F.col("id").alias("feature_id"), F.col("id").alias("pos"),
                                G.line(F.array(G.vertex(F.lit(0.0), F.lit(0.0)), G.vertex(F.col("id") + 1.0, F.lit(9.0)))).alias("geom"))
    ends = Q.free_ends(d, 0.001).collect()
    assert len(ends) == 300 and {r["which"] for r in ends} == {"end"}


def test_deep_property_chains_keep_their_leaves(spark):
    from terrafold.operators.relations import flatten_properties

    n = 400
    rows = [(i, i - 1 if i else None, "e" if not i else None, i, "complex" if i < n else "single", f"p{i}", "v" if i == n else None, None) for i in range(n + 1)]
    rows += [(1001, 1002, None, 0, "complex", "a", None, None), (1002, 1001, None, 0, "single", "b", "lost in a cycle", None)]
    props = spark.createDataFrame(rows, "prop_id long, parent_id long, element_id string, pos long, kind string, name string, value string, values array<string>")
    assert [tuple(r) for r in flatten_properties(props).collect()] == [("e", n, f"p{n}", "v")]


def test_profiles_inherit_along_long_chains(spark):
    """Three hundred profiles in a row, a cycle with a tail, and a chain whose root names an unknown parent."""
    from terrafold.operators import schema as P

    k = F.col("id")
    none = lambda t: F.lit(None).cast(t)
    chain = spark.range(300).select(k.cast("string").alias("id"), F.when(k > 0, (k - 1).cast("string")).alias("extends"))
    rows = chain.union(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y"), ("y", "gone")], "id string, extends string"))
    d = rows.select("id", "extends", F.when(k == "0", "root").alias("name"), *[F.when(k == "7", "7").alias(c) if c == "output_crs" else none("string").alias(c) for c in P.PROFILE_SCALARS],
                    *[k.alias(c) for c in P.PROFILE_WHOLE], F.create_map(F.when(k == "0", "ROADS").otherwise("Roads"), k).alias("layer_mapping"),
                    none("map<string,string>").alias("attribute_mapping"), F.array(F.concat(F.lit("X"), k)).alias("excluded"))
    r = {x["id"]: x for x in P.resolve_profiles(d).collect()}
    assert (r["299"]["status"], r["299"]["name"], r["299"]["output_crs"], r["299"]["naming"], r["299"]["layer_mapping"], len(r["299"]["excluded"])) == ("ok", "root", "7", "299", {"Roads": "299"}, 300)
    assert (r["5"]["output_crs"], len(r["5"]["excluded"])) == (None, 6)
    assert [r[x]["status"] for x in "abcxy"] == ["Gis.ProfileCycle"] * 3 + ["Gis.ProfileParentNotFound"] * 2


def test_stopped_read_is_told(spark):
    from terrafold.operators import relations as R

    e = spark.range(10).select("id", F.when(F.col("id") < 8, "A").otherwise("B").alias("layer"), F.col("id").alias("pos"))
    layers = spark.createDataFrame([("a", True, False), ("b", False, False)], "layer string, is_visible boolean, is_frozen boolean")
    assert R.filter_layers(e, layers, max_elements=5).count() == 5
    assert [r["code"] for r in R.element_limit_warning(e, layers, 5).collect()] == ["Reader.ElementLimit"]
    assert R.element_limit_warning(e, layers, 8).count() == R.element_limit_warning(e, layers, 0).count() == 0


def test_sides_that_grow_are_never_collected_on_the_driver(spark):
    """Rows that Spark takes for a few bytes each hold a geometry, and an explode makes many of one."""
    from terrafold.functions import geometry as G
    from terrafold.operators import arrangement as A
    from terrafold.operators import shapes as H

    x = F.col("id") * 20.0
    d = spark.range(50).select(F.col("id").alias("key"), x.alias("x"), G.rect(x, F.lit(0.0), x + 10, F.lit(10.0)).alias("geom"), F.lit(10.0).alias("cell"))
    rings = d.select("key", (F.col("key") % 3).alias("ring_id"), G.rect_ring(F.col("x"), F.lit(0.0), F.col("x") + 10, F.lit(10.0)).alias("ring"))
    dots = d.select("key", (F.col("x") + 1).alias("mx"), F.lit(1.0).alias("my"), "cell")
    for df in (H.ring_depths(rings, 40.0), A.winding(dots, A.directed_edges(d, ["key", "cell"]), ["key"], "key", F.col("cell"))):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
