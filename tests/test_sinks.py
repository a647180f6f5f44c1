"""Writers: what is on disk reads back as what went in."""

import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from terrafold.functions import encode as E
from terrafold.functions import geometry as G
from terrafold.operators import ledger as L
from terrafold.operators import quality as Q
from terrafold.operators import selection as S
from terrafold.sinks import formats as K
from terrafold.sinks import report as R


def features(spark):
    d = spark.createDataFrame([("1", "a.b c", 'say "hi", <you>', 1.5, True, 0.0), ("2", "..", None, float("nan"), None, 5.0), ("3", "Road", "<script>", 1e20, False, 9.0)],
                              "feature_id string, feature_class string, name string, v double, ok boolean, x double")
    return d.withColumn("geom", F.when(F.col("feature_id") == "2", F.lit(None).cast(G.GEOM)).otherwise(G.rect("x", "x", F.col("x") + 1, F.col("x") + 1)))


def test_geojson(spark, tmp_path):
    K.write_geojson(features(spark), str(tmp_path / "g"), ["name", "v", "ok"], crs="EPSG:27700")
    rows = {r["id"]: r for r in (json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "g")).collect())}
    assert rows["1"]["properties"] == {"name": 'say "hi", <you>', "v": 1.5, "ok": True}
    assert rows["2"]["properties"] == {"v": "NaN"} and rows["2"]["geometry"] is None
    assert rows["3"]["properties"]["v"] == 1e20
    assert json.loads(spark.read.text(str(tmp_path / "g_crs")).first()["value"])["properties"]["name"] == "urn:ogc:def:crs:EPSG::27700"
    kept = [json.loads(r["value"]) for r in K.geojson_rows(features(spark), ["name"], omit_nulls=False).collect()]
    assert {r["id"]: r["properties"]["name"] for r in kept}["2"] is None


def test_csv_quotes_and_wkt(spark, tmp_path):
    K.write_csv_wkt(features(spark), str(tmp_path / "c"), ["name", "v", "ok"])
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*.csv"))
    assert 'say ""hi"", <you>' in text and "id,WKT,name,v,ok" in text
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).withColumn("g", E.geom_from_wkt("WKT"))
    assert {r["id"]: r["a"] for r in back.select("id", G.st_area("g").alias("a")).collect()}["1"] == 1.0


def test_wkt_reads_what_it_writes_and_refuses_the_rest(spark):
    good = ["POINT (1 2)", "LINESTRING (0 0, 1 1.5)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))",
            "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "POLYGON EMPTY"]
    bad = ["POINT (1)", "CIRCLE (1 2)", "POLYGON ((0 0, 1 1", "POINT (1 2) x", ""]
    d = spark.createDataFrame([(t,) for t in good + bad], "t string").withColumn("g", E.geom_from_wkt("t"))
    rows = {r["t"]: r["w"] for r in d.select("t", F.when(F.col("g.kind").isNotNull(), E.to_wkt("g")).alias("w")).collect()}
    assert all(rows[t] == t for t in good) and all(rows[t] is None for t in bad)


def test_wkb_reads_in_an_independent_reader(spark):
    rows = K.with_wkb(features(spark)).select("feature_id", F.hex("wkb").alias("h")).collect()
    h = {r["feature_id"]: r["h"] for r in rows}
    assert h["2"] is None and h["1"].startswith("0103000000" + "01000000" + "05000000") and len(h["1"]) == 2 * (9 + 4 + 80)


def test_wkb_of_holes_of_other_lengths(spark):
    texts = ["POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 2, 2 1, 1 1))", "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 5.5, 7 6, 7 5.5, 6 5.5)))", "MULTIPOINT ((1 2), (3 4))"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", E.to_wkb(E.geom_from_wkt("t")).alias("b"))

    def read(b):
        """Coordinates in order, by a reader of its own."""
        kind, at = struct.unpack_from("<I", b, 1)[0], 5

        def numbers(n):
            nonlocal at
            at += 8 * n
            return list(struct.unpack_from(f"<{n}d", b, at - 8 * n))

        def count():
            nonlocal at
            at += 4
            return struct.unpack_from("<I", b, at - 4)[0]

        def body(kind):
            nonlocal at
            if kind == 1:
                return numbers(2)
            if kind == 3:
                return [v for _ in range(count()) for v in numbers(2 * count())]
            out = []
            for _ in range(count()):
                at += 5
                out += body(struct.unpack_from("<I", b, at - 4)[0])
            return out

        out = body(kind)
        assert at == len(b)
        return out

    for t, b in d.collect():
        assert read(bytes(b)) == [float(v) for v in re.findall(r"[0-9.]+", t)]


def test_one_output_per_class(spark, tmp_path):
    st = K.write_by_class(features(spark), str(tmp_path / "o"), "geojson", ["name"])
    assert st == {"Road": "ok", "a_b_c": "ok", "layer": "ok"}

    def refuse(df, path, fields):
        if path.endswith("Road"):
            raise OSError("full")
        K.write_geojson(df, path, fields)

    K.register_writer("picky", refuse)
    st = K.write_by_class(features(spark), str(tmp_path / "p"), "picky", ["name"])
    assert st["layer"] == "ok" and st["Road"].startswith("OSError")
    K.write_by_class(features(spark).drop("geom"), str(tmp_path / "q"), "parquet", [])
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "q")).select("class_file").collect()} == {"Road", "a_b_c", "layer"}


def test_report_encodes_hostile_text(spark, tmp_path):
    d = features(spark).withColumns({"dataset": F.lit("D"), "pos": F.lit(1)})
    f = Q.finding(d, "R", 2, "Attribute", F.coalesce("name", F.lit("none")), feature_id=F.col("feature_id"))
    R.write_report(f, str(tmp_path / "r"))
    html = "".join(p.read_text() for p in (tmp_path / "r" / "html").rglob("part-*"))
    assert "<script>" not in html and "&lt;script&gt;" in html
    head = next(p.read_text().splitlines()[0] for p in (tmp_path / "r" / "csv").glob("part-*.csv"))
    assert head == ",".join(R.CSV_COLUMNS)
    assert json.loads(spark.read.text(str(tmp_path / "r/json/summary")).first()["value"]) == {
        "total": 3, "highestSeverity": "Error", "acceptable": True, "information": 0, "warning": 0, "error": 3, "critical": 0}
    assert K.kml_finding("EPSG:27700") == (3, "Export.KmlRequiresWgs84") and K.kml_finding("epsg:4326") is None


def test_selection_sets_and_finding_partitions(spark, tmp_path):
    ids = spark.range(5).withColumnRenamed("id", "element_id")
    S.save_selection(ids.where("element_id > 2"), str(tmp_path / "s"), "mine")
    assert S.selection_set(spark, str(tmp_path / "s"), "mine").count() == 2
    f = spark.range(10).select((F.col("id") % 3).alias("run_id"), F.col("id").alias("pos"))
    L.append_findings(f, str(tmp_path / "f"))
    L.append_findings(f, str(tmp_path / "f"))
    one = L.findings_for_run(spark, str(tmp_path / "f"), 1)
    assert one.count() == 6
    assert "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().executedPlan().toString()
    assert L.rewrite(f, str(tmp_path / "v"), "2").endswith("version=2")


@pytest.mark.parametrize("fmt", ["geojson", "csv", "kml"])
def test_many_classes_in_one_job(spark, tmp_path, fmt):
    n = 120
    d = spark.range(n * 3).select(F.col("id").alias("feature_id"), F.when(F.col("id") < n * 2, F.concat(F.lit("c "), (F.col("id") % n).cast("string"))).otherwise("large").alias("feature_class"),
                                  F.lit('a"b').alias("name"), G.point(F.col("id").cast("double"), F.lit(1.0)).alias("geom"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    st = K.write_classes(d, str(tmp_path / "o"), fmt, ["name"], crs="EPSG:27700")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 4
    got = {r["class_file"]: tuple(r)[1:] for r in st.collect()}
    code = "Export.KmlRequiresWgs84" if fmt == "kml" else None
    assert len(got) == n + 1 and got["large"] == (n, n, "ok", code) and got["c_17"] == (2, 2, "ok", code)
    back = spark.read.option("header", fmt == "csv").format("csv" if fmt == "csv" else "text").load(str(tmp_path / "o"))
    assert {r["class_file"]: r["count"] for r in back.groupBy("class_file").count().collect()} == {k: v[0] for k, v in got.items()}


def test_kml_says_that_it_needs_wgs84(spark, tmp_path):
    d = features(spark)
    assert [r["code"] for r in K.write_kml(d, str(tmp_path / "k"), ["name"], crs="EPSG:27700").collect()] == ["Export.KmlRequiresWgs84"]
    assert K.write_kml(d, str(tmp_path / "l"), ["name"]).count() == 0
