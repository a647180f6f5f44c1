"""Readers on small files of every supported kind."""

import json
import re

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geometry as G
from terrafold.operators import pipeline as P
from terrafold.operators.classify import classify_rules
from terrafold.sources import bridge, landxml, points, profiles

XML = """<?xml version="1.0"?>
<LandXML xmlns="http://www.landxml.org/schema/LandXML-1.2" version="1.2">
 <CgPoints name="Control"><CgPoint name="7" code="TREE" desc="Oak">100.0 200.0 5.5</CgPoint><CgPoint name="8">bad text</CgPoint><CgPoint oID="9">110.0 210.0</CgPoint></CgPoints>
 <Parcels><Parcel name="A1" area="100.0" owner="Town"><CoordGeom>
   <Line><Start>0.0 0.0</Start><End>0.0 10.0</End></Line>
   <Curve rot="ccw"><Start>0.0 10.0</Start><Center>0.0 0.0</Center><End>10.0 0.0</End></Curve>
   <Line><Start>10.0 0.0</Start><End>0.0 0.0</End></Line></CoordGeom></Parcel></Parcels>
 <Alignments><Alignment name="RD" length="30.0"><CoordGeom><Line><Start>0 0</Start><End>0 30</End></Line></CoordGeom></Alignment></Alignments>
 <Surfaces><Surface name="EG"><SourceData>
   <Breaklines><Breakline name="B" brkType="standard"><PntList3D>0 0 1 5 5 2 10 10 3</PntList3D></Breakline></Breaklines>
   <Boundaries><Boundary name="O" bndType="outer"><PntList2D>0 0 0 10 10 10 10 0</PntList2D></Boundary></Boundaries></SourceData>
  <Definition surfType="TIN"><Pnts><P id="1">0 0 1</P><P id="2">0 10 2</P><P id="3">10 10 3</P><P id="4">10 0 4</P></Pnts>
   <Faces><F n="2 0 0">1 2 3</F><F i="1">1 4 3</F><F>1 2 99</F></Faces></Definition></Surface></Surfaces>
 <PlanFeatures name="Plan"><PlanFeature name="F"><CoordGeom><Line><Start>1 1</Start><End>1 9</End></Line></CoordGeom></PlanFeature></PlanFeatures>
 <PipeNetworks><PipeNetwork name="S"><Structs><Struct name="M1" elevRim="9"><Center>0 0 9</Center></Struct><Struct name="M2"><Center>0 40 8</Center></Struct></Structs>
  <Pipes><Pipe name="P1" refStart="m1" refEnd="M2" material="PVC"><CircPipe diameter="0.3"/></Pipe><Pipe name="P2" refStart="M1" refEnd="M9"/></Pipes></PipeNetwork></PipeNetworks>
</LandXML>"""


@pytest.fixture(scope="module")
def survey(tmp_path_factory):
    p = tmp_path_factory.mktemp("xml") / "site.xml"
    p.write_text(XML)
    return str(p)


def test_landxml_collections(spark, survey):
    got = {c: landxml.read_landxml(spark, survey, c).collect() for c in landxml.COLLECTIONS}
    pts = {r["element_id"]: r["geom"]["parts"][0][0][0] for r in got["points"]}
    assert set(pts) == {"cgpoint:7", "cgpoint:9"}
    # Northing first in the file, easting first here.
    assert (pts["cgpoint:7"]["x"], pts["cgpoint:7"]["y"], pts["cgpoint:7"]["z"]) == (200.0, 100.0, 5.5)
    parcel = got["parcels"][0]
    ring = parcel["geom"]["parts"][0][0]
    assert parcel["geom"]["kind"] == "Polygon" and ring[0] == ring[-1] and len(ring) == 1 + 19 + 1
    assert parcel["attrs"]["Owner"] == "Town"
    assert [len(got[c]) for c in ("alignments", "breaklines", "boundaries", "plan_features", "structures")] == [1, 1, 1, 1, 2]
    faces = {r["element_id"]: r for r in got["faces"]}
    assert len(faces) == 2
    assert sorted(float(r["attrs"]["Elevation"]) for r in faces.values()) == pytest.approx([2.0, 8 / 3])
    assert {r["attrs"].get("Invisible") for r in faces.values()} == {None, "1"}
    pipes = got["pipes"]
    assert [r["element_id"] for r in pipes] == ["pipe:S:P1"] and pipes[0]["attrs"]["Diameter"] == "0.3"
    assert [(v["x"], v["y"]) for v in pipes[0]["geom"]["parts"][0][0]] == [(0.0, 0.0), (40.0, 0.0)]


def test_unnamed_survey_objects_are_numbered(spark, tmp_path):
    """The number counts the objects read so far, named ones included, and skips those without a shape."""
    geom = "<CoordGeom><Line><Start>0 0</Start><End>0 9</End></Line><Line><Start>0 9</Start><End>9 9</End></Line></CoordGeom>"
    line = "<PntList3D>0 0 1 5 5 2</PntList3D>"
    (tmp_path / "a.xml").write_text(
        f"<LandXML><Parcel>{geom}</Parcel><Parcel/><Parcel name='A'>{geom}</Parcel><Parcel>{geom}</Parcel><Alignment name='R'>{geom}</Alignment><Alignment>{geom}</Alignment>"
        f"<Surface name='S'><SourceData><Breaklines><Breakline>{line}</Breakline><Breakline/><Breakline>{line}</Breakline></Breaklines></SourceData></Surface></LandXML>")
    ids = lambda c: sorted(r["element_id"] for r in landxml.read_landxml(spark, str(tmp_path), c).collect())
    assert ids("parcels") == ["parcel:A", "parcel:Parcel1", "parcel:Parcel3"]
    assert ids("alignments") == ["alignment:Alignment2", "alignment:R"]
    assert ids("breaklines") == ["breakline:S:Breakline1", "breakline:S:Breakline2"]


def test_points_keep_physical_line_numbers_across_splits(spark, tmp_path):
    n = 4000
    body = ["e;n;ELEV;Code;note"] + [f"{i}.5;{i};;{'ROAD' if i % 2 else ''};row {i}" if i % 100 else "  " for i in range(2, n + 2)]
    (tmp_path / "a.csv").write_text("\n".join(body))
    (tmp_path / "b.csv").write_text("x,y\n1,2\nq,3\n")
    (tmp_path / "c.csv").write_text("p,q\n1,2\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        e, w = points.read_points(spark, str(tmp_path))
        rows = e.where(F.col("doc_id").endswith("a.csv")).select("element_id", F.get(G.vertices("geom"), F.lit(0))["y"].alias("y"), "layer").collect()
        assert len(rows) == n - sum(1 for i in range(2, n + 2) if i % 100 == 0)
        assert all(int(r["element_id"]) == int(r["y"]) for r in rows)
        assert {r["layer"] for r in rows} == {"ROAD", "Points"}
        warn = {(r["path"][-5:], r["line_no"], r["code"]) for r in w.collect()}
        assert warn == {("b.csv", 3, "Reader.UnreadableCoordinates"), ("c.csv", 1, "Reader.NoCoordinateColumns")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bridge_json(spark, tmp_path):
    doc = {"Location": "m.rvt", "FormatKey": "revit", "Warnings": ["part"], "Layers": [{"Name": "Walls", "Elements": [
        {"Id": "1", "GeometryKind": "polygon", "GeometryWkt": "POLYGON ((0 0, 1 0, 1 1, 0 0))", "Attributes": {"A": "1"}},
        {"Id": "2", "GeometryKind": "Blob", "GeometryWkt": "POLYGON ((0 0"}, {"Id": "3"}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    e, w = bridge.read_bridge_json(spark, str(tmp_path))
    rows = {r["element_id"]: r for r in e.collect()}
    assert rows["1"]["geom"]["kind"] == "Polygon" and rows["2"]["geom"] is None and rows["2"]["geometry_kind"] == "Unknown"
    assert sorted((r["element_id"] or "", r["code"]) for r in w.collect()) == [("", "part"), ("2", "Reader.UnreadableGeometry")]


def test_bridge_elements_do_not_carry_their_layer(spark, tmp_path):
    """Each element row of a large layer once held a copy of the whole layer."""
    doc = {"location": "m", "layers": [{"name": "W", "elements": [{"id": str(i), "geometryWkt": f"POINT ({i} 1)"} for i in range(50)]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    e, _ = bridge.read_bridge_json(spark, str(tmp_path))
    carried = re.findall(r"Generate posexplode\((\w+)\S*\), \[(.*?)\]", e._jdf.queryExecution().executedPlan().toString())
    assert [re.findall(r"(\w+)#", c) for g, c in carried if g == "_els"] == [["doc_id", "_lp", "layer", "is_visible"]]
    assert sorted((r["pos"]["_lp"], r["pos"]["_ep"], r["element_id"]) for r in e.collect()) == [(0, i, str(i)) for i in range(50)]


def test_rule_profiles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ProfileId": "p", "Name": "P", "Rules": [{"RuleName": "Road", "Priority": 9, "TargetFeatureClass": "Road", "LayerNames": ["ROAD_CL"], "GeometryTypes": ["Line"]}]}, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    rules, bad = profiles.load_profiles(spark, str(tmp_path))
    assert [r["file"][-6:] for r in bad.collect()] == ["b.json"]
    compiled = profiles.as_rules(rules)
    e = spark.createDataFrame([("1", "LINE", "Line", {"layer": "road_cl"}), ("2", "LINE", "Point", {"Layer": "ROAD_CL"})], "element_id string, native_type string, geometry_kind string, attrs map<string,string>")
    e = e.withColumns({"text": F.lit(None).cast("string"), "area": F.lit(None).cast("double"), "length": F.lit(None).cast("double")})
    r = classify_rules(e, compiled).collect()
    assert [(x["element_id"], x["label"], x["confidence"]) for x in r] == [("1", "Road", 0.90)]


def test_sidecar(spark, tmp_path):
    (tmp_path / "plan.prj").write_text('PROJCS["a",GEOGCS["b",AUTHORITY["EPSG","4277"]],AUTHORITY["EPSG","27700"]]')
    assert [tuple(r) for r in profiles.sidecar_crs(spark, str(tmp_path / "*.prj")).collect()] == [("plan", "EPSG:27700")]


def test_batch_goes_on_past_a_bad_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,layer\n1,2,A\n3,4,B\nz,1,A\n")
    P.register_reader("points-csv", points.read_points)
    P.register_reader("broken", lambda s, p: (_ for _ in ()).throw(ValueError("no")))
    c = P.convert_batch(spark, {"points-csv": str(tmp_path), "broken": "/nowhere"}, P.Settings(class_kind="Point"))
    assert c.features.where("status = 'written'").count() == 2
    assert sorted(r["status"] for r in c.documents.collect()) == ["Failed", "SucceededWithWarnings"]
    with pytest.raises(ValueError):
        P.convert_batch(spark, {"broken": "/nowhere"}, P.Settings(continue_on_error=False))
