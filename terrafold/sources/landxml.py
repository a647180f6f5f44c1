"""LandXML collections as element tables, one read per collection.

Rows are cut out by tag with an explicit schema.  A mixed run of segments is read as its inner text,
because a schema by tag name would lose their order.  Coordinates are northing first and are swapped;
text that does not read as numbers is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curves as C
from ..functions import geometry as G
from ..functions.values import as_double
from ..operators.common import dense_position
from ..operators.relations import pipe_lines, tin_faces

CG = ["name", "oID", "code", "desc", "state", "pntSurv"]


def _attrs(names) -> str:
    return ", ".join(f"_{n} string" for n in names)


def _rows(spark: SparkSession, path, tag: str, schema: str) -> DataFrame:
    d = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
    return d.withColumn("doc_id", F.input_file_name())


def parse_coordinate(c) -> Column:
    """Vertex of ``northing easting [height]``; null when either of the first two does not read."""
    p = F.filter(F.split(F.trim(G._c(c)), r"[\s,]+"), lambda t: F.length(t) > 0)
    nums = G.let(p, lambda q: F.struct(*[as_double(F.get(q, F.lit(i))).alias(c) for i, c in enumerate("nez")]))
    return G.let(nums, lambda v: F.when(v["n"].isNotNull() & v["e"].isNotNull(), G.vertex(v["e"], v["n"], v["z"])))


def parse_list(c, step: int = 3) -> Column:
    """Vertices of a flat run of triples (or pairs); a group that does not read is left out."""
    p = F.filter(F.split(F.trim(F.coalesce(G._c(c), F.lit(""))), r"\s+"), lambda t: F.length(t) > 0)
    n = F.floor(F.size(p) / step).cast("int")

    def at(q, i):
        nums = F.array(*[as_double(F.get(q, i * step + k)) for k in range(step)])
        return G.let(nums, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), G.vertex(F.get(v, F.lit(1)), F.get(v, F.lit(0)), F.get(v, F.lit(2)))))

    made = F.when(n > 0, G.let(p, lambda q: F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: at(q, i)))).otherwise(F.array().cast(G.RING))
    return F.array_compact(made)


def coord_geom(c) -> Column:
    """Path of the lines, curves and irregular lines of a ``CoordGeom``, in order, joints stated once."""
    text = F.coalesce(G._c(c), F.lit(""))
    segs = F.regexp_extract_all(text, F.lit(r"(?s)(<(Line|Curve|IrregularLine)\b.*?</\2>)"), F.lit(1))
    inner = lambda s, tag: F.regexp_extract(s, rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>", 1)

    none = F.array().cast(G.RING)

    def path(s):
        ends = F.struct(parse_coordinate(inner(s, "Start")).alias("a"), parse_coordinate(inner(s, "End")).alias("b"),
                        F.when(s.startswith("<Curve"), parse_coordinate(inner(s, "Center"))).alias("m"),
                        F.when(s.contains("<PntList3D"), parse_list(inner(s, "PntList3D"))).when(s.contains("<PntList2D"), parse_list(inner(s, "PntList2D"), 2)).otherwise(none).alias("more"),
                        (F.lower(F.regexp_extract(s, r'\brot\s*=\s*"([^"]*)"', 1)) != "ccw").alias("cw"))
        return G.let(ends, lambda e: F.when(e["a"].isNotNull() & e["b"].isNotNull() & e["m"].isNotNull(), C.survey_arc(e["a"], e["m"], e["b"], e["cw"])).otherwise(
            F.array_compact(F.concat(F.array(e["a"]), e["more"], F.array(e["b"])))))

    every = F.flatten(F.transform(segs, path))
    same = lambda u, v: (u["x"] == v["x"]) & (u["y"] == v["y"])
    return G.let(every, lambda e: F.filter(e, lambda v, i: (i == 0) | ~F.coalesce(same(F.get(e, i - 1), v), F.lit(False))))


def _close(path: Column) -> Column:
    return F.when(G.is_closed(path), path).otherwise(F.concat(path, F.slice(path, 1, 1)))


def _named(pairs: dict[str, Column]) -> Column:
    e = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(e, lambda x: F.length(x["value"]) > 0))


def _element(df: DataFrame, layer, eid, kind, geom, native: str, attrs: dict[str, Column]) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("doc_id", lit(layer).alias("layer"), eid.alias("element_id"), lit(kind).alias("geometry_kind"), geom.alias("geom"),
                     F.lit(native).alias("native_type"), F.lit(None).cast("string").alias("text"), _named(attrs).alias("attrs"))


def read_points(spark, path) -> DataFrame:
    s = f"_name string, CgPoint array<struct<{', '.join('_' + n + ':string' for n in CG)},_VALUE:string>>"
    d = _rows(spark, path, "CgPoints", s).select("doc_id", "_name", F.posexplode("CgPoint").alias("i", "p"))
    d = G.pin(d, v=parse_coordinate("p._VALUE")).where(F.col("v").isNotNull())
    layer = F.when(F.length("_name") > 0, F.concat(F.lit("CgPoints:"), "_name")).otherwise("CgPoints")
    name = F.coalesce("p._name", "p._oID", F.concat(F.lit("P"), (F.col("i") + 1).cast("string")))
    z = F.when(~F.isnan("v.z"), F.col("v.z"))
    return _element(d, layer, F.concat(F.lit("cgpoint:"), name), "Point", G.make_geom(G.POINT, F.array(F.array(F.array("v")))), "CgPoint", {
        "Layer": layer, "PointName": name, "Code": F.col("p._code"), "Description": F.col("p._desc"), "State": F.col("p._state"), "SurveyType": F.col("p._pntSurv"), "Elevation": z})


def _line_or_area(path: Column) -> tuple[Column, Column]:
    closed = (F.size(path) >= 4) & G.is_closed(path)
    kind = F.when(F.size(path) == 1, "Point").when(closed, "Polygon").otherwise("Line")
    geom = G.make_geom(F.when(F.size(path) == 1, G.POINT).when(closed, G.POLYGON).otherwise(G.LINE), F.array(F.array(path)))
    return kind, geom


def _names(d: DataFrame, word: str) -> DataFrame:
    """``name`` of each row: its own, else ``word`` and its place among the document's rows, from one.

    Splits of a file are read in its order (equal ones first, the shorter last), so row ids follow it too.
    """
    d = dense_position(d.withColumn("_row", F.monotonically_increasing_id()), "_row", "_nth", ["doc_id"])
    return d.withColumn("name", F.coalesce("_name", F.concat(F.lit(word), (F.col("_nth") + 1).cast("string"))))


def read_parcels(spark, path) -> DataFrame:
    names = ["name", "area", "desc", "parcelType", "state", "class", "useOfParcel", "owner"]
    d = _rows(spark, path, "Parcel", f"{_attrs(names)}, CoordGeom string")
    d = _names(G.pin(d, v=coord_geom("CoordGeom")).where(F.size("v") >= 3), "Parcel")
    ring = _close(F.col("v"))
    geom = F.when(F.size(ring) >= 4, G.make_geom(G.POLYGON, F.array(F.array(ring)))).otherwise(G.line(ring))
    return _element(d, "Parcels", F.concat(F.lit("parcel:"), "name"), "Polygon", geom, "Parcel", {
        "Layer": F.lit("Parcels"), "ParcelName": F.col("name"), "Area": F.col("_area"), "Description": F.col("_desc"), "ParcelType": F.col("_parcelType"),
        "State": F.col("_state"), "Class": F.col("_class"), "UseOfParcel": F.col("_useOfParcel"), "Owner": F.col("_owner")})


def read_alignments(spark, path) -> DataFrame:
    d = _rows(spark, path, "Alignment", f"{_attrs(['name', 'length', 'staStart', 'desc', 'state'])}, CoordGeom string")
    d = _names(G.pin(d, v=coord_geom("CoordGeom")).where(F.size("v") >= 2), "Alignment")
    return _element(d, "Alignments", F.concat(F.lit("alignment:"), "name"), "Line", G.line(F.col("v")), "Alignment", {
        "Layer": F.lit("Alignments"), "AlignmentName": F.col("name"), "Length": F.col("_length"), "StartStation": F.col("_staStart"), "Description": F.col("_desc"), "State": F.col("_state")})


def read_plan_features(spark, path) -> DataFrame:
    d = _rows(spark, path, "PlanFeatures", "_name string, PlanFeature array<struct<_name:string,_desc:string,_state:string,CoordGeom:string>>")
    d = d.select("doc_id", "_name", F.explode("PlanFeature").alias("p"))
    d = G.pin(d, v=coord_geom("p.CoordGeom")).where(F.size("v") > 0)
    layer = F.when(F.length("_name") > 0, F.concat(F.lit("PlanFeatures:"), "_name")).otherwise("PlanFeatures")
    kind, geom = _line_or_area(F.col("v"))
    return _element(d, layer, F.concat(F.lit("planfeature:"), "p._name"), kind, geom, "PlanFeature", {
        "Layer": layer, "FeatureName": F.col("p._name"), "Description": F.col("p._desc"), "State": F.col("p._state")})


_LIST = "PntList3D:string,PntList2D:string"
SURFACE = f"""_name string, SourceData struct<Breaklines:array<struct<Breakline:array<struct<_name:string,_brkType:string,_desc:string,{_LIST}>>>>,
Boundaries:array<struct<Boundary:array<struct<_name:string,_bndType:string,_edgeTrim:string,_desc:string,{_LIST}>>>>>,
Definition struct<Pnts:struct<P:array<struct<_id:string,_VALUE:string>>>, Faces:array<struct<F:array<struct<_n:string,_i:string,_VALUE:string>>>>>"""


def _run(p: Column) -> Column:
    return F.when(p["PntList3D"].isNotNull(), parse_list(p["PntList3D"])).otherwise(parse_list(p["PntList2D"], 2))


def read_breaklines(spark, path) -> DataFrame:
    d = _rows(spark, path, "Surface", SURFACE).select("doc_id", F.col("_name").alias("s"), F.posexplode(
        F.filter(F.flatten("SourceData.Breaklines.Breakline"), lambda b: F.size(_run(b)) >= 2)).alias("i", "b"))
    d = G.pin(d, v=_run(F.col("b")), name=F.coalesce("b._name", F.concat(F.lit("Breakline"), (F.col("i") + 1).cast("string"))))
    layer = F.concat(F.lit("Breaklines:"), "s")
    return _element(d, layer, F.concat_ws(":", F.lit("breakline"), "s", "name"), "Line", G.line(F.col("v")), "Breakline", {
        "Layer": layer, "SurfaceName": F.col("s"), "BreaklineName": F.col("name"), "BreaklineType": F.col("b._brkType"), "Description": F.col("b._desc")})


def read_boundaries(spark, path) -> DataFrame:
    d = _rows(spark, path, "Surface", SURFACE).select("doc_id", F.col("_name").alias("s"), F.explode(F.flatten("SourceData.Boundaries.Boundary")).alias("b"))
    d = G.pin(d, v=_run(F.col("b"))).where(F.size("v") >= 3)
    ring = _close(F.col("v"))
    layer = F.concat(F.lit("Boundaries:"), "s")
    geom = F.when(F.size(ring) >= 4, G.make_geom(G.POLYGON, F.array(F.array(ring)))).otherwise(G.line(ring))
    return _element(d, layer, F.concat_ws(":", F.lit("boundary"), "s", "b._name"), "Polygon", geom, "SurfaceBoundary", {
        "Layer": layer, "SurfaceName": F.col("s"), "BoundaryName": F.col("b._name"), "BoundaryType": F.col("b._bndType"), "EdgeTrim": F.col("b._edgeTrim"), "Description": F.col("b._desc")})


def read_faces(spark, path) -> DataFrame:
    d = _rows(spark, path, "Surface", SURFACE).withColumn("surface", F.concat_ws("|", "doc_id", "_name"))
    p = d.select("surface", F.posexplode("Definition.Pnts.P").alias("pos", "p"))
    p = G.pin(p, v=parse_coordinate("p._VALUE")).where(F.col("v").isNotNull()).select("surface", F.col("p._id").alias("point_id"), "pos", "v.x", "v.y", "v.z")
    f = d.select("doc_id", "_name", "surface", F.posexplode(F.flatten("Definition.Faces.F")).alias("face_id", "f"))
    ids = F.filter(F.split(F.trim("f._VALUE"), r"\s+"), lambda t: F.length(t) > 0)
    t = tin_faces(p, f.withColumn("ids", ids))
    layer = F.concat(F.lit("TIN:"), "_name")
    return _element(t, layer, F.concat_ws(":", F.lit("face"), "_name", (F.col("face_id") + 1).cast("string")), "Polygon", F.col("geom"), "TinFace", {
        "Layer": layer, "SurfaceName": F.col("_name"), "Elevation": F.col("elevation"), "Neighbours": F.col("f._n"), "Invisible": F.col("f._i")})


NETWORK = """_name string, Structs array<struct<Struct:array<struct<_name:string,_desc:string,_elevSump:string,_elevRim:string,_state:string,Center:string>>>>,
Pipes array<struct<Pipe:array<struct<_name:string,_refStart:string,_refEnd:string,_desc:string,_material:string,_slope:string,_flowDir:string,_system:string,
PntList3D:string,CoordGeom:string,CircPipe:struct<_diameter:string,_thickness:string>>>>>"""


def _structures(spark, path) -> DataFrame:
    d = _rows(spark, path, "PipeNetwork", NETWORK).select("doc_id", F.col("_name").alias("n"), F.posexplode(F.flatten("Structs.Struct")).alias("pos", "s"))
    return G.pin(d, v=parse_coordinate("s.Center")).where(F.col("v").isNotNull())


def read_structures(spark, path) -> DataFrame:
    d = _structures(spark, path)
    layer = F.concat(F.lit("Structures:"), "n")
    return _element(d, layer, F.concat_ws(":", F.lit("struct"), "n", "s._name"), "Point", G.make_geom(G.POINT, F.array(F.array(F.array("v")))), "Struct", {
        "Layer": layer, "NetworkName": F.col("n"), "StructureName": F.col("s._name"), "Description": F.col("s._desc"), "SumpElevation": F.col("s._elevSump"),
        "RimElevation": F.col("s._elevRim"), "State": F.col("s._state")})


def read_pipes(spark, path) -> DataFrame:
    s = _structures(spark, path).groupBy(F.concat_ws("|", "doc_id", "n").alias("network"), F.lower("s._name").alias("structure_id")).agg(F.max_by("v", "pos").alias("centre"))
    d = _rows(spark, path, "PipeNetwork", NETWORK).select("doc_id", F.col("_name").alias("n"), F.explode(F.flatten("Pipes.Pipe")).alias("p"))
    d = d.withColumns({"network": F.concat_ws("|", "doc_id", "n"), "start_id": F.lower("p._refStart"), "end_id": F.lower("p._refEnd")})
    d = G.pin(d, list3d=parse_list("p.PntList3D"), path=coord_geom("p.CoordGeom"))
    t = pipe_lines(d, s)
    layer = F.concat(F.lit("Pipes:"), "n")
    return _element(t, layer, F.concat_ws(":", F.lit("pipe"), "n", "p._name"), "Line", F.col("geom"), "Pipe", {
        "Layer": layer, "NetworkName": F.col("n"), "PipeName": F.col("p._name"), "StartStructure": F.col("p._refStart"), "EndStructure": F.col("p._refEnd"), "Description": F.col("p._desc"),
        "Material": F.col("p._material"), "Slope": F.col("p._slope"), "FlowDirection": F.col("p._flowDir"), "System": F.col("p._system"),
        "Diameter": F.col("p.CircPipe._diameter"), "WallThickness": F.col("p.CircPipe._thickness")})


COLLECTIONS = {"points": read_points, "parcels": read_parcels, "alignments": read_alignments, "plan_features": read_plan_features, "breaklines": read_breaklines,
               "boundaries": read_boundaries, "faces": read_faces, "structures": read_structures, "pipes": read_pipes}


def read_landxml(spark: SparkSession, path, collection: str) -> DataFrame:
    return COLLECTIONS[collection](spark, path)
