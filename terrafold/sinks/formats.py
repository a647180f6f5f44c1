"""Feature and element outputs.  Each format has a row form, which queries can check, and a writer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encode as E
from ..functions import geometry as G
from ..functions.naming import safe_file_name
from ..functions.values import canonical_string

DATA_TYPE = {"bigint": "Long", "int": "Integer", "double": "Double", "boolean": "Boolean", "timestamp": "DateTime", "timestamp_ntz": "DateTime"}


def _json_string(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def _property(df: DataFrame, name: str, keep_null: bool) -> Column:
    """``"name":value`` text of one typed column; null when left out."""
    t = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if t == "double":
        # A number JSON cannot hold is written as text.
        odd = F.isnan(c) | (F.abs(c) == float("inf"))
        v = F.when(F.isnan(c), '"NaN"').when(odd, F.when(c > 0, '"Infinity"').otherwise('"-Infinity"')).otherwise(E.plain_number(c))
    elif t in ("bigint", "int", "smallint", "boolean"):
        v = c.cast("string")
    else:
        v = _json_string(canonical_string(c, DATA_TYPE.get(t, "Text")))
    key = F.lit('"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":')
    return F.when(c.isNotNull(), F.concat(key, v)).otherwise(F.concat(key, F.lit("null")) if keep_null else F.lit(None))


def geojson_rows(df: DataFrame, properties: list[str], fid: str = "feature_id", geom: str = "geom", omit_nulls: bool = True,
                 digits: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One GeoJSON feature per row as ``value``, beside the columns ``carry``."""
    props = F.concat_ws(",", *[_property(df, p, not omit_nulls) for p in properties]) if properties else F.lit("")
    text = F.concat(F.lit('{"type":"Feature","id":'), _json_string(F.col(fid).cast("string")), F.lit(',"properties":{'), props, F.lit('},"geometry":'), E.to_geojson(geom, digits), F.lit("}"))
    return df.select(*carry, text.alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str], crs: str = "EPSG:4326", **kw) -> None:
    """Newline-delimited features, and beside them a header that names the system when it is not WGS 84."""
    geojson_rows(df, properties, **kw).write.mode("overwrite").text(path)
    if crs.upper() != "EPSG:4326":
        auth, code = crs.split(":")
        head = f'{{"type":"name","properties":{{"name":"urn:ogc:def:crs:{auth}::{code}"}}}}'
        df.sparkSession.range(1).select(F.lit(head).alias("value")).coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_crs")


def elements_geojson_rows(elements: DataFrame) -> DataFrame:
    """Source elements before conversion: layer, kind, type, text and raw attributes; nulls are written."""
    pair = lambda k, v: F.concat(_json_string(k), F.lit(":"), F.coalesce(_json_string(v), F.lit("null")))
    raw = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(
        _json_string(e["key"]), F.lit(":"), F.when(e["value"].isNull(), F.lit("null")).otherwise(_json_string(e["value"])))), ",")
    head = F.concat_ws(",", pair(F.lit("layer"), F.col("layer")), pair(F.lit("geometryKind"), F.col("geometry_kind")),
                       F.when(F.col("native_type").isNotNull(), pair(F.lit("nativeType"), F.col("native_type"))), F.when(F.col("text").isNotNull(), pair(F.lit("text"), F.col("text"))),
                       F.when(F.length(raw) > 0, raw))
    text = F.concat(F.lit('{"type":"Feature","id":'), _json_string(F.col("element_id").cast("string")), F.lit(',"properties":{'), head, F.lit('},"geometry":'), E.to_geojson("geom", 7), F.lit("}"))
    return elements.select(text.alias("value"))


def write_elements_geojson(elements: DataFrame, path: str) -> None:
    elements_geojson_rows(elements).write.mode("overwrite").text(path)


def csv_rows(df: DataFrame, fields: list[str], fid: str = "feature_id", geom: str = "geom", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, WKT`` and the schema fields as canonical text; null is empty, heights are left out."""
    cols = [canonical_string(c, DATA_TYPE.get(df.schema[c].dataType.simpleString(), "Text")).alias(c) for c in fields]
    return df.select(*carry, F.col(fid).cast("string").alias("id"), F.coalesce(E.to_wkt(geom), F.lit("")).alias("WKT"), *cols)


def write_csv_wkt(df: DataFrame, path: str, fields: list[str], **kw) -> None:
    csv_rows(df, fields, **kw).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def wkt_rows(df: DataFrame, geom: str = "geom") -> DataFrame:
    return df.where(F.col(geom).isNotNull()).select(E.to_wkt(geom, z=True).alias("value"))


def write_wkt(df: DataFrame, path: str, geom: str = "geom") -> None:
    wkt_rows(df, geom).write.mode("overwrite").text(path)


def with_wkb(df: DataFrame, geom: str = "geom", out: str = "wkb") -> DataFrame:
    return df.withColumn(out, E.to_wkb(geom))


def write_wkb(df: DataFrame, path: str, geom: str = "geom") -> None:
    with_wkb(df, geom).drop(geom).write.mode("overwrite").parquet(path)


def kml_rows(df: DataFrame, fields: list[str], fid: str = "feature_id", geom: str = "geom", carry: tuple[str, ...] = ()) -> DataFrame:
    """One placemark per row; every schema field is a data value, empty when null."""
    data = [F.concat(F.lit(f'<Data name="{n}"><value>'), E.xml_escape(canonical_string(n, DATA_TYPE.get(df.schema[n].dataType.simpleString(), "Text"))), F.lit("</value></Data>")) for n in fields]
    ext = F.concat(F.lit("<ExtendedData>"), *data, F.lit("</ExtendedData>")) if fields else F.lit("")
    text = F.concat(F.lit('<Placemark id="'), E.xml_escape(F.col(fid).cast("string")), F.lit('">'), ext, E.to_kml(geom), F.lit("</Placemark>"))
    return df.select(*carry, text.alias("value"))


def kml_finding(crs: str) -> tuple[int, str] | None:
    """KML has one system: anything else is critical."""
    return None if crs.upper() == "EPSG:4326" else (3, "Export.KmlRequiresWgs84")


def kml_findings(df: DataFrame, crs: str) -> DataFrame:
    """The finding of a KML delivery in ``crs``, or no row."""
    from ..operators.quality import finding

    said = kml_finding(crs)
    one = df.sparkSession.range(1 if said else 0)
    severity, code = said or (3, "Export.KmlRequiresWgs84")
    return finding(one, "Export.Kml", severity, "Crs", F.lit(f"KML holds WGS 84 positions, this delivery is in {crs}"), code)


def write_kml(df: DataFrame, path: str, fields: list[str], crs: str = "EPSG:4326", **kw) -> DataFrame:
    """Writes the placemarks and returns the findings of the delivery."""
    kml_rows(df, fields, **kw).write.mode("overwrite").text(path)
    return kml_findings(df, crs)


WRITERS: dict[str, Callable] = {"geojson": write_geojson, "csv": write_csv_wkt, "kml": write_kml}


def register_writer(key: str, fn: Callable) -> None:
    """Add an output format: ``fn(df, path, fields)``."""
    WRITERS.setdefault(key.lower(), fn)


LINES: dict[str, Callable] = {"geojson": geojson_rows, "csv": csv_rows, "kml": kml_rows}


def write_classes(df: DataFrame, path: str, fmt: str, fields: list[str], class_col: str = "feature_class", crs: str = "EPSG:4326",
                  fid: str = "feature_id") -> DataFrame:
    """All feature classes in one job, ``path/class_file=<safe name>`` each, and ``class_file, n_features, n_written, status, code`` per class.

    Rows are dealt by range over class and feature, so a class fills few files and a large one several tasks. A feature that the
    format cannot hold is left out and its class is ``incomplete``; the other classes are not touched by it.
    """
    named = df.withColumn("class_file", safe_file_name(class_col))
    dealt = named.repartitionByRange("class_file", F.xxhash64(F.col(fid).cast("string")))
    rows = LINES[fmt](dealt, fields, fid=fid, carry=("class_file",))
    kept = rows if fmt == "csv" else rows.where("value IS NOT NULL")
    out = kept.write.mode("overwrite").partitionBy("class_file")
    out.option("header", True).option("escape", '"').option("emptyValue", "").csv(path) if fmt == "csv" else out.text(path)
    lines = LINES[fmt](named, fields, fid=fid, carry=("class_file",))
    written = F.count("*") if fmt == "csv" else F.count("value")
    n = lines.groupBy("class_file").agg(F.count("*").alias("n_features"), written.alias("n_written"))
    code = kml_finding(crs)[1] if fmt == "kml" and kml_finding(crs) else None
    return n.select("*", F.when(F.col("n_features") == F.col("n_written"), "ok").otherwise("incomplete").alias("status"), F.lit(code).cast("string").alias("code"))


def write_by_class(df: DataFrame, path: str, fmt: str, fields: list[str], class_col: str = "feature_class") -> dict[str, str]:
    """One output per feature class under a safe name, with the state of each; a failing class does not stop the others.

    The library's own formats write all classes in one partitioned job; a registered writer runs one job per class.
    """
    if fmt == "parquet":
        named = df.withColumn("class_file", safe_file_name(class_col))
        named.write.mode("overwrite").partitionBy("class_file").parquet(path)
        return {"*": "ok"}
    if fmt in LINES:
        return {r["class_file"]: r["status"] for r in write_classes(df, path, fmt, fields, class_col).toLocalIterator()}
    named = df.withColumn("_file", safe_file_name(class_col))
    status = {}
    names = [r[0] for r in named.select("_file").distinct().orderBy("_file").limit(10001).collect()]
    if len(names) > 10000:
        raise ValueError("more than 10000 classes for a writer that runs a job each")
    for n in names:
        try:
            WRITERS[fmt](named.where(F.col("_file") == n).drop("_file"), f"{path.rstrip('/')}/{n}", fields)
            status[n] = "ok"
        except Exception as e:  # noqa: BLE001 - the remaining classes are still delivered
            status[n] = f"{type(e).__name__}: {e}"[:500]
    if status and all(s != "ok" for s in status.values()):
        raise RuntimeError(f"every class failed: {status}")
    return status
