"""Spatial, BIM and ledger views derived from the given tables by integer arithmetic.

Every builder has a SQL twin in ``CTE`` so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from .registry import load

CTE: dict[str, str] = {}


def with_sql(*names: str, body: str) -> str:
    """Prefix ``body`` with the named CTEs and whatever they depend on, in definition order."""
    need: set[str] = set()

    def visit(n):
        if n in need:
            return
        need.add(n)
        for other in CTE:
            if other != n and f"/*{other}*/" in CTE[n]:
                visit(other)

    for n in names:
        visit(n)
    ordered = [n for n in CTE if n in need]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTE[n]})" for n in ordered) + " " + body


# --- square parcels from orders --------------------------------------------------------------

def parcels(spark: SparkSession, sf: str) -> DataFrame:
    return parcels_of(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority"))


def parcels_of(o: DataFrame) -> DataFrame:
    x = ((F.col("id") * 7919) % 20000) / 10.0
    y = ((F.col("id") * 104729) % 20000) / 10.0
    s = (F.lit(1) + F.col("id") % 17).cast("double")
    return o.select(
        "id", "o_custkey", "o_orderpriority",
        x.alias("minx"), y.alias("miny"), (x + s).alias("maxx"), (y + s).alias("maxy"),
    )


CTE["parcels"] = """
SELECT o_orderkey AS id, o_custkey, o_orderpriority,
 ((o_orderkey*7919) % 20000)/10.0 AS minx, ((o_orderkey*104729) % 20000)/10.0 AS miny,
 ((o_orderkey*7919) % 20000)/10.0 + CAST(1 + o_orderkey % 17 AS DOUBLE) AS maxx,
 ((o_orderkey*104729) % 20000)/10.0 + CAST(1 + o_orderkey % 17 AS DOUBLE) AS maxy
FROM orders"""


def parcel_geoms(spark, sf) -> DataFrame:
    return parcels(spark, sf).withColumn("geom", G.rect("minx", "miny", "maxx", "maxy"))


# --- L-shaped plots with a square hole; even ids are wound clockwise ---------------------------

def plots(spark, sf) -> DataFrame:
    p = parcels(spark, sf).select("id", "minx", "miny", (F.col("maxx") - F.col("minx")).alias("s"))
    x, y, s = F.col("minx"), F.col("miny"), F.col("s")
    shell = F.array(
        G.vertex(x, y), G.vertex(x + s, y), G.vertex(x + s, y + s / 2), G.vertex(x + s / 2, y + s / 2),
        G.vertex(x + s / 2, y + s), G.vertex(x, y + s), G.vertex(x, y),
    )
    shell = F.when(F.col("id") % 2 == 0, F.reverse(shell)).otherwise(shell)
    hole = G.rect_ring(x + s / 8, y + s / 8, x + s / 4, y + s / 4)
    return p.select("id", "minx", "miny", "s", G.polygon(shell, hole).alias("geom"))


CTE["plots"] = """
SELECT id, minx AS x, miny AS y, maxx - minx AS s FROM /*parcels*/ parcels"""


# --- geographic points from customers and suppliers --------------------------------------------

def points(spark, sf) -> DataFrame:
    def derive(table, key, prefix):
        k = F.col(key)
        return load(spark, sf, table).select(
            F.concat(F.lit(prefix), k.cast("string")).alias("id"), F.lit(prefix).alias("src"),
            (((k * 7919) % 36000) / 100.0 - 180.0).alias("lon"),
            (((k * 104729) % 16000) / 100.0 - 80.0).alias("lat"),
        )

    return derive("customer", "c_custkey", "C").unionByName(derive("supplier", "s_suppkey", "S"))


CTE["points"] = """
SELECT 'C' || c_custkey AS id, 'C' AS src, ((c_custkey*7919) % 36000)/100.0 - 180.0 AS lon,
 ((c_custkey*104729) % 16000)/100.0 - 80.0 AS lat FROM customer
UNION ALL
SELECT 'S' || s_suppkey, 'S', ((s_suppkey*7919) % 36000)/100.0 - 180.0,
 ((s_suppkey*104729) % 16000)/100.0 - 80.0 FROM supplier"""


# --- polylines along a 10-unit grid: a third end off the grid, one start in fifty is 5 mm off ------

def lines(spark, sf) -> DataFrame:
    return lines_of(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"))


def lines_of(o: DataFrame) -> DataFrame:
    k = F.col("id")
    x = ((k % 300) * 10).cast("double")
    y = ((F.floor(k / 300) % 500) * 10).cast("double")
    return o.select(
        "id", "o_custkey", (x + F.when(k % 50 == 0, 0.005).otherwise(0.0)).alias("x1"), y.alias("y1"),
        (x + 5.0).alias("x2"), y.alias("y2"), (x + 10.0).alias("x3"),
        (y + F.when(k % 3 == 0, 5.0).otherwise(0.0)).alias("y3"),
    )


CTE["lines"] = """
SELECT o_orderkey AS id, o_custkey,
 (o_orderkey % 300)*10 + CASE WHEN o_orderkey % 50 = 0 THEN 0.005::DOUBLE ELSE 0.0::DOUBLE END AS x1,
 CAST(((o_orderkey // 300) % 500)*10 AS DOUBLE) AS y1,
 (o_orderkey % 300)*10 + 5.0::DOUBLE AS x2, CAST(((o_orderkey // 300) % 500)*10 AS DOUBLE) AS y2,
 (o_orderkey % 300)*10 + 10.0::DOUBLE AS x3,
 ((o_orderkey // 300) % 500)*10 + CASE WHEN o_orderkey % 3 = 0 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS y3
FROM orders"""


def line_geoms(spark, sf) -> DataFrame:
    path = F.array(G.vertex("x1", "y1"), G.vertex("x2", "y2"), G.vertex("x3", "y3"))
    return lines(spark, sf).withColumn("geom", G.line(path))


# --- source elements from part -------------------------------------------------------------------

def elements(spark, sf) -> DataFrame:
    return elements_of(load(spark, sf, "part"))


def elements_of(p: DataFrame) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "Point").when(F.col("p_size") % 3 == 1, "Line").otherwise("Polygon")
    layer = F.upper(F.get(F.split("p_name", " "), F.lit(1)))
    area = F.when(kind == "Polygon", F.col("p_retailprice"))
    length = F.when(kind != "Point", F.col("p_size").cast("double"))
    attrs = F.map_filter(
        F.create_map(
            F.lit("Layer"), layer, F.lit("Color"), F.col("p_brand"),
            F.lit("Linetype"), F.when(F.col("p_partkey") % 4 == 0, "DASHED").otherwise("CONTINUOUS"),
            F.lit("BlockName"), F.when(kind == "Point", F.concat(F.lit("BLK_"), F.col("p_type"))),
            F.lit("XData"), F.when(F.col("p_partkey") % 10 == 0, "ACAD_REV,SURVEY"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return p.select(
        F.col("p_partkey").alias("element_id"), F.lit(1).alias("doc_id"), layer.alias("layer"),
        F.col("p_type").alias("native_type"), kind.alias("geometry_kind"), F.col("p_name").alias("text"),
        attrs.alias("attrs"), area.alias("area"), length.alias("length"), F.col("p_partkey").alias("pos"),
    )


CTE["elements"] = """
SELECT p_partkey AS element_id, 1 AS doc_id, upper(split_part(p_name,' ',2)) AS layer, p_type AS native_type,
 CASE p_size % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'Line' ELSE 'Polygon' END AS geometry_kind,
 p_name AS text, p_brand AS color,
 CASE WHEN p_partkey % 4 = 0 THEN 'DASHED' ELSE 'CONTINUOUS' END AS linetype,
 CASE WHEN p_size % 3 = 0 THEN 'BLK_' || p_type END AS block,
 CASE WHEN p_partkey % 10 = 0 THEN 'ACAD_REV,SURVEY' END AS xdata,
 CASE WHEN p_size % 3 = 2 THEN p_retailprice END AS area,
 CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS length,
 p_partkey AS pos
FROM part"""


# --- long attributes from line items, with blanks, leading zeros and mixed types ---------------------

ATTR_NAMES = ("QTY", "PRICE", "CODE", "FLAG", "SHIPPED", "MIXED", "NOTE")


def attrs_values(spark, sf) -> DataFrame:
    """``layer, element_id, pos`` and the texts of ``ATTR_NAMES`` of a line item; the id joins the line's keys and its price."""
    li = load(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    value = {
        "QTY": F.col("l_quantity").cast("int").cast("string"),
        "PRICE": F.format_string("%.2f", F.col("l_extendedprice")),
        "CODE": F.lpad(F.col("l_partkey").cast("string"), 8, "0"),
        "FLAG": F.when(k % 2 == 0, "true").otherwise("False"),
        "SHIPPED": F.date_format("l_shipdate", "yyyy-MM-dd"),
        "MIXED": F.when(F.col("l_partkey") % 97 == 0, "n/a").otherwise(F.col("l_suppkey").cast("string")),
        "NOTE": F.when(k % 5 == 0, "").when(k % 5 != 1, F.concat(F.lit("note "), F.col("l_returnflag"))),
    }
    return li.select(
        F.concat(F.lit("L-"), F.col("l_returnflag")).alias("layer"),
        F.concat_ws("-", k, "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("element_id"),
        (k * 10 + F.col("l_linenumber")).alias("pos"), *[value[n].alias(n) for n in ATTR_NAMES])


def attr_entries(value) -> Column:
    """The entries ``name, value`` of a row of ``attrs_values``; ``value`` gives the column of a name."""
    return F.array(*[F.struct(F.lit(n).alias("name"), value(n).alias("value")) for n in ATTR_NAMES])


def attrs_long(spark, sf) -> DataFrame:
    """``(layer, element_id, pos, name, value)``, a row for each of ``ATTR_NAMES``."""
    return attrs_values(spark, sf).select("layer", "element_id", "pos", F.explode(attr_entries(F.col)).alias("e")).select("layer", "element_id", "pos", "e.name", "e.value")


CTE["attrs_wide"] = """
SELECT 'L-' || l_returnflag AS layer,
 l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice*100) AS BIGINT) AS element_id,
 l_orderkey*10 + l_linenumber AS pos,
 CAST(CAST(l_quantity AS INT) AS VARCHAR) AS "QTY", printf('%.2f', l_extendedprice) AS "PRICE",
 lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS "CODE",
 CASE WHEN l_orderkey % 2 = 0 THEN 'true' ELSE 'False' END AS "FLAG",
 strftime(l_shipdate, '%Y-%m-%d') AS "SHIPPED",
 CASE WHEN l_partkey % 97 = 0 THEN 'n/a' ELSE CAST(l_suppkey AS VARCHAR) END AS "MIXED",
 CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 5 <> 1 THEN 'note ' || l_returnflag END AS "NOTE"
FROM lineitem"""

CTE["attrs_long"] = "\nUNION ALL ".join(
    f"SELECT layer, element_id, pos, '{n}' AS name, \"{n}\" AS value FROM /*attrs_wide*/ attrs_wide"
    for n in ATTR_NAMES
)


# --- semantic relations: customer -> nation -> region, some ids dangling ---------------------------

def bim_elements(spark, sf) -> DataFrame:
    """Regions are sites, nations storeys, customers hosted products; raw relation ids as attributes."""
    r = load(spark, sf, "region").select(
        F.concat(F.lit("R"), "r_regionkey").alias("element_id"), F.lit("IfcSite").alias("category"),
        F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"),
        F.lit(None).cast("string").alias("host_id"), F.lit(None).cast("string").alias("storey_id"),
        F.lit(0.0).alias("elevation"),
    )
    n = load(spark, sf, "nation").select(
        F.concat(F.lit("N"), "n_nationkey"), F.lit("IfcBuildingStorey"), "n_name",
        F.concat(F.lit("R"), "n_regionkey"), F.lit(None).cast("string"), F.lit(None).cast("string"),
        F.col("n_nationkey") * 3.5,
    )
    k = F.col("c_custkey")
    cat = (
        F.when(k % 5 == 0, "IfcDoor").when(k % 5 == 1, "IfcWindow").when(k % 5 == 2, "Door").otherwise("IfcWall")
    )
    host = F.when(cat != "IfcWall", F.when(k % 11 != 0, F.concat(F.lit("C"), (k - k % 5 + 3).cast("string"))))
    c = load(spark, sf, "customer").select(
        F.concat(F.lit("C"), k.cast("string")), cat, "c_name",
        F.concat(F.lit("N"), F.when(k % 13 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).cast("string")),
        host, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.col("c_acctbal"),
    )
    return r.union(n).union(c)


CTE["bim"] = """
SELECT 'R' || r_regionkey AS element_id, 'IfcSite' AS category, r_name AS name, NULL::VARCHAR AS parent_id,
  NULL::VARCHAR AS host_id, NULL::VARCHAR AS storey_id, 0.0::DOUBLE AS elevation FROM region
UNION ALL SELECT 'N' || n_nationkey, 'IfcBuildingStorey', n_name, 'R' || n_regionkey, NULL, NULL, n_nationkey*3.5::DOUBLE FROM nation
UNION ALL SELECT 'C' || c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN 'IfcDoor' WHEN 1 THEN 'IfcWindow' WHEN 2 THEN 'Door' ELSE 'IfcWall' END, c_name,
  'N' || (CASE WHEN c_custkey % 13 = 0 THEN 99 ELSE c_nationkey END),
  CASE WHEN c_custkey % 5 < 3 AND c_custkey % 11 <> 0 THEN 'C' || (c_custkey - c_custkey % 5 + 3) END,
  'N' || c_nationkey, c_acctbal FROM customer"""


# --- findings and runs from events -----------------------------------------------------------------

SEVERITY_OF_EVENT = {"view": 0, "click": 0, "signup": 1, "purchase": 2, "error": 3}  # fixed values


def findings(spark, sf) -> DataFrame:
    e = load(spark, sf, "events")
    rank = (
        F.when(F.col("event_type").isin("view", "click"), 0).when(F.col("event_type") == "signup", 1)
        .when(F.col("event_type") == "purchase", 2).otherwise(3)
    )
    return e.select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("run_id"),
        rank.cast("int").alias("severity"), (F.col("event_id") % 8).cast("int").alias("category"),
        F.concat(F.lit("Rule."), F.col("event_type")).alias("code"),
        F.concat(F.lit("DS"), (F.col("user_id") % 3).cast("string")).alias("dataset"), F.col("ts").alias("at"),
        F.col("value"),
    )


CTE["findings"] = """
SELECT event_id AS pos, user_id AS run_id,
 CASE WHEN event_type IN ('view','click') THEN 0 WHEN event_type='signup' THEN 1 WHEN event_type='purchase' THEN 2 ELSE 3 END AS severity,
 CAST(event_id % 8 AS INT) AS category, 'Rule.' || event_type AS code, 'DS' || (user_id % 3) AS dataset, ts AS at, value
FROM events"""


def runs(spark, sf) -> DataFrame:
    """One run per (user, day): started at its first event and, unless every eleventh, finished."""
    e = load(spark, sf, "events")
    day = F.date_format("ts", "yyyyMMdd").cast("int")
    return e.groupBy(F.col("user_id"), day.alias("day")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events"),
        F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("had_error"),
        F.min("event_id").alias("first_event"),
    ).select(
        (F.col("user_id") * 100000000 + F.col("day")).alias("run_id"),
        F.col("user_id").alias("job_id"), (F.col("user_id") % 10).alias("project_id"), "started_at",
        F.when(F.col("first_event") % 11 != 0, F.col("last_ts")).alias("finished_at"),
        F.when(F.col("first_event") % 11 == 0, "Running")
        .when(F.col("first_event") % 7 == 0, "Failed")
        .when(F.col("had_error") == 1, "SucceededWithWarnings").otherwise("Succeeded").alias("status"),
        F.when(F.col("had_error") == 1, 2).otherwise(0).alias("severity"), "n_events",
    )


CTE["runs"] = """
SELECT user_id*100000000 + CAST(strftime(ts,'%Y%m%d') AS INT) AS run_id, user_id AS job_id, user_id % 10 AS project_id,
 min(ts) AS started_at, CASE WHEN min(event_id) % 11 <> 0 THEN max(ts) END AS finished_at,
 CASE WHEN min(event_id) % 11 = 0 THEN 'Running' WHEN min(event_id) % 7 = 0 THEN 'Failed'
   WHEN max(CASE WHEN event_type='error' THEN 1 ELSE 0 END) = 1 THEN 'SucceededWithWarnings' ELSE 'Succeeded' END AS status,
 CASE WHEN max(CASE WHEN event_type='error' THEN 1 ELSE 0 END) = 1 THEN 2 ELSE 0 END AS severity, count(*) AS n_events
FROM events GROUP BY user_id, strftime(ts,'%Y%m%d')"""
