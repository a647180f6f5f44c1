"""Streaming queries, drained over the whole table; each has the SQL of its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.build import BuildProfile
from ..streaming import features as T
from ..streaming.drain import drain, drain_batches
from . import algebra
from . import derive as V
from .classification import RULES
from .derive import with_sql
from .ledger import TS, ts
from .registry import ORACLES, load, query


def stream_of(spark, sf, table):
    return T.landing(spark, sf, load(spark, sf, table).schema, glob=f"{table}.parquet")


def _parcels(spark, sf):
    """The parcel view over a stream of orders."""
    o = stream_of(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    x, y = ((F.col("id") * 7919) % 20000) / 10.0, ((F.col("id") * 104729) % 20000) / 10.0
    s = (F.lit(1) + F.col("id") % 17).cast("double")
    return o.select("id", x.alias("minx"), y.alias("miny"), (x + s).alias("maxx"), (y + s).alias("maxy"))


@query("stream_feature_build", with_sql("parcels", body="""
SELECT id, CASE WHEN id % 6 = 0 THEN 'empty' ELSE 'written' END AS status, CASE WHEN id % 6 <> 0 THEN 'MultiPolygon' END AS kind, CASE WHEN id % 6 <> 0 THEN round((maxx-minx)*(maxy-miny), 4) END AS area FROM parcels"""))
def stream_feature_build(spark, sf):
    d = _parcels(spark, sf).withColumn("geom", F.when(F.col("id") % 6 != 0, G.rect("minx", "miny", "maxx", "maxy")))
    f = T.stream_features(d, BuildProfile(orientation="Clockwise", promote=True))
    return drain(f.select("id", "status", F.col("geom.kind").alias("kind"), F.round(F.when(F.col("geom").isNotNull(), G.st_area("geom")), 4).alias("area")))


@query("stream_clip", ORACLES.get("clip_to_box"))
def stream_clip(spark, sf):
    c = T.stream_clip(_parcels(spark, sf), (250, 125, 1250, 1700))
    return drain(c.select("id", "covered", F.round((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), 6).alias("area")))


@query("stream_simplified_build", ORACLES.get("simplified_build"))
def stream_simplified_build(spark, sf):
    """The whole build, batch by batch."""
    made = drain_batches(algebra.bumps_of(stream_of(spark, sf, "orders")), T.build_batch(BuildProfile(simplify_tol=1.0)))
    n = made["findings"].select(F.col("pos").alias("p"), "code")
    return made["features"].join(n, F.col("pos") == F.col("p"), "left").select(F.col("pos").alias("id"), "status", F.size(G.vertices("geom")).cast("long").alias("n"), "code")


@query("stream_clip_shapes", f"SELECT * FROM ({algebra.CLIPPED}) WHERE id NOT LIKE 'S%'")
def stream_clip_shapes(spark, sf):
    """Polygons and lines of a stream by one long outline."""
    o = stream_of(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority")
    plot = V.parcels_of(o).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("id"), G.rect("minx", "miny", "maxx", "maxy").alias("geom"))
    path = F.array(G.vertex("x1", "y1"), G.vertex("x2", "y2"), G.vertex("x3", "y3"))
    line = V.lines_of(o).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("id"), G.line(path).alias("geom"))
    return algebra.measured(drain_batches(plot.unionByName(line), T.clip_batch(algebra.comb(spark), "id"))["clipped"])


@query("stream_classification", ORACLES.get("classification_decision"))
def stream_classification(spark, sf):
    p = stream_of(spark, sf, "part")
    e = V.elements_of(p)
    return drain(T.stream_classify(e, RULES).drop("n_candidates"))


@query("stream_quality", """
SELECT CAST(o_orderkey AS VARCHAR) AS feature_id, 'Geometry.Null' AS code FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'Topology.Sliver' FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0""")
def stream_quality(spark, sf):
    k = F.col("o_orderkey")
    x = k.cast("double")
    g = F.when(k % 7 != 0, G.rect(x, F.lit(0.0), x + 100, F.lit(0.0) + F.when(k % 5 == 0, 0.05).otherwise(5.0)))
    d = stream_of(spark, sf, "orders").select(F.lit("STRIP").alias("dataset"), k.alias("feature_id"), k.alias("pos"), g.alias("geom"))
    return drain(T.stream_qa(d).select("feature_id", "code"))


@query("stream_failure_breaker", ORACLES.get("failure_breaker"))
def stream_failure_breaker(spark, sf):
    """The stream decides where a layer is abandoned; the landed rows are read up to there."""
    of = lambda e: e.select(F.col("event_type").alias("layer"), F.col("event_id").alias("pos"), (F.col("user_id") % 3 != 0).alias("failed"), F.col("ts").alias("at"))
    blocks = drain(T.stream_breaker(of(stream_of(spark, sf, "events")), 9), "update", ["layer", "blk"])
    return T.rows_until_cut(of(load(spark, sf, "events")), T.breaker_cuts(blocks, 9)).select("layer", "pos", "abandoned")


@query("stream_response_cache", ORACLES.get("response_cache"))
def stream_response_cache(spark, sf):
    r = stream_of(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return drain(T.stream_cache(r), "update", ["key", "seq"])


@query("stream_run_status", ORACLES.get("run_state_fold"))
def stream_run_status(spark, sf):
    to = F.create_map(*[F.lit(x) for kv in {"view": "Running", "click": "Queued", "signup": "Succeeded", "purchase": "Cancelled", "error": "Failed"}.items() for x in kv])
    e = stream_of(spark, sf, "events")
    e = e.select(F.floor(F.col("event_id") / 7).alias("run_id"), F.col("event_id").alias("seq"), to[F.col("event_type")].alias("status"), F.col("ts").alias("at"))
    return drain(T.stream_runs(e), "update", ["run_id"])


@query("stream_runs_per_window", f"SELECT {TS('date_trunc(' + chr(39) + 'day' + chr(39) + ', ts)')} AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2")
def stream_runs_per_window(spark, sf):
    e = stream_of(spark, sf, "events").select(F.col("ts").alias("finished_at"), F.col("event_type").alias("status"))
    d = drain(T.runs_per_window(e), "update", ["window_start", "status"])
    return d.withColumn("window_start", ts("window_start"))
