"""Queries over runs, jobs, projects and their findings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import ledger as L
from . import derive as V
from .derive import with_sql
from .registry import load, query

FROM, TO = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)
ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')".format


@query("runs_by_specification", with_sql("runs", body="""
SELECT run_id FROM runs WHERE (finished_at >= TIMESTAMP '2024-01-10' AND finished_at < TIMESTAMP '2024-01-20' AND project_id = 3 AND (status IN ('Failed','SucceededWithWarnings') OR severity >= 2)) OR (status = 'Running' AND project_id <> 3)"""))
def runs_by_specification(spark, sf):
    spec = (L.finished_between(FROM, TO) & L.of_project(3) & L.needs_attention()) | (L.has_status("Running") & ~L.of_project(3))
    return L.runs_where(V.runs(spark, sf), spec).select("run_id")


@query("latest_run_per_job", with_sql("runs", body="SELECT job_id, max(started_at) IS NOT NULL AS found, max_by(run_id, started_at) AS run_id, max_by(status, started_at) AS status FROM runs GROUP BY 1"))
def latest_run_per_job(spark, sf):
    return L.latest_runs(V.runs(spark, sf)).select("job_id", F.col("started_at").isNotNull().alias("found"), "run_id", "status")


@query("recent_runs", with_sql("runs", body="SELECT run_id, status FROM runs WHERE project_id = 4 ORDER BY started_at DESC, run_id DESC LIMIT 25"))
def recent_runs(spark, sf):
    return L.recent_runs(V.runs(spark, sf), 4, 25).select("run_id", "status")


def projects(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy((F.col("user_id") % 40).alias("project_id")).agg(
        F.min("ts").alias("created_at"), F.max(F.when((F.col("user_id") % 3 == 0) & (F.col("event_type") == "error"), F.col("ts"))).alias("modified_at")).withColumn(
        "name", F.concat(F.lit("Project "), (F.col("project_id") % 7).cast("string")))


V.CTE["projects"] = """SELECT user_id % 40 AS project_id, min(ts) AS created_at, max(CASE WHEN user_id % 3 = 0 AND event_type = 'error' THEN ts END) AS modified_at, 'Project ' || (user_id % 40 % 7) AS name FROM events GROUP BY 1"""


@query("recent_projects", with_sql("projects", body="SELECT project_id, name FROM projects ORDER BY coalesce(modified_at, created_at) DESC, project_id LIMIT 12"))
def recent_projects(spark, sf):
    return L.recent_projects(projects(spark, sf), 12).select("project_id", "name")


@query("projects_with_jobs", with_sql("projects", "runs", body="""
SELECT p.project_id, (SELECT count(DISTINCT job_id) FROM runs r WHERE r.project_id = p.project_id) AS n_jobs, coalesce((SELECT string_agg(DISTINCT job_id, ',' ORDER BY job_id) FROM runs r WHERE r.project_id = p.project_id), '') AS jobs
FROM projects p WHERE contains(name, '3') OR contains(name, 'Project')"""))
def projects_with_jobs(spark, sf):
    j = V.runs(spark, sf).select("project_id", "job_id").distinct()
    p = L.projects_with_jobs(projects(spark, sf), j, "project")
    return p.select("project_id", F.size("jobs").cast("long").alias("n_jobs"), F.array_join("jobs", ",").alias("jobs"))


def run_findings(spark, sf):
    """Findings keyed by the run of their user and day."""
    f = V.findings(spark, sf)
    return f.withColumn("run_id", F.col("run_id") * 100000000 + F.date_format("at", "yyyyMMdd").cast("int"))


V.CTE["run_findings"] = """SELECT pos, run_id*100000000 + CAST(strftime("at",'%Y%m%d') AS INT) AS run_id, severity, code, dataset FROM /*findings*/ findings"""


@query("project_finding_count", with_sql("run_findings", "runs", body="SELECT count(*) AS n FROM run_findings f JOIN runs USING (run_id) WHERE project_id = 2 AND f.severity = 3"))
def project_finding_count(spark, sf):
    return L.count_findings(run_findings(spark, sf), V.runs(spark, sf), 2, 3)


@query("terminal_status", with_sql("run_findings", "runs", body="""
SELECT run_id, CASE WHEN finished_at IS NOT NULL AND status NOT IN ('Failed','Cancelled') THEN CASE WHEN w >= 1 THEN 'SucceededWithWarnings' ELSE 'Succeeded' END ELSE status END AS terminal_status
FROM runs LEFT JOIN (SELECT run_id, max(severity) AS w FROM run_findings GROUP BY 1) USING (run_id)"""))
def terminal_status(spark, sf):
    return L.run_status(V.runs(spark, sf), run_findings(spark, sf)).select("run_id", "terminal_status")


@query("run_summaries", with_sql("run_findings", "runs", body="""
SELECT run_id, count(f.pos) AS findings, count(*) FILTER (f.severity = 3) AS critical, coalesce(max(f.severity), 0) AS highest, (SELECT count(*) FROM orders WHERE o_custkey % 1000 = run_id // 100000000 % 1000) AS features
FROM runs LEFT JOIN run_findings f USING (run_id) GROUP BY run_id"""))
def run_summaries(spark, sf):
    r = V.runs(spark, sf)
    per_user = load(spark, sf, "orders").select((F.col("o_custkey") % 1000).alias("_u"), F.col("o_orderpriority").alias("feature_class"))
    feats = r.select("run_id", (F.col("job_id") % 1000).alias("_u")).join(per_user, "_u").select("run_id", "feature_class")
    return L.run_summaries(r.select("run_id"), run_findings(spark, sf), feats).select("run_id", "findings", "critical", "highest", "features")


@query("pruned_ledger", with_sql("run_findings", "runs", body="""
SELECT 'runs' AS what, count(*) AS n FROM runs WHERE finished_at IS NULL OR finished_at >= TIMESTAMP '2024-01-10'
UNION ALL SELECT 'findings', count(*) FROM run_findings WHERE run_id NOT IN (SELECT run_id FROM runs WHERE finished_at < TIMESTAMP '2024-01-10')"""))
def pruned_ledger(spark, sf):
    r, f = L.prune(V.runs(spark, sf), run_findings(spark, sf), FROM)
    n = lambda d, what: d.groupBy(F.lit(what).alias("what")).agg(F.count("*").alias("n"))
    return n(r, "runs").unionByName(n(f, "findings"))


@query("findings_of_run", with_sql("run_findings", body="SELECT pos, severity, code FROM run_findings WHERE run_id = (SELECT min(run_id) FROM run_findings WHERE run_id // 100000000 = 7)"))
def findings_of_run(spark, sf):
    f = run_findings(spark, sf)
    first = f.where(F.floor(F.col("run_id") / 100000000) == 7).agg(F.min("run_id").alias("run_id"))
    return f.join(first, "run_id").select("pos", "severity", "code")


@query("runs_per_window", with_sql("runs", body=f"SELECT {TS('date_trunc(' + chr(39) + 'day' + chr(39) + ', finished_at)')} AS window_start, status, count(*) AS n FROM runs WHERE finished_at IS NOT NULL GROUP BY 1, 2"))
def runs_per_window(spark, sf):
    return L.runs_per_window(V.runs(spark, sf)).withColumn("window_start", ts("window_start"))


def run_events(spark, sf):
    """Seven events to a run in order of their id; types stand for requests to move it."""
    to = F.create_map(*[F.lit(x) for kv in {"view": "Running", "click": "Queued", "signup": "Succeeded", "purchase": "Cancelled", "error": "Failed"}.items() for x in kv])
    return load(spark, sf, "events").select(F.floor(F.col("event_id") / 7).alias("run_id"), F.col("event_id").alias("seq"), to[F.col("event_type")].alias("status"), F.col("ts").alias("at"))


@query("run_state_fold", """
WITH e AS (SELECT event_id // 7 AS run_id, list(CASE event_type WHEN 'view' THEN 'Running' WHEN 'signup' THEN 'Succeeded' WHEN 'purchase' THEN 'Cancelled' ELSE 'Failed' END ORDER BY event_id) AS ev FROM events WHERE event_type <> 'click' GROUP BY 1)
SELECT run_id, split_part(s, '|', 1) AS status, CAST(split_part(s, '|', 2) AS BIGINT) AS illegal FROM (SELECT run_id, list_reduce(list_prepend('Queued|0', ev), lambda s, x: CASE
  WHEN split_part(s, '|', 1) = 'Queued' AND x IN ('Running','Failed','Cancelled') THEN x || '|' || split_part(s, '|', 2)
  WHEN split_part(s, '|', 1) = 'Running' AND x <> 'Running' THEN x || '|' || split_part(s, '|', 2)
  WHEN split_part(s, '|', 1) IN ('Failed','Cancelled') AND x = 'Failed' THEN 'Failed|' || split_part(s, '|', 2)
  ELSE split_part(s, '|', 1) || '|' || (CAST(split_part(s, '|', 2) AS INT) + 1) END) AS s FROM e)""")
def run_state_fold(spark, sf):
    return L.fold_runs(run_events(spark, sf)).select("run_id", "status", "illegal")
