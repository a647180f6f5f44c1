"""Projects, jobs, runs and findings: queries, status rules and housekeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality as Q

# States that end a run.
TERMINAL = ("Succeeded", "SucceededWithWarnings", "Failed", "Cancelled")


def has_status(status: str) -> Column:
    return F.col("status") == status


def _moment(v) -> Column:
    """A wall-clock time as the ledger stores it, whatever the session's zone."""
    return v if isinstance(v, Column) else F.lit(str(v)).cast("timestamp_ntz")


def finished_between(start, end) -> Column:
    """Half-open: from ``start`` up to, not including, ``end``."""
    return F.col("finished_at").isNotNull() & (F.col("finished_at") >= _moment(start)) & (F.col("finished_at") < _moment(end))


def of_project(project) -> Column:
    return F.col("project_id") == F.lit(project)


def needs_attention() -> Column:
    return F.col("status").isin("Failed", "SucceededWithWarnings") | (F.col("severity") >= Q.ERROR)


def runs_where(runs: DataFrame, spec: Column) -> DataFrame:
    return runs.where(spec)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Most recently started run of each job, by one aggregate rather than a sort of each job."""
    cols = [c for c in runs.columns if c != "job_id"]
    return runs.groupBy("job_id").agg(F.max(F.struct("started_at", *[c for c in cols if c != "started_at"])).alias("r")).select("job_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def recent_runs(runs: DataFrame, project, limit: int = 20) -> DataFrame:
    return runs.where(of_project(project)).orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def recent_projects(projects: DataFrame, limit: int = 10) -> DataFrame:
    return projects.withColumn("touched_at", F.coalesce("modified_at", "created_at")).orderBy(F.col("touched_at").desc(), "project_id").limit(limit)


def projects_with_jobs(projects: DataFrame, jobs: DataFrame, name_like: str | None = None) -> DataFrame:
    """Projects with their job ids in order, projects without jobs included."""
    p = projects if name_like is None else projects.where(F.lower("name").contains(name_like.lower()))
    j = jobs.groupBy("project_id").agg(F.sort_array(F.collect_list("job_id")).alias("jobs"))
    return p.join(j, "project_id", "left").withColumn("jobs", F.coalesce("jobs", F.array().cast(j.schema["jobs"].dataType)))


def count_findings(findings: DataFrame, runs: DataFrame, project, severity: int) -> DataFrame:
    f = findings.where(F.col("severity") == severity).select("run_id")
    return f.join(runs.where(of_project(project)).select("run_id"), "run_id").agg(F.count("*").alias("n"))


def run_status(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Finished runs whose findings reach a warning end as succeeded with warnings."""
    worst = findings.groupBy("run_id").agg(F.max("severity").alias("_w"))
    d = runs.join(worst, "run_id", "left")
    ok = F.col("finished_at").isNotNull() & ~F.col("status").isin("Failed", "Cancelled")
    return d.withColumn("terminal_status", F.when(ok, F.when(F.col("_w") >= Q.WARN, "SucceededWithWarnings").otherwise("Succeeded")).otherwise(F.col("status"))).drop("_w")


def fold_runs(events: DataFrame) -> DataFrame:
    """Final state of each run from its ordered events (``run_id, seq, status, at``); a run is born queued.

    Events the current state does not allow are counted and ignored.  A failed or cancelled run may still
    be failed again.  Each step finds the next legal event by an aggregate, so a run with very many events
    is never one sorted list.
    """
    e = events.where(F.col("status") != "Queued").select("run_id", "seq", "status", "at")
    first = lambda cond: F.min(F.when(cond, F.struct("seq", "status", "at")))
    g = e.groupBy("run_id").agg(F.count("*").alias("_n"), first(F.col("status").isin("Running", "Failed", "Cancelled")).alias("_s"))
    d = e.join(g, "run_id")
    done = (F.col("_s.status") == "Running") & F.col("status").isin(*TERMINAL) & (F.col("seq") > F.col("_s.seq"))
    t = d.groupBy("run_id", "_n", "_s").agg(first(done).alias("_t"))
    t = t.withColumn("_e", F.coalesce("_t", F.when(F.col("_s.status") != "Running", F.col("_s"))))
    d = e.join(t.drop("_n"), "run_id").where(F.col("_e.status").isin("Failed", "Cancelled") & (F.col("status") == "Failed") & (F.col("seq") > F.col("_e.seq")))
    again = d.groupBy("run_id").agg(F.count("*").alias("_again"), F.max(F.struct("seq", "at")).alias("_l"))
    r = t.join(again, "run_id", "left")
    legal = F.when(F.col("_s").isNotNull(), 1).otherwise(0) + F.when(F.col("_t").isNotNull(), 1).otherwise(0) + F.coalesce("_again", F.lit(0))
    finish = F.coalesce("_l.at", "_e.at")
    status = F.when(F.col("_again") > 0, "Failed").otherwise(F.coalesce("_e.status", "_s.status", F.lit("Queued")))
    out = r.select("run_id", status.alias("status"), F.coalesce(F.when(F.col("_s.status") == "Running", F.col("_s.at")), F.col("_e.at")).alias("started_at"),
                   finish.alias("finished_at"), (F.col("_n") - legal).alias("illegal"))
    return out.withColumn("duration", F.col("finished_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double"))


def run_summaries(runs: DataFrame, findings: DataFrame, features: DataFrame) -> DataFrame:
    """One row per run: findings by severity, highest severity, features and features per class count."""
    f = findings.groupBy("run_id").agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == i).alias(s.lower()) for i, s in enumerate(Q.SEVERITIES)], F.max("severity").alias("highest"))
    n = features.groupBy("run_id").agg(F.count("*").alias("features"), F.count_distinct("feature_class").alias("classes"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("findings", *[s.lower() for s in Q.SEVERITIES], "highest", "features", "classes")}
    return runs.join(f, "run_id", "left").join(n, "run_id", "left").withColumns(zero)


def prune(runs: DataFrame, findings: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """Runs and findings that remain after dropping runs finished before ``cutoff``; unfinished runs stay."""
    old = runs.where(F.col("finished_at").isNotNull() & (F.col("finished_at") < _moment(cutoff)))
    return runs.where(F.col("finished_at").isNull() | (F.col("finished_at") >= _moment(cutoff))), findings.join(old.select("run_id"), "run_id", "left_anti")


def append_findings(findings: DataFrame, path: str) -> None:
    findings.write.mode("append").partitionBy("run_id").parquet(path)


def findings_for_run(spark, path: str, run_id) -> DataFrame:
    """Read of one run: only its partition is listed and scanned."""
    return spark.read.parquet(path).where(F.col("run_id") == F.lit(run_id))


def runs_per_window(runs: DataFrame, width: str = "1 day") -> DataFrame:
    w = F.window("finished_at", width)
    d = runs.where(F.col("finished_at").isNotNull()).groupBy(w.alias("w"), "status").agg(F.count("*").alias("n"))
    return d.select(F.col("w.start").alias("window_start"), "status", "n")


def rewrite(df: DataFrame, path: str, version: str) -> str:
    """Write a new version directory; readers switch to it by name, so a failed write changes nothing."""
    out = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(out)
    return out


