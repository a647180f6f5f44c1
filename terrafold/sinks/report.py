"""Quality report outputs: CSV with fixed columns, JSON lines with a summary, and HTML rows by rule or category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import plain_number, xml_escape
from ..operators.quality import CRITICAL, SEVERITIES, report_summary, severity_name

CSV_COLUMNS = ("severity", "category", "code", "message", "layer", "featureId", "field", "x", "y", "remediation", "detectedUtc")  # fixed values


def csv_rows(findings: DataFrame, min_severity: int = 0) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    num = lambda c: F.coalesce(plain_number(F.col(c)), F.lit(""))
    at = F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if "detected_at" in findings.columns else F.lit("")
    vals = [severity_name("severity"), F.col("category"), F.col("code"), F.col("message"), text("dataset"), text("feature_id"), text("field"), num("x"), num("y"), text("remediation"), at]
    return findings.where(F.col("severity") >= min_severity).select(*[v.alias(n) for v, n in zip(vals, CSV_COLUMNS)])


def json_rows(findings: DataFrame, min_severity: int = 0) -> DataFrame:
    """One finding per row as ``value``; members without a value are left out."""
    loc = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))
    body = F.struct(severity_name("severity").alias("severity"), "category", "code", "message", F.col("dataset").alias("layer"),
                    F.col("feature_id").cast("string").alias("featureId"), "field", loc.alias("location"), "remediation")
    return findings.where(F.col("severity") >= min_severity).select(F.to_json(body).alias("value"))


def json_summary(findings: DataFrame, fail_at: int = CRITICAL) -> DataFrame:
    s = report_summary(findings, fail_at)
    return s.select(F.to_json(F.struct("total", severity_name("highest").alias("highestSeverity"), "acceptable", *[F.col(n.lower()).alias(n[0].lower() + n[1:]) for n in SEVERITIES])).alias("value"))


def html_rows(findings: DataFrame, by_rule: bool = True, min_severity: int = 0) -> DataFrame:
    """``section, value``: a table row per finding, its texts encoded, under a rule or category heading."""
    e = lambda c: F.coalesce(xml_escape(F.col(c).cast("string")), F.lit(""))
    sev = severity_name("severity")
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat(plain_number(F.col("x")), F.lit(", "), plain_number(F.col("y")))).otherwise("")
    note = F.when(F.col("remediation").isNotNull(), F.concat(F.lit('<div class="rem">'), e("remediation"), F.lit("</div>"))).otherwise("")
    row = F.concat(F.lit('<tr><td class="sev '), sev, F.lit('">'), sev, F.lit("</td><td>"), F.coalesce(xml_escape(F.col("feature_id").cast("string")), F.lit("&mdash;")), F.lit("</td><td>"),
                   e("field"), F.lit("</td><td>"), place, F.lit("</td><td>"), e("message"), note, F.lit("</td></tr>"))
    return findings.where(F.col("severity") >= min_severity).select(F.col("code" if by_rule else "category").alias("section"), row.alias("value"))


def write_report(findings: DataFrame, path: str, formats=("csv", "json", "html"), min_severity: int = 0, fail_at: int = CRITICAL, by_rule: bool = True) -> None:
    base = path.rstrip("/")
    if "csv" in formats:
        csv_rows(findings, min_severity).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(base + "/csv")
    if "json" in formats:
        json_rows(findings, min_severity).write.mode("overwrite").text(base + "/json/findings")
        json_summary(findings, fail_at).write.mode("overwrite").text(base + "/json/summary")
    if "html" in formats:
        # One directory per section; its row files hold the table body.
        html_rows(findings, by_rule, min_severity).write.mode("overwrite").partitionBy("section").text(base + "/html")
