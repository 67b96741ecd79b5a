"""Sinks: SARIF, JSON, CSV, report blocks and context bundles, a text column for each project or row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta.functions.columns import blank, fingerprint
from vetta.schemas import SEVERITY, STATUS


# Columns that reports show where findings have them.
OPTIONAL = {
    "cvss": "struct<score: double, vector: string>", "line_end": "int", "function": "string", "snippet": "string", "description": "string", "impact": "string", "remediation": "string",
    "references": "array<string>", "flow_trace": "struct<source: string, sink: string, path: array<string>>", "evidence": "array<struct<type: string, description: string, trace: array<string>>>", "confidence": "string", "status": "string",
}


def complete(findings: DataFrame) -> DataFrame:
    """findings with a null column for each optional one that is missing."""
    return findings.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in findings.columns})


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rules(findings: DataFrame, project: str) -> DataFrame:
    """A rule for each CWE (else id) of a project, with its index; its text is the first finding's."""
    rule = F.when(blank(F.col("cwe")), F.col("id")).otherwise(F.upper("cwe"))
    first = findings.groupBy(project, rule.alias("rule")).agg(F.min_by(F.struct("title", "severity"), "id").alias("f"), F.min("id").alias("_at"))
    return first.select(project, "rule", "f.title", "f.severity", (F.row_number().over(Window.partitionBy(project).orderBy("_at")) - 1).alias("index"))


def sarif_results(findings: DataFrame, project: str, suppressed: DataFrame | None = None) -> DataFrame:
    """A SARIF result as JSON for each finding. suppressed: (id, reason)."""
    rule = F.when(blank(F.col("cwe")), F.col("id")).otherwise(F.upper("cwe"))
    findings = complete(findings)
    rows = findings.withColumn("rule", rule).join(sarif_rules(findings, project).select(project, "rule", "index"), [project, "rule"])
    rows = rows.join(suppressed.select("id", "reason"), "id", "left") if suppressed is not None else rows.withColumn("reason", F.lit(None).cast("string"))
    some = lambda c: F.when(~blank(F.col(c)), F.struct(F.col(c).alias("text")))
    uri = F.struct(F.col("file").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    region = F.when(F.col("line_start") > 0, F.struct(F.col("line_start").alias("startLine"), F.when(F.col("line_end") > 0, F.col("line_end")).alias("endLine"), some("snippet").alias("snippet")))
    at = F.struct(F.struct(uri.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    # From the source over the steps to the sink, all in the finding's file.
    steps = F.concat(F.array(F.concat(F.lit("Source: "), "flow_trace.source")), F.coalesce("flow_trace.path", F.array().cast("array<string>")), F.array(F.concat(F.lit("Sink: "), "flow_trace.sink")))
    places = F.transform(steps, lambda x: F.struct(F.struct(F.struct(uri.alias("artifactLocation")).alias("physicalLocation")).alias("location"), F.struct(x.alias("text")).alias("message")))
    flows = F.when(F.col("flow_trace").isNotNull(), F.array(F.struct(F.array(F.struct(places.alias("locations"))).alias("threadFlows"))))
    own = fingerprint(F.col("cwe"), F.col("file"), F.col("function"), F.col("title"))
    printed = F.when(blank(F.col("fingerprint")), own).otherwise(F.col("fingerprint")) if "fingerprint" in findings.columns else own
    dismissed = F.array(F.struct(F.lit("external").alias("kind"), F.lit("accepted").alias("status"), F.col("reason").alias("justification")))
    result = F.struct(
        F.col("rule").alias("ruleId"), F.col("index").alias("ruleIndex"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(at).alias("locations"), flows.alias("codeFlows"),
        F.struct(printed.alias("finding/v1")).alias("partialFingerprints"), F.when(F.col("reason").isNotNull(), dismissed).alias("suppressions"), F.struct("id", "confidence", "status", "cvss").alias("properties"),
    )
    return rows.select(project, "id", F.to_json(result).alias("result"))


def to_sarif(findings: DataFrame, project: str, suppressed: DataFrame | None = None) -> DataFrame:
    """A SARIF document for each project, from its results in order of id."""
    rules = sarif_rules(findings, project).groupBy(project).agg(F.array_sort(F.collect_list(F.struct("index", F.struct(F.col("rule").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration")).alias("rule")))).alias("rules"))
    results = sarif_results(findings, project, suppressed).groupBy(project).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "result"))), lambda x: x["result"]), ",").alias("results"))
    head = F.to_json(F.struct(F.lit("vetta").alias("name"), F.transform("rules", lambda x: x["rule"]).alias("rules")))
    return rules.join(results, project).select(project, F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":'), head, F.lit('},"results":['), "results", F.lit("]}]}")).alias("sarif"))


def to_json_report(findings: DataFrame, project: str, tool: str = "vetta", version: str = "1") -> DataFrame:
    """The head of a JSON report for each project: metadata and counts by severity and status. Its findings are the rows of json_findings()."""
    counts = [F.count_if(F.col(c) == x).alias(x) for c, values in (("severity", SEVERITY), ("status", STATUS)) for x in values]
    by = findings.groupBy(project).agg(F.count(F.lit(1)).alias("total"), *counts)
    metadata = F.struct(F.lit(tool).alias("tool"), F.lit(version).alias("version"), F.col(project).alias("project_name"))
    summary = F.struct("total", F.struct(*SEVERITY).alias("by_severity"), F.struct(*STATUS).alias("by_status"))
    return by.select(project, F.to_json(F.struct(metadata.alias("metadata"), summary.alias("summary"))).alias("report"))


def json_findings(findings: DataFrame, project: str) -> DataFrame:
    """Each finding with all its columns as JSON: a row each, so that a project's report can be as long as it likes."""
    return findings.select(project, "id", F.to_json(F.struct(*[c for c in findings.columns if c != project])).alias("finding"))


def to_csv_rows(findings: DataFrame) -> DataFrame:
    """Findings as the 19 text columns of a CSV file: scores with one decimal, lists joined by `; `, times as yyyy-MM-dd HH:mm:ss, no line number for 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    line = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise("").alias(c)
    joined = lambda c: F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c)
    score = F.coalesce(F.format_string("%.1f", "cvss.score"), F.lit(""))
    return complete(findings).select(
        "id", text("title"), text("severity"), text("confidence"), text("status"), text("cwe"), F.when(F.col("cvss").isNull(), "").otherwise(score).alias("cvss_score"), F.coalesce("cvss.vector", F.lit("")).alias("cvss_vector"),
        text("file"), line("line_start"), line("line_end"), text("function"), text("description"), text("impact"), text("remediation"), joined("tags"), joined("references"),
        F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd HH:mm:ss").alias("created_at"), text("created_by"),
    )


def to_report_blocks(findings: DataFrame) -> DataFrame:
    """A Markdown block for each finding."""
    place = F.concat(F.lit("- **File:** `"), "file", F.lit(":"), F.col("line_start").cast("string"), F.lit("`"))
    block = F.concat_ws("\n", F.concat(F.lit("### "), "id", F.lit(": "), "title"), F.concat(F.lit("- **Severity:** "), "severity"), F.when(~blank(F.col("cwe")), F.concat(F.lit("- **CWE:** "), "cwe")), place, F.when(~blank(F.col("description")), F.concat(F.lit("\n"), "description")))
    return findings.select("id", block.alias("block"))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_html_rows(findings: DataFrame) -> DataFrame:
    cells = [html_escape(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "title", "severity", "file")]
    return findings.select("id", F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>")).alias("row"))


def context_bundle(projects: DataFrame, memories: DataFrame, findings: DataFrame, agents: DataFrame) -> DataFrame:
    """(project, bundle): each project's notes, agents and finding counts as JSON. All have a column project."""
    m = memories.groupBy("project").agg(F.array_sort(F.collect_set("name")).alias("memories"))
    f = findings.groupBy("project").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("status") == "open").alias("open"))
    a = agents.groupBy("project").agg(F.array_sort(F.collect_set("agent")).alias("agents"))
    rows = projects.select("project").distinct().join(m, "project", "left").join(f, "project", "left").join(a, "project", "left")
    return rows.select("project", F.to_json(F.struct("project", "memories", "findings", "open", "agents")).alias("bundle"))
