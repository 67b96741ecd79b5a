"""Documents of any size: rows of text in order, written as parts in a folder a project and read back row by row.

A document is its project's part files, one after the other by name. Nothing holds a
document whole: rows are dealt by ranges of project, section and key, and each range
writes its own part. JSON documents have one item a line, so that a reader takes
them apart by lines.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetta.functions.columns import blank
from vetta.schemas import SEVERITY, STATUS
from vetta.sources.writers import complete, html_escape, sarif_level, sarif_results, sarif_rules

ROW = ("project", "section", "key", "text")


def fixed(projects: DataFrame, section: int, text: Column | str) -> DataFrame:
    """One row of text in each project's section."""
    return projects.select("project", F.lit(section).alias("section"), F.lit("").alias("key"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def items(rows: DataFrame, section: int, key: str, text: Column, separator: str = ",") -> DataFrame:
    """A row of text for each item in order of key; all but a project's first have the separator before them."""
    own = rows.select("project", F.col(key).cast("string").alias("key"), text.alias("text"))
    if not separator:
        return own.select("project", F.lit(section).alias("section"), "key", "text")
    first = own.groupBy("project").agg(F.min("key").alias("_first"))
    told = F.when(F.col("key") == F.col("_first"), F.col("text")).otherwise(F.concat(F.lit(separator), "text"))
    return own.join(first, "project").select("project", F.lit(section).alias("section"), "key", told.alias("text"))


def stacked(*sections: DataFrame) -> DataFrame:
    out = sections[0]
    for more in sections[1:]:
        out = out.unionByName(more)
    return out


def write_documents(rows: DataFrame, path: str) -> None:
    """rows (project, section, key, text) as text files, a folder a project; keys are unique in a section."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["project", "section", "key"]
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("project", "text").write.partitionBy("project").text(path)


def read_items(spark: SparkSession, path: str, schema: str, begins: str) -> DataFrame:
    """project and the fields of a schema for each line of JSON documents that is an item which begins so."""
    lines = spark.read.schema("value string, project string").text(path).select("project", F.regexp_replace("value", "^,", "").alias("line"))
    return lines.where(F.col("line").startswith(begins)).select("project", F.from_json("line", schema).alias("x")).select("project", "x.*")


def of_project(df: DataFrame, project: str) -> DataFrame:
    return df if project == "project" else df.withColumnRenamed(project, "project")


def sarif_document(findings: DataFrame, project: str, suppressed: DataFrame | None = None, tool: str = "vetta", version: str = "1") -> DataFrame:
    """A SARIF document for each project: rules by index, then results by id."""
    findings = of_project(findings, project)
    projects = findings.select("project").distinct()
    rule = F.to_json(F.struct(F.col("rule").alias("id"), F.struct(F.col("title").alias("text")).alias("shortDescription"), F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration")))
    rules = sarif_rules(findings, "project").withColumn("_key", F.lpad(F.col("index").cast("string"), 12, "0"))
    head = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"version":' + json.dumps(version) + ',"rules":['
    return stacked(fixed(projects, 0, head), items(rules, 1, "_key", rule), fixed(projects, 2, ']}},"results":['), items(sarif_results(findings, "project", suppressed), 3, "id", F.col("result")), fixed(projects, 4, "]}]}"))


def counts_of(findings: DataFrame) -> DataFrame:
    """total and, under the names of severities and statuses, how many findings of a project have each."""
    return findings.groupBy("project").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c) == x).alias(x) for c, values in (("severity", SEVERITY), ("status", STATUS)) for x in values])


def bundle_document(projects: DataFrame, memories: DataFrame, findings: DataFrame, agents: list[str]) -> DataFrame:
    """A JSON bundle for each project (project, path, and what else is known of it): its notes and findings with their bodies, counts, and the agents there are."""
    told = F.concat(F.lit('{"project":'), F.to_json(F.struct(*projects.columns)), F.lit(',"memories":['))
    notes = memories.join(projects.select("project"), "project", "left_semi")
    own = findings.join(projects.select("project"), "project", "left_semi")
    body = lambda df: F.to_json(F.struct(F.lit("note" if df is notes else "finding").alias("kind"), *[c for c in df.columns if c != "project"]))
    counts = projects.select("project").join(counts_of(own), "project", "left").na.fill(0)
    stats = F.to_json(F.struct("total", F.struct(*SEVERITY).alias("by_severity"), F.struct(*STATUS).alias("by_status")))
    names = F.to_json(F.array(*map(F.lit, agents)))
    tail = F.concat(F.lit('],"finding_stats":'), stats, F.lit(',"available_agents":'), names, F.lit("}"))
    return stacked(fixed(projects, 0, told), items(notes, 1, "name", body(notes)), fixed(projects, 2, '],"findings":['), items(own, 3, "id", body(own)), fixed(counts, 4, tail))


def run_document(runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """A JSON export for each run: its findings, an item each."""
    rows = of_project(runs, run_id)
    ids = rows.select("project").distinct()
    finding = F.to_json(F.struct("id", "title", "severity", "status", "cwe", F.struct("file", "line_start").alias("location"), "tags"))
    return stacked(fixed(ids, 0, '{"findings":['), items(rows, 1, "id", finding), fixed(ids, 2, "]}"))


# --- reports for people -----------------------------------------------------------

# How reports show severities.
BADGES = {"critical": "🔴 **CRITICAL**", "high": "🟠 **HIGH**", "medium": "🟡 **MEDIUM**", "low": "🟢 **LOW**", "info": "🔵 **INFO**"}


def badge(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, v) for k, v in BADGES.items()], severity)


def field(findings: DataFrame, column: str, name: str) -> Column:
    """A field of a struct column, or null where the struct has none of that name."""
    return F.col(column)[name] if column in findings.columns and name in findings.schema[column].dataType.names else F.lit(None)


def filled(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("")) != ""


def listed(column: Column, line) -> Column:
    """The lines of an array, each by line(element, number from 1), each with its line end."""
    return F.array_join(F.transform(column, lambda x, k: F.concat(line(x, k + 1), F.lit("\n"))), "")


def section(title: str, body: Column, there: Column) -> Column:
    return F.when(there, F.concat(F.lit(f"#### {title}\n\n"), body)).otherwise("")


def markdown_blocks(findings: DataFrame) -> DataFrame:
    """id and block: a finding as Markdown with its table, place, texts, evidence, flow, references and tags; what is missing is left out."""
    f = complete(findings)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    some = lambda c: (F.size(c) > 0) if isinstance(c, str) else F.coalesce(F.size(c) > 0, F.lit(False))
    row = lambda name, value, there=F.lit(True): F.when(there, F.concat(F.lit(f"| **{name}** | "), value, F.lit(" |\n"))).otherwise("")
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    number = F.regexp_replace(F.upper("cwe"), "^CWE-", "")
    link = F.concat(F.lit("["), "cwe", F.lit("](https://cwe.mitre.org/data/definitions/"), number, F.lit(".html)"))
    rated = F.col("cvss").isNotNull()
    table = F.concat(
        F.lit("| Property | Value |\n|----------|-------|\n"), row("ID", tick(F.col("id"))), row("Severity", text("severity")), row("Confidence", text("confidence")), row("Status", text("status")), row("CWE", link, filled(F.col("cwe"))),
        row("CVSS Score", F.format_string("%.1f", "cvss.score"), rated), row("CVSS Vector", tick(F.coalesce("cvss.vector", F.lit(""))), rated), F.lit("\n"),
    )
    start, end = F.coalesce("line_start", F.lit(0)), F.coalesce("line_end", F.lit(0))
    lines = F.when(start <= 0, "").when((end > 0) & (end != start), F.concat(F.lit(" (lines "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" (line "), start.cast("string"), F.lit(")")))
    place = F.concat(F.lit("#### Location\n\n**File:** "), tick(text("file")), lines, F.lit("\n"), F.when(filled(F.col("function")), F.concat(F.lit("**Function:** "), tick(text("function")), F.lit("\n"))).otherwise(""), F.lit("\n"))
    snippet = F.when(filled(F.col("snippet")), F.concat(F.lit("```\n"), text("snippet"), F.when(text("snippet").endswith("\n"), "").otherwise("\n"), F.lit("```\n\n"))).otherwise("")
    prose = [section(c.title(), F.concat(text(c), F.lit("\n\n")), filled(F.col(c))) for c in ("description", "impact", "remediation")]
    trace = lambda e: F.when(some(e["trace"]), F.concat(F.lit("\n   - Trace: "), F.array_join(e["trace"], " → "))).otherwise("")
    shown = listed(F.col("evidence"), lambda e, k: F.concat(k.cast("string"), F.lit(". **"), F.coalesce(e["type"], F.lit("")), F.lit(":** "), F.coalesce(e["description"], F.lit("")), trace(e)))
    evidence = section("Evidence", F.concat(shown, F.lit("\n")), some(F.col("evidence")))
    flow, path, guards = F.col("flow_trace"), field(f, "flow_trace", "path"), field(f, "flow_trace", "guards").cast("array<string>")
    end_of = lambda name: F.concat(F.lit(f"**{name.title()}:** "), F.coalesce(flow[name], F.lit("")), F.lit("\n"))
    steps = F.when(some(path), F.concat(F.lit("**Path:**\n"), listed(path, lambda s, k: F.concat(k.cast("string"), F.lit(". "), s)))).otherwise("")
    held = F.when(some(guards), F.concat(F.lit("**Guards:**\n"), listed(guards, lambda g, k: F.concat(F.lit("- "), g)))).otherwise("")
    verdict = F.concat(F.lit("**Verdict:** "), F.when(field(f, "flow_trace", "unguarded").cast("boolean"), "UNGUARDED").otherwise("GUARDED"), F.lit("\n\n"))
    flows = section("Data Flow Trace", F.concat(end_of("source"), steps, held, end_of("sink"), verdict), flow.isNotNull())
    references = section("References", F.concat(listed(F.col("references"), lambda r, k: F.concat(F.lit("- "), r)), F.lit("\n")), some(F.col("references")))
    tags = F.when(some(F.col("tags")), F.concat(F.lit("**Tags:** "), F.array_join(F.transform("tags", tick), ", "), F.lit("\n\n"))).otherwise("")
    block = F.concat(F.lit("### "), badge(F.col("severity")), F.lit(" "), text("title"), F.lit("\n\n"), table, place, snippet, *prose, evidence, flows, references, tags)
    return f.select(*([c for c in ("project",) if c in f.columns]), "id", block.alias("block"))


def summary_table(title: str, first: str, values, shown) -> Column:
    """A Markdown table of the counts in columns of these names, in their order, without zeros."""
    rows = [F.when(F.col(v) > 0, F.concat(F.lit("| "), shown(v), F.lit(" | "), F.col(v).cast("string"), F.lit(" |\n"))).otherwise("") for v in values]
    return F.concat(F.lit(f"### {title}\n\n| {first} | Count |\n|{'-' * (len(first) + 2)}|-------|\n"), *rows, F.lit("\n"))


def markdown_document(findings: DataFrame, project: str, order: str = "id", made: str = "Generated by vetta v1") -> DataFrame:
    """A report for each project: head, counts by severity and status, then each finding's block in order of a column that tells findings apart."""
    findings = of_project(findings, project)
    counts = counts_of(findings)
    tables = F.concat(summary_table("By Severity", "Severity", SEVERITY, lambda v: F.lit(BADGES[v])), summary_table("By Status", "Status", STATUS, lambda v: F.lit(v)))
    head = F.concat(F.lit("# Security Findings Report: "), "project", F.lit(f"\n\n{made}\n\n## Summary\n\n**Total Findings:** "), F.col("total").cast("string"), F.lit("\n\n"), tables, F.lit("## Findings\n"))
    blocks = markdown_blocks(findings).join(findings.select("id", F.col(order).alias("_order")), "id")
    return stacked(fixed(counts, 0, head), items(blocks, 1, "_order", F.concat("block", F.lit("\n---\n")), ""))


def html_articles(findings: DataFrame) -> DataFrame:
    """id and article: a finding as HTML with all that its Markdown block has, everything escaped."""
    f = complete(findings)
    safe = lambda c: html_escape(F.coalesce(c.cast("string"), F.lit("")))
    cell = lambda name, value: F.when(filled(value), F.concat(F.lit(f"<tr><th>{name}</th><td>"), safe(value), F.lit("</td></tr>"))).otherwise("")
    lines = F.when(F.col("line_start") > 0, F.concat_ws("-", "line_start", F.when(F.col("line_end") > F.col("line_start"), F.col("line_end"))))
    cells = [cell(n, v) for n, v in (("ID", F.col("id")), ("Severity", F.col("severity")), ("Confidence", F.col("confidence")), ("Status", F.col("status")), ("CWE", F.col("cwe")), ("CVSS", F.concat_ws(" ", F.format_string("%.1f", "cvss.score"), "cvss.vector")), ("File", F.concat_ws(":", "file", lines)), ("Function", F.col("function")), ("Created by", F.col("created_by") if "created_by" in f.columns else F.lit(None)))]
    part = lambda name, body, there: F.when(there, F.concat(F.lit(f"<h3>{name}</h3>"), body)).otherwise("")
    prose = [part(c.title(), F.concat(F.lit("<p>"), safe(F.col(c)), F.lit("</p>")), filled(F.col(c))) for c in ("description", "impact", "remediation")]
    code = F.when(filled(F.col("snippet")), F.concat(F.lit("<pre>"), safe(F.col("snippet")), F.lit("</pre>"))).otherwise("")
    entries = lambda tag, column, told: F.concat(F.lit(f"<{tag}>"), F.array_join(F.transform(column, lambda x: F.concat(F.lit("<li>"), told(x), F.lit("</li>"))), ""), F.lit(f"</{tag}>"))
    there = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    evidence = part("Evidence", entries("ol", F.col("evidence"), lambda e: F.concat_ws(": ", safe(e["type"]), safe(e["description"]), F.when(there(e["trace"]), safe(F.array_join(e["trace"], " → "))))), there(F.col("evidence")))
    flow = F.col("flow_trace")
    steps = F.concat(F.array(flow["source"]), F.coalesce(flow["path"], F.array().cast("array<string>")), F.array(flow["sink"]))
    verdict = F.when(field(f, "flow_trace", "unguarded").cast("boolean"), "UNGUARDED").otherwise("GUARDED")
    flows = part("Data Flow Trace", F.concat(entries("ol", steps, safe), F.lit("<p>"), verdict, F.lit("</p>")), flow.isNotNull())
    references = part("References", entries("ul", F.col("references"), safe), there(F.col("references")))
    tags = part("Tags", F.concat(F.lit("<p>"), safe(F.array_join("tags", ", ")), F.lit("</p>")), there(F.col("tags")))
    article = F.concat(F.lit("<article><h2>"), safe(F.col("title")), F.lit("</h2><table>"), *cells, F.lit("</table>"), code, *prose, evidence, flows, references, tags, F.lit("</article>"))
    return f.select(*([c for c in ("project",) if c in f.columns]), "id", article.alias("article"))
