"""Queries on sources, sinks and streams."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from vetta.catalog import query
from vetta.plans.fixtures import view
from vetta.plans.tables import written
from vetta.plans.text_queries import TREE_SQL, tree
from vetta.sources import documents, readers, writers
from vetta.streaming import jobs


def with_project(spark, d):
    return view(spark, d, "findings").withColumn("project", F.split_part("file", F.lit("/"), F.lit(2)))


RULE = "case when trim(cwe) = '' then id else upper(cwe) end"
LEVEL = "case when severity in ('critical', 'high') then 'error' when severity = 'medium' then 'warning' else 'note' end"


@query(f"select project, rule, row_number() over (partition by project order by first) - 1 as index from (select split_part(file, '/', 2) as project, {RULE} as rule, min(id) as first from fx_findings group by 1, 2) as r", "findings")
def snk1_sarif_rules(spark, d):
    return writers.sarif_rules(with_project(spark, d), "project").select("project", "rule", "index")


@query(f"select id, title, case when severity in ('critical', 'high') then 'high' when severity = 'medium' then 'medium' else 'low' end as severity, file, line_start from fx_findings where title <> ''", "findings")
def src2_sarif_round_trip(spark, d):
    """Findings out as SARIF and in again. The message is the id, so that each row can be told."""
    rows = with_project(spark, d).where("title <> ''")
    text = writers.to_sarif(rows.withColumn("title", F.concat("id", F.lit("; "), F.translate("title", ".", " "))), "project")
    parsed = text.select(F.col("project").alias("path"), F.from_json("sarif", readers.SARIF)["runs"].alias("runs"))
    back = readers.sarif_to_findings(parsed, "/")
    own = rows.select("id", F.col("title").alias("own"))
    return back.select(F.split_part("title", F.lit("; "), F.lit(1)).alias("id"), "severity", "file", "line_start").join(own, "id").select("id", F.col("own").alias("title"), "severity", "file", "line_start")


@query(f"select id, case when doc_id % 4 = 0 then 'high' when doc_id % 4 = 1 then 'medium' when doc_id % 4 = 2 then 'low' else 'info' end as severity, upper(cwe) as cwe, case when doc_id % 7 = 0 then 1 else line_start end as line_start, case when doc_id % 3 = 0 then 'leaf' when doc_id % 3 = 1 then 'Short text' else 'Long text' end as title from fx_findings", "findings")
def src3_sarif_mapping(spark, d):
    """Results with what SARIF leaves out by turns: level, message, line."""
    rows = view(spark, d, "findings")
    doc = F.expr("""array(struct(struct(struct('x' as name, array(struct('pack.leaf' as id, struct(case when doc_id % 3 = 1 then 'Short text' when doc_id % 3 = 0 then 'Opengrep Finding: x' else '' end as text) as shortDescription, struct(case when doc_id % 3 = 2 then 'Long text. More.' else '' end as text) as fullDescription,
        struct(case doc_id % 4 when 0 then 'error' when 1 then 'warning' when 2 then 'note' else 'none' end as level) as defaultConfiguration, struct(array('a', lower(cwe)) as tags) as properties)) as rules) as driver) as tool,
        array(struct('pack.leaf' as ruleId, case when doc_id % 5 = 0 then case doc_id % 4 when 0 then 'error' when 1 then 'warning' when 2 then 'note' else 'none' end else '' end as level, struct('' as text) as message, array(struct(struct(struct(file as uri) as artifactLocation, struct(case when doc_id % 7 = 0 then 0 else line_start end as startLine, cast(null as int) as endLine, struct('' as text) as snippet) as region) as physicalLocation)) as locations)) as results))""")
    return readers.sarif_to_findings(rows.select(F.col("id").alias("path"), doc.alias("runs"))).select(F.col("path").alias("id"), "severity", "cwe", "line_start", "title")


URI = "case doc_id % 4 when 0 then 'file:///repo/' || file when 1 then './' || file when 2 then '/other/' || file else '/repo//' || file end"


@query("select id, case doc_id % 4 when 2 then '/other/' || file else file end as path from fx_findings", "findings")
def src4_relativize(spark, d):
    return view(spark, d, "findings").select("id", readers.relativize(F.expr(URI), "/repo").alias("path"))


@query("select id, file in (select file from fx_changed) as created from fx_findings", "findings", "changed")
def src5_in_project(spark, d):
    inside, outside = readers.in_project(view(spark, d, "findings"), view(spark, d, "changed").withColumnRenamed("file", "path"))
    return inside.select("id", F.lit(True).alias("created")).union(outside.select("id", F.lit(False)))


YAML = "case when doc_id % 9 = 4 then 'a: [' else 'id: ' || id || chr(10) || 'title: \"T ' || cast(doc_id as string) || '\"' || chr(10) || 'severity: ' || severity || chr(10) || 'location: {file: ' || file || ', line_start: ' || cast(line_start as string) || '}' end"


@query("select id, severity, file, line_start, 'T ' || cast(doc_id as varchar) as title from fx_findings where doc_id % 9 <> 4", "findings")
def src1_yaml(spark, d):
    files = view(spark, d, "findings").select(F.col("id").alias("path"), F.expr(YAML).alias("content"))
    return readers.findings_from_text(files).select("id", "severity", "file", "line_start", "title")


@query("select run_id, count(*) as n, count(distinct file) as files from fx_runs group by 1", "runs")
def src10_runs(spark, d):
    """Runs written as JSON files, a folder each, and read back."""
    from vetta.plans.tables import folder

    rows = view(spark, d, "runs").withColumn("location", F.struct("file", "line_start"))
    export = rows.groupBy("run_id").agg(F.to_json(F.struct(F.collect_list(F.struct("id", "title", "severity", "status", "cwe", "location", "tags")).alias("findings"))).alias("value"))
    path = f"{folder(spark)}/runs-{uuid.uuid4().hex}"
    export.write.partitionBy("run_id").text(path)
    parsed = spark.read.schema(readers.RUN).json(path, multiLine=True, recursiveFileLookup=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"run_id=(\d+)", 1).cast("int").alias("run_id"), F.explode("findings").alias("f"))
    return parsed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("f.location.file").alias("files"))


COUNTS = ",".join(f"\"{x}\":' || count(*) filter (severity = '{x}') || '" for x in ("critical", "high", "medium", "low", "info"))
BY_STATUS = ",".join(f"\"{x}\":' || count(*) filter (status = '{x}') || '" for x in ("open", "confirmed", "false_positive", "fixed", "duplicate"))


@query(f"""select split_part(file, '/', 2) as project, '{{"metadata":{{"tool":"vetta","version":"1","project_name":"' || split_part(file, '/', 2) || '"}},"summary":{{"total":' || count(*) || ',"by_severity":{{{COUNTS}}},"by_status":{{{BY_STATUS}}}}}}}' as report from fx_findings group by 1""", "findings")
def snk2_json(spark, d):
    return writers.to_json_report(with_project(spark, d), "project")


@query("select split_part(file, '/', 2) as project, id, severity, status, title, line_start from fx_findings", "findings")
def snk2_json_findings(spark, d):
    """The findings of the reports, read back from their JSON."""
    rows = writers.json_findings(with_project(spark, d), "project")
    told = F.from_json("finding", "severity string, status string, title string, line_start int")
    return rows.select("project", "id", told["severity"].alias("severity"), told["status"].alias("status"), told["title"].alias("title"), told["line_start"].alias("line_start"))


@query("""select id, title, severity, confidence, status, cwe, case when doc_id % 3 = 0 then format('{:.1f}', doc_id % 100 / 10.0) else '' end as cvss_score, case when doc_id % 3 = 0 then 'AV:N/' || lang_of else '' end as cvss_vector, file,
    cast(line_start as varchar) as line_start, case when doc_id % 2 = 0 then cast(line_start + 3 as varchar) else '' end as line_end, function, md5(description) as description, 'of ' || severity as impact, case when doc_id % 5 = 0 then '' else 'mend' end as remediation,
    replace(tags, ';', '; ') as tags, case when doc_id % 7 = 0 then '' else 'https://a/' || doc_id || '; b' end as references, strftime(to_timestamp(created_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as created_at, created_by
    from (select *, split_part(tags, ';', 1) as lang_of from fx_findings) as f""", "findings")
def snk3_csv(spark, d):
    rows = view(spark, d, "findings").withColumns({
        "cvss": F.expr("case when doc_id % 3 = 0 then named_struct('score', cast(doc_id % 100 / 10.0 as double), 'vector', 'AV:N/' || tags[0]) end"), "line_end": F.expr("case when doc_id % 2 = 0 then line_start + 3 else 0 end"),
        "impact": F.expr("'of ' || severity"), "remediation": F.expr("case when doc_id % 5 = 0 then null else 'mend' end"), "references": F.expr("case when doc_id % 7 = 0 then null else array('https://a/' || doc_id, 'b') end"),
    })
    return writers.to_csv_rows(rows).withColumn("description", F.md5("description"))


@query("select id, md5('### ' || id || ': ' || title || chr(10) || '- **Severity:** ' || severity || chr(10) || case when cwe <> '' then '- **CWE:** ' || cwe || chr(10) else '' end || '- **File:** `' || file || ':' || line_start || '`' || case when trim(description) <> '' then chr(10) || chr(10) || description else '' end) as block from fx_findings", "findings")
def snk4_markdown(spark, d):
    return writers.to_report_blocks(view(spark, d, "findings")).select("id", F.md5("block").alias("block"))


@query("select id, '<tr><td>' || id || '</td><td>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') || '</td><td>' || severity || '</td><td>' || file || '</td></tr>' as row from fx_findings", "findings")
def snk4_html(spark, d):
    return writers.to_html_rows(view(spark, d, "findings"))


@query("select project, count(*) as n, count(*) filter (status = 'open') as open from (select *, split_part(file, '/', 2) as project from fx_findings) as f group by 1", "findings")
def snk5_bundle(spark, d):
    rows = with_project(spark, d)
    notes = rows.where("doc_id % 10 = 0").select("project", F.col("id").alias("name"))
    bundle = writers.context_bundle(rows, notes, rows, rows.select("project", F.col("created_by").alias("agent")))
    told = F.from_json("bundle", "findings long, open long")
    return bundle.select("project", told["findings"].alias("n"), told["open"].alias("open"))


# --- documents in parts: written, and read back line by line ----------------------

# Findings with all that reports can show, by turns; SQL makes the same columns.
SHOWN = {
    "flow_trace": "case when doc_id % 3 = 0 then named_struct('source', 'in ' || id, 'sink', 'out <b>', 'path', array('s1', 'step ' || severity), 'guards', case when doc_id % 2 = 0 then array('check') end, 'unguarded', doc_id % 4 = 0) end",
    "evidence": "case when doc_id % 5 < 2 then array(named_struct('type', 'code', 'description', 'seen ' || id, 'trace', case when doc_id % 5 = 0 then array('a', 'b') end)) end",
    "cvss": "case when doc_id % 4 = 1 then named_struct('score', cast(doc_id % 100 / 10.0 as double), 'vector', 'AV:N') end",
    "line_end": "case when doc_id % 2 = 0 then line_start + 3 else 0 end",
    "snippet": "case when doc_id % 7 = 0 then 'x = 1' || chr(10) when doc_id % 7 = 1 then 'y & z' else '' end",
    "impact": "'of ' || severity",
    "remediation": "case when doc_id % 5 = 0 then null else 'mend' end",
    "references": "case when doc_id % 6 = 0 then array('https://a/' || cast(doc_id as string), 'b') end",
}


def shown(spark, d):
    return with_project(spark, d).withColumns({k: F.expr(v) for k, v in SHOWN.items()})


def documents_of(rows, name: str) -> str:
    from vetta.plans.tables import folder

    path = f"{folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    documents.write_documents(rows, path)
    return path


RESULT = """ruleId string, ruleIndex int, level string, message struct<text: string>, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int, snippet: struct<text: string>>>>>,
    codeFlows array<struct<threadFlows: array<struct<locations: array<struct<message: struct<text: string>>>>>>>, partialFingerprints map<string, string>, suppressions array<struct<justification: string>>, properties struct<id: string, cvss: struct<score: double>>"""


@query(f"""with r as (select project, rule, row_number() over (partition by project order by first) - 1 as index from (select split_part(file, '/', 2) as project, {RULE} as rule, min(id) as first from fx_findings group by 1, 2) as r)
    select split_part(file, '/', 2) as project, id, {RULE} as rule, index, {LEVEL} as level, title, file, line_start, case when doc_id % 2 = 0 then line_start + 3 end as line_end, case when doc_id % 7 = 0 then 'x = 1' || chr(10) when doc_id % 7 = 1 then 'y & z' end as snippet,
        case when doc_id % 3 = 0 then 'Source: in ' || id || '|s1|step ' || severity || '|Sink: out <b>' end as flow, case when doc_id % 50 = 3 then 'accepted' end as reason, case when doc_id % 4 = 1 then doc_id % 100 / 10.0::double end as cvss, 'print ' || id as fingerprint
    from fx_findings as f join r on r.project = split_part(file, '/', 2) and r.rule = {RULE}""", "findings")
def snk1_document(spark, d):
    """SARIF with regions, snippets, flows, suppressions, fingerprints and scores, a result a line."""
    rows = shown(spark, d).withColumn("fingerprint", F.concat(F.lit("print "), "id"))
    path = documents_of(documents.sarif_document(rows, "project", rows.where("doc_id % 50 = 3").select("id", F.lit("accepted").alias("reason"))), "sarif")
    x = documents.read_items(spark, path, RESULT, '{"ruleId"')
    at, flow = F.col("locations")[0]["physicalLocation"], F.col("codeFlows")[0]["threadFlows"][0]["locations"]
    return x.select(
        "project", F.col("properties.id").alias("id"), F.col("ruleId").alias("rule"), F.col("ruleIndex").alias("index"), "level", F.col("message.text").alias("title"), at["artifactLocation"]["uri"].alias("file"), at["region"]["startLine"].alias("line_start"), at["region"]["endLine"].alias("line_end"),
        at["region"]["snippet"]["text"].alias("snippet"), F.when(flow.isNotNull(), F.array_join(F.transform(flow, lambda s: s["message"]["text"]), "|")).alias("flow"), F.col("suppressions")[0]["justification"].alias("reason"), F.col("properties.cvss.score").alias("cvss"), F.col("partialFingerprints")["finding/v1"].alias("fingerprint"),
    )


@query("select split_part(file, '/', 2) as project, 'finding' as kind, id as name, md5(description) as body from fx_findings union all select 'src' || cast(conv_id % 4 as varchar), 'note', name || ' ' || type, md5(content) from (select *, row_number() over (partition by name, type) as k from fx_memories) as m where k = 1 and 'src' || cast(conv_id % 4 as varchar) in (select split_part(file, '/', 2) from fx_findings)", "findings", "memories")
def snk5_bodies(spark, d):
    """Bundles with the bodies of notes and findings, read back."""
    rows = with_project(spark, d)
    notes = view(spark, d, "memories").select(F.concat(F.lit("src"), (F.col("conv_id") % 4).cast("string")).alias("project"), F.concat_ws(" ", "name", "type").alias("name"), "type", "content")
    projects = rows.select("project", F.concat(F.lit("/repo/"), "project").alias("path")).distinct()
    path = documents_of(documents.bundle_document(projects, notes, rows.select("project", "id", "title", "severity", "status", "description"), ["agent-1", "agent-2"]), "bundle")
    back = documents.read_items(spark, path, "kind string, name string, id string, content string, description string", '{"kind"')
    return back.select("project", "kind", F.coalesce("name", "id").alias("name"), F.md5(F.coalesce("content", "description")).alias("body"))


@query("select run_id, id, title, severity, status, cwe, file, line_start, tags from fx_runs", "runs")
def src10_parts(spark, d):
    """Whole runs as documents in parts, read back."""
    path = documents_of(documents.run_document(view(spark, d, "runs")), "runs")
    back = documents.read_items(spark, path, "id string, title string, severity string, status string, cwe string, location struct<file: string, line_start: int>, tags array<string>", '{"id"')
    return back.select(F.col("project").cast("int").alias("run_id"), "id", "title", "severity", "status", "cwe", "location.file", "location.line_start", F.array_join("tags", ";").alias("tags"))


BLOCK = """'### ' || case severity when 'critical' then '🔴 **CRITICAL**' when 'high' then '🟠 **HIGH**' when 'medium' then '🟡 **MEDIUM**' when 'low' then '🟢 **LOW**' else '🔵 **INFO**' end || ' ' || title || e'\\n\\n| Property | Value |\\n|----------|-------|\\n'
    || '| **ID** | `' || id || e'` |\\n| **Severity** | ' || severity || e' |\\n| **Confidence** | ' || confidence || e' |\\n| **Status** | ' || status || e' |\\n'
    || case when cwe <> '' then '| **CWE** | [' || cwe || '](https://cwe.mitre.org/data/definitions/' || replace(upper(cwe), 'CWE-', '') || e'.html) |\\n' else '' end
    || case when doc_id % 4 = 1 then '| **CVSS Score** | ' || format('{:.1f}', doc_id % 100 / 10.0) || e' |\\n| **CVSS Vector** | `AV:N` |\\n' else '' end
    || e'\\n#### Location\\n\\n**File:** `' || file || '`' || case when doc_id % 2 = 0 then ' (lines ' || line_start || '-' || (line_start + 3) || ')' else ' (line ' || line_start || ')' end || e'\\n' || case when function <> '' then '**Function:** `' || function || e'`\\n' else '' end || e'\\n'
    || case when doc_id % 7 = 0 then e'```\\nx = 1\\n```\\n\\n' when doc_id % 7 = 1 then e'```\\ny & z\\n```\\n\\n' else '' end || case when description <> '' then e'#### Description\\n\\n' || description || e'\\n\\n' else '' end
    || e'#### Impact\\n\\nof ' || severity || e'\\n\\n' || case when doc_id % 5 = 0 then '' else e'#### Remediation\\n\\nmend\\n\\n' end
    || case when doc_id % 5 < 2 then e'#### Evidence\\n\\n1. **code:** seen ' || id || e'\\n' || case when doc_id % 5 = 0 then e'   - Trace: a → b\\n' else '' end || e'\\n' else '' end
    || case when doc_id % 3 = 0 then e'#### Data Flow Trace\\n\\n**Source:** in ' || id || e'\\n**Path:**\\n1. s1\\n2. step ' || severity || e'\\n' || case when doc_id % 2 = 0 then e'**Guards:**\\n- check\\n' else '' end || e'**Sink:** out <b>\\n**Verdict:** ' || case when doc_id % 4 = 0 then 'UNGUARDED' else 'GUARDED' end || e'\\n\\n' else '' end
    || case when doc_id % 6 = 0 then e'#### References\\n\\n- https://a/' || doc_id || e'\\n- b\\n\\n' else '' end || '**Tags:** `' || replace(tags, ';', '`, `') || e'`\\n\\n'"""


@query(f"select id, md5({BLOCK}) as block from fx_findings", "findings")
def snk4_blocks(spark, d):
    return documents.markdown_blocks(shown(spark, d)).select("id", F.md5("block").alias("block"))


TABLE = lambda column, values: " || ".join(f"case when count(*) filter ({column} = '{v}') > 0 then '| {s} | ' || count(*) filter ({column} = '{v}') || e' |\\n' else '' end" for v, s in values)
HEAD = f"""'# Security Findings Report: ' || project || e'\\n\\nGenerated by vetta v1\\n\\n## Summary\\n\\n**Total Findings:** ' || count(*) || e'\\n\\n### By Severity\\n\\n| Severity | Count |\\n|----------|-------|\\n' || {TABLE("severity", documents.BADGES.items())}
    || e'\\n### By Status\\n\\n| Status | Count |\\n|--------|-------|\\n' || {TABLE("status", [(s, s) for s in ("open", "confirmed", "false_positive", "fixed", "duplicate")])} || e'\\n## Findings\\n'"""


@query(f"select project, md5({HEAD}) as head, count(*) as blocks from (select *, split_part(file, '/', 2) as project from fx_findings) as f group by 1", "findings")
def snk4_report(spark, d):
    """Reports by project: the head with its tables, and how many blocks follow it."""
    rows = documents.markdown_document(shown(spark, d), "project")
    return rows.groupBy("project").agg(F.md5(F.max(F.when(F.col("section") == 0, F.col("text")))).alias("head"), F.count_if(F.col("section") == 1).alias("blocks"))


# --- streams, replayed from written tables until they are used up -----------------


def replay(frame, name: str, sink: str):
    """A stream over a written copy of frame."""
    spark = frame.sparkSession
    path = written(frame, name).inputFiles()[0].rpartition("/")[0]
    return spark.readStream.schema(frame.schema).parquet(path)


def replay_in_parts(frames: list, name: str, files: int = 4):
    """A stream over tables that are written one after the other, each of them a batch."""
    from vetta.plans.tables import folder

    spark = frames[0].sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    for frame in frames:
        frame.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", files).parquet(path)


@contextlib.contextmanager
def state_store(spark, name: str):
    """A session's state store, as long as a query runs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, f"org.apache.spark.sql.execution.streaming.state.{name}")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drained(stream, spark, mode: str = "append"):
    """What a stream gives until its source is used up, as a table."""
    from vetta.plans.tables import folder

    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("select path, max(at_us) as at_us from (select 'u' || cast(user_id as varchar) as path, epoch_us(ts) as at_us from events) as x group by 1")
def str1_index(spark, d):
    """Each path's last change, through the index stream."""
    from vetta.plans.tables import folder

    changes = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("at"))
    path = f"{folder(spark)}/index-{uuid.uuid4().hex}"

    def apply(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    jobs.start_index_stream(replay(changes, "changes", "index"), apply, path + "-state", once=True).awaitTermination()
    return spark.read.parquet(path).groupBy("path").agg(F.max(F.unix_micros("at")).alias("at_us"))


FILE_ROWS = "path string, mtime long, size long, sha256 string, part int"


def file_parts(files):
    """A made-up extractor: as many parts of a file as its hash says."""
    return files.select("path", "mtime", "size", "sha256", F.explode(F.sequence(F.lit(0), F.substring("sha256", 2, 9).cast("int"))).alias("part"))


def file_changes(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    path = F.concat(F.lit("f"), (F.col("event_id") * 37 % 6007).cast("string"))
    return rows.select(path.alias("path"), "at", (F.col("event_type") == "purchase").alias("removed"), F.unix_micros("at").alias("mtime"), (F.col("event_id") % 100).alias("size"), F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("sha256"))


@query("""with c as (select (event_id * 37) % 6007 as p, epoch_us(ts) as mtime, event_id % 100 as size, event_id % 5 as h, event_type = 'purchase' as removed from events),
    l as (select *, row_number() over (partition by p order by mtime desc, removed desc, size desc, h desc) as k from c)
    select 'f' || p as path, mtime, size, 'h' || h as sha256, unnest(range(0, h + 1))::int as part from l where k = 1 and not removed and p % 17 <> 0""")
def str1_files(spark, d):
    """An index of files' parts after three batches of changes, with a listing that has lost some paths; the last batch has come twice."""
    from vetta.plans.tables import folder

    changes = file_changes(spark, d)
    days = [F.timestamp_seconds(F.lit(1704067200 + k * 86400)) for k in (10, 20)]
    parts = [changes.where(F.col("at") < days[0]), changes.where((F.col("at") >= days[0]) & (F.col("at") < days[1])), changes.where(F.col("at") >= days[1])]
    store = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    listing = lambda: changes.select("path").distinct().where("cast(substring(path, 2) as long) % 17 <> 0")
    jobs.start_merge_stream(replay_in_parts(parts, "changes"), store, file_parts, FILE_ROWS, store + "-state", listing, once=True).awaitTermination()
    jobs.merge_batch(parts[2], 2, store, file_parts, FILE_ROWS, listing())
    return jobs.current_index(spark, store, FILE_ROWS)


@query("select agent, event_id, cast(floor((at_us - p) / 1000) as bigint) as ms from (select *, lag(kind) over w as k, lag(at_us) over w as p from fx_agent_events window w as (partition by agent order by at_us, event_id)) as x where kind = 'end' and k = 'start' and at_us - p <= 86400000000", "agent_events")
def str2_stream(spark, d):
    """Events in three batches that are out of order; a last row of another kind lets the watermark pass them all."""
    events = view(spark, d, "agent_events").select("agent", "event_id", "kind", "at_us")
    parts = [events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)]
    tick = events.agg(F.max("at_us").alias("at_us")).select(F.lit(-1).alias("agent"), F.lit(-1).cast("long").alias("event_id"), F.lit("tick").alias("kind"), (F.col("at_us") + 400 * 86_400_000_000).alias("at_us"))
    with state_store(spark, "RocksDBStateStoreProvider"):
        return drained(jobs.pair_events(replay_in_parts([*parts, tick], "events"), "365 days"), spark)


@query("select distinct file as fingerprint, created_by from fx_findings", "findings")
def str3_dedup(spark, d):
    rows = view(spark, d, "findings").select(F.col("file").alias("fingerprint"), "created_by", F.timestamp_seconds("created_at").alias("at"))
    return drained(jobs.dedup_stream(replay(rows, "arrivals", "dedup")), spark).select("fingerprint", "created_by")


@query("select file as fingerprint, created_by, case when count(*) filter (doc_id % 3 = 0) > 0 then 1 else 2 end as run from fx_findings group by 1, 2", "findings")
def str3_history(spark, d):
    """A run over a third of the findings and a later one over all of them: each key with the run that brought it."""
    from vetta.plans.tables import folder

    rows = view(spark, d, "findings").select(F.col("file").alias("fingerprint"), "created_by", F.timestamp_seconds("created_at").alias("at"), "doc_id")
    history = f"{folder(spark)}/history-{uuid.uuid4().hex}"
    for k, part in ((1, rows.where("doc_id % 3 = 0")), (2, rows)):
        jobs.start_dedup_stream(replay(part, "arrivals", "history"), history, f"{history}-state-{k}", once=True).awaitTermination()
    kept = spark.read.schema("fingerprint string, created_by string, run string").parquet(history)
    return kept.where("fingerprint is not null").select("fingerprint", "created_by", F.when(F.col("run") == jobs.run_name(f"{history}-state-1"), 1).otherwise(2).alias("run"))


@query("""with n as (select *, case when at_us - lag(at_us) over (partition by agent order by at_us) <= 600000000 then 0 else 1 end as new from fx_agent_events), b as (select *, sum(new) over (partition by agent order by at_us range between unbounded preceding and current row) as b from n)
    select agent, min(at_us) as first, max(at_us) + 600000000 as last, count(*) as n from b group by agent, b""", "agent_events")
def str4_stream(spark, d):
    """Bursts of a stream; a last row of another key lets the watermark pass them all."""
    rows = view(spark, d, "agent_events").select("agent", F.timestamp_micros("at_us").alias("at"))
    tick = rows.agg(F.max("at").alias("at")).select(F.lit(-1).alias("agent"), (F.col("at") + F.expr("interval 400 days")).alias("at"))
    out = drained(jobs.debounce(replay_in_parts([rows, tick], "bursts"), "agent", "10 minutes", "365 days"), spark)
    return out.where("agent >= 0").select("agent", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query(f"with {TREE_SQL} select count(*) as files from fx_tree")
def src6_listing(spark, d):
    return tree(spark, d).agg(F.count(F.lit(1)).alias("files"))


