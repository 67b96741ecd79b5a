"""Sources: each file becomes rows; files that can't be read become none, or a reject."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetta.functions.columns import blank
from vetta.operators.findings import with_fingerprint

FINDING = """id string, fingerprint string, title string, severity string, confidence string, exploitability string, fix_priority string, status string, cwe string,
    location struct<file: string, line_start: int, line_end: int, function: string, snippet: string>, description string, impact string, remediation string,
    references array<string>, tags array<string>, reviewed_by array<string>, cvss struct<score: double, vector: string>,
    evidence array<struct<type: string, description: string, trace: array<string>>>, flow_trace struct<source: string, sink: string, path: array<string>, guards: array<string>, unguarded: boolean>,
    notes array<struct<timestamp: string, author: string, text: string>>, created_by string, created_at string, updated_at string, duplicate_of string"""


def parse_yaml(column: Column) -> Column:
    """A finding record from its YAML text; null if it is unreadable."""

    @F.pandas_udf("string")
    def as_json(texts: pd.Series) -> pd.Series:
        import json

        import yaml

        def one(t):
            try:
                value = yaml.safe_load(t or "")
            except yaml.YAMLError:
                return None
            return json.dumps(value, default=str) if isinstance(value, dict) else None

        return texts.map(one)

    return F.from_json(as_json(column), FINDING)


def findings_from_text(files: DataFrame) -> DataFrame:
    """Findings of files (path, content); those that can't be parsed are left out, a missing fingerprint is made."""
    rows = files.select("path", parse_yaml(F.col("content")).alias("f")).where("f is not null").select("path", "f.*", "f.location.*").drop("location")
    made = with_fingerprint(rows.withColumn("_stored", F.col("fingerprint")))
    return made.withColumn("fingerprint", F.when(blank(F.col("_stored")), F.col("fingerprint")).otherwise(F.col("_stored"))).drop("_stored")


def rejected_files(files: DataFrame) -> DataFrame:
    """The files (path, content) that hold no finding."""
    return files.where(parse_yaml(F.col("content")).isNull())


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.y*ml")
    return findings_from_text(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


SARIF = """runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string, shortDescription: struct<text: string>, fullDescription: struct<text: string>,
    defaultConfiguration: struct<level: string>, properties: struct<tags: array<string>>>>>>, results: array<struct<ruleId: string, level: string, message: struct<text: string>,
    locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int, snippet: struct<text: string>>>>>>>>>"""


def level_severity(level: Column) -> Column:
    return F.when(level == "error", "high").when(level == "note", "low").when(level == "none", "info").otherwise("medium")


def relativize(uri: Column, root: str) -> Column:
    """A path relative to root, without file:// and ./; paths outside root stay as they are."""
    raw = F.regexp_replace(uri, "^file://", "")
    rooted = raw.startswith("/")
    none = F.array().cast("array<string>")
    # a/../b is b; .. at the root is the root, and at the start of a relative path it stays.
    up = lambda a: (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != "..")
    step = lambda a, x: F.when((x == "") | (x == "."), a).when((x == "..") & up(a), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when((x == "..") & rooted, a).otherwise(F.concat(a, F.array(x)))
    parts = F.array_join(F.aggregate(F.split(raw, "/"), none, step), "/")
    plain = F.when(rooted, F.concat(F.lit("/"), parts)).otherwise(parts)
    inside = root.rstrip("/") + "/"
    return F.when(plain.startswith(inside), F.substr(plain, F.lit(len(inside) + 1))).otherwise(plain)


def sarif_to_findings(docs: DataFrame, root: str = "/") -> DataFrame:
    """Findings of parsed documents (path, runs): each result with its run's rule of that id; results without a title are dropped.

    Of rules with one id, the last counts.
    """
    runs = docs.select("path", F.posexplode("runs").alias("run", "r"))
    rules = runs.select("path", "run", F.posexplode("r.tool.driver.rules").alias("pos", "rule")).groupBy("path", "run", F.col("rule.id").alias("ruleId")).agg(F.max_by("rule", "pos").alias("rule"))
    results = runs.select("path", "run", F.posexplode("r.results").alias("nth", "x")).select("path", "run", "nth", "x.*")
    rows = results.join(rules, ["path", "run", "ruleId"], "left")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    description = F.coalesce(text(F.col("message.text")), text(F.col("rule.fullDescription.text")), F.lit(""))
    short = text(F.col("rule.shortDescription.text"))
    sentence = F.nullif(F.trim(F.regexp_extract(description, r"^([^.\n]*)", 1)), F.lit(""))
    title = F.coalesce(sentence, F.when(~short.startswith("Opengrep Finding:"), short), F.element_at(F.split("ruleId", r"\."), -1), F.lit(""))
    tags = F.coalesce("rule.properties.tags", F.array().cast("array<string>"))
    cwe = F.upper(F.regexp_extract(F.coalesce(F.try_element_at(F.filter(tags, lambda t: F.upper(t).rlike(r"CWE-\d+")), F.lit(1)), F.lit("")), r"(?i)(CWE-\d+)", 1))
    at = F.try_element_at("locations", F.lit(1))["physicalLocation"]
    line = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(c)
    return rows.select(
        "path", "run", "nth", title.alias("title"), description.alias("description"), level_severity(F.coalesce(text(F.col("level")), F.col("rule.defaultConfiguration.level"), F.lit(""))).alias("severity"),
        cwe.alias("cwe"), relativize(at["artifactLocation"]["uri"], root).alias("file"), line(at["region"]["startLine"]).alias("line_start"), F.coalesce(at["region"]["endLine"], line(at["region"]["startLine"])).alias("line_end"),
        F.coalesce(at["region"]["snippet"]["text"], F.lit("")).alias("snippet"), F.array(F.lit("sast"), F.lit("opengrep"), F.concat(F.lit("opengrep-rule:"), "ruleId")).alias("tags"), F.lit("medium").alias("confidence"), F.lit("open").alias("status"),
    ).where("title <> ''")


def read_sarif(spark: SparkSession, path: str, root: str = "/") -> DataFrame:
    docs = spark.read.schema(SARIF).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "runs")
    return sarif_to_findings(docs, root)


def in_project(findings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings whose file there is, and those whose file there isn't."""
    paths = files.select(F.col("path").alias("file")).distinct()
    return findings.join(paths, "file", "left_semi"), findings.join(paths, "file", "left_anti")


RUN = "findings array<struct<id: string, title: string, severity: string, status: string, cwe: string, location: struct<file: string, line_start: int>, tags: array<string>>>"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Findings of run exports, with run_id from the file's name; unreadable files have none."""
    docs = spark.read.schema(RUN).json(path, multiLine=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("run_id"), F.explode("findings").alias("f"))
    return docs.select("run_id", "f.id", "f.title", "f.severity", "f.status", "f.cwe", "f.location.file", "f.location.line_start", "f.tags")
