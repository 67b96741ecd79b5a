"""Findings, exceptions, runs, files and the like, derived from the given tables by one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "documents embeddings pages conversations events".split()


def pick(n: str, *values: str) -> str:
    return f"case {n} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


CWES = [f"CWE-{n}" for n in (89, 79, 78, 22, 330, 94, 200, 352, 611, 502, 798, 601)]
AS_OF = 1704067200 + 14 * 86400  # 2024-01-15
# A column of an inner select, so that engines split a text once and not for each word.
FIRST_LINE = "split_part(text, chr(10), 1) as first_line"

SQL = {
    "findings": f"""
        select doc_id, 'FIND-' || lpad(cast(doc_id as string), 6, '0') as id,
            trim(concat_ws(' ', {", ".join(f"split_part(first_line, ' ', {k})" for k in range(1, 9))})) as title,
            {pick("doc_id % 5", "critical", "high", "medium", "low", "info")} as severity,
            {pick("doc_id % 3", "high", "medium", "low")} as confidence,
            case when doc_id % 11 < 6 then 'open' when doc_id % 11 < 8 then 'confirmed' when doc_id % 11 = 8 then 'false_positive' when doc_id % 11 = 9 then 'fixed' else 'duplicate' end as status,
            case when doc_id % 4 = 0 then '' else {pick("doc_id % 4 - 1", "proven", "likely", "possible")} end as exploitability,
            case when doc_id % 4 = 0 then '' else {pick("doc_id % 3", "immediate", "high", "low")} end as fix_priority,
            case when doc_id % 13 = 0 then '' when doc_id % 17 = 0 then lower({pick("doc_id % 12", *CWES)}) else {pick("doc_id % 12", *CWES)} end as cwe,
            'src/' || source || '/m' || cast(doc_id % 37 as string) || '.py' as file,
            cast(1 + n_chars % 400 as int) as line_start,
            case when doc_id % 4 = 1 then '' else 'fn_' || cast(doc_id % 23 as string) end as function,
            lang || ';' || source || case when doc_id % 2 = 0 then ';Sast' else '' end as tags,
            case when doc_id % 6 = 5 then '' else 'agent-' || cast(doc_id % 6 as string) end as created_by,
            1704067200 + doc_id * 60 as created_at,
            text as description
        from (select *, {FIRST_LINE} from {{documents}} where doc_id is not null) as d""",
    "findings_dup": """
        select * from {findings} union all
        select doc_id, id || '-D', 'Possible ' || title || ' (issue)', severity, confidence, status, exploitability, fix_priority, cwe, file,
            line_start + 7, function, tags, created_by, created_at + 86400, description
        from {findings} where doc_id % 4 = 0 or doc_id % 12 = 11""",
    "exceptions": f"""
        select 'EXC-F' || cast(doc_id as string) as id, of_id as fingerprint, '' as path_glob, '' as cwe, 'accepted' as reason,
            {AS_OF} + case when doc_id % 100 = 3 then 864000 else -864000 end as expires, 'lead' as approved_by, 1000 + doc_id as pos
        from (select doc_id, id as of_id from {{findings}} where doc_id % 50 = 3) as f
        union all select 'EXC-G1', '', 'src/src3/*.py', 'CWE-22', 'legacy', {AS_OF} + 864000, 'lead', 1
        union all select 'EXC-G2', '', 'm[1-2]?.py', 'cwe-89', 'tests', {AS_OF} + 86400, 'lead', 2
        union all select 'EXC-G3', '', 'm2*.py', 'CWE-79', 'old', {AS_OF} - 86400, 'lead', 3
        union all select 'EXC-G4', '', 'src/src3/*.py', 'CWE-22', 'later', {AS_OF} + 1728000, '', 4""",
    "changed": "select distinct file from {findings} where doc_id % 37 % 3 = 0",
    "decisions": f"""
        select case when doc_id % 45 = 0 then '' when doc_id % 45 = 9 then 'FIND-none' || cast(doc_id as string) else id end as finding_id,
            case when doc_id % 27 = 18 then 'bogus' else {pick("doc_id % 3", "confirmed", "false_positive", "fixed")} end as status,
            case when doc_id % 2 = 0 then 'seen in review' else '' end as reason,
            case when doc_id % 63 = 0 then 'urgent' when doc_id % 7 = 0 then 'high' else '' end as severity_override, 'triager' as author, doc_id as pos
        from {{findings}} where doc_id % 9 = 0""",
    "memories": """
        select cast(conv_id as string) || '-' || cast(turn as string) as name,
            case role when 'system' then 'context' when 'user' then 'pattern' else 'stack' end as type, text as content, role as tag, conv_id, turn
        from {conversations} where text is not null""",
    "gt": """
        select 'VULN-' || cast(doc_id as string) as vuln_id, title, severity, case when doc_id % 35 = 0 and upper(cwe) = 'CWE-330' then 'CWE-338' when doc_id % 10 = 0 and upper(cwe) = 'CWE-89' then 'CWE-564' else cwe end as cwe,
            file, cast(line_start + doc_id % 20 as int) as line_start, tags, doc_id
        from {findings} where doc_id % 5 = 0""",
    "runs": "select cast(doc_id % 4 as int) as run_id, id, title, severity, status, cwe, file, line_start, tags, doc_id from {findings}",
    "gt_fp": "select distinct 'm' || cast(doc_id % 37 as string) || '.py' as file from {findings} where doc_id % 37 in (7, 14, 21)",
    "event_paths": "select event_id, ts, event_type, user_id, (event_id * 37) % 6007 as p from {events}",
    "files_old": """
        select 'f' || cast(p as string) as path, max(epoch_us) as mtime, count(*) as size, min(event_type) || '-' || max(event_type) || '-' || cast(count(*) as string) as sha256
        from (select p, event_type, event_id, {us} as epoch_us from {event_paths}) as e where epoch_us < 1705276800000000 group by p""",
    "files_new": """
        select 'f' || cast(p as string) as path, max(epoch_us) + case when p % 19 = 0 then 1000000 else 0 end as mtime, count(*) as size,
            min(event_type) || '-' || max(event_type) || '-' || cast(count(*) as string) as sha256
        from (select p, event_type, event_id, {us} as epoch_us from {event_paths}) as e where p % 17 <> 0 group by p""",
    "logs": f"""
        select doc_id, cast(doc_id % 4 as int) as exit_code,
            {pick("doc_id % 6", "", "Error 429 Too Many Requests ", "failed to parse the plan ", "", "rate limit reached ", "Unexpected EOF in tool ")} || text as log
        from {{documents}} where doc_id is not null""",
    "manifests": "select 'p' || cast(page_id % 20 as string) as project, url as path, lower(html) as content from {pages} where html is not null",
    "vectors": "select vec_id as chunk_id, embedding, 'f' || cast(vec_id % 50 as string) as file, label % 5 as type, label % 3 as language from {embeddings}",
    "agent_events": "select event_id, cast(user_id % 8 as int) as agent, case event_type when 'view' then 'start' else 'end' end as kind, {us} as at_us from {events} where event_type in ('view', 'purchase')",
}

ENGINE = {"spark": {"us": "unix_micros(cast(ts as timestamp))"}, "duckdb": {"us": "epoch_us(ts)"}}


class Names(dict):
    def __missing__(self, key):
        raise KeyError(f"no view or table {key}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; tags as an array."""
    found: set[str] = set()
    args = {}
    import string

    for _, field, _, _ in string.Formatter().parse(SQL[name]):
        if field and field != "us" and field not in found:
            found.add(field)
            args[field] = spark.read.parquet(f"{sf_dir}/{field}.parquet") if field in TABLES else view(spark, sf_dir, field)
    # The outer views split tags only once: the inner ones keep their text.
    args = {k: v.withColumn("tags", F.array_join("tags", ";")) if "tags" in v.columns else v for k, v in args.items()}
    text = SQL[name].replace("{us}", ENGINE["spark"]["us"])
    out = spark.sql(text, **args)
    return out.withColumn("tags", F.split("tags", ";")) if "tags" in out.columns else out


def duckdb_ctes(names: tuple[str, ...]) -> str:
    """WITH list of the views for DuckDB, inner ones first."""
    import string

    order: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in order:
            return
        for _, field, _, _ in string.Formatter().parse(SQL[name]):
            if field and field != "us":
                add(field)
        order.append(name)

    for name in names:
        add(name)
    fill = Names({k: k for k in [*TABLES]} | {k: f"fx_{k}" for k in SQL} | ENGINE["duckdb"])
    return ", ".join(f"fx_{name} as ({SQL[name].format_map(fill)})" for name in order)
