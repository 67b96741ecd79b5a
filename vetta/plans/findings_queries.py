"""Queries on findings and exceptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetta.catalog import query
from vetta.functions.columns import severity_rank
from vetta.operators import findings as op
from vetta.operators import suppress as sup
from vetta.plans.fixtures import AS_OF, pick, view
from vetta.schemas import EXPLOITABILITY, FIX_PRIORITY, STATUS, TITLE_STOPWORDS

WORDS = ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)
RANK = "case lower(severity) when 'critical' then 5 when 'high' then 4 when 'medium' then 3 when 'low' then 2 when 'info' then 1 else 0 end"


def fp_sql(table: str) -> str:
    return f"""select *, sha256(concat_ws(':', upper(trim(cwe)), trim(file), case when trim(function) = '' then '_' else trim(function) end,
        coalesce(array_to_string(list_filter(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w not in ({WORDS})), ' '), ''))) as fingerprint from {table}"""


FP = f"fp as ({fp_sql('fx_findings_dup')})"
FIRST = "kept as (select * from (select *, row_number() over (partition by fingerprint, created_by order by created_at, id) as k from fp where created_by <> '') as x where k = 1)"


def dup(spark, d):
    return op.with_fingerprint(view(spark, d, "findings_dup"))


@query(f"with {FP} select id, fingerprint from fp", "findings_dup")
def set1_fingerprint(spark, d):
    return dup(spark, d).select("id", "fingerprint")


@query(f"with {FP}, {FIRST} select id, fingerprint, created_by from kept union all select id, fingerprint, created_by from fp where created_by = ''", "findings_dup")
def set2_dedup(spark, d):
    return op.dedup_findings(dup(spark, d)).select("id", "fingerprint", "created_by")


@query(f"with {FP} select id, fingerprint from fp where id like '%-D' and (created_by = '' or (fingerprint, created_by) not in (select (fingerprint, created_by) from fp where id not like '%-D' and doc_id % 8 = 0))", "findings_dup")
def set2_dedup_incremental(spark, d):
    rows = dup(spark, d)
    return op.dedup_findings(rows.where("id like '%-D'"), rows.where("id not like '%-D' and doc_id % 8 = 0")).select("id", "fingerprint")


@query(f"with {FP} select fingerprint, count(distinct created_by) as creators, count(*) as findings from (select fingerprint, created_by from fp where created_by <> '' union all select fingerprint, 'other-' || created_by from fp where created_by <> '' and doc_id % 3 = 0) as x group by 1 having count(distinct created_by) > 1", "findings_dup")
def set3_agreement(spark, d):
    rows = dup(spark, d)
    more = rows.where("doc_id % 3 = 0 and created_by <> ''").withColumn("created_by", F.concat(F.lit("other-"), "created_by"))
    return op.agreement(rows.unionByName(more))


DIMS = "severity status confidence exploitability fix_priority cwe created_by".split()
STATS = " union all ".join(f"select '{c}' as dim, {c} as key, count(*) as n from kept group by 2" for c in DIMS[:3]) + "".join(f" union all select '{c}', {c}, count(*) from kept where trim({c}) <> '' group by 2" for c in DIMS[3:]) + " union all select 'total', '', count(*) from kept"


@query(f"with {FP}, first as (select * from (select *, row_number() over (partition by fingerprint, created_by order by created_at, id) as k from fp where created_by <> '') as x where k = 1), kept as (select * exclude (k) from first union all select * from fp where created_by = '') {STATS}", "findings_dup")
def agg1_finding_stats(spark, d):
    return op.finding_stats(op.dedup_findings(dup(spark, d)))


@query("select tag, count(*) as n from (select unnest(string_split(tags, ';')) as tag from fx_findings) as t group by tag order by n desc, tag limit 10", "findings")
def agg2_top_tags(spark, d):
    return op.top_tags(view(spark, d, "findings"))


@query("select id, severity, status from fx_findings where severity = 'high' and status = 'open' and list_contains(list_transform(string_split(tags, ';'), lambda t: lower(t)), 'sast')", "findings")
def fil1_filter(spark, d):
    return op.filter_findings(view(spark, d, "findings"), tag="SAST", severity="high", status="open").select("id", "severity", "status")


@query("select id, created_by from fx_findings where confidence = 'medium' and created_by = 'agent-1' order by id limit 50 offset 20", "findings")
def fil1_page(spark, d):
    return op.filter_findings(view(spark, d, "findings"), confidence="medium", created_by="agent-1", limit=50, offset=20).select("id", "created_by")


def spoiled(spark, d):
    """Findings with faults planted by doc_id."""
    spoil = lambda c, n, v: F.when(F.col("doc_id") % n == 1, F.lit(v)).otherwise(F.col(c))
    rows = view(spark, d, "findings")
    return rows.withColumn("title", spoil("title", 19, " ")).withColumn("file", spoil("file", 23, "")).withColumn("severity", F.when(F.col("doc_id") % 29 == 1, "urgent").when(F.col("doc_id") % 31 == 1, "").otherwise(F.upper("severity"))).withColumn("confidence", spoil("confidence", 7, "")).withColumn("line_start", F.when(F.col("doc_id") % 37 == 1, 0).otherwise(F.col("line_start"))).withColumns({c: F.expr(TURNS[c]) for c in TURNS})


def turns(n: str, values) -> str:
    """Each value by turns, then the empty string and a wrong one."""
    return pick(n, *values, "", "wrong")


TURNS = {"status": turns(f"doc_id % {len(STATUS) + 2}", STATUS), "exploitability": turns(f"doc_id % {len(EXPLOITABILITY) + 2}", EXPLOITABILITY), "fix_priority": turns(f"doc_id div 7 % {len(FIX_PRIORITY) + 2}", FIX_PRIORITY)}
# Literals, so that the values are told twice.
STATUS_SQL = "case doc_id % 7 when 0 then 'open' when 1 then 'confirmed' when 2 then 'false_positive' when 3 then 'fixed' when 4 then 'duplicate' when 5 then '' else 'wrong' end"
EXPLOIT_SQL = "case doc_id % 7 when 0 then 'proven' when 1 then 'likely' when 2 then 'possible' when 3 then 'unlikely' when 4 then 'unknown' when 5 then '' else 'wrong' end"
FIX_SQL = "case doc_id // 7 % 7 when 0 then 'immediate' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'defer' when 5 then '' else 'wrong' end"


SPOILED = f"""s as (select doc_id, id, {STATUS_SQL} as status, {EXPLOIT_SQL} as exploitability, {FIX_SQL} as fix_priority, case when doc_id % 19 = 1 then ' ' else title end as title, case when doc_id % 23 = 1 then '' else file end as file,
    case when doc_id % 29 = 1 then 'urgent' when doc_id % 31 = 1 then '' else severity end as severity, case when doc_id % 7 = 1 then 'medium' else confidence end as confidence,
    case when doc_id % 37 = 1 then 0 else line_start end as line_start, created_by, created_at, source_of from (select *, split_part(file, '/', 2) as source_of from fx_findings) as f)"""


@query(f"with {SPOILED} select id, severity, confidence, status, exploitability, fix_priority, case when trim(title) = '' then 'title is required' when trim(file) = '' then 'file is required' when severity not in ('', 'critical', 'high', 'medium', 'low', 'info') then 'invalid severity' when status not in ('', 'open', 'confirmed', 'false_positive', 'fixed', 'duplicate') then 'invalid status' when exploitability not in ('', 'proven', 'likely', 'possible', 'unlikely', 'unknown') then 'invalid exploitability' when fix_priority not in ('', 'immediate', 'high', 'medium', 'low', 'defer') then 'invalid fix_priority' when line_start < 1 then 'line_start must be at least 1' end as error from s", "findings")
def fil2_validate(spark, d):
    return op.validate_findings(spoiled(spark, d)).select("id", "severity", "confidence", "status", "exploitability", "fix_priority", "error")


NAMES = "case doc_id % 9 when 0 then 'human:' when 1 then 'human:ann' when 2 then 'bot:claude' when 3 then 'agent:agent:' || created_by when 4 then 'nobody' when 5 then '' else created_by end"


@query(f"""with n as (select id, {NAMES} as who, created_by, doc_id from fx_findings),
    p as (select id, regexp_replace(who, '^(agent:){{1,2}}', '') as name from n),
    k as (select distinct created_by as agent from fx_findings where created_by <> '' and created_by <> 'agent-4')
    select id, coalesce(case when name like 'human:%' or name like 'bot:%' then case when split_part(name, ':', 2) not in ('', 'claude', 'codex', 'opencode') then name end when name in (select agent from k) then name end, 'dispatcher') as creator from p""", "findings")
def fil3_created_by(spark, d):
    rows = view(spark, d, "findings")
    agents = rows.where("created_by not in ('', 'agent-4')").select(F.col("created_by").alias("agent"))
    return op.check_created_by(rows.withColumn("created_by", F.expr(NAMES)), agents, "dispatcher").select("id", "creator")


@query("select id, file from fx_findings where file in (select file from fx_changed)", "findings", "changed")
def fil4_changed(spark, d):
    return op.scope_to_changed(view(spark, d, "findings"), view(spark, d, "changed")).select("id", "file")


@query(f"select id, severity from fx_findings where {RANK} >= 4", "findings")
def fil5_at_least(spark, d):
    return op.at_least(view(spark, d, "findings"), "high").select("id", "severity")


@query(f"select id, rank, row_number() over (partition by file order by rank desc, created_at desc, id) as place from (select *, {RANK} as rank from fx_findings) as f", "findings")
def top1_order(spark, d):
    from pyspark.sql import Window

    rows = view(spark, d, "findings").withColumn("rank", severity_rank(F.col("severity")))
    return rows.select("id", "rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("rank"), F.desc("created_at"), "id")).alias("place"))


@query("""with f as (select *, split_part(file, '/', 2) as project from fx_findings), l as (select project, count(*) as last from f where doc_id % 3 = 0 group by 1)
    select id, project, 'FIND-' || case when n > 999 then cast(n as varchar) else lpad(cast(n as varchar), 3, '0') end as new_id from (select id, project, coalesce(last, 0) + row_number() over (partition by project order by created_at, id) as n from f left join l using (project) where doc_id % 3 <> 0) as x""", "findings")
def win1_ids(spark, d):
    rows = view(spark, d, "findings").withColumn("project", F.split_part("file", F.lit("/"), F.lit(2)))
    last = rows.where("doc_id % 3 = 0").groupBy("project").agg(F.count(F.lit(1)).alias("last"))
    return op.assign_ids(rows.where("doc_id % 3 <> 0"), "project", "FIND", ["created_at", "id"], last).select("id", "project", "new_id")


@query("""with o as (select id, file, count(*) over (partition by file) - 1 as others from fx_findings),
    j as (select a.id, b.id as other, row_number() over (partition by a.id order by b.id) as k from fx_findings as a join fx_findings as b on a.file = b.file and a.id <> b.id)
    select o.id, o.others, greatest(o.others - 5, 0) as more, coalesce((select string_agg(other, ',' order by other) from j where j.id = o.id and k <= 5), '') as first_others from o""", "findings")
def rec6_same_file(spark, d):
    return op.same_file_hint(view(spark, d, "findings")).select("id", "others", "more", "first_others")


STATUSES = "'open', 'confirmed', 'false_positive', 'fixed', 'duplicate'"
JUDGED = f"""j as (select d.*, case when trim(finding_id) = '' then 'error' when f.id is null then 'skipped' when d.status not in ({STATUSES}) then 'error' when severity_override not in ('', 'critical', 'high', 'medium', 'low', 'info') then 'error' else 'applied' end as outcome
    from fx_decisions as d left join (select id from fx_findings) as f on f.id = d.finding_id)"""


@query(f"with {JUDGED} select outcome, status, count(*) as n from j group by 1, 2", "findings", "decisions")
def set7_triage_outcomes(spark, d):
    return op.judged_decisions(view(spark, d, "decisions"), view(spark, d, "findings")).groupBy("outcome", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {JUDGED} select f.id, coalesce(j.status, f.status) as status, case when coalesce(j.severity_override, '') <> '' then j.severity_override else f.severity end as severity,
    case when j.reason <> '' then 'triager: ' || j.reason else '' end as notes from fx_findings as f left join j on j.finding_id = f.id and outcome = 'applied'""", "findings", "decisions")
def set7_triage(spark, d):
    out = op.apply_triage(view(spark, d, "findings"), view(spark, d, "decisions"))
    return out.select("id", "status", "severity", F.array_join("notes", "|").alias("notes"))


@query("select f.id, case when doc_id % 10 = 0 then 'fixed' else status end as status, case when doc_id % 10 = 0 then 'user: patched' else '' end as notes from fx_findings as f", "findings")
def rec7_patch(spark, d):
    rows = view(spark, d, "findings")
    patch = rows.where("doc_id % 10 = 0").select(F.col("id").alias("finding_id"), F.lit("fixed").alias("status"), F.lit("patched").alias("reason"))
    return op.patch_findings(rows, patch).select("id", "status", F.array_join("notes", "|").alias("notes"))


@query(f"with u as (select * replace (case when doc_id % 10 = 0 then 'CWE-22' else cwe end as cwe) from fx_findings), fp as ({fp_sql('u')}) select id, cwe, created_at, case when doc_id % 10 = 0 then {AS_OF} else created_at end as updated_at, fingerprint from fp", "findings")
def set8_update(spark, d):
    rows = view(spark, d, "findings")
    changes = rows.where("doc_id % 10 = 0").select("id", F.lit("CWE-22").alias("cwe"), F.lit("").alias("title"))
    return op.update_findings(rows, changes, AS_OF).select("id", "cwe", "created_at", F.col("updated_at").cast("long"), "fingerprint")


@query(f"""with {FP}, f as (select *, split_part(file, '/', 2) as project from fp), k as (select * from (select *, row_number() over (partition by fingerprint, created_by order by created_at, id) as k from f where created_by <> '') as x where k = 1),
    u as (select id, project, created_at from k union all select id, project, created_at from f where created_by = '')
    select id, project, 'FIND-' || case when n > 999 then cast(n as varchar) else lpad(cast(n as varchar), 3, '0') end as new_id from (select id, project, row_number() over (partition by project order by created_at, id) as n from u) as x""", "findings_dup")
def rec8_import(spark, d):
    rows = view(spark, d, "findings_dup").withColumn("project", F.split_part("file", F.lit("/"), F.lit(2)))
    return op.import_findings(rows).select("id", "project", "new_id")


@query("select severity, count(*) as n, cast(floor(100 * count(*) / (select count(*) from fx_findings)) as bigint) as percent from fx_findings group by 1", "findings")
def rec14_percentage(spark, d):
    return op.severity_share(view(spark, d, "findings"))


ACTIVE = f"(expires > 0 and {AS_OF} <= expires)"


@query(f"select id, pos, {ACTIVE} as active, {ACTIVE} and expires <= {AS_OF + 14 * 86400} as soon from fx_exceptions", "exceptions")
def fil14_active(spark, d):
    return sup.active_exceptions(view(spark, d, "exceptions"), AS_OF).select("id", F.col("pos").cast("long"), "active", "soon")


# Ends as people write them: a date, a time with its zone or without one, and no date at all.
ENDS = "case pos % 4 when 0 then '2024-01-15' when 1 then ' 2024-01-14T08:00:00Z' when 2 then '2024-01-15T01:00:00+02:00' else 'soon' end"


@query(f"select id, pos, case pos % 4 when 0 then {AS_OF + 86399} when 1 then {AS_OF - 57600} when 2 then {AS_OF - 3600} end as ends from fx_exceptions", "exceptions")
def fil14_dates(spark, d):
    return view(spark, d, "exceptions").select("id", F.col("pos").cast("long").alias("pos"), sup.parse_expiry(F.expr(ENDS)).alias("ends"))


@query("select id, case when trim(approved_by) = '' then 'approved_by is required' end as error from fx_exceptions", "exceptions")
def fil15_exceptions(spark, d):
    return sup.validate_exceptions(view(spark, d, "exceptions")).select("id", "error")


@query("select id, row_number() over (partition by reason order by expires, id) as place from fx_exceptions", "exceptions")
def top2_exceptions(spark, d):
    from pyspark.sql import Window

    return view(spark, d, "exceptions").select("id", F.row_number().over(Window.partitionBy("reason").orderBy("expires", "id")).alias("place"))


@query(f"select id, case when {ACTIVE} then 'keep' else 'remove' end as action, count(*) over (partition by id) > 1 as repeated from fx_exceptions", "exceptions")
def rec11_expire(spark, d):
    return sup.expire_exceptions(view(spark, d, "exceptions"), AS_OF).select("id", "action", "repeated")


SUPPRESSED = f"""live as (select *, '^' || replace(replace(replace(path_glob, '.', '\\.'), '*', '[^/]*'), '?', '[^/]') || '$' as re from fx_exceptions where {ACTIVE}),
    hits as (select f.id, e.id as exception_id, e.pos, e.reason, e.approved_by from fx_findings as f join live as e on e.fingerprint = f.id
        union all select f.id, e.id, e.pos, e.reason, e.approved_by from fx_findings as f join live as e on e.fingerprint = '' and upper(trim(f.cwe)) = upper(trim(e.cwe)) and f.cwe <> ''
            and (regexp_matches(f.file, e.re) or regexp_matches(split_part(f.file, '/', -1), e.re))),
    first as (select * from (select *, row_number() over (partition by id order by pos) as k from hits) as x where k = 1)"""


def printed(spark, d):
    """Findings whose id serves as the fingerprint that exceptions name."""
    return view(spark, d, "findings").withColumn("fingerprint", F.col("id"))


@query(f"with {SUPPRESSED} select id, file from fx_findings where id not in (select id from first)", "findings", "exceptions")
def jn1_suppress(spark, d):
    return sup.suppress(printed(spark, d), view(spark, d, "exceptions"), AS_OF).select("id", "file")


@query(f"with {SUPPRESSED} select f.id, exception_id, reason, approved_by from fx_findings as f left join first using (id)", "findings", "exceptions")
def rec13_with_suppression(spark, d):
    return sup.with_suppression(printed(spark, d), view(spark, d, "exceptions"), AS_OF).select("id", "exception_id", "reason", "approved_by")


@query(f"with {SUPPRESSED} select severity, count(*) filter (exception_id is null) as shown, count(exception_id) as suppressed from fx_findings as f left join first using (id) where file in (select file from fx_changed) group by 1", "findings", "exceptions", "changed")
def agg6_pr_report(spark, d):
    return sup.pr_report(printed(spark, d), view(spark, d, "changed"), view(spark, d, "exceptions"), AS_OF)


@query(f"""with r as (select *, split_part(file, '/', 2) as pr, {RANK} as rank from fx_findings where {RANK} >= 3), t as (select pr, count(*) as n from r group by 1)
    select pr, place, id, severity, greatest(n - 10, 0) as more from (select *, row_number() over (partition by pr order by rank desc, created_at desc, id) as place from r) as x join t using (pr) where place <= 10""", "findings")
def top3_digest(spark, d):
    rows = view(spark, d, "findings").withColumn("pr", F.split_part("file", F.lit("/"), F.lit(2)))
    return sup.pr_digest(rows, "pr")
