"""Rules, agents, notes, projects and the file index: joins, upserts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetta import schemas
from vetta.functions.columns import blank, severity_rank
from vetta.functions.needles import contained, words_in
from vetta.functions.sizes import small

# --- rules ------------------------------------------------------------------


def validate_rules(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """rules (slug, id, message, pattern, and optionally patterns in its place) with error: the first thing wrong, or null.

    files (slug): rule files; one without any rule gets a row of its own.
    """
    twice = F.count(F.lit(1)).over(Window.partitionBy("slug", "id")) > 1
    other = F.col("patterns").isNull() if "patterns" in df.columns else F.lit(True)
    error = F.coalesce(
        F.when(~F.col("slug").rlike("^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$"), "invalid slug"), F.when(blank(F.col("id")), "id is required"), F.when(twice, "id repeats"),
        F.when(blank(F.col("message")), "message is required"), F.when(blank(F.col("pattern")) & other, "pattern or patterns is required"),
    )
    out = df.withColumn("error", error)
    if files is None:
        return out
    empty = files.select("slug").distinct().join(df.select("slug"), "slug", "left_anti").withColumn("error", F.lit("at least one rule is required"))
    return out.unionByName(empty, allowMissingColumns=True)


def attribute_rules(findings: DataFrame, rules: DataFrame, prefix: str = "opengrep-rule:") -> DataFrame:
    """(finding id, slug): the first tag that names a rule, by its id or by what follows its last point."""
    tags = findings.select(F.col("id").alias("finding"), F.posexplode("tags").alias("pos", "tag")).where(F.col("tag").startswith(prefix)).select("finding", "pos", F.substring("tag", len(prefix) + 1, 1 << 20).alias("full"))
    keys = tags.select("finding", "pos", F.explode(F.array_distinct(F.array("full", F.element_at(F.split("full", r"\."), -1)))).alias("id"), "full")
    hits = keys.join(rules.select("id", "slug"), "id").withColumn("exact", F.col("id") == F.col("full"))
    return hits.groupBy("finding").agg(F.min_by("slug", F.struct("pos", ~F.col("exact"), "slug")).alias("slug")).withColumnRenamed("finding", "id")


def rules_with_meta(rules: DataFrame, meta: DataFrame, enabled_only: bool = False) -> DataFrame:
    out = rules.select("slug").distinct().join(meta, "slug", "left").withColumn("disabled", F.coalesce("disabled", F.lit(False)))
    return out.where(~F.col("disabled")) if enabled_only else out


def annotate_rules(meta: DataFrame, verdicts: DataFrame, as_of: int) -> DataFrame:
    """Verdicts (keep, refine, retire, escalate) set on rules; a retired one is disabled."""
    told = verdicts.where(F.col("new_verdict").isin("keep", "refine", "retire", "escalate"))
    out = meta.join(told, "slug", "left")
    hit = F.col("new_verdict").isNotNull()
    return out.withColumn("verdict", F.coalesce("new_verdict", "verdict")).withColumn("disabled", F.when(hit, F.col("new_verdict") == "retire").otherwise(F.col("disabled"))).withColumn("audited", F.when(hit, F.lit(as_of))).drop("new_verdict")


def rule_audit(findings: DataFrame, rules: DataFrame, meta: DataFrame) -> DataFrame:
    """For every rule file: how many findings it made, and how many of them were false."""
    of = attribute_rules(findings, rules).join(findings.select("id", "status"), "id")
    counts = of.groupBy("slug").agg(F.count(F.lit(1)).alias("triggers"), F.count_if(F.col("status") == "false_positive").alias("false_positives"))
    return rules_with_meta(rules, meta).join(counts, "slug", "left").na.fill(0, ["triggers", "false_positives"])


# --- agents and notes ----------------------------------------------------------


def check_ownership(findings: DataFrame, agent_cwes: DataFrame) -> DataFrame:
    """Findings whose creator has a list of CWEs that theirs isn't on."""
    listed = agent_cwes.select(F.col("agent").alias("created_by")).distinct()
    named = findings.where(~blank(F.col("created_by")) & ~blank(F.col("cwe"))).join(listed, "created_by", "left_semi")
    own = agent_cwes.select(F.col("agent").alias("created_by"), F.upper("cwe").alias("_cwe")).distinct()
    return named.withColumn("_cwe", F.upper(F.trim("cwe"))).join(own, ["created_by", "_cwe"], "left_anti").drop("_cwe")


def scope_check(findings: DataFrame, agent_cwes: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings that are taken and those out of their creator's scope. Strict: the latter aren't taken; else they are, with a warning."""
    outside = check_ownership(findings, agent_cwes)
    told = outside.select("id", F.concat("cwe", F.lit(" is not owned by "), "created_by").alias("warning"))
    taken = findings.join(told, "id", "left")
    return taken.where("warning is null") if strict else taken, outside


def adherence(findings: DataFrame, checklist: DataFrame) -> DataFrame:
    """For each creator, findings in and out of its checklist; creators without an agent are unknown.

    checklist: agent, cwe (null for an agent without one). A finding without CWE is out, unless the agent lists none.
    """
    named = findings.where(~blank(F.col("created_by")))
    agents = checklist.groupBy(F.col("agent").alias("created_by")).agg(F.count("cwe").alias("_n"))
    own = checklist.where("cwe is not null").select(F.col("agent").alias("created_by"), F.upper("cwe").alias("_cwe"), F.lit(True).alias("_hit")).distinct()
    rows = named.withColumn("_cwe", F.upper(F.trim("cwe"))).join(agents, "created_by", "left").join(own, ["created_by", "_cwe"], "left")
    inside = F.coalesce(F.col("_n") == 0, F.lit(False)) | F.coalesce("_hit", F.lit(False))
    return rows.groupBy("created_by").agg(F.max(F.col("_n").isNull()).alias("unknown"), F.count_if(inside & F.col("_n").isNotNull()).alias("inside"), F.count_if(~inside & F.col("_n").isNotNull()).alias("outside"))


def suggest_agents(projects: DataFrame, agents: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(project, agent) where the agent always applies or shares a type or a trait with the project. overrides: agents that replace those of the same name."""
    if overrides is not None:
        agents = agents.join(overrides, "agent", "left_anti").unionByName(overrides)
    # Types and traits are equi joins; only agents that always apply meet every project, as each such pair is a row of the result.
    shared = [projects.select("project", F.explode(a).alias("k")).join(agents.select("agent", F.explode(b).alias("k")), "k").select("project", "agent") for a, b in (("types", "for_types"), ("traits", "for_traits"))]
    return projects.select("project").crossJoin(small(agents.where("always").select("agent"))).union(shared[0]).union(shared[1]).distinct()


def priority_cap(suggested: DataFrame, group: str, priority: list[str] = schemas.FAST_PRIORITY, n: int = 5, last: str = "validation-agent") -> DataFrame:
    """The first n suggested agents by priority in each group, and the validation agent besides if it is suggested."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("agent"))
    ranked = suggested.where(place > 0).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(place))).where(F.col("place") <= n)
    return ranked.unionByName(suggested.where(F.col("agent") == last).withColumn("place", F.lit(n + 1)))


def verify_memories(required: DataFrame, memories: DataFrame) -> DataFrame:
    """For each agent, how many of its required notes (agent, name) there are and which are missing."""
    have = memories.select("name", F.lit(True).alias("_have")).distinct()
    return required.distinct().join(have, "name", "left").groupBy("agent").agg(F.count(F.lit(1)).alias("required"), F.count("_have").alias("present"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_have").isNull(), F.col("name")))), ",").alias("missing"))


def verify_in_total(required: DataFrame, memories: DataFrame) -> DataFrame:
    """One row over all agents: how many agents ask for notes and how many of these have them all, and what they ask for and what there is."""
    rows = verify_memories(required, memories)
    return rows.agg(F.count(F.lit(1)).alias("agents"), F.count_if(F.col("present") == F.col("required")).alias("complete"), F.coalesce(F.sum("required"), F.lit(0)).alias("required"), F.coalesce(F.sum("present"), F.lit(0)).alias("present"))


def cross_references(memories: DataFrame) -> DataFrame:
    """(source, target) where a note's text contains another note's name, without case, anywhere in it."""
    names = memories.select("name", F.lower("name").alias("_low")).distinct()
    hits = contained(memories.select(F.col("name").alias("source"), F.lower("content").alias("_text")), "source", "_text", names, "_low")
    return hits.join(names, "_low").where("source <> name").select("source", F.col("name").alias("target")).distinct()


def context_audit(memories: DataFrame, required: DataFrame) -> DataFrame:
    """(kind, name, detail): required notes that are missing, with their agents; notes that others name, with how many; and notes that nobody needs or names."""
    names = memories.select("name").distinct()
    agents = F.array_join(F.array_sort(F.collect_set("agent")), ",")
    missing = required.join(names, "name", "left_anti").groupBy("name").agg(agents.alias("detail")).select(F.lit("missing").alias("kind"), "name", "detail")
    refs = cross_references(memories).groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).cast("string").alias("detail"))
    orphans = names.join(required, "name", "left_anti").join(refs, "name", "left_anti")
    return missing.union(refs.select(F.lit("referenced"), "name", "detail")).union(orphans.select(F.lit("orphan"), "name", F.lit("")))


def memory_by_name(memories: DataFrame) -> DataFrame:
    """One note a name: context before pattern before stack."""
    rank = F.when(F.col("type") == "context", 0).when(F.col("type") == "pattern", 1).otherwise(2)
    return memories.groupBy("name").agg(F.min_by(F.struct("type", "content"), rank).alias("m")).select("name", "m.*")


def memories_of(memories: DataFrame, type: str) -> DataFrame:
    if type not in ("context", "pattern", "stack"):
        raise ValueError(f"no such type: {type}")
    return memories.where(F.col("type") == type)


def upsert_memories(stored: DataFrame, incoming: DataFrame, overwrite: bool = True) -> DataFrame:
    """Notes after an upsert by name, with action: a known one keeps its type and created_at; without overwrite it is refused."""
    new = incoming.groupBy("name").agg(F.max_by(F.struct("type", "content", "at"), "at").alias("n"))
    out = stored.join(new, "name", "full_outer")
    known, come = F.col("created_at").isNotNull(), F.col("n").isNotNull()
    change = known & come & F.lit(overwrite)
    action = F.when(~known, "created").when(change, "updated").when(come, "refused").otherwise("kept")
    return out.select("name", F.coalesce("type", "n.type").alias("type"), F.when(change | ~known, F.col("n.content")).otherwise(F.col("content")).alias("content"), F.coalesce("created_at", "n.at").alias("created_at"), F.when(change, F.col("n.at")).alias("updated_at"), action.alias("action"))


def completeness(required: DataFrame, checklist: DataFrame, memories: DataFrame, findings: DataFrame) -> DataFrame:
    """Percent done of each agent: 60 by required notes that are there, 40 by checklist CWEs with a finding of its own or a note that says there is none; and what follows.

    The checklist is a list of fixed size; where notes have a content, each is read once for all of it.
    """
    have = memories.select("name", F.lit(1).alias("_h")).distinct()
    notes = required.distinct().join(have, "name", "left").groupBy("agent").agg(F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("notes"))
    listed = checklist.where("cwe is not null").distinct()
    seen = findings.where(~blank(F.col("cwe"))).select(F.col("created_by").alias("agent"), F.upper("cwe").alias("_cwe"))
    if "content" in memories.columns:
        named = [r["cwe"] for r in listed.select("cwe").distinct().collect()]
        phrases = {p.format(c): c for c in named for p in ("no findings for {}", "no {} findings", "No {}")}
        none = memories.select(F.explode(words_in(F.col("content"), list(phrases))).alias("phrase")).distinct()
        told = none.select(F.upper(F.regexp_extract("phrase", r"^(?:no findings for |[nN]o )(.*?)(?: findings)?$", 1)).alias("_cwe"))
        seen = seen.union(told.join(listed.select("agent", F.upper("cwe").alias("_cwe")), "_cwe").select("agent", "_cwe"))
    cwes = listed.withColumn("_cwe", F.upper("cwe")).join(seen.distinct().withColumn("_h", F.lit(1)), ["agent", "_cwe"], "left").groupBy("agent").agg(F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("cwes"))
    both = notes.join(cwes, "agent", "full_outer")
    percent = F.floor(F.round(60 * F.coalesce("notes", F.lit(1.0)) + 40 * F.coalesce("cwes", F.lit(1.0)), 6)).cast("int")
    return both.select("agent", percent.alias("percent")).withColumn("next", F.when(F.col("percent") >= 90, "report").when(F.col("percent") >= 60, "gaps").otherwise("continue"))


def next_steps(findings: DataFrame, required: DataFrame, checklist: DataFrame, memories: DataFrame) -> DataFrame:
    """(rank, step, n) of what is left to do, most urgent first; steps with nothing to do are left out."""
    one = lambda df, rank, step: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rank).alias("rank"), F.lit(step).alias("step"), "n")
    open_ = findings.where("status = 'open'")
    missing = required.select("name").distinct().join(memories.select("name"), "name", "left_anti")
    uncovered = checklist.where("cwe is not null").select("cwe").distinct().join(findings.select(F.upper("cwe").alias("cwe")), "cwe", "left_anti")
    steps = one(open_.where(severity_rank(F.col("severity")) >= 4), 1, "triage open high and critical findings").union(one(missing, 2, "write missing notes")).union(one(uncovered, 3, "look for uncovered CWEs")).union(one(open_.where(blank(F.col("cwe"))), 4, "name the CWE of open findings"))
    return steps.where("n > 0")


def hypotheses(tech: str, memories: DataFrame, hints: DataFrame, n: int = 10, checklist: DataFrame | None = None) -> DataFrame:
    """CWEs by how much the tech text (2 a word) and the notes (1 a note) hint at them. hints: cwe, word, a list of fixed size.

    checklist (cwe): those of the applicable agents; only they are candidates, but all are where it is empty.
    """
    if checklist is not None and not checklist.isEmpty():
        hints = hints.join(checklist.select("cwe").distinct(), "cwe", "left_semi")
    pairs = [(r["cwe"], r["word"].lower()) for r in hints.distinct().collect()]
    kinds = {w: sorted(c for c, x in pairs if x == w) for w in {w for _, w in pairs}}
    tech = tech.lower()
    rated = {c: 2 * sum(w in tech for x, w in pairs if x == c) for c, _ in pairs}
    spark = memories.sparkSession
    rows = spark.createDataFrame(sorted(rated.items()), "cwe string, t int")
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in sorted(kinds.items()) for x in pair]) if kinds else F.create_map().cast("map<string,array<string>>")
    found = F.array_distinct(F.flatten(F.transform(words_in(F.lower("content"), list(kinds)), lambda w: F.element_at(table, w))))
    hits = memories.select(F.explode(found).alias("cwe")).groupBy("cwe").agg(F.count(F.lit(1)).alias("m"))
    out = rows.join(hits, "cwe", "left").select("cwe", (F.col("t") + F.coalesce("m", F.lit(0))).alias("score")).where("score > 0")
    return out.orderBy(F.desc("score"), "cwe").limit(n)


def run_manifest(findings: DataFrame, memories: DataFrame, timings: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """For each agent its findings, notes and milliseconds, and with agents (agent, phase) its phase, empty for an unknown one. memories and timings: agent, and ms."""
    f = findings.groupBy(F.col("created_by").alias("agent")).agg(F.count(F.lit(1)).alias("findings"))
    m = memories.groupBy("agent").agg(F.count(F.lit(1)).alias("notes"))
    t = timings.groupBy("agent").agg(F.sum("ms").alias("ms"))
    out = f.join(m, "agent", "full_outer").join(t, "agent", "full_outer").where(~F.col("agent").isin("", "unknown")).na.fill(0, ["findings", "notes", "ms"])
    return out if agents is None else out.join(agents.select("agent", "phase"), "agent", "left").na.fill("", ["phase"])


def starter_memories(projects: DataFrame) -> DataFrame:
    """An overview note for each project, and one for each of its languages and frameworks (project, languages: array of struct name, frameworks)."""
    pairs = projects.select("project", F.explode("languages").alias("l")).select("project", F.explode_outer("l.frameworks").alias("framework"), F.col("l.name").alias("language"))
    each = pairs.select("project", F.concat_ws("-", "language", "framework").alias("name")).distinct()
    return projects.select("project", F.lit("overview").alias("name")).distinct().union(each)


def agents_by(agents: DataFrame, phase: str | None = None, cwe: str | None = None, category: str | None = None) -> DataFrame:
    """Agents of a phase, with a CWE among those they own, and with a category among those they review."""
    out = agents if phase is None else agents.where(F.col("phase") == phase)
    out = out if cwe is None else out.where(F.array_contains("owns", cwe))
    return out if category is None else out.where(F.array_contains("reviews", category))


def examples_for(examples: DataFrame, cwes: DataFrame, language: str | None = None) -> DataFrame:
    out = examples.join(cwes.select("cwe"), "cwe", "left_semi")
    return out if language is None else out.where(F.col("language") == language)


# --- the file index -------------------------------------------------------------


def index_diff(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action) over all paths: delete, first_index, skip (same time and size), touch (same hash) or reindex."""
    s, c = stored.alias("s"), current.alias("c")
    both = s.join(c, "path", "full_outer")
    action = F.when(F.col("c.size").isNull(), "delete").when(F.col("s.size").isNull(), "first_index").when((F.col("s.mtime") == F.col("c.mtime")) & (F.col("s.size") == F.col("c.size")), "skip").when(F.col("s.sha256") == F.col("c.sha256"), "touch").otherwise("reindex")
    return both.select("path", action.alias("action"))


def upsert_chunks(index: DataFrame, changes: DataFrame, actions: DataFrame) -> DataFrame:
    """The index after its changed and deleted files' chunks gave way to new ones; of equal ids the last start_line stays."""
    gone = actions.where(F.col("action").isin("delete", "reindex", "first_index")).select(F.col("path").alias("file"))
    new = changes.groupBy("id").agg(F.max_by(F.struct(*changes.columns), "start_line").alias("r")).select("r.*")
    kept = index.join(gone, "file", "left_anti").join(new, "id", "left_anti")
    return kept.unionByName(new)


def pair_events(events: DataFrame, key: str = "agent") -> DataFrame:
    """Ends with the milliseconds since the latest start of their key; a start opens anew, an end closes."""
    order = Window.partitionBy(key).orderBy("at_us", "event_id")
    before = events.withColumn("_kind", F.lag("kind").over(order)).withColumn("_at", F.lag("at_us").over(order))
    return before.where("kind = 'end' and _kind = 'start'").select(key, "event_id", F.floor((F.col("at_us") - F.col("_at")) / 1000).cast("long").alias("ms"))


def bursts(events: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Events of a key closer than the gap to the one before as one burst: key, first, last, n."""
    order = Window.partitionBy(key).orderBy("at_us")
    new = (F.col("at_us") - F.lag("at_us").over(order) > gap_us).cast("int")
    rows = events.withColumn("_b", F.sum(F.coalesce(new, F.lit(1))).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy(key, "_b").agg(F.min("at_us").alias("first"), F.max("at_us").alias("last"), F.count(F.lit(1)).alias("n")).drop("_b")


