"""Finding records: filters, validation, fingerprints, duplicates, triage, numbers and statistics.

Null text counts as empty, as in the readers. Windows are partitioned by a
finding's project, file or fingerprint, never by nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta import schemas
from vetta.functions.columns import blank, filled, fingerprint, percentage, severity_rank

EXACT = "severity status confidence exploitability fix_priority cwe file created_by".split()


def filter_findings(df: DataFrame, tag: str | None = None, limit: int | None = None, offset: int = 0, **values) -> DataFrame:
    """Rows with all given values; a tag is compared without case. limit, offset: a page of them in order of id."""
    if unknown := set(values) - set(EXACT):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    for name, value in values.items():
        df = df.where(F.col(name) == value)
    df = df if tag is None else df.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))
    if limit is None and not offset:
        return df
    page = df.orderBy("id").offset(offset)
    return page if limit is None else page.limit(limit)


def first_error(*rules: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(wrong, F.lit(text)) for wrong, text in rules])


def validate_findings(df: DataFrame) -> DataFrame:
    """Normalised findings with the column error: the first rule that a row breaks, or null."""
    out = df.withColumn("severity", F.lower("severity")).withColumn("confidence", filled(F.lower("confidence"), F.lit("medium")))
    optional = [(~blank(F.col(c)) & ~F.col(c).isin(*allowed), f"invalid {c}") for c, allowed in (("status", schemas.STATUS), ("exploitability", schemas.EXPLOITABILITY), ("fix_priority", schemas.FIX_PRIORITY))]
    error = first_error(
        (blank(F.col("title")), "title is required"),
        (blank(F.col("file")), "file is required"),
        (~blank(F.col("severity")) & ~F.col("severity").isin(*schemas.SEVERITY), "invalid severity"),
        (~F.col("confidence").isin(*schemas.CONFIDENCE), "invalid confidence"),
        *optional,
        (F.coalesce("line_start", F.lit(0)) < 1, "line_start must be at least 1"),
    )
    return out.withColumn("error", error)


def check_created_by(df: DataFrame, agents: DataFrame, dispatcher: str = "", runtimes: tuple[str, ...] = ("claude", "codex", "opencode")) -> DataFrame:
    """Who created a finding, and whether that name is known: human: and bot: need a name that isn't a runtime's, others must be an agent's.

    An unknown name falls back to the dispatcher's.
    """
    plain = F.regexp_replace(F.trim(F.coalesce("created_by", F.lit(""))), r"^(?:agent:){1,2}", "")
    kind = F.regexp_extract(plain, r"^(human|bot):", 1)
    suffix = F.trim(F.regexp_replace(plain, r"^(?:human|bot):", ""))
    known = agents.select(F.col("agent").alias("_agent")).distinct()
    out = df.withColumn("_name", plain).join(known, F.col("_name") == F.col("_agent"), "left")
    valid = F.when(kind != "", (suffix != "") & ~F.lower(suffix).isin(*runtimes)).otherwise(F.col("_agent").isNotNull() & (F.col("_name") != ""))
    creator = F.when(valid, F.col("_name")).when(F.lit(dispatcher or "") != "", F.lit(dispatcher))
    return out.withColumn("creator_ok", creator.isNotNull()).withColumn("creator", creator).drop("_name", "_agent")


def scope_to_changed(findings: DataFrame, changed: DataFrame) -> DataFrame:
    return findings.join(changed.select("file"), "file", "left_semi")


def at_least(df: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity or above; an unknown severity doesn't filter."""
    rank = schemas.SEVERITY.get(severity.lower(), 0)
    return df.where(severity_rank(F.col("severity")) >= rank) if rank else df


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(F.col("cwe"), F.col("file"), F.col("function"), F.col("title")))


def dedup_findings(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The earliest finding of each fingerprint and creator; those without a creator all stay.

    stored: findings that are there already (fingerprint, created_by).
    """
    named = df.where(~blank(F.col("created_by")))
    if stored is not None:
        named = named.join(stored.select("fingerprint", "created_by"), ["fingerprint", "created_by"], "left_anti")
    # min_by keeps one row a group in the map-side aggregate; a window would sort whole groups.
    first = named.groupBy("fingerprint", "created_by").agg(F.min_by(F.struct(*df.columns), F.struct("created_at", "id")).alias("r")).select("r.*")
    return first.unionByName(df.where(blank(F.col("created_by"))))


def agreement(df: DataFrame) -> DataFrame:
    """Fingerprints that several creators found."""
    return df.where(~blank(F.col("created_by"))).groupBy("fingerprint").agg(F.countDistinct("created_by").alias("creators"), F.count(F.lit(1)).alias("findings")).where("creators > 1")


def finding_stats(df: DataFrame) -> DataFrame:
    """Counts by dimension and key: (dim, key, n). Blank keys count for the first three dimensions only."""
    dims = "severity status confidence exploitability fix_priority cwe created_by".split()
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d), F.lit("")).alias("key")) for d in dims], F.struct(F.lit("total").alias("dim"), F.lit("").alias("key")))
    rows = df.select(F.explode(pairs).alias("p")).groupBy("p.dim", "p.key").agg(F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("dim").isin("severity", "status", "confidence", "total") | (F.trim("key") != ""))


def top_tags(df: DataFrame, n: int = 10) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def order_findings(df: DataFrame) -> DataFrame:
    """Worst first, then newest, then by id."""
    return df.orderBy(severity_rank(F.col("severity")).desc(), F.col("created_at").desc(), "id")


def numbered(df: DataFrame, group: str, order: list) -> DataFrame:
    """df with _n, a row's number in its group by order.

    Rows are dealt by ranges of group and order, so a large group is spread over many
    tasks; each range numbers its own rows and starts after those of the ranges before.
    """
    from vetta.plans.tables import written

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a range's number is the same wherever it is read.
    ranged = written(df.repartitionByRange(n, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_group").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_group", "_at", before.alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    out = ranged.withColumn("_own", own).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    return out.withColumn("_n", F.col("_start") + F.col("_own")).select(*df.columns, "_n")


def assign_ids(df: DataFrame, project: str, prefix: str, order: list, existing: DataFrame | None = None) -> DataFrame:
    """new_id: the prefix and the next number of the row's project. existing: (project, last)."""
    df = numbered(df, project, order)
    number = F.col("_n")
    if existing is not None:
        df = df.join(existing.select(F.col(project), F.col("last").alias("_last")), project, "left")
        number = number + F.coalesce("_last", F.lit(0))
    return df.withColumn("new_id", F.concat(F.lit(f"{prefix}-"), F.when(number > 999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 3, "0")))).drop("_last", "_n")


def same_file_hint(df: DataFrame, n: int = 5) -> DataFrame:
    """For each finding, how many others its file has, and the ids of the first n of the file."""
    # One row a file carries the count and the n least ids; ids never meet in one long list.
    whole = df.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    first = df.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("id"))).where(F.col("_k") <= n + 1).groupBy("file").agg(F.array_sort(F.collect_list("id")).alias("_first"))
    others = F.slice(F.filter("_first", lambda x: x != F.col("id")), 1, n)
    out = df.join(whole, "file").join(first, "file").withColumn("others", F.col("_n") - 1).withColumn("first_others", F.array_join(others, ","))
    return out.withColumn("more", F.greatest(F.col("others") - n, F.lit(0))).drop("_n", "_first")


CHANGES = {"status": "status", "severity_override": "severity", "confidence_override": "confidence", "fix_priority": "fix_priority", "exploitability": "exploitability", "duplicate_of": "duplicate_of"}


ALLOWED = {"status": schemas.STATUS, "severity_override": tuple(schemas.SEVERITY), "confidence_override": schemas.CONFIDENCE, "fix_priority": schemas.FIX_PRIORITY, "exploitability": schemas.EXPLOITABILITY}


def judged_decisions(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Decisions with their outcome: error (no id, a bad status, or a field that no finding may have), skipped (no such finding) or applied."""
    known = findings.select(F.col("id").alias("finding_id"), F.lit(True).alias("_known"))
    wrong = lambda c, allowed: ~blank(F.col(c)) & ~F.col(c).isin(*allowed) if c in decisions.columns else F.lit(False)
    bad = reduce(lambda a, b: a | b, [F.coalesce(wrong(c, allowed), F.lit(False)) for c, allowed in ALLOWED.items()])
    out = F.when(blank(F.col("finding_id")), "error").when(F.col("_known").isNull(), "skipped").when(bad, "error").otherwise("applied")
    return decisions.join(known, "finding_id", "left").withColumn("outcome", out).drop("_known")


def apply_triage(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with the accepted decisions' fields; of several decisions the last (by pos, their place in the plan) that names a field counts."""
    if "pos" not in decisions.columns:
        raise ValueError("decisions need pos, their place in the plan: the last one counts")
    fields = [c for c in CHANGES if c in decisions.columns]
    order = F.col("pos")
    last = [F.max_by(c, F.when(~blank(F.col(c)), order)).alias(f"_{c}") for c in fields]
    notes = F.sort_array(F.collect_list(F.when(~blank(F.col("reason")), F.struct(order.alias("at"), F.concat_ws(": ", "author", "reason").alias("note")))))
    merged = judged_decisions(decisions, findings).where("outcome = 'applied'").groupBy(F.col("finding_id").alias("id")).agg(*last, F.transform(notes, lambda x: x["note"]).alias("notes"))
    out = findings.join(merged, "id", "left")
    out = reduce(lambda d, c: d.withColumn(CHANGES[c], F.coalesce(filled(F.col(f"_{c}"), F.lit(None)), F.col(CHANGES[c]) if CHANGES[c] in findings.columns else F.lit(None))), fields, out)
    return out.withColumn("notes", F.coalesce("notes", F.array())).drop(*[f"_{c}" for c in fields])


def patch_findings(findings: DataFrame, patch: DataFrame, author: str = "user") -> DataFrame:
    """One decision a finding, from its non-blank fields."""
    return apply_triage(findings, patch.withColumn("author", F.lit(author)).withColumn("pos", F.lit(0)))


def update_findings(stored: DataFrame, changes: DataFrame, as_of: int) -> DataFrame:
    """Stored findings with the non-blank fields of changes (by id); created_at stays, the fingerprint is made anew."""
    fields = [c for c in changes.columns if c != "id"]
    out = stored.join(changes.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields]), "id", "left")
    for c in fields:
        out = out.withColumn(c, F.when(F.coalesce(F.trim(F.col(f"_{c}").cast("string")), F.lit("")) != "", F.col(f"_{c}")).otherwise(F.col(c)))
    return with_fingerprint(out.withColumn("updated_at", F.when(F.col("_hit"), F.lit(as_of)).otherwise(F.col("created_at")))).drop("_hit", *[f"_{c}" for c in fields])


def import_findings(df: DataFrame, stored: DataFrame | None = None, project: str = "project") -> DataFrame:
    """Valid findings of df without duplicates, numbered anew in each project."""
    valid = with_fingerprint(validate_findings(df).where("error is null").drop("error"))
    return assign_ids(dedup_findings(valid, stored), project, "FIND", ["created_at", "id"])


def severity_share(df: DataFrame) -> DataFrame:
    """Severities with their count and whole percentage of all."""
    counts = df.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("severity", "n", percentage(F.col("n"), F.col("total")).alias("percent"))
