"""Exceptions: which findings they cover, how long, and what reports leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta.functions.columns import base_name, blank, glob_column, severity_rank
from vetta.functions.sizes import small
from vetta.operators.findings import at_least, first_error, scope_to_changed

DAY = 86400


def parse_expiry(column: Column) -> Column:
    """Epoch seconds of an end given as text: a date alone lasts to its last second in UTC; other text is a time with its zone, UTC without one. Unreadable text is null."""
    text = F.trim(column)
    alone = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = F.when(text.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_seconds(F.try_to_timestamp(F.when(alone, F.concat(text, F.lit("T23:59:59Z"))).otherwise(zoned)))


def active_exceptions(df: DataFrame, as_of: int) -> DataFrame:
    """Exceptions with active and soon (ends within 14 days). No end counts as ended."""
    ends = F.coalesce("expires", F.lit(0))
    active = (ends > 0) & (F.lit(as_of) <= ends)
    return df.withColumn("active", active).withColumn("soon", active & (ends <= as_of + 14 * DAY))


def validate_exceptions(df: DataFrame) -> DataFrame:
    error = first_error(
        (blank(F.col("reason")), "reason is required"),
        (F.coalesce("expires", F.lit(0)) == 0, "expires is required"),
        (blank(F.col("approved_by")), "approved_by is required"),
        (blank(F.col("fingerprint")) & blank(F.col("path_glob")), "fingerprint or path_glob is required"),
        (~blank(F.col("fingerprint")) & ~blank(F.col("path_glob")), "fingerprint and path_glob exclude each other"),
        (~blank(F.col("path_glob")) & blank(F.col("cwe")), "cwe is required with path_glob"),
    )
    return df.withColumn("error", error)


def expire_exceptions(df: DataFrame, as_of: int) -> DataFrame:
    """Exceptions with the action that a clean-up takes: remove, or keep; and whether their id repeats."""
    repeated = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    return active_exceptions(df, as_of).withColumn("action", F.when(F.col("active"), "keep").otherwise("remove")).withColumn("repeated", repeated)


def order_exceptions(df: DataFrame) -> DataFrame:
    return df.orderBy("expires", "id")


def suppressions(findings: DataFrame, exceptions: DataFrame, as_of: int) -> DataFrame:
    """(id, exception): the first active exception, in file order, that covers a finding.

    By equal fingerprint; without one, by equal CWE and a glob over the path or
    its last part. Both are equi joins; the glob is a condition within a CWE. A few CWEs
    hold most findings, so globs up to a checked number are broadcast.
    """
    live = active_exceptions(exceptions, as_of).where("active").select("fingerprint", "path_glob", F.upper(F.trim("cwe")).alias("_cwe"), "pos", F.struct("pos", F.col("id").alias("exception_id"), "reason", "expires", "approved_by").alias("exception"))
    by_print = findings.select("id", "fingerprint").join(live.where(~blank(F.col("fingerprint"))).select("fingerprint", "exception"), "fingerprint").select("id", "exception")
    globs = small(live.where(blank(F.col("fingerprint")) & ~blank(F.col("path_glob"))).select("_cwe", "path_glob", "exception"))
    globs = globs.withColumn("_re", glob_column(F.col("path_glob"))).drop("path_glob")  # after the count, so that it runs once
    keyed = findings.where(~blank(F.col("cwe"))).select("id", "file", F.upper(F.trim("cwe")).alias("_cwe"))
    by_glob = keyed.join(globs, "_cwe").where(F.regexp_like("file", "_re") | F.regexp_like(base_name(F.col("file")), F.col("_re"))).select("id", "exception")
    return by_print.union(by_glob).groupBy("id").agg(F.min("exception").alias("exception"))


def with_suppression(findings: DataFrame, exceptions: DataFrame, as_of: int) -> DataFrame:
    """Findings with exception_id, reason, expires and approved_by of what suppresses them, else null."""
    return findings.join(suppressions(findings, exceptions, as_of), "id", "left").select(*findings.columns, "exception.exception_id", "exception.reason", "exception.expires", "exception.approved_by")


def suppress(findings: DataFrame, exceptions: DataFrame, as_of: int) -> DataFrame:
    """Findings that no exception covers."""
    return findings.join(suppressions(findings, exceptions, as_of), "id", "left_anti")


def pr_report(findings: DataFrame, changed: DataFrame, exceptions: DataFrame, as_of: int) -> DataFrame:
    """Findings of changed files by severity: shown and suppressed."""
    rows = with_suppression(scope_to_changed(findings, changed), exceptions, as_of)
    return rows.groupBy("severity").agg(F.count_if(F.col("exception_id").isNull()).alias("shown"), F.count_if(F.col("exception_id").isNotNull()).alias("suppressed"))


def pr_digest(findings: DataFrame, by: str, n: int = 10, threshold: str = "medium") -> DataFrame:
    """For each group the first n findings at or above a severity, and how many more there are."""
    rows = at_least(findings, threshold).withColumn("rank", severity_rank(F.col("severity")))
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_all"))
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rank"), F.desc("created_at"), "id"))).where(F.col("place") <= n)
    return top.join(total, by).withColumn("more", F.greatest(F.col("_all") - n, F.lit(0))).select(by, "place", "id", "severity", "more")
