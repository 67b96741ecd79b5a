"""Column expressions that several operators use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetta.schemas import LANGUAGE, SEVERITY, TITLE_STOPWORDS


def chosen(column: Column, table: dict, otherwise) -> Column:
    """The value of a small table under a column."""
    out = F.lit(otherwise)
    for k, v in reversed(table.items()):
        out = F.when(column == k, v).otherwise(out)
    return out


def severity_rank(column: Column) -> Column:
    return chosen(F.lower(column), SEVERITY, 0)


def blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def filled(column: Column, other) -> Column:
    """column unless it is null or blank."""
    return F.when(blank(column), other).otherwise(column)


def normal_title(title: Column) -> Column:
    """Lower case, letters and digits only, without the words that don't tell findings apart."""
    words = F.split(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(TITLE_STOPWORDS)), " ")


def fingerprint(cwe: Column, file: Column, function: Column, title: Column) -> Column:
    symbol = F.when(blank(function), "_").otherwise(F.trim(function))
    none = F.lit("")
    return F.sha2(F.concat_ws(":", F.upper(F.trim(F.coalesce(cwe, none))), F.trim(F.coalesce(file, none)), symbol, normal_title(F.coalesce(title, none))), 256)


TOKEN = re.compile(r"\\(?P<quoted>.)|\[(?P<no>\^?)(?P<set>(?:\\.|[^\]\\])+)\]|(?P<many>\*)|(?P<one>\?)|(?P<plain>[^\[\\])", re.DOTALL)


def quoted(c: str) -> str:
    """A character of a class for Java's engine."""
    return c if c.isalnum() else "\\" + c


def glob(pattern: str) -> str | None:
    """A glob as a regular expression: * and ? stop at a slash, [a-z] and [^a-z] are one character, a backslash quotes. None if it is malformed."""
    out, at = "^", 0
    while at < len(pattern):
        m = TOKEN.match(pattern, at)
        if not m:
            return None
        if m["set"]:
            pairs = re.findall(r"(\\.|[^\\])(?:-(\\.|[^\\]))?", m["set"], re.DOTALL)
            if any("-" in pair for pair in pairs):
                return None
            ranges = [(a[-1], (b or a)[-1]) for a, b in pairs]
            body = "".join(f"{quoted(a)}-{quoted(b)}" for a, b in ranges if a <= b)
            out += f"[{m['no']}{body}]" if body else r"[\s\S]" if m["no"] else "(?!)"
        else:
            out += "[^/]*" if m["many"] else "[^/]" if m["one"] else re.escape(m["quoted"] or m["plain"])
        at = m.end()
    return out + "$"


def glob_column(pattern: Column) -> Column:
    """glob() of a column, for the few rows of a table of globs; null where it is malformed, so that nothing matches."""

    @F.pandas_udf("string")
    def regex(patterns):
        return patterns.map(lambda p: None if p is None else glob(p))

    return regex(pattern)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case extension of the last path part, without its point."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]*)$", 1))


def language_of(path: Column) -> Column:
    return chosen(extension(path), LANGUAGE, "unknown")


def any_of(column: Column, patterns) -> Column:
    """Whether any regular expression is found, ignoring case."""
    return column.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def percentage(n: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.floor(100 * n / total)).cast("long")


def redact(column: Column, secret: str) -> Column:
    """column without a secret of at least 8 characters."""
    return F.replace(column, F.lit(secret), F.lit("[REDACTED]")) if len(secret) >= 8 else column


def truncate_bytes(column: Column, n: int = 4096, marker: str = "\n[truncated]") -> Column:
    """At most n bytes of UTF-8, whole characters only, and a marker where something went."""
    head = F.left(column, F.lit(n))
    # Characters take one byte at least, so n of them hold n bytes; those over are taken off the end.
    over = F.octet_length(head) - n
    cut = F.aggregate(F.reverse(F.split(F.right(head, F.lit(n)), "")), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda a, c: F.when(a["bytes"] >= over, a).otherwise(F.struct((a["bytes"] + F.octet_length(c)).alias("bytes"), (a["n"] + 1).alias("n"))))
    short = F.when(over <= 0, head).otherwise(F.left(head, F.length(head) - cut["n"]))
    return F.when(F.octet_length(column) > n, F.concat(short, F.lit(marker))).otherwise(column)
