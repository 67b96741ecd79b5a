"""Lines, searches, symbols, blocks and chunks of source text; notes, logs and manifests."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetta import schemas
from vetta.functions.columns import any_of, base_name, blank, extension, glob, language_of, truncate_bytes
from vetta.functions.needles import words_in

MOST_BYTES = 1 << 20  # of a file that is searched


def lines(files: DataFrame, keep_last: bool = True) -> DataFrame:
    """(path, line_no, text): lines from 1, with the files' size where they have it. keep_last: an ending newline makes an empty last line, and \\r stays; else neither."""
    content = F.coalesce("content", F.lit(""))
    parts = F.split(content, "\n") if keep_last else F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n")
    size = ["size"] if "size" in files.columns else []
    return files.select("path", *size, F.posexplode(parts).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line_no"), "text", *size)


def read_lines(rows: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Lines first..last of a file; the column status tells whether the range starts beyond its end."""
    own = rows.where(F.col("path") == path)
    size = own.agg(F.max("line_no").alias("n")).select(F.when(F.coalesce("n", F.lit(0)) < first, "beyond end").otherwise("ok").alias("status"))
    return size.join(own.where(F.col("line_no").between(first, last)).select("line_no", "text"), F.lit(True), "left")


def grep(rows: DataFrame, pattern: str, regex: bool = False, ignore_case: bool = False, file_glob: str | None = None, context: int = 0, limit: int | None = None) -> DataFrame:
    """Lines that match: path, line_no, column (from 1), trimmed text, and the lines around with `> ` before the hit.

    Binary files (by extension) are left out, and files over MOST_BYTES where rows have the column size.
    """
    rows = rows.where(~extension(F.col("path")).isin(*schemas.BINARY))
    rows = rows.where(F.coalesce("size", F.lit(0)) <= MOST_BYTES) if "size" in rows.columns else rows
    flags = "(?i)" if ignore_case else ""
    if regex:
        hit, at = F.col("text").rlike(flags + pattern), F.regexp_instr("text", F.lit(flags + pattern))
    else:
        text, what = (F.lower("text"), pattern.lower()) if ignore_case else (F.col("text"), pattern)
        hit, at = text.contains(what), F.instr(text, what)
    if file_glob:
        rows = rows.where(base_name(F.col("path")).rlike(glob(file_glob)))
    out = rows.withColumn("hit", hit)
    if context:
        near = Window.partitionBy("path").orderBy("line_no").rowsBetween(-context, context)
        shown = F.collect_list(F.struct("line_no", "text")).over(near)
        out = out.withColumn("context", F.array_join(F.transform(shown, lambda x: F.concat(F.when(x["line_no"] == F.col("line_no"), "> ").otherwise("  "), x["text"])), "\n"))
    out = out.where("hit").withColumn("column", at).withColumn("text", F.trim("text")).drop("hit")
    return out if limit is None else out.orderBy("path", "line_no").limit(limit)


def symbol_refs(rows: DataFrame, name: str, limit: int = 100) -> DataFrame:
    return grep(rows, name, limit=limit)


def find_paths(files: DataFrame, pattern: str, ignore_case: bool = False, depth: int | None = None, kind: str | None = None) -> DataFrame:
    """Paths whose last part matches a glob, or contains the pattern if it has no * or ?. kind: file or dir, by the column is_dir (files where there is none)."""
    if kind not in (None, "file", "dir"):
        raise ValueError(f"kind must be file or dir: {kind}")
    if kind:
        is_dir = F.coalesce("is_dir", F.lit(False)) if "is_dir" in files.columns else F.lit(False)
        files = files.where(is_dir if kind == "dir" else ~is_dir)
    name = base_name(F.col("path"))
    if ignore_case:
        name, pattern = F.lower(name), pattern.lower()
    out = files.where(name.rlike(glob(pattern)) if set(pattern) & set("*?") else name.contains(pattern))
    return out if depth is None else out.where(F.size(F.split("path", "/")) - 1 <= depth)


def list_dir(files: DataFrame, directory: str, depth: int = 1) -> DataFrame:
    """What stands in a directory, as (path, is_dir), directories first; hidden and ignored ones are left out."""
    start = directory.rstrip("/") + "/" if directory else ""
    parts = F.split(F.substr(F.col("path"), F.lit(len(start) + 1)), "/")
    rows = files.where(F.col("path").startswith(start)).select(parts.alias("parts"))
    seen = rows.select(F.explode(F.sequence(F.lit(1), F.least(F.size("parts"), F.lit(depth)))).alias("n"), "parts")
    entries = seen.select(F.concat(F.lit(start), F.array_join(F.slice("parts", 1, F.col("n")), "/")).alias("path"), (F.col("n") < F.size("parts")).alias("is_dir"), F.slice("parts", 1, F.col("n")).alias("own"))
    shown = entries.where(~F.exists("own", lambda x: x.startswith(".") | x.isin(schemas.IGNORED_DIRS)))
    return shown.groupBy("path").agg(F.max("is_dir").alias("is_dir")).orderBy(F.desc("is_dir"), "path")


def source_files(files: DataFrame, excludes: tuple[str, ...] = ()) -> DataFrame:
    """Files of the project's own source: known extensions, no dot or ignored directories, nothing bundled or from vendors."""
    path, name = F.col("path"), F.lower(base_name(F.col("path")))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    out = files.where(extension(path).isin(list(schemas.LANGUAGE)))
    out = out.where(~F.exists(folders, lambda x: (x.startswith(".") & (F.length(x) > 1)) | x.isin(schemas.IGNORED_DIRS)))
    for part in (*schemas.BUNDLED_NAMES, *schemas.VENDOR_NAMES):
        out = out.where(~name.contains(part))
    for end in schemas.BUNDLED_ENDS:
        out = out.where(~name.endswith(end))
    for part in schemas.VENDOR_PATHS:
        out = out.where(~F.lower(path).contains(part))
    for pattern in excludes:
        out = out.where(~(path.rlike(glob(pattern)) | path.contains(pattern.removesuffix("*").removeprefix("*"))))
    return out


def chunk_filter(df: DataFrame, files: tuple[str, ...] = (), types: tuple = (), languages: tuple = (), legacy_like: bool = False) -> DataFrame:
    """Chunks in any of the files (a * crosses slashes, case doesn't count), of any type and language given."""
    if files:

        def one(f: str) -> Column:
            if "*" not in f:
                return F.col("file") == f
            return F.col("file").ilike((f if legacy_like else f.replace("\\", "\\\\").replace("_", r"\_").replace("%", r"\%")).replace("*", "%"))

        hits = [one(f) for f in files]
        df = df.where(F.array_contains(F.array(*hits), True))
    for column, allowed in (("type", types), ("language", languages)):
        if allowed:
            df = df.where(F.col(column).isin(*allowed))
    return df


def flag_injection(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("injection", any_of(F.coalesce(column, F.lit("")), schemas.INJECTION))


def classify_logs(runs: DataFrame) -> DataFrame:
    """kind of each run: clean, silent failure, hard or recoverable, by its exit code and log; of a run that ended well the first 16 KiB."""
    log = F.coalesce("log", F.lit(""))
    head = truncate_bytes(log, 16384, "")
    kind = F.when((F.col("exit_code") == 0) & any_of(head, schemas.HARD_LOG), "silent failure").when(F.col("exit_code") == 0, "clean")
    return runs.withColumn("kind", kind.when(any_of(log, schemas.HARD_LOG), "hard").when(any_of(log, schemas.SOFT_LOG), "recoverable").otherwise("hard"))


def has_results(column: str) -> Column:
    """Whether a JSON text has results: total above 0, else any findings; unreadable text has none."""
    parsed = F.from_json(column, "total long, findings array<string>")
    return F.coalesce(F.when(parsed["total"].isNotNull(), parsed["total"] > 0).otherwise(F.size(parsed["findings"]) > 0), F.lit(False))


# --- chunks -----------------------------------------------------------------


def with_chunk_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.left(F.sha2(F.concat_ws(":", "file", "content"), 256), F.lit(32))).withColumn("content_hash", F.left(F.sha2("content", 256), F.lit(16)))


def split_units(units: DataFrame, max_lines: int = 100, overlap: int = 5) -> DataFrame:
    """Units (file, name, start_line, content) over max_lines lines in overlapping parts; others as they are.

    A part has max_lines - overlap lines, and the next begins overlap lines before its end.
    """
    size, stride = max_lines - overlap, max_lines - 2 * overlap
    rows = units.withColumn("_lines", F.split(F.coalesce("content", F.lit("")), "\n")).withColumn("_n", F.size("_lines"))
    starts = F.when(F.col("_n") <= max_lines, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(stride)), lambda s: (s == 0) | (s + overlap < F.col("_n"))))
    parts = rows.withColumn("_s", F.explode(starts)).withColumn("_len", F.when(F.col("_n") <= max_lines, F.col("_n")).otherwise(F.least(F.lit(size), F.col("_n") - F.col("_s"))))
    whole = F.col("_n") <= max_lines
    return parts.select(
        "file", "name", (F.col("start_line") + F.col("_s")).alias("start_line"), (F.col("start_line") + F.col("_s") + F.col("_len") - 1).alias("end_line"),
        F.array_join(F.slice("_lines", F.col("_s") + 1, F.col("_len")), "\n").alias("content"), F.when(whole, "unit").otherwise("block").alias("type"), F.when(~whole, F.col("name")).alias("parent_name"),
    )


def embedding_text(chunks: DataFrame, max_bytes: int = 2000) -> DataFrame:
    """What is embedded of a chunk: type and name, its signature where that tells more, its parent, and the head of its content in bytes of UTF-8."""
    signature = F.when(~blank(F.col("signature")) & (F.col("signature") != F.col("name")), F.col("signature")) if "signature" in chunks.columns else F.lit(None).cast("string")
    parent = F.when(F.col("parent_name").isNotNull(), F.concat(F.lit("in "), "parent_name"))
    return chunks.withColumn("embedding_text", F.concat_ws("\n", F.concat_ws(" ", "type", "name"), signature, parent, truncate_bytes(F.col("content"), max_bytes, "...")))


def cap_per_file(chunks: DataFrame, n: int = 500) -> DataFrame:
    """The first n chunks of each file, in its order."""
    return chunks.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("start_line", "name"))).where(F.col("_k") <= n).drop("_k")


# --- symbols and blocks --------------------------------------------------------

# For each family of languages, kinds with the expression that finds the name, in the order in which they are tried.
SYMBOLS = {
    "python": (("class", r"^\s*class\s+(\w+)"), ("method", r"^\s+(?:async\s+)?def\s+(\w+)"), ("function", r"^(?:async\s+)?def\s+(\w+)"), ("constant", r"^([A-Z][A-Z0-9_]+)\s*=")),
    "go": (("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("type", r"^type\s+(\w+)"), ("constant", r"^const\s+(\w+)"), ("variable", r"^var\s+(\w+)")),
    "javascript": (("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\("), ("method", r"^\s+(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{")),
    "java": (("class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s+(?:public|private|protected)\s+[\w<>\[\], ]+\s+(\w+)\s*\(")),
    "rust": (("method", r"^\s+(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("function", r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("interface", r"^\s*(?:pub\s+)?trait\s+(\w+)"), ("type", r"^\s*(?:pub\s+)?enum\s+(\w+)")),
    "ruby": (("class", r"^\s*class\s+(\w+)"), ("class", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("constant", r"^\s*([A-Z][A-Z0-9_]+)\s*=")),
    "c": (("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("function", r"^[\w*]+[\w\s*]*\s+\**(\w+)\s*\([^;]*$")),
}
CONTROL = "if for while switch catch return else do function new sizeof".split()


def symbols(rows: DataFrame, language: str, patterns: dict = SYMBOLS) -> DataFrame:
    """Symbols of a family's lines: path, line_no, name, kind, signature; the first expression that hits counts."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in reversed(patterns[language]):
        hit = F.col("text").rlike(pattern)
        kind, name = F.when(hit, k).otherwise(kind), F.when(hit, F.regexp_extract("text", pattern, 1)).otherwise(name)
    return rows.select("path", "line_no", name.alias("name"), kind.alias("kind"), F.trim("text").alias("signature")).where(F.col("kind").isNotNull() & ~F.col("name").isin(CONTROL))


def find_symbols(found: DataFrame, name: str) -> DataFrame:
    return found.where(F.lower("name").contains(name.lower()))


def enclosing_symbol(rows: DataFrame, start: str, stop: str) -> DataFrame:
    """The last class-like name (group 1 of start) at or above each line; a line that matches stop resets it."""
    mark = F.when(F.col("text").rlike(start), F.regexp_extract("text", start, 1)).when(F.col("text").rlike(stop), "")
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("enclosing", F.last(mark, ignorenulls=True).over(upto)).withColumn("enclosing", F.nullif("enclosing", F.lit("")))


def first_after(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, line_no, _end, _last): for each start line the first later line of its file whose `_v` is at most the start line's `_most`; where there is none, the file's last line as _last.

    Each file is read once in order; the open starts wait in a heap, highest `_most` first.
    """
    both = rows.where("path is not null").select("path", "line_no", F.col("_v").cast("long"), F.col("_most").cast("long"), F.lit(False).alias("_start"))
    both = both.union(starts.select("path", "line_no", F.lit(None), F.lit(None), F.lit(True)).where("path is not null").distinct())
    number = both.schema["line_no"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last, own, waiting = None, None, None, []
        kinds = [None] * 4

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(4)], ["path", "line_no", "_end", "_last"])

        for batch in batches:
            kinds = [batch.schema.field(0).type, *[batch.schema.field(1).type] * 3]
            out = []
            for p, n, v, most, start in zip(*(c.to_pylist() for c in batch.columns)):
                if p != path:
                    out += [(path, m, None, last) for _, m in waiting]
                    path, last, own, waiting = p, None, None, []
                if start:
                    if last == n and own is not None:
                        heapq.heappush(waiting, (-own, n))
                    continue
                last, own = n, most
                while v is not None and waiting and -waiting[0][0] >= v:
                    out.append((p, heapq.heappop(waiting)[1], n, None))
            yield table(out)
        if waiting:
            yield table([(path, m, None, last) for _, m in waiting])

    return both.repartition("path").sortWithinPartitions("path", "line_no", "_start").mapInArrow(run, f"path string, line_no {number}, _end {number}, _last {number}")


def depth_before(rows: DataFrame, opening: Column, closing: Column) -> DataFrame:
    """rows with depth, the sum of openings less closings up to each line, and before, that above it."""
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_net", opening - closing).withColumn("depth", F.sum("_net").over(upto)).withColumn("before", F.col("depth") - F.col("_net")).drop("_net")


def brace_block_end(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (path, line_no) with end_line: where the braces opened from the start line on are closed."""
    return block_end(rows, starts, r"\{", r"\}")


def keyword_block_end(rows: DataFrame, starts: DataFrame, words: str = r"^\s*(?:def|class|module|if|unless|case|while|until|begin|for)\b|\bdo\b", end: str = r"^\s*end\b") -> DataFrame:
    return block_end(rows, starts, words, end)


def block_end(rows: DataFrame, starts: DataFrame, opening: str, closing: str) -> DataFrame:
    deep = depth_before(rows, F.regexp_count("text", F.lit(opening)), F.regexp_count("text", F.lit(closing)))
    found = first_after(deep.withColumns({"_v": F.col("depth"), "_most": F.col("before")}), starts)
    return found.select("path", "line_no", F.coalesce("_end", "_last").alias("end_line"))


def indent_block_end(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """starts with end_line: the line before the next one, not blank and no comment, that isn't indented deeper."""
    indent = F.length("text") - F.length(F.ltrim("text"))
    real = F.when((F.trim("text") != "") & ~F.ltrim("text").startswith("#"), indent)
    found = first_after(rows.withColumns({"_v": real, "_most": indent}), starts)
    return found.select("path", "line_no", F.coalesce(F.col("_end") - 1, "_last").alias("end_line"))


BLOCK_END = {"python": indent_block_end, "ruby": keyword_block_end}
#: Kinds that have members, and what opens a block of members without being a symbol itself.
HOLDERS = ("class", "struct", "interface")
MEMBERS = {"rust": r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"}
#: Where a member names its holder itself.
RECEIVER = {"go": r"^func\s+\(\s*(?:\w+\s+)?\*?(\w+)"}


def nested(spans: DataFrame) -> DataFrame:
    """spans (path, line_no, end_line, name, holds) with parent, the name of the innermost span around each that holds members.

    A file's spans are read once in order, with a stack of those that are open.
    """
    columns = ["path", "line_no", "end_line", "name", "holds"]
    types = dict(spans.select(*columns).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stack = None, []
        for batch in batches:
            parents = []
            for p, n, end, name, holds in zip(*(c.to_pylist() for c in batch.columns)):
                if p != path:
                    path, stack = p, []
                while stack and stack[-1][0] < n:
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                if holds:
                    stack.append((end, name))
            yield batch.append_column("parent", pa.array(parents, pa.string()))

    ordered = spans.select(*columns).where("path is not null").repartition("path").sortWithinPartitions("path", "line_no", F.desc("end_line"))
    return ordered.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in columns) + ", parent string")


def symbol_tree(rows: DataFrame, language: str, patterns: dict = SYMBOLS) -> DataFrame:
    """Symbols with end_line and parent: the class, struct or interface around them, or the type that a method is of.

    A function with such a parent is a method, and a method without one is a function.
    """
    found = symbols(rows, language, patterns)
    if language in MEMBERS:
        opened = rows.where(F.col("text").rlike(MEMBERS[language])).select("path", "line_no", F.regexp_extract("text", MEMBERS[language], 1).alias("name"), F.lit("members").alias("kind"), F.trim("text").alias("signature"))
        found = found.unionByName(opened)
    spans = BLOCK_END.get(language, brace_block_end)(rows, found.select("path", "line_no"))
    held = found.join(spans, ["path", "line_no"]).withColumn("holds", F.col("kind").isin(*HOLDERS, "members"))
    tree = nested(held).select("path", "line_no", "name", "end_line", "parent")
    out = found.where("kind <> 'members'").join(tree, ["path", "line_no", "name"])
    if language in RECEIVER:
        out = out.withColumn("parent", F.coalesce(F.when(F.col("kind") == "method", F.nullif(F.regexp_extract("signature", RECEIVER[language], 1), F.lit(""))), "parent"))
    kind = F.when(F.col("kind").isin("function", "method"), F.when(F.col("parent").isNull(), "function").otherwise("method")).otherwise(F.col("kind"))
    return out.withColumn("kind", kind).select("path", "line_no", "name", "kind", "signature", "end_line", "parent")


def code_chunks(files: DataFrame, language: str, patterns: dict = SYMBOLS) -> DataFrame:
    """Chunks of code: each function, method or class with its lines and its parent."""
    found = symbol_tree(lines(files), language, patterns).where(F.col("kind").isin("function", "method", "class", "struct"))
    body = F.array_join(F.slice(F.split("content", "\n"), F.col("line_no"), F.col("end_line") - F.col("line_no") + 1), "\n")
    return found.join(files.select("path", "content"), "path").select(F.col("path").alias("file"), "name", F.col("kind").alias("type"), F.col("line_no").alias("start_line"), "end_line", "signature", "parent", body.alias("content"))


def index_stats(chunks: DataFrame, languages: bool = True) -> DataFrame:
    """(dimension, value, chunks, files) of an index of chunks (file, type): by type, by language (of the file's ending), and in all."""
    rows = chunks.select("file", F.col("type").cast("string").alias("type"), language_of(F.col("file")).alias("language"))
    kinds = ["type", "language"] if languages else ["type"]
    values = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.coalesce(c, F.lit("")).alias("value")) for c in kinds])
    return rows.select("file", F.explode(values).alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file").alias("files"))


def index_files(chunks: DataFrame) -> DataFrame:
    """Each file of an index with its number of chunks."""
    return chunks.groupBy("file").agg(F.count(F.lit(1)).alias("chunks"))


def chunks_of(chunks: DataFrame, file: str) -> DataFrame:
    """The chunks of a file in order of their lines."""
    return chunks.where(F.col("file") == file).orderBy("start_line", "id" if "id" in chunks.columns else "end_line")


# --- notes and manifests --------------------------------------------------------


def contains_notes(memories: DataFrame, query: str, type: str | None = None) -> DataFrame:
    """Notes with the text in their name, content or tag, without case; with a type, tags are not searched."""
    columns = ["name", "content"] + ([] if type else ["tag"])
    hit = F.lower(F.concat_ws("\n", *columns)).contains(query.lower())
    out = memories.where(hit)
    return out.where(F.col("type") == type) if type else out


STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def terms(column: Column) -> Column:
    """Words of at least two letters without stop words, cut to their stems by the commonest endings."""
    words = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(STOP))
    return F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(?:ing|ed|es|s)$", "")).otherwise(w))


LONG = 64


def near_keys(term: Column) -> Column:
    """Keys of which two terms with one edit between them (a letter more, less or other) share one.

    The term and all that is left of it without one letter; a long term gives its two ends
    instead, as one edit leaves either end whole. Terms of 60 to LONG letters give both.
    """
    n = F.length(term)
    less = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.substring(term, F.lit(1), k), F.substring(term, k + 2, n)))
    ends = F.array(F.concat(F.lit("^"), F.substring(term, 1, 16)), F.concat(F.lit("$"), F.substring(term, -16, 16)))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.when((n > 0) & (n <= LONG), F.concat(F.array(term), less)).otherwise(none), F.when(n >= LONG - 4, ends).otherwise(none)))


def index_notes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of the notes (name, type, content, description, tags): postings (name, type, term) and a vocabulary (term, key) for near terms.

    Text and description give stems; name, type and each tag are terms as they stand.
    """
    from vetta.plans.tables import written

    columns = dict(memories.dtypes)
    text = F.concat_ws(" ", *[c for c in ("content", "description") if c in columns])
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in columns else F.array().cast("array<string>")
    every = F.array_distinct(F.concat(terms(text), F.array("name", "type"), tags))
    postings = written(memories.select("name", "type", F.explode(every).alias("term")).where("term <> ''").distinct(), "postings")
    return postings, written(postings.select("term").distinct().select("term", F.explode(near_keys(F.col("term"))).alias("key")), "vocabulary")


# So many notes, in order of name and type, are searched as one block of arrays, and so many queries meet the first block in a task.
NOTE_BLOCK, QUERY_PART = 1 << 14, 1 << 11
LISTS = "block long, asked long, type string, whole binary, half binary"


def runs_of(*codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal rows of sorted columns begin and end."""
    new = np.zeros(max(0, len(codes[0]) - 1), bool)
    for c in codes:
        new |= c[1:] != c[:-1]
    starts = np.flatnonzero(np.append(len(codes[0]) > 0, new)) if len(codes[0]) else np.zeros(0, np.int64)
    return starts, np.append(starts[1:], len(codes[0]))


def coded(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """Strings as numbers (null: -1) and the strings."""
    found = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), [*found.dictionary.to_pylist(), None]


def term_lists(key: tuple, notes: pa.Table) -> pa.Table:
    """A block's notes (at, type, terms) as the places of each term and type."""
    terms = notes.column("terms").combine_chunks()
    n = np.asarray(terms.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    term, words = coded(terms.flatten())
    kind, kinds = coded(notes.column("type"))
    kind, at = np.repeat(kind, n), np.repeat(notes.column("at").to_numpy(), n)
    order = np.lexsort((at, kind, term))
    term, kind, at = term[order], kind[order], at[order].astype(np.int32)
    starts, ends = runs_of(term, kind)
    places = [at[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist())]
    return pa.table({"block": pa.array([key[0].as_py()] * len(starts), pa.int64()), "term": pa.array([words[x] for x in term[starts]], pa.string()), "type": pa.array([kinds[x] for x in kind[starts]], pa.string()), "places": pa.array(places, pa.binary())})


def asked_lists(key: tuple, found: pa.Table) -> pa.Table:
    """A block's places of terms near to asked words (asked, type, exact, places): for each asked word and type those of the word itself, and those of other terms alone."""
    places = [np.frombuffer(x, np.int32) for x in found.column("places").to_pylist()]
    n = np.array([len(x) for x in places], np.int64)
    kind, kinds = coded(found.column("type"))
    asked, kind, other = (np.repeat(x, n) for x in (found.column("asked").to_numpy(), kind, ~found.column("exact").to_numpy(zero_copy_only=False)))
    at = np.concatenate([np.zeros(0, np.int32), *places])
    order = np.lexsort((other, at, kind, asked))
    asked, kind, other, at = asked[order], kind[order], other[order], at[order]
    first, _ = runs_of(asked, kind, at)
    asked, kind, other, at = asked[first], kind[first], other[first], at[first]
    starts, ends = runs_of(asked, kind)
    parts = [(at[x:y], other[x:y]) for x, y in zip(starts.tolist(), ends.tolist())]
    return pa.table({"block": pa.array([key[0].as_py()] * len(starts), pa.int64()), "asked": pa.array(asked[starts], pa.int64()), "type": pa.array([kinds[x] for x in kind[starts]], pa.string()),
                     "whole": pa.array([x[~o].tobytes() for x, o in parts], pa.binary()), "half": pa.array([x[o].tobytes() for x, o in parts], pa.binary())})


def best_of_block(k: int):
    """The k best notes of a block for each of some queries (query, words, least) whose score is above the least."""

    def run(lists: pa.Table, queries: pa.Table) -> pa.Table:
        words: dict = {}
        for asked, kind, whole, half in zip(*(lists.column(c).to_pylist() for c in ("asked", "type", "whole", "half"))):
            words.setdefault(asked, []).append((kind, np.frombuffer(whole, np.int32), np.frombuffer(half, np.int32)))
        block = lists.column("block")[0].as_py() if lists.num_rows else 0
        score = np.zeros(1 + max((int(x.max()) for ls in words.values() for _, *two in ls for x in two if len(x)), default=0))
        query, note, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
        for number, asked, least in zip(*(queries.column(c).to_pylist() for c in ("query", "words", "least"))):
            score[:] = 0
            for w in asked:
                for kind, whole, half in words.get(w["asked"], ()):
                    if w["only"] is None or w["only"] == kind:
                        score[whole] += w["idf"]
                        score[half] += w["idf"] / 2
            at = np.flatnonzero(score > max(0, least - 1e-8))
            # Scores are compared at nine digits, as places are given.
            told = np.round(score[at], 9)
            keep = told > least if least > 0 else told >= 0
            if keep.sum() > k:
                keep &= told >= -np.partition(-told[keep], k - 1)[k - 1]
            at, told = at[keep], told[keep]
            at = at[np.lexsort((at, -told))[:k]]
            query += [number] * len(at)
            note.append(at.astype(np.int64) + (block << 33))
            scores.append(score[at])
        return pa.table({"query": pa.array(query, pa.int64()), "note": pa.array(np.concatenate(note)), "score": pa.array(np.concatenate(scores))})

    return run


def open_blocks(asked: DataFrame, lists: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query, words, least, later): the later blocks in which a note can be better than a query's k best of the first one.

    Words that together can't lift a note above the k-th score need not be looked for: a better
    note has one of the others. Equal scores go to the earlier block.
    """
    least = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min(F.round("score", 9)).alias("least")).where(F.col("n") >= k).select("query", "least")
    asked = asked.drop("least").join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    needed = F.expr("filter(transform(words, (w, i) -> if(round(aggregate(slice(words, 1, i + 1), 0D, (t, x) -> t + x.most), 9) > least, w.asked, null)), w -> w is not null)")
    pairs = asked.select("query", F.explode(needed).alias("asked")).join(lists.where("block > 0").select("asked", F.col("block").alias("later")).distinct(), "asked").select("query", "later").distinct()
    return asked.join(pairs, "query")


def search_note_table(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, name, type, score, place): the k best notes (20 where k isn't above 0) of each query (query_id, query, and optionally type, the only type then searched).

    A note matches by any word; a word may differ by one edit and then counts half. A word's
    worth is the inverse frequency of the notes that it matches. Words meet terms by
    equality of near_keys, then the edit is checked. Notes are blocks in order of name and
    type; all queries meet the first block, and a later one where it can hold a better note.
    """
    from vetta.plans.tables import written

    postings, vocabulary = index
    k = k if k > 0 else 20
    only = F.col("type") if "type" in queries.columns else F.lit(None).cast("string")
    asked = written(queries.select("query_id", only.alias("only"), F.explode(F.array_distinct(terms(F.col("query")))).alias("word")).distinct(), "asked")
    words = written(asked.select("word").distinct().withColumn("asked", F.monotonically_increasing_id()), "words")
    near = words.select("asked", "word", F.explode(near_keys(F.col("word"))).alias("key")).join(vocabulary, "key").where(F.levenshtein("term", "word", 1) >= 0)
    near = near.select("asked", "term", (F.col("term") == F.col("word")).alias("exact")).distinct()
    notes = postings.groupBy("name", "type").agg(F.collect_list("term").alias("terms"))
    total = postings.select("name", "type").distinct().count()
    notes = notes.repartitionByRange(-(-total // NOTE_BLOCK) or 1, "name", "type").sortWithinPartitions("name", "type").withColumn("note", F.monotonically_increasing_id())
    notes = written(notes, "notes")
    placed = notes.select(F.shiftright("note", 33).alias("block"), F.col("note").bitwiseAND((1 << 33) - 1).alias("at"), "type", "terms")
    held = placed.groupBy("block").applyInArrow(term_lists, "block long, term string, type string, places binary")
    lists = held.join(near, "term").select("block", "asked", "type", "exact", "places").groupBy("block").applyInArrow(asked_lists, LISTS)
    lists = written(lists, "lists")
    # A word's worth, and the most that it can add to a score.
    worth = lists.groupBy("asked").agg((F.sum(F.octet_length("whole") + F.octet_length("half")) / 4).alias("df"), F.max(F.octet_length("whole")).alias("whole"))
    worth = worth.withColumn("idf", F.log(1 + F.lit(total) / F.col("df"))).join(words, "asked").select("word", "asked", "idf", (F.col("idf") * F.when(F.col("whole") > 0, 1.0).otherwise(0.5)).alias("most"))
    named = asked.join(worth, "word").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("most", "asked", "only", "idf"))).alias("words"))
    named = written(named.withColumn("query", F.monotonically_increasing_id()).withColumn("least", F.lit(0.0)), "queries")
    some = named.select("query", "words", "least")
    run, parts = best_of_block(k), -(-named.count() // QUERY_PART) or 1
    first = lists.where("block = 0").crossJoin(lists.sparkSession.range(parts).withColumnRenamed("id", "part"))
    dealt = some.withColumn("part", F.pmod(F.hash("query"), F.lit(parts)).cast("long"))
    result = "query long, note long, score double"
    found = written(first.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(run, result), "first")
    later = lists.groupBy("block").cogroup(open_blocks(some, lists, found, k).groupBy("later")).applyInArrow(run, result)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "note"))
    best = found.union(later).withColumn("place", place).where(F.col("place") <= k)
    return best.join(notes.select("note", "name", "type"), "note").join(named.select("query", "query_id"), "query").select("query_id", "name", "type", "score", "place")


def search_notes(memories: DataFrame, query: str, k: int = 50, type: str | None = None) -> DataFrame:
    """search_note_table() of one query: name, type and score, best first."""
    asked = memories.sparkSession.createDataFrame([(0, query, type)], "query_id int, query string, type string")
    return search_note_table(index_notes(memories), asked, k).orderBy("place").select("name", "type", "score")


def detect_stack(files: DataFrame, keywords: DataFrame) -> DataFrame:
    """(project, kind, name) of the stack words (kind, name, word) that a project's files have. keywords is a list of fixed size; a text is read once for all words."""
    rows = sorted({(r["word"], r["kind"], r["name"]) for r in keywords.collect()})
    return files.select("project", named_words(F.col("content"), rows)).select("project", "n.*").distinct()


def named_words(text: Column, rows: list[tuple[str, str, str]]) -> Column:
    """One row (n: struct of kind and name) for each (word, kind, name) whose word is in the text."""
    table = {w: F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")) for x, k, n in rows if x == w]) for w in {w for w, _, _ in rows}}
    if not table:
        return F.explode(F.array().cast("array<struct<kind:string,name:string>>")).alias("n")
    names = F.create_map(*[x for w in sorted(table) for x in (F.lit(w), table[w])])
    return F.explode(F.array_distinct(F.flatten(F.transform(words_in(text, list(table)), lambda w: F.element_at(names, w))))).alias("n")


def directories(path: Column) -> Column:
    """All directories above a file, outermost first."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def walked(path: Column, *skipped: str) -> Column:
    """Not under a directory that walks leave out; skipped: more of these, such as a tool's own folder."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, (*schemas.SKIPPED_DIRECTORIES, *skipped))))


def detect_project(files: DataFrame) -> DataFrame:
    """(project, kind, name) for each language, framework, database, auth and infrastructure that a project's files (project, path, content) show.

    Languages and infrastructure go by paths, frameworks by the language's manifest,
    databases by manifests and settings, auth by all walked source and settings files.
    """
    path, low = F.col("path"), F.lower("content")
    kind = lambda name, rows: rows.select("project", F.lit(name).alias("kind"), "name").where("name is not null")
    one = lambda table: F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in table]))).alias("name")
    # The first of a language's manifests that a project has is the one that is read (java); node's are parsed.
    manifest = files.where(path.isin(*schemas.MANIFESTS))
    rank = F.col("path").isin("build.gradle").cast("int") + 2 * F.col("path").isin("build.gradle.kts").cast("int")
    java = manifest.where(path.isin(*schemas.JAVA_MANIFESTS)).groupBy("project").agg(F.min_by("content", rank).alias("content"))
    packages_of = lambda key: F.coalesce(F.map_keys(F.from_json(F.get_json_object("content", f"$.{key}"), "map<string,string>")), F.array().cast("array<string>"))
    node = manifest.where((path == "package.json") & F.get_json_object("content", "$").isNotNull()).select("project", F.array_union(packages_of("dependencies"), packages_of("devDependencies")).alias("names"))
    typed = node.where(F.array_contains("names", "typescript")).select("project").union(files.where(path == "tsconfig.json").select("project")).distinct().withColumn("_typed", F.lit(True))
    languages = manifest.select("project", one([(path.isin(*paths), name) for name, paths in schemas.LANGUAGE_MANIFESTS.items()]))
    scripts = node.select("project").distinct().join(typed, "project", "left").select("project", F.when(F.col("_typed"), "typescript").otherwise("javascript").alias("name"))
    words = lambda rows, text, table: rows.select("project", named_words(text, [(w, "", n) for w, n in table.items()])).select("project", "n.name")
    frameworks = words(manifest.where(path == "go.mod"), F.col("content"), schemas.FRAMEWORKS["go"])
    for rows, text, name in ((manifest.where(path == "requirements.txt"), low, "python"), (manifest.where(path == "Cargo.toml"), F.col("content"), "rust"), (java, F.col("content"), "java"), (manifest.where(path == "Gemfile"), F.col("content"), "ruby")):
        frameworks = frameworks.union(words(rows, text, schemas.FRAMEWORKS[name]))
    packages = F.create_map(*[F.lit(x) for pair in schemas.FRAMEWORKS["node"].items() for x in pair])
    frameworks = frameworks.union(node.select("project", F.explode(F.transform("names", lambda n: F.element_at(packages, n))).alias("name")))
    listed = lambda table: {w: n for n, ws in table.items() for w in ws}
    databases = words(files.where(path.isin(*schemas.DATABASE_FILES)), low, listed(schemas.DATABASES))
    auth = words(files.where(walked(path) & path.rlike(schemas.AUTH_FILES)), low, listed(schemas.AUTH))
    under = lambda p: (path == p) | path.startswith(p + "/")
    infrastructure = files.select("project", one([(under(p) if not p.endswith("/") else path.startswith(p), n) for p, n in schemas.INFRASTRUCTURE] + [(path.rlike(r"^[^/]+\.tf$"), "terraform")]))
    found = kind("language", languages.union(scripts))
    for name, rows in (("framework", frameworks), ("database", databases), ("auth", auth), ("infrastructure", infrastructure)):
        found = found.union(kind(name, rows))
    return found.distinct()


def sensitive_areas(files: DataFrame) -> DataFrame:
    """(project, path, reason) of each directory whose name has a telling word; of several words the first in the list gives the reason."""
    rows = files.where(walked(F.col("path"))).select("project", F.explode(directories(F.col("path"))).alias("directory")).distinct()
    name = F.lower(F.element_at(F.split("directory", "/"), -1))
    reason = F.coalesce(*[F.when(name.contains(w), F.lit(r)) for w, r in schemas.SENSITIVE.items()])
    return rows.select("project", F.concat("directory", F.lit("/")).alias("path"), reason.alias("reason")).where("reason is not null")


def classify_projects(stack: DataFrame, rules: DataFrame) -> DataFrame:
    """Types by the names of the stack (rules: name, type), traits by the kinds that a project has any of; a project with languages and no type at all is a library."""
    from vetta.plans.tables import written

    stack = written(stack, "stack")
    types = stack.join(rules, "name").groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    traits = stack.groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("traits"), F.max(F.col("kind") == "language").alias("_spoken"))
    return traits.join(types, "project", "left").withColumn("types", F.coalesce("types", F.when(F.col("_spoken"), "library").otherwise(""))).drop("_spoken")


def cwe_order(column: Column) -> list[Column]:
    """Sort keys: by number, what has none last."""
    return [F.regexp_extract(column, r"(\d+)$", 1).try_cast("int").asc_nulls_last(), column]


def stratified_head(df: DataFrame, group: str, flag: str, order: str, n_true: int = 3, n_false: int = 2) -> DataFrame:
    """The first n_true true and n_false false rows of each group."""
    k = F.row_number().over(Window.partitionBy(group, flag).orderBy(order))
    return df.withColumn("_k", k).where(F.col("_k") <= F.when(F.col(flag), n_true).otherwise(n_false)).drop("_k")


def round_robin(df: DataFrame, group: str, order: str, n: int = 3) -> DataFrame:
    """n rows in turns over the groups: the first of each, then the second of each."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", k).where(F.col("turn") <= n).orderBy("turn", group).limit(n)
