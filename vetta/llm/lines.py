"""Lines that several documents share, dropped but from the last document holding them; DataFrame functions only.

Nulls and odd rows: a null text is one empty line. Rows with one doc_id are one
document when documents are counted, and every row keeps its own line numbers; a
null doc_id is a document of its own, smaller than any other. Keys of fewer than
`least` code points (so empty lines too) are never dropped. A line repeated in
one document counts once, and all its occurrences stay or go together. Texts of
any length go through whole, an empty table gives no rows, and no other column of
the table is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import materialize

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: So many of the commonest keys meet the lines by a broadcast; any other key has less than that share of all rows.
HOT = 1000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def digest(column: Column) -> Column:
    """16 bytes, so that different keys don't meet by chance at any size."""
    return F.unhex(F.md5(column.cast("binary")))


def row_digest(doc_id: Column, text: Column) -> Column:
    """Names a row by what it holds: equal rows have equal lines to drop."""
    return digest(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text))


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """row, doc_id and keys: the digest of each line's key in order, null for keys of fewer than `least` code points."""
    text = F.coalesce("text", F.lit(""))
    key = F.transform(F.split(text, "\n"), line_key)
    keys = F.transform(key, lambda k: F.when(F.length(k) >= least, digest(k)))
    return docs.select(row_digest(F.col("doc_id"), text).alias("row"), "doc_id", keys.alias("keys"))


def shared_keys(lines: DataFrame, documents: int) -> DataFrame:
    """key, n (documents holding it) and last (the largest of them), for keys in at least so many documents."""
    once = lines.select("doc_id", F.explode(F.array_compact(F.array_distinct("keys"))).alias("key")).distinct()
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= documents)


def dropped_lines(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """row and gone: the places (from 1, in order) of the lines that a row of docs loses; no row where nothing goes.

    Only digests and places are shuffled here. The HOT commonest keys are joined by a
    broadcast of at most HOT rows, so a key that a third of all documents hold is spread
    as the documents are.
    """
    lines = materialize(lines_of(docs, least), "line-keys")
    keys = materialize(shared_keys(lines, documents), "shared-lines")
    hot = keys.orderBy(F.desc("n"), "key").limit(HOT).select("key", F.col("last").alias("hot_last"))
    places = lines.select("row", "doc_id", F.posexplode("keys").alias("at", "key")).where("key is not null")
    goes = lambda last: F.col("doc_id").isNull() | (F.col("doc_id") < F.col(last))
    met = places.join(F.broadcast(hot), "key", "left")
    common = met.where(F.col("hot_last").isNotNull() & goes("hot_last")).select("row", "at")
    cold = keys.join(F.broadcast(hot), "key", "left_anti").select("key", "last")
    rare = met.where(F.col("hot_last").isNull()).join(cold, "key").where(goes("last")).select("row", "at")
    return common.unionByName(rare).groupBy("row").agg(F.sort_array(F.collect_set(F.col("at") + 1)).alias("gone"))


def drop_shared_lines(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text for each row of docs (doc_id, text).

    Lines are put together again by place: between two places that go lies a run
    that stays, so a text of n lines takes n steps.
    """
    text = F.coalesce("text", F.lit(""))
    mine = docs.select("doc_id", text.alias("text"), row_digest(F.col("doc_id"), text).alias("row"))
    gone = dropped_lines(docs, least, documents)
    ends = F.concat(F.array(F.lit(0)), "gone", F.array(F.lit(2**31 - 1)))
    both = mine.join(gone.withColumn("ends", ends), "row", "left")
    return both.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(runs_kept(F.split("text", "\n"), F.col("ends")), "\n")).alias("kept_text"),
    )


def runs_kept(lines: Column, ends: Column) -> Column:
    """The lines between each two neighbours of ends (places from 1 that aren't kept themselves)."""
    after = F.slice(ends, F.lit(2), F.size(ends) - 1)
    pairs = F.arrays_zip(F.slice(ends, F.lit(1), F.size(ends) - 1).alias("a"), after.alias("b"))
    return F.flatten(F.transform(pairs, lambda p: F.slice(lines, p["a"] + 1, p["b"] - p["a"] - 1)))
