"""Documents drawn by how much likelier their word n-grams are in a target table than among all documents.

Words come from UTF-8 bytes by one 256-byte table that lower-cases A-Z and blanks
separators, then bytes.split. A feature is a run of 1 to 3 words joined by a space;
zlib.crc32 goes on from the run before it, so each word is read once for each length.

Nulls and odd rows: a null or empty text has no features, weight 0, and isn't drawn. A
null doc_id counts as empty text in the draw and comes after equal scores. Rows are
counted as they are: a repeated row is drawn or not by its own rank, and the ranks of
equal rows may be exchanged. Empty tables give no rows, or gains from the other side
alone. Texts go through whole, and no other column is read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetta.llm.common import materialize

BUCKETS = 10_000
WORDS = 3
LOWER = bytes(range(0x61, 0x7B))
#: Bytes of ASCII letters and digits stay (A-Z as a-z), all of 0x80 and above stay, any other becomes a blank.
TABLE = bytes(c if c >= 0x80 or 0x30 <= c < 0x3A or c in LOWER else c + 32 if 0x41 <= c < 0x5B else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def buckets(found: list[bytes], n: int = WORDS) -> np.ndarray:
    """The bucket of each run of 1 to n words, repeats included."""
    sums, spaced = list(map(crc32, found)), [b" " + w for w in found[1:]]
    out = [sums]
    for k in range(n - 1):
        sums = list(map(crc32, spaced[k:], sums))
        out.append(sums)
    return np.concatenate([np.array(s, np.int64) for s in out]) % BUCKETS


def bucket_counts(texts: DataFrame) -> DataFrame:
    """bucket and n: how many features of a table's texts fall into it. A task gives at most BUCKETS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(buckets(words(text.as_py())).tolist())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(counts.keys(), pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    return texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def totals(texts: DataFrame) -> np.ndarray:
    """The counts of all BUCKETS buckets; a task, a row and the driver hold BUCKETS numbers, whatever the table's size."""
    out = np.zeros(BUCKETS, np.int64)
    for row in bucket_counts(texts).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths of a natural logarithm."""
    s, t = totals(docs), totals(target)
    every, wanted = float(s.sum()) + BUCKETS, float(t.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1.0) * every / ((a + 1.0) * wanted))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def luck(doc_id: int | None, seed: int) -> int:
    """A Gumbel number of the document, in thousandths: the highest sums with it are a draw without replacement."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                at = buckets(found)
                weight = int(gain[at].sum())
                rows.append((i, len(found), len(at), weight, weight + luck(i, seed)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, first: list) -> DataFrame:
    """rows with their place from 1 in the order `first`: ranges are numbered apart and moved on by the ranges before them.

    The driver holds one count a range.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *first).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dict(dealt.groupBy("_range").count().collect())
    start, at = {}, 0
    for k in sorted(counts):
        start[k], at = at, at + counts[k]
    starts = F.create_map(*[F.lit(x) for pair in start.items() for x in pair]) if start else F.create_map().cast("map<int,int>")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*first))
    return dealt.withColumn("_place", own.cast("long") + F.element_at(starts, F.col("_range")).cast("long")).drop("_range")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of docs (doc_id, text).

    Of the documents with at least `least_words` words, floor(percent * N / 100) get a
    rank: those with the highest scores, equal ones by ascending doc_id.
    """
    rows = materialize(weighed(docs, gains(docs, target), seed), "weights")
    eligible = F.col("n_words") >= least_words
    n = rows.where(eligible).count() * percent // 100
    out = ranked(rows, [F.desc(eligible), F.desc("score"), F.asc_nulls_last("doc_id")])
    return out.withColumn("rank", F.when(eligible & (F.col("_place") <= n), F.col("_place"))).drop("_place")
