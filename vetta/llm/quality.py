"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A word is a run of letters and digits, or a run of other signs; spaces part
words. Its hash is a polynomial of its bytes; words and pairs of neighbouring
words (one feature for all pairs of equal words) are hashed to 2^BITS features, whose values are their shares of the
document's n-grams. Training takes at most SAMPLE labelled rows, those whose
doc_id hashes lowest, dealt to SHARDS tasks, or more of them where their texts
are over SHARD_BYTES each, whose weights are averaged; the weights are the same
however the table is partitioned. A task keeps its texts as sparse counts.

Texts: null counts as empty; an empty text has the bias alone as its score. Any
length: memory follows the longest document. Labels that repeat a doc_id count
once, by their mean, and of documents that share one the least text is learned from; null labels and ids are not. A null doc_id
counts as the empty string in the fold. Without labels every score is 0.5.
Repeated documents are scored each by itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import crc_fold, giving_back

BITS = 18
SAMPLE = 24_000  # labelled rows at most
SHARDS, SHARD_BYTES = 4, 64 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-6
SCALE = 20.0
BYTES = 1 << 18  # bytes handled at once
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
# 0 for spaces, 1 for letters, digits and bytes of longer letters, 2 for other signs.
KIND = np.array([0 if b <= 32 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(2 * BYTES, BASE), powers(2 * BYTES, INVERSE)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all n-grams of the texts, text after text, and how many each text has."""
    size = sum(map(len, texts)) + len(texts)
    up, down = (UP, DOWN) if size < len(UP) else (powers(size, BASE), powers(size, INVERSE))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = KIND[data]
    cut = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts, ends = cut[:-1], cut[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
        h = (sums[ends] - sums[starts]) * down[starts]
        h = (h ^ (h >> np.uint64(32))) * MIX
        row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        same = row[1:] == row[:-1]
        pair = ((h[:-1] * BASE) ^ (h[1:] >> np.uint64(7)))[same] * MIX
        # A word and the same word again is one pair, whichever word it is.
        pair[(h[:-1] == h[1:])[same]] = MIX
    every = np.concatenate([h, pair])
    of = np.concatenate([row, row[1:][same]])
    order = np.argsort(of, kind="stable")
    return (every[order] >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(of, minlength=len(texts))


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's features and their values, the bias last."""
    f, _ = features([text])
    at, n = np.unique(f, return_counts=True)
    return np.append(at, 1 << BITS).astype(np.int32), np.append(n * (SCALE / max(1, len(f))), 1.0).astype(np.float32)


def train(found: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights of the features, the bias last, by follow the regularised leader, coordinate by coordinate; found: sparse() of each text."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        lean = np.maximum(np.abs(z[at]) - L1, 0) * -np.sign(z[at])
        return lean / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (at, x), y in zip(found, labels):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange((1 << BITS) + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    """Weights from at most SAMPLE rows of docs (doc_id, text) that have a label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    # At most SAMPLE rows of three numbers.
    picked = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("h", "doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(SHARDS, -(-size // SHARD_BYTES))
    dealt = rows.repartition(shards, F.pmod(F.col("h"), F.lit(shards))).sortWithinPartitions("h", "doc_id").select(F.encode("text", "utf-8"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, ys = [], []
        for batch in batches:
            found += [sparse(x.as_buffer().to_pybytes()) for x in batch.column(0)]
            ys += batch.column(1).to_pylist()
        if found:
            w = train(found, ys)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array(np.full(len(at), len(found), np.int64))], ["at", "w", "n"])

    out, total = np.zeros((1 << BITS) + 1), 0
    # At most 2^BITS rows a shard; a shard weighs as many rows as it had.
    summed = dealt.mapInArrow(giving_back(run), "at long, w double, n long").groupBy("at").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n"))
    for r in summed.collect():
        out[r["at"]] = r["w"]
        total = max(total, r["n"])
    return (out / max(1, total)).astype(np.float64)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Scores of texts, slab by slab."""
    out = np.zeros(len(texts))
    first, held = 0, 0
    for k in range(len(texts) + 1):
        if k == len(texts) or held + len(texts[k]) > BYTES and k > first:
            if k > first:
                f, n = features(texts[first:k])
                sums = np.concatenate(([0.0], np.cumsum(weights[f])))
                ends = np.cumsum(n)
                out[first:k] = (sums[ends] - sums[ends - n]) * SCALE / np.maximum(n, 1)
            first, held = k, 0
        if k < len(texts):
            held += len(texts[k])
    return 1 / (1 + np.exp(-np.clip(out + weights[-1], -35, 35)))


def bytes_of(texts: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts]


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(bytes_of(batch.column(1)), weights))], ["doc_id", "score"])

    return docs.select("doc_id", F.encode("text", "utf-8")).mapInArrow(giving_back(run), "doc_id long, score double")


def good(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The documents, with all columns, that score 0.5 or more."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(bytes_of(batch.column(at)), weights) >= 0.5))

    return docs.mapInArrow(giving_back(run), docs.schema)


def held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels of two folds of three, score all rows."""
    weights = fit(docs, labels.where(crc_fold(F.col("doc_id")) != 1))
    found = score(docs, weights)
    return found.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
