"""Which of many words a text contains: one automaton pass for a bounded list, blocks of byte grams for a growing table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
BITS = 1 << 20


def words_in(column: Column, words: list[str]) -> Column:
    """The words, each once and in the list's order, that a text contains; null for a null text. For lists of fixed size: each task builds one automaton."""
    listed = sorted({w for w in words if w})
    made = {}

    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        import ahocorasick

        if not made:
            made["automaton"] = ahocorasick.Automaton()
            for k, w in enumerate(listed):
                made["automaton"].add_word(w, k)
            made["automaton"].make_automaton()
        # One text at a time: a batch of them as strings would be held beside the batch.
        found = (None if not t.is_valid else [listed[k] for k in sorted({k for _, k in made["automaton"].iter(t.as_py())})] for t in texts)
        return pa.array(found, pa.list_(pa.string()))

    return find(column) if listed else F.when(column.isNotNull(), F.array().cast("array<string>"))


def gram_hashes(data: bytes, n: int):
    """A number below BITS for each run of n bytes."""
    import numpy as np

    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.full(max(0, len(x) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x100000001B3)) ^ x[k : len(x) - n + 1 + k]
    return (out ^ (out >> np.uint64(23))) % np.uint64(BITS)


def contained(texts: DataFrame, id: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """(id, word) for each text and each word that it contains, once each; no row for null or empty words.

    Both tables may grow. A word stands for its byte run (of at most GRAM bytes) that the fewest
    words have; texts give rows for those runs only that some word stands for, as a
    bitmap of BITS bits tells; text and word then meet on the run, and the word is looked
    for in the whole text.
    """
    import numpy as np

    named = words.select(F.col(word).alias("_word")).where("_word <> ''").distinct()

    def word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, min(GRAM, len(w.encode())), int(g)) for w in batch.column(0).to_pylist() for g in set(gram_hashes(w.encode(), min(GRAM, len(w.encode()))).tolist())]
            yield pa.RecordBatch.from_pydict({"_word": pa.array([r[0] for r in rows], pa.string()), "_n": pa.array([r[1] for r in rows], pa.int32()), "_gram": pa.array([r[2] for r in rows], pa.int32())})

    from vetta.plans.tables import written

    grams = written(named.mapInArrow(word_grams, "_word string, _n int, _gram int"), "grams")
    often = grams.groupBy("_n", "_gram").agg(F.count(F.lit(1)).alias("_often"))
    stands = written(grams.join(often, ["_n", "_gram"]).groupBy("_word", "_n").agg(F.min_by("_gram", F.struct("_often", "_gram")).alias("_gram")), "stands")
    maps = {n: np.zeros(BITS // 8, np.uint8) for n in range(1, GRAM + 1)}
    used = set()
    for row in stands.select("_n", "_gram").distinct().toLocalIterator():  # at most GRAM * BITS numbers
        maps[row[0]][row[1] >> 3] |= 1 << (row[1] & 7)
        used.add(row[0])

    def text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes, found = [], [], []
            for k, t in enumerate(batch.column(1)):
                data = (t.as_py() or "").encode()
                for n in sorted(used):
                    g = np.unique(gram_hashes(data, n)).astype(np.int64)
                    g = g[(maps[n][g >> 3] >> (g & 7) & 1).astype(bool)]
                    at += [k] * len(g)
                    sizes += [n] * len(g)
                    found += g.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int32()), pa.array(found, pa.int32())], ["_id", "_n", "_gram"])

    kind = texts.schema[id].dataType.simpleString()
    met = texts.select(F.col(id).alias("_id"), text).mapInArrow(text_grams, f"_id {kind}, _n int, _gram int").join(stands, ["_n", "_gram"]).select("_id", "_word").distinct()
    both = met.join(texts.select(F.col(id).alias("_id"), F.col(text).alias("_text")), "_id").where(F.col("_text").contains(F.col("_word")))
    return both.select(F.col("_id").alias(id), F.col("_word").alias(word)).distinct()
