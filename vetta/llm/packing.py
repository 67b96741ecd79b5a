"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens.

The rule for one sequence: fill it with the longest unpacked piece that fits,
again and again; if a gap is left, take out the shortest piece and put in two
unpacked pieces that fit the widened gap better than it did, the two that fill
it most. That depends only on which lengths are still there, so one choice
holds for as many sequences as the counts of its lengths last. The plan is
therefore made from the histogram of lengths, which has at most `capacity`
rows however many documents there are; the sequences it gives are those of the
rule applied piece by piece. Each piece then finds its place by its rank among
the pieces of its length. No window holds more than one salt of one length.

Texts: null counts as empty; every document ends with id 0, so an empty one has
one token. Longer documents than a sequence are cut, others never. Rows that
repeat a doc_id, or have none, are packed each by itself. An empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetta.llm.bpe import let_go, library_encoder, tokenizer_path
from vetta.llm.common import giving_back, materialize

CAPACITY = 2048
END = b"\0\0\0\0"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Each document's ids and a closing 0, cut into pieces of at most `capacity`."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(enc.words(text.as_py() or "")) + END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(giving_back(run, let_go), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Sequences as ({length: how often}, number of such sequences), by best two fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    index = np.arange(capacity + 1)
    out = []
    while left.any():
        free = left.copy()
        used: dict[int, int] = {}
        gap = capacity
        # The longest available length up to each size.
        upto = np.maximum.accumulate(np.where(free > 0, index, 0))
        size = upto[gap]
        while size:
            n = int(min(gap // size, free[size]))
            used[int(size)] = n
            free[size] -= n
            gap -= n * int(size)
            size = upto[min(gap, size - 1)]
        if gap:
            short = min(used)
            room = gap + short
            upto = np.maximum.accumulate(np.where(free > 0, index, 0))
            first = index[1 : room + 1][free[1 : room + 1] > 0]
            second = upto[room - first]
            alone = (second == first) & (free[first] < 2)
            second[alone] = upto[first[alone] - 1]
            both = np.where(second > 0, first + second, 0)
            if len(both) and both.max() > short:
                k = int(both.argmax())
                used[short] -= 1
                for size in (int(first[k]), int(second[k])):
                    used[size] = used.get(size, 0) + 1
                used = {size: n for size, n in used.items() if n}
        times = int(min(left[size] // n for size, n in used.items()))
        for size, n in used.items():
            left[size] -= n * times
        out.append((used, times))
    return out


def places(sequences: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """The plan as rows (length, first rank, sequences, pieces of that length in each, first sequence, offset)."""
    rows, rank, sequence = [], {}, 0
    for used, times in sequences:
        offset = 0
        for size in sorted(used, reverse=True):
            n = used[size]
            first = rank.get(size, 0)
            rows.append((size, first, times, n, sequence, offset))
            rank[size] = first + n * times
            offset += n * size
        sequence += times
    return np.array(rows, np.int64).reshape(-1, 6)


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """cut with each row's rank among the rows of its length, from 0: its salt's start and its place in the salt."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    rows = salted.withColumn("within", F.row_number().over(within) - 1)
    return rows.join(starts.drop("count"), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within")).drop("salt", "before", "within")


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (a written table with a column length, doc_id, piece, ids_crc32) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    # As many rows as the plan has lengths in its sequences: a few thousand for any table.
    rows = [(*map(int, r),) for r in places(plan(histogram, capacity))]
    table = cut.sparkSession.createDataFrame(rows, "length long, first long, times long, n long, sequence long, at long")
    salts = max(64, cut.rdd.getNumPartitions())
    found = ranked(cut, salts).join(F.broadcast(table), "length").where("rank >= first and rank < first + n * times")
    nth = F.col("rank") - F.col("first")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.expr("(rank - first) div n")).alias("sequence_id"), (F.col("at") + nth % F.col("n") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(materialize(pieces(docs, capacity, path), "pieces"), capacity)
