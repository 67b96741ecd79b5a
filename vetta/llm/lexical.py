"""Ranked lexical search: a K2-treap over the grid of terms and documents, descended by all terms of an item at once.

Documents are cut into shards of a few MB of text. A shard's grid has a row for each
term and a column for each document; its quadtree keeps the cells that hold a
posting, as four bits for the quarters of each cell, and for each the greatest impact
in it, as the drop from the cell around it. An item walks down the tree by ranges of
documents: each of its terms stands in the cell of its row and of the range, and the
sum of weighted maxima is a bound for all documents of the range. A beam of the best
ranges gives the k-th score first; then ranges whose bound is below it are left out.
Scores at the leaves are exact, so the result is exact whatever is pruned.

Nulls and odd rows: a null or empty text has no terms; such a document is never found
and not counted, such an item gets no rows. Rows of documents with one doc_id are
documents of their own, a null doc_id comes after equal scores. Rows of one item_id
are one item with the terms of all of them; a null item_id is an item too. Empty
tables give no rows. Texts of any length go through whole: a text longer than a shard
is a shard of its own. No other column is read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetta.llm.common import give_back, materialize
from vetta.llm.resample import words

SHARD_MB = 8
#: Items that walk together have so many terms at most (one item may have more), and states of more entries are split.
TERMS, ENTRIES = 4096, 1 << 20
BEAM = 96
#: One in so many shards is searched first; its k-th scores are where the others begin.
FIRST = 16
SEGMENTS = 64
QUARTERS = np.array([m.bit_count() for m in range(16)], np.int32)
BEFORE = np.array([[(m & ((1 << q) - 1)).bit_count() for q in range(4)] for m in range(16)], np.int32)
SHARD = "shard long, docs array<long>, terms array<binary>, dfs array<int>, nodes array<int>, top int, masks binary, drops binary"


def spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2**32, moved to the even places of 64."""
    x = x.astype(np.uint64)
    for shift in (16, 8, 4, 2, 1):
        keep = np.uint64(sum(((1 << shift) - 1) << at for at in range(0, 64, 2 * shift)))
        x = (x | x << np.uint64(shift)) & keep
    return x


def grow(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> dict:
    """The tree of points that are different cells of the grid: from the root down, quarters in use, greatest value, drops."""
    levels = max(1, int(max(rows.max(), columns.max())).bit_length())
    code = spread(rows) << np.uint64(1) | spread(columns)
    order = np.argsort(code)
    code, value = code[order], values[order].astype(np.int32)
    masks, drops = [], []
    for _ in range(levels):
        up = code >> np.uint64(2)
        first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
        top = np.maximum.reduceat(value, first)
        drops.append(np.repeat(top, np.diff(np.append(first, len(code)))) - value)
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)).astype(np.uint8), first))
        code, value = up[first], top
    pack = pa.Codec("zstd").compress
    return {
        "nodes": [len(m) for m in reversed(masks)] + [len(values)],
        "top": int(value[0]),
        "masks": pack(np.concatenate(masks[::-1]).tobytes(), asbytes=True),
        "drops": pack(np.concatenate(drops[::-1]).tobytes(), asbytes=True),
    }


class Tree:
    """A tree of grow(), ready to walk: of each level the quarters, the first child and the children's maxima."""

    def __init__(self, nodes: list[int], top: int, masks: bytes, drops: bytes):
        unpack = pa.Codec("zstd").decompress
        masks = np.frombuffer(unpack(masks, sum(nodes[:-1]), asbytes=True), np.uint8)
        drops = np.frombuffer(unpack(drops, 4 * sum(nodes[1:]), asbytes=True), np.int32)
        self.levels, value, m, d = [], np.array([top], np.int32), 0, 0
        for above, below in zip(nodes, nodes[1:]):
            mask = masks[m : m + above]
            children = QUARTERS[mask]
            value = np.repeat(value, children) - drops[d : d + below]
            self.levels.append((mask, np.cumsum(children, dtype=np.int32) - children, value))
            m, d = m + above, d + below


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by place; halves keep doubles exact."""
    high, low = np.bincount(at, values >> 20, n), np.bincount(at, values & 0xFFFFF, n)
    return (high.astype(np.int64) << 20) + low.astype(np.int64)


def places(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The place from 0 of each row in its group, rows taken in `order`, which keeps groups together."""
    sorted_group = group[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return out


class Walk:
    """Some items on one tree. An entry is a term of a range: its range, its row and weight, and its cell."""

    def __init__(self, tree: Tree, item: np.ndarray, row: np.ndarray, weight: np.ndarray, floor: np.ndarray, k: int):
        self.tree, self.row, self.weight, self.floor, self.k = tree, row, weight, floor, k
        items = np.arange(len(floor))
        self.root = (0, items, items * 0, np.full(len(floor), np.iinfo(np.int64).max), item, np.arange(len(row)), np.zeros(len(row), np.int32))

    def keep(self, state, wanted: np.ndarray):
        depth, item, column, bound, at, slot, node = state
        to, stays = np.cumsum(wanted) - 1, wanted[at]
        return depth, item[wanted], column[wanted], bound[wanted], to[at[stays]], slot[stays], node[stays]

    def halves(self, state):
        """The next level: both halves of each range, without those that hold nothing or can't reach the item's floor."""
        depth, item, column, _, at, slot, node = state
        mask, first, value = self.tree.levels[depth]
        quarters = mask[node]
        q = (self.row[slot] >> (len(self.tree.levels) - 1 - depth) & 1) * 2
        sides = [np.flatnonzero(quarters >> (q + side) & 1) for side in (0, 1)]
        at = np.concatenate([at[on] * 2 + side for side, on in enumerate(sides)])
        node = np.concatenate([first[node[on]] + BEFORE[quarters[on], q[on] + side] for side, on in enumerate(sides)])
        slot = np.concatenate([slot[on] for on in sides])
        item, column = np.repeat(item, 2), np.repeat(column * 2, 2) + np.tile([0, 1], len(column))
        bound = sums(at, self.weight[slot] * value[node], len(item))
        return self.keep((depth + 1, item, column, bound, at, slot, node), bound >= self.floor[item])

    def raise_floors(self, item: np.ndarray, score: np.ndarray) -> None:
        last = places(item, np.lexsort((-score, item))) == self.k - 1
        self.floor[item[last]] = np.maximum(self.floor[item[last]], score[last])

    def beam(self, width: int) -> None:
        """Down the best ranges alone, for floors to begin with."""
        state = self.root
        while state[0] < len(self.tree.levels):
            state = self.halves(state)
            state = self.keep(state, places(state[1], np.lexsort((-state[3], state[1]))) < width)
        self.raise_floors(state[1], state[3])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, column and score of all documents that reach their item's floor in the end."""
        self.beam(max(BEAM, self.k))
        stack, found = [self.root], []
        while stack:
            state = stack.pop()
            state = self.keep(state, state[3] >= self.floor[state[1]])
            if not len(state[1]):
                continue
            if state[0] == len(self.tree.levels):
                found.append((state[1], state[2], state[3]))
                self.raise_floors(state[1], state[3])
            elif len(state[4]) > ENTRIES and len(state[1]) > 1:
                better = places(state[1] * 0, np.argsort(-state[3], kind="stable")) < len(state[1]) // 2
                stack += [self.keep(state, ~better), self.keep(state, better)]
            else:
                stack.append(self.halves(state))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What tf occurrences in a document of n terms are worth before the term's weight, in whole numbers."""
    m = 50 + 50 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def term_totals(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms they have with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [len(words(text.as_py())) for batch in batches for text in batch.column(0)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(map(bool, n))], pa.int64()), "length": pa.array([sum(n)], pa.int64())})

    row = docs.select("text").mapInArrow(run, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return row[0] or 0, row[1] or 0


def build(docs: DataFrame, shard_mb: float = SHARD_MB) -> tuple[DataFrame, int]:
    """The index, a row a shard, as a written table; and the number of documents with terms. Nothing is shuffled."""
    documents, length = term_totals(docs)

    def shard(number: int, ids: list, tf: list, terms: dict) -> pa.RecordBatch:
        n = np.array([t.sum() for _, t in tf])
        order = np.argsort(n, kind="stable")  # columns by length: like impacts side by side
        rows, values = np.concatenate([tf[k][0] for k in order]), np.concatenate([tf[k][1] for k in order])
        columns = np.repeat(np.arange(len(order)), [len(tf[k][0]) for k in order])
        df = np.bincount(rows, minlength=len(terms))
        common = np.argsort(-df, kind="stable")  # rows by how common the terms are
        place = np.empty(len(common), np.int64)
        place[common] = np.arange(len(common))
        names = list(terms)
        tree = grow(place[rows], columns, impact(values, n[order][columns], documents, length))
        row = {"shard": number, "docs": [ids[k] for k in order], "terms": [names[k] for k in common], "dfs": df[common].tolist()} | tree
        out = pa.RecordBatch.from_pylist([row], pa.schema([("shard", pa.int64()), ("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("dfs", pa.list_(pa.int32())), ("nodes", pa.list_(pa.int32())), ("top", pa.int32()), ("masks", pa.binary()), ("drops", pa.binary())]))
        give_back()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        size, ids, tf, terms = 0, [], [], defaultdict(count().__next__)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = words(text.as_py())
                if not found:
                    continue
                counts = Counter(found)
                tf.append((np.fromiter(map(terms.__getitem__, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))))
                ids.append(doc_id.as_py())
                size += sum(map(len, found)) + len(found)
                if size >= shard_mb * 2**20:
                    yield shard(number, ids, tf, terms)
                    size, ids, tf, terms, number = 0, [], [], defaultdict(count().__next__), number + 1
        if ids:
            yield shard(number, ids, tf, terms)

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SHARD), "lexical-index"), documents


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(k, w) for k, text in enumerate(batch.column(1)) for w in dict.fromkeys(words(text.as_py()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in pairs], pa.int64())), pa.array([w for _, w in pairs], pa.binary())], ["item_id", "term"])

    kind = items.select("item_id").schema[0].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


def weigh(terms: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """item_id, terms and weights of each item, without terms that no document has."""
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.dfs").alias("df"))
    df = held.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weighed = terms.join(df.select("term", weight.cast("long").alias("weight")), "term").where("weight > 0")
    both = F.sort_array(F.collect_list(F.struct("term", "weight")))
    return weighed.groupBy("item_id").agg(both.alias("p")).select("item_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"))


def answer(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item_id, doc_id and score: each shard's k best documents of each item (item_id, terms, weights, floor), none below the floor.

    Each shard is sent once and each item to every task; in a task the shards come first and items pass by in batches.
    """
    tasks = max(1, index.count())
    tree = index.select(F.pmod(F.xxhash64("shard"), F.lit(tasks)).cast("int").alias("task"), F.struct(*index.columns).alias("tree"), F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("ask"))
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(None).cast(tree.schema["tree"].dataType).alias("tree"), F.struct(*asked.columns).alias("ask"))
    kind = asked.schema["item_id"].dataType.simpleString()

    def walk(shard: dict, names: dict, asks: list[dict]) -> pa.RecordBatch:
        item, row, weight = [], [], []
        for n, ask in enumerate(asks):
            for term, w in zip(ask["terms"], ask["weights"]):
                if (r := names.get(term)) is not None:
                    item.append(n), row.append(r), weight.append(w)
        floor = np.array([ask["floor"] for ask in asks], np.int64)
        at, column, score = Walk(shard["tree"], np.array(item, np.int64), np.array(row, np.int64), np.array(weight, np.int64), floor, k).best()
        ids, null = shard["docs"]
        kept = places(at, np.lexsort((ids[column], null[column], -score, at))) < k
        at, column, score = at[kept], column[kept], score[kept]
        return pa.RecordBatch.from_arrays([pa.array([asks[n]["item_id"] for n in at], schema.field("item_id").type), pa.array(ids[column], pa.int64(), mask=null[column]), pa.array(score, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shards, asks, size = None, [], [], 0
        for batch in batches:
            for task, tree, ask in zip(*batch.columns):
                if (task := task.as_py()) != now:
                    yield from (walk(s, names, asks) for s, names in shards if asks)
                    now, shards, asks, size = task, [], [], 0
                if tree.is_valid:
                    t = tree.as_py()
                    null = np.array([i is None for i in t["docs"]])
                    ids = np.array([i or 0 for i in t["docs"]], np.int64)
                    shards.append(({"tree": Tree(t["nodes"], t["top"], t["masks"], t["drops"]), "docs": (ids, null)}, {name: r for r, name in enumerate(t["terms"])}))
                    continue
                asks.append(ask.as_py())
                size += len(asks[-1]["terms"])
                if size >= TERMS:
                    yield from (walk(s, names, asks) for s, names in shards)
                    asks, size = [], 0
        yield from (walk(s, names, asks) for s, names in shards if asks)

    schema = pa.schema([("item_id", arrow_type(asked, "item_id")), ("doc_id", pa.int64()), ("score", pa.int64())])
    dealt = tree.unionByName(every).repartition(tasks, "task").sortWithinPartitions("task", F.col("ask").isNotNull())
    return dealt.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def top(rows: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item with their rank; first of each segment of rows, so that an item is never one task's alone."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    cut = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= k)
    parts = rows.withColumn("_segment", F.pmod(F.xxhash64("doc_id"), F.lit(SEGMENTS)))
    return cut(cut(parts, "item_id", "_segment").drop("rank"), "item_id").drop("_segment")


def search(docs: DataFrame, items: DataFrame, k: int = 50, shard_mb: float = SHARD_MB) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: for each item its k documents of the highest score above 0, equal ones by ascending doc_id."""
    index, documents = build(docs, shard_mb)
    asked = materialize(weigh(materialize(item_terms(items), "item-terms"), index, documents), "items")
    begins = F.pmod(F.xxhash64(F.lit(7), "shard"), F.lit(FIRST)) == 0
    first = materialize(answer(index.where(begins), asked.withColumn("floor", F.lit(1).cast("long")), k), "first-shards")
    floors = top(first, k).where(F.col("rank") == k).select(F.col("item_id").alias("_item"), F.col("score").alias("floor"))
    raised = asked.join(floors, F.col("item_id").eqNullSafe(F.col("_item")), "left").drop("_item").withColumn("floor", F.coalesce("floor", F.lit(1).cast("long")))
    rest = answer(index.where(~begins), materialize(raised, "floors"), k)
    return top(first.unionByName(rest), k).select("item_id", "rank", "doc_id", "score")
