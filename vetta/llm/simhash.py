"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each bit of the shingles' hashes, set where more
than half of them have it. Bit i of a fingerprint is given a non-zero vector
m(i) of radius + 1 bits; table v (each non-zero vector) keeps the bits with
m(i)·v odd. Up to `radius` differing bits span a space that some v is
orthogonal to, so that table drops all of them: every pair within the radius
meets there, with no chance of a miss. Copies of a fingerprint are one node.

Within a table's bucket no pairs are listed: a search from one unvisited
fingerprint to the next yields a spanning forest of the links, at most one link
a fingerprint, so connectivity is whole and large groups stay small.

Texts: null counts as empty; texts without words have fingerprint zero, and
link like any other. An empty table gives no rows. Repeated rows and ids share a
fingerprint; a null doc_id is kept and never names a group unless all are null.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import giving_back, materialize
from vetta.llm.components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
# Near copies by PRINTS fingerprints of a text's different shingles of five words, each of the shingles' hashes mixed in a way of its own.
# A table keeps of a fingerprint and the next one the strongest bit each (that with the clearest majority): its place and its value.
# At a likeness of 0.8 a bit differs with probability acos(2 * 0.8 / 1.8) / pi = 0.15, and a strongest bit is the same
# with 0.44 (simulated), so of such pairs some 4 in 100,000 share no table's key.
COPY_SHINGLE, ALIKE, PRINTS = 5, 0.8, 64
# Of the first two fingerprints' 128 bits texts that share a key may differ in WITHIN, other texts in some 64.
# The first SKETCH fingerprints are compared next; in LIKELY of their bits a pair agrees, at a likeness of 0.8 in 0.85.
# The first round links texts from LINKED on, since these links also say which texts later rounds compare: shingles that are 4 and 5
# in number, 4 of them the same, agree in 0.81, and of such pairs some 5 in 100,000 don't reach LIKELY.
WITHIN, SKETCH, LIKELY, LINKED = 41, 20, 0.77, 0.75
# A later round's bucket is dealt over a task for each so many texts, at most SHARES: each task sees all of them and looks for the links of its share.
SHARE, SHARES = 1024, 64
# Buckets of at most so many texts are compared all with all.
SHORT = 32
# Texts with so many different shingles or fewer are compared by all of them (32 bits each), so that next to no link fails its test.
FINE, NEARLY = 2048, 0.79
# The links that fingerprints miss are looked for by shared shingles: commonest ones last, at most COMMON, as some COUNTED texts have them.
# Bits of a text's marks bound what two texts can share.
COMMON, COUNTED, MARKS = 1 << 15, 1 << 12, 1024
# Candidates that leave a task at once.
PAIRS = 1 << 17
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(data: bytes, words: int) -> list[bytes]:
    """Shingles of so many words, space-joined; bytes.split() splits at 20 and 09-0D, as asked for."""
    parts = data.translate(LOWER).split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - words + 1]
    return [joined[a:b] for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())]


def simhash(data: bytes, words: int = SHINGLE) -> int:
    digest = xxhash.xxh64_intdigest
    found = [digest(x, SEED) for x in shingles(data, words)]
    if not found:
        return 0
    h = np.array(found, np.uint64).view(np.uint8)
    counts = sum(np.unpackbits(h[k : k + (1 << 20)].reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(0, len(h), 1 << 20))
    return int.from_bytes(np.packbits(counts * 2 > len(found), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x.as_buffer().to_pybytes(), words) if x.is_valid else 0 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.encode("text", "utf-8").alias("data")).mapInArrow(giving_back(run), "doc_id long, fp long")


def masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps, as signed 64-bit numbers."""
    vectors = (1 << radius + 1) - 1
    of_bit = [i % vectors + 1 for i in range(64)]
    found = [sum(1 << i for i, m in enumerate(of_bit) if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def distance(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; bitwise_count takes signed numbers by their absolute value, so the bits are read as unsigned."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest_of(n: int, near: Callable[[np.ndarray, int], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among n positions, as pairs; near tells which of some positions one position has a link to."""
    out, left, queue = [], np.arange(1, n), [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        linked = near(left, at)
        if linked.any():
            got = left[linked].tolist()
            out += [(at, j) for j in got]
            queue += got
            left = left[~linked]
    return out


def forest(bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within radius among distinct fingerprints, as pairs of positions."""
    return forest_of(len(bucket), lambda left, at: distance(bucket[left], bucket[at]) <= radius)


def links(nodes: DataFrame, radius: int = RADIUS, within: int = RADIUS) -> DataFrame:
    """Links (u, v) between nodes (node, prints: array of fingerprints) that meet in a table of the same fingerprint and differ in at most `within` bits.

    Links form a spanning forest in each bucket, so they must not be dropped afterwards.
    """
    keep = F.array(*[F.lit(m).cast("long") for m in masks(radius)])
    rows = nodes.select("node", F.posexplode("prints").alias("k", "fp")).select("node", "k", "fp", F.posexplode(keep).alias("t", "mask"))
    rows = rows.select((F.col("k") * len(masks(radius)) + F.col("t")).cast("long").alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node")
    n = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [np.empty(0, np.int64)] * 4
        for batch in batches_and_end(batches):
            carry = carry if batch is None else [np.concatenate([c, batch.column(k).to_numpy()]) for k, c in enumerate(carry)]
            table, key, fp, node = carry
            if not len(fp):
                continue
            new = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            # The last bucket may go on in the next batch.
            end = len(fp) if batch is None else int(new[-1]) if len(new) else 0
            carry = [c[end:] for c in carry]
            starts = np.concatenate(([0], new[new < end])) if end else new[:0]
            sizes = np.diff(np.append(starts, end))
            pairs = starts[sizes == 2]
            pairs = pairs[distance(fp[pairs], fp[pairs + 1]) <= within]
            u, v = [node[pairs]], [node[pairs + 1]]
            for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if found := forest(fp[a : a + n], within):
                    i, j = np.array(found).T
                    u.append(node[a + i])
                    v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    def batches_and_end(batches):
        yield from batches
        yield None

    return rows.repartition(n, "table", "key").sortWithinPartitions("table", "key", "node").mapInArrow(giving_back(run), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that links of at most radius bits reach."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("prints")), radius, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(firsts, "root").select("fp", "component_id"), "fp")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def hashes(parts: list[bytes]) -> np.ndarray:
    """Distinct hashes, sorted."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts)))


SEEDS = np.array([xxhash.xxh64_intdigest(b"%d" % k, SEED) | 1 for k in range(PRINTS)], np.uint64)


def margins(h: np.ndarray) -> np.ndarray:
    """For each bit of PRINTS fingerprints, by how many of a set of hashes ones outnumber zeros."""
    ones = np.zeros(64 * PRINTS, np.int64)
    for k in range(0, len(h), 255):  # so that a count fits a byte
        with np.errstate(over="ignore"):
            x = h[k : k + 255, None] * SEEDS
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return (2 * ones - len(h)).reshape(PRINTS, 64)


def keys_and_sketch(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each table and the first SKETCH fingerprints of a text, from the hashes of its shingles."""
    m = margins(mixed(h, 5))
    place = np.abs(m).argmax(axis=1)
    strongest = 2 * place + (m[np.arange(PRINTS), place] > 0)
    return (strongest * 128 + np.roll(strongest, -1)).astype(np.int16), np.packbits(m[:SKETCH] > 0, axis=1, bitorder="little").tobytes()


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of shingles that many texts have, commonest last: at most COMMON, counted in some COUNTED texts.

    They say nothing but the order in which heads() takes a text's shingles. Any
    order finds the same links; with common shingles last fewer texts meet that are not alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(shingles(x.as_buffer().to_pybytes(), COPY_SHINGLE)) for x in batch.column(0)]
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    one_in = max(1, docs.count() // COUNTED)
    some = docs.where((F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0) & F.col("text").isNotNull()).select(F.encode("text", "utf-8").alias("data"))
    counts = some.mapInArrow(giving_back(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    return counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow().column("h").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def heads(common: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives of a text's hashes, in one order for all texts, so many first ones that two texts with ALIKE of their union in common share one."""
    place = np.argsort(common, kind="stable")
    ordered = common[place]

    def head(h: np.ndarray) -> np.ndarray:
        most = len(h) - (4 * len(h) + 4) // 5 + 1 if len(h) else 0
        if not len(common):
            return h[:most]
        at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
        known = ordered[at] == h
        rare = h[~known][:most]
        return rare if len(rare) == most else np.concatenate([rare, common[np.sort(place[at[known]])]])[:most]

    return head


def marks(h: np.ndarray) -> bytes:
    """MARKS bits, with a one at each hash's place."""
    out = np.zeros(MARKS, np.uint8)
    out[(h % np.uint64(MARKS)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def sketches(docs: DataFrame, common: np.ndarray = np.zeros(0, np.uint64)) -> DataFrame:
    """doc_id, md5 of the text, its key in each table, its first two fingerprints and the sketch that they begin; how many shingles it has, the first of them in the order that heads() gives, and their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = heads(common)
        for batch in batches:
            sets = [hashes(shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", COPY_SHINGLE)) for x in batch.column(2)]
            found = [keys_and_sketch(h) for h in sets]
            keys = pa.array([x for x, _ in found], pa.list_(pa.int16()))
            two = np.frombuffer(b"".join(x[:16] for _, x in found), np.int64).reshape(-1, 2)
            columns = [keys, pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array([x for _, x in found], pa.binary())]
            more = [pa.array([len(h) for h in sets], pa.int32()), pa.array([head(h).view(np.int64) for h in sets], pa.list_(pa.int64())), pa.array([marks(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *more], ["doc_id", "md5", "keys", "fp1", "fp2", "sketch", "size", "head", "marks"])

    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return docs.select("doc_id", F.md5(data).alias("md5"), data.alias("data")).mapInArrow(giving_back(run), "doc_id long, md5 string, keys array<smallint>, fp1 long, fp2 long, sketch binary, size int, head array<long>, marks binary")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in order of their first column, cut where it changes: a table of whole runs, where each begins and where it ends."""

    def runs(table: pa.Table, end: int, new: np.ndarray):
        starts = np.concatenate(([0], new[new < end]))
        return table.slice(0, end), starts, np.append(starts[1:], end)

    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        carry = table if carry is None else pa.concat_tables([carry, table])
        key = carry.column(0).to_numpy()
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        if len(new):
            yield runs(carry, int(new[-1]), new)
            carry = carry.slice(int(new[-1]))
    if carry is not None and carry.num_rows:
        yield runs(carry, carry.num_rows, np.zeros(0, np.int64))


def in_runs(rows: DataFrame, key: str) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    return rows.repartition(n, key).sortWithinPartitions(key, "node")


def groups_within(fp1: np.ndarray, fp2: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each row of runs (tables' buckets) the first row of its component, by links between rows of a run that differ in at most WITHIN bits."""
    size = np.repeat(ends - starts, ends - starts)
    left = np.repeat(ends, ends - starts) - np.arange(len(fp1)) - 1
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Rows of short runs meet those that stand k behind them; a longer run yields a forest.
    at, k = np.flatnonzero((left > 0) & (size <= SHORT)), 1
    while len(at):
        near = distance(fp1[at], fp1[at + k]) + distance(fp2[at], fp2[at + k]) <= WITHIN
        u.append(at[near])
        v.append(at[near] + k)
        k += 1
        at = at[left[at] >= k]
    for a, b in zip(starts[ends - starts > SHORT].tolist(), ends[ends - starts > SHORT].tolist()):
        x, y = fp1[a:b], fp2[a:b]
        if found := forest_of(b - a, lambda left, at: distance(x[left], x[at]) + distance(y[left], y[at]) <= WITHIN):
            i, j = np.array(found).T
            u.append(a + i)
            v.append(a + j)
    u, v = np.concatenate(u), np.concatenate(v)
    first = np.arange(len(fp1))
    while (first[u] != first[v]).any():
        least = np.minimum(first[u], first[v])
        np.minimum.at(first, u, least)
        np.minimum.at(first, v, least)
        first = first[first]
    return first


def meetings(rows: DataFrame) -> DataFrame:
    """rows (key, node, and fp1 and fp2, if texts with a key must be within WITHIN bits): the sets of two or more nodes that meet, as (bucket, node); equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_runs(batches):
            node = table.column(1).to_numpy()
            if table.num_columns > 2:
                first = groups_within(table.column(2).to_numpy(), table.column(3).to_numpy(), starts, ends)
                order = np.argsort(first, kind="stable")
                node, first = node[order], first[order]
                starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
                ends = np.append(starts[1:], len(node))
            many = ends - starts > 1
            found = [node[a:b] for a, b in zip(starts[many].tolist(), ends[many].tolist())]
            sets = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
            bucket = np.repeat(sets, [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.concatenate([node[:0], *found]))], ["bucket", "node"])

    return in_runs(rows, "key").mapInArrow(giving_back(run), "bucket long, node long").distinct()


def agreement(slots: np.ndarray, at: int | slice, other: int | np.ndarray) -> np.ndarray:
    """Of the bits of sketches (a row of 64-bit words each) the share that agrees."""
    return 1 - np.bitwise_count(slots[at] ^ slots[other]).sum(axis=1) / (64 * slots.shape[1])


def likely_forest(slots: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the likely links among a bucket's sketches (a row each), as pairs of positions."""
    return forest_of(len(slots), lambda left, at: agreement(slots, left, at) >= LINKED)


def overlaps(fine: list[bytes | None]):
    """A function that gives the likeness of one set of shingles to all others of a bucket; -1 where a set isn't there."""
    sets = [None if x is None else np.frombuffer(x, np.uint32) for x in fine]
    size = np.array([-1 if x is None else len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *(x for x in sets if x is not None)])
    of = np.repeat(np.arange(len(sets)), np.maximum(size, 0))
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]

    def likeness(i: int) -> np.ndarray:
        out = np.full(len(sets), -1.0)
        if size[i] < 0:
            return out
        a, b = np.searchsorted(flat, sets[i], side="left"), np.searchsorted(flat, sets[i], side="right")
        n = b - a
        both = np.bincount(of[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(sets))
        there = size >= 0
        out[there] = both[there] / np.maximum(size[i] + size[there] - both[there], 1)
        return out

    return likeness


def untested(node: np.ndarray, root: np.ndarray, slots: np.ndarray, failed: list, most: int, fine: list[bytes | None], mine: np.ndarray) -> list[tuple[int, int]]:
    """For each node that is mine, up to `most` of its likeliest links to other components of a bucket that have not been tested, as pairs of positions."""
    names, of = np.unique(root, return_inverse=True)
    if len(names) == 1:
        return []
    out, likeness = [], overlaps(fine)
    # Each link to test has an end outside the largest component.
    for i in np.flatnonzero(mine & (of != np.bincount(of).argmax())).tolist():
        share = agreement(slots, slice(None), i)
        exact = likeness(i)
        share = np.where(exact < 0, share, np.where(exact >= NEARLY, exact, 0))
        share[of == of[i]] = 0
        if failed[i] is not None:
            share[np.isin(node, failed[i])] = 0
        best = np.argsort(-share, kind="stable")[:most]
        out += [(i, j) for j in best[share[best] >= LIKELY].tolist()]
    return out


def fine_sets(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, fine): the nodes' shingles as sorted 32-bit hashes; null for texts with more than FINE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(1):
                h = np.unique((hashes(shingles(t.as_buffer().to_pybytes(), COPY_SHINGLE)) >> np.uint64(32)).astype(np.uint32))
                found.append(h.tobytes() if len(h) <= FINE else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "fine"])

    return texts.join(nodes, "node", "left_semi").mapInArrow(giving_back(run), "node long, fine binary")


def clusters(links: DataFrame) -> DataFrame:
    """(bucket, node): the components of links (u, v) as buckets of two or more nodes, each node once."""
    stars = components(links.select("u", "v"))
    return stars.select(F.col("v").alias("bucket"), F.col("u").alias("node")).union(stars.select("v", F.col("v").alias("node")).distinct())


def to_test(members: DataFrame, sketch: DataFrame, texts: DataFrame, roots: DataFrame | None, failed: DataFrame | None, most: int) -> DataFrame:
    """Links (u, v) that a round tests: at first a forest of the likely ones in each bucket, then likely ones between components."""
    if roots is not None:
        both = failed.union(failed.select("v", "u")).groupBy("u").agg(F.collect_list("v").alias("failed"))
        rows = members.join(roots.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Only buckets that hold several components are looked at again.
        several = rows.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
        shares = F.least(F.lit(SHARES), F.ceil(F.col("n") / SHARE)).cast("int").alias("shares")
        rows = materialize(rows.join(several.select("bucket", shares), "bucket"), "several")
        fine = fine_sets(rows.select("node"), texts)
        rows = rows.join(sketch, "node").join(both.withColumnRenamed("u", "node"), "node", "left").join(fine, "node", "left")
        rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        mine = (F.pmod(F.xxhash64("node"), "shares") == F.col("share")).alias("mine")
        rows = rows.select(F.xxhash64("bucket", "share").alias("bucket"), "node", "sketch", "root", "failed", "fine", mine)
    else:
        rows = members.join(sketch, "node").select("bucket", "node", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_runs(batches):
            u, v = [], []
            node = table.column(1).to_numpy()
            slots = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint64).reshape(len(node), -1)
            root = table.column(3).to_numpy() if table.num_columns > 3 else None
            for a, b in zip(starts.tolist(), ends.tolist()):
                if root is None:
                    found = likely_forest(slots[a:b])
                else:
                    part = table.slice(a, b - a)
                    found = untested(node[a:b], root[a:b], slots[a:b], part.column(4).to_pylist(), most, part.column(5).to_pylist(), np.array(part.column(6).to_pylist(), bool))
                if found:
                    i, j = np.array(found).T
                    u.append(node[a + i])
                    v.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[:0], *x])) for x in (u, v)], ["u", "v"])

    found = in_runs(rows, "bucket").mapInArrow(giving_back(run), "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, alike): whether the texts' sets of shingles have ALIKE of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (hashes(shingles(t.as_buffer().to_pybytes(), COPY_SHINGLE)) for t in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= ALIKE * (len(x) + len(y) - both) if len(x) + len(y) else True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(alike, pa.bool_())], ["u", "v", "alike"])

    two = pairs.join(texts.withColumnsRenamed({"node": "u", "data": "a"}), "u").join(texts.withColumnsRenamed({"node": "v", "data": "b"}), "v")
    return two.select("u", "v", "a", "b").mapInArrow(giving_back(run), "u long, v long, alike boolean")


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, data): the texts of nodes, as bytes."""
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    named = nodes.select("node", F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"))
    texts = docs.select("doc_id", F.md5(data).alias("md5"), data.alias("data")).join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("md5") == F.col("_md5")))
    return materialize(texts.select("node", "data").dropDuplicates(["node"]), "texts")


def near_copies(nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v): each node that a chain of alike texts links to a smaller one, and the least of its component; and (bucket, node): the groups of which all links were looked for.

    nodes: node (a number of its own for each different text), doc_id (one of the text's), md5, keys, fp1, fp2 and sketch.

    Only links that the whole texts confirm join nodes. Nodes of a bucket whose
    links fail go on to their next likeliest ones, sixteen times as many a round,
    until no bucket has an untested likely link between two components. A text
    is in as many buckets as there are tables, so from the second round on the
    buckets are the components of the first round's links, whether these passed
    or failed: they hold every likely link, and each node once. Texts of FINE
    shingles or fewer are compared there by all of them, so a large group of
    texts that are nearly alike lists no pairs.
    """
    members = materialize(meetings(keys_of_nodes(nodes)), "meetings")
    wanted = members.select("node").distinct()
    sketch = materialize(nodes.join(wanted, "node").select("node", "sketch"), "sketch")
    texts = texts_of(docs, nodes.join(wanted, "node"))
    known, roots, failed, most = None, None, None, 1
    while True:
        pairs = materialize(to_test(members, sketch, texts, roots, failed, most), "pairs")
        if pairs.isEmpty():
            return (roots, members) if roots is not None else (pairs, pairs.select(F.col("u").alias("bucket"), F.col("v").alias("node")))
        if roots is None:
            members = materialize(clusters(pairs), "clusters")
        now = materialize(tested(pairs, texts), "tested")
        known = now if known is None else known.union(now)
        if roots is None or not now.where("alike").isEmpty():
            roots = components(known.where("alike").select("u", "v"))
        failed = known.where("not alike").select("u", "v")
        most *= 16


def missed(prints: DataFrame, named: DataFrame) -> DataFrame:
    """Candidates (u, v) for alike texts of different components that no bucket has compared.

    prints: sketches(); named: node, doc_id, md5, root, and bucket, if its
    component's links were looked for. Two sets of a and b shingles are alike if they share
    4 (a + b) / 9 or more, and then one of each one's first a - 4 a / 5 + 1 in
    any order that both follow. At the first that they share, as many are left at most as
    stand behind it. Texts of FINE shingles or fewer of a bucket were compared by all of them.
    """
    at = F.posexplode("head").alias("pos", "key")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("md5") == F.col("_md5"))
    rows = prints.join(named.withColumnsRenamed({"doc_id": "_id", "md5": "_md5"}), same).select("node", "root", F.when(F.col("size") <= FINE, F.col("bucket")).alias("bucket"), "size", at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in whole_runs(batches):
            # A run's rows in order of what they needn't be compared in: a bucket or a component.
            bucket = table.column(3).fill_null(-1).to_numpy()
            group = np.where(bucket < 0, -1 - table.column(2).to_numpy(), bucket)
            of = np.repeat(np.arange(len(starts)), ends - starts)
            order = np.lexsort((group, of))
            node, root, size, pos = (table.column(k).to_numpy()[order].astype(np.int64) for k in (1, 2, 4, 5))
            group, rest = group[order], size - pos
            new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (group[1:] != group[:-1])))
            to = np.repeat(np.append(new[1:], len(node)), np.diff(np.append(new, len(node))))
            end = np.repeat(ends, ends - starts)
            at, held, n = np.flatnonzero(to < end), [], 0
            # Each row meets those of its run's later groups, one after the other.
            while len(at):
                i, j = at, to[at]
                total = size[i] + size[j]
                good = (root[i] != root[j]) & (9 * np.minimum(size[i], size[j]) >= 4 * total) & (9 * np.minimum(rest[i], rest[j]) >= 4 * total)
                held.append((node[i[good]], node[j[good]]))
                n += int(good.sum())
                to[at] += 1
                at = at[to[at] < end[at]]
                if n >= PAIRS or not len(at):
                    u, v = map(np.concatenate, zip(*held))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])
                    held, n = [], 0

    pairs = in_runs(rows.select("key", "node", "root", "bucket", "size", "pos"), "key").mapInArrow(giving_back(run), "u long, v long").distinct()

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MARKS // 8) for k in (4, 5))
            a, b = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            # Each mark of one that the other hasn't is a shingle that they don't share.
            most = np.minimum(a - np.bitwise_count(x & ~y).sum(axis=1), b - np.bitwise_count(y & ~x).sum(axis=1))
            yield batch.filter(pa.array(9 * most >= 4 * (a + b))).select(["u", "v"])

    known = prints.join(named.withColumnsRenamed({"doc_id": "_id", "md5": "_md5"}), same).select("node", "size", "marks").dropDuplicates(["node"])
    sides = [known.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("marks").alias(f"{c}_marks")) for c in "uv"]
    return pairs.join(sides[0], "u").join(sides[1], "v").select("u", "v", "u_size", "v_size", "u_marks", "v_marks").mapInArrow(giving_back(likely), "u long, v long")


def keys_of_nodes(nodes: DataFrame) -> DataFrame:
    """(key, node, fp1, fp2): nodes with a key, the strongest bits that a table keeps, meet."""
    key = (F.col("table") * (1 << 14) + F.col("bits")).alias("key")
    return nodes.select(F.posexplode("keys").alias("table", "bits"), "node", "fp1", "fp2").select(key, "node", "fp1", "fp2")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents less all but the first (least doc_id) of each group of exact copies and of near copies by SimHash fingerprints, confirmed by word shingles.

    Fingerprints find nearly all links; those that they miss are found by shared
    shingles, so texts that share ALIKE of their shingles are linked without exception.
    Different texts are the nodes of the links, whatever doc_ids they have: rows
    without a doc_id and texts that share one link like any other. Of a group the
    least doc_id stays, none only where no row of it has one; then, and of
    texts with the same doc_id, the least digest. Rows that repeat both doc_id and text are one document.
    """
    prints = materialize(sketches(docs, common_shingles(docs)), "sketches")
    nodes = prints.groupBy("md5").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("keys", "fp1", "fp2", "sketch")])
    # Numbers that stay as they are once written.
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links, groups = near_copies(nodes, docs)
    least = lambda links: links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    named = nodes.select("node", "doc_id", "md5").join(least(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Fingerprints miss a few links; those are found by shared shingles.
    pairs = materialize(missed(prints, named.join(groups, "node", "left")), "missed")
    if not pairs.isEmpty():
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        more = materialize(tested(pairs, texts_of(docs, nodes.join(ends, "node"))), "tested").where("alike").select("u", "v")
        if not more.isEmpty():
            links = components(links.union(more))
    named = nodes.select("node", "doc_id", "md5").join(least(links), "node", "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"))
    stay = named.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("first")).select("first.*").select("_id", "_md5")
    md5 = F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    # Columns of docs may have any names, so its rows meet in a struct.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("at_id"), md5.alias("at_md5"))
    kept = rows.join(stay, F.col("at_id").eqNullSafe(F.col("_id")) & (F.col("at_md5") == F.col("_md5")), "left_semi").select("row.*")
    again = prints.groupBy("doc_id", "md5").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept
