"""Lempel-Ziv phrase fingerprints: the set of phrases that an incremental parse of a document meets, as a minimum-hash signature.

The parse reads the UTF-8 bytes and cuts the shortest phrase that isn't in the
dictionary yet, which it then joins (the closing phrase may be a known one and
adds nothing). Phrase hashes are polynomials of their bytes, so equal phrases
have equal hashes everywhere. The signature has SLOTS values of 16 bits: each
hash falls in one slot and the least of a slot stays; an empty slot takes the
value of the next filled one to its right, mixed with the distance (densified
one-permutation hashing). Likeness is the share of equal slots, less what
slots of unlike documents have in common by chance.

Texts: null counts as empty; empty texts have a signature of zeros and are like
each other. Any length: memory follows the document's phrases. Rows that repeat
a doc_id stand next to one another, in order of their text. A null doc_id
comes last. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import parts

SLOTS = 64
BITS = 16
RANGES = 20_000  # at most so many, however large the table: rows stream through a range
STEP = 0x9E3779B97F4A7C15
BASE = 0x100000001B3


def parse(data: bytes, phrases: dict[int, int] | None = None, node: int = 0) -> tuple[dict[int, int], int]:
    """The dictionary after data, and the phrase it ends in. An entry's key is its parent's number and its last byte.

    phrases, node: where an earlier part of the document ended.
    """
    phrases = {} if phrases is None else phrases
    get, new = phrases.get, (len(phrases) + 1) << 8
    for c in data:
        key = node | c
        found = get(key)
        if found is None:
            phrases[key] = new
            new += 256
            node = 0
        else:
            node = found
    return phrases, node


def phrase_hashes(phrases: dict[int, int]) -> np.ndarray:
    """A hash of each phrase: a polynomial of its bytes, mixed."""
    keys = np.fromiter(phrases, np.int64, len(phrases))
    parent, last = keys >> 8, (keys & 255).astype(np.uint64) + np.uint64(1)
    acc = np.zeros(len(keys), np.uint64)
    power, live, at = np.uint64(1), np.arange(len(keys)), np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            acc[live] += last[at] * power
            up = parent[at]
            more = up > 0
            live, at = live[more], up[more] - 1
            power *= np.uint64(BASE)
        acc = (acc ^ (acc >> np.uint64(31))) * np.uint64(STEP)
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return acc ^ (acc >> np.uint64(32))


def signature(phrases: dict[int, int]) -> np.ndarray:
    if not phrases:
        return np.zeros(SLOTS, np.uint16)
    h = phrase_hashes(phrases)
    slot, value = (h >> np.uint64(58)).astype(np.int64), (h & np.uint64((1 << 58) - 1))
    least = np.full(SLOTS, np.uint64(1 << 60))
    np.minimum.at(least, slot, value)
    filled = np.flatnonzero(least < np.uint64(1 << 60))
    source = filled[np.searchsorted(filled, np.arange(SLOTS)) % len(filled)]
    away = (source - np.arange(SLOTS)) % SLOTS
    with np.errstate(over="ignore"):
        mixed = (least[source] + away.astype(np.uint64) * np.uint64(STEP)) * np.uint64(STEP)
    return (mixed >> np.uint64(64 - BITS)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    chance = 1 / (1 << BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def spelled(x: np.ndarray) -> str:
    return x.astype(">u2").tobytes().hex()


def fingerprint(text: str) -> np.ndarray:
    return signature(parse(text.encode())[0])


def both(text: str, other: str) -> tuple[np.ndarray, str, np.ndarray]:
    """The text's signature, its edited text, and the signature of that; both parses share the half that stays."""
    half = len(text) // 2
    stay, tail = text[: len(text) - half], text[len(text) - half :]
    # The last half gives way to the other text's first so many code points.
    edited = stay + other[:half]
    phrases, node = parse(stay.encode())
    fork = parse(other[:half].encode(), dict(phrases), node)[0]
    return signature(parse(tail.encode(), phrases, node)[0]), edited, signature(fork)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex) of each document."""

    @F.pandas_udf("string")
    def one(texts):
        return texts.map(lambda t: spelled(fingerprint(t or "")))

    return docs.select("doc_id", one("text").alias("fingerprint"))


def with_next(docs: DataFrame) -> DataFrame:
    """docs dealt by ranges of doc_id, descending in each: (range, own, doc_id, text).

    The next document of a range's last one is the first of the next range, so
    each range also gets that row, with own false. Ranges end at quantiles of
    doc_id, which are ids of the table, so that row's id is known beforehand.
    """
    n = min(parts(docs, "text"), RANGES)
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"))
    found = ids.agg(F.percentile_approx("id", [k / n for k in range(1, n + 1)], 20 * n), F.max("id")).first()
    # Range k holds the ids over ends[k - 1] and up to ends[k]; the one below its least is ends[k - 1], and below range 0's the largest.
    ends = np.array(sorted({*(found[0] or [0]), found[1] or 0}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.searchsorted(ends, batch.column(0).to_numpy())
            twice = np.flatnonzero(ends[home] == batch.column(0).to_numpy())
            rows = batch.take(pa.array(np.concatenate([np.arange(len(home)), twice])))
            to = np.concatenate([home, (home[twice] + 1) % len(ends)]).astype(np.int32)
            own = np.arange(len(to)) < len(home)
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(own), *rows.columns], ["range", "own", "id", "doc_id", "text"])

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(deal, "range int, own boolean, id long, doc_id long, text string")
    return dealt.repartition(len(ends), "range").sortWithinPartitions("range", F.desc("own"), F.desc("id"), "text").select("range", "own", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, descending by doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(k) for k in range(4)))

        held, out = None, []
        names = [x.strip().split()[0] for x in SCHEMA.split(",")]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]

        def done():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        waiting = None  # signature and the rest of the row whose next document's signature is to come
        met = None  # the last range whose next document has come
        for at, own, doc, text in rows():
            at, own, text = at.as_py(), own.as_py(), text.as_py()
            if held is not None and at == held[0] and not (met == at):
                mine, new, theirs = both(held[2], text)
                row = (held[1], len(held[2]), hashlib.sha256(new.encode()).hexdigest(), spelled(mine), spelled(theirs), likeness(mine, theirs))
                if waiting:
                    out.append((*waiting[1], likeness(waiting[0], mine)))
                waiting = mine, row
                if not own:  # the range ends here
                    out.append((*row, likeness(mine, fingerprint(text))))
                    waiting, met = None, at
            held = (at, doc.as_py(), text) if own else None
            if len(out) >= 1000:
                yield done()
                out = []
        if out:
            yield done()

    return with_next(docs).mapInArrow(run, SCHEMA)
