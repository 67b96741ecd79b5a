"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. The
vector of an n-gram binds (multiplies) its letters' vectors, each shifted by its
place; a document bundles (adds) its n-grams' vectors, and a language bundles
its documents, each at equal length. A document takes the language whose
prototype has the largest cosine with it; ties go to the first in alphabetical
order.

Texts: null counts as empty; a text without letters is `und` with score 0. Any
length: n-grams are counted CHARS at a time and bundled GRAMS different ones at
a time, so beside the text's own code points memory is bounded. Null languages are not learned
from. A null doc_id counts as the empty string in the fold. An empty table, or
one without a learnable row, teaches nothing: every answer is `und`. Rows that
repeat count each by itself; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import crc_fold, give_back

SIZE = 1024
GRAM = 3
CHARS, TEXTS, GRAMS = 1 << 19, 512, 2048  # characters, texts and different n-grams handled at once


@functools.lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(8192)
def letter_vector(code: int) -> np.ndarray:
    bits = np.random.Generator(np.random.Philox(key=code)).bytes(SIZE // 8)
    return (np.unpackbits(np.frombuffer(bits, np.uint8)).astype(np.int8) << 1) - 1


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, one after another, and where each text's end. What isn't a letter is 0; runs of it are one."""
    lower = [t.lower() for t in texts]
    code = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lower])
    code = np.where(letters()[code], code, np.uint32(0))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    # A text's closing 0 and its first letter or space stay, so that its neighbours don't matter.
    keep[ends - 1] = True
    keep[ends[:-1]] = True
    return code[keep], np.cumsum(keep)[ends - 1]


def gram_vectors(grams: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The vectors of n-grams, given as numbers of the letters whose vectors are in base."""
    out = np.ones((len(grams), SIZE), np.int8)
    for k in range(GRAM):
        out *= np.roll(base[grams % len(base)], k, axis=1)
        grams = grams // len(base)
    return out.astype(np.float32)


def bundles(texts: list[str]) -> np.ndarray:
    """The bundled n-gram vectors of TEXTS texts at most, a row for each."""
    out = np.zeros((len(texts), SIZE), np.float32)
    code, ends = codes(texts)
    for begin in range(0, len(code) - GRAM + 1, CHARS):
        part = code[begin : begin + CHARS + GRAM - 1]
        seen = np.unique(part)
        at = np.zeros(int(seen[-1]) + 1, np.int64)
        at[seen] = np.arange(len(seen))
        part = at[part]
        gram = part[: len(part) - GRAM + 1].copy()
        for k in range(1, GRAM):
            gram = gram * len(seen) + part[k : len(part) - GRAM + 1 + k]
        row = np.searchsorted(ends, begin + np.arange(len(gram)), side="right")
        # An n-gram ends at its text's last code point but one, the closing 0, at most; it has none of the next text.
        same = begin + np.arange(len(gram)) + GRAM <= ends[np.minimum(row, len(ends) - 1)] - 1
        gram, row = gram[same], row[same]
        found, which = np.unique(gram, return_inverse=True) if len(seen) > 200 else dense_unique(gram, len(seen) ** GRAM)
        base = np.stack([letter_vector(int(c)) for c in seen])  # a row for each different letter
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(0, len(found) + GRAMS, GRAMS))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            some = order[a:b]
            own = found[k * GRAMS : (k + 1) * GRAMS]
            counts = np.bincount(row[some] * len(own) + which[some] - k * GRAMS, minlength=len(texts) * len(own))
            out += counts.reshape(len(texts), -1).astype(np.float32) @ gram_vectors(own, base)
    return out


def dense_unique(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    there = np.zeros(size, bool)
    there[x] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there), place[x]


def slabs(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of TEXTS texts at most, of about CHARS characters, each with its first position."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if (held + len(t) > CHARS or k - first == TEXTS) and k > first:
            yield first, texts[first:k]
            first, held = k, 0
        held += len(t)
    if first < len(texts):
        yield first, texts[first:]


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their vectors, of length 1, from all rows of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, some in slabs(text):
                x = bundles(some)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                own = lang[first : first + len(some)]
                for y in set(own):
                    sums[y] = sums.get(y, 0) + x[[z == y for z in own]].sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])
        give_back()

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = known.mapInArrow(run, "lang string, vector array<double>").select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    # One row for each language and dimension: its size doesn't depend on the number of documents.
    rows = sums.collect()
    names = sorted({r["lang"] for r in rows})
    out = np.zeros((len(names), SIZE))
    place = {x: k for k, x in enumerate(names)}
    for r in rows:
        out[place[r["lang"]], r["k"]] = r["x"]
    return names, (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def predict(docs: DataFrame, names: list[str], vectors: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score. Only the text is read for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            best, score = np.zeros(len(texts), np.int64), np.full(len(texts), -1.0)
            for first, some in slabs(texts):
                x = bundles(some)
                cosine = (x @ vectors.T) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                there = np.array([any(map(str.isalpha, t)) for t in some])
                if len(names):
                    best[first : first + len(some)] = cosine.argmax(axis=1)
                    score[first : first + len(some)] = np.where(there, np.clip(cosine.max(axis=1), 0, 1), -1)
            pred = [names[b] if s >= 0 else "und" for b, s in zip(best, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.maximum(score, 0.0))], ["doc_id", "lang_pred", "score"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(docs: DataFrame) -> DataFrame:
    """Learn from two folds of three, predict all rows."""
    names, vectors = prototypes(docs.where(crc_fold(F.col("doc_id")) != 1))
    found = predict(docs, names, vectors)
    return found.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
