"""Shared lines, drawn documents and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vetta.llm import lexical, lines, resample

DOC = "doc_id long, text string"
LICENSE = "Permission is hereby granted, Ünïcode too"
ODD = [
    (1, f"{LICENSE}\nown line of document one\n\n  {LICENSE.upper().replace('Ü', 'Ü')}\t"),
    (2, f"a\n{LICENSE}\n"),
    (3, f"\x0b{LICENSE}\r\nshared by two, so it must stay here\x00"),
    (3, f"again\n{LICENSE}"),
    (4, "shared by two, so it must stay here\x00\n\n\n"),
    (5, None),
    (6, ""),
    (None, f"no id\n{LICENSE}"),
    (None, f"{LICENSE}\nno id either"),
    (7, "\n".join(f"{LICENSE} {k % 50}" for k in range(4000))),
    (8, "\n".join(f"{LICENSE} {k % 50}" for k in range(100))),
    (9, "\n".join(f"{LICENSE} {k}" for k in range(60)) + "\n " + LICENSE),
    (10, "nineteen characters"),
    (11, "nineteen characters"),
    (12, "nineteen characters"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, ties, and columns with clashing names."""
    df = spark.createDataFrame(ODD, DOC)
    for name in ("row", "key", "keys", "gone", "at", "n", "last", "rank", "score", "shard", "bucket", "part"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def plain_lines(rows, least=20, documents=3):
    low = str.maketrans(lines.UPPER, lines.UPPER.lower())
    order = lambda i: float("-inf") if i is None else i
    key = lambda x: x.strip(lines.BLANKS).translate(low)
    holders = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            holders[key(x)].add(order(i))
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if len(key(x)) < least or len(holders[key(x)]) < documents or order(i) == max(holders[key(x)])]
        yield str(i), len(every), len(every) - len(kept), "\n".join(kept)


def found_lines(df, **options):
    return sorted((str(r[0]), r[1], r[2], r[3]) for r in lines.drop_shared_lines(df, **options).collect())


def test_shared_lines(odd, none):
    found = found_lines(odd)
    assert found == sorted(plain_lines(ODD)) and sum(r[2] for r in found) > 4000
    assert found_lines(none) == []


def test_shared_lines_beyond_the_broadcast(odd, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 2)
    assert found_lines(odd) == sorted(plain_lines(ODD))


def test_least_and_documents(odd):
    assert found_lines(odd, least=1, documents=2) == sorted(plain_lines(ODD, 1, 2))


def test_all_lines_go(spark):
    df = spark.createDataFrame([(k, f"{LICENSE}\n{LICENSE}") for k in range(4)], DOC)
    assert [(r["n_dropped"], r["kept_text"]) for r in lines.drop_shared_lines(df).orderBy("doc_id").collect()] == [(2, "")] * 3 + [(0, f"{LICENSE}\n{LICENSE}")]
    assert hashlib.sha256(b"").hexdigest() == lines.drop_shared_lines(df).where("doc_id = 0").select(F.sha2("kept_text", 256)).first()[0]


LOW = str.maketrans(lines.UPPER, lines.UPPER.lower())
WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
ITEM = "item_id long, text string"
ITEMS = [(1, f"{LICENSE} document one"), (2, None), (3, ""), (4, "a id no"), (4, "either again"), (None, "own line"), (5, "absent words alone"), (6, LICENSE * 300), (7, "a")]


def plain_words(text):
    return re.findall(WORD, (text or "").translate(LOW))


def test_words_are_those_of_the_expression():
    rand = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rand.choice([rand.randrange(128), rand.randrange(0x800), rand.randrange(0x10000, 0x11000)])) for _ in range(rand.randrange(60)))
        assert resample.words(text) == [w.encode() for w in plain_words(text)]
    assert resample.words("[A]@Z`{z}/0:9") == [b"a", b"z", b"z", b"0", b"9"]


def plain_draw(docs, target, percent, least_words):
    def features(text):
        w = plain_words(text)
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    rows = [(i, *features(text)) for i, text in docs]
    s, t = Counter(b for _, _, x in rows for b in x), Counter(b for _, text in target for b in features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for i, n, x in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], float("inf") if r[0] is None else r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[5] = k + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("percent,least_words", [(5, 20), (50, 1), (100, 3)])
def test_draw(spark, odd, percent, least_words):
    found = resample.resample(odd, spark.createDataFrame(ITEMS, ITEM), percent, least_words)
    assert sorted(str(list(r)) for r in found.collect()) == plain_draw(ODD, ITEMS, percent, least_words)


def test_draw_of_many_ranges(spark):
    rand = random.Random(3)
    docs = [(k, " ".join(rand.choice("abcdefgh") for _ in range(rand.randrange(40)))) for k in range(600)]
    found = resample.resample(spark.createDataFrame(docs, DOC).repartition(7), spark.createDataFrame([(1, "a b c a b")], ITEM), 30)
    assert sorted(str(list(r)) for r in found.collect()) == plain_draw(docs, [(1, "a b c a b")], 30, 20)


def test_draw_of_empty_tables(spark, odd, none):
    empty = spark.createDataFrame([], ITEM)
    assert resample.resample(none, spark.createDataFrame(ITEMS, ITEM)).count() == 0 and resample.resample(none, empty).count() == 0
    assert sorted(str(list(r)) for r in resample.resample(odd, empty, 50, 1).collect()) == plain_draw(ODD, [], 50, 1)


def plain_search(docs, items, k):
    rows = [(i, Counter(plain_words(text))) for i, text in docs]
    n, length = sum(bool(c) for _, c in rows), sum(c.total() for _, c in rows)
    df = Counter(w for _, c in rows for w in c)
    wanted = defaultdict(set)
    for i, text in items:
        wanted[i] |= set(plain_words(text))
    for item, terms in wanted.items():
        scores = []
        for i, c in rows:
            m = 50 + 50 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 20 * m)) for w in terms if c[w])
            if score > 0:
                scores.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scores)[:k]):
            yield str((item, rank + 1, i, -score))


def found_hits(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("k,shard_mb", [(50, 8), (3, 0.0001)])
def test_search(spark, odd, k, shard_mb):
    items = spark.createDataFrame(ITEMS, ITEM)
    for name in ("term", "terms", "weights", "floor", "task", "tree", "ask", "doc_id"):
        items = items.withColumn(name, F.lit("x"))
    assert found_hits(lexical.search(odd, items, k, shard_mb)) == sorted(plain_search(ODD, ITEMS, k))


def test_search_of_many_shards_and_ties(spark):
    rand = random.Random(4)
    vocabulary = ["".join(rand.choice("abc") for _ in range(n)) for n in (1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5, 5, 5, 6, 6)]
    docs = [(k, " ".join(rand.choice(vocabulary) for _ in range(rand.randrange(1, 30)))) for k in range(400)] + [(k, "same words in each of these") for k in range(400, 500)]
    items = [(k, " ".join(rand.choice(vocabulary) for _ in range(rand.randrange(1, 12)))) for k in range(30)] + [(99, "same words")]
    found = lexical.search(spark.createDataFrame(docs, DOC).repartition(5), spark.createDataFrame(items, ITEM), 10, 0.0005)
    assert found_hits(found) == sorted(plain_search(docs, items, 10))


def test_search_of_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, ITEM)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(odd, spark.createDataFrame([], ITEM)).count() == 0
    assert lexical.search(spark.createDataFrame([(1, None), (2, " \n")], DOC), items).count() == 0


@pytest.mark.parametrize("entries", [8, 1 << 20])
def test_walks_find_what_a_scan_finds(monkeypatch, entries):
    """Trees of many shapes; with 8 entries a state, walks are split all the way."""
    monkeypatch.setattr(lexical, "ENTRIES", entries)
    monkeypatch.setattr(lexical, "BEAM", 2)
    rand = np.random.default_rng(5)
    for rows, columns, points in [(1, 1, 1), (1, 9, 5), (70, 3, 60), (40, 300, 2000), (500, 64, 900)]:
        cells = rand.choice(rows * columns, points, replace=False)
        value = rand.integers(1, 50, points)
        grid = np.zeros((rows, columns), np.int64)
        grid[cells // columns, cells % columns] = value
        tree = lexical.Tree(**lexical.grow(cells // columns, cells % columns, value))
        row = rand.integers(0, rows, 40)
        item, weight = np.sort(rand.integers(0, 4, 40)), rand.integers(1, 1 << 40, 40)
        floor = np.ones(4, np.int64)
        at, column, score = lexical.Walk(tree, item, row, weight, floor, 5).best()
        for n in range(4):
            scores = (grid[row[item == n]] * weight[item == n, None]).sum(0)
            wanted = sorted(((-s, c) for c, s in enumerate(scores.tolist()) if s), key=lambda x: x)[:5]
            assert sorted(zip((-score[at == n]).tolist(), column[at == n].tolist()))[:5] == wanted
