"""SimHash, suffixes, components and the pipeline against plain versions."""

import hashlib
import random
import tempfile

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from vetta.llm import simhash, suffixes
from vetta.llm.components import components

DOC = "doc_id long, text string"


def plain_components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rand = random.Random(seed)
    pairs = [(rand.randint(0, 80), rand.randint(0, 80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 230)]
    found = components(spark.createDataFrame(pairs, "u long, v long"))
    assert {r["u"]: r["v"] for r in found.collect()} == plain_components(pairs)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rand = random.Random(0)
    masks = [m % (1 << 64) for m in simhash.masks()]
    assert len(masks) == 31
    for _ in range(3000):
        differ = sum(1 << b for b in rand.sample(range(64), rand.randint(0, 4)))
        assert any(not m & differ for m in masks)


def plain_simhash(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    parts = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    rand = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = [rand.choice(words) for _ in range(rand.randint(150, 400))]
        for _ in range(rand.randint(1, 5)):
            copy = list(base)
            copy[rand.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    texts += ["", None, " \n", "Ab c", "aB  c", "x" * 5000, texts[0], texts[0].upper()]
    rows = [(5 * k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as fp", "2 as component_id", "3 as node")
    found = simhash.digest(simhash.near_duplicates(df)).collect()
    prints = [plain_simhash(t or "") for _, t in rows]
    links = [(a, b) for a in set(prints) for b in set(prints) if a < b and (a ^ b).bit_count() <= 4]
    root = plain_components(links)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            r = root.get(p, p)
            least[r] = min(least.get(r, doc), doc)
    wanted = sorted((doc is None, doc or 0, f"{p:016x}", least[root.get(p, p)]) for (doc, _), p in zip(rows, prints))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in found) == wanted
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_signed_bits_count():
    a, b = np.array([-1, 0], np.int64), np.array([0, -(1 << 63)], np.int64)
    assert simhash.distance(a, b).tolist() == [64, 1]


def test_a_bucket_s_forest_connects_what_all_pairs_do():
    rand = random.Random(2)
    for _ in range(40):
        own = list({sum(1 << b for b in rand.sample(range(12), rand.randint(0, 6))) for _ in range(rand.randint(2, 60))})
        links = [(i, j) for i in range(len(own)) for j in range(i) if (own[i] ^ own[j]).bit_count() <= 2]
        made = simhash.forest(np.array(own, np.int64), 2)
        assert plain_components(made) == plain_components(links) and len(made) < len(own)


def test_one_of_each(spark):
    rand = random.Random(6)
    words = [f"w{k}" for k in range(2000)]
    base = [[rand.choice(words) for _ in range(200)] for _ in range(15)]
    rows, near = [], set()
    for k, b in enumerate(base):
        rows.append((k, " ".join(b)))
        copy = list(b)
        copy[rand.randrange(200)] = "edit"
        rows.append((100 + k, " ".join(copy)))
        near.add(100 + k)
        rows.append((200 + k, " ".join(b)))
        near.add(200 + k)
        half = b[:100] + [rand.choice(words) for _ in range(100)]
        rows.append((300 + k, " ".join(half)))
    rows += [(0, rows[0][1]), (None, "alone"), (None, "alone"), (900, None), (901, "")]
    # Near copies without a doc_id, and under one that other texts have.
    for k in range(5):
        rows += [(None, rows[4 * k][1].replace(" ", " new ", 1)), (300, rows[4 * k][1].replace(" ", " other ", 1))]
    rows += [(None, " ".join(words[:80])), (None, " ".join(["first", *words[:80]]))]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "'x' as lang", "1 as node", "'y' as md5")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert ids == sorted([-1, -1, 900, *(k for k in range(15)), *(300 + k for k in range(15))])
    assert simhash.one_of_each(df.limit(0)).count() == 0


def plain_alike(a, b):
    x, y = (set(zip(*(t.split()[k:] for k in range(5)))) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def test_edited_copies_whose_original_comes_last(spark, monkeypatch):
    monkeypatch.setattr(simhash, "keys_of_nodes", lambda nodes: nodes.selectExpr("0L as key", "node"))
    # Two edited copies are rarely alike; the original is alike with most of them and has the largest doc_id.
    rand = random.Random(11)
    base = [f"w{rand.randrange(3000)}" for _ in range(300)]
    rows = []
    for k in range(300):
        copy = list(base)
        for at in rand.sample(range(300), 6):
            copy[at] = f"new{k}x{at}"
        rows.append((k, " ".join(copy)))
    rows += [(1000, " ".join(base))] + [(400 + k, " ".join(f"w{rand.randrange(3000)}" for _ in range(50))) for k in range(40)]
    links = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if plain_alike(s, t)]
    gone = plain_components(links)
    assert sum(b == 1000 for _, b in links) > 250
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(k for k, _ in rows if k not in gone)


def test_later_rounds_hold_each_text_of_a_large_group_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARE", 50)
    written, rounds = simhash.materialize, []

    def counted(df, name):
        out = written(df, name)
        rounds.extend([out.select("node").collect()] if name == "several" else [])
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    rand = random.Random(17)
    base = [f"w{rand.randrange(3000)}" for _ in range(300)]
    rows = []
    for k in range(200):
        copy = list(base)
        for at in rand.sample(range(300), rand.randint(4, 7)):
            copy[at] = f"new{k}x{at}"
        rows.append((k, " ".join(copy)))
    rows.append((1000, " ".join(base)))
    gone = plain_components([(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[i + 1 :] if plain_alike(s, t)])
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(k for k, _ in rows if k not in gone) and 1 < len(kept) < 150
    assert rounds and all(len(x) == len(set(x)) <= len(rows) for x in rounds)


def changed(rand, words, kind, fresh):
    n, word = len(words), lambda: f"new{rand.randrange(10**9)}" if fresh else f"w{rand.randrange(2000)}"
    at = rand.randrange(n)
    if kind == "added":
        return words[:at] + [word() for _ in range(n // 5 - 8)] + words[at:]
    if kind == "removed":
        return words[: at * 4 // 5] + words[at * 4 // 5 + n // 5 - 8 :]
    return [word() if rand.random() < 0.015 else w for w in words]


def test_copies_with_added_removed_and_scattered_words(spark):
    rand = random.Random(12)
    rows = []
    for n in (300, 1500):
        for kind in ("added", "removed", "scattered"):
            for k in range(16):
                base = [f"w{rand.randrange(2000)}" for _ in range(n)]
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed(rand, base, kind, k % 2)))]
    gone = {b for (_, s), (b, t) in zip(rows[::2], rows[1::2]) if plain_alike(s, t)}
    assert len(gone) > 80
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r["doc_id"] for r in kept) == [k for k, _ in rows if k not in gone]


def test_copies_of_long_texts(spark):
    rand = random.Random(14)
    rows = []
    for kind in ("added", "removed", "scattered"):
        for k in range(6):
            base = [f"w{rand.randrange(4000)}" for _ in range(2600 + 900 * k)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(changed(rand, base, kind, k % 2)))]
    gone = {b for (_, s), (b, t) in zip(rows[::2], rows[1::2]) if plain_alike(s, t)}
    assert len(gone) > 15 and all(len(t.split()) > simhash.FINE for _, t in rows)
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r["doc_id"] for r in kept) == [k for k, _ in rows if k not in gone]


@pytest.mark.parametrize("common", [0, 1 << 15])
def test_links_that_no_fingerprint_finds(spark, monkeypatch, common):
    """No texts meet by fingerprints; those that are alike are linked all the same, short, long and among texts with a passage in common."""
    monkeypatch.setattr(simhash, "keys_of_nodes", lambda nodes: nodes.where("node < 0").selectExpr("0L as key", "node", "fp1", "fp2"))
    monkeypatch.setattr(simhash, "COMMON", common)
    rand = random.Random(19)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for n in (1, 6, 12, 90, 300, 2600):
        for kind in ("added", "removed", "scattered"):
            for k in range(4):
                base = passage[: 60 * (k % 2)] + [f"w{rand.randrange(2000)}" for _ in range(n)]
                copy = changed(rand, base, kind, k > 1) if n > 20 else base[:-1] if kind == "removed" else [*base, "new"]
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    rows += [(len(rows), ""), (None, rows[100][1].upper())]
    sets = [set(simhash.shingles(t.encode(), 5)) for _, t in rows]
    links = [(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 5 * len(x & y) >= 4 * len(x | y)]
    gone = plain_components(links)
    assert len(gone) > 50
    kept = simhash.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept) == sorted((d is None, d or 0, t) for k, (d, t) in enumerate(rows) if k not in gone)


def plain_margins(text):
    """Ones less zeros at each bit of the fingerprints of a text's different shingles."""
    h = simhash.mixed(simhash.hashes(simhash.shingles(text.encode(), 5)), 5).tolist()
    out = np.zeros((simhash.PRINTS, 64), int)
    for k, seed in enumerate(simhash.SEEDS.tolist()):
        for x in h:
            x = x * seed % (1 << 64)
            x = (x ^ x >> 32) * 0x94D049BB133111EB % (1 << 64)
            x ^= x >> 29
            out[k] += [1 if x >> b & 1 else -1 for b in range(64)]
    return out


def test_near_copies_meet_by_fingerprints(spark):
    rand = random.Random(15)
    rows, alike = [], set()
    for k in range(60):
        base = [f"w{rand.randrange(3000)}" for _ in range(rand.choice([8, 20, 90, 280]))]
        copy = changed(rand, base, "scattered", True) if len(base) > 20 else base[: len(base) - 1 - (len(base) > 8)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        if base != copy and plain_alike(rows[-2][1], rows[-1][1]):
            alike.add((2 * k, 2 * k + 1))
    rows += [(1000, "a b c"), (1001, " \n"), (1002, " ".join(f"w{k}" for k in range(700)))]
    prints = {r["doc_id"]: r for r in simhash.sketches(spark.createDataFrame(rows, DOC)).collect()}
    for doc, text in (*rows[:8], *rows[-3:]):
        m = plain_margins(text)
        fps = [sum(1 << b for b in range(64) if x[b] > 0) for x in m]
        assert [prints[doc]["fp1"] % (1 << 64), prints[doc]["fp2"] % (1 << 64)] == fps[:2]
        assert prints[doc]["sketch"] == b"".join(x.to_bytes(8, "little") for x in fps[: simhash.SKETCH])
        best = [2 * int(np.abs(x).argmax()) + int(x[np.abs(x).argmax()] > 0) for x in m]
        assert prints[doc]["keys"] == [128 * a + b for a, b in zip(best, best[1:] + best[:1])]
    nodes = spark.createDataFrame([(doc, r["keys"], r["fp1"], r["fp2"]) for doc, r in prints.items()], "node long, keys array<smallint>, fp1 long, fp2 long")
    met = {}
    for r in simhash.meetings(simhash.keys_of_nodes(nodes)).collect():
        met.setdefault(r["bucket"], set()).add(r["node"])
    assert len(alike) > 30 and all(any(set(p) <= x for x in met.values()) for p in alike)
    # Texts with nothing in common share keys by chance and differ in too many bits.
    assert all(len({n // 2 for n in x}) == 1 for x in met.values())


@pytest.mark.parametrize("short", [0, 1000])
def test_rows_of_a_bucket_are_grouped_by_links(monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT", short)
    rand = random.Random(16)
    bits = lambda n: sum(1 << b for b in rand.sample(range(128), n))
    runs = []
    for size in (1, 2, 70, 5):
        base = [bits(64) for _ in range(4)]
        runs.append([rand.choice(base) ^ bits(rand.randint(0, 24)) for _ in range(size)])
    flat = [x for r in runs for x in r]
    fp1, fp2 = (np.array([x >> s & (1 << 64) - 1 for x in flat], np.uint64).view(np.int64) for s in (0, 64))
    ends = np.cumsum([len(r) for r in runs])
    starts = np.append(0, ends[:-1])
    links = [(a, b) for s, e in zip(starts.tolist(), ends.tolist()) for a in range(s, e) for b in range(a + 1, e) if (flat[a] ^ flat[b]).bit_count() <= simhash.WITHIN]
    root = plain_components(links)
    assert simhash.groups_within(fp1, fp2, starts, ends).tolist() == [root.get(k, k) for k in range(len(flat))] and len(links) > 50


def plain_removal(rows):
    first = {}
    for doc, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], doc)
    big = 1 << 62
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if (big if first[b[k : k + 50]] is None else first[b[k : k + 50]]) < (big if doc is None else doc):
                gone[k : k + 50] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((doc is None, doc or 0, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_repeats(spark, seed):
    rand = random.Random(seed)
    alphabet = ["ab", "abcdefghij é", "a"][seed]
    passages = ["".join(rand.choice(alphabet) for _ in range(rand.randint(45, 140))) for _ in range(6)]
    rows = []
    for k in range(40):
        parts = [rand.choice(passages) if rand.random() < 0.6 else "".join(rand.choice("klmnopq") for _ in range(rand.randint(0, 90))) for _ in range(rand.randint(0, 5))]
        rows.append((rand.randint(0, 30) if k % 5 else None, "".join(parts)))
    rows += [(31, None), (32, ""), (33, "z" * 49), (34, "z" * 50), (35, "z" * 51), (36, "ab" * 700), (37, "ab" * 700), rows[0]]
    df = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as block", "'k' as keys")
    found = suffixes.remove_repeats(df, ["keys"]).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == plain_removal(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and r["keys"] == "k" for r in found)
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def in_tables(tables, n, last=1 << 40):
    """The three passes over (block, rows) given, with Spark's dealing done here: rows of plain_removal, and the pieces that each group gets."""

    def dealt(found, column):
        whole = pa.concat_tables(found)
        return [(x, whole.filter(pa.array([y == x for y in whole.column(column).to_pylist()]))) for x in sorted(set(whole.column(column).to_pylist()))]

    blocks = [(pa.scalar(b), pa.table({"_id": pa.array([d for d, _ in rows], pa.int64()), "_data": pa.array([(t or "").encode() for _, t in rows], pa.binary()), "_block": pa.array([b] * len(rows), pa.int64())})) for b, rows in tables]
    asked = dealt([suffixes.ask(n)((b,), t) for b, t in blocks], "g")
    chosen = dealt([suffixes.choose(last)((pa.scalar(g),), t) for g, t in asked], "block")
    wanted = dict(chosen)
    pieces = dealt([suffixes.send(n)((b,), t, wanted.get(b.as_py(), suffixes.batch([], suffixes.WANTED))) for b, t in blocks], "g")
    told = [suffixes.answer((pa.scalar(g),), t) for g, t in pieces]
    empty = {f.name: pa.nulls(1, f.type) for f in suffixes.TOLD}
    told += [pa.table(empty | {"block": w.column("block"), "gone": w.column("gone"), "hot": w.column("hot")}, schema=suffixes.TOLD) for _, t in chosen for w in (t.slice(k, 1) for k in range(t.num_rows))]
    answers = dict(dealt(told, "block")) if told else {}
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    found = [r for b, t in blocks for r in suffixes.cut_out(schema)((b,), t, answers.get(b.as_py(), suffixes.batch([], suffixes.TOLD))).to_pylist()]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *list(r.values())[1:]) for r in found), [sum(len(x) // suffixes.KEY for x in t.column("keys").to_pylist()) for _, t in pieces]


def test_slabs_and_large_keys(monkeypatch):
    monkeypatch.setattr(suffixes, "SLAB", 100)
    monkeypatch.setattr(suffixes, "COLLECTION", 3)
    rand = random.Random(9)
    line = "".join(rand.choice("abcdefgh ") for _ in range(70))
    texts = [("".join(rand.choice("ij") for _ in range(9)) + line + "".join(rand.choice("kl") for _ in range(9))) * 3 for _ in range(12)]
    assert in_tables([(0, list(enumerate(texts)))], 1)[0] == plain_removal(list(enumerate(texts)))


def test_a_key_with_many_pieces_is_dealt_to_many_groups(monkeypatch):
    monkeypatch.setattr(suffixes, "COLLECTION", 40)
    rand = random.Random(10)
    line = "".join(rand.choice("abcdefgh ") for _ in range(45))
    rows = [(k, "".join(rand.choice("ij") for _ in range(3 if k % 4 else 40)) + line + "".join(rand.choice("kl") for _ in range(3 if k % 3 else 40))) for k in range(300)]
    found, most = in_tables([(b, rows[100 * b : 100 * b + 100]) for b in range(3)], 16)
    assert len(most) == 16 and max(most) < sum(most) / 4
    assert found == plain_removal(rows)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_in_order_of_doc_id(monkeypatch, seed):
    monkeypatch.setattr(suffixes, "COLLECTION", [5, 1000][seed % 2])
    rand = random.Random(seed)
    passages = ["".join(rand.choice("abcdefgh") for _ in range(rand.randint(45, 200))) for _ in range(5)]
    ids = sorted(rand.randrange(60) for _ in range(60))
    rows = [(k, "".join(rand.choice(passages) if rand.random() < 0.5 else "".join(rand.choice("klm") for _ in range(rand.randint(0, 60))) for _ in range(rand.randint(0, 5)))) for k in ids]
    # Rows without doc_id are in blocks of their own, all equally late.
    late = [(None, rand.choice(rows)[1] + rand.choice(passages)) for _ in range(9)]
    tables = [(b, [r for r in rows if r[0] // 20 == b]) for b in range(3)] + [(3, late[:4]), (4, late[4:])]
    assert in_tables(tables, 3, last=3)[0] == plain_removal(rows + late)


def test_blocks_are_ranges(spark):
    rand = random.Random(5)
    ids = sorted({rand.choice([rand.randrange(100), rand.randrange(10**15), -rand.randrange(10**6)]) for _ in range(400)})
    df = spark.createDataFrame([(k, "x" * rand.randrange(2000)) for k in ids] + [(None, "a"), (None, None)], DOC)
    for ranges in (20_000, 1, 3):
        dealt, last, hot, blocks, total = suffixes.blocks_by_id(df, ranges=ranges)
        found = [(r["doc_id"], r["_block"]) for r in dealt(df).collect()]
        assert total == df.selectExpr("sum(octet_length(text))").first()[0]
        assert all(last <= b < blocks for k, b in found if k is None)
        known = sorted((k, b) for k, b in found if k is not None)
        assert all(0 <= a <= b < last for (_, a), (_, b) in zip(known, known[1:])) and len({b for _, b in known}) > 1
    assert suffixes.blocks_by_id(df.where("doc_id is null"))[0](df.where("doc_id is null")).count() == 2


@pytest.mark.parametrize("ranges", [20_000, 3])
def test_a_hot_doc_id_has_several_equally_late_blocks(spark, monkeypatch, ranges):
    rand = random.Random(13)
    passages = ["".join(rand.choice("abcdefgh") for _ in range(rand.randint(50, 120))) for _ in range(30)]
    text = lambda: "".join(rand.choice(passages) if rand.random() < 0.5 else "".join(rand.choice("klmno") for _ in range(60)) for _ in range(4))
    rows = [(7 if k % 2 else rand.choice([rand.randrange(7), rand.randrange(8, 40)]), text()) for k in range(400)] + [(None, text()) for _ in range(9)]
    df = spark.createDataFrame(rows, DOC)
    by_id = suffixes.blocks_by_id
    monkeypatch.setattr(suffixes, "blocks_by_id", lambda docs: by_id(docs, ranges=ranges))
    dealt, last, hot, blocks, _ = suffixes.blocks_by_id(df)
    found = [(r["doc_id"], r["_block"]) for r in dealt(df).collect()]
    assert len({b for k, b in found if k == 7}) > 1 and {b for k, b in found if k == 7} == {b for k, b in found if last <= b < hot[-1][0]}
    assert all(hot[-1][0] <= b < blocks for k, b in found if k is None)
    late = suffixes.lateness(np.array([b for _, b in found]), last, hot).tolist()
    order = sorted((k is None, k or 0, x) for (k, _), x in zip(found, late))
    assert [x for *_, x in order] == sorted(late) and len({x for _, k, x in order if k == 7}) == 1
    got = suffixes.remove_repeats(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain_removal(rows)


def test_carried_columns(spark):
    passage = "".join(random.Random(1).choice("abcdefgh") for _ in range(80))
    df = spark.createDataFrame([(1, "é" + passage), (2, "ü" + passage + "z"), (3, None)], DOC).selectExpr("*", "7 as n_bytes", "'b' as _block", "cast(null as string) as kept")
    found = suffixes.remove_repeats(df, ["n_bytes", "_block", "kept", "text"], "kept_text string")
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "carried_n_bytes", "_block", "kept", "text"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[2]["kept_text"] == "üz" and rows[1]["kept_text"] == "é" + passage and rows[3]["kept_text"] == ""
    assert all(r["carried_n_bytes"] == 7 and r["_block"] == "b" for r in rows.values()) and rows[3]["text"] is None


def test_characters_cut_in_the_middle_go(spark):
    # The repeated bytes begin in the middle of a character: its other bytes can't stand alone.
    tail = "".join(random.Random(2).choice("abcdefgh") for _ in range(60))
    rows = {r["doc_id"]: r for r in suffixes.remove_repeats(spark.createDataFrame([(1, "é" + tail), (2, "x\u00a9" + tail)], DOC), [], "kept_text string").collect()}
    assert rows[2]["n_removed"] == 61 and rows[2]["kept_text"] == "x"


def test_transform_of_a_collection():
    rand = random.Random(3)
    for _ in range(15):
        strings = [bytes(rand.choice(b"ab") for _ in range(rand.randint(50, 70))) for _ in range(rand.randint(1, 20))]
        with tempfile.TemporaryDirectory() as folder:
            bwt, lcp = suffixes.build(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]), folder)
        ranked = sorted((s[k:], i, k) for i, s in enumerate(strings) for k in range(len(s) + 1))
        order = {(i, k): n for n, (_, i, k) in enumerate(ranked)}
        assert bwt.tolist() == [255 if k == 0 else strings[i][k - 1] for _, i, k in ranked]
        assert len(order) == len(bwt)
        for n in range(1, len(ranked)):
            a, b = ranked[n - 1][0], ranked[n][0]
            same = next((x for x, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            assert lcp[n] == min(same, 50)


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    found = rows.collect()
    assert found and all(0 < r["length"] <= 2048 for r in found)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert sorted(out.columns) == sorted(docs.columns)
