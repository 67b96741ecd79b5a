"""The pipeline's stages, one after the other, against plain versions of all of them."""

import hashlib
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_duplicates import plain_alike, plain_components
from test_text_operators import plain_features, plain_spans
from tokenizers import Tokenizer

import corpus_pipeline
from vetta.llm import bpe, common, packing, pii, quality, suffixes

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def made_rows():
    """Good and bad prose, exact and near copies in chains, shared passages, personal data, nulls, empty and long texts, repeats."""
    rand = random.Random(12)
    words = ["".join(rand.choice("abcdefghijklmnop") for _ in range(rand.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rand.choice(words) for _ in range(n))
    passage = prose(40)
    texts = [f"{prose(60)} clear prose here. {prose(60)}" for _ in range(40)]
    rows = [[k, t] for k, t in enumerate(texts)]
    rows += [[100 + k, f"junk !! ## {k} " * 30] for k in range(40)]
    for k in range(6):  # a chain of copies, each near to the one before it
        edited = texts[k].split()
        for step in range(3):
            edited[10 + 30 * step] = f"edit{step}"
            rows.append([200 + 10 * k + step, " ".join(edited)])
    rows += [[300 + k, f"{prose(50)} clear prose here. {passage} {prose(20)}"] for k in range(6)]
    rows += [[400, f"{prose(30)} clear prose here. write to some.one@mail.example or 10.1.2.3, call +1 (234) 567-8901 or pay 4111 1111 1111 1111. {prose(30)}"]]
    rows += [[500, f"{prose(9000)} clear prose here."], [501, None], [502, ""], [503, texts[9]], [None, texts[10]], [None, f"{prose(80)} clear prose here."], [504, texts[3]]]
    rows += [list(rows[5]), list(rows[-2])]
    # Near copies without a doc_id, and under one that another text has.
    rows += [[None, f"Addendum {texts[11]}"], [12, f"{texts[13]} Addendum"], [13, f"{prose(70)} clear prose here."]]
    return [(i, t, None if k % 9 == 0 else "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


def plain_good(text, weights):
    f = plain_features((text or "").encode())
    total = weights[1 << quality.BITS] + sum(weights[i] * f.count(i) * quality.SCALE / max(1, len(f)) for i in set(f))
    return 1 / (1 + np.exp(-total)) >= 0.5


def plain_one_of_each(rows):
    """Of exact copies and of components of near ones the least doc_id stays, none only where none has one."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(t or "", (i, t))
    named = sorted(first.values(), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    known = [(k, t) for k, (_, t) in enumerate(named) if (t or "").split()[4:]]
    gone = plain_components([(a, b) for n, (a, s) in enumerate(known) for b, t in known[n + 1 :] if plain_alike(s, t)])
    return [r for k, r in enumerate(named) if k not in gone]


def plain_cut(rows):
    """Bytes of strings of 50 bytes that also begin in an earlier document go; these texts are ASCII."""
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        for k in range(len(t or "") - 49):
            first.setdefault(t[k : k + 50], key(i))
    for i, t in rows:
        gone = [False] * len(t or "")
        for k in range(len(gone) - 49):
            if first[t[k : k + 50]] < key(i):
                gone[k : k + 50] = [True] * 50
        yield i, "".join(c for c, g in zip(t or "", gone) if not g)


def plain_masked(text):
    out, at = "", 0
    for a, kind, b in plain_spans(text):
        if a >= at:
            out += text[at:a] + f"<{pii.KINDS[kind]}>"
        at = max(at, b)
    return out + text[at:]


def told(rows):
    return sorted((str(i), t or "") for i, t in rows)


def test_stages_are_the_plain_ones(spark, tmp_path):
    rows = made_rows()
    folder = f"file://{tmp_path}/sf"
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i, *_ in rows if i is not None and i < 140], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    learned = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    weights = quality.fit(docs, spark.createDataFrame(learned, labels.schema))
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    def step(name, path):
        out = stages[name](spark, docs, folder)
        assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(f"{folder}/{path}")
        return spark.read.parquet(f"{folder}/{path}")

    plain = [(i, t) for i, t, *_ in rows if plain_good(t, weights)]
    docs = step("quality classifier", "one")
    assert told(pairs(docs)) == told(plain)
    assert {k for k in range(40)} <= {i for i, _ in plain} and not {100 + k for k in range(40)} & {i for i, _ in plain}
    plain = plain_one_of_each(plain)
    docs = step("SimHash near-dedup", "two")
    assert told(pairs(docs)) == told(plain) and not any(i in (200, 212, 503, 504) for i, _ in plain)
    plain = list(plain_cut(plain))
    docs = step("suffix-array dedup", "three")
    assert told(pairs(docs)) == told(plain) and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    plain = [(i, plain_masked(t)) for i, t in plain]
    docs = step("PII", "four")
    assert told(pairs(docs)) == told(plain) and "<email> or <ip>, call <phone> or pay <card>." in dict(plain)[400]
    found = stages["best-fit packing"](spark, docs, folder).collect()
    library = Tokenizer.from_file(bpe.tokenizer_path())
    wanted = []
    for i, t in plain:
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        wanted += [(str(i), k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(wanted)
    filled = {}
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in whole if r["doc_id"] is not None) == sorted(tuple(r)[:5] for r in found if r["doc_id"] is not None) and len(whole) == len(found)


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_empty_tables(spark, tmp_path, empty):
    """Without documents nothing comes out; without labels all texts score 0.5 and stay."""
    rows = [] if empty == "documents" else made_rows()[:3]
    spark.createDataFrame(rows, DOC).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()} == {i for i, *_ in rows}


def test_columns_of_the_stages_own_names(spark):
    """Stages before the last give all columns of documents, also where a table has more, named as the stages name theirs."""
    df = spark.createDataFrame([r for r in made_rows() if r[0] is not None][:12], DOC).selectExpr("*", "1 as node", "'x' as key", "2 as start", "'y' as _vetta", "3 as score")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert set(DOC.replace(" long", "").replace(" string", "").split(", ")) <= set(stage(spark, df, "").columns), name


def test_tasks_give_back_what_they_took(spark, tmp_path, monkeypatch):
    """Each mapInArrow task of the stages ends with give_back()."""
    runs, calls, cls = [], [], type(spark.range(1))
    plain = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda df, run, schema, *more: runs.append(run) or plain(df, run, schema, *more))
    docs = spark.createDataFrame(made_rows(), DOC)
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path))
    assert len(runs) >= 8
    for module in (common, suffixes):
        monkeypatch.setattr(module, "give_back", lambda: calls.append(1))
    for k, run in enumerate(runs, 1):
        list(run(iter([])))
        assert len(calls) == k


def test_give_back_comes_after_a_task_s_variables(monkeypatch):
    held, gone = [], []

    def run(batches):
        big = np.zeros(9)
        held.append(weakref.ref(big))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: gone.append(held[0]() is None))
    assert list(common.giving_back(run)(iter([1, 2]))) == [1, 2] and gone == [True]


def test_blocks_are_gone_when_suffix_tasks_give_back(monkeypatch):
    blocks, gone = [], []

    class Watched(suffixes.Block):
        def __init__(self, table):
            super().__init__(table)
            blocks.append(weakref.ref(self))

    monkeypatch.setattr(suffixes, "Block", Watched)
    monkeypatch.setattr(suffixes, "give_back", lambda: gone.append(all(x() is None for x in blocks)))
    passage = " ".join(f"word{k}" for k in range(40))
    tables = [pa.table({"_id": [k], "_data": [f"{passage} {k} {passage[k + 3:]}".encode()], "_block": [k]}) for k in range(2)]
    key = lambda k: (pa.scalar(k),)
    asked = pa.concat_tables([suffixes.ask(1)(key(k), t) for k, t in enumerate(tables)])
    assert gone == [True, True]
    wanted = suffixes.choose(2)(key(0), asked)
    assert wanted.num_rows and gone == [True] * 3
    for k, t in enumerate(tables):
        suffixes.send(1)(key(k), t, wanted.filter(pc.equal(wanted.column("block"), k)))
    assert gone[3:] and all(gone)


def test_tokens_leave_no_tables_in_a_worker(spark, monkeypatch):
    runs, cls = [], type(spark.range(1))
    plain = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda df, run, schema: runs.append(run) or plain(df, run, schema))
    packing.pieces(spark.createDataFrame(made_rows(), DOC))
    words = weakref.ref(bpe.word_bpe(bpe.tokenizer_path()))
    rows = list(runs[0](iter([pa.record_batch({"doc_id": [1], "text": ["some words"]})])))
    assert rows[0].num_rows == 1 and words() is None
    assert list(runs[0](iter([pa.record_batch({"doc_id": [1], "text": ["some words"]})]))) == rows
