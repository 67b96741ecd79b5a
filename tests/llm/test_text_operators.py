"""Tokens, packing, fingerprints, languages, quality, personal data, media and archives against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from vetta.llm import bpe, language, lzprint, media, packing, pii, quality, warc

DOC = "doc_id long, text string"
ODD = [(1, "The cat's 3 cats, don't! " * 3), (2, None), (3, ""), (4, "x" * 3000), (5, "Ünïcödé ΑΣ ﬁ 中文 <|endoftext|> \x1c\x85 a"), (5, "again"), (None, "no id"), (7, "a " * 9000), (8, " \n\t"), (9, "The cat's 3 cats, don't! " * 3)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOC)
    return df.withColumn("ids", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("block", F.lit(2)).withColumn("length", F.lit("y")).withColumn("media", F.lit(0))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def test_encoding_is_the_library_s(odd, none, library):
    found = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(odd).collect())
    wanted = []
    for _, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == sorted(wanted)
    assert bpe.digests(none).count() == 0


def test_encoding_of_random_texts(library):
    rand = random.Random(2)
    enc = bpe.bytes_encoder(bpe.tokenizer_path())
    for alphabet in ("ab", "aeinrst'!", "abcdé ß'<|>%.12\n", "".join(map(chr, range(32, 1000)))):
        for _ in range(300):
            t = "".join(rand.choice(alphabet) for _ in range(rand.randint(0, 80)))
            assert np.frombuffer(b"".join(enc.words(t)), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing_encodes_by_the_library_s_model(spark, library, monkeypatch):
    rand = random.Random(3)
    enc = bpe.library_encoder(bpe.tokenizer_path())
    texts = ["<|endoftext|>x <|", "ünïcode 日本語 \U0001f600\x1c\u2003e\u0301", "a" * 130]
    for alphabet in ("aeinrst'!", "abcdé ß'<|>%.12\n", "".join(map(chr, range(32, 1000)))):
        texts += ["".join(rand.choice(alphabet) for _ in range(rand.randint(0, 80))) for _ in range(100)]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for long in (bpe.LONG_WORD, 3):
        monkeypatch.setattr(bpe, "LONG_WORD", long)
        enc.forget()
        assert [np.frombuffer(b"".join(enc.words(t)), np.uint32).tolist() for t in texts] == wanted
    monkeypatch.undo()
    # A task doesn't build the tables of the encoder that walks.
    runs, cls = [], type(spark.range(1))
    monkeypatch.setattr(cls, "mapInArrow", lambda df, run, schema: runs.append(run))
    packing.pieces(spark.createDataFrame([(1, "a")], DOC))
    bpe.let_go()
    monkeypatch.setattr(bpe, "WordBpe", None)
    (rows,) = runs[0](iter([pa.record_batch({"doc_id": [1], "text": ["some words"]})]))
    assert rows.column("length").to_pylist() == [len(library.encode("some words").ids) + 1]


def test_columns_round_trip(spark, library):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], DOC)
    rows = bpe.decode_column(bpe.encode_column(df)).orderBy("doc_id").collect()
    assert rows[0]["ids"] == library.encode("hello world", add_special_tokens=False).ids and rows[0]["decoded"] == "hello</w> world</w>" and rows[1]["ids"] == []


def test_packing(odd, none, library):
    rows = packing.pack_documents(odd, 64).collect()
    places = {}
    for r in rows:
        assert 0 < r["length"] <= 64
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    wanted = []
    for doc, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        wanted += [(doc is None, doc or 0, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(wanted)
    assert packing.pack_documents(none, 64).count() == 0


def piecewise(lengths, capacity):
    """Best two fit, one sequence after another."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        if gap:
            short = own[-1]
            pairs = [(a + b, a) for i, a in enumerate(left) for b in left[i + 1 :] if short < a + b <= gap + short]
            if pairs:
                total, a = max(pairs)
                own = own[:-1] + [a, total - a]
                left.remove(a)
                left.remove(total - a)
                left.append(short)
                left.sort(reverse=True)
        out.append(sorted(own, reverse=True))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_the_plan_is_the_rule_piece_by_piece(seed):
    rand = random.Random(seed)
    lengths = [rand.randint(1, 40) for _ in range(rand.randint(1, 120))]
    counts = {x: lengths.count(x) for x in set(lengths)}
    made = [sorted((x for x, n in used.items() for _ in range(n)), reverse=True) for used, times in packing.plan(counts, 40) for _ in range(times)]
    assert sorted(x for own in made for x in own) == sorted(lengths)
    assert all(sum(own) <= 40 for own in made)
    assert len(made) == len(piecewise(lengths, 40))


def test_phrases(odd, none):
    def plain(data):
        seen, start, out = set(), 0, []
        for end in range(1, len(data) + 1):
            if data[start:end] not in seen:
                seen.add(data[start:end])
                out.append(data[start:end])
                start = end
        return out

    rand = random.Random(1)
    for _ in range(50):
        data = bytes(rand.choice(b"ab") for _ in range(rand.randint(0, 300)))
        phrases, _ = lzprint.parse(data)
        spelled = {}
        for number, key in enumerate(phrases, 1):
            spelled[number] = spelled.get(key >> 8, b"") + bytes([key & 255])
        assert list(spelled.values()) == plain(data)
        assert len(set(lzprint.phrase_hashes(phrases).tolist())) == len(phrases)
    rows = lzprint.edited(odd).collect()
    order = sorted(ODD, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    own = {}
    for k, (doc, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        a, b, c = (lzprint.fingerprint(x) for x in (t, new, other))
        own.setdefault(doc, []).append((len(t), hashlib.sha256(new.encode()).hexdigest(), lzprint.spelled(a), lzprint.spelled(b), lzprint.likeness(a, b), lzprint.likeness(a, c)))
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in own.items()}
    assert lzprint.edited(none).count() == 0


def test_languages(spark, none):
    rand = random.Random(0)
    words = {"en": "the of and with for this that".split(), "fr": "le la des une pour avec être".split()}
    rows = [(k, " ".join(rand.choice(words[x]) for _ in range(20)), x, "s") for k in range(120) for x in [rand.choice(["en", "fr"])]]
    rows += [(500, None, "en", "s"), (501, "12 %", "fr", "s"), (502, "", None, "s"), (None, "the of and", None, "s"), (503, "le " * 5000, "fr", "s")]
    df = spark.createDataFrame(rows, DOC + ", lang string, source string")
    found = {r["doc_id"]: r for r in language.held_out(df).collect()}
    held = [k for k in range(120) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(found[k]["held_out"] == (k in held) for k in range(120))
    assert all(found[k]["lang_pred"] == rows[k][2] for k in held)
    assert {found[k]["lang_pred"] for k in (500, 501, 502)} == {"und"} and found[None]["lang_pred"] == "en" and found[503]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language.predict(none, ["en"], np.ones((1, language.SIZE), np.float32)).count() == 0
    assert language.prototypes(spark.createDataFrame([], DOC + ", lang string"))[0] == []
    assert language.predict(df.select("doc_id", "text"), [], np.zeros((0, language.SIZE))).where("lang_pred <> 'und'").count() == 0


def test_quality(spark, none):
    rand = random.Random(0)
    rows = [(k, " ".join(rand.choice("alpha beta gamma delta".split()) for _ in range(30)) + (" !!" * 8 if k % 2 else "")) for k in range(200)] + [(900, None), (901, ""), (None, "alpha beta"), (902, "alpha " * 20000)]
    df = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(200)] + [(3, None, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.held_out(df, labels).collect()}
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(found[k]["predicted"] == 1 - k % 2 for k in range(200) if found[k]["held_out"])
    # Rows that share a doc_id are learned from once, by the least text.
    again = spark.createDataFrame([(k, f"z{n} !!") for k in (2, 3, 900) for n in range(40)], DOC)
    assert np.array_equal(quality.fit(df, labels), quality.fit(df.union(again), labels))
    weights = quality.fit(df, labels.limit(0))
    assert {r["score"] for r in quality.score(df, weights).collect()} == {0.5}
    assert quality.score(none, weights).count() == 0


def test_word_hashes_don_t_depend_on_place():
    for t in (b"ab cd", b"  ab\ncd ", b"ab   cd"):
        assert sorted(quality.features([t])[0].tolist()) == sorted(quality.features([b"zz", t])[0][-3:].tolist())
    assert quality.features([b"", b" ", b"a"])[1].tolist() == [0, 0, 1]


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def plain_bundle(text):
    """One n-gram after another, each letter's vector shifted by its place from the n-gram's end."""
    letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
    while "\0\0" in letters:
        letters = letters.replace("\0\0", "\0")
    out = np.zeros(language.SIZE)
    for k in range(len(letters) - 2):
        v = np.ones(language.SIZE)
        for place, c in enumerate(reversed(letters[k : k + 3])):
            v *= np.roll(language.letter_vector(ord(c)), place)
        out += v
    return out


@pytest.mark.parametrize("limits", [(1 << 19, 2048), (7, 3)])
def test_bundles_and_prototypes_by_hand(spark, monkeypatch, limits):
    monkeypatch.setattr(language, "CHARS", limits[0])
    monkeypatch.setattr(language, "GRAMS", limits[1])
    texts = ["", "ab", "abc", " a--b  c ", "Straße über 12 Wege", "\u4e2d\u6587\u5b57\u7b26 a", "x" * 40, "-- --", "one\0two"]
    assert np.abs(language.bundles(texts) - np.array([plain_bundle(t) for t in texts])).max() < 1e-3
    rows = [(k, t, "pq"[k % 2]) for k, t in enumerate(texts)] + [(50, "abcd", None), (51, None, "p")]
    names, vectors = language.prototypes(spark.createDataFrame(rows, DOC + ", lang string"))
    assert names == ["p", "q"]
    for name, v in zip(names, vectors):
        made = sum(x / (np.linalg.norm(x) or 1) for _, t, lang in rows if lang == name and t is not None for x in [plain_bundle(t)])
        assert np.abs(v - made / np.linalg.norm(made)).max() < 1e-3
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows, DOC + ", lang string"), names, vectors).collect()}
    for k, t, _ in rows:
        if t and any(map(str.isalpha, t)) and len(t) > 2:
            x = plain_bundle(t)
            cosine = vectors @ x / (np.linalg.norm(x) or 1)
            assert found[k]["lang_pred"] == names[int(cosine.argmax())] and abs(found[k]["score"] - max(0, cosine.max())) < 1e-3
        elif not t or not any(map(str.isalpha, t)):
            assert found[k]["lang_pred"] == "und" and found[k]["score"] == 0


def plain_features(text):
    """Hashes of words and of neighbouring pairs, byte by byte."""
    m = (1 << 64) - 1
    words, last = [], 0
    for c in text:
        kind = int(quality.KIND[c])
        if kind and kind == last:
            words[-1].append(c)
        elif kind:
            words.append([c])
        last = kind
    base, mix = int(quality.BASE), int(quality.MIX)
    h = []
    for w in words:
        x = sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) & m
        h.append((x ^ x >> 32) * mix & m)
    pairs = [mix if a == b else ((a * base & m) ^ b >> 7) * mix & m for a, b in zip(h, h[1:])]
    return [x >> 64 - quality.BITS for x in h + pairs]


def test_training_and_scores_by_hand():
    rand = random.Random(3)
    texts = [" ".join(rand.choice(["good", "fine,", "bad", "spam!!", "a1", "é"]) for _ in range(rand.randint(0, 12))).encode() for _ in range(60)]
    labels = [int(b"good" in t) for t in texts]
    for t in texts:
        assert sorted(quality.features([t])[0].tolist()) == sorted(plain_features(t))
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0)) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    def values(t):
        f = plain_features(t)
        return {i: f.count(i) * quality.SCALE / max(1, len(f)) for i in f} | {1 << quality.BITS: 1.0}

    for _ in range(quality.EPOCHS):
        for t, y in zip(texts, labels):
            x = values(t)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                step = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0) + g - step * w[i]
                n[i] = n.get(i, 0) + g * g
    made = quality.train([quality.sparse(t) for t in texts], labels)
    assert max(abs(made[i] - weight(i)) for i in z) < 1e-3 and np.count_nonzero(made) <= len(z)
    plain = [1 / (1 + np.exp(-sum(made[i] * v for i, v in values(t).items()))) for t in texts]
    assert np.abs(quality.scores(texts, made) - plain).max() < 1e-6


def test_good_keeps_all_columns(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, quality int")
    rows = [(k, ("clear prose here " if k % 2 else "junk !! ## ") * 5) for k in range(200)] + [(None, None), (900, ""), (901, "clear prose here " * 20_000)]
    docs = spark.createDataFrame(rows, DOC).selectExpr("doc_id", "'x' as score", "text", "map('a', 1) as m", "1.5 as doc_score")
    weights = quality.fit(docs, labels)
    kept = quality.good(docs, weights)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert {901, *range(1, 200, 2)} <= set(ids) and not set(range(0, 200, 2)) & set(ids)
    assert set(ids) == {k for k, s in scores.items() if s >= 0.5}
    assert quality.good(docs.limit(0), weights).count() == 0


def test_base_spans():
    rand = random.Random(5)
    for alphabet in ("ab1.9@+-%() \n_4", "0123456789 -", "0123456789.+", "a@."):
        for _ in range(3000):
            t = "".join(rand.choice(alphabet) for _ in range(rand.randint(0, 60)))
            assert pii.base_spans(t) == plain_spans(t), t


def test_contexts_discover_identifiers(spark, none):
    from pyspark.sql import functions as F

    rand = random.Random(1)
    rows = [(k, f"please call {rand.randint(200, 999)}-{rand.randint(1000, 9999)} today" if k % 4 == 0 else f"please call +1 ({rand.randint(200, 999)}) 555-{rand.randint(1000, 9999)} today") for k in range(80)]
    rows += [(100 + k, f"there are {k} apples") for k in range(30)] + [(300, None), (None, "x"), (300, ""), (301, "a" * 50_000 + "@"), (302, "é m@x.org é"), (302, "é m@x.org é")]
    df = spark.createDataFrame(rows, DOC).withColumn("spans", F.lit(1)).withColumn("more", F.lit(2)).withColumn("kind", F.lit(3))
    found = pii.personal_data(df).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[0]["spans"] == "phone:12:20" and by[0]["n_phone"] == 0 and by[1]["spans"].startswith("phone:12:") and by[1]["n_phone"] == 1
    assert all(by[100 + k]["spans"] == "" for k in range(30)) and by[302]["spans"] == "email:2:9"
    hidden = pii.mask(df)
    assert hidden.columns == df.columns and hidden.count() == len(rows)
    assert hidden.where("doc_id = 0").first()["text"] == "please call <phone> today"
    assert pii.personal_data(none).count() == 0


def test_media(odd, none):
    from pyspark.sql import functions as F

    found = sorted(media.media_features(odd).collect(), key=lambda r: (r["payload_sha256"], r["doc_id"] or 0))
    wanted = []
    for doc, t in ODD:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        wanted.append((hashlib.sha256(p).hexdigest(), doc or 0, len(b), len(p), zlib.crc32(p[-64:])))
    assert [(r["payload_sha256"], r["doc_id"] or 0, r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) for r in found] == sorted(wanted)
    same = [r for r in found if r["doc_id"] in (1, 9)]
    assert same[0]["feature"] == same[1]["feature"] and same[0]["pair_code"] == same[1]["pair_code"]
    assert media.media_features(none).count() == 0
    assert media.features(media.encode(odd).withColumn("media", F.lit(None).cast("binary"))).where("payload_bytes is not null").count() == 0


def test_a_tone_has_its_peak():
    tone = (128 + 100 * np.sin(2 * np.pi * 32 / 256 * np.arange(4096))).astype(np.uint8)
    times, codes = media.peak_pairs(tone)
    band1 = codes[(codes >> 20 == 1) & (codes >> 16 & 15 == 1)]
    assert len(times) and set((band1 >> 8 & 255).tolist()) == {32}


def test_archives(spark):
    big, same = "é" * 700, "b" * 1200
    rows = [(1, "http://a/ü b\r\nX: 1", big), (2, "u", same), (3, None, same), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", same), (9, "u", "c\r\n\r\n" * 300), (10, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(warc.revisits(df).coalesce(1), 2000)
    normal = warc.normalise(archives)
    assert archives.count() > 1 and warc.sidecar(normal).count() == len(rows)
    for r in normal.collect():
        assert sum(x["length"] for x in r["index"]) == len(r["content"])
    read = warc.read_records(normal, payload=True).collect()
    told = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in read)
    wanted = []
    for page, _, html in rows:
        b = (html or "").encode()
        again = html == same and page != 3
        wanted.append((str(page), len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", "3" if again else "None"))
    assert told == sorted(wanted)
    assert {r["page_id"]: r["payload"] for r in read}[1] == big.encode()
    assert warc.read_records(warc.normalise(warc.write_archives(warc.revisits(df.limit(0))))).count() == 0


def test_broken_archives_are_told():
    with pytest.raises(ValueError):
        list(warc.inflate(warc.deflate(b"abc" * 1000)[:-9]))
    with pytest.raises(ValueError):
        list(warc.records(iter([warc.record(1, "u", b"x", None)[:-3]])))


def plain_learn(rows, support, confidence):
    """Rounds of scoring over sets, until a round names nothing."""
    edges = {(p, i) for i, _, p in rows}
    known = {(i, k): 1.0 for i, k, _ in rows if k}
    while True:
        found = {}
        for p in {p for p, _ in edges}:
            own = {i for q, i in edges if q == p}
            named = sum((i, k) in known for i in own for k in pii.KINDS)
            for k in pii.KINDS:
                score, n = sum(known.get((i, k), 0) for i in own), sum((i, k) in known for i in own)
                share = score / (named + 0.5 * max(len(own) - named, 0)) if named else 0
                if n >= support and share >= confidence:
                    found[p, k] = share
        more = {}
        for i in {i for _, i in edges}:
            for k in pii.KINDS:
                if not ("@" in i if k == "email" else sum(map(str.isdigit, i)) >= 6):
                    continue
                doubt = np.prod([1 - min(found[p, k], 0.999) for p, j in edges if j == i and (p, k) in found])
                if 1 - doubt >= confidence and (i, k) not in known:
                    more[i, k] = 1 - doubt
        if not more:
            return found
        known |= more


@pytest.mark.parametrize("seed", range(2))
def test_learning_by_hand(spark, seed):
    rand = random.Random(seed)
    rows = []
    for k in range(160):
        kind = rand.choice(["phone", "email", None, None])
        name = f"u{k}@x" if kind == "email" else f"{rand.randrange(10**7, 10**8)}"
        liked = {"phone": ["left tel", "left call"], "email": ["in mail:"], None: ["left tel", "left call", "left the", "gap a"]}[kind]
        rows += [(name, kind, rand.choice([*liked, "gap " + rand.choice("abc")])) for _ in range(rand.randint(1, 3))]
    # A chain: what one pattern names makes the next one sure.
    rows += [(f"5550{k:05d}", "phone" if k < 40 else None, f"left chain{k // 30}") for k in range(90)] + [(f"5550{k:05d}", None, f"left chain{k // 30 + 1}") for k in range(60)]
    found = {(r["pattern"], r["kind"]): r["confidence"] for r in pii.learn(spark.createDataFrame(rows, "instance string, kind string, pattern string"), support=5, confidence=0.6).collect()}
    wanted = plain_learn(rows, 5, 0.6)
    assert set(found) == set(wanted) and all(abs(found[x] - wanted[x]) < 1e-9 for x in wanted) and len(wanted) > 2


def test_masking_an_empty_table_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "write to a.b@c.org or 10.0.0.1"), (2, "x" * 300_000 + " +1 (234) 567-8901")], DOC).selectExpr("'z' as more", "doc_id", "text", "1 as start")
    hidden = pii.mask(df)
    assert hidden.columns == df.columns
    assert sorted((r["text"] or "")[-20:] for r in hidden.collect()) == ["", "", "e to <email> or <ip>", "x" * 12 + " <phone>"]
    assert pii.mask(df.limit(0)).count() == 0 and pii.mask(df.limit(0)).columns == df.columns


def test_signatures_from_plain_sets_of_phrases():
    rand = random.Random(4)
    for _ in range(30):
        data = bytes(rand.choice(b"abc") for _ in range(rand.randint(1, 900)))
        phrases, now = set(), b""
        for c in data:
            now += bytes([c])
            if now not in phrases:
                phrases.add(now)
                now = b""
        m = (1 << 64) - 1
        hashed = []
        for p in phrases:
            h = sum((c + 1) * pow(lzprint.BASE, len(p) - 1 - k, 1 << 64) for k, c in enumerate(p)) & m
            h = (h ^ h >> 31) * lzprint.STEP & m
            h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & m
            hashed.append(h ^ h >> 32)
        least = {}
        for h in hashed:
            least[h >> 58] = min(least.get(h >> 58, m), h & (1 << 58) - 1)
        made = []
        for k in range(lzprint.SLOTS):
            away = next(d for d in range(lzprint.SLOTS) if (k + d) % lzprint.SLOTS in least)
            made.append(((least[(k + away) % lzprint.SLOTS] + away * lzprint.STEP) * lzprint.STEP & m) >> 48)
        assert lzprint.fingerprint(data.decode()).tolist() == made


def test_peak_pairs_by_hand():
    rand = np.random.default_rng(5)
    for n in (64, 700, 5000):
        samples = rand.integers(0, 256, n, dtype=np.uint8)
        x = samples.astype(float) - 128
        x = np.pad(x, (0, max(0, 256 - len(x))))
        loud = np.array([np.abs(np.fft.rfft(x[a : a + 256] * np.hanning(256))) for a in range(0, len(x) - 255, 128)])
        peaks = []
        for a in range(0, len(loud), 4):
            top = loud[a : a + 4].max(axis=0)
            peaks.append([lo + int(top[lo:hi].argmax()) for lo, hi in zip(media.BANDS, media.BANDS[1:])])
        pairs = [(t, band << 20 | p[band] << 8 | p[band + 1]) for t, p in enumerate(peaks) for band in range(2)]
        pairs += [(t, band << 20 | ahead << 16 | peaks[t][band] << 8 | peaks[t + ahead][band]) for t in range(len(peaks)) for ahead in (1, 2) if t + ahead < len(peaks) for band in range(3)]
        times, codes = media.peak_pairs(samples)
        assert sorted(pairs) == list(zip(times.tolist(), codes.tolist()))
