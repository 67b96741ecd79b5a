"""Byte-pair encoding with exact merges in linear time, and decoding by an offset table.

The encoder works on one pre-token at a time. An Aho-Corasick pass over the
pre-token yields the longest vocabulary entry that starts at each position; the
encoder then walks forward with those, accepts an entry only if it may stand
beside its left neighbour under the merge order (pair_fits), falls back to
the entry's next shorter prefix, and steps back one entry when none is left. A
bit per position keeps it from trying a dead end twice, so the walk is linear.

Texts: null counts as empty. Any length, any characters. Both special-token
strings are taken as their ids, as the tokenizers library does. An empty text
has no ids and decodes to "". Repeated rows and ids are encoded each by itself;
columns other than the text are passed through or ignored.
"""

from __future__ import annotations

import functools
import gc
import json
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from vetta.llm.common import give_back

WORD_BPE = "word_bpe_49k.json"
# Words that a task keeps, twice at most, about 250 bytes each, and forgets at its end: a worker stays far below the memory of an executor.
CACHE_WORDS = 150_000
# The library makes an object for each token, so longer words are left to WordBpe.
LONG_WORD = 10_000


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the others follow from U+0100."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary file of kind BPE with word ends. Symbols are bytes; the last of a word is shifted by 256."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        symbol = {c: chr(b) for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            if token.endswith(end) and len(token) > len(end):
                body = [symbol[c] for c in token[: -len(end)]]
                return "".join(body[:-1]) + chr(ord(body[-1]) + 256)
            return "".join(symbol[c] for c in token)

        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.names = [""] * size
        self.length = [0] * size
        spelled: dict[str, int] = {}
        for token, i in vocab.items():
            self.names[i] = token
            spelled[s := symbols(token)] = i
            self.length[i] = len(s)
        for token, i in self.specials.items():
            self.names[i] = token
        # Each entry's two halves, and the rank at which a pair merges; a base symbol is its own half.
        self.halves = [(i, i) for i in range(size)]
        self.pairs: dict[tuple[int, int], int] = {}
        rank_of = [0] * size
        for rank, (a, b) in enumerate(model["merges"], 1):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if (left, right) not in self.pairs:
                self.pairs[left, right] = whole
                if self.halves[whole] == (whole, whole):
                    self.halves[whole] = (left, right)
                    rank_of[whole] = rank
        self.rank = rank_of
        self.known: dict[int, int] = {}
        # Entries that merging their own symbols doesn't give can't appear in an encoding.
        usable = {s: i for s, i in spelled.items() if len(s) == 1 or self.pair_fits(*self.halves[i], whole=i)}
        self.spelled = usable
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for s, i in usable.items():
            self.automaton.add_word(s, i)
            self.shorter[i] = next((usable[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in usable), -1)
        self.automaton.make_automaton()
        self.offsets, self.blob = self.offset_table()

    def pair_fits(self, left: int, right: int, whole: int = -1) -> bool:
        """Whether left and right can stand side by side: no merge across their border comes before the merges inside them.

        Undoes the merges beside the border from the latest to the earliest. At
        each step, a merge across it that ranks before the one undone last
        would have come first. whole: the pair's own merge is allowed.
        """
        a, b, rank, halves, limit = left, right, self.rank, self.halves, len(self.rank) + 1
        while True:
            both = self.pairs.get((a, b))
            if both is not None and both != whole and rank[both] < limit:
                return False
            # A merge on the left side is done before one of the same rank on the right side.
            if rank[a] > rank[b]:
                limit, a = rank[a], halves[a][1]
            elif rank[b]:
                limit, b = rank[b] + 1, halves[b][0]
            else:
                return True

    def fitting(self, left: int, i: int) -> int:
        """The longest of entry i and its shorter prefixes that can stand after left (-1: nothing does), or -1; kept in the table of pairs."""
        if i < 0 or left < 0:
            return i
        got = self.known.get(left << 20 | i)
        if got is None:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            got = self.known[left << 20 | i] = i if self.pair_fits(left, i) else self.fitting(left, self.shorter[i])
        return got

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of one pre-token, given as symbols."""
        known, length, longest = self.known, self.length, self.automaton.iter_long
        ids: list[int] = []
        at, last, n = 0, -1, len(word)
        closed: set[int] = set()  # positions from which no way leads on
        while at < n:
            # As long as the longest entries one after another fit, the walk takes them.
            for _, i in longest(word, at):
                if last < 0:
                    j = i
                elif (j := known.get(last << 20 | i)) is None:
                    j = self.fitting(last, i)
                if j != i or closed and at + length[i] in closed:
                    break
                ids.append(i)
                at += length[i]
                last = i
            else:
                return ids
            while True:
                while j >= 0 and at + length[j] in closed:
                    j = self.fitting(last, self.shorter[j])
                if j >= 0:
                    break
                closed.add(at)
                last = ids.pop()
                at -= length[last]
                j, last = self.shorter[last], ids[-1] if ids else -1
                j = self.fitting(last, j)
            ids.append(j)
            at += length[j]
            last = j
        return ids

    def encode_word(self, word: str) -> list[int]:
        b = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        return self.encode_symbols(b[:-1] + chr(ord(b[-1]) + 256))

    def offset_table(self) -> tuple[array, str]:
        """All entries' texts in one string, and where each begins."""
        offsets = array("q", [0])
        for name in self.names:
            offsets.append(offsets[-1] + len(name))
        return offsets, "".join(self.names)

    def decode(self, ids) -> str:
        """The entries' texts, joined by a space: the file names no decoder."""
        o, blob = self.offsets, self.blob
        return " ".join([blob[o[i] : o[i + 1]] for i in ids])


class WordModel:
    """The tokenizers library's own model of the file: the ids of WordBpe, read four times as fast and sooner done with a new word."""

    def __init__(self, path: str):
        whole = Tokenizer.from_file(path)
        self.path, self.model = path, whole.model
        self.specials = {token.content: i for i, token in whole.get_added_tokens_decoder().items()}
        self.letters = dict(enumerate(byte_letters()))

    def encode_word(self, word: str) -> list[int]:
        if len(word) > LONG_WORD:
            return word_bpe(self.path).encode_word(word)
        b = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        return [token.id for token in self.model.tokenize(b.translate(self.letters))]


# The vocabulary's own pre-token pattern; and the same for Latin-1 texts, with the engine that is faster for these.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN, DIGIT = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
LATIN_WORD = re.compile(f"[{LATIN}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGIT}]|[^\\s{LATIN}{DIGIT}]+")
# Beyond Latin-1 (and for spaces of str.split() that the pattern doesn't take for such), the library normalises and splits: its Unicode tables count.
ODD = re.compile("[\x1c-\x1f]")
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
SPLIT = pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True)


class Kept(dict):
    """make(key) of each key asked for. When CACHE_WORDS are kept they become the old ones, of which those asked for again stay."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(key) < 100:
            self[key] = got
        return got


class Encoder:
    """Encodes texts word by word and keeps what it has seen. make(ids) gives what is kept for a word."""

    def __init__(self, path: str, make, bpe: WordBpe | WordModel | None = None):
        self.bpe, self.make = bpe or word_bpe(path), make
        self.kept = Kept(lambda w: make(self.bpe.encode_word(w)))
        self.word = self.kept.__getitem__
        self.special = re.compile("(" + "|".join(map(re.escape, self.bpe.specials)) + ")")

    def words(self, text: str) -> list:
        """make(ids) of each word of a text, in order."""
        if "<|" in text:
            out = []
            for k, piece in enumerate(self.special.split(text)):
                out += [self.make([self.bpe.specials[piece]])] if k % 2 else self.plain(piece)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list:
        if (text.isascii() or latin(text)) and not ODD.search(text):
            return list(map(self.word, LATIN_WORD.findall(text.lower())))
        return [self.word(w) for w, _ in SPLIT.pre_tokenize_str(NORMAL.normalize_str(text))]

    def forget(self) -> None:
        self.kept.clear()
        self.kept.old = {}


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(4)
def bytes_encoder(path: str) -> Encoder:
    """Words as their ids in little-endian 32-bit."""
    return Encoder(path, lambda ids: array("I", ids).tobytes())


@functools.lru_cache(4)
def library_encoder(path: str) -> Encoder:
    """bytes_encoder() by the library's model."""
    return Encoder(path, lambda ids: array("I", ids).tobytes(), WordModel(path))


@functools.lru_cache(4)
def text_encoder(path: str) -> Encoder:
    """Words as (number of ids, decimal ids, decoded text)."""
    bpe = word_bpe(path)
    return Encoder(path, lambda ids: (len(ids), " ".join(map(str, ids)), bpe.decode(ids)))


def let_go() -> None:
    """Drop the vocabularies' tables, some 40 MB and what the pairs add: a worker goes on to other stages, and a task reads them again in less than a second."""
    for kept in (word_bpe, bytes_encoder, library_encoder, text_encoder):
        kept.cache_clear()
    gc.collect()  # an encoder and the words it keeps hold each other


def encode_column(df, text: str = "text", path: str | None = None, out: str = "ids"):
    """df with the ids of a text column as array<int>, in a new last column."""
    from pyspark.sql import functions as F

    path = path or tokenizer_path()

    @F.pandas_udf("array<int>")
    def ids(texts):
        import numpy as np

        enc = bytes_encoder(path)
        out = texts.map(lambda t: np.frombuffer(b"".join(enc.words(t or "")), np.uint32).astype(np.int32))
        enc.forget()
        return out

    return df.withColumn(out, ids(F.col(text)))


def decode_column(df, ids: str = "ids", path: str | None = None, out: str = "decoded"):
    """df with the decoded text of a column of ids, in a new last column."""
    from pyspark.sql import functions as F

    path = path or tokenizer_path()

    @F.pandas_udf("string")
    def text(column):
        bpe = word_bpe(path)
        return column.map(lambda x: bpe.decode([] if x is None else x))

    return df.withColumn(out, text(F.col(ids)))


def digests(df, path: str | None = None):
    """Per row: doc_id, n_tokens, SHA-256 of the ids as text and of the text decoded from them."""
    import hashlib

    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(path)
        for batch in batches:
            n, ids, text = [], [], []
            for t in batch.column(1):
                got = [x for x in enc.words(t.as_py() or "") if x[0]]
                n.append(sum([x[0] for x in got]))
                ids.append(hashlib.sha256(" ".join([x[1] for x in got]).encode()).hexdigest())
                text.append(hashlib.sha256(" ".join([x[2] for x in got]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.forget()
        give_back()

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
