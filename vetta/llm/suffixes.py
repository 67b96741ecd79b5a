"""Suffix-array de-duplication: bytes covered by a long string that also starts in an earlier document.

The suffix array is built column by column for many strings at once: each round
puts one more symbol in front of every string's suffix, finds the new suffixes'
places from the collection's Burrows-Wheeler transform, and merges their symbols
and common prefixes into it, from one sequential file into the next. Suffixes
next to each other that share WINDOW bytes form a class, and a class's least
doc_id decides which of its windows repeat an earlier document.

So that collections can be built side by side, windows are dealt by content.
The least hash of the GRAM-byte strings in a window is the same wherever the
window stands, so equal windows meet under equal keys. A run of windows with
one key is a piece, of at most RUN windows; its mark is a hash of all its bytes.
Blocks are ranges of doc_id, in order, so of two blocks it is known which is
earlier. Three passes over blocks of whole documents do the rest:

1. blocks tell which keys they have, and a key's mark if it has but one piece
   there. Keys that only one document has end here. A key that has the same
   piece everywhere needs no transform: every block but the earliest loses it;
2. blocks send the pieces of the other keys, equal ones once, with their least
   doc_id; collections of pieces are built and answer with their classes' least
   doc_id where that is smaller than the block's own;
3. blocks mark their bytes and cut them out.

A key with more than COLLECTION distinct pieces, such as the edges of a line
that many documents have, is dealt once more: its windows go one by one by a
hash of their whole WINDOW bytes, to any group, so no task gets all of them.

A block sends each key or piece once, however many of its documents have it, so
a passage in a third of all documents is as many rows as there are blocks. Two
pieces are taken for one if their keys (47 bits) and marks (48 bits or more) are
equal; keys that collide otherwise cost time, never a wrong answer.

Texts: null counts as empty; texts under WINDOW bytes stay as they are. Any
length: documents are read in slabs. A null doc_id is larger than all others;
such rows are dealt by their text, and so are those of a doc_id that holds the
bytes of several blocks. Rows with equal doc_id never repeat each other. Repeats within a document are left. An empty table gives no rows. Columns
asked for are carried along; one that is named like a result is returned as
carried_<name>.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections import Counter
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import give_back

WINDOW = 50
GRAM = 20
SPAN = WINDOW - GRAM + 1  # strings of GRAM bytes in a window
RUN = SPAN
SLAB = 1 << 16  # bytes hashed at once
BLOCK_MB, GROUP_MB = 8, 16  # of text: a block, and what a group of keys or pieces comes from
RANGES = 20_000  # quantiles of doc_id at most; more blocks than that are parts of equal width between two of them
COLLECTION = 1 << 13  # pieces built together; a key with more is dealt window by window
ROWS = 1 << 15  # pieces of blocks that are answered at once
COUNTED = 8  # pieces of a key in a block from which they are counted; fewer count as two
END = 255  # no byte of UTF-8
KEY = 6  # bytes of a key, and of a mark in pass 1
LAST = np.iinfo(np.int64).max
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
BASE = 0x9E3779B97F4A7C15


# --- the collection's transform ---------------------------------------------


class Columns:
    """A transform and its common prefixes in a file, read and written from start to end in place."""

    def __init__(self, path: Path):
        self.file, self.rows = open(path, "w+b", buffering=0), 0

    def write(self, *columns: np.ndarray) -> None:
        self.file.seek(0)
        self.rows = len(columns[0])
        for x in columns:
            self.file.write(x)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(0)
        out = np.empty(self.rows, np.uint8), np.empty(self.rows, np.uint8)
        for x in out:
            self.file.readinto(x)
        return out


def build(flat: np.ndarray, size: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and common prefixes (up to WINDOW) of a collection of strings, one after another in flat, by one symbol a round.

    Row r of the transform is the symbol before the r-th smallest suffix; the
    rows of the empty suffixes come first, in the strings' order, and END stands
    before a whole string. Symbols may be in any order, as long as it is one.
    """
    m, longest = len(size), int(size.max())
    # The symbols from the end, a column for each round, and END before the first.
    column = np.full((longest + 1, m), END, np.uint8)
    column[np.repeat(np.cumsum(size), size) - 1 - np.arange(len(flat)), np.repeat(np.arange(m), size)] = flat
    old, new_file = (Columns(Path(folder) / f"columns{k}") for k in (0, 1))
    old.write(column[0], np.zeros(m, np.uint8))
    at, active = np.arange(m), np.arange(m)
    for k in range(1, longest + 1):
        bwt, lcp = old.read()
        if k > 1:
            still = size[active] >= k
            active, at = active[still], at[still]
        # Rows by their symbol, in order, are the suffixes that start with it: those there are and the new ones.
        order = np.argsort(bwt, kind="stable")
        order = order[: len(bwt) - np.count_nonzero(bwt == END)]
        fresh = np.zeros(len(bwt), bool)
        fresh[at] = True
        new = np.flatnonzero(fresh[order])
        total = m + len(order)
        place = np.empty(len(bwt), np.int32)
        place[order[new]] = m + new
        stay = np.ones(total, bool)
        stay[m + new] = False
        out, prefix = np.empty(total, np.uint8), np.empty(total, np.uint8)
        out[stay], prefix[stay] = bwt, lcp
        at = place[at]
        out[at] = column[k][active]
        # A new suffix and the one after it: one more than the least prefix between the rows they come from.
        after = new[:-1] + 1
        first = np.sort(np.concatenate((new, after[after != new[1:]], new[-1:] + 1 if len(new) and new[-1] + 1 < len(order) else new[:0])))
        prefix[m + first] = 0
        first = first[first > 0]
        low, high = order[first - 1], order[first]
        same = bwt[low] == bwt[high]
        prefix[m + first[same]] = np.minimum(range_min(lcp, low[same] + 1, high[same]) + 1, WINDOW)
        new_file.write(out, prefix)
        old, new_file = new_file, old
    out = old.read()
    old.file.close()
    new_file.file.close()
    return out


def range_min(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of x[low..high] for each pair, by minima over runs of powers of two."""
    if not len(low):
        return np.zeros(0, x.dtype)
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), x.dtype)
    table = x
    for k in range(int(level.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        here = level == k
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k) + 1])
    return out


def least_ids(flat: np.ndarray, size: np.ndarray, ids: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string, string by string: the least id of the strings that have it; and where each string's begin."""
    bwt, lcp = build(flat, size, folder)
    rows = np.flatnonzero(bwt != END)
    follow = np.empty(len(bwt), np.int64)
    follow[rows[np.argsort(bwt[rows], kind="stable")]] = len(size) + np.arange(len(rows))
    number = np.cumsum(lcp < WINDOW) - 1
    windows = size - WINDOW + 1
    starts = np.concatenate(([0], np.cumsum(windows)))
    of = np.empty(starts[-1], np.int64)
    at, active = np.arange(len(size)), np.arange(len(size))
    for k in range(1, int(size.max()) + 1):
        still = size[active] >= k
        active, at = active[still], follow[at[still]]
        if k >= WINDOW:
            of[starts[active] + size[active] - k] = number[at]
    least = np.full(int(number[-1]) + 1, LAST)
    np.minimum.at(least, of, np.repeat(ids, windows))
    return least[of], starts


# --- windows and pieces of a block -------------------------------------------


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        out[k::8] = data[k : k + (n - k + 7) // 8 * 8].view(np.uint64)
    return out


def keys(data: np.ndarray) -> np.ndarray:
    """The key of the window from each position: the least hash of its strings of GRAM bytes."""
    with np.errstate(over="ignore"):
        w = words_at(data)
        n = len(w) - (GRAM - 8)
        h = w[:n] * MIX[0]
        h ^= h >> np.uint64(29)
        h += w[8 : n + 8]
        h *= MIX[1]
        h ^= h >> np.uint64(31)
        h += w[GRAM - 8 :]
        h *= MIX[2]
        h ^= h >> np.uint64(30)
        h *= MIX[0]
        h >>= np.uint64(64 - 8 * KEY + 1)  # the first bit is for keys of single windows
    span = 1
    while 2 * span <= SPAN:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = SPAN - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(SLAB + WINDOW, BASE), powers(SLAB + WINDOW, pow(BASE, -1, 1 << 64))


def marks(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[begin:end], of a slab at most."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * UP[: len(data)], out=sums[1:])
        h = (sums[end] - sums[begin]) * DOWN[begin]
        h ^= h >> np.uint64(32)
        h *= MIX[1]
        return h ^ (h >> np.uint64(29))


def window_hashes(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of single windows (rows of WINDOW bytes), with the first bit set, and their marks."""
    w = np.zeros((len(windows), -(-WINDOW // 8) * 8), np.uint8)
    w[:, :WINDOW] = windows
    key, mark = np.zeros(len(w), np.uint64), np.full(len(w), MIX[2])
    with np.errstate(over="ignore"):
        for k, column in enumerate(w.view("<u8").T):
            key = (key ^ column) * MIX[k % 3]
            key ^= key >> np.uint64(29)
            mark = (mark + column) * MIX[(k + 1) % 3]
            mark ^= mark >> np.uint64(31)
        key *= MIX[0]
        mark *= MIX[1]
    return key >> np.uint64(64 - 8 * KEY) | np.uint64(1 << 8 * KEY - 1), mark ^ (mark >> np.uint64(32))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Positions where any of the columns has another value than before; the first one is such."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def found_in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + n[0] - 1, first[1] .. and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Block:
    """The documents of one block, in order of doc_id and text, and their pieces, in order of place."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("_id").to_pylist(), [x.as_buffer() if x.is_valid else pa.py_buffer(b"") for x in table.column("_data")]
        ids = [LAST if x is None else x for x in ids]
        order = sorted(range(len(ids)), key=ids.__getitem__)
        if any(ids[a] == ids[b] for a, b in zip(order, order[1:])):
            order.sort(key=lambda k: (ids[k], texts[k].to_pybytes()))
        self.order, self.ids = order, np.array([ids[k] for k in order], np.int64)
        self.sizes = np.array([texts[k].size for k in order], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.data = np.concatenate([*(np.frombuffer(texts[k], np.uint8) for k in order), np.zeros(0, np.uint8)])
        self.runs()

    def runs(self) -> None:
        """Of each piece: key, mark, first byte in the block, windows, document."""
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        begin = 0
        while len(self.data) - begin >= WINDOW:
            part = self.data[begin : begin + SLAB + WINDOW - 1]
            key = keys(part)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            a, b = np.searchsorted(self.starts, (begin, begin + len(key)))
            new[self.starts[a:b] - begin] = True
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(key)))
            # Windows over a document's end are none; they are the last of its runs.
            doc = np.searchsorted(self.starts, begin + first, side="right") - 1
            n = np.minimum(n, np.maximum(self.starts[doc + 1] - WINDOW + 1 - begin - first, 0))
            first, n = first[n > 0], n[n > 0]
            cuts = -(-n // RUN)
            head = np.repeat(first, cuts)
            nth = np.arange(len(head)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            at, windows = head + nth * RUN, np.minimum(np.repeat(n, cuts) - nth * RUN, RUN)
            found.append((key[head], marks(part, at, at + windows + WINDOW - 1), begin + at, windows))
            begin += len(key)
        self.key, self.mark, self.first, self.windows = (np.concatenate(x) for x in zip(*found))
        self.doc = np.searchsorted(self.starts, self.first, side="right") - 1

    def distinct(self, here: np.ndarray, key: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Of the pieces or windows at `here` (in order of place), the first with each key and mark, in order of these."""
        order = np.lexsort((mark, key))
        return order[changes(key[order], mark[order])]

    def split(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of the pieces of hot keys (sorted): first byte, key and mark of each."""
        here = np.flatnonzero(found_in(hot, self.key))
        first = spread(self.first[here], self.windows[here])
        out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        out += [window_hashes(self.data[first[k : k + SLAB, None] + np.arange(WINDOW)]) for k in range(0, len(first), SLAB)]
        return first, *(np.concatenate(x) for x in zip(*out))

    def doc_of(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, first, side="right") - 1


def packed(x: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def packed_keys(x: np.ndarray) -> bytes:
    """Numbers in KEY bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def keys_in(data) -> np.ndarray:
    found = np.frombuffer(data, np.uint8).reshape(-1, KEY)
    out = np.zeros((len(found), 8), np.uint8)
    out[:, :KEY] = found
    return out.view("<u8").ravel()


def keys_of(table: pa.Table, column: str = "keys") -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(keys_in(x.as_buffer()) for x in table.column(column) if x.is_valid)])


def concatenated(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column(column) if x.is_valid)])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def schema_of(longs: str, binaries: str) -> pa.Schema:
    return pa.schema([*((x, pa.int64()) for x in longs.split()), *((x, pa.binary()) for x in binaries.split())])


KEYS = schema_of("g block", "keys marks shared which many")
WANTED = schema_of("block", "gone wanted hot")
PIECES = schema_of("g block", "keys marks sizes ids data")
TOLD = schema_of("block", "gone hot keys marks first windows ids")
DDL = {"int64": "long", "binary": "binary"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[str(f.type)]}" for f in schema)


def groups_of(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by key modulo n."""
    g = (key % np.uint64(n)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    cut = np.flatnonzero(np.diff(g[order])) + 1
    for part in np.split(order, cut) if len(g) else []:
        yield int(g[part[0]]), part


def ask(n: int):
    """Pass 1: a block's keys, each with the mark of its piece, or 0 if it has several, and whether rows of different ids have it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table)
        order = np.argsort(block.key, kind="stable")
        which, mark, ids = block.key[order], block.mark[order], block.ids[block.doc[order]]
        first = changes(which)
        last = np.append(first[1:], len(which)) - 1
        if not len(first):
            return batch([], KEYS)
        one = np.minimum.reduceat(mark, first) == np.maximum.reduceat(mark, first)
        short = np.where(one, mark[first] >> np.uint64(64 - 8 * KEY) | np.uint64(1), np.uint64(0))
        # How many distinct pieces the other keys have, where these are many.
        here = np.repeat(~one, last - first + 1)
        several, number = order[here], np.repeat(np.arange(len(first)), last - first + 1)[here]
        by = np.lexsort((block.mark[several], number))
        heads = changes(number[by], block.mark[several][by])
        count = np.bincount(number[by][heads], minlength=len(first))
        found, shared, out = which[first], ids[first] != ids[last], []
        for g, p in groups_of(found, n):
            own = np.flatnonzero(count[p] >= COUNTED)
            out.append((g, key[0].as_py(), packed_keys(found[p]), packed_keys(short[p]), np.packbits(shared[p]).tobytes(), packed(own, np.uint32), packed(count[p][own], np.uint32)))
        rows = batch(out, KEYS)
        del block, order, which, mark, ids, here, several, number, out
        give_back()
        return rows

    return run


def lateness(blocks: np.ndarray, last: int, hot: list[tuple[int, int]]) -> np.ndarray:
    """The place of blocks in the order of doc_id: blocks of one doc_id, and those of rows without one, are equally late."""
    starts, after = np.array([x for x, _ in hot] or [LAST], np.int64), np.array([x for _, x in hot] or [0], np.int64)
    k = np.searchsorted(starts, blocks, side="right") - 1
    return np.where(blocks < last, 2 * blocks, np.where(k < 0, 2 * last, np.minimum(2 * after[k] + 1, 2 * last)))


def choose(last: int, hot: list[tuple[int, int]] = []):
    """Between the passes 1 and 2: a block's keys that an earlier one has with the same single piece, those whose pieces are wanted, and those of too many pieces.

    last: blocks from this number on are for one hot doc_id (hot: the first such
    block of each, and the block that they come after) or, after these, for rows without doc_id.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks = table.column("block").to_numpy()
        counts = [len(x.as_buffer()) // KEY for x in table.column("keys")]
        ends = np.concatenate(([0], np.cumsum(counts)))
        every, short = keys_of(table), keys_of(table, "marks")
        late = np.repeat(lateness(blocks, last, hot), counts)
        shared = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(table.column("shared"), counts)]).astype(bool)
        pieces = np.where(short == 0, 2, 0)
        for a, which, many in zip(ends.tolist(), table.column("which"), table.column("many")):
            pieces[a + np.frombuffer(which.as_buffer(), np.uint32).astype(np.int64)] = np.frombuffer(many.as_buffer(), np.uint32)
        # By key, then by mark: a row for each mark of a key counts a piece.
        order = np.lexsort((late, short, every))
        k, s = every[order], short[order]
        pieces[order[changes(k, s)]] = np.maximum(pieces[order[changes(k, s)]], 1)
        first = changes(k)
        n = np.diff(np.append(first, len(k)))
        of = np.minimum.reduceat(late[order], first)
        again = (of != np.maximum.reduceat(late[order], first)) | np.logical_or.reduceat(shared[order], first)
        one = (s[first] == s[first + n - 1]) & (s[first] > 0)
        many = np.add.reduceat(pieces[order], first) > COLLECTION
        kind = np.empty(len(every), np.uint8)
        kind[order] = np.repeat(np.where(again, np.where(one, 1, np.where(many, 3, 2)), 0), n)
        least = np.empty(len(every), np.int64)
        least[order] = np.repeat(of, n)
        kind[(kind == 1) & (late == least)] = 0
        out = []
        for b, lo, hi in zip(blocks.tolist(), ends.tolist(), ends[1:].tolist()):
            parts = [packed_keys(every[lo:hi][kind[lo:hi] == x]) for x in (1, 2, 3)]
            if any(parts):
                out.append((b, *parts))
        rows = batch(out, WANTED)
        del every, short, late, shared, pieces, order, k, s, kind, least, out
        give_back()
        return rows

    return run


def send(n: int):
    """Pass 2: the pieces of wanted keys and the windows of hot ones."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return batch([], PIECES)
        wanted, hot = np.sort(keys_of(right, "wanted")), np.sort(keys_of(right, "hot"))
        if not len(wanted) and not len(hot):
            return batch([], PIECES)
        block = Block(left)
        here = np.flatnonzero(found_in(wanted, block.key))
        begin, single, mark = block.split(hot)
        out = []
        pieces = block.first[here], block.key[here], block.mark[here], block.windows[here] + WINDOW - 1
        for first, which, mark, sizes in (pieces, (begin, single, mark, np.full(len(begin), WINDOW))):
            # Pieces are in order of place, so of their document: the first to have one has the least id.
            one = block.distinct(first, which, mark)
            first, which, mark, sizes = first[one], which[one], mark[one], sizes[one]
            ids = block.ids[block.doc_of(first)]
            for g, p in groups_of(which, n):
                data = block.data[spread(first[p], sizes[p])].tobytes()
                out.append((g, key[0].as_py(), packed_keys(which[p]), packed(mark[p], np.uint64), packed(sizes[p], np.uint8), packed(ids[p], np.int64), data))
        rows = batch(out, PIECES)
        del block, pieces, begin, single, mark, first, which, sizes, ids, out
        give_back()
        return rows

    return run


def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Between the passes 2 and 3: collections are built, and each block learns of the smaller ids."""
    which, mark, ids = keys_of(table), concatenated(table, "marks", np.uint64), concatenated(table, "ids", np.int64)
    sizes, data = concatenated(table, "sizes", np.uint8).astype(np.int64), concatenated(table, "data", np.uint8)
    counts = [len(x.as_buffer()) // KEY for x in table.column("keys")]
    of = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((mark, which))
    first = changes(which[order], mark[order])
    piece = np.empty(len(which), np.int64)
    piece[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(which))))
    own = np.minimum.reduceat(ids[order], first)
    at, length, of_key = begin[order[first]], sizes[order[first]], which[order[first]]
    # Where a key's pieces begin; they stay together, and are COLLECTION at most or little more.
    heads = np.append(changes(of_key), len(of_key))
    start, parts, total, a = np.zeros(len(first), np.int64), [np.empty(0, np.int64)], 0, 0
    while a < len(first):
        b = int(heads[np.searchsorted(heads, min(a + COLLECTION, len(first)))])
        with tempfile.TemporaryDirectory() as folder:
            got, starts = least_ids(data[spread(at[a:b], length[a:b])], length[a:b], own[a:b], folder)
        start[a:b] = total + starts[:-1]
        parts.append(got)
        total += len(got)
        a = b
    least = np.concatenate(parts)
    windows = sizes - WINDOW + 1
    blocks = table.column("block").to_numpy()
    rows = []
    # A row's windows stand side by side; a change of the answer begins a new run. So many rows at a time.
    for a in range(0, len(which), ROWS):
        b = min(a + ROWS, len(which))
        row = np.repeat(np.arange(a, b), windows[a:b])
        off = np.arange(len(row)) - np.repeat(np.cumsum(windows[a:b]) - windows[a:b], windows[a:b])
        value = least[start[piece[row]] + off]
        first = changes(row, value)
        run = np.diff(np.append(first, len(row)))
        keep = value[first] < ids[row[first]]
        first, run = first[keep], run[keep]
        r = row[first]
        for p in np.split(np.arange(len(r)), np.flatnonzero(np.diff(of[r])) + 1):
            if len(p):
                rows.append((int(blocks[of[r[p[0]]]]), b"", b"", packed_keys(which[r[p]]), packed(mark[r[p]], np.uint64), packed(off[first[p]], np.uint8), packed(run[p], np.uint8), packed(value[first[p]], np.int64)))
    out = batch(rows, TOLD)
    del least, data, rows
    give_back()
    return out


def repeated(block: Block, told: pa.Table) -> np.ndarray:
    """Which bytes of a block are covered by a window that an earlier document has."""
    step = np.zeros(len(block.data) + 1, np.int32)

    def mark(first: np.ndarray, windows: np.ndarray) -> None:
        np.add.at(step, first, 1)
        np.add.at(step, first + windows + WINDOW - 1, -1)

    gone, hot = np.sort(keys_of(told, "gone")), np.sort(keys_of(told, "hot"))
    lost = found_in(gone, block.key)
    mark(block.first[lost], block.windows[lost])
    begin, single, marks_ = block.split(hot)
    # Pieces, and windows of hot keys, beside those that a row of the block with a smaller id has.
    rest = np.flatnonzero(~lost & ~found_in(hot, block.key))
    which, by = np.concatenate((block.key[rest], single)), np.concatenate((block.mark[rest], marks_))
    first, windows = np.concatenate((block.first[rest], begin)), np.concatenate((block.windows[rest], np.ones(len(begin), np.int64)))
    ids = block.ids[block.doc_of(first)]
    order = np.lexsort((first, which, by))
    heads = changes(which[order], by[order])
    least = np.repeat(ids[order[heads]], np.diff(np.append(heads, len(order))))
    late = order[ids[order] > least]
    mark(first[late], windows[late])
    # What other blocks' pieces tell of parts of a piece.
    key, code = keys_of(told), concatenated(told, "marks", np.uint64)
    by = by[order]
    a, b = np.searchsorted(by, code, side="left"), np.searchsorted(by, code, side="right")
    at, tells = order[spread(a, b - a)], np.repeat(np.arange(len(code)), b - a)
    real = (which[at] == key[tells]) & (concatenated(told, "ids", np.int64)[tells] < ids[at])
    at, tells = at[real], tells[real]
    mark(first[at] + concatenated(told, "first", np.uint8)[tells], concatenated(told, "windows", np.uint8)[tells].astype(np.int64))
    return np.cumsum(step[:-1], dtype=np.int32, out=step[:-1]) > 0


def cut_out(schema: pa.Schema):
    """Pass 3. schema: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, and the columns carried along."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        block = Block(left)
        gone = repeated(block, right)
        edge = np.ones(len(gone), bool)
        edge[1:] = gone[1:] != gone[:-1]
        edge[block.starts[:-1][block.sizes > 0]] = True
        edge &= gone
        a, b = block.starts[:-1], block.starts[1:]
        removed, spans = (np.array([np.count_nonzero(x[i:j]) for i, j in zip(a.tolist(), b.tolist())], np.int64) for x in (gone, edge))
        kept = [(block.data[x:y][~gone[x:y]] if n else block.data[x:y]).tobytes() for x, y, n in zip(a.tolist(), b.tolist(), removed.tolist())]
        rows = left.take(pa.array(block.order))
        made = {
            "doc_id": rows.column("_id").combine_chunks(), "n_bytes": block.sizes, "n_removed": removed, "n_spans": spans,
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept": kept, "kept_text": [x.decode("utf-8", "ignore") for x in kept] if "kept_text" in schema.names else None,
        }
        carried = iter(rows.columns[3:])
        out = pa.Table.from_arrays([pa.array(made[f.name], f.type) if f.name in made else next(carried).combine_chunks() for f in schema], schema=schema)
        del block, gone, kept, made
        give_back()
        return out

    return run


def blocks_by_id(docs: DataFrame, mb: int = BLOCK_MB, ranges: int = RANGES) -> tuple[Callable[[DataFrame], DataFrame], int, list[tuple[int, int]], int, int]:
    """A function that adds each row's block, the number of ranges, the hot ids' blocks (see choose), how many blocks there are, and the bytes of all texts.

    Blocks are ranges of doc_id with about mb MB of text each. Their ends are
    quantiles, at most `ranges` of them; between two of these, blocks are of equal width.
    A doc_id that is several quantiles has as many blocks of its own, and its rows are dealt to
    them by their text, as those without doc_id are to theirs.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    total, none = docs.agg(F.sum(size), F.sum(F.when(F.col("doc_id").isNull(), size))).first()
    total, none = total or 0, none or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (mb << 20)))
    cuts = min(n, ranges)
    # A long text counts as several, so that blocks have equal shares of bytes rather than of rows.
    weighed = docs.where("doc_id is not null").select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(size / 4096).cast("int"))))
    found = weighed.agg(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)] or [1.0], 20 * cuts), F.min("doc_id"), F.max("doc_id")).first()
    ends = sorted({*(found[0] or [0]), found[2] or 0})
    parts = -(-n // cuts)
    # Range k has the ids over ends[k - 1] and up to ends[k]; k is found by halving.
    bits = len(ends).bit_length()
    padded = [*ends, *[LAST] * ((1 << bits) - len(ends))]
    table = f"cast(split('{','.join(map(str, padded))}', ',') as array<bigint>)"
    half = " ".join(f"when k = {k} then {1 << bits - 1 - k}" for k in range(bits))
    place = F.expr(f"if(doc_id is null, null, aggregate(sequence(0, {bits - 1}), 0, (at, k) -> at + case when element_at({table}, cast(at + case {half} end as int)) < doc_id then case {half} end else 0 end))")
    low = (found[1] or 0) - 1
    if parts > 1:
        lows = f"cast(split('{','.join(map(str, [low, *padded[:-1]]))}', ',') as array<bigint>)"
        here, below = F.expr(f"element_at({table}, cast(_place + 1 as int))"), F.expr(f"element_at({lows}, cast(_place + 1 as int))")
        within = F.least(F.floor((F.col("doc_id") - below - 1) / (here - below) * parts), F.lit(parts - 1))
    last = len(ends) * parts
    often = {v: n for v, n in Counter(found[0] or []).items() if n > 1}
    shares = [n * parts for n in often.values()]
    starts = [last + sum(shares[:k]) for k in range(len(shares) + 1)]
    hot = [(x, ends.index(v) * parts + parts - 1) for x, v in zip(starts, often)]
    nulls = max(1, -(-none // (mb << 20)))
    loose = F.pmod(F.xxhash64("text"), F.lit(nulls)) + starts[-1]
    if hot:
        hot.append((starts[-1], last))
        numbers = [F.expr(f"cast(split('{','.join(map(str, x))}', ',') as array<bigint>)") for x in (often, starts, shares)]
        which = (F.array_position(numbers[0], F.col("doc_id")) - 1).cast("int")
        own = F.when(which >= 0, F.get(numbers[1], which) + F.pmod(F.xxhash64("text"), F.get(numbers[2], which)))

    def block(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_place", place)
        at = F.col("_place") * parts + within if parts > 1 else F.col("_place")
        return rows.withColumn("_block", F.coalesce(*([own] if hot else []), at, loose).cast("long")).drop("_place")

    return block, last, hot, starts[-1] + nulls, total


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, kept: str = "kept binary") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, what is kept, and the columns to carry along.

    kept: "kept binary" for the bytes, "kept_text string" for whole characters of them, or empty for neither.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = carry or []
    dealt_to, last, hot, blocks, total = blocks_by_id(docs)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (GROUP_MB << 20)))
    rows = dealt_to(docs.select("doc_id", "text", *(F.col(c).alias(f"_c{k}") for k, c in enumerate(carry))))
    dealt = rows.select(F.col("doc_id").alias("_id"), F.encode("text", "utf-8").alias("_data"), "_block", *(f"_c{k}" for k in range(len(carry)))).repartition(blocks, "_block")
    whole = dealt.groupBy("_block")
    wanted = whole.applyInArrow(ask(n), ddl(KEYS)).groupBy("g").applyInArrow(choose(last, hot), ddl(WANTED))
    pieces = whole.cogroup(wanted.groupBy("block")).applyInArrow(send(n), ddl(PIECES))
    told = pieces.groupBy("g").applyInArrow(answer, ddl(TOLD)).unionByName(wanted.where("length(gone) + length(hot) > 0").select("block", "gone", "hot"), allowMissingColumns=True)
    fields = docs.sparkSession.createDataFrame([], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (kept and f", {kept}")).schema
    for c in carry:
        fields = fields.add(f"carried_{c}" if c in fields.names else c, docs.schema[c].dataType)
    return whole.cogroup(told.groupBy("block")).applyInArrow(cut_out(to_arrow_schema(fields)), fields)
