"""Benchmark decontamination by Wu-Manber search over word symbols.

A text becomes a row of 64-bit word hashes. Windows of equal length form one
family with a shift table over hashed two-symbol blocks: the shift says how far
the window's end may jump because no test string has that block nearer to its
end. Where the shift is zero, a suffix-hash bucket selects test strings, and the
words themselves are compared. Many lanes of a block of texts jump at once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bytes, blocks, lower_ascii, settled

#: Bytes of a word: 0-9, a-z and all above 7F, after A-Z are lower-cased.
IN_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    if n > 1:
        up[1:], down[1:] = np.uint64(base), np.uint64(inverse)
        with np.errstate(over="ignore"):
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return up, down


_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("w", [()])[0]) < n:
        _POWERS["w"] = powers(max(n, 1 << 16), _BASE)
    up, down = _POWERS["w"]
    return up[:n], down[:n]


def words_of(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word begins, word ends and each word's text number. Words end at text ends."""
    low = lower_ascii(data)
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = IN_WORD[low]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = start[1:-1]
    edge = edge[(edge > 0) & (edge < len(low))]
    first[edge] = inside[1:-1][edge]
    last[edge - 1] |= inside[1:-1][edge - 1]
    begin = np.flatnonzero(first)
    return low, begin, np.flatnonzero(last) + 1, np.searchsorted(start, begin, "right") - 1


def symbols(low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word, equal for equal words wherever they stand."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[end] - total[begin]) * down[begin]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


class Family:
    """Test strings of one length in words: where each begins among all items' words, the shift table and the suffix buckets."""

    def __init__(self, symbol: np.ndarray, first: np.ndarray, m: int):
        self.symbol, self.string, self.m = symbol, first.astype(np.int32), m
        self.block = min(2, m)
        bits = min(max(len(first).bit_length() + 3, 16), 24)  # of the shift table, a byte each
        self.coarse = 3  # bits fewer for the buckets
        self.shift_bits = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8)
        suffix = np.empty(len(first), np.int32)
        for k in range(0, len(first), 1 << 18):
            part = first[k : k + (1 << 18)]
            for j in range(self.block, m + 1):  # blocks that end at symbol j
                at = self.hashed(symbol[part + j - 1], symbol[part + j - self.block])
                np.minimum.at(self.shift, at, np.uint8(m - j))
            suffix[k : k + (1 << 18)] = at >> self.coarse
        self.order = np.argsort(suffix, kind="stable").astype(np.int32)
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << bits - self.coarse) + 1)).astype(np.int32)

    def hashed(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        return (((before * np.uint64(0xA24BAED4963EE407)) ^ last) * _MIX >> self.shift_bits).astype(np.int64)

    def search(self, s: np.ndarray, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first symbol, place of the string's first word) of every occurrence by symbols."""
        m, n = self.m, len(s)
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(64, -(-(n - m + 1) // lanes))
        at = np.arange(m - 1, n, step)
        stop = np.minimum(at + step, n)
        found = []
        while len(at):
            key = self.hashed(s[at], s[at - self.block + 1])
            jump = self.shift[key]
            hit = jump == 0
            if hit.any():
                found.append(np.stack([at[hit], key[hit]]))
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, key = np.concatenate(found, axis=1)
        key >>= self.coarse
        some = self.bucket[key + 1] - self.bucket[key]
        row = np.repeat(np.arange(len(at)), some)
        within = np.arange(len(row)) - np.repeat(np.cumsum(some) - some, some)
        string = self.string[self.order[self.bucket[key][row] + within]].astype(np.int64)
        begin = at[row] - m + 1
        for j in range(m):
            same = s[begin + j] == self.symbol[string + j]
            begin, string = begin[same], string[same]
        return begin, string


class Index:
    """Windows of benchmark items in flat arrays: about 40 bytes a word and the texts, whatever the windows overlap."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = 10):
        self.names = [name for name, _ in items]
        start = np.cumsum([0, *(len(text) for _, text in items)])
        low, begin, end, owner = words_of(np.frombuffer(b"".join(text for _, text in items), np.uint8), start)
        self.text, self.begin, self.end, self.owner = low, begin.astype(np.int32), end.astype(np.int32), owner.astype(np.int32)
        self.symbol = symbols(low, begin, end)
        count = np.bincount(owner, minlength=len(items))
        base = np.cumsum(count) - count
        self.families = []
        for m in sorted(set(np.minimum(count, width).tolist()) - {0}):
            which = np.flatnonzero(np.minimum(count, width) == m)
            many = count[which] - m + 1
            first = np.repeat(base[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            self.families.append(Family(self.symbol, first, m))

    def word(self, k: int) -> bytes:
        return self.text[self.begin[k] : self.end[k]].tobytes()

    def scan(self, texts: Bytes) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Per text: number of words, hit word runs [first, last), items."""
        low, begin, end, owner = words_of(texts.data, texts.start)
        count = np.bincount(owner, minlength=len(texts))
        base = np.cumsum(count) - count
        s = np.zeros(len(begin) + len(texts), np.uint64)  # a zero between texts matches no word
        place = np.arange(len(begin)) + owner
        s[place] = symbols(low, begin, end)
        word_at = np.zeros(len(s), np.int64)
        word_at[place] = np.arange(len(begin))
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        for family in self.families:
            for p, k in zip(*(x.tolist() for x in family.search(s))):
                w = int(word_at[p])
                if all(low[begin[w + j] : end[w + j]].tobytes() == self.word(k + j) for j in range(family.m)):
                    doc = int(owner[w])
                    runs[doc].append((w - int(base[doc]), w - int(base[doc]) + family.m))
                    items[doc].add(self.names[self.owner[k]])
        return count, [merged(runs[i]) if i in runs else [] for i in range(len(texts))], [sorted(items[i]) if i in items else [] for i in range(len(texts))]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open runs."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


FOUND = "n_words long, hit_runs array<struct<first:long,last:long>>, item_ids array<string>"
_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find_leaks(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """All columns of ``docs`` plus n_words, hit_runs and item_ids (sorted as strings).

    A window is ``width`` consecutive words of an item; an item of fewer words, but
    not none, is one window. hit_runs are maximal runs of document words inside
    occurrences. Null texts have no words; items with a null id or text are left
    out; items that repeat count once. A document column that has the name of a
    result column is replaced. Empty tables give no rows, or no hits. Items come to the
    driver in blocks of at most ``block_bytes`` of text (a longer item stands alone).
    A block's index, about eight times as large, is built there once and broadcast; it
    is one more pass over the documents, and a checkpoint keeps passes apart, so that a
    worker holds one index at a time, its size is bounded and all items count.
    """
    spark = docs.sparkSession
    clean = bench.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item).cast("string").alias("name"), F.encode(F.col(item_text), "utf-8").alias("body"))

    def packs() -> Iterator[Index]:
        pack, size, any_yet = [], 0, False
        for row in clean.toLocalIterator():
            if pack and size + len(row.body) > block_bytes:
                yield Index(pack, width)
                pack, size, any_yet = [], 0, True
            pack.append((row.name, bytes(row.body)))
            size += len(row.body)
        if pack or not any_yet:
            yield Index(pack, width)

    out = docs.drop("n_words", "hit_runs", "item_ids")
    names = out.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), FOUND])
    for k, index in enumerate(packs()):
        if k:
            out = settled(out)
        sent = spark.sparkContext.broadcast(index)

        def step(batches: Iterator[pa.RecordBatch], sent=sent, more=k > 0) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in blocks(batches, text):
                count, runs, items = index.scan(Bytes(b.column(text)))
                if more:
                    runs = [merged([*new, *((r["first"], r["last"]) for r in old)]) for new, old in zip(runs, b.column("hit_runs").to_pylist())]
                    items = [sorted({*new, *old}) for new, old in zip(items, b.column("item_ids").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(count, pa.int64()), pa.array([[{"first": x, "last": y} for x, y in r] for r in runs], _RUNS), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hit_runs", "item_ids"])

        out = out.mapInArrow(step, schema)
    return out


def hit_words() -> F.Column:
    return F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
