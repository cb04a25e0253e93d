"""LM scoring by online logistic mixing of hashed-context bit predictors.

A text is a row of words and one end. Frequent words, an escape and the end have a
Huffman code, and each bit of it is predicted by several counters: that of the code
node alone, and those of the node in hashed contexts (the word before; the last very
frequent word; the last two of them). Escaped words are spelled in bytes, coded and
predicted the same way (two bytes before; four; three and the last very frequent
word). Weights, gated by how much a counter has seen, mix the predictions in the
logistic domain, and a slope and an offset refine the mix. All start the same for
every text and are learnt online within it, after each symbol (a word's code or a
byte), so a text's score doesn't depend on its neighbours and there is nothing to fit
on a sample.

Counters cover the whole training corpus; those of the spelling also have every word
that has a code, once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bytes, blocks, lower_ascii, partitions, reuse_memory, settled

#: Words with a code of their own, and words whose counts every worker holds; longer words than LONGEST are never among them.
CODED, HELD, LONGEST = 1 << 17, 1 << 18, 64
#: Very frequent words, for the contexts.
MARKERS = 256
#: Slots of a context's table, as a power of two: what a worker can hold while it counts (six tables of 16 MB).
SLOT_BITS = 21
PIECE = 1 << 15
#: Nodes of a path that share a line of a context's table, as a worker's cache holds it: a context and the first of them choose the line.
SPAN = 5
_LOW = np.uint32((2 << SPAN) - 1)
_M32 = np.uint32(0x9E3779B1)
#: Symbols of a text between two steps of its mixer, their rate, and the weights at the start.
CHUNK, RATE, START = 1, 0.1, 0.4
#: Symbols whose inputs are gathered at once, and text bytes of a block that is scored: the more texts, the more bits a step has.
GROUP, SCORED = 1 << 14, 3 << 20
#: Symbols of a text that makes it wait for others as long, so that few texts don't take most steps; and symbols that wait at most.
LONG, WAITING = 1 << 10, 3 << 19
#: Of those that wait, how many of the longest go on waiting while others come, for the steps beyond the others' length would be theirs alone.
LAST = 64
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SPACE = 32
#: Hashed contexts of the words' code and of the spelling; each has a table of counters for both bits.
CONTEXTS = (("marker", "before", "markers"), ("two", "four", "three"))
TABLES = tuple(name for names in CONTEXTS for name in names)


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of a column of texts, one after the other, and how many each text has.

    A-Z lower-cased; split at white space (20, 09-0D). A null text has none.
    """
    held = Bytes(column)  # ascii_lower reads amiss in arrays that don't begin at 0
    low = pa.LargeStringArray.from_buffers(len(held), pa.py_buffer(np.ascontiguousarray(held.start)), pa.py_buffer(lower_ascii(held.data)))
    parts = pc.ascii_split_whitespace(low)
    many = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not there.all():
        flat = flat.filter(pa.array(there))
        many = np.bincount(np.repeat(np.arange(len(many)), many)[there], minlength=len(many))
    return flat, many


class Tree:
    """Huffman code of weighted symbols; paths as flat arrays of bits, and of their nodes' hashes and log odds."""

    def __init__(self, weight: list[int]):
        n = len(weight)
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, bit, size = [0] * (2 * n - 1), [0] * (2 * n - 1), [*weight, *([0] * (n - 1))]
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = node
            bit[y] = 1
            size[node] = a + b
            heapq.heappush(heap, (a + b, node))
        one = np.zeros(n - 1)
        for x in range(2 * n - 2):
            if bit[x]:
                one[parent[x] - n] = size[x]
        whole = np.array(size[n:], float)
        up, turn, root = np.array(parent), np.array(bit, np.int8), 2 * n - 2
        at, steps = np.arange(n), []
        while (live := at != root).any():
            steps.append((np.flatnonzero(live), up[at[live]] - n, turn[at[live]]))
            at = np.where(live, up[at], at)
        self.length = np.zeros(n, np.int64)
        for i, _, _ in steps:
            self.length[i] += 1
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        nodes, self.bits = np.zeros(int(self.length.sum()), np.int32), np.zeros(int(self.length.sum()), np.int8)
        for k, (i, node, b) in enumerate(steps):
            place = self.start[i] + self.length[i] - 1 - k
            nodes[place], self.bits[place] = node, b
        self.odds = np.log((one + 0.5) / (whole - one + 0.5)).astype(np.float32)[nodes]
        # A path's nodes by SPAN: the hash of the first, and in the lowest places which of the tree below it (from 1) and the bit that follows.
        begin = np.repeat(self.start, self.length)
        deep = np.arange(len(nodes)) - begin
        which = np.ones(len(nodes), np.uint32)
        for k in range(1, SPAN):
            at = np.flatnonzero(deep % SPAN == k)
            which[at] = 2 * which[at - 1] + self.bits[at - 1].astype(np.uint32)
        top = ((np.arange(n, dtype=np.uint64) + np.uint64(1)) * _K[3] >> np.uint64(32)).astype(np.uint32)[nodes[begin + deep // SPAN * SPAN]]
        self.mixed = top & ~_LOW | which << np.uint32(1) | self.bits.astype(np.uint32)


class Code:
    """Held words with their counts, and the trees of coded words (with escape and end) and of bytes."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, texts: int, coded: int = CODED):
        self.ids = {w: i for i, w in enumerate(words)}
        self.words = pa.array(words, pa.large_binary())
        self.counts = np.array(counts, np.int64)
        # Words seen once are spelled: they tell how often a new word comes, and how one is spelled.
        self.coded = min(coded, int(np.count_nonzero(self.counts > 1)))
        self.escape, self.end, self.begin = self.coded, self.coded + 1, self.coded + 2
        letters = np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256)
        self.trees = (Tree([*counts[: self.coded], max(1, total - sum(counts[: self.coded])), max(1, texts)]), Tree((16 * letters + 1).tolist()))

class Channel:
    """Symbols in a row, the text of each, and its contexts (hashed to 32 bits)."""

    def __init__(self, symbol: np.ndarray, owner: np.ndarray, contexts: list[np.ndarray]):
        self.symbol, self.owner = symbol, owner
        self.contexts = [((c ^ (c >> np.uint64(29))) * _K[3] >> np.uint64(32)).astype(np.uint32) for c in contexts]

    @classmethod
    def of(cls, symbol: np.ndarray, owner: np.ndarray, contexts: list[np.ndarray]) -> Channel:
        """A channel of contexts that are hashed already."""
        out = cls(symbol, owner, [])
        out.contexts = contexts
        return out

    def part(self, texts: np.ndarray) -> Channel:
        """The symbols of some texts, by their numbers in order; the texts are numbered anew, the others go."""
        number = np.full(1 + max([*texts[-1:].tolist(), *self.owner[-1:].tolist()], default=0), -1, np.int32)
        number[texts] = np.arange(len(texts))
        owner = number[self.owner]
        which = np.flatnonzero(owner >= 0)
        return Channel.of(self.symbol[which].astype(np.int32), owner[which], [c[which] for c in self.contexts])

    def slots(self, tree: Tree, which: slice | np.ndarray):
        """(code bits of each symbol, place in the tree's paths, the bits, slot in each context's table) of some symbols."""
        s = self.symbol[which]
        n = tree.length[s]
        end = np.cumsum(n)
        first = end - n
        at = np.arange(int(end[-1]) if len(end) else 0, dtype=np.int32) + np.repeat(tree.start[s] - first.astype(np.int32), n)
        mixed = tree.mixed.take(at)
        low = mixed & _LOW
        mixed ^= low
        bit = low & np.uint32(1)
        low >>= np.uint32(1)
        out = []
        for c in self.contexts:
            slot = c[which].repeat(n)
            slot ^= mixed
            slot *= _M32
            slot >>= np.uint32(32 - SLOT_BITS)
            slot ^= low
            out.append(slot)
        return n, at, bit.astype(np.int32), out


class Tokens:
    """Words of a block of texts, and its two channels."""

    def __init__(self, code: Code, texts: pa.Array):
        u = np.uint64
        flat, many = words_of(texts)
        kinds = flat.dictionary_encode()
        self.kinds, self.kind = kinds.dictionary.cast(pa.large_binary()), kinds.indices.to_numpy(zero_copy_only=False)
        held = pc.fill_null(pc.index_in(self.kinds, value_set=code.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[self.kind]
        self.many, self.held = many, held
        self.text = np.repeat(np.arange(len(texts)), many)
        at = np.arange(len(held)) + self.text
        symbol = np.full(len(held) + len(texts), code.end, np.int64)
        symbol[at] = np.where((held < 0) | (held >= code.coded), code.escape, held)
        owner = np.repeat(np.arange(len(texts)), many + 1)
        begin = np.cumsum(many + 1) - many - 1
        before = np.empty_like(symbol)
        before[1:] = symbol[:-1]
        before[begin] = code.begin
        marker = symbol < min(MARKERS, code.coded)
        seen = np.cumsum(marker)
        first = (seen[begin] - marker[begin])[owner]  # markers in earlier texts
        count = seen - marker
        which = np.concatenate([symbol[marker], [0, 0]])
        one = np.where(count - first > 0, which[count - 1], MARKERS)
        two = np.where(count - first > 1, which[count - 2], MARKERS)
        contexts = [one.astype(u) * _K[0], (before.astype(u) + u(1 << 20)) * _K[1], (one.astype(u) * u(MARKERS + 1) + two.astype(u) + u(1 << 40)) * _K[2]]
        which = np.flatnonzero(symbol[at] == code.escape)
        self.channels = (Channel(symbol, owner, contexts), spelling(each(self.kinds.take(pa.array(self.kind[which]))), self.text[which], one[at][which]))


def each(words: pa.Array) -> list[bytes]:
    """Words as bytes."""
    held = Bytes(words)
    whole, edge = held.data.tobytes(), held.start.tolist()
    return [whole[a:z] for a, z in zip(edge, edge[1:])]


def spelling(words: list[bytes], text: np.ndarray, marker: np.ndarray) -> Channel:
    """Bytes of words, a space ending each; bytes before a word's first count as spaces."""
    u = np.uint64
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), size)
    c = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)[: len(word)]
    before = [c]
    for _ in range(4):
        last = before[-1]
        before.append(np.concatenate([[_SPACE], last[:-1]])[: len(c)] if len(before) == 1 else np.where(last == _SPACE, _SPACE, np.concatenate([[_SPACE], last[:-1]])[: len(c)]))
    p1, p2, p3, p4 = (x.astype(u) for x in before[1:])
    three = p1 | p2 << u(8) | p3 << u(16)
    contexts = [((three & u(0xFFFF)) + u(1 << 32)) * _K[0], ((three | p4 << u(24)) + u(1 << 40)) * _K[1], (three + (marker[word].astype(u) << u(24)) + u(1 << 48)) * _K[2]]
    return Channel(c, text[word], contexts)


_STEP = 1 << 13  # symbols whose bits are handled at once


class Tally:
    """A worker's counters, of both bits in turn."""

    def __init__(self):
        self.held = {t: np.zeros(2 << SLOT_BITS, np.int32) for t in TABLES}

    def add(self, tree: Tree, channel: Channel, names: tuple[str, ...]) -> None:
        for a in range(0, len(channel.symbol), _STEP):
            _, _, bit, slots = channel.slots(tree, slice(a, a + _STEP))
            bit = bit.view(np.uint32)
            for name, slot in zip(names, slots):
                np.add.at(self.held[name], ((slot << np.uint32(1)) | bit).astype(np.intp), np.int32(1))

    def pieces(self, salt: int) -> Iterator[pa.RecordBatch]:
        for tab, name in enumerate(TABLES):
            table = self.held[name]
            for k in range(0, len(table), PIECE):
                part = table[k : k + PIECE]
                if part.any():
                    yield _piece(tab, k // PIECE, salt, part.astype(np.int64))


def _piece(tab: int, piece: int, salt: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tab], pa.int32()), pa.array([piece], pa.int32()), pa.array([salt], pa.int32()), pa.array([pa.compress(values.tobytes(), "zstd", asbytes=True)], pa.binary())], names=["tab", "piece", "salt", "data"])


def _values(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, PIECE * 8, "zstd", asbytes=True), np.int64)


#: How far log odds count by how much their counter has seen: nothing, 1 to 3, 4 to 31, more. They open or shut the weights.
GATE = np.array([0, 0.9, 1, 1])
_UNIT = 256.0


def odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """A counter as 16 bits: gated log odds in 256ths."""
    n = n0 + n1
    gate = GATE[(n > 0).astype(np.int64) + (n > 3) + (n > 31)]
    return np.clip(np.rint(np.log((n1 + 0.4) / (n0 + 0.4)) * gate * _UNIT), -32000, 32000).astype(np.int16)


#: Log odds of up to 12 in 64ths; the probability of each, and its cost in bits.
_FINE, _HALF = 64, 768
_CHANCE = (1 / (1 + np.exp(-np.arange(-_HALF, _HALF + 1) / _FINE))).astype(np.float32)
_COST = (-np.log2(_CHANCE)).astype(float)  # sums of costs are double
_ZERO = np.float32(_HALF + 0.5)  # of the cells, so that cutting rounds


def bits_of(tree: Tree, channel: Channel, tables: list[np.ndarray], texts: int) -> np.ndarray:
    """Total bits of each text's symbols.

    All texts of a block take their n-th step at once, each with its own weights and
    its own refinement: a slope and an offset for the mix, learnt in the same steps.
    The inputs of many steps are gathered together; what is learnt isn't.
    """
    n = len(channel.symbol)
    if not n:
        return np.zeros(texts)
    # Texts by length, so that those of a step come first in every table.
    size = np.bincount(channel.owner, minlength=texts)
    place = np.empty(texts, np.int32)
    place[np.argsort(-size, kind="stable")] = np.arange(texts)
    rank = place[channel.owner]
    at = np.arange(n) - (np.cumsum(size) - size)[channel.owner]
    chunk = (at // CHUNK).astype(np.int32)
    order = np.argsort((at // CHUNK * texts + rank) * CHUNK + at % CHUNK)
    del at
    cuts = np.searchsorted(chunk[order], np.arange(chunk.max() + 2))
    out, rows = np.zeros(texts), len(tables) + 1
    # Weights, slope and offset; weights and offset in cells, which changes no digit as _FINE is a power of two.
    state = np.zeros((rows + 2, texts), np.float32)
    state[0], state[1:rows], state[rows] = START * _FINE, START / _UNIT * _FINE, 1
    unit = np.array([_FINE, *[_FINE / _UNIT**2] * len(tables), 0.1 / _FINE, 0.1 * _FINE], np.float32)[:, None]
    add, multiply, subtract, total, sums = np.add, np.multiply, np.subtract, np.add.reduce, np.add.reduceat
    k = 0
    while k < len(cuts) - 1:
        end = max(k + 1, int(np.searchsorted(cuts, cuts[k] + GROUP, "right")) - 1)
        which = order[cuts[k] : cuts[end]]
        many, path, bit, slots = channel.slots(tree, which)
        # What a text has of a step, and where its bits begin.
        own, step = rank[which], chunk[which]
        first = np.concatenate([[0], np.flatnonzero((np.diff(own) != 0) | (np.diff(step) != 0)) + 1])
        bits = np.add.reduceat(many, first)
        start = np.cumsum(bits) - bits
        scale = unit * (RATE / np.sqrt(bits)).astype(np.float32)
        # Single precision throughout: whole numbers of 32 bits would make the products double.
        x, one = np.empty((rows, len(path)), np.float32), bit.astype(np.float32)
        x[0] = tree.odds.take(path)
        for row, table, slot in zip(x[1:], tables, slots):
            row[:] = table.take(slot)
        cell = np.empty(len(path), np.intp)
        edge = np.searchsorted(step[first], np.arange(step[0], step[-1] + 2))
        at = np.concatenate([start, [len(path)]])[edge]
        inner = start - np.repeat(at[:-1], np.diff(edge))
        most = int(np.diff(at).max())
        space, pair = np.empty((rows + 2, most), np.float32), np.empty((2, most), np.float32)
        places = np.empty((2, most), np.intp)
        for a, z, i, j in zip(edge.tolist(), edge[1:].tolist(), at.tolist(), at[1:].tolist()):
            # The texts of a step are the first ones, in order.
            n = j - i
            own_state, v, move, both, cells = state[:, : z - a], x[:, i:j], space[:, :n], pair[:, :n], places[:, :n]
            now = own_state.repeat(bits[a:z], 1)
            fine, mix = both
            multiply(now[:rows], v, move[:rows])
            total(move[:rows], 0, None, mix)
            multiply(now[rows], mix, fine)
            add(fine, now[rows + 1], fine)
            add(both, _ZERO, cells, casting="unsafe")
            cell[i:j] = cells[0]
            late, wrong = subtract(one[i:j], _CHANCE.take(cells, None, None, "clip"))
            multiply(v, wrong, move[:rows])
            multiply(late, mix, move[rows])
            move[rows + 1] = late
            own_state += sums(move, inner[a:z], 1) * scale[:, a:z]
        np.clip(cell, 0, 2 * _HALF, out=cell)
        out += np.bincount(own[first], np.add.reduceat(_COST.take(np.where(one > 0, cell, 2 * _HALF - cell)), start), texts)
        k = end
    return out[place]


def total_bits(code: Code, tables: list[np.ndarray], tokens: Tokens | Joined, texts: int) -> np.ndarray:
    half = len(CONTEXTS[0])
    return sum(bits_of(tree, channel, part, texts) for tree, channel, part in zip(code.trees, tokens.channels, (tables[:half], tables[half:])))


class Joined:
    """The channels of some texts of one or more blocks, in turn."""

    def __init__(self, blocks: list[tuple[Channel, ...]], texts: list[int]):
        before = (np.cumsum(texts) - texts).astype(np.int32)
        self.channels = tuple(Channel.of(np.concatenate([c.symbol for c in each]), np.concatenate([c.owner + k for c, k in zip(each, before)]), [np.concatenate(x) for x in zip(*(c.contexts for c in each))]) for each in zip(*blocks))


class Waiting:
    """Long texts of several blocks with what is known of each, to be scored together."""

    def __init__(self):
        self.blocks, self.rows = [], []

    def add(self, channels: tuple[Channel, ...], rows: list[np.ndarray]) -> None:
        self.blocks.append(channels)
        self.rows.append(rows)

    def full(self) -> bool:
        return sum(len(c.symbol) for channels in self.blocks for c in channels) >= WAITING

    def scored(self, code: Code, tables: list[np.ndarray], last: int = 0) -> list[np.ndarray]:
        """What is known of each text, and its total bits; then none waits, or the ``last`` longest if they are small enough."""
        texts = [len(r[0]) for r in self.rows]
        rows, n = [np.concatenate(x) for x in zip(*self.rows)], sum(texts)
        joined = Joined(self.blocks, texts)
        self.blocks, self.rows = [], []
        if 0 < last < n:
            size = np.stack([np.bincount(c.owner, minlength=n) for c in joined.channels])
            order = np.argsort(size.max(0), kind="stable")
            some, others = np.sort(order[n - last :]), np.sort(order[: n - last])
            if 2 * size[:, some].sum() <= WAITING:
                self.add(tuple(c.part(some) for c in joined.channels), [r[some] for r in rows])
                joined.channels = tuple(c.part(others) for c in joined.channels)
                rows, n = [r[others] for r in rows], len(others)
        return [*rows, total_bits(code, tables, joined, n)]


# --- statistics of the corpus -----------------------------------------------------


def word_counts(docs: DataFrame, most: int = 400_000) -> DataFrame:
    """(word binary, n): exact counts over all rows; workers hand on partial counts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flushed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(waiting).group_by("word").aggregate([("n", "sum")]).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(whole["word"].chunks).cast(pa.binary()), pa.concat_arrays(whole["n_sum"].chunks)], names=["word", "n"])

        for b in blocks(batches, "body"):
            found = words_of(b.column("body"))[0].value_counts()
            if len(found):
                waiting.append(pa.RecordBatch.from_arrays([found.field("values").cast(pa.large_binary()), found.field("counts")], names=["word", "n"]))
                size += len(found)
            if size > most:
                yield flushed()
                waiting, size = [], 0
        if waiting:
            yield flushed()

    return docs.select("body").mapInArrow(step, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[list[bytes], list[int]]:
    """The most frequent words of at most LONGEST bytes, and their counts.

    All words from a count on, the least for which they are at most ``most``. It is
    found from how many words have each count (all large counts together), so no
    task sorts the vocabulary.
    """
    cap = 1 << 16
    short = counts.where(F.octet_length("word") <= LONGEST)
    tally = dict(short.groupBy(F.least("n", F.lit(cap)).alias("n")).count().collect())
    least, total = cap + 1, 0
    for n in sorted(tally, reverse=True):
        if total + tally[n] > most:
            break
        least, total = n, total + tally[n]
    if least > cap:  # more words than that have huge counts
        short = short.where(F.col("n") >= cap).orderBy(F.desc("n"), "word").limit(most)
    found = short.where(F.col("n") >= min(least, cap)).toArrow()
    rows = sorted(zip(found["n"].to_pylist(), found["word"].to_pylist()), key=lambda r: (-r[0], r[1]))
    return [w for _, w in rows], [n for n, _ in rows]


def _sums(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
    """Adds up pieces of counters that come sorted by place; one sum is held at a time."""
    place, total = None, None
    for b in batches:
        for tab, piece, s, data in zip(*(b.column(c).to_pylist() for c in ("tab", "piece", "salt", "data"))):
            now = (tab, piece, s if salted else 0)
            if now != place:
                if place is not None:
                    yield _piece(*place, total)
                place, total = now, _values(data).copy()
            else:
                total += _values(data)
    if place is not None:
        yield _piece(*place, total)


_COUNTER = "tab int, piece int, salt int, data binary"


def counters(docs: DataFrame, sent) -> list[np.ndarray]:
    """Each table's counters as ``odds``, over all rows; workers' tables are summed in two steps."""
    n = partitions(docs)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, seen, salt = sent.value, None, 0
        reuse_memory()
        for b in blocks(batches, "body", SCORED):
            seen, salt = seen or Tally(), salt or b.num_rows % 32
            for channel, tree, names in zip(Tokens(code, b.column("body")).channels, code.trees, CONTEXTS):
                seen.add(tree, channel, names)
        if seen:
            yield from seen.pieces(salt)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, known = sent.value, None
        for b in batches:
            if b.num_rows and known is None:
                known, seen = list(code.ids)[: code.coded], Tally()
                for k in range(0, len(known), 1 << 14):
                    part = known[k : k + (1 << 14)]
                    seen.add(code.trees[1], spelling(part, np.zeros(len(part), np.int64), np.full(len(part), MARKERS)), CONTEXTS[1])
                yield from seen.pieces(0)

    rows = docs.select("body").mapInArrow(step, _COUNTER).union(docs.sparkSession.range(0, 1, 1, 1).mapInArrow(spelled, _COUNTER))
    rows = rows.repartition(n, "tab", "piece", "salt").sortWithinPartitions("tab", "piece", "salt").mapInArrow(lambda b: _sums(b, True), _COUNTER)
    rows = rows.repartition(n, "tab", "piece").sortWithinPartitions("tab", "piece").mapInArrow(lambda b: _sums(b, False), _COUNTER)
    none = odds(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    out = [np.full(1 << SLOT_BITS, none, np.int16) for _ in TABLES]
    for r in rows.toLocalIterator():
        values = _values(bytes(r.data))
        out[r.tab][r.piece * PIECE // 2 : (r.piece + 1) * PIECE // 2] = odds(values[0::2], values[1::2])
    return out


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of its key as text, modulo 5, is 1. A null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))


_SCORED = "ida long, idb long, word binary, tf long, n_tokens long, n_known long, base double, bits double, n_bytes long"
_OWN = ("n_tokens", "n_known", "base", "bits", "n_bytes")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", coded: int = CODED, held: int = HELD) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    base_score is the add-half unigram model's log10 probability, score the mixing
    model's; bits_per_byte is its total over UTF-8 bytes (and one for the end). A
    null or empty text has the end as its only token; a null key is in training;
    repeated rows are repeated. Counts of the ``held`` most frequent words (of 64
    bytes at most, so the size is bounded) are broadcast; rarer words are joined.
    An empty training set gives uniform base scores, and the model still codes; an
    empty table gives an empty result. Columns besides key and text, whatever their
    names, aren't read.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), held_out(key).alias("held_out"))
    train = named.where("not held_out")
    counts = settled(word_counts(train))
    texts = train.count()
    n_words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + texts, kinds + (texts > 0)
    below = math.log10(total + 0.5 * (kinds + 1))
    words, many = frequent(counts, held)
    sent = spark.sparkContext.broadcast(Code(words, many, n_words, texts, coded))
    tables = spark.sparkContext.broadcast(counters(train, sent))
    end_base = math.log10(texts + 0.5) - below

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value
        reuse_memory()
        known = np.log10(code.counts + 0.5) - below
        waiting = Waiting()

        def own(rows: list[np.ndarray]) -> pa.RecordBatch:
            ida, idb, n_tokens, n_known, base, n_bytes, bits = rows
            # A row's own record has a made-up word that no text holds (it has a space), so records spread over tasks.
            word = [b" %d" % x for x in idb.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(ida), pa.array(idb), pa.array(word, pa.binary()), pa.nulls(len(ida), pa.int64()), *map(pa.array, (n_tokens, n_known, base, bits, n_bytes))], names=["ida", "idb", "word", "tf", *_OWN])

        for b in blocks(batches, "body", SCORED):
            n = b.num_rows
            t = Tokens(code, b.column("body"))
            there = t.held >= 0
            base = np.bincount(t.text[there], weights=known[t.held[there]], minlength=n) + end_base
            n_known = np.bincount(t.text[there], minlength=n) + (texts > 0)
            ida, idb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ida", "idb"))
            rare, times = np.unique(t.text[~there] * len(t.kinds) + t.kind[~there], return_counts=True)
            at, words = np.divmod(rare, max(1, len(t.kinds)))
            none = [pa.nulls(len(rare), pa.float64() if c in ("base", "bits") else pa.int64()) for c in _OWN]
            yield pa.RecordBatch.from_arrays([pa.array(ida[at]), pa.array(idb[at]), t.kinds.take(pa.array(words)).cast(pa.binary()), pa.array(times), *none], names=["ida", "idb", "word", "tf", *_OWN])
            n_bytes = pc.fill_null(pc.binary_length(b.column("body")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            rows = [ida, idb, t.many + 1, n_known.astype(np.int64), base, n_bytes]
            long = np.maximum(*(np.bincount(c.owner, minlength=n) for c in t.channels)) > LONG
            now = Waiting()
            for some, held in ((np.flatnonzero(~long), now), (np.flatnonzero(long), waiting)):
                if len(some):
                    held.add(tuple(c.part(some) for c in t.channels), [x[some] for x in rows])
            del t
            if now.blocks:
                yield own(now.scored(code, tables.value))
            if waiting.full():
                yield own(waiting.scored(code, tables.value, LAST))
        if waiting.blocks:
            yield own(waiting.scored(code, tables.value))

    identity = named.select(F.xxhash64("key").alias("ida"), F.xxhash64("body").alias("idb"), "body")
    seen = identity.mapInArrow(step, _SCORED).join(counts.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    # Rows of equal key and text share an identity: their sums are divided by how many they are.
    rows = F.count("n_tokens")
    by = seen.groupBy("ida", "idb").agg(
        rows.alias("rows"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(c > 0, F.col("tf"))), F.lit(0)) / rows).cast("long").alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(F.when(F.col("tf").isNotNull(), F.col("tf") * (F.log10(c + F.lit(0.5)) - F.lit(below)))), F.lit(0.0)) / rows).alias("base_score"),
        (F.max("bits") * F.lit(-math.log10(2))).alias("score"),
        (F.max("bits") / F.max("n_bytes")).alias("bits_per_byte"),
    )
    keys = named.select(F.col("key").alias(key), "held_out", F.xxhash64("key").alias("ida"), F.xxhash64("body").alias("idb"))
    return keys.join(by, ["ida", "idb"]).select(key, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
