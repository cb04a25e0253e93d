"""Exact substring dedup with a logarithmic family of suffix arrays.

A byte goes if a string of ``width`` bytes over it also starts anywhere else. Each
string has one anchor: of its ``gram``-byte substrings the one with the least hash
(leftmost if equal), so equal strings have equal anchors at equal places. A text
thus splits its strings into short runs, one for each anchor.

1. Runs are dealt and sorted by (anchor, bytes of the run). Anchors that occur once
   are done. A run whose bytes occur again is repeated as a whole; where that shows
   within a block of texts already, only one of the copies is dealt by its anchor.
2. Where an anchor has several different runs, one of each kind enters the index of
   its partition. New batches get a suffix array, are merge-scanned against the
   levels there are, and join them; levels of equal size merge, so there are few.
   Anchors with very many kinds of runs, as at the edge of a passage that a great
   part of all texts share, would fill a partition: their strings are dealt one by
   one, by their hash, to the same indexes.
3. Repeated strings are joined back to their texts, which lose those bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bytes, blocks, partitions, settled

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Windows that one vectorised step covers.
SEGMENT = 1 << 19
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """64-bit hashes of substrings of a buffer, to choose anchors by; unequal strings may share one."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])

    def fixed(self, n: int) -> np.ndarray:
        """Hashes of all substrings of n bytes."""
        h = (self.total[n:] - self.total[:-n]) * self.down[: len(self.total) - n]
        h = (h ^ (h >> np.uint64(33))) * _MIX[0]
        h = (h ^ (h >> np.uint64(29))) * _MIX[1]
        return h ^ (h >> np.uint64(32))


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if n > size else h


def runs_of(data: np.ndarray, start: np.ndarray, width: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """(text number, first string, last string, anchor hash, hash of the run's bytes and place), strings by place in their text."""
    out, last_start = [], len(data) - width
    for s in range(0, last_start + 1, SEGMENT):
        part = data[s : min(s + SEGMENT + width - 1, len(data))]
        h = Rolling(part).fixed(gram)
        place = np.arange(len(h), dtype=np.uint64)
        anchor = (least_of((h & ~np.uint64((1 << 24) - 1)) | place, width - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        at = np.arange(len(anchor)) + s
        text = np.searchsorted(start, at, "right") - 1
        inside = at + width <= start[text + 1]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor)) - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        a, t = anchor[first], text[first]
        whole, digest = part.tobytes(), xxhash.xxh3_64_digest
        at, begin, end = a.tolist(), first.tolist(), (last + width).tolist()
        # Anchors and runs are told apart by sound hashes; the rolling one only chooses anchors.
        name = np.frombuffer(b"".join([digest(whole[x : x + gram]) for x in at]), ">u8").astype(np.uint64)
        run = np.frombuffer(b"".join([digest(whole[y:z], x - y) for x, y, z in zip(at, begin, end)]), ">u8").astype(np.uint64)
        base = s - start[t]
        out.append((t, first + base, last + base, name, run))
    return out


# --- the index family -------------------------------------------------------------


class Family:
    """Suffix arrays, by bytes, of strings of ``width`` bytes, in levels whose sizes double.

    A level holds its strings in byte order, with their first 8 bytes at hand. A new
    batch is sorted, and merge-scanned against itself and the levels there are: strings
    that share their first 8 bytes are merged by the next ones, and so on; neighbours
    that match in all of ``width`` bytes are repeated. Levels of equal size then merge.
    """

    def __init__(self, width: int):
        self.width = width
        self.steps = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
        self.text = np.zeros(8, np.uint8)
        self.used = 0
        self.at = np.zeros(0, np.int64)  # place in text of each string
        self.repeated = np.zeros(0, bool)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, pieces: list[bytes]) -> np.ndarray:
        """Take in one batch; number of its first string and of each piece's."""
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(size) - size
        many = np.maximum(0, size - self.width + 1)
        place = np.arange(int(many.sum())) + np.repeat(begin - (np.cumsum(many) - many), many)
        base, old = len(self.at), self.used
        if self.used + len(joined) > len(self.text):
            self.text = np.concatenate([self.text[: self.used], np.zeros(max(self.used, len(joined)), np.uint8)])
        self.text[old : old + len(joined)] = joined
        self.used += len(joined)
        self.at = np.concatenate([self.at, place + old])
        self.repeated = np.concatenate([self.repeated, np.zeros(len(place), bool)])
        if len(place):
            self._insert(np.arange(base, base + len(place)))
        return base + np.cumsum(many) - many

    def _insert(self, fresh: np.ndarray) -> None:
        level = self._merged(self._words(fresh, 0), fresh)
        for key, ref in self.levels.values():
            here, there = np.isin(level[0], key), np.isin(key, level[0])
            if here.any():
                self._merged(np.concatenate([level[0][here], key[there]]), np.concatenate([level[1][here], ref[there]]))
        rank = 0
        while rank in self.levels:
            key, ref = self.levels.pop(rank)
            level = self._merged(np.concatenate([key, level[0]]), np.concatenate([ref, level[1]]))
            rank += 1
        self.levels[rank] = level

    def _words(self, ref: np.ndarray, step: int) -> np.ndarray:
        """Eight bytes of each string as a number that orders as they do."""
        whole = np.ndarray(len(self.text) - 7, ">u8", self.text, strides=(1,))
        return whole[self.at[ref] + step].astype(np.uint64)

    def _merged(self, key: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strings in byte order (two runs in order are merged, by a stable sort); marks those that match throughout."""
        order = np.argsort(key, kind="stable")
        key, ref = key[order], ref[order]
        equal = key[1:] == key[:-1]  # of each string and the next, as far as compared
        settled = self._settled(ref, equal)
        equal &= ~settled
        for step in self.steps[1:]:
            if not equal.any():
                break
            tied = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
            at = np.flatnonzero(tied)
            group = np.cumsum(~np.concatenate([[False], equal])[at])
            now = self._words(ref[at], step)
            order = np.lexsort((now, group))
            ref[at], now = ref[at[order]], now[order]
            same = np.concatenate([(now[1:] == now[:-1]) & (group[1:] == group[:-1]), [False]])
            equal[at[:-1]] = same[:-1]
        at = np.flatnonzero(equal | settled)
        self.repeated[ref[at]] = True
        self.repeated[ref[at + 1]] = True
        return key, ref

    def _settled(self, ref: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Neighbours in groups whose strings all match throughout; these need no more sorting."""
        live = pairs = np.flatnonzero(equal)
        for step in self.steps[1:]:
            live = live[self._words(ref[live], step) == self._words(ref[live + 1], step)]
        whole = np.zeros(len(equal), bool)
        whole[live] = True
        group = np.cumsum(np.concatenate([[True], ~equal]))[:-1]
        mixed = np.zeros(len(equal) + 2, bool)
        mixed[group[pairs[~whole[pairs]]]] = True
        return whole & ~mixed[group]


# --- the operator -----------------------------------------------------------------

#: copies: 1 if the block has more of this run. khash is null in those; they are settled, and dealt evenly.
_RUN = "khash long, rhash long, ida long, idb long, first int, last int, copies int, deal long"
#: kind 1: repeated as a whole; 2: to be searched; 3: repeated as a whole, and others may match parts of it.
_KIND = "ida long, idb long, first int, last int, khash long, kind int"
_PIECE = "khash long, ida long, idb long, first int, kind int, piece binary"


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (khash, rhash), as a stream: those of anchors that occur again, with their kinds.

    Only the first row of the run that is still open is held back, with the number
    of its copies and whether its anchor had another run before, so memory doesn't
    depend on how often an anchor occurs.
    """
    fields = ("khash", "rhash", "ida", "idb", "first", "last", "copies")
    held, before = None, False
    for b in batches:
        settled_rows = b.filter(b.column("khash").is_null())
        if settled_rows.num_rows:
            c = {f: settled_rows.column(f).to_numpy(zero_copy_only=False) for f in ("ida", "idb", "first", "last")}
            yield from _kinds(c | {"khash": np.zeros(settled_rows.num_rows, np.int64)}, np.ones(settled_rows.num_rows, np.int32))
            b = b.filter(b.column("khash").is_valid())
        c = {f: b.column(f).to_numpy(zero_copy_only=False) for f in fields}
        if held is not None:
            c = {f: np.concatenate([held[f], c[f]]) for f in fields}
        n = len(c["khash"])
        if not n:
            continue
        other = c["khash"][1:] != c["khash"][:-1]
        begin = np.flatnonzero(np.concatenate([[True], other | (c["rhash"][1:] != c["rhash"][:-1])]))
        size = np.diff(np.append(begin, n)) + np.add.reduceat(c["copies"], begin)
        after_own = np.concatenate([[before], ~other[begin[1:] - 1]])  # the run before has the same anchor
        several = after_own | np.append(after_own[1:], False)
        kind = np.ones(n, np.int32)  # a row after the first of its run is a copy
        kind[begin] = np.where(size > 1, np.where(several, 3, 1), np.where(several, 2, 0))
        open_at = begin[-1]
        kind[open_at] = 0
        yield from _kinds(c, kind)
        held, before = {f: v[open_at : open_at + 1].copy() for f, v in c.items()}, bool(after_own[-1])
        held["copies"][0] = min(1, int(size[-1]) - 1)
    if held is not None:
        copies = held["copies"][0]
        yield from _kinds(held, np.array([(3 if before else 1) if copies else 2 if before else 0], np.int32))


def _kinds(c: dict, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(kind)
    if len(at):
        names = ["ida", "idb", "first", "last", "khash"]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[f][at]) for f in names), pa.array(kind[at])], names=[*names, "kind"])


def repeats(docs: DataFrame, width: int = 200, gram: int = 40, batch: int = 1 << 18, pieces_in_task: int = 8000, hot: int = 20_000) -> DataFrame:
    """(ida, idb, first, last): places of strings of ``width`` bytes that start elsewhere too.

    ``docs`` has ida, idb (the identity of a row) and text. An anchor of more than
    ``hot`` kinds of runs is hot; no string goes unsearched either way.
    """
    n = partitions(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", SEGMENT):
            texts = Bytes(b.column("text"))
            ida, idb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ida", "idb"))
            for t, first, last, k, r in runs_of(texts.data, texts.start, width, gram):
                order = np.lexsort((r, k))
                k, r, t, first, last = k[order], r[order], t[order], first[order], last[order]
                lead = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, bool)
                more = lead & ~np.append(lead[1:], True)
                place = (idb[t].view(np.uint64) + first.astype(np.uint64) * _MIX[0]) * _MIX[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k.view(np.int64), mask=~lead), pa.array(r.view(np.int64)), pa.array(ida[t]), pa.array(idb[t]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(np.where(lead, k, place).view(np.int64))],
                    names=["khash", "rhash", "ida", "idb", "first", "last", "copies", "deal"],
                )

    runs = docs.select("ida", "idb", "text").mapInArrow(cut, _RUN)
    found = settled(runs.repartition(n, "deal").sortWithinPartitions("khash", "rhash").mapInArrow(_classified, _KIND))
    searched = found.where("kind > 1")
    many = searched.count()
    crowded = settled(searched.groupBy("khash").count().where(F.col("count") > hot).select("khash"))
    some_hot = not crowded.isEmpty()

    def held(asked: DataFrame) -> DataFrame:
        wanted = asked.groupBy("ida", "idb").agg(F.collect_list(F.struct("khash", "first", "last", "kind")).alias("wanted"))
        return docs.select("ida", "idb", "text").join(wanted.hint("shuffle_hash"), ["ida", "idb"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", SEGMENT):
            rows = []
            for ida, idb, text, asked in zip(b.column("ida").to_pylist(), b.column("idb").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), b.column("wanted").to_pylist()):
                rows += [(w["khash"], ida, idb, w["first"], w["kind"], text[w["first"] : w["last"] + width]) for w in asked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["khash", "ida", "idb", "first", "kind", "piece"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", SEGMENT):
            for ida, idb, text, asked in zip(b.column("ida").to_pylist(), b.column("idb").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), b.column("wanted").to_pylist()):
                for w in asked:
                    at = np.arange(w["first"], w["last"] + 1, dtype=np.int32)
                    each = [text[i : i + width] for i in at.tolist()]
                    deal = np.frombuffer(b"".join([xxhash.xxh3_64_digest(x) for x in each]), ">i8").astype(np.int64)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(np.full(n, ida)), pa.array(np.full(n, idb)), pa.array(at), pa.array(np.full(n, w["kind"], np.int32)), pa.array(each, pa.binary())], names=["khash", "ida", "idb", "first", "kind", "piece"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, taken, waiting, size = Family(width), [], [], 0

        def enter() -> None:
            nonlocal waiting, size
            numbers = family.add([w[3] for w in waiting])
            taken.extend((ida, idb, first, int(m), len(p) - width + 1) for (ida, idb, first, p, kind), m in zip(waiting, numbers) if kind == 2)
            waiting, size = [], 0

        for b in batches:
            for ida, idb, first, kind, piece in zip(*(b.column(c).to_pylist() for c in ("ida", "idb", "first", "kind", "piece"))):
                waiting.append((ida, idb, first, piece, kind))
                size += len(piece) - width + 1
                if size >= batch:
                    enter()
        if waiting:
            enter()
        rows = []
        for ida, idb, first, m, many in taken:
            mark = family.repeated[m : m + many]
            if mark.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mark, [False]])))
                rows += [(ida, idb, first + int(x), first + int(y) - 1) for x, y in zip(edge[::2], edge[1::2])]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows[k : k + 10_000]), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["ida", "idb", "first", "last"])

    calm = searched.join(crowded, "khash", "left_anti") if some_hot else searched
    sent = held(calm).mapInArrow(pieces, _PIECE)
    if some_hot:
        sent = sent.union(held(searched.join(crowded, "khash", "left_semi")).mapInArrow(strings, _PIECE))
    dealt = sent.repartition(max(n, -(-many // pieces_in_task)), "khash")
    return found.where("kind <> 2").select("ida", "idb", "first", "last").union(dealt.mapInArrow(search, "ida long, idb long, first int, last int"))


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(ida, idb, text, key): a row's identity is the hash of its key and that of its text.

    Rows of equal key and text share it; they are copies of each other, and get the same result.
    """
    return docs.select(F.xxhash64(F.col(key)).alias("ida"), F.xxhash64(F.col(text)).alias("idb"), F.col(text).alias("text"), F.col(key).alias("key"))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 200, gram: int = 40, as_text: bool = False, **tuning) -> DataFrame:
    """(key, kept, n_bytes, spans): each text's bytes without repeated strings.

    spans are the maximal removed runs, as [first, last) bytes. Null and empty texts
    and those of fewer than ``width`` bytes keep all they have; null keys and
    repeated rows stay (repeated rows are copies, so their strings go). Strings are
    judged on the input. An empty table gives an empty result; columns besides key
    and text, whatever their names, aren't read. Removal may cut a character in two, so ``kept`` is
    binary; with ``as_text`` it is text without such parts of characters.
    """
    known = identified(docs, key, text)
    gone = repeats(known, width, gram, **tuning).groupBy("ida", "idb").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    joined = known.select("ida", "idb", "text", "key").join(gone.hint("shuffle_hash"), ["ida", "idb"], "left").select("key", "text", "gone")
    kind = docs.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            kept, sizes, spans = [], [], []
            for t, g in zip(b.column("text").cast(pa.large_binary()).to_pylist(), b.column("gone").to_pylist()):
                t = t or b""
                out: list[list[int]] = []
                for a, z in sorted((x["first"], x["last"] + width) for x in g or ()):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], z)
                    else:
                        out.append([a, z])
                edge = [0, *(x for pair in out for x in pair), len(t)]
                kept.append(b"".join(t[a:z] for a, z in zip(edge[::2], edge[1::2])))
                sizes.append(len(t))
                spans.append([{"first": a, "last": z} for a, z in out])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], names=[key, "kept", "n_bytes", "spans"])

    return joined.mapInArrow(step, f"`{key}` {kind}, kept {'string' if as_text else 'binary'}, n_bytes long, spans array<struct<first:long,last:long>>")
