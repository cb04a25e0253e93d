"""SimHash near-duplicates: fingerprints, Golay-coded keys, verified links, components.

A fingerprint is cut in segments of 21 to 32 bits, and a segment in three blocks.
Where two segments differ in two bits at most, one block is equal in both. The other
two, padded to 23 bits, are decoded by the binary Golay code: every codeword within
distance 4 is a key (six of them, or one). Words at distance two or less share such a
codeword. For if the nearest codeword lies within 2 of one word, it lies within 4 of
the other. If it lies at 3, by three places, then the other places fall into five
fours, each of which leads to a codeword at distance 4; one that holds a changed
place stays within 4.
Fingerprints that share (block, codeword) are compared; links become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, partitions, settled

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, of the perfect Golay code


# --- fingerprints -----------------------------------------------------------------


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle; none without words.

    Words are what white space (20, 09-0D) separates, A-Z lower-cased. A text of
    fewer than ``width`` words, but not none, is one shingle.
    """
    words = b" ".join((text or b"").lower().split())
    if not words:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(words, 42)], np.uint64)
    out = np.empty(n - width + 1, np.uint64)
    digest, begin, end = xxhash.xxh64_digest, np.append(0, gaps + 1), np.append(gaps, len(words))
    for k in range(0, len(out), 1 << 14):  # no more than this many Python objects at once
        z = min(k + (1 << 14), len(out))
        out[k:z] = np.frombuffer(b"".join([digest(words[a:b], 42) for a, b in zip(begin[k:z].tolist(), end[k + width - 1 : z + width - 1].tolist())]), ">u8")
    return out


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 13):
        bits = np.unpackbits(hashes[k : k + (1 << 13)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)  # sums of up to 255 rows fit a byte
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int = 4) -> int:
    """SimHash of the word shingles of a text, repeats included; 0 without words."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit integer. Null text: no words, so 0."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "body"):
            fp = np.fromiter((fingerprint(t, width) if t else 0 for t in b.column("body").cast(pa.large_binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(fp.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(step, f"key {kind}, fp long")


# --- Golay keys -------------------------------------------------------------------


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """(parity of each 12-bit message, error patterns of weight <= 4 for each 11-bit syndrome; -1 fills)."""
    rest = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    single = [int(rest[1 << (b - 11)]) if b >= 11 else 1 << b for b in range(23)]
    found: list[list[int]] = [[] for _ in range(1 << 11)]

    def grow(first: int, pattern: int, syndrome: int, left: int) -> None:
        found[syndrome].append(pattern)
        if left:
            for b in range(first, 23):
                grow(b + 1, pattern | 1 << b, syndrome ^ single[b], left - 1)

    grow(0, 0, 0, 4)
    patterns = np.full((1 << 11, max(map(len, found))), -1, np.int64)
    for s, f in enumerate(found):
        patterns[s, : len(f)] = sorted(f, key=int.bit_count)
    return rest, patterns


#: Segments, as (word of the fingerprint, first bit, end). In halves of 64 bits up to 5 errors leave one half with 2 at most.
HALVES = ((0, 0, 32), (0, 32, 64))
#: Six segments of 128 bits, for pairs that differ in about every seventh bit.
SIXTHS = tuple((w, a, z) for w in (0, 1) for a, z in ((0, 22), (22, 43), (43, 64)))


class Keys:
    """Keys of fingerprints: (segment and exact block of it, bits of the block, codeword of the rest) as one integer."""

    def __init__(self, segments: tuple[tuple[int, int, int], ...] = HALVES):
        self.parity, self.patterns = golay_tables()
        self.plan = []
        for word, a, z in segments:
            cut = [a, a + (z - a + 2) // 3, z - (z - a) // 3, z]
            self.plan += [(word, x, y - x, [i for i in range(a, z) if not x <= i < y]) for x, y in zip(cut, cut[1:])]

    @staticmethod
    def gathered(fp: np.ndarray, bits: list[int]) -> np.ndarray:
        """The bits of fp at the given places (runs of them), packed."""
        out, at = np.zeros(len(fp), np.int64), 0
        while bits:
            n = next((i for i in range(1, len(bits)) if bits[i] != bits[0] + i), len(bits))
            out |= ((fp >> np.uint64(bits[0])) & np.uint64((1 << n) - 1)).astype(np.int64) << at
            at, bits = at + n, bits[n:]
        return out

    def of(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, index of the fingerprint of each). ``fp`` has a row for each word of 64 bits."""
        fp = np.atleast_2d(fp)
        keys, owners = [], []
        for number, (word, a, n, rest) in enumerate(self.plan):
            part = self.gathered(fp[word], rest)
            near = self.patterns[self.parity[part >> 11] ^ (part & 2047)]
            some = near >= 0
            code = (part[:, None] ^ near) >> 11
            exact = self.gathered(fp[word], list(range(a, a + n)))
            owner, place = np.nonzero(some)
            keys.append((np.int64(number) << 25) | (exact[owner] << 12) | code[owner, place])
            owners.append(owner)
        return np.concatenate(keys), np.concatenate(owners)


# --- links within a key -----------------------------------------------------------

#: Comparisons of one vectorised step.
AREA = 1 << 20


def close(fp: np.ndarray, now: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """Which of ``now`` and ``left`` differ in ``most`` bits or fewer, as a matrix."""
    apart = np.bitwise_count(fp[0, now][:, None] ^ fp[0, left][None, :])
    for word in fp[1:]:
        apart += np.bitwise_count(word[now][:, None] ^ word[left][None, :])
    return apart <= most


def spanning(fp: np.ndarray, most: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Indices of links that connect what is connected at ``most`` bits or fewer.

    Flood fill: all of the frontier is compared with what is not reached yet, so a
    dense group costs about its size and no list of all pairs arises. ``known``
    numbers parts that are connected already; links are then only between parts.
    """
    fp = np.atleast_2d(fp)
    links, left = [], np.arange(fp.shape[1])
    if known is not None:
        return _across(fp, most, known)
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, AREA // len(left))
            now, front = front[:step], front[step:]
            near = close(fp, now, left, most)
            hit = near.any(axis=0)
            if hit.any():
                links += zip(now[near[:, hit].argmax(axis=0)].tolist(), left[hit].tolist())
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return links


def _across(fp: np.ndarray, most: int, part: np.ndarray) -> list[tuple[int, int]]:
    """One link between each two parts that have one, found part by part."""
    links, left, order = [], np.arange(fp.shape[1]), np.argsort(part, kind="stable")
    members = dict(zip(*(lambda u, f: (u.tolist(), np.split(order, f[1:])))(*np.unique(part[order], return_index=True))))
    while len(left):
        front = members[int(part[left[0]])]
        left = left[part[left] != part[left[0]]]
        while len(front) and len(left):
            step = max(1, AREA // len(left))
            now, front = front[:step], front[step:]
            near = close(fp, now, left, most)
            hit = near.any(axis=0)
            if hit.any():
                fresh, first = np.unique(part[left[hit]], return_index=True)
                links += zip(now[near[:, hit].argmax(axis=0)][first].tolist(), left[hit][first].tolist())
                front = np.concatenate([front, *(members[int(p)] for p in fresh)])
                left = left[~np.isin(part[left], fresh)]
    return links


def numbers(fp: np.ndarray) -> np.ndarray:
    """One signed integer for each fingerprint: itself if it is one word, else a hash of its words."""
    fp = np.atleast_2d(fp)
    out = fp[0].copy()
    for word in fp[1:]:
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + word
    return out.view(np.int64)


class Forest:
    """What a task's links connect (union-find)."""

    #: Nodes held at once; then their links are given and the task begins anew.
    MOST = 1 << 18

    def __init__(self):
        self.up: dict[int, int] = {}

    def least(self, x: int) -> int:
        up, root = self.up, x
        while (above := up.setdefault(root, root)) != root:
            root = above
        while x != root:
            x, up[x] = up[x], root
        return root

    def add(self, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for one, two in found:
            for a, b in zip(one.tolist(), two.tolist()):
                a, b = self.least(a), self.least(b)
                if a != b:
                    self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """One link for each node but the least of each part; forgets all."""
        pairs = np.array([(self.least(x), x) for x in self.up], np.int64).reshape(-1, 2)
        self.up = {}
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return [(pairs[:, 0], pairs[:, 1])]


_LINK = "a long, b long"
_CHUNK = "key long, part int, fps array<long>"
#: Runs of so many are compared many runs at a time.
SMALL = 16
#: One fingerprint in so many tells which keys are crowded; that decides how they are dealt, not what is found.
SAMPLE = 64


def links(distinct: DataFrame, most: int = 4, segments: tuple[tuple[int, int, int], ...] = HALVES, chunk: int = 1 << 15) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints of ``distinct``, whose columns are their words.

    a and b are ``numbers``. A dense group meets in many keys; a task joins what its
    keys connect and gives one link a fingerprint, to the least that it is connected
    with, so the links of a group are at most its size times the tasks. Keys are dealt by value and sorted, and each key's run is
    read as a stream. A key that a sample shows to be crowded is dealt in salted
    parts. A run of more than ``chunk`` fingerprints is closed in chunks. Chunks and
    parts of one key are then paired, each pair in a group of its own, so a task holds
    two chunks at most and no pair of fingerprints goes uncompared.
    """
    n, words = partitions(distinct), distinct.columns
    w = len(words)

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in words])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Keys(segments)
        for b in batches:
            whole = matrix(b)
            for k in range(0, b.num_rows, 1024):
                fp = whole[:, k : k + 1024]
                key, owner = make.of(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(x[owner].view(np.int64)) for x in fp)], names=["key", *words])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, part, forest = [], None, 0, Forest()

        def size() -> int:
            return sum(x.shape[1] for x in held)

        for b in batches:
            keys, salts, fps = *(b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt")), matrix(b)
            if not len(keys):
                continue
            edge = np.flatnonzero((np.diff(keys) != 0) | (np.diff(salts) != 0)) + 1
            runs = np.concatenate([[0], edge, [len(keys)]])
            many, calm = np.diff(runs), salts[runs[:-1]] < 0
            calm[[0, -1]] = False  # these may go on in another batch
            found, chunks = _small(fps, runs[:-1], np.where(calm, many, 0), most), []
            for r in np.flatnonzero(~calm | (many > SMALL)).tolist():
                run, now = fps[:, runs[r] : runs[r + 1]], (int(keys[runs[r]]), int(salts[runs[r]]))
                if now != key:
                    if held:
                        _closed(held, key, part, most, found, chunks, True)
                    held, key, part = [], now, 0
                held.append(run)
                while size() > chunk:
                    rest = np.concatenate(held, axis=1)
                    _closed([rest[:, :chunk]], key, part, most, found, chunks, False)
                    held, part = [rest[:, chunk:]], part + 1
            forest.add(found)
            yield from _emit(forest.links() if len(forest.up) > Forest.MOST else [], chunks)
        found, chunks = [], []
        if held:
            _closed(held, key, part, most, found, chunks, True)
        forest.add(found)
        yield from _emit(forest.links(), chunks)

    kind = ", ".join(f"{c} long" for c in words)
    # The sum by fingerprint may leave few partitions, and one row becomes some dozens.
    rows = distinct.repartition(n).mapInArrow(keyed, f"key long, {kind}")
    few = distinct.where(F.pmod(F.xxhash64(*words), F.lit(SAMPLE)) == 0).repartition(n).mapInArrow(keyed, f"key long, {kind}")
    crowded = few.groupBy("key").count().where(F.col("count") > chunk // SAMPLE).select("key", (F.col("count") * F.lit(2 * SAMPLE / chunk)).cast("int").alias("parts"))
    crowded = settled(crowded.coalesce(-(-n // SAMPLE)))
    if crowded.isEmpty():
        rows = rows.withColumn("salt", F.lit(-1))
    else:
        rows = rows.join(crowded, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*words), F.col("parts") + 1).cast("int"), F.lit(-1))).drop("parts")
    dealt = rows.select("key", "salt", *words).repartition(n, "key", "salt").sortWithinPartitions("key", "salt")
    first = settled(dealt.mapInArrow(closed, f"{_LINK}, {_CHUNK}"))
    return first.where("key is null").select("a", "b").union(_between(first.where("key is not null").select("key", "part", "fps"), most, w, n)).distinct()


def _small(fp: np.ndarray, start: np.ndarray, many: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of 2 to SMALL fingerprints: all there are, or, if all are linked, those of the first."""
    found, name = [], numbers(fp)
    for g in np.unique(many[(many > 1) & (many <= SMALL)]).tolist():
        i, j = np.triu_indices(g, 1)
        first = start[many == g][:, None]
        apart = np.zeros((len(first), len(i)), np.uint8)
        for word in fp:
            apart += np.bitwise_count(word[first + i] ^ word[first + j])
        near = apart <= most
        near[near.all(axis=1)] = i == 0
        row, pair = np.nonzero(near)
        found.append((name[first[row, 0] + i[pair]], name[first[row, 0] + j[pair]]))
    return found


def _closed(held: list[np.ndarray], key: tuple[int, int], part: int, most: int, found: list, chunks: list, last: bool) -> None:
    """Links of one chunk; the chunk itself too if its key has more of them."""
    fp = np.concatenate(held, axis=1)
    if fp.shape[1] > 1:
        name, linked = numbers(fp), spanning(fp, most)
        if linked:
            i, j = np.array(linked).T
            found.append((name[i], name[j]))
    if key[1] >= 0 or part or not last:
        chunks.append((key[0], (key[1] + 1 << 16) + part, fp.ravel()))


def _emit(found: list[tuple[np.ndarray, np.ndarray]], chunks: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Links without repeats, then chunks."""
    names = ["a", "b", "key", "part", "fps"]
    one, two = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    if len(one):
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
        n = len(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], names=names)
    for key, part, fps in chunks:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key], pa.int64()), pa.array([part], pa.int32()), pa.array([fps.view(np.int64)], pa.list_(pa.int64()))], names=names)


def _between(chunks: DataFrame, most: int, words: int, n: int) -> DataFrame:
    """Links between the chunks of one key. Each chunk's own links are known."""
    names = chunks.select("key", "part")
    pairs = names.join(names.select("key", F.col("part").alias("later")), "key").where("part < later").repartition(n, "key", "part", "later")
    pairs = pairs.join(chunks, ["key", "part"]).join(chunks.select("key", F.col("part").alias("later"), F.col("fps").alias("more")), ["key", "later"]).select("fps", "more")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one, two = (np.asarray(b.column(c)[k].values).view(np.uint64).reshape(words, -1) for c in ("fps", "more"))
                both = np.concatenate([one, two], axis=1)
                part = np.concatenate([_parts(one, most), one.shape[1] + _parts(two, most)])
                name = numbers(both)
                found = [(name[i], name[j]) for i, j in spanning(both, most, part)]
                yield pa.RecordBatch.from_arrays([pa.array([int(min(x)) for x in found], pa.int64()), pa.array([int(max(x)) for x in found], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(step, _LINK)


def _parts(fp: np.ndarray, most: int) -> np.ndarray:
    part = np.arange(fp.shape[1])
    for i, j in spanning(fp, most):  # flood order: i is reached before j
        part[j] = part[i]
    return part


# --- components -------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes with an edge.

    Alternating large-star and small-star steps. A node's least neighbour comes from
    a hash aggregate (combined before the shuffle) and is joined back; the join's
    rows of one hub can be split (adaptive skew joins). Each step is cut by a
    checkpoint, so each join runs once, and the one before is removed; its files are as
    many as the edges call for, not as the shuffle's partitions. It is done when the
    edges are stars: no node is on both sides, and none has two roots.
    """
    now = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    many = now.count()
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = settled(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), many)
        discard(now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.explode(F.array(*(F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "uv"))).alias("edge")
        now = settled(large.join(least, "u").select(moved).select("edge.*").where("u <> v").distinct(), many)
        discard(large)
        sides = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(now.select("v", F.lit(0), F.lit(1)))
        if sides.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
    raise RuntimeError("components did not settle")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, most: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) for every row.

    component_id is the least key that is reachable over links of ``most`` bits or
    fewer, the row's own included. Equal fingerprints are collapsed before anything
    is compared, so copies cost nothing. Rows without words (null and empty texts
    too) have fingerprint 0 and link like any other; null keys are never a
    component's id unless it has no other; repeated rows stay repeated. An empty
    table gives an empty result; other columns, whatever their names, aren't read.
    """
    fps = settled(fingerprints(docs, key, text, width))
    distinct = fps.groupBy("fp").agg(F.min("key").alias("least"))
    if most > 5:
        raise ValueError("the keys find links of up to 5 bits")
    roots = components(links(distinct.select("fp"), most))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(ids, "root").select("fp", "component_id")
    return fps.join(names, "fp").select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
