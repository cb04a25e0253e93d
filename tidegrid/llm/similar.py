"""Near-duplicates: SimHash candidates by Golay keys, settled by exact shingle similarity.

Each text has a SimHash of 128 bits over its distinct word shingles. Texts that share
a key of one of six segments and differ in at most ``MOST`` bits are candidates. What
candidates connect forms a neighbourhood. Its texts meet once, however many keys they
share, and are compared by all of their shingles in a flood fill; links at a Jaccard
similarity of 4/5 or more form the groups. A neighbourhood of very many shingles is
cut in chunks, and each pair of chunks meets in a task of its own.

A segment finds a pair if it has two errors at most. At a similarity of exactly 4/5,
where bits differ with probability 0.15, all six miss about one pair in sixteen; the
share falls fast above that, and pairs in one neighbourhood need no key in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, partitions, settled
from .simhash import SIXTHS, components, links, majority, numbers, shingle_hashes

#: Words of a shingle, and the least similarity as a fraction.
WIDTH, PART, WHOLE = 5, 4, 5
#: Candidates differ in so many of 128 bits at most: 3 standard deviations above the mean at a similarity of 4/5.
MOST = 32
#: Shingles of a chunk.
CHUNK = 1 << 21


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; all texts without words are alike."""
    found = np.unique(shingle_hashes(text, width))
    return found if len(found) else np.zeros(1, np.uint64)


def sketch(found: np.ndarray) -> tuple[int, int]:
    """SimHash of 128 bits; the second word is of remixed hashes."""
    other = (found ^ (found >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    other = (other ^ (other >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(found), majority(other ^ (other >> np.uint64(31)))


def alike(overlap, m, n):
    """Whether sets of m and n elements with this overlap have similarity PART / WHOLE or more."""
    return overlap * (PART + WHOLE) >= PART * (m + n)


def sketches(texts: DataFrame) -> DataFrame:
    """(id, place, n, one, two) of (id, place, body): number of distinct shingles and the two words."""
    kind = texts.schema["place"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "body"):
            found = [shingles(t) for t in b.column("body").cast(pa.large_binary()).to_pylist()]
            words = np.array([sketch(f) for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("place"), pa.array([len(f) for f in found], pa.int64()), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], names=["id", "place", "n", "one", "two"])

    return texts.mapInArrow(step, f"id long, place {kind}, n long, one long, two long")


def numbered(rows: DataFrame) -> DataFrame:
    """One more column, node: the number of the fingerprint (one, two) as ``links`` has it."""
    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.stack([b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("one", "two")])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers(fp))], names=[*b.schema.names, "node"])

    return rows.mapInArrow(step, ", ".join([*names, "node long"]))


def flooded(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected among these sets; a set that is reached is compared with all that are not."""
    size = np.array([len(s) for s in sets])
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    links, left, front = [], np.arange(len(sets)), []
    mark = np.zeros(len(kinds), bool)
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            if not len(left):
                break
            flat = np.concatenate([own[i] for i in left])
            start = np.cumsum(size[left]) - size[left]
        now = front.pop()
        mark[own[now]] = True
        hit = alike(np.add.reduceat(mark[flat], start, dtype=np.int64), size[now], size[left])
        mark[own[now]] = False
        if hit.any():
            links += [(int(ids[now]), int(ids[i])) for i in left[hit]]
            front += left[hit].tolist()
            left = left[~hit]
            if not len(left):
                break
            flat = np.concatenate([own[i] for i in left])
            start = np.cumsum(size[left]) - size[left]
    return links


def _flood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of neighbourhoods; comes sorted by (root, lo, hi)."""
    key, ids, sets = None, [], []

    def out() -> pa.RecordBatch:
        found = flooded(np.array(ids), sets)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    for b in blocks(batches, "body"):
        for *k, i, t in zip(*(b.column(c).to_pylist() for c in ("root", "lo", "hi", "id")), b.column("body").cast(pa.large_binary()).to_pylist()):
            if k != key:
                if ids:
                    yield out()
                key, ids, sets = k, [], []
            ids.append(i)
            sets.append(shingles(t))
    if ids:
        yield out()


def least_of_groups(docs: DataFrame, place: str = "place", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row (place) for each group: the least ``place`` of texts that links connect.

    Equal texts (by a 64-bit hash) are collapsed before anything is compared. Null
    texts and texts without words are alike. Rows of equal place and text count once;
    an empty table gives no row.
    """
    n = partitions(docs)
    rows = docs.select(F.xxhash64(text).alias("id"), F.col(place).alias("place"), F.col(text).alias("body"))
    least = settled(numbered(sketches(rows).groupBy("id").agg(F.min("place").alias("place"), F.max("n").alias("n"), F.max("one").alias("one"), F.max("two").alias("two"))))
    near = components(links(least.select("one", "two").distinct(), MOST, SIXTHS))
    named = least.join(near, "node", "left").select("id", "place", "n", F.coalesce("root", "node").alias("root"))
    many = named.groupBy("root").agg(F.count("*").alias("texts"), F.ceil(F.sum("n") / F.lit(chunk)).cast("int").alias("parts")).where("texts > 1")
    met = settled(named.join(many, "root").select("id", "place", "root", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")), least.count())

    # One row for each text, dealt to the pairs of chunks that its own is in.
    texts = rows.join(met, ["id", "place"])
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))).alias("other")
    dealt = texts.select("root", "id", "body", "part", "parts", other).where("parts = 1 or other <> part")
    dealt = dealt.select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "id", "body")
    found = dealt.repartition(n, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(_flood, "a long, b long").distinct()
    roots = components(found)
    return least.join(roots, least.id == roots.node, "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("place").alias("place")).select("place")
