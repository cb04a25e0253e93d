"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks

#: Names of languages a profile set may hold; profiles are then at most this many x 400 rows.
MOST_LANGUAGES = 4096
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text number) of all 1- to 3-grams of all texts.

    Letters are lower-cased, each run of other characters becomes one space, and a
    text is bounded by spaces. An n-gram packs up to three code points of 21 bits;
    a lone space isn't one.
    """
    joined = "\0".join(texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    break_at = code == 0
    if np.count_nonzero(break_at) != len(texts) - 1:  # a text holds U+0000
        return grams([t.replace("\0", " ") for t in texts])
    number = np.cumsum(break_at)
    code = np.where(letters()[code], code, 32)
    keep = (code != 32) | break_at
    keep[1:] |= (code[1:] == 32) & (code[:-1] != 32)
    code, number, break_at = code[keep], number[keep], break_at[keep]
    # A space before the first text and after the last; breaks serve as spaces of both sides.
    code = np.concatenate([[32], code, [32]])
    number = np.concatenate([[0], number, [len(texts) - 1]])
    out, owner = [], []
    one = code != 32
    out.append(code[one])
    owner.append(number[one])
    a, b = code[:-1], code[1:]
    two = (a != 32) | (b != 32)
    # An n-gram that begins with the break before a text belongs to that text: it counts breaks up to itself.
    two_owner = np.where(a != 32, number[:-1], number[1:])
    out.append(((a << 21) | b)[two])
    owner.append(two_owner[two])
    a, b, c = code[:-2], code[1:-1], code[2:]
    three = b != 32
    out.append(((a << 42) | (b << 21) | c)[three])
    owner.append(number[1:-1][three])
    return np.concatenate(out), np.concatenate(owner)


def by_text(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of each text."""
    gram, owner = grams(texts)
    at = np.argsort(owner, kind="stable")
    gram, cuts = gram[at], np.searchsorted(owner[at], np.arange(len(texts) + 1))
    out = []
    for a, b in zip(cuts, cuts[1:]):
        g = np.sort(gram[a:b])
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
        out.append((g[first], np.diff(np.append(first, len(g)))))
    return out


def ranked(gram: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties by n-gram."""
    return gram[np.lexsort((gram, -count))[:most]]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 300) -> DataFrame:
    """(lang, rank, gram): each language's most frequent n-grams over all given rows.

    Rows with a null text or language teach nothing. Workers count by language and
    hand on partial counts; Spark sums them. Ties go to the smaller n-gram.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                g, c = summed(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(c)], names=["lang", "gram", "n"])

        for b in blocks(batches, "body"):
            langs = b.column("lang").to_pylist()
            texts = b.column("body").to_pylist()
            for name in sorted(set(langs)):
                g = np.sort(grams([t for t, x in zip(texts, langs) if x == name])[0])
                first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
                held.setdefault(name, []).append((g[first], np.diff(np.append(first, len(g)))))
                size += len(first)
                if len(held[name]) > 8:
                    size -= sum(len(x) for x, _ in held[name])
                    held[name] = [summed(held[name])]
                    size += len(held[name][0][0])
            if size > 2_000_000:
                yield from flushed()
                held.clear()
                size = 0
        yield from flushed()

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("body"))
    total = known.mapInArrow(step, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return total.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", (F.col("rank") - 1).alias("rank"), "gram")


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g = np.concatenate([x for x, _ in parts])
    c = np.concatenate([x for _, x in parts])
    u, at = np.unique(g, return_inverse=True)
    return u, np.bincount(at, weights=c, minlength=len(u)).astype(np.int64)


class Classifier:
    """Profiles as one table: a row of ranks for each known n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int = 300):
        self.most = most
        self.langs = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(self.langs)}
        self.gram = np.unique(np.array([r[2] for r in rows], np.int64))
        self.rank = np.full((len(self.gram) + 1, len(self.langs)), -1, np.int64)
        for lang, rank, gram in rows:
            self.rank[np.searchsorted(self.gram, gram), place[lang]] = rank

    def judged(self, gram: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        """Nearest language and 1 - distance / greatest possible distance.

        An n-gram that a profile lacks is as far out of place as can be. Ties go to
        the language that sorts first; without letters or profiles: und and 0.
        """
        if not len(gram) or not self.langs:
            return "und", 0.0
        own = ranked(gram, count, self.most)
        at = np.minimum(np.searchsorted(self.gram, own), len(self.gram) - 1)
        at = np.where(self.gram[at] == own, at, len(self.gram))
        rank = self.rank[at]
        place = np.arange(len(own))[:, None]
        distance = np.where(rank < 0, self.most, np.minimum(np.abs(rank - place), self.most)).sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.most * len(own)))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 300) -> list[tuple[str, int, int]]:
    """Profiles of all languages, at most MOST_LANGUAGES x ``most`` rows."""
    rows = profiles(docs, text, lang, most).limit(MOST_LANGUAGES * most + 1).collect()
    if len(rows) > MOST_LANGUAGES * most:
        raise ValueError("too many languages for one set of profiles")
    return [(r.lang, r.rank, r.gram) for r in rows]


def predict(docs: DataFrame, model: list[tuple[str, int, int]], text: str = "text", most: int = 300) -> DataFrame:
    """All columns plus lang_pred and score (0 to 1); columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0. Rows are
    independent. The model's size is bounded (see train), so it is broadcast.
    """
    docs = docs.drop("lang_pred", "score")
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(sent.value, most)
        for b in blocks(batches, text, 1 << 20):
            found = [judge.judged(g, c) for g, c in by_text([t or "" for t in b.column(text).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(step, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double"]))


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a row is kept from training: CRC-32 of its key as text, modulo 3, is 1. A null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): learn from rows not held out, predict all."""
    small = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.col(lang).alias("lang"))
    model = train(small.where(~held_out("key")), "body", "lang")
    return predict(small.select("key", "body", held_out("key").alias("held_out")), model, "body").select(F.col("key").alias(key), "held_out", "lang_pred", "score")
