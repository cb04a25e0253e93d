"""BPE encoding by speculate and verify, and decoding.

Greedy longest match proposes tokens for every new word of a block; one
vectorised check tests all adjacent pairs of all proposals; a proposal is the BPE
result exactly if every pair is one that merging its own bytes would leave
alone. Words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks

_NEVER = 1 << 40
_FAR = np.int64(_NEVER)
#: Longer words are merged with a heap.
SHORT_WORD = 48
#: The vocabulary's split, for any text and for ASCII.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\v\f\r a-z0-9]+")
#: Below U+0378 every code point is assigned.
_HIGH = re.compile("[^\x00-\u0377]")
#: Words that a worker remembers; beyond that it starts anew.
CACHE_WORDS = 250_000


def byte_letters() -> list[str]:
    """Byte-level alphabets write printable bytes as themselves, and the others as U+0100 and on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Model:
    """Tables of a word-end BPE file: symbols, merges and each token's last merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.text = [""] * self.size
        for s, i in [*vocab.items(), *self.special.items()]:
            self.text[i] = s
        self.merge = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            joined = vocab.get(a + b)
            if joined is not None:
                self.merge.setdefault((vocab[a], vocab[b]), (rank, joined))
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        place = {c: b for b, c in enumerate(letters)}
        self.near = {(a << 32) | b: rank for (a, b), (rank, _) in self.merge.items()}
        self.joined = {rank: made for rank, made in self.merge.values()}
        keys = np.array([*self.near], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        self.inside: dict[bytes, int] = {}
        self.ending: dict[bytes, int] = {}
        for s, i in vocab.items():
            end = s.endswith(self.suffix)
            spelled = bytes(place[c] for c in (s[: -len(self.suffix)] if end else s))
            ids, last = self.merged(spelled, end)
            if ids == [i]:  # a token that merging can reach
                (self.ending if end else self.inside)[spelled] = i
                if last:
                    self.left[i], self.right[i] = last
                    self.rank[i] = self.merge[last][0]
        self.longest = max(map(len, self.inside))
        self.longest_ending = max(map(len, self.ending), default=0)

    def merged(self, word: bytes, end: bool = True) -> tuple[list[int], tuple[int, int] | None]:
        """Exact merging: the least rank first, from the left; also the last merge made."""
        ids = [self.inner[b] for b in word]
        if end and word:
            ids[-1] = self.final[word[-1]]
        if len(ids) <= SHORT_WORD:
            return self._merged_short(ids)
        n, merge, last = len(ids), self.merge, None
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            last = (a, b)
            ids[i], ids[j] = merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0], last

    def _merged_short(self, ids: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """The same over plain lists, which is quicker while a word is short."""
        get, joined, last = self.near.get, self.joined, None
        ranks = [get((a << 32) | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < _NEVER:
            i = ranks.index(least)
            last = (ids[i], ids[i + 1])
            ids[i : i + 2] = [t := joined[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((t << 32) | ids[i + 1], _NEVER)
            if i:
                ranks[i - 1] = get((ids[i - 1] << 32) | t, _NEVER)
        return ids, last

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(word)
        inside, ending, longest, last = self.inside, self.ending, self.longest, self.longest_ending
        most = max(longest, last)
        while True:
            rest = word[at : at + most] if n > most else word[at:] if at else word
            if n - at <= last and (t := ending.get(rest)) is not None:
                out.append(t)
                return out
            for k in range(min(longest, n - at - 1), 0, -1):
                if (t := inside.get(rest[:k])) is not None:
                    break
            out.append(t)
            at += k

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging would keep each pair apart.

        Walks back in time: the later of the two tokens is undone, until both are
        single symbols. No pair across the border may have a rank that comes before
        the merge that ended it; at equal rank the left one comes first.
        """
        ok = np.ones(len(one), bool)
        live, x, y = np.arange(len(one)), one.astype(np.int64), two.astype(np.int64)
        limit = np.full(len(one), _FAR)
        while len(live):
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            rank = np.where(self.pair_key[at] == key, self.pair_rank[at], _FAR)
            bad = rank < limit
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            undo = rx > ry
            limit = np.where(undo, rx, ry + 1)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return ok

    def encoded(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Token ids of each word, and how many had to be merged exactly."""
        found = [self.proposed(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(found)), size)
        joint = owner[1:] == owner[:-1]
        bad = np.unique(owner[1:][joint][~self.compatible(flat[:-1][joint], flat[1:][joint])])
        for i in bad:
            found[i] = self.merged(words[i])[0]
        return found, len(bad)


def _unassigned() -> regex.Pattern:
    """Code points that this Python's tables don't know; the installed library may know more or fewer."""
    ranges, begin = [], None
    for c in range(0x110001):
        new = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if new and begin is None:
            begin = c
        elif not new and begin is not None:
            ranges.append(f"\\U{begin:08X}-\\U{c - 1:08X}")
            begin = None
    return re.compile(f"[{''.join(ranges)}]")


class Codec:
    """A worker's encoder and decoder with its memory of words."""

    def __init__(self, model: Model, path: str):
        self.model, self.path = model, path
        self.known: dict[str, bytes] = {}
        self.unknown, self.library = _unassigned(), None
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None
        self.strings = np.array(model.text, object)

    def words(self, text: str) -> list[str]:
        """Normal form C, lower case letter by letter, split; special tokens stand for themselves."""
        if self.marks and "<|" in text:
            parts = self.marks.split(text)
            if len(parts) > 1:
                return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return _SPLIT_ASCII.findall(text.lower())
        if _HIGH.search(text) and self.unknown.search(text):
            return self._by_library(text)
        return _SPLIT.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes_of[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in cut]

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        special = self.model.special
        plain = [w for w in new if w not in special]
        ids, _ = self.model.encoded([w.encode("utf-8", "surrogateescape") for w in plain])
        self.known.update(zip(plain, (np.array(i, "<u4").tobytes() for i in ids)))
        self.known.update((w, np.array([special[w]], "<u4").tobytes()) for w in new if w in special)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.words(t) if t else [] for t in texts]
        fresh = set().union(*cut) - self.known.keys()
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = set().union(*cut)
        self.learn(sorted(fresh))
        known = self.known
        return [b"".join(map(known.__getitem__, w)) for w in cut]

    def decode(self, ids: bytes | None) -> str:
        """Tokens as the vocabulary writes them, joined by spaces. Ids without a token are left out."""
        n = np.frombuffer(ids or b"", "<u4")
        if len(n) and n.max() >= self.model.size:
            n = n[n < self.model.size]
        return " ".join(self.strings[n].tolist())


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def sent_model(spark: SparkSession, path: str):
    """Broadcast tables; their size is the vocabulary's, a few MB."""
    return spark.sparkContext.broadcast(model(path))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns plus ``ids`` (binary, little-endian unsigned 32-bit integers).

    Null and empty texts have no ids. A column named like ``ids`` is replaced.
    Rows are independent: repeats give repeats, an empty table an empty one.
    """
    return _mapped(docs.drop(ids), path, text, ids, "binary", lambda codec, column: pa.array(codec.encode(column.to_pylist()), pa.binary()))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns plus ``text`` from ids; null ids give the empty text."""
    return _mapped(df.drop(text), path, ids, text, "string", lambda codec, column: pa.array([codec.decode(x) for x in column.to_pylist()], pa.string()))


def _mapped(df: DataFrame, path: str, source: str, out: str, kind: str, make) -> DataFrame:
    sent, names = sent_model(df.sparkSession, path), df.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, path)
        for b in blocks(batches, source):
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), make(codec, b.column(source))], names=[*names, out])

    return df.mapInArrow(step, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{out}` {kind}"]))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), and ids if kept: encode and decode in one pass.

    Null and empty texts have no tokens; null keys and repeated rows stay.
    """
    sent = sent_model(docs.sparkSession, path)
    kept = ["ids"] if keep_ids else []

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value, path)
        for b in blocks(batches, "body"):
            ids = codec.encode(b.column("body").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(codec.decode(i).encode()).hexdigest() for i in ids]), *([pa.array(ids, pa.binary())] if kept else [])],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256", *kept],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(step, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids binary' if kept else ''}")
