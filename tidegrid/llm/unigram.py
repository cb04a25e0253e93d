"""Token counts of a unigram vocabulary by dynamic programming over a trie of words.

Distinct words go into a trie. A node's forward score, the best sum of piece scores
that spells the way from the root, depends on its ancestors only, so words with a
common prefix share that work; a node where a word ends keeps its token count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks

MARK = "▁"
_WORD = re.compile(r"[^\t\n\v\f\r ]+")
#: A worker's memory of words; beyond it a new trie begins.
MOST_NODES = 400_000
#: Longer words share no prefix worth keeping; they are scored by themselves, in a window of the longest piece.
LONG = 4_096


class Vocabulary:
    """Pieces and their scores; a character that no piece spells falls back to its UTF-8 bytes."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.byte_score = byte_score
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        # Pieces by their last character and then backwards, so that a node looks only at ways that lead on.
        self.back: dict = {}
        for piece, score in scores.items():
            at = self.back
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[""] = score


def from_file(path: str) -> Vocabulary:
    """Ordinary pieces of a sentencepiece file.

    A rank-scored (BPE) file has scores -rank; those become the logarithm of Zipf's
    law over ranks, log(1 / (rank + 1)), so that scores add as log probabilities do.
    A byte is worth as little as the last rank twice over.
    """
    import math

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
    ranked = all(r >= 0 and r == int(r) for r in rank.values())
    scores = {p: -math.log(r + 1) if ranked and r < 1e8 else (-math.log(1e9) if ranked else -r) for p, r in rank.items()}
    return Vocabulary(scores, -2 * math.log(n + 1))


class Trie:
    """Nodes in the order of their making: parent, character, forward score, tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.child: list[dict[str, int]] = [{}]
        self.parent, self.letter = [-1], [""]
        self.score, self.tokens = [0.0], [0]
        self.ends: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Tokens of the best segmentation; of equal scores, the one of fewer tokens."""
        known = self.ends.get(word)
        if known is not None:
            return known
        if len(word) > LONG:
            self.ends[word] = self._alone(MARK + word)
            return self.ends[word]
        child, at = self.child, 0
        for c in MARK + word:
            to = child[at].get(c)
            if to is None:
                to = self._grow(at, c)
            at = to
        self.ends[word] = self.tokens[at]
        return self.tokens[at]

    def _alone(self, text: str) -> int:
        """The same scores without nodes."""
        width = self.vocabulary.longest + 1
        score, tokens = [0.0] * width, [0] * width
        for i, c in enumerate(text):
            n = len(c.encode("utf-8", "surrogatepass"))
            best, fewest = score[i % width] + n * self.vocabulary.byte_score, tokens[i % width] + n
            way, j = self.vocabulary.back.get(c), i
            while way is not None:
                gain = way.get("")
                if gain is not None:
                    s, t = score[j % width] + gain, tokens[j % width] + 1
                    if s > best or (s == best and t < fewest):
                        best, fewest = s, t
                if j == 0:
                    break
                j -= 1
                way = way.get(text[j])
            score[(i + 1) % width], tokens[(i + 1) % width] = best, fewest
        return tokens[len(text) % width]

    def _grow(self, at: int, c: str) -> int:
        parent, letter, score, tokens = self.parent, self.letter, self.score, self.tokens
        n = len(c.encode("utf-8", "surrogatepass"))
        best, fewest = score[at] + n * self.vocabulary.byte_score, tokens[at] + n
        way, node, x = self.vocabulary.back.get(c), at, c
        while way is not None:
            gain = way.get("")
            if gain is not None:
                s, t = score[node] + gain, tokens[node] + 1
                if s > best or (s == best and t < fewest):
                    best, fewest = s, t
            if node == 0:
                break
            x = letter[node]
            way, node = way.get(x), parent[node]
        new = len(self.child)
        self.child.append({})
        self.child[at][c] = new
        parent.append(at)
        letter.append(c)
        score.append(best)
        tokens.append(fewest)
        return new


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns plus n_words and n_tokens (long); columns of these names are replaced.

    Words are what ASCII white space separates, each with a word mark in front. Null
    and empty texts have none. Rows are independent; each worker keeps one trie and
    starts anew when it has MOST_NODES nodes; a word of more than LONG characters is
    scored outside the trie.
    """
    docs = docs.drop("n_words", "n_tokens")
    sent, names = docs.sparkSession.sparkContext.broadcast(from_file(path)), docs.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        for b in blocks(batches, text):
            words = [_WORD.findall(t) if t else [] for t in b.column(text).to_pylist()]
            for w in sorted(set().union(*words) - trie.ends.keys()):
                trie.count(w)
            ends = trie.ends
            total = [sum(map(ends.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([len(w) for w in words], pa.int64()), pa.array(total, pa.int64())], names=[*names, "n_words", "n_tokens"])
            for w in [w for w in ends if len(w) > LONG]:
                del ends[w]
            if len(trie.child) > MOST_NODES:
                trie = Trie(sent.value)

    return docs.mapInArrow(step, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words long, n_tokens long"]))
