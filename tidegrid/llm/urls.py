"""URL filter: allow and block rules, then a character language-model ratio.

Two smoothed Markov models of variable order, one of accepted URLs and one of
rejected, score a URL by their log-likelihood difference per character. The
threshold is calibrated on labelled URLs that the models haven't seen.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters outside this many kinds share the unknown share of every model.
ALPHABET = 256
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """host/path; fits the host and its subdomains if the path starts with the rule's."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first :// to /, ?, # or end, A-Z lower-cased; path from there to ? or #. Both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))
    return _lower(host), path


def ruled(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest fitting rule's (text, verdict), or null. Of equally long rules the one that sorts first wins."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        chosen = F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, chosen) if out is None else out.when(fits, chosen)
    return out


class Markov:
    """Interpolated character model: each order backs off to the one below by Witten-Bell weights."""

    def __init__(self, texts: list[str], order: int):
        self.order = order
        self.next: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for t in texts:
            t = START * order + t + END
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.next[t[i - k : i]][t[i]] += 1
        self.next = {c: dict(n) for c, n in self.next.items()}
        self.total = {c: sum(n.values()) for c, n in self.next.items()}

    def probability(self, context: str, c: str) -> float:
        p = 1 / ALPHABET
        for k in range(self.order + 1):
            seen = self.next.get(context[self.order - k :])
            if seen is None:
                break
            total = self.total[context[self.order - k :]]
            p = (seen.get(c, 0) + len(seen) * p) / (total + len(seen))
        return p


class Ratio:
    """Accepted against rejected, and the calibrated threshold."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = 4):
        self.order, self.memory = order, {}
        keep = lambda urls: ([u for i, u in enumerate(urls) if i % 4], urls[::4])
        (a, a_held), (r, r_held) = keep(sorted(set(accepted))), keep(sorted(set(rejected)))
        self.accepted, self.rejected = Markov(a, order), Markov(r, order)
        self.threshold = self._calibrated([self.score(u) for u in a_held], [self.score(u) for u in r_held])

    @staticmethod
    def _calibrated(good: list[float], bad: list[float]) -> float:
        """The threshold of greatest balanced accuracy; the middle of the widest best gap."""
        if not good or not bad:
            return 0.0
        marks = sorted([(s, 1) for s in good] + [(s, 0) for s in bad])
        best, at, below_good, below_bad = -1.0, (0.0, 0.0), 0, 0
        edge = [(-math.inf, marks[0][0])]
        for (s, kind), (t, _) in zip(marks, [*marks[1:], (math.inf, 0)]):
            below_good, below_bad = below_good + kind, below_bad + 1 - kind
            edge.append((s, t))
            value = (len(good) - below_good) / len(good) + below_bad / len(bad)
            if value > best or (value == best and t - s > at[1] - at[0] and t < math.inf):
                best, at = value, (s, t)
        return at[0] if at[1] == math.inf else (at[0] + at[1]) / 2

    def score(self, url: str) -> float:
        """Log-likelihood difference per character, the end counted as one."""
        if len(self.memory) > 1_000_000:
            self.memory.clear()
        t, total, memory = START * self.order + url + END, 0.0, self.memory
        for i in range(self.order, len(t)):
            key = t[i - self.order : i + 1]
            d = memory.get(key)
            if d is None:
                context, c = key[:-1], key[-1]
                d = memory[key] = math.log(self.accepted.probability(context, c)) - math.log(self.rejected.probability(context, c))
            total += d
        return total / (len(url) + 1)


def labelled(pages: DataFrame, url: str, rules: tuple[Rule, ...], most: int) -> tuple[list[str], list[str]]:
    """Up to ``most`` distinct URLs of each verdict of the rules, those of least hash."""
    host, path = parts(F.col(url))
    marked = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("u"), ruled(rules, host, path)["verdict"].alias("v")).where("v is not null").distinct()
    out = []
    for verdict in ("allow", "block"):
        rows = marked.where(F.col("v") == verdict).orderBy(F.xxhash64("u"), "u").limit(most).collect()
        out.append([r.u for r in rows])
    return out[0], out[1]


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, order: int = 4, most: int = 20_000) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row.

    The rules' verdict holds where one fits; the others are allowed if their score
    is at or above the calibrated threshold. The models learn from URLs that rules
    judge, a sample bounded by ``most`` for each verdict, so what is broadcast is
    bounded. A null or empty URL has score 0 and is blocked unless a rule allows it;
    repeated rows are judged alike; with no labelled URL, scores are 0 and the
    threshold is 0. An empty table gives an empty result; columns besides key and
    url, whatever their names, aren't read.
    """
    accepted, rejected = labelled(pages, url, rules, most)
    sent = pages.sparkSession.sparkContext.broadcast(Ratio(accepted, rejected, order))  # fitted once
    kind = pages.schema[key].dataType.simpleString()
    host, path = parts(F.col("url"))
    small = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    cut = small.select("key", "url", host.alias("host"), path.alias("path")).withColumn("ruled", ruled(rules, F.col("host"), F.col("path")))
    flat = cut.select("key", "url", "host", "path", F.col("ruled.text").alias("rule"), F.col("ruled.verdict").alias("verdict"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            score = [model.score(u) if u else 0.0 for u in b.column("url").to_pylist()]
            verdict = [v or ("allow" if u and s >= model.threshold else "block") for v, u, s in zip(b.column("verdict").to_pylist(), b.column("url").to_pylist(), score)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("host"), b.column("path"), b.column("rule"), pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=[key, "host", "path", "rule", "verdict", "score"])

    return flat.mapInArrow(step, f"`{key}` {kind}, host string, path string, rule string, verdict string, score double")
