"""Each operator against a brute-force version, and its defined results for odd inputs."""

import hashlib
import math
import pickle
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

from tidegrid.llm import bpe, common, decontam, langid, mixing, ogg, queries, shards, simhash, suffix, unigram, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.table(spark, sf_dir, "documents").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids, ties, repeated rows, very long and exotic texts."""
    long = " ".join(f"wörd{i % 977} x" for i in range(40_000))
    texts = [(1, "Hello World's <|endoftext|> hello"), (2, None), (3, ""), (None, "no id here at all"), (None, None), (4, "same same"), (4, "same same"), (5, long), (6, "  \t\n "), (7, "日本語 テキスト 😀\x1c\x85 ΣΑΣ"), (8, "a\x00b"), (9, "x" * 500), (10, "x" * 500), (11, "123 456 !!!")]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", None) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with further columns that are named like results and helpers."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("?") for c in ("key", "ids", "score", "n_words", "item_ids", "hit_runs", "fp", "ida", "idb", "body", "shard", "slot", "kept", "media", "n_tokens", "lang_pred", "size", "held_out")})


# --- 1 ----------------------------------------------------------------------------


def slow_fingerprint(text: bytes) -> int:
    w = WS.findall(text.lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(fps)]


def _sorted(found):
    return sorted(found, key=repr)


def test_simhash_groups(docs, rows):
    wanted = slow_groups([(d, slow_fingerprint(t.encode())) for d, t in rows])
    assert _sorted(tuple(r) for r in simhash.groups(docs).collect()) == _sorted(wanted)


def test_simhash_odd(odd, none):
    texts = [(r.doc_id, slow_fingerprint((r.text or "").encode())) for r in odd.collect()]
    assert _sorted(tuple(r) for r in simhash.groups(clashing(odd)).collect()) == _sorted(slow_groups(texts))
    assert simhash.groups(none).collect() == []


@pytest.mark.parametrize("chunk, sample", [(1 << 15, 64), (5, 64), (5, 1)])
def test_links_connect_dense_groups(spark, monkeypatch, chunk, sample):
    """A large group of near copies, chains, runs longer than a chunk, and crowded keys in salted parts."""
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)}
    chain = rng.getrandbits(64)
    for _ in range(20):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 4, chunk=chunk)).collect()}
    got = Counter(roots.get(f, f) for f in signed)
    wanted = Counter(c for _, _, c in slow_groups([(i, f) for i, f in enumerate(fps)]))
    assert sorted(got.values()) == sorted(wanted.values())


@pytest.mark.parametrize("errors", [1, 2, 3, 4, 5])
def test_golay_keys_meet_within_five_bits(errors):
    rng = np.random.default_rng(errors)
    one = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    two = one ^ np.array([sum(1 << int(b) for b in rng.choice(64, errors, replace=False)) for _ in range(3000)], np.uint64)
    keys = simhash.Keys()
    sets = []
    for fp in (one, two):
        k, owner = keys.of(fp)
        sets.append(set(zip(owner.tolist(), k.tolist())))
    assert {o for o, _ in sets[0] & sets[1]} == set(range(3000))


def test_wide_keys_meet_if_a_segment_has_two_errors():
    rng = np.random.default_rng(7)
    one = rng.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    two = one ^ rng.integers(0, 2**64, (2, 3000), dtype=np.uint64)
    word, a, z = simhash.SIXTHS[4]
    inside = np.uint64(((1 << z) - 1) ^ ((1 << a) - 1))
    flips = np.array([sum(1 << int(b) for b in rng.choice(np.arange(a, z), 2, replace=False)) for _ in range(3000)], np.uint64)
    two[word] = (two[word] & ~inside) | (one[word] & inside) ^ flips
    keys = simhash.Keys(simhash.SIXTHS)
    sets = [set(zip(o.tolist(), k.tolist())) for k, o in (keys.of(one), keys.of(two))]
    assert {o for o, _ in sets[0] & sets[1]} == set(range(3000))


# --- 2 ----------------------------------------------------------------------------


def test_ogg_round_trip(docs, rows):
    texts = dict(rows)
    for r in ogg.features(ogg.to_media(docs)).collect():
        t = texts[r.key].encode()
        p = t + b"\0" * (max(64, -(-len(t) // 64) * 64) - len(t))
        assert (r.ok, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (True, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_ogg_odd(odd, none, spark):
    found = ogg.features(ogg.to_media(clashing(odd))).collect()
    assert len(found) == 14 and all(r.ok for r in found)
    assert len({r.media_sha256 for r in found if r.n_bytes == 0}) == 1 and {r.payload_bytes for r in found if r.n_bytes == 0} == {64}
    assert ogg.to_media(none).collect() == []
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "key long, media binary")
    assert [(r.ok, r.payload_bytes) for r in ogg.features(bad).collect()] == [(False, 0)] * 2


def slow_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)
            crc &= 0xFFFFFFFF
    return crc


def test_ogg_pages():
    assert ogg.checksum(b"OggS example") == slow_crc(b"OggS example")
    packets = [(b"h" * 30, 0), (b"a" * 200_000, 10), (b"", 11), (b"b" * 510, 12), (b"c" * 254, 20)]
    other = [(b"other", 0), (b"z" * 70_000, 5)]
    data = ogg.interleave([ogg.stream_pages(7, packets), ogg.stream_pages(9, other)])
    got = ogg.read(b"noise" + data)
    assert got.skipped_bytes == 5 and not got.bad_pages and set(got.streams) == {7, 9}
    assert got.streams[7].packets == [p for p, _ in packets] and got.streams[9].packets == [p for p, _ in other]
    assert got.streams[7].began and got.streams[7].ended and not got.streams[7].gaps
    assert [g for g in got.streams[7].granules if g >= 0][-1] == 20 and ogg.seconds(got.streams[9], 10)[-1] == 0.5
    hurt = bytearray(data)
    hurt[data.index(b"a" * 100) + 5] ^= 1
    got = ogg.read(bytes(hurt))
    assert got.bad_pages == 1 and got.streams[7].gaps == 1 and got.streams[9].packets == [p for p, _ in other]
    assert b"a" * 200_000 not in got.streams[7].packets and got.streams[7].packets[-1] == b"c" * 254


# --- 3 ----------------------------------------------------------------------------


def slow_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for r in urls.RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best and best.verdict


ODD_URLS = ["http://a.org", "https://X.Example.ORG/en/12?q", "ftp://com/fr/a#b", "no scheme", "", None, "http://evilorg/", "http://u:p@b.org:80/x", "http://a.com/de/://x", "://com/fr/", "http://a.com?x=/fr/", "http://é.org/\n/x", "http://example.org/en/1"]


def test_url_rules(spark, sf_dir):
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    odd = spark.createDataFrame([(-i - 1, u) for i, u in enumerate(ODD_URLS)], "page_id long, url string")
    both = pages.union(odd)
    by = {r.page_id: r.url for r in both.collect()}
    found = urls.judge(clashing(both)).collect()
    assert len(found) == len(by)
    for r in found:
        host, path, rule, verdict = slow_rule(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    assert {r.verdict for r in found if not by[r.page_id]} == {"block"}
    assert urls.judge(odd.limit(0)).collect() == []


def test_url_model_tells_kinds_apart():
    good = [f"https://news.site{i}.example/story/{i}" for i in range(80)]
    bad = [f"http://win-casino{i}.example/bonus?id={i}" for i in range(80)]
    model = urls.Ratio(good[:60], bad[:60])
    assert all(model.score(u) >= model.threshold for u in good[60:]) and all(model.score(u) < model.threshold for u in bad[60:])
    m = urls.Markov(["abc", "abd"], 2)
    assert sum(m.probability("ab", chr(c)) for c in range(256)) == pytest.approx(1)
    assert m.probability("ab", "c") > m.probability("ab", "z") > 0


# --- 4 ----------------------------------------------------------------------------


def slow_dedup(texts, width=200):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + width
                else:
                    spans.append([i, i + width])
        edge = [0, *(x for s in spans for x in s), len(t)]
        out.append((len(t), len(spans), b"".join(t[a:z] for a, z in zip(edge[::2], edge[1::2]))))
    return out


def check_dedup(frame, width=200, **tuning):
    given = [(r.doc_id, (r.text or "").encode()) for r in frame.collect()]
    wanted = [(d, *x) for (d, _), x in zip(given, slow_dedup([t for _, t in given], width))]
    got = [(r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix.cleaned(clashing(frame), width=width, **tuning).collect()]
    assert _sorted(got) == _sorted(wanted)


def test_suffix_dedup(docs):
    check_dedup(docs)


def test_suffix_dedup_odd(odd, none, spark):
    check_dedup(odd)
    check_dedup(odd, 20, gram=5)
    assert suffix.cleaned(none).collect() == []


@pytest.mark.parametrize("tuning", [{}, {"batch": 7, "pieces_in_task": 3}, {"hot": 0}, {"hot": 4}])
def test_suffix_dedup_of_dense_repeats(spark, tuning):
    """Small alphabets, periods and shared passages: many levels, ties of hashes, overlaps."""
    rng = random.Random(5)
    shared = "".join(rng.choice("abcd") for _ in range(90))
    texts = []
    for i in range(60):
        a, z = sorted(rng.sample(range(90), 2))
        texts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + shared[a:z] + "".join(rng.choice("abé") for _ in range(rng.randint(0, 30))))
    texts += ["ab" * 50, "ab" * 49 + "c", "a" * 70, shared, shared]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    check_dedup(frame, 20, gram=6, **tuning)


def test_suffix_dedup_of_texts_that_rolling_hashes_confuse(spark):
    """Thue-Morse words, whose polynomial hashes modulo 2**64 agree, and periods."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rng = random.Random(6)
    noise = ["".join(rng.choices("cdefg", k=150)) for _ in range(6)]
    texts = [noise[0] + word[:1024] + noise[1], noise[2] + other[:1024] + noise[3], noise[4] + word[:300], "xy" * 300, noise[5] + "yx" * 120 + noise[0]]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    check_dedup(frame)
    check_dedup(frame, hot=0)


def test_levels_are_in_byte_order():
    rng = random.Random(3)
    family = suffix.Family(30)
    for _ in range(8):
        family.add([bytes(rng.choices(b"ab", k=200))])
    for key, ref in family.levels.values():
        strings = [family.text[family.at[r] : family.at[r] + 30].tobytes() for r in ref.tolist()]
        assert strings == sorted(strings) and key.tolist() == [int.from_bytes(s[:8]) for s in strings]


def test_family_levels_grow_geometrically():
    rng = random.Random(1)
    family, pieces = suffix.Family(10), [bytes(rng.choices(b"ab", k=40)) for _ in range(37)]
    first = [int(family.add([p])[0]) for p in pieces]
    assert sorted(family.levels) == [i for i in range(8) if 37 >> i & 1]
    seen = Counter(p[i : i + 10] for p in pieces for i in range(31))
    for p, at in zip(pieces, first):
        assert [bool(x) for x in family.repeated[at : at + 31]] == [seen[p[i : i + 10]] > 1 for i in range(31)]


# --- 5 ----------------------------------------------------------------------------


def slow_count(v, word):
    w = unigram.MARK + word
    best = [(0.0, 0)]
    for j in range(1, len(w) + 1):
        n = len(w[j - 1].encode())
        ways = [(best[j - 1][0] + n * v.byte_score, best[j - 1][1] - n)]
        ways += [(best[i][0] + v.scores[w[i:j]], best[i][1] - 1) for i in range(max(0, j - v.longest), j) if w[i:j] in v.scores]
        best.append(max(ways))
    return -best[-1][1]


def test_token_counts(docs, rows, odd, none, monkeypatch):
    v = unigram.from_file(queries.pieces())
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in unigram.count_tokens(docs.select("doc_id", "text"), queries.pieces()).collect()}
    for d, t in rows[:60]:
        words = unigram._WORD.findall(t)
        assert got[d] == (len(words), sum(slow_count(v, w) for w in words))
    found = unigram.count_tokens(clashing(odd), queries.pieces()).collect()
    assert [(r.n_words, r.n_tokens) for r in found if not (r.text or "").strip(" \t\n")] == [(0, 0)] * 4
    assert next(r.n_tokens for r in found if r.doc_id == 7) == sum(slow_count(v, w) for w in unigram._WORD.findall(next(r.text for r in found if r.doc_id == 7)))
    assert unigram.count_tokens(none, queries.pieces()).collect() == []


def test_trie_shares_prefixes():
    v = unigram.Vocabulary({"▁a": -1.0, "b": -1.0, "▁ab": -2.0, "c": -3.0}, -10.0)
    t = unigram.Trie(v)
    assert t.count("ab") == 1  # of equal scores the fewer tokens
    before = len(t.child)
    assert t.count("abc") == 2 and len(t.child) == before + 1 and t.count("é") == 3 + 2


# --- 6 ----------------------------------------------------------------------------

_ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_leaks(texts, items):
    low = lambda t: _ITEM_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for name, t in items:
        w = low(t)
        for k in range(max(1, len(w) - 9) if w and name is not None else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(name))
    out = []
    for t in texts:
        w = low(t)
        hit, found = [0] * len(w), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= names
                    hit[k : k + size] = [1] * size
        out.append((len(w), sum(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [32 << 20, 3000])
def test_leaks(docs, rows, spark, sf_dir, block_bytes):
    bench = common.table(spark, sf_dir, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    wanted = {d: x for (d, _), x in zip(rows, slow_leaks([t for _, t in rows], items))}
    found = decontam.find_leaks(clashing(docs), bench, block_bytes=block_bytes).withColumn("hit", decontam.hit_words()).collect()
    assert {r.doc_id: (r.n_words, r.hit, r.item_ids) for r in found} == wanted and any(x[1] for x in wanted.values())


def test_leaks_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "Hello"), (2, "same SAME"), (3, None), (None, "here"), (4, "..."), (5, "wörd1 x wörd2 x wörd3 x wörd4 x wörd5 x wörd6"), (5, "hello"), (6, "hello")], "item_id long, text string")
    items = [(r.item_id, r.text) for r in bench.collect()]
    given = odd.collect()
    found = decontam.find_leaks(odd, bench).withColumn("hit", decontam.hit_words()).collect()
    assert [(r.n_words, r.hit, r.item_ids) for r in found] == slow_leaks([r.text for r in given], items)
    assert decontam.find_leaks(none, bench).collect() == []
    assert {r.n_words for r in decontam.find_leaks(odd, bench.limit(0)).collect() if r.text is None} == {0}


def test_index_is_flat():
    """4 MB of items of random words take a fixed multiple of their text, pickled too, and are found."""
    rng = random.Random(12)
    items = [(str(i), " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(200)).encode()) for i in range(3300)]
    size = sum(len(t) for _, t in items)
    index = decontam.Index(items)
    assert 4_000_000 < size and len(pickle.dumps(index, 5)) < 9 * size
    texts = [items[7][1][300:700].decode(), "a b c", items[3000][1].decode()]
    count, runs, found = index.scan(common.Bytes(pa.array(texts)))
    assert found == [["7"], [], ["3000"]] and runs[2] == [(0, 200)] and count.tolist() == [len(t.split()) for t in texts]


# --- 7 ----------------------------------------------------------------------------


def check_base(frame):
    given = [(r.doc_id, (r.text or "").encode().lower().split()) for r in frame.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    train = [w for d, w in given if not held(d)]
    c = Counter(x for w in train for x in w)
    n = sum(c.values()) + len(train)
    below = math.log10(n + 0.5 * (len(c) + bool(train) + 1))
    base = lambda w: sum(math.log10(c[x] + 0.5) - below for x in w) + math.log10(len(train) + 0.5) - below
    wanted = [(d, held(d), len(w) + 1, sum(x in c for x in w) + bool(train), n, round(base(w), 6)) for d, w in given]
    found = mixing.score(clashing(frame), coded=5000, held=300).collect()
    assert _sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == _sorted(wanted)
    return found


def test_mixing(docs):
    found = check_base(docs)
    assert all(r.score < 0 for r in found)
    seen = [r for r in found if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)
    assert max(r.bits_per_byte for r in found if r.n_tokens > 50) < 8


def test_mixing_odd(odd, none):
    found = check_base(odd)
    same = [r.score for r in found if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert mixing.score(none).collect() == []


def test_code_and_mixture_are_probabilities():
    words = [(f"w{i}".encode(), 50 - i) for i in range(40)]
    code = mixing.Code([w for w, _ in words], [c for _, c in words], 1200, 10)
    for tree in code.trees:
        assert sum(2.0 ** -float(n) for n in tree.length) == pytest.approx(1)
    # Of two texts that differ in one bit of a byte the model's shares for that bit add up to one.
    tables = [np.zeros(1 << mixing.SLOT_BITS, np.int16)] * 3
    for one, two in ((0, 1), (39, code.end)):
        each = [mixing.bits_of(code.trees[0], mixing.Channel(np.array([w]), np.zeros(1, np.int64), [np.zeros(1, np.uint64)] * 3), tables, 1)[0] for w in (one, two)]
        assert all(x > 0 for x in each)
    every = [mixing.bits_of(code.trees[0], mixing.Channel(np.array([w]), np.zeros(1, np.int64), [np.zeros(1, np.uint64)] * 3), tables, 1)[0] for w in range(code.end + 1)]
    assert sum(2.0**-x for x in every) == pytest.approx(1, abs=1e-5)


def slow_bits(code, tables, text):
    """Bit by bit: the mix, its refinement, and what both learn after each chunk."""
    total, half = 0.0, len(mixing.CONTEXTS[0])

    def chance(x):
        return 1 / (1 + math.exp(-max(-12.0, min(12.0, x))))

    for tree, channel, part in zip(code.trees, mixing.Tokens(code, pa.array([text])).channels, (tables[:half], tables[half:])):
        weight, slope, offset = [mixing.START] * 4, 1.0, 0.0
        for a in range(0, len(channel.symbol), mixing.CHUNK):
            seen = []
            for k in range(a, min(a + mixing.CHUNK, len(channel.symbol))):
                _, path, bits, slots = channel.slots(tree, np.array([k]))
                for i, bit in enumerate(bits.tolist()):
                    x = [float(tree.odds[path[i]]), *(int(t[s[i]]) / 256 for t, s in zip(part, slots))]
                    mix = sum(w * v for w, v in zip(weight, x))
                    final = chance(slope * mix + offset)
                    total -= math.log2(final if bit else 1 - final)
                    seen.append((x, bit - chance(mix), mix, bit - final))
            rate = mixing.RATE / math.sqrt(len(seen))
            weight = [w + rate * sum(s[0][i] * s[1] for s in seen) for i, w in enumerate(weight)]
            slope += 0.1 * rate * sum(s[2] * s[3] for s in seen)
            offset += 0.1 * rate * sum(s[3] for s in seen)
    return total


def test_scores_bit_by_bit(spark, docs, monkeypatch):
    """Counters by dictionaries, and the model by plain loops, against the operator's scores."""
    kept = {}
    real = mixing.counters
    monkeypatch.setattr(mixing, "counters", lambda train, sent: kept.setdefault("tables", (real(train, sent), sent.value))[0])
    few = docs.where("doc_id < 60")
    found = {r.doc_id: r for r in mixing.score(few).collect()}
    tables, code = kept["tables"]
    given = [(r.doc_id, r.text) for r in few.collect()]
    count = [Counter() for _ in mixing.TABLES]
    train = [t or "" for d, t in given if not found[d].held_out]
    known = list(code.ids)[: code.coded]
    spelled = mixing.spelling(known, np.zeros(len(known), np.int64), np.full(len(known), mixing.MARKERS))
    for c, (tree, channel) in enumerate([*((i % 2, x) for t in train for i, x in enumerate(mixing.Tokens(code, pa.array([t])).channels)), (1, spelled)]):
        which, tree = tree, code.trees[tree]
        _, path, bits, slots = channel.slots(tree, slice(None))
        for j, slot in enumerate(slots):
            count[3 * which + j].update(zip(slot.tolist(), bits.tolist()))
    for table, counts in zip(tables, count):
        seen = {s for s, _ in counts}
        assert all(table[s] == mixing.odds(np.array([counts[s, 0]]), np.array([counts[s, 1]]))[0] for s in seen)
        assert len(np.unique(table[np.setdiff1d(np.arange(len(table)), list(seen))])) == 1
    for d, t in given:
        assert found[d].score == pytest.approx(-slow_bits(code, tables, t or "") * math.log10(2), rel=1e-3)


def test_each_symbol_is_learnt_before_the_next():
    """A word that comes again costs less, however short the text is; texts among others of any length score as alone."""
    rng = np.random.default_rng(9)
    code = mixing.Code([f"w{i}".encode() for i in range(40)], [50 - i for i in range(40)], 1200, 10)
    none = [np.zeros(1 << mixing.SLOT_BITS, np.int16)] * 3
    again = [mixing.bits_of(code.trees[0], mixing.Channel(np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(n, np.uint64)] * 3), none, 1)[0] for n in (1, 2, 3)]
    assert again[2] - again[1] < again[1] - again[0] < again[0]
    tables = [rng.integers(-900, 900, 1 << mixing.SLOT_BITS).astype(np.int16) for _ in mixing.TABLES]
    given = [" ".join(f"w{i}" if i < 40 else "x" * (i - 39) for i in rng.integers(0, 44, n)) for n in [0, 1, 700, 20_000, *range(2, 120)]]
    found = mixing.total_bits(code, tables, mixing.Tokens(code, pa.array(given)), len(given))
    for k in (0, 1, 2, 3, 50):
        assert mixing.total_bits(code, tables, mixing.Tokens(code, pa.array(given[k : k + 1])), 1)[0] == pytest.approx(found[k], rel=1e-12)


def test_long_texts_wait_for_others(spark, monkeypatch):
    """A long text doesn't take steps of its own, and scores as without others; equal rows and what is known of each stay together."""
    rng = np.random.default_rng(3)
    given = [" ".join(f"w{i}" for i in rng.integers(0, 60, n)) for n in [0, 3, 30, 40, 50, 900, 800, 700, 60, 650, 2]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*given, given[5], None])], "doc_id long, text string").coalesce(1)

    def scored():
        return {r.doc_id: tuple(r) for r in mixing.score(docs).collect()}

    most = max(len(t.encode()) for t in given)
    monkeypatch.setattr(mixing, "SCORED", most)
    monkeypatch.setattr(mixing, "LONG", 100)
    found = scored()
    monkeypatch.setattr(mixing, "LONG", 1 << 30)  # none waits
    alone = scored()
    assert sorted(found) == list(range(13)) and found[5][3:] == found[11][3:]
    for d, row in alone.items():
        assert found[d] == pytest.approx(row, rel=1e-12)

    calls, real = [], mixing.bits_of
    code = mixing.Code([f"w{i}".encode() for i in range(60)], [90 - i for i in range(60)], 3000, 10)
    monkeypatch.setattr(mixing, "bits_of", lambda tree, channel, tables, texts: calls.append(texts) or real(tree, channel, tables, texts))
    held, tables = mixing.Waiting(), [np.zeros(1 << mixing.SLOT_BITS, np.int16) for _ in mixing.TABLES]
    for k in (5, 6, 7):
        tokens = mixing.Tokens(code, pa.array(["w1 w2", given[k]]))
        held.add(tuple(c.part(np.array([1])) for c in tokens.channels), [np.array([k])])
    which, bits = held.scored(code, tables)
    assert calls == [3, 3] and which.tolist() == [5, 6, 7] and not held.blocks
    for k, x in zip((5, 6, 7), bits):
        assert x == pytest.approx(mixing.total_bits(code, tables, mixing.Tokens(code, pa.array([given[k]])), 1)[0], rel=1e-12)


def test_the_longest_texts_wait_for_the_last():
    """Few texts that are longer than all others aren't scored with each lot of them, but once, and as alone."""
    rng = np.random.default_rng(4)
    code = mixing.Code([f"w{i}".encode() for i in range(60)], [90 - i for i in range(60)], 3000, 10)
    tables = [rng.integers(-900, 900, 1 << mixing.SLOT_BITS).astype(np.int16) for _ in mixing.TABLES]
    given = [" ".join(f"w{i}" for i in rng.integers(0, 70, n)) for n in (30, 900, 40, 0, 50, 60, 700, 35, 800, 45)]
    held, found = mixing.Waiting(), {}
    for k in (0, 5):
        held.add(mixing.Tokens(code, pa.array(given[k : k + 5])).channels, [np.arange(k, k + 5)])
        found |= dict(zip(*(x.tolist() for x in held.scored(code, tables, 2))))
        assert len(found) == (3, 8)[k > 0] and max(len(given[i]) for i in found) < (200, 3000)[k > 0]
    assert 1 not in found and 8 not in found
    which, bits = held.scored(code, tables)
    assert which.tolist() == [1, 8] and not held.blocks
    for k, x in (found | dict(zip(which.tolist(), bits.tolist()))).items():
        assert x == pytest.approx(mixing.total_bits(code, tables, mixing.Tokens(code, pa.array(given[k : k + 1])), 1)[0], rel=1e-12)


def test_a_path_has_few_lines_of_a_table():
    """Of a symbol's bits, each SPAN in turn have slots of one line, and all slots differ; other contexts have other lines."""
    code = mixing.Code([f"w{i}".encode() for i in range(4000)], [9000 // (i + 1) + 2 for i in range(4000)], 90_000, 10)
    context = np.random.default_rng(5).integers(0, 1 << 60, 4000).astype(np.uint64)
    channel = mixing.Channel(np.arange(4000), np.zeros(4000, np.int64), [context] * 3)
    many, _, _, slots = channel.slots(code.trees[0], slice(None))
    assert many.max() > 10
    for k in (0, 17, 3999):
        part = slots[0][many[:k].sum() : many[: k + 1].sum()].astype(int)
        lines = [set((part[i : i + mixing.SPAN] >> mixing.SPAN).tolist()) for i in range(0, len(part), mixing.SPAN)]
        assert all(len(x) == 1 for x in lines) and len(set(part.tolist())) == len(part)
    first = slots[0][np.cumsum(many) - many]
    assert len(np.unique(first >> mixing.SPAN)) > 3800 and len(np.unique(first & ((1 << mixing.SPAN) - 1))) == 1 << mixing.SPAN


def test_held_out_texts_score_above_the_base(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    held = [r for r in mixing.score(docs).where("held_out").collect()]
    assert len(held) == 2027 and sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)


def test_very_long_words(spark):
    """Words without a break: time in proportion to their length, and the same counts as through the trie."""
    model, vocabulary = bpe.model(queries.word_bpe()), unigram.from_file(queries.pieces())
    word = "".join(random.Random(8).choice("abcdeth") for _ in range(20_000))
    trie = unigram.Trie(vocabulary)
    at = 0
    for c in unigram.MARK + word[:6_000]:
        at = trie._grow(at, c)
    assert trie.count(word[:6_000]) == trie.tokens[at] and len(trie.child) == 6_002
    began = time.process_time()
    model.proposed(word.encode() * 20)
    assert time.process_time() - began < 10


# --- 8 ----------------------------------------------------------------------------


def slow_shard(key, node):
    while node.children:
        u = lambda c: (int(hashlib.md5(f"{key}|{c.name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        node = min(node.children, key=lambda c: (-math.log(u(c)) / c.total, c.name))
    return node.shard


def test_shards(docs, rows):
    a, b = shards.tree(40), shards.tree(41, built=40)
    found = shards.assign(clashing(docs), a, b, blocks=3).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 16, zlib.crc32(t), "key")
        assert r.shard == slow_shard(r.doc_id, a) and r.grown_shard == slow_shard(r.doc_id, b) and r.grown_shard in (r.shard, 40)
    for s in range(40):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_odd(odd, none):
    found = shards.assign(odd, shards.tree(7, racks=1, per_rack=3)).collect()
    assert len(found) == 14 and {r.grown_shard for r in found} == {None} and len({r.shard for r in found if r.doc_id == 4}) == 1
    assert {(r.size, r.text_crc32) for r in found if r.doc_id in (2, 3)} == {(16, 0)}
    assert len({(r.shard, r.slot) for r in found}) == 14
    assert shards.assign(none, shards.tree(4)).collect() == []


def test_weights_move_rows_only_into_the_changed_subtree(spark):
    """A heavier shard takes rows into its region; rows elsewhere stay or come in."""
    from dataclasses import replace

    old = shards.tree(12, racks=2, per_rack=3)
    region, other = old.children
    rack = region.children[0]
    heavy = replace(rack, children=(replace(rack.children[0], weight=4.0), *rack.children[1:]))
    new = replace(old, children=(replace(region, children=(heavy, region.children[1])), other))
    where = lambda n: {r.doc_id: r.shard for r in shards.assign(spark.range(3000).selectExpr("id AS doc_id", "'' AS text"), n).collect()}
    before, after = where(old), where(new)
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(after[k] < 6 for k in moved if before[k] >= 6) and all(after[k] < 6 for k in moved)
    assert sum(v == 0 for v in after.values()) > 2 * sum(v == 0 for v in before.values())


# --- 9 ----------------------------------------------------------------------------


def slow_grams(text):
    s = re.sub(r"[^\w]|[\d_]", " ", text.lower())
    s = "".join(c if c.isalpha() else " " for c in s)
    s = " " + re.sub(" +", " ", s).strip(" ") + " "
    return Counter(g for n in (1, 2, 3) for i in range(len(s) - n + 1) if (g := s[i : i + n]) != " " and (n < 3 or g[1] != " ") and g.strip())


def test_grams():
    texts = ["Ab, c", "x", "", "Élan 12 vital", "--", "a  b"]
    for t, (g, c) in zip(texts, langid.by_text(texts)):
        spell = lambda x: "".join(chr(x >> 21 * k & 0x1FFFFF) for k in (2, 1, 0)).lstrip("\0")
        got = {spell(int(x)): int(n) for x, n in zip(g, c)}
        assert got == dict(slow_grams(t)) if any(ch.isalpha() for ch in t) else got == {}


def test_language_id(docs):
    by = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(clashing(docs).drop("held_out")).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == len(by) and held and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.lang_pred == by[r.doc_id] for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in found)


def test_language_id_odd(odd, none, spark):
    found = langid.identify(odd).collect()
    assert len(found) == 14 and {r.lang_pred for r in found if r.doc_id in (2, 3, 6, 11)} == {"und"}
    assert langid.identify(none).collect() == [] and {r.lang_pred for r in langid.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).where("false")).collect()} == set()
    unlabelled = spark.createDataFrame([(1, "some words", None, None, None)], DOCS)
    assert langid.identify(unlabelled).first().lang_pred == "und"


# --- 10 ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_bpe())


def slow_bpe(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    packed = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe(docs, rows, library):
    found = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(docs, queries.word_bpe()).collect()}
    assert found == {d: slow_bpe(library, t) for d, t in rows}


def test_bpe_odd(odd, none, library):
    path = queries.word_bpe()
    assert _sorted(tuple(r) for r in bpe.round_trip(clashing(odd), path).collect()) == _sorted((r.doc_id, *slow_bpe(library, r.text)) for r in odd.collect())
    coded = bpe.decode(bpe.encode(clashing(odd), path), path).collect()
    assert [r.decoded for r in coded] == [library.decode(library.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in coded]
    assert bpe.round_trip(none, path).collect() == []


def test_bpe_fuzz(library):
    rng = random.Random(2)
    codec = bpe.Codec(bpe.model(queries.word_bpe()), queries.word_bpe())
    letters = "abcdefghijklmnopqrstuvwxyzABΣİıéÉ '’ſßǅ<|> 0129٣,.;!?\x1c\x85　中字😀👍🏽ᲉꟋ\n\t́"
    texts = ["".join(rng.choice(letters) if rng.random() < 0.7 else rng.choice(["the", "ing", "can't", "'ll", "<|endoftext|>", "aaaa", "!!!!"]) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["a" * 3000, "ab" * 900 + "!" * 900]
    for t, ids in zip(texts, codec.encode(texts)):
        e = library.encode(t, add_special_tokens=False)
        assert np.array(e.ids, "<u4").tobytes() == ids and library.decode(e.ids, skip_special_tokens=False) == codec.decode(ids)


def test_compatibility_is_exact():
    """Every pair that the check passes is what merging leaves, and no other."""
    m = bpe.model(queries.word_bpe())
    rng = random.Random(4)
    one = rng.choices(list(m.inside.items()), k=4000)
    two = rng.choices([*[(w, t, False) for w, t in m.inside.items()], *[(w, t, True) for w, t in m.ending.items()]], k=4000)
    ok = m.compatible(np.array([t for _, t in one]), np.array([t for _, t, _ in two]))
    assert all((m.merged(a + b, end)[0] == [x, y]) == good for (a, x), (b, y, end), good in zip(one, two, ok))


# --- SQL --------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    wanted = sorted(found.fetchall())
    frame = queries.QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns) and sorted(tuple(r) for r in frame.select(*columns).collect()) == wanted


def test_queries_have_the_stated_columns(spark, sf_dir):
    """Names and types of the columns that each query promises."""
    wanted = {
        "op1_simhash_groups": "doc_id:bigint fingerprint:string component_id:bigint",
        "op2_ogg_media": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
        "op3_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
        "op4_suffix_dedup": "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
        "op5_token_counts": "doc_id:bigint n_words:bigint n_tokens:bigint",
        "op6_decontaminate": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
        "op7_context_mixing": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
        "op8_hash_tree_shards": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
        "op9_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
        "op10_bpe_round_trip": "doc_id:bigint n_tokens:bigint ids_sha256:string decoded_sha256:string",
    }
    assert set(wanted) == set(queries.QUERIES)
    for name, columns in wanted.items():
        have = dict(queries.QUERIES[name](spark, sf_dir).dtypes)
        assert {c: have.get(c) for c in dict(x.split(":") for x in columns.split())} == dict(x.split(":") for x in columns.split())
