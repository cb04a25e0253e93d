"""The pipeline's near-dedup against brute-force Jaccard similarity of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidegrid.llm import common, similar, simhash


def slow_kept(texts):
    """texts: (doc_id, text). The least doc_id of each group."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def planted(changes, copies, words=120):
    """Texts of their own words, each with copies that differ in some words."""
    rng, out = random.Random(4), []
    for k in range(30):
        base = [f"w{k}x{i}" for i in range(words)]
        out.append(" ".join(base))
        for c in range(copies):
            now = list(base)
            for i in rng.sample(range(words), rng.choice(changes)):
                now[i] = f"c{k}y{c}z{i}"
            out.append(" ".join(now))
    rng.shuffle(out)
    return list(enumerate(out))


def kept(spark, sf_dir, texts):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], common.table(spark, sf_dir, "documents").schema)
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, sf_dir).collect())


def test_near_dedup_of_given_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    found = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert found == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("chunk", [similar.CHUNK, 150])
def test_near_dedup_of_copies(spark, sf_dir, monkeypatch, chunk):
    """Copies on both sides of 0.8, odd texts, and neighbourhoods cut in chunks."""
    monkeypatch.setattr(similar.least_of_groups, "__defaults__", ("place", "text", chunk))
    texts = planted((1, 2, 3, 4), 4)
    texts += [(1000 + i, t) for i, t in enumerate(["", None, "  ", "one two", "One  two", "one two three", *["same text"] * 5])]
    wanted = slow_kept(texts)
    assert kept(spark, sf_dir, texts) == wanted and 30 < len(wanted) < len(texts)


def test_share_of_pairs_found():
    """Pairs at 0.8 to 0.85 and at 0.9: the share that has a key in common and few enough differing bits."""
    rng, keys = np.random.default_rng(5), simhash.Keys(simhash.SIXTHS)
    for shared, least in ((900, 0.9), (950, 0.985)):  # of 1,000 in each
        both = [], []
        for _ in range(1000):
            whole = rng.integers(0, 2**64, 2000 - shared, dtype=np.uint64)
            both[0].append(similar.sketch(whole[:1000]))
            both[1].append(similar.sketch(whole[1000 - shared :]))
        one, two = (np.array(x, np.uint64).T for x in both)
        met = {o for o, _ in set(zip(*(x.tolist() for x in keys.of(one)[::-1]))) & set(zip(*(x.tolist() for x in keys.of(two)[::-1])))}
        near = np.flatnonzero(np.bitwise_count(one ^ two).sum(axis=0) <= similar.MOST)
        assert len(met & set(near.tolist())) >= least * 1000


def test_flood_connects_what_pairs_connect():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(40, 34, replace=False)) for _ in range(60)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar.flooded(np.arange(60), sets):
        assert 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
        parent[find(a)] = find(b)
    for i in range(60):
        for j in range(i):
            if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                assert find(i) == find(j)


def test_dense_group_has_few_links(spark):
    """Near copies that share many keys: a task gives one link a fingerprint at most, and what connects stays connected."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, 128, dtype=np.uint8)
    bits = (base ^ (rng.random((600, 128)) < 0.08)).astype(np.uint8)
    fps = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    frame = spark.createDataFrame([tuple(map(int, f)) for f in fps], "one long, two long")
    found = simhash.links(frame, similar.MOST, simhash.SIXTHS)
    assert found.count() < 600 * common.partitions(frame)
    words, names = fps.T.view(np.uint64), simhash.numbers(fps.T.view(np.uint64))
    apart = sum(np.bitwise_count(w[:, None] ^ w[None, :]).astype(int) for w in words)
    key, owner = simhash.Keys(simhash.SIXTHS).of(words)
    parent = np.arange(600)
    for k in np.unique(key):
        run = owner[key == k]
        for i in run:
            for j in run[apart[i, run] <= similar.MOST]:
                parent[parent == parent[max(i, j)]] = parent[min(i, j)]
    roots = {r.node: r.root for r in simhash.components(found).collect()}
    got = [roots.get(int(x), int(x)) for x in names]
    assert [min(names[parent == p]) for p in parent] == got and len(set(got)) < 60


def test_components_settle_at_stars(spark):
    """A clique is a star after one round, and no further round is run to see that."""
    edges = spark.createDataFrame([(a, b) for a in range(9) for b in range(a)] + [(20, 20)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges, rounds=1).collect()} == {(x, 0) for x in range(9)}
    assert simhash.components(edges.where("a > 99"), rounds=1).collect() == []


def test_small_checkpoints_have_few_files(spark, monkeypatch):
    """Not one for each of the shuffle's partitions, each of which costs an executor two processes."""
    files, real = [], simhash.settled

    def noted(df, *rows):
        files.append((out := real(df, *rows)).rdd.getNumPartitions())
        return out

    monkeypatch.setattr(simhash, "settled", noted)
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", 20)
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    edges = own.createDataFrame([(x, x + 1) for x in range(40)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(x, 0) for x in range(41)}
    assert len(files) > 2 and set(files[1:]) == {1}
    many = common.settled(own.range(0, 100, 1, 20), 3 * common.FILE_ROWS)
    assert many.rdd.getNumPartitions() == 3 and many.count() == 100
