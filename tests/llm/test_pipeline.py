"""The pipeline against a brute-force version of its stages."""

import hashlib

import numpy as np
from test_operators import slow_dedup, slow_leaks
from test_similar import slow_kept

import corpus_pipeline
from tidegrid.llm import common, langid, queries


def slow_pipeline(docs, model, items):
    """docs: (doc_id, text). Rows of (doc_id, n_chars, ids_sha256)."""
    from tokenizers import Tokenizer

    judge, kept = langid.Classifier(model), []
    for d, t in docs:
        lang, score = judge.judged(*langid.by_text([t or ""])[0])
        if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE:
            kept.append((d, t))
    least = set(slow_kept(kept))
    kept = [(d, t) for d, t in kept if d in least]
    kept = [(d, x[2].decode("utf-8", "ignore")) for (d, _), x in zip(kept, slow_dedup([t.encode() for _, t in kept]))]
    kept = [(d, t) for (d, t), x in zip(kept, slow_leaks([t for _, t in kept], items)) if not x[2]]
    library = Tokenizer.from_file(queries.word_bpe())
    return [(d, len(t), hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for d, t in kept]


def test_pipeline(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    model = langid.train(docs.where(~langid.held_out()))
    items = [(r.item_id, r.text) for r in common.table(spark, sf_dir, "benchmark").collect()]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_chars, r.ids_sha256) for r in found) == sorted(slow_pipeline(given, model, items))
    assert 0 < len(found) < len(given)


def test_stages_return_documents(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, "Words of the night and the day", "en", None, None), (-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "The same words of the house", "en", "s", 5), (-3, "The same words of the house", "en", "s", 5)], docs.schema)
    now = docs.limit(60).union(odd)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf_dir)
        if k < 4:
            assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    ids = [r.doc_id for r in now.collect()]
    assert ids.count(-3) == 1 and ids.count(None) == 1 and -1 not in ids and -2 not in ids
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, sf_dir)
    assert nothing.count() == 0
