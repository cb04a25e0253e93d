"""Corpus pipeline: each stage works on all that its predecessor kept.

Language ID, near-duplicates, repeated passages, benchmark leaks, then encoding.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, common, decontam, langid, queries, similar, suffix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected as no known language if its score is lower; running text of a learned language has over 0.3.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no known language: null, without letters, or unlike every profile."""
    known = docs.select(*COLUMNS)
    judged = langid.predict(known, langid.train(known.where(~langid.held_out())))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one of least doc_id.

    SimHash candidates by Golay keys are settled by the Jaccard similarity of five-word
    shingles, 0.8 or more; groups are what links connect. A null doc_id comes last.
    Of a group's rows that share the least doc_id the one of least hash of all columns
    stays; of wholly equal rows one stays. Null and empty texts are alike. An empty table gives none; columns besides those of documents go.
    """
    known = docs.select(*COLUMNS)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("row"))
    kept = similar.least_of_groups(known.select(place.alias("place"), "text")).select(F.xxhash64("place").alias("__place"))
    return known.withColumn("__place", F.xxhash64(place)).join(kept, "__place", "left_semi").dropDuplicates(["__place"]).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every 200-byte string that starts elsewhere too; characters that a cut splits go. n_chars is counted anew."""
    rest = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    done = suffix.cleaned(rest, "row", as_text=True)
    return done.select("row.doc_id", F.col("kept").alias("text"), "row.lang", "row.source", F.length("kept").cast("long").alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item."""
    found = decontam.find_leaks(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("item_ids") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), with digests of them and of what they decode to."""
    rest = docs.select(F.struct("doc_id", "lang", "source", "n_chars").alias("row"), "text")
    coded = bpe.round_trip(rest, queries.word_bpe(), "row", keep_ids=True)
    return coded.select("row.*", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding and decoding", encode),
]

#: Shingle sets, suffix arrays and merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is settled, since the next ones read it more than once."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
