"""Registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, langid, mixing, ogg, shards, simhash, suffix, unigram, urls
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401  (registered with the queries)


def pieces() -> str:
    """Place of the vocabulary file that the token counts use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_bpe() -> str:
    """Place of the vocabulary file that the BPE query encodes with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = ogg.to_media(table(spark, sf_dir, "documents"))
    return ogg.features(stored).withColumnRenamed("key", "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.cleaned(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces()).drop("text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = decontam.hit_words()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), shards.tree(40), shards.tree(41, built=40))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe())


QUERIES = {f.__name__: f for f in (op1_simhash_groups, op2_ogg_media, op3_url_filter, op4_suffix_dedup, op5_token_counts, op6_decontaminate, op7_context_mixing, op8_hash_tree_shards, op9_language_id, op10_bpe_round_trip)}
