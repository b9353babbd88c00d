"""Queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, language_id, packing, quality_classifier, quality_rules, ranked_search, sharding, simhash, spelling_variants, substring_dedup, suffix_dedup, url_filter
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.digest(quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    return bpe.digest(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(url_filter.captures_of(pages), url_filter.entries_of(pages))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeated_bytes(read(spark, sf_dir, "documents")))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeated_words(read(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judge(read(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_bpe, op3_url_filter, op4_embedding_dedup, op5_packing, op6_suffix_dedup, op7_sharding, op8_simhash, op9_substring_dedup, op10_quality_rules, op11_spelling_variants, op12_ranked_search, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    """Hashes, tokenizers and fitted models have no SQL form; the tests hold those operators against brute force."""
    return {"op3_url_filter": url_filter.SQL, "op11_spelling_variants": spelling_variants.SQL, "op12_ranked_search": ranked_search.SQL}
