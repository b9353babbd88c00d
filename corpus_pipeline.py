"""From raw documents to packed training sequences: filter, classify, deduplicate, cut repeated passages, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidsieve.llm import packing, quality_classifier, quality_rules, simhash, substring_dedup
from bidsieve.llm.common import forget, read, shared_folder
from bidsieve.llm.queries import tokenizer

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs.select(*DOCUMENTS))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of documents still there, predicts to be good."""
    return quality_classifier.keep_good(docs.select(*DOCUMENTS), read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id; ids that are null come last."""
    return simhash.one_of_each(docs.select(*DOCUMENTS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has."""
    cut = substring_dedup.remove_repeated_words(docs, carry=("lang", "source"))
    return cut.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return packing.digest(packing.pack(docs, tokenizer("word_bpe_49k.json")))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("simhash", near_duplicates), ("substring_dedup", repeated_passages), ("packing", sequences)]

#: Hashing, tokenizing and model fitting have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder, read again by the next and then removed."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            forget(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
