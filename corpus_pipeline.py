"""The document pipeline: STAGES over a documents table, and run()."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from softcluster.llm import decontaminate, packing, quality_classifier, secrets, simhash
from softcluster.llm.queries import tokenizer
from softcluster.llm.tables import load, written
from softcluster.session import ensure_importable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_classifier.keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one of the least doc_id."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mask; every document stays."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2,048 ids, with the ids."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


#: (name, function of (spark, docs, sf_dir)), each over what the one before kept.
STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scan", no_secrets),
    ("packing", packed),
]

#: SQL cannot train the first stage's classifiers; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on documents, each one's rows written and read again."""
    ensure_importable(spark)
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
