"""From raw documents to token ids: quality, exact dedup, near-dedup, mixing, encoding.

Each stage takes all that its predecessor kept, written as Parquet and read again, and returns the columns of documents;
the last returns each document's token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import bpe, exact_dedup, mixing, quality, simhash
from leafmark.llm.shared import staged, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.drop_copies(docs)


def distinct_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    return simhash.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as little-endian unsigned 32-bit integers, with the digests of ids and of what they decode to."""
    return bpe.round_trip(docs, *bpe.public_vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("SimHash near-dedup", distinct_groups),
    ("mixing to target weights", mixed_documents),
    ("byte-level BPE", encoded_documents),
]

#: The classifier isn't expressible in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
