"""A corpus from documents to training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns documents; the last one
returns packed pieces. `run` writes each stage's rows to the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path as vocabulary

from tidegauge.llm import bagminhash, compression, langid, packing, suffix
from tidegauge.llm.texts import load, written
from tidegauge.runtime import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return compression.keep_quality(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, by a network that learns from these documents."""
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bagminhash.keep_distinct(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur more than once."""
    return suffix.without_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    return packing.packed_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeats),
    ("best_fit_packing", sequences),
]

# Compression, a trained network and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = load(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
