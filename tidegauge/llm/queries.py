"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path as vocabulary

from tidegauge.llm import (bagminhash, compression, fingerprints, langid, licenses, linefield, negatives, packing, pieces, suffix,
                           tokencount, warc, whitening)
from tidegauge.llm.texts import load
from tidegauge.runtime import prepare

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(load(prepare(spark), sf, "documents"), vocabulary(WORDS))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.removed_repeats(load(prepare(spark), sf, "documents"))


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.encode_digests(load(prepare(spark), sf, "documents"), vocabulary(PIECES))


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_scan(load(prepare(spark), sf, "documents"))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(prepare(spark), sf, "documents")
    return langid.identify(docs, langid.train(docs))


def op6_bagminhash(spark: SparkSession, sf: str) -> DataFrame:
    return bagminhash.near_duplicates(load(prepare(spark), sf, "documents"))


def op7_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.edited_likeness(load(prepare(spark), sf, "documents"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(load(prepare(spark), sf, "pages"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_counts(load(prepare(spark), sf, "documents"), vocabulary(PIECES))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return compression.quality_facts(load(prepare(spark), sf, "documents"))


def op11_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(prepare(spark), sf, "documents")
    return linefield.score_quality(docs, linefield.train(docs, load(spark, sf, "labels")))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(load(prepare(spark), sf, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.hard_negatives(load(prepare(spark), sf, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_suffix_dedup, op3_sentencepiece, op4_license_scan, op5_language_id, op6_bagminhash,
    op7_fingerprints, op8_warc, op9_token_counts, op10_quality_rules, op11_quality_classifier, op12_whitening, op13_hard_negatives)}

ORACLES: dict[str, str] = {
    "op13_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.x, r.x) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 5""",
}
