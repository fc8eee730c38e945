"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, licenses, linededup, mixing, neardup, pii, piece_codec, quality, spotsigs, toxicity
from .common import documents, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(documents(spark, sf_dir))


#: The key of the driver's invented tables; a corpus of real persons has a secret one, given by spark.fathom.pii.key.
TABLES_KEY = "invented tables"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(documents(spark, sf_dir), spark.conf.get("spark.fathom.pii.key", TABLES_KEY))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(documents(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_digests(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict_languages(docs, langid.train(docs))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_neardup": op2_neardup,
    "op3_lines": op3_lines,
    "op4_pii": op4_pii,
    "op5_fingerprints": op5_fingerprints,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_licenses": op10_licenses,
}

ORACLES: dict[str, str] = {
    "op7_quality": quality.oracle(),
    "op8_mixing": mixing.oracle(),
}
