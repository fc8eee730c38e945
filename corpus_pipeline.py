"""The corpus pipeline: language ID, line dedup, near-dedup, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's docs; all but the last return the columns of documents. A stage's folder goes when the next one is written, the last when the program ends.

Defined results, of every stage: columns of documents other than doc_id, text, lang and source are passed on, whatever their names; ids of several
rows or none are kept apart by their text; an empty table stays empty. Null texts and texts without a letter go in the first stage, so later stages see
none in run(), though each takes them: line dedup and near-dedup keep rows without a word, the mix takes them once, the encoder gives them no ids. Ties
go to the lesser id. Very long texts are read whole, in memory in proportion to their length.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import langid, linededup, mixing, neardup, piece_codec
from fathom.llm.common import remove, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; without a letter, or ambiguous and against their label, they go. Null labels are filled in."""
    return langid.keep_identified(docs, langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those that were copies throughout go."""
    return linededup.dedup_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.dedup_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks, in training order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each document of the mix."""
    return piece_codec.encode_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("sentencepiece", encode),
]

#: Language ID, the string sketches and the encoder are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir; what is written between stages lies in the shared folder."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    atexit.register(_end, spark, base)
    return docs


def _end(spark: SparkSession, base: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        remove(spark, base)
