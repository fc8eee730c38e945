"""Incremental indexing of a folder that documents arrive in: an extension for corpora that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import AnalyzerConfig
from ..plans.index import Index


def index_stream(spark: SparkSession, source: str, schema: str, index_path: str, checkpoint: str, fields: tuple[str, ...] = ("body",), analyzer: AnalyzerConfig = AnalyzerConfig()) -> StreamingQuery:
    """Indexes each new Parquet file of source once and adds it to the index at index_path; stops when none is left.

    The checkpoint remembers finished files. A batch whose write was cut off is written again under the same number and replaces what it
    had left, as each batch has a folder of its own.
    """

    def add(batch: DataFrame, number: int) -> None:
        Index.build(batch, fields, analyzer).save(f"{index_path}/batch={number}", force=True)

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, index_path: str, batches: list[int]) -> Index:
    """One index over batches; statistics are summed."""
    from pyspark.sql import functions as F

    parts = [Index.load(spark, f"{index_path}/batch={n}") for n in batches]
    first = parts[0]
    postings, docs, stats = first.postings, first.doc_stats, first.term_stats
    for p in parts[1:]:
        postings, docs, stats = postings.unionByName(p.postings), docs.unionByName(p.doc_stats), stats.unionByName(p.term_stats)
    stats = stats.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return Index(postings, docs, stats, first.fields, first.analyzer)
