"""What building an index took: times, documents a second, size; kept as lines of JSON."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from ..config import AnalyzerConfig
from .index import Index


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of a folder by the file system that Spark reads it with."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def measured_build(corpus: DataFrame, path: str, fields: tuple[str, ...] = ("body",), analyzer: AnalyzerConfig = AnalyzerConfig(), positions: bool = False, log: str | None = None) -> dict[str, float]:
    """Builds and saves an index; docs, seconds, ms_per_doc, docs_per_second and kib_per_doc. A log is a folder that gets a line of JSON a run."""
    spark = corpus.sparkSession
    began = time.time()
    Index.build(corpus, fields, analyzer, positions).save(path, force=True)
    took = time.time() - began
    docs = max((n for n, _ in Index.load(spark, path).sizes().values()), default=0)
    out = {"docs": docs, "seconds": round(took, 3), "ms_per_doc": round(1000 * took / max(1, docs), 3), "docs_per_second": round(docs / took, 1), "kib_per_doc": round(folder_bytes(spark, path) / 1024 / max(1, docs), 2)}
    if log:
        spark.createDataFrame([(json.dumps({"at": int(began), "path": path, **out}),)], "value string").coalesce(1).write.mode("append").text(log)
    return out
