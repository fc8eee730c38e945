"""Corpus sources: tab-separated text and the adapters for document and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_FIELDS = ("title", "body", "url")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id (physical line number from 0) and value of a text file or folder."""
    lines = spark.read.option("lineSep", "\n").text(path)
    numbered = lines.select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"))
    # line numbers: ids grow within a partition and partitions in order of their first line
    per = numbered.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    # one row a partition
    start = per.withColumn("start", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return numbered.join(F.broadcast(start), F.shiftright("m", 33) == F.col("p")).select((F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("row_id"), "value")


def read_corpus(spark: SparkSession, path: str, limit: int | None = None, batch: int = 10_000, exact: bool = False) -> DataFrame:
    """row_id, doc_id, url, title, body of the lines with exactly four columns.

    A limit admits whole batches of physical lines, as many as reach it; exact admits just that many lines.
    """
    rows = read_lines(spark, path)
    if limit is not None and limit >= 0:
        rows = rows.where(F.col("row_id") < (limit if exact else -(-limit // batch) * batch))
    parts = F.split("value", "\t", -1)
    return rows.where(F.size(parts) == 4).select("row_id", *[parts[i].alias(n) for i, n in enumerate(("doc_id", "url", "title", "body"))])


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def page_body(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", " ")


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.col("page_id").alias("doc_id"), "url", page_title(F.col("html")).alias("title"), page_body(F.col("html")).alias("body"))


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))


def unpivot(corpus: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """doc_id, field, text; the field ``all`` is the title, a blank and the body."""
    value = {"all": F.concat_ws(" ", "title", "body") if "all" in fields else None}
    return corpus.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (value[f] if f == "all" else F.col(f)).alias("text")) for f in fields])).alias("e")).select("doc_id", "e.field", "e.text")
