"""Query, relevance, qid-list and candidate files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import read_lines

CANDIDATES = "qid long, candidates array<struct<docid: string, bm25: double>>"


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """row_id, qid, query: split on the first tab; blank, one-column and non-integer lines are dropped."""
    parts = F.split("value", "\t", 2)
    at = read_lines(spark, path).select("row_id", F.expr("try_cast(trim(split(value, '\t', 2)[0]) AS bigint)").alias("qid"), F.get(parts, F.lit(1)).alias("query"))
    return at.where("qid IS NOT NULL AND query IS NOT NULL")


def last_query(queries: DataFrame, order: str = "row_id") -> DataFrame:
    """One query a qid: the last by order, for read_queries' rows the last line."""
    return queries.groupBy("qid").agg(F.max_by("query", order).alias("query"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """qid, docid, rel: at least four parts between white space; rows without integers are dropped."""
    at = spark.read.option("lineSep", "\n").text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p")).where(F.size("p") >= 4)
    return at.select(F.expr("try_cast(p[0] AS bigint)").alias("qid"), F.expr("p[2]").alias("docid"), F.expr("try_cast(p[3] AS int)").alias("rel")).where("qid IS NOT NULL AND rel IS NOT NULL")


def read_qids(spark: SparkSession, path: str) -> DataFrame:
    """qid of each non-blank line; anything but an integer is an error when the rows are read."""
    line = F.trim("value")
    return spark.read.option("lineSep", "\n").text(path).where(line != "").select(F.when(line.try_cast("bigint").isNull(), F.raise_error(F.concat(F.lit("not a qid: "), line))).otherwise(line.try_cast("bigint")).cast("long").alias("qid"))


def positives(qrels: DataFrame) -> DataFrame:
    """qid, docids of the relevant documents of each query."""
    return qrels.where("rel > 0").groupBy("qid").agg(F.sort_array(F.collect_set("docid")).alias("docids"))


def write_candidates(candidates: DataFrame, path: str, force: bool = False) -> None:
    """candidates(qid, docid, bm25, rank) as one JSON line a query, sorted by qid."""
    nested = candidates.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "docid", "bm25"))).alias("c"))
    nested = nested.select("qid", F.expr("transform(c, x -> named_struct('docid', cast(x.docid as string), 'bm25', x.bm25))").alias("candidates"))
    nested.orderBy("qid").write.mode("overwrite" if force else "errorifexists").json(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """qid, docid, bm25, rank."""
    at = spark.read.schema(CANDIDATES).json(path).select("qid", F.posexplode("candidates").alias("p", "c"))
    return at.select("qid", "c.docid", "c.bm25", (F.col("p") + 1).alias("rank"))


def write_split(splits: DataFrame, path: str, seed: int, force: bool = False) -> None:
    """splits(qid, split) as a folder for each part, and a line of JSON with sizes."""
    mode = "overwrite" if force else "errorifexists"
    splits.repartition("split").sortWithinPartitions("qid").write.mode(mode).partitionBy("split").parquet(f"{path}/qids")
    sizes = {r["split"]: r["n"] for r in splits.groupBy("split").agg(F.count("*").alias("n")).collect()}
    splits.sparkSession.createDataFrame([(json.dumps({"seed": seed, **sizes}),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/split_meta")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
