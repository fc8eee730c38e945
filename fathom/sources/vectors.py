"""Saved vectors of documents: written once, read by scan or by id."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ID_BUCKETS = 64


class VectorStore:
    """vec array<float> by doc_id, as Parquet split by a hash of the id and sorted by it, so that a lookup reads a few row groups.

    An existing store isn't overwritten unless forced; one whose writing was cut off has no ``meta`` and doesn't exist.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._meta: dict | None = None

    def exists(self) -> bool:
        try:
            self.spark.read.text(f"{self.path}/meta").first()
        except AnalysisException:
            return False
        return True

    def started(self) -> bool:
        """Whether any vector was written, sealed or not."""
        try:
            return bool(self.load().columns)
        except AnalysisException:
            return False

    def write(self, vectors: DataFrame, force: bool = False) -> None:
        """Store vectors(doc_id, vec); vectors of different widths are an error."""
        if not force and self.exists():
            raise FileExistsError(self.path)
        self._put(vectors, "overwrite")
        self.seal()

    def append(self, vectors: DataFrame) -> None:
        """Add vectors of new ids; the store isn't whole again until it's sealed."""
        self._put(vectors, "append")

    def _put(self, vectors: DataFrame, mode: str) -> None:
        rows = vectors.select("doc_id", F.col("vec").cast("array<float>").alias("vec"), F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).cast("int").alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.mode(mode).partitionBy("bucket").parquet(f"{self.path}/vectors")

    def seal(self) -> None:
        """Check the widths and note size and width."""
        row = self.load().agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("hi")).first()
        if row["lo"] != row["hi"]:
            raise ValueError(f"vectors of {row['lo']} to {row['hi']} numbers")
        meta = json.dumps({"num_docs": row["n"], "dim": row["hi"] or 0})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        self._meta = None

    def load(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors").select("doc_id", "vec")

    def get(self, ids: list) -> DataFrame:
        """doc_id, vec of a few ids; unknown ones are left out."""
        if not ids:
            return self.load().limit(0)
        kind = self.load().schema["doc_id"].dataType.simpleString()
        listed = ", ".join(f"CAST({i!r} AS {kind})" for i in ids)
        buckets = self.spark.sql(f"SELECT transform(array({listed}), x -> CAST(pmod(xxhash64(x), {ID_BUCKETS}) AS int)) AS b FROM VALUES (1)").first()[0]
        at = self.spark.read.parquet(f"{self.path}/vectors")
        return at.where(F.col("bucket").isin(sorted(set(buckets))) & F.col("doc_id").isin(ids)).select("doc_id", "vec")

    def _known(self) -> dict:
        if self._meta is None:
            self._meta = json.loads(self.spark.read.text(f"{self.path}/meta").first()[0])
        return self._meta

    @property
    def num_docs(self) -> int:
        return self._known()["num_docs"]

    @property
    def dim(self) -> int:
        return self._known()["dim"]
