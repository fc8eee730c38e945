"""Indexes kept between queries: built once for a state of a table, in the folder that the session shares."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import FORMAT, Index


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "fathom-checkpoints")


def state(spark: SparkSession, path: str) -> str:
    """A digest of a Parquet table's files: names, sizes and times of change."""
    files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").groupBy("file_path").agg(F.max("file_size").alias("s"), F.max("file_modification_time").alias("t"))
    row = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "s", "t").cast("decimal(38,0)"))).first()
    return hashlib.md5(f"{FORMAT}:{path}:{row[0]}:{row[1]}".encode()).hexdigest()


#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Spark 4.1 puts the single partitions of a union's sides in one, for one task.
UNION = "spark.sql.unionOutputPartitioning"


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder to cut lineage; they go with ``end``, or when the program ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_folder(spark)}/fathom-scratch-{uuid.uuid4().hex}", 0
        atexit.register(self.end)

    def cut(self, df: DataFrame, batch: int = 10_000) -> DataFrame:
        """Write df, and go on from what was written. batch: rows that go to a Python worker at once."""
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        with settings(self.spark, {FILES: "true", BATCH: str(batch), UNION: "false"}):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


_loaded: dict[tuple[int, str], Index] = {}


def kept(spark: SparkSession, table: str, name: str, build: Callable[[], Index]) -> Index:
    """The index of a table under a name: loaded if it was built from the table's present state, else built and saved."""
    path = f"{shared_folder(spark)}/fathom-index/{name}-{state(spark, table)}"
    key = (id(spark.sparkContext), path)
    if key not in _loaded:
        try:
            _loaded[key] = Index.load(spark, path)
        except AnalysisException:  # not there
            with settings(spark, {FILES: "true"}):
                build().save(path, force=True)
            _loaded[key] = Index.load(spark, path)
    return _loaded[key]
