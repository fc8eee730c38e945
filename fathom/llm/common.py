"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HELD_OUT_MODULUS = 5


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the ids that no model learns from; a null id counts as held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % HELD_OUT_MODULUS == 0, F.lit(True))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128-bit key of a row's id and text: rows that agree in both are one document with several rows."""
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(ident, F.lit("\x00"), F.coalesce(F.col(text), F.lit("")), F.when(F.col(text).isNull(), F.lit("\x00")).otherwise(F.lit("")))))


def text_key(text: str = "text") -> Column:
    """128-bit key of a text; null and empty texts share one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which all executors share; a temporary one only in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "fathom-checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark reads it with."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a narrow table that one task writes.
ROWS_PER_TASK = 100_000
#: Rows that go to a Python worker at once while a table is written; texts in batches of Spark's 10,000 take tens of MB on either side.
ROWS_PER_BATCH = 2000


class Tables:
    """Tables that an operator writes to the shared folder to cut its lineage: parquet, so later steps read the columns they use.

    The shuffle files of the step that made a table go as soon as it's written. ``drop`` deletes tables that no later step reads; those that a
    returned DataFrame reads are deleted when the program ends.
    """

    FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, {}
        self.base = f"{shared_folder(spark)}/fathom-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            remove(self.spark, self.base)

    def cut(self, df: DataFrame, rows: int | None = None, per_task: int = ROWS_PER_TASK) -> DataFrame:
        """Write df and go on from what was written. Where a bound of its rows is known, no more tasks write it than those take."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_task)))
        path, conf = f"{self.base}/{len(self.made)}", self.spark.conf
        old = {k: conf.get(k) for k in (self.FILES, self.BATCH)}
        conf.set(self.FILES, "true")
        conf.set(self.BATCH, str(ROWS_PER_BATCH))
        try:
            df.write.parquet(path)
        finally:
            for k, v in old.items():
                conf.set(k, v)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path, made in list(self.made.items()):
            if any(made is t for t in tables):
                remove(self.spark, path)
                self.made[path] = None


#: Heavy keys are those that most rows hold, so many of them at most, and more than HEAVY_LEAST rows each. Any other key holds less than a thousandth of the rows.
HEAVY_KEYS = 1000
HEAVY_LEAST = 64


def heavy(side: DataFrame, n: str = "n") -> list:
    """The rows of side, which has a row a key, of the heavy keys by column n."""
    return side.where(F.col(n) > HEAVY_LEAST).orderBy(F.desc(n)).limit(HEAVY_KEYS).collect()  # a thousand at most


def skewed_join(big: DataFrame, side: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Inner join of big with side, unique in keys and written already, whose column n counts big's rows by key.

    Rows of heavy keys meet side by broadcast where they lie, so that no key fills one task; the rest is shuffled.
    side's rows have to be small. n isn't passed on.
    """
    found = heavy(side, n)
    if not found:
        return big.join(side.drop(n), keys)
    some = F.broadcast(side.sparkSession.createDataFrame(found, side.schema).drop(n))
    rare = big.join(F.broadcast(some.select(*keys)), keys, "left_anti").join(side.drop(n), keys)
    return rare.unionByName(big.join(some, keys))


def salted_join(big: DataFrame, side: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join of big with side, unique in key, whose rows may be large: the row of a heavy key is handed out in several copies, each for a part of big's rows, dealt by spread."""
    often = heavy(big.groupBy(key).agg(F.count("*").alias("n")))
    if not often:
        return big.join(side, key)
    names = [*big.columns, *side.columns]
    part, parts = fresh_name("part_", names), fresh_name("parts_", names)
    kind = big.schema[key].dataType.simpleString()
    dealt = F.broadcast(big.sparkSession.createDataFrame([(r[key], -(-r["n"] // HEAVY_LEAST)) for r in often], f"`{key}` {kind}, `{parts}` int"))
    left = big.join(dealt, key, "left").withColumn(part, F.pmod(F.xxhash64(spread), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    right = side.join(dealt, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return left.join(right, [key, part]).drop(part)


#: What the operator that a Python worker serves keeps between tasks. Workers outlive stages, so another operator's first task drops it.
kept: dict = {}


def lean(owner: str, run: Callable) -> Callable:
    """run, a function of batches, for a worker that then keeps nothing of other operators than owner, and gives back freed memory when the task ends."""

    def leaner(batches: Iterator) -> Iterator:
        _take(owner)
        try:
            yield from run(batches)
        finally:
            trim()

    return leaner


def _take(owner: str) -> None:
    """A function of its own: workers find it by name, and with it the one dict of their process; a closure would bring a copy."""
    if kept.get("owner") != owner:
        kept.clear()
        kept["owner"] = owner


def trim() -> None:
    """Give memory that this process has freed back to the system; where the allocators can't, nothing happens."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """Batches cut into pieces of so many rows, to bound what is made of them at once."""
    for b in batches:
        for lo in range(0, len(b), rows):
            yield b.iloc[lo : lo + rows]


def fresh_name(base: str, taken: list[str]) -> str:
    """base, lengthened until it clashes with none of the taken column names (case-insensitively)."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base


class Recent(dict):
    """A bounded store for Python workers: when it is full, what wasn't asked for since the last time goes.

    Holds up to twice the given number of entries; look up with ``find``.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def find(self, key):
        got = self.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
