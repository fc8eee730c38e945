"""Dense retrieval: brute-force cosine top-k over unit vectors, embedding post-processing and encoders."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.vectors import VectorStore
from .score import BROADCAST_ROWS, DIGITS, small, top_k

#: Vectors and queries that meet in one matrix product.
VECTOR_BLOCK = 1024
QUERY_BLOCK = 512
DOCUMENT_CHARS = 2048
PREFIXES = {"query": "search_query: ", "document": "search_document: "}


class Encoder(Protocol):
    """Anything that turns texts into a float32 matrix; made once in each Python worker."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic stand-in for a model, for tests: signed hashed word counts. It carries no semantics."""

    def __init__(self, width: int = 128):
        self.width = width

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.width), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.width] += 1 if h >> 31 else -1
        return out


def document_text(title: Column, body: Column) -> Column:
    """Title and as much of the body as fits; the title alone without room or body; ``empty`` for blank texts."""
    room = DOCUMENT_CHARS - F.length(title) - 1
    text = F.when((room > 0) & (body != ""), F.concat_ws(" ", title, F.substring(body, F.lit(1), room.cast("int")))).otherwise(title)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.lit("empty")).otherwise(text)


def post_process(x: np.ndarray, dim: int) -> np.ndarray:
    """Layer norm over the full width, cut to dim, unit length."""
    x = x.astype(np.float64)
    x = (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
    x = x[..., :dim]
    return (x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def post_process_column(v: Column, dim: int) -> Column:
    """The same for a column of vectors that are there already, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else post_process(np.asarray(x)[None], dim)[0] for x in s])

    return run(v)


def embed(texts: DataFrame, encoder: Encoder, kind: str = "document", dim: int = 64, batch: int = 16, key: str = "doc_id") -> DataFrame:
    """key, vec of texts(key, text)."""
    prefix = PREFIXES[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                yield pd.DataFrame({key: part[key], "vec": list(post_process(encoder([prefix + (t or "") for t in part["text"]]), dim))})

    return texts.select(key, "text").mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, vec array<float>")


def resume(texts: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts that have no embedding yet."""
    return texts.join(done.select(key), key, "left_anti")


def embed_corpus(corpus: DataFrame, encoder: Encoder, store: VectorStore, dim: int = 64, batch: int = 16, part: int | None = None) -> int:
    """Embed the documents of corpus(doc_id, title, body) that store has no vector of yet, and seal it; the number of vectors.

    Work that was cut off is taken up where it ended. part: at most so many documents, least ids first, for a run in portions.
    """
    texts = corpus.select("doc_id", document_text(F.col("title"), F.col("body")).alias("text"))
    if store.started():
        texts = resume(texts, store.load())
    if part is not None:
        texts = texts.orderBy("doc_id").limit(part)
    store.append(embed(texts, encoder, "document", dim, batch))
    store.seal()
    return store.num_docs


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double precision of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_one(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """doc_id, score of the k vectors nearest to one query: a projection and TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("doc_id", F.round(cosine(F.col("vec"), q), DIGITS).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def _blocks(rows: DataFrame, key: str, size: int, names: tuple[str, str]) -> DataFrame:
    """names: arrays of the keys and vectors of about so many rows each, dealt by a hash of the key."""
    number = max(1, -(-rows.count() // size))
    own = rows.select(F.col(key).alias("k"), "vec", F.pmod(F.xxhash64(key), F.lit(number)).alias("b")).groupBy("b").agg(F.collect_list(F.struct("k", "vec")).alias("x"))
    return own.select(F.col("x.k").alias(names[0]), F.col("x.vec").alias(names[1]))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank, doc_id, score of the k vectors of vectors(doc_id, vec) nearest to each of queries(qid, vec).

    Every block of queries meets every block of vectors in one matrix product, which passes on its k best per query; nothing comes to the driver but two counts.
    """
    kind = vectors.schema["doc_id"].dataType.simpleString()
    asked = small(_blocks(queries, "qid", QUERY_BLOCK, ("qids", "q")), BROADCAST_ROWS // QUERY_BLOCK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qids, q, ids, v in zip(b["qids"], b["q"], b["ids"], b["v"], strict=True):
                yield _nearest(np.stack(q).astype(np.float64), np.asarray(qids), np.stack(v).astype(np.float64), np.asarray(ids), k)

    meet = _blocks(vectors, "doc_id", VECTOR_BLOCK, ("ids", "v")).crossJoin(asked)
    return top_k(meet.mapInPandas(run, f"qid long, doc_id {kind}, score double"), k).select("qid", "rank", "doc_id", "score")


def _nearest(q: np.ndarray, qids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    s = np.round(q @ v.T, DIGITS)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    # ties at the edge of the k best are settled by id, so all of them stay for now
    edge = np.take_along_axis(s, near, 1).min(1)
    i, j = np.nonzero(s >= edge[:, None])
    best = pd.DataFrame({"qid": qids[i], "doc_id": ids[j], "score": s[i, j]})
    return best.sort_values(["qid", "score", "doc_id"], ascending=[True, False, True]).groupby("qid").head(k)
