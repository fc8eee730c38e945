"""The engine as one object: corpus, index, vectors and model, and the search modes over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FEATURES, ChunkerConfig, ExpansionConfig, LtrConfig, SearchConfig
from .functions.snippet import snippets
from .operators import dense, ltr_data, ltr_model
from .operators.expand import SparseEncoder, encode, expand
from .operators.score import hydrate, search
from .plans.boolean import search_boolean
from .plans.index import Index

MODES = ("bm25", "bm25+ltr", "semantic", "semantic+ltr")


@dataclass
class Engine:
    """corpus(doc_id, title, body, ...) and its index; vectors(doc_id, vec), encoders and a model where the mode needs them."""

    spark: SparkSession
    corpus: DataFrame
    index: Index
    cfg: SearchConfig = SearchConfig()
    ltr: LtrConfig = LtrConfig()
    vectors: DataFrame | None = None
    encoder: dense.Encoder | None = None
    expander: SparseEncoder | None = None
    model: ltr_model.Model | None = None

    def search(self, queries: DataFrame, mode: str = "bm25", k: int | None = None) -> DataFrame:
        """qid, rank, doc_id, score of a batch of queries(qid, query). Expansion, if there is an encoder for it, is for the lexical modes."""
        if mode not in MODES:
            raise ValueError(f"no mode {mode!r}; there are {', '.join(MODES)}")
        k = self.cfg.max_results if k is None else k
        deep = self.cfg.rerank_topn if mode.endswith("+ltr") else k
        if mode.startswith("semantic"):
            if self.vectors is None or self.encoder is None:
                raise ValueError("semantic search needs vectors and an encoder")
            asked = dense.embed(queries.select("qid", F.col("query").alias("text")), self.encoder, "query", key="qid")
            found = dense.dense_top_k(self.vectors, asked, deep)
        else:
            if self.expander is not None:
                queries = expand(encode(queries, self.expander, ExpansionConfig()), ExpansionConfig())
            found = search(queries, self.index, self.cfg, deep)
        return self._rerank(found, queries, k) if mode.endswith("+ltr") else found

    def _rerank(self, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        if self.model is None:
            raise ValueError("reranking needs a model")
        cands = found.select("qid", F.col("doc_id").alias("docid"), F.col("score").alias("bm25"), "rank")
        featured = ltr_data.features(cands, queries, self.corpus, self.index, self.cfg, FEATURES)
        return ltr_model.rerank(featured, self.model, FEATURES, self.ltr.list_size, k).withColumnRenamed("docid", "doc_id").select("qid", "rank", "doc_id", "score")

    def search_one(self, query: str, mode: str = "bm25", k: int | None = None) -> DataFrame:
        return self.search(self.spark.createDataFrame([(0, query)], "qid long, query string"), mode, k)

    def boolean(self, query: str, k: int | None = None) -> tuple[DataFrame, int, str]:
        return search_boolean(self.spark, query, self.index, self.cfg, k, expander=self.expander)

    def show(self, ranked: DataFrame, queries: DataFrame, columns: tuple[str, ...] = ("title", "body"), chunker: ChunkerConfig = ChunkerConfig()) -> DataFrame:
        """ranked with the corpus columns and a snippet of the body for each query."""
        full = hydrate(ranked, self.corpus, columns).join(queries.select("qid", "query"), "qid")
        return snippets(full, chunker, "body").orderBy("qid", "rank")
