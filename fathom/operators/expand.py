"""Sparse query expansion behind a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ExpansionConfig

#: Texts to a list of (token, weight) each.
SparseEncoder = Callable[[list[str]], list[list[tuple[str, float]]]]


def pool(logits: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Vocabulary weights of masked-language-model logits [positions, vocabulary]: the largest log(1 + relu) over unmasked positions."""
    return (np.log1p(np.maximum(logits, 0)) * mask[:, None]).max(0)


def encode(queries: DataFrame, encoder: SparseEncoder, cfg: ExpansionConfig = ExpansionConfig()) -> DataFrame:
    """qid, query, weights array<struct<token, weight>>: heaviest first, at least the threshold, cap times as many as the query has words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = encoder(b["query"].tolist())
            yield pd.DataFrame({"qid": b["qid"], "query": b["query"], "w": [[{"token": t, "weight": round(float(w), 2)} for t, w in f] for f in found]})

    raw = queries.select("qid", "query").mapInPandas(run, "qid long, query string, w array<struct<token: string, weight: double>>")
    order = F.expr("array_sort(filter(w, x -> x.weight >= %r), (a, b) -> CASE WHEN a.weight > b.weight THEN -1 WHEN a.weight < b.weight THEN 1 WHEN a.token < b.token THEN -1 WHEN a.token > b.token THEN 1 ELSE 0 END)" % cfg.threshold)
    return raw.select("qid", "query", F.slice(order, F.lit(1), F.greatest(F.lit(1), F.size(F.split("query", " ")) * cfg.cap)).alias("weights"))


def expand(encoded: DataFrame, cfg: ExpansionConfig = ExpansionConfig()) -> DataFrame:
    """qid, query: up to cap new tokens, heaviest first, before the query's own words."""
    own = F.split("query", " ")
    new = F.slice(F.array_except(F.col("weights.token"), own), 1, cfg.cap)
    return encoded.select("qid", F.array_join(F.concat(new, own), " ").alias("query"))
