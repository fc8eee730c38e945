"""A listwise scoring model in NumPy: forward pass, ApproxNDCG training by hand-made gradients, reranking.

Features are normalized, pass through dense layers with relu, optionally attend across the list, and end in one score a document.
Weights are our own; nothing is carried over from elsewhere. Training keeps a share of the lists for validation and gives back the weights of its best epoch.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LtrConfig


@dataclass
class Model:
    mean: np.ndarray
    std: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    heads: int = 4
    #: query, key, value and output weights of attention across the list after the first layer, if any
    attention: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
    #: loss of each epoch's training, and the validation metrics by name
    history: list[float] = field(default_factory=list)
    validation: list[dict[str, float]] = field(default_factory=list)

    @classmethod
    def fresh(cls, x: np.ndarray, cfg: LtrConfig) -> Model:
        """Untrained weights; normalization from x [.., features]."""
        rng = np.random.default_rng(cfg.seed)
        flat = x.reshape(-1, x.shape[-1]).astype(np.float64)
        sizes = [x.shape[-1], *cfg.hidden, 1]
        layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        att = None
        if cfg.attention:
            h = cfg.hidden[0]
            att = tuple(rng.normal(0, np.sqrt(1 / h), (h, h)) for _ in range(4))
        return cls(flat.mean(0), np.sqrt(flat.var(0) + 1e-7), layers, cfg.heads, att)

    def forward(self, x: np.ndarray) -> np.ndarray:
        """Scores [lists, documents] of features [lists, documents, features]."""
        return self._pass(x)[0]

    def _pass(self, x: np.ndarray, dropout: float = 0.0, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores, and each layer's input; with dropout, inner units are left out at random and the rest scaled up."""
        h, kept = (x - self.mean) / self.std, []
        for i, (w, b) in enumerate(self.layers):
            kept.append(h)
            h = h @ w + b
            if i < len(self.layers) - 1:
                h = np.maximum(h, 0)
                if dropout and rng is not None:
                    h = h * (rng.random(h.shape) >= dropout) / (1 - dropout)
                if i == 0 and self.attention is not None:
                    h = self._attend(h)
        return h[..., 0], kept

    def _attend(self, h: np.ndarray) -> np.ndarray:
        """Multi-head attention over the list with a residual and layer norm."""
        q, k, v, o = self.attention
        n, m, d = h.shape
        cut = lambda y: y.reshape(n, m, self.heads, d // self.heads).transpose(0, 2, 1, 3)
        s = cut(h @ q) @ cut(h @ k).transpose(0, 1, 3, 2) / np.sqrt(d // self.heads)
        s = np.exp(s - s.max(-1, keepdims=True))
        y = h + ((s / s.sum(-1, keepdims=True)) @ cut(h @ v)).transpose(0, 2, 1, 3).reshape(n, m, d) @ o
        return (y - y.mean(-1, keepdims=True)) / np.sqrt(y.var(-1, keepdims=True) + 1e-3)

    def to_json(self) -> str:
        return json.dumps({"mean": self.mean.tolist(), "std": self.std.tolist(), "layers": [[w.tolist(), b.tolist()] for w, b in self.layers], "heads": self.heads, "attention": None if self.attention is None else [a.tolist() for a in self.attention], "history": self.history, "validation": self.validation})

    @classmethod
    def from_json(cls, s: str) -> Model:
        d = json.loads(s)
        return cls(np.array(d["mean"]), np.array(d["std"]), [(np.array(w), np.array(b)) for w, b in d["layers"]], d["heads"], None if d["attention"] is None else tuple(np.array(a) for a in d["attention"]), d["history"], d.get("validation", []))

    def save(self, spark: SparkSession, path: str, cfg: LtrConfig | None = None) -> None:
        """Weights, history and, if given, the options they were trained with, as a line of JSON each."""
        lines = [(self.to_json(),)] + ([(json.dumps(cfg.__dict__),)] if cfg else [])
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        return next(cls.from_json(r["value"]) for r in spark.read.text(path).collect() if '"layers"' in r["value"])


def approx_ndcg(scores: np.ndarray, labels: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Mean loss (minus the smooth NDCG) of lists, and its gradient in the scores.

    The smooth rank of i is 1 + the sum over j of sigmoid((s_j - s_i) / temperature).
    """
    diff = (scores[:, None, :] - scores[:, :, None]) / temperature
    p = 1 / (1 + np.exp(-np.clip(diff, -50, 50)))
    n = scores.shape[1]
    p[:, np.arange(n), np.arange(n)] = 0
    rank = 1 + p.sum(2)
    gain = 2.0**labels - 1
    ideal = (np.sort(gain, 1)[:, ::-1] / np.log2(np.arange(2, n + 2))).sum(1)
    ideal = np.where(ideal > 0, ideal, 1)
    loss = -(gain / np.log2(rank + 1)).sum(1) / ideal
    d_rank = gain / ideal[:, None] / ((rank + 1) * np.log(rank + 1) ** 2) * np.log(2)
    d = d_rank[:, :, None] * p * (1 - p) / temperature
    return float(loss.mean()), (d.sum(1) - d.sum(2)) / len(scores)


def learning_rate(step: int, steps: int, base: float, schedule: str, rate: float = 0.96, alpha: float = 0.0) -> float:
    """cosine: from base down to alpha * base over the steps; exponential: base * rate per tenth of the steps; else constant."""
    done = min(1.0, step / max(1, steps))
    if schedule == "cosine":
        return base * ((1 - alpha) * 0.5 * (1 + np.cos(np.pi * done)) + alpha)
    if schedule == "exponential":
        return base * rate ** (10 * done)
    return base


def list_metrics(scores: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Means over lists: mrr_1, mrr_10, ndcg_10 and recall_1 (of the relevant documents, those ranked first)."""
    order = np.argsort(-scores, axis=1, kind="stable")
    hit = np.take_along_axis(labels, order, 1) > 0
    first = np.where(hit.any(1), hit.argmax(1), np.inf)
    discount = 1 / np.log2(np.arange(2, hit.shape[1] + 2))
    ideal = np.array([discount[: min(10, int(n))].sum() for n in hit.sum(1)])
    dcg = (hit[:, :10] * discount[:10]).sum(1)
    ok = hit.any(1)
    mean = lambda v: float(v[ok].mean()) if ok.any() else 0.0
    return {"mrr_1": mean(first == 0), "mrr_10": mean(np.where(first < 10, 1 / (first + 1), 0.0)), "ndcg_10": mean(dcg / np.where(ideal > 0, ideal, 1)), "recall_1": mean(hit[:, 0] / np.maximum(1, hit.sum(1)))}


def pad(x: np.ndarray, size: int) -> np.ndarray:
    """A list of feature rows cut or zero-padded to a size."""
    out = np.zeros((size, x.shape[1]), x.dtype)
    out[: min(size, len(x))] = x[:size]
    return out


def train(lists: Iterable[tuple[list, list]], cfg: LtrConfig = LtrConfig(), batch: int = 64) -> Model:
    """Model fitted to at most max_lists (features, labels) lists by Adam on ApproxNDCG.

    The last share of the lists validates; of the epochs the one best by cfg.best_by gives its weights (without validation, the last). Attention weights,
    if any, can't be trained here.
    """
    data = [(np.array(x, np.float32), np.array(y, np.float32)) for x, y in islice(lists, cfg.max_lists)]
    if not data:
        raise ValueError("no list to train on")
    x, y = np.stack([d[0] for d in data]), np.stack([d[1] for d in data])
    model = Model.fresh(x, cfg)
    if model.attention is not None:
        raise ValueError("attention is for inference; training is of the dense layers")
    n_val = int(len(x) * cfg.validation) if len(x) > 1 else 0
    x, y, vx, vy = x[: len(x) - n_val], y[: len(y) - n_val], x[len(x) - n_val :], y[len(y) - n_val :]
    rng, moments, step, best = np.random.default_rng(cfg.seed), None, 0, (-np.inf, None)
    steps = cfg.decay_steps or cfg.epochs * -(-len(x) // batch)
    for _ in range(cfg.epochs):
        losses = []
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            s, kept = model._pass(x[at].astype(float), cfg.dropout, rng)
            loss, g = approx_ndcg(s, y[at].astype(float), cfg.temperature)
            losses.append(loss)
            grads, g = [], g[..., None]
            for i in reversed(range(len(model.layers))):
                grads.append((np.tensordot(kept[i], g, axes=([0, 1], [0, 1])), g.sum((0, 1))))
                if i:
                    g = (g @ model.layers[i][0].T) * (kept[i] > 0) / (1 - cfg.dropout)
            flat = [a for pair in reversed(grads) for a in pair]
            params = [a for pair in model.layers for a in pair]
            moments = moments or [(np.zeros_like(a), np.zeros_like(a)) for a in params]
            rate = learning_rate(step, steps, cfg.learning_rate, cfg.schedule, cfg.decay_rate, cfg.alpha)
            step += 1
            for a, b, (m, v) in zip(params, flat, moments, strict=True):
                m += 0.1 * (b - m)
                v += 0.001 * (b * b - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        model.history.append(float(np.mean(losses)))
        if n_val:
            model.validation.append(list_metrics(model.forward(vx.astype(float)), vy))
            if model.validation[-1][cfg.best_by] > best[0]:
                best = model.validation[-1][cfg.best_by], [(w.copy(), b.copy()) for w, b in model.layers]
    if best[1] is not None:
        model.layers = best[1]
    return model


@lru_cache(maxsize=4)
def _parsed(text: str) -> Model:
    """One model a worker, not one a query."""
    return Model.from_json(text)


def rerank(featured: DataFrame, model: Model, names: tuple[str, ...], list_size: int, k: int = 10, compat: bool = False) -> DataFrame:
    """qid, rank, docid, score of featured(qid, docid, rank, names...), each query's candidates scored as one list.

    Lists are padded to list_size when they're shorter; longer ones are scored in blocks, or, with compat, cut.
    """
    text = model.to_json()
    if model.attention is None and not compat:  # a document's score depends on no other: whole batches at once
        return _ranked(featured, text, names, k)
    kind = featured.schema["docid"].dataType.simpleString()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _parsed(text)
        pdf = pdf.sort_values("rank")
        if compat:
            pdf = pdf.head(list_size)
        x = pdf[list(names)].to_numpy(float)
        out = np.concatenate([m.forward(pad(x[lo : lo + list_size], list_size)[None])[0][: len(x[lo : lo + list_size])] for lo in range(0, len(x), list_size)])
        order = np.lexsort((pdf["rank"].to_numpy(), -out))[:k]
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "rank": np.arange(1, len(order) + 1), "docid": pdf["docid"].to_numpy()[order], "score": out[order]})

    return featured.groupBy("qid").applyInPandas(score, f"qid long, rank int, docid {kind}, score double")


def _ranked(featured: DataFrame, text: str, names: tuple[str, ...], k: int) -> DataFrame:
    """Scores of rows on their own, map-only, then the k best of each qid; ties go to the earlier rank."""

    def score(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        m = _parsed(text)
        for b in batches:
            yield pd.DataFrame({"qid": b["qid"], "docid": b["docid"], "before": b["rank"], "score": m.forward(b[list(names)].to_numpy(float)[None])[0]})

    kind = featured.schema["docid"].dataType.simpleString()
    scored = featured.select("qid", "docid", "rank", *names).mapInPandas(score, f"qid long, docid {kind}, before int, score double")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "before")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "docid", "score")


def feature_statistics(featured: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Mean and variance of each feature, one row each."""
    row = featured.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.var_pop(n).alias(f"v_{n}") for n in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(f"m_{n}", 6).alias("mean"), F.round(f"v_{n}", 6).alias("variance")) for n in names])).alias("e")).select("e.*")
