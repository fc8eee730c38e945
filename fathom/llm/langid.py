"""Language identification by error-correcting output codes over hashed character n-grams.

Each language has a codeword; each bit is a binary logistic classifier on the text's n-gram counts
(square roots, unit length). Decoding is loss-weighted: a language's distance is the sum over bits of
the classifier's logistic loss against the codeword's bit, weighted by how well the bit was learned;
the nearest codeword wins, and a text whose two nearest codewords lie close together is flagged.

Training uses a bounded sample: of each language up to ``TRAIN_ROWS_PER_LANGUAGE`` different rows, of all together up to
``TRAIN_ROWS``, chosen by a hash of id and text; a share of each language's rows is drawn by that hash before any of them
meet in a task. Prediction reads every whole text, map-only, with memory bounded per text by ``CHUNK`` bytes.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled row everything is
``und``; with one language everything with a letter is that language. Rows without an id or label never train; rows equal in id and text train
once; of rows equal in text but not in label each trains for its own. Ties between languages go to the lesser name. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, lean, row_key, slices, trim

TRAIN_ROWS_PER_LANGUAGE = 500
TRAIN_ROWS = 4000
TRAIN_MOST_CHARS = 20_000
BITS = 13
DIMENSIONS = 1 << BITS
ORDERS = (2, 3, 4)
CHUNK = 1 << 20
SEED = 20240
UNDETERMINED = "und"
CLOSE = 0.6  # of the softmax over distances; below it a text is flagged

_SPACES = bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128))
_FOLD = bytearray(range(256))
for _b in _SPACES:
    _FOLD[_b] = 32
for _b in range(65, 91):
    _FOLD[_b] = _b + 32
_FOLD = bytes(_FOLD)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a text: its UTF-8 bytes, ASCII lower-cased, ASCII non-letters as blanks."""
    raw = b" " + text.encode("utf-8", "replace").translate(_FOLD) + b" "
    out = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[at : at + CHUNK + max(ORDERS) - 1], dtype=np.uint8).astype(np.uint32)
        whole = at + CHUNK >= len(raw)
        h = b.copy()
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :]
            if n in ORDERS and len(h):
                own = h if whole else h[:CHUNK]
                out += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=DIMENSIONS)
    return out


def features(texts: list[str]) -> np.ndarray:
    x = np.sqrt(np.stack([counts(t) for t in texts]).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: every two-way split for few languages, else the most spread of random codes."""
    if n <= 6:
        splits = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(splits).T.reshape(n, -1)
    # one against the rest, unless a random code lies further apart
    rng, best, most = np.random.default_rng(SEED), 2 * np.eye(n, dtype=int) - 1, 2
    for _ in range(200):
        code = rng.choice([-1, 1], size=(n, int(10 * np.ceil(np.log2(n)))))
        if (abs(code.sum(0)) == n).any():
            continue
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and flags of texts."""
        langs, scores, close = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(rows), 256):
            own = rows[at : at + 256]
            if len(self.languages) == 1:
                p = np.ones((len(own), 1))
            else:
                f = features([texts[i] for i in own]) @ self.weights + self.bias
                loss = (np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.trust).sum(-1) / self.trust.sum()
                p = np.exp(4 * (loss.min(1, keepdims=True) - loss))
                p /= p.sum(1, keepdims=True)
            for i, k in zip(own, p.argmax(1), strict=True):
                langs[i] = self.languages[k]
            scores[own], close[own] = p.max(1), p.max(1) < CLOSE
        return langs, scores, close


def fit(x: np.ndarray, labels: list[str], rounds: int = 150) -> Model:
    """Logistic classifiers of all bits at once by accelerated gradient steps."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages)
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in labels]].astype(np.float32)
    share = {v: 1 / labels.count(v) for v in languages}
    weight = np.array([share[v] for v in labels], dtype=np.float32)[:, None] / len(languages)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -y / (1 + np.exp(y * (x @ (w + 0.9 * vw) + b + 0.9 * vb))) * weight
        vw = 0.9 * vw - 20.0 * (x.T @ g + 1e-5 * w)
        vb = 0.9 * vb - 2.0 * g.sum(0)
        w, b = w + vw, b + vb
    right = (((x @ w + b) * y > 0) * weight).sum(0)
    return Model(languages, code, w, b, np.maximum(2 * right - 1, 0.05))


def sample(docs: DataFrame, rows: int = TRAIN_ROWS_PER_LANGUAGE, total: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, lang, text, k (place in its language) of at most so many different rows a language, and so many in all, that may train a model."""
    able = docs.select("doc_id", "lang", "text", row_key().alias("key")).where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TRAIN_MOST_CHARS))
    # one row a language; half as many again as are wanted are drawn, so that the estimate of the count may be off
    sizes = able.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n"))
    counted = sizes.count()
    most = max(1, min(rows, total // max(1, counted)))
    share = sizes.select(F.col("lang").alias("lang_"), F.least(F.lit(1.0), F.lit(1.5 * most) / F.col("n") + F.lit(20.0) / F.col("n")).alias("share"))
    drawn = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    few = able.join(F.broadcast(share), F.col("lang") == F.col("lang_")).where(drawn).groupBy("key", "lang").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key", F.lit(SEED)), "key")
    return few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("doc_id", "lang", "text", "k")


def train(docs: DataFrame) -> Model:
    """Model of docs(doc_id, text, lang) learned from a bounded sample of its rows that aren't held out."""

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            c = [counts(t) for t in b["text"]]
            at = [np.flatnonzero(v) for v in c]
            yield pd.DataFrame({"lang": b["lang"], "k": b["k"], "at": [i.astype(np.int32).tobytes() for i in at], "n": [v[i].astype(np.int32).tobytes() for v, i in zip(c, at, strict=True)]})

    # TRAIN_ROWS rows at most
    got = sample(docs).mapInPandas(lean("langid", sparse), "lang string, k int, at binary, n binary").toPandas()
    if not len(got):
        return Model([])
    got = got.sort_values(["lang", "k"])
    x = np.zeros((len(got), DIMENSIONS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        x[i, np.frombuffer(at, np.int32)] = np.sqrt(np.frombuffer(n, np.int32))
    labels = got["lang"].tolist()
    del got
    for lo in range(0, len(x), 100):  # in parts, as lengths take as much again as the rows they are of
        x[lo : lo + 100] /= np.maximum(np.linalg.norm(x[lo : lo + 100], axis=1, keepdims=True), 1e-9)
    trim()
    model = fit(x, labels)
    del x
    trim()
    return model


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            langs, scores, close = model.predict(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": langs, "score": scores, "ambiguous": close})

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInPandas(lean("langid", run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs whose language can be told, with null languages filled in; columns as in docs.

    Rejected are texts without a letter, and ambiguous ones (no language is near) whose label the nearest codeword contradicts or that have none.
    A model without a language tells letters only.
    """
    import pyarrow as pa

    names = docs.columns
    text, lang = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                texts = b.column(text).to_pylist()
                if not model.languages:
                    yield b.filter(pa.array([has_letter(t) for t in texts], pa.bool_()))
                    continue
                langs, _, close = model.predict(texts)
                own = b.column(lang).to_pylist() if lang is not None else [None] * len(langs)
                if None in own and lang is not None:
                    filled = [p if v is None and p != UNDETERMINED else v for v, p in zip(own, langs, strict=True)]
                    b = b.set_column(lang, b.schema.field(lang), pa.array(filled, b.schema.field(lang).type))
                yield b.filter(pa.array([p != UNDETERMINED and (not c or p == v) for p, c, v in zip(langs, close, own, strict=True)], pa.bool_()))

    return docs.mapInArrow(lean("langid", run), docs.schema)
