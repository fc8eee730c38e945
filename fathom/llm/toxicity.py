"""Toxicity scores by a gap-weighted subsequence-kernel support vector machine with Nystrom landmarks.

Units are words (case, accents, digits-for-letters and inserted punctuation undone), runs of spaced-out letters, and neighbouring
short words read as one (an insult cut by blanks). The kernel of two units is the normalized string kernel on subsequences of three letters, each weighted by
``DECAY`` to the length it spans, so an insult with gaps or inserted characters stays near the plain one.

A labelled sentence or text is a bag of units (multiple-instance learning): the units of a toxic text that such texts hold most above chance are its
witnesses, every unit of a clean one is clean. Witnesses also train with one to three letters inserted, and so do as many clean units, so
that the margin is of the insult and not of the insertion. Landmarks are the best witnesses and a random set of clean units; a unit's features
are its kernel values with them times the inverse root of the landmark matrix; a squared-hinge SVM is
fitted there. As both steps are linear, landmarks, root and SVM fold exactly into one weight per letter
triple, so scoring a unit is a weighted sum over its triples divided by its own norm: cost does not grow
with the landmarks.

A unit's evidence is a function of its margin that grows piecewise between ``KNOTS``, a text's the sum over its different units; a logistic
curve turns it into the score. Both are fitted on the training texts with no slope below zero. So the score follows the SVM's margins alone,
and never falls when a unit's margin grows.

Training reads a bounded sample: up to ``TRAIN_ROWS`` different labelled texts of at most ``TRAIN_MOST_CHARS`` characters, drawn by a hash of
the text; of their clean units the SVM takes up to ``TRAIN_UNITS``, frequent ones first and the rest at random. Scoring reads every whole text, map-only.
Units beyond ``PIECE`` letters are scored in all their pieces of
that length, and the worst counts.

Defined results: null and empty texts and texts without letters get the curve's value for no evidence. Without labels of both kinds the
score is 0 everywhere. Repeated rows get equal scores and train once; a document or text with labels of both kinds counts as toxic. An empty table
gives an empty result. Very long texts cost in proportion to their different words. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, text_key

TRAIN_ROWS = 4000
TRAIN_MOST_CHARS = 20_000
TRAIN_UNITS = 12_000
DECAY = 0.6
LEAST_EXCESS = 4.0  # in standard deviations, of a landmark's toxic texts over chance
PIECE = 14
LETTERS = 28
EDGE = "|"  # stands before and after a unit
KNOTS = (-0.5, 0.0, 0.5, 1.0, 2.0, 3.0, 4.5)  # of the curve that turns a unit's margin into evidence; it's flat before the first and after the last
HARD_UNITS = 4000  # clean units taken up after each round
ROUNDS = 4
CLEAN_SHARE = 8.0  # weight of all clean units to that of all witnesses
VARIED_SHARE = 1.0  # the same of units with inserted letters
INSERTED = (1, 1, 2, 2, 3, 3)  # letters, in the variants that train
SHORT = 3  # letters of a word that is also read together with its neighbours
JOINED = (2, 3, 4)  # short words read as one
JOINED_LETTERS = (5, 12)
LANDMARKS = 96  # of each kind
CACHE_ENTRIES = 300_000
SEED = 7

# Digits read as letters within words.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SPACED_RUN = 4
_NOT_LETTER = re.compile(r"[\W\d_]+")


def unit(token: str) -> str:
    """A token in lower case as a string over a-z and '{' (any other letter)."""
    if token.isascii() and token.isalpha():
        return token
    if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
        token = "".join(_DIGITS.get(c, c) for c in token)
    token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    return "".join(c if "a" <= c <= "z" else "{" for c in _NOT_LETTER.sub("", token))


def tokens(text: str) -> set[str]:
    """Distinct raw tokens of a text in lower case; runs of spaced-out letters and neighbouring short words, joined, are tokens too."""
    listed = text.lower().split()
    found = set(listed)
    run: list[str] = []
    for t in [*listed, "." * (SHORT + 1)]:
        if len(t) <= SHORT:
            run.append(t)
            continue
        if len(run) > 1:
            single = all(len(x) == 1 for x in run)
            if single and len(run) >= SPACED_RUN:
                found.add("".join(run))
            for n in JOINED:
                for i in range(len(run) - n + 1):
                    own = "".join(run[i : i + n])
                    if JOINED_LETTERS[0] <= len(own) <= JOINED_LETTERS[1]:
                        found.add(own)
            if not single:
                _spaced(run, found)
        run = []
    return found


def _spaced(run: list[str], found: set[str]) -> None:
    """Adds the runs of single letters among short words."""
    own: list[str] = []
    for t in [*run, ".."]:
        if len(t) == 1:
            own.append(t)
            continue
        if len(own) >= SPACED_RUN:
            found.add("".join(own))
        own = []


@lru_cache(maxsize=None)
def _triples(n: int) -> list[tuple[int, int, int, float]]:
    return [(i, j, k, DECAY ** (k - i + 1)) for i, j, k in combinations(range(n), 3)]


def _codes(units: list[str]) -> np.ndarray:
    return (np.frombuffer("".join(units).encode("ascii"), dtype=np.uint8).astype(np.int64) - 97).reshape(len(units), -1)


def norms(c: np.ndarray) -> np.ndarray:
    """Roots of the kernel of each row (letters of units of one length) with itself, by dynamic programming."""
    n = c.shape[1]
    same = (c[:, :, None] == c[:, None, :]).astype(np.float64).transpose(1, 2, 0)
    m = same * DECAY**2
    for _ in range(2):
        s = np.zeros((n + 1, n + 1, len(c)))
        for i in range(1, n):
            for j in range(1, n):
                s[i, j] = m[i - 1, j - 1] + DECAY * (s[i - 1, j] + s[i, j - 1]) - DECAY**2 * s[i - 1, j - 1]
        m = same * s[:n, :n] * DECAY**2
    return np.sqrt(m.sum((0, 1)))


def project(units: list[str], table: np.ndarray) -> np.ndarray:
    """For units of one length, sums of the table's rows (or numbers) over letter triples, weighted by span."""
    c = _codes(units)
    out = np.zeros((len(c), *table.shape[1:]))
    for i, j, k, w in _triples(c.shape[1]):
        out += table[(c[:, i] * LETTERS + c[:, j]) * LETTERS + c[:, k]] * w
    return out


def explicit(u: str) -> np.ndarray:
    """The unit's normalized vector over letter triples."""
    out = np.zeros(LETTERS**3)
    c = [ord(x) - 97 for x in u]
    for i, j, k, w in _triples(len(c)):
        out[(c[i] * LETTERS + c[j]) * LETTERS + c[k]] += w
    n = np.linalg.norm(out)
    return out / n if n else out


def embed(units: list[str], base: np.ndarray) -> np.ndarray:
    """Normalized features of units of at least three letters: their explicit vectors times base."""
    out = np.zeros((len(units), base.shape[1]))
    for n in {len(u) for u in units}:
        at = [i for i, u in enumerate(units) if len(u) == n]
        own = [units[i] for i in at]
        out[at] = project(own, base) / norms(_codes(own))[:, None]
    return out


def substrings(u: str, n: int) -> list[str]:
    v = EDGE + u + EDGE
    return [v[i : i + n] for i in range(len(v) - n + 1)]


def pieces(u: str) -> list[str]:
    """A unit between edges, or all its pieces of the longest length that is scored at once; none for under three letters."""
    return [] if len(u) < 3 else [EDGE + u + EDGE] if len(u) + 2 <= PIECE else substrings(u, PIECE)


@dataclass
class Model:
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(len(KNOTS)))  # offset, and slope between knots
    landmarks: list[str] = field(default_factory=list)  # those of toxic texts

    def margins(self, units: list[str]) -> np.ndarray:
        """SVM margin of each unit, at least -1; units of fewer than three letters are like no landmark."""
        by: dict[int, tuple[list[int], list[str]]] = {}
        for i, u in enumerate(units):
            for p in pieces(u):
                at, own = by.setdefault(len(p), ([], []))
                at.append(i)
                own.append(p)
        out = np.full(len(units), max(-1.0, self.bias))
        for n, (at, own) in by.items():
            least = np.sqrt(sum(w * w for *_, w in _triples(n)))  # no unit of this length has a smaller norm
            for lo in range(0, len(own), 20_000):
                some, ids = own[lo : lo + 20_000], np.array(at[lo : lo + 20_000])
                s = project(some, self.table)
                near = np.flatnonzero(s / least + self.bias > -1)
                if len(near):
                    np.maximum.at(out, ids[near], s[near] / norms(_codes([some[i] for i in near])) + self.bias)
        return out


class Scorer:
    """Scores texts with one model, keeping the margins of tokens seen (a bounded store)."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """1, and of each text's different units the sum of their margins' lengths between knots."""
        found = [tokens(t) if t else set() for t in texts]
        if len(self.seen) > CACHE_ENTRIES:
            self.seen.clear()
        seen = self.seen
        new = list(set().union(*found).difference(seen)) if found else []
        units = [unit(t) for t in new]
        distinct = list(dict.fromkeys(units))
        margin = dict(zip(distinct, self.model.margins(distinct).tolist(), strict=True))
        seen.update((t, m if (m := margin[u]) > KNOTS[0] else None) for t, u in zip(new, units, strict=True))
        out = np.ones((len(texts), len(KNOTS)))
        low, high = np.array(KNOTS[:-1]), np.array(KNOTS[1:])
        for i, f in enumerate(found):
            own = sorted(m for m in map(seen.__getitem__, f) if m is not None)  # in order, so that sums come out alike
            out[i, 1:] = np.clip(np.array(own)[:, None] - low, 0, high - low).sum(0) if own else 0
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.landmarks or not texts:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ self.model.curve, -40, 40)))


def _growing_curve(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression whose slopes aren't below zero: those that would be are left out, the worst first."""
    on = np.ones(z.shape[1], dtype=bool)
    while True:
        x, c = z[:, on], np.zeros(on.sum())
        ridge = np.full(on.sum(), 0.05)
        ridge[0] = 1e-3
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * c)
            c += step
            if abs(step).max() < 1e-8:
                break
        out = np.zeros(z.shape[1])
        out[on] = c
        if (out[1:] >= 0).all():
            return out
        on[1 + int(out[1:].argmin())] = False


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * 1e-3
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        on = y * (z @ w) < 1
        zz = z[on] * weight[on, None]
        new = np.linalg.solve(ridge + zz.T @ z[on], zz.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1], float(w[-1])


def _varied(units: list[str], rng: np.random.Generator) -> list[str]:
    """Units with letters inserted, one variant for each number of INSERTED; letters as frequent as in the units."""
    letters = list("".join(u.strip(EDGE) for u in units))
    out = []
    for u in units:
        for k in INSERTED:
            own = list(u.strip(EDGE))
            for _ in range(k):
                own.insert(int(rng.integers(1, max(2, len(own)))), letters[int(rng.integers(len(letters)))])
            out += pieces("".join(own))
    return out


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Model of labelled texts."""
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    if not n1 or not n0:
        return Model()
    rng = np.random.default_rng(SEED)
    units = [sorted({u for t in tokens(x) if len(u := unit(t)) >= 3}) for x in texts]
    found = [sorted({p for u in f for p in pieces(u)}) for f in units]
    in1, in0 = Counter(), Counter()
    for f, t in zip(found, toxic, strict=True):
        (in1 if t else in0).update(f)
    excess = {}
    for u, k in in1.items():
        expected = (k + in0[u]) * n1 / len(toxic)
        if k >= 3 and k > 2 * expected:
            excess[u] = (k - expected) / np.sqrt(expected)
    heads = [u for u in sorted(excess, key=lambda u: (-excess[u], u))[:LANDMARKS] if excess[u] > LEAST_EXCESS] or sorted(excess)[:4]
    clean = sorted(in0)
    if not heads or not clean:
        return Model()
    others = [clean[i] for i in sorted(rng.choice(len(clean), min(LANDMARKS, len(clean)), replace=False))]
    marks = list(dict.fromkeys(heads + others))
    v = np.stack([explicit(u) for u in marks])
    values, vectors = np.linalg.eigh(v @ v.T)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    base = v.T @ root  # features of a unit: explicit(unit) @ base

    # frequent clean units first: an error on one of them costs the most texts
    some = sorted(in0, key=lambda u: (-in0[u], u))[: TRAIN_UNITS // 3]
    rest = sorted(set(in0) - set(some))
    some += [rest[i] for i in rng.permutation(len(rest))[: TRAIN_UNITS - len(some)]]
    rest = sorted(set(rest) - set(some))
    odd = _varied([some[i] for i in sorted(rng.choice(len(some), min(len(some), 2 * len(heads)), replace=False))], rng)
    bags = [[u for u in f if u in in1] for f, t in zip(found, toxic, strict=True) if t]
    witness = [u for b in bags for u in b if u in excess and excess[u] > LEAST_EXCESS]
    model = Model()
    for _ in range(ROUNDS):
        if not witness:
            break
        n = Counter(witness)
        names = sorted(n)
        # variants of whole insults that no clean text holds
        plain = [u for u in names if not in0[u] and u.startswith(EDGE) and u.endswith(EDGE)]
        more = [(p, n[u]) for u in plain for p in _varied([u], np.random.default_rng(SEED + len(u)))]
        x = embed(names + [u for u, _ in more] + some + odd, base)
        parts = [(np.array([n[u] for u in names], float), 1.0), (np.array([k for _, k in more], float), VARIED_SHARE), (np.array([in0[u] for u in some], float) ** 0.5, CLEAN_SHARE), (np.ones(len(odd)), VARIED_SHARE)]
        weight = np.concatenate([total * w / max(1.0, w.sum()) for w, total in parts]) * 2000
        toxic_units = len(names) + len(more)
        w, b = _svm(x, np.concatenate([np.ones(toxic_units), -np.ones(len(x) - toxic_units)]), weight)
        model = Model((base @ w).astype(np.float32), b, landmarks=heads)
        inside = sorted({u for f in bags for u in f})
        margin = dict(zip(inside, model.margins(inside), strict=True))
        witness = [u for f in bags for u in f if margin[u] > 0 and in1[u] > 2 * in0[u] * n1 / n0]
        # the clean units that the machine takes for toxic join the training
        hard = np.argsort(-model.margins(rest), kind="stable")[:HARD_UNITS] if rest else []
        some = some + [rest[i] for i in hard]
        rest = sorted(set(rest) - set(some))
    if not model.landmarks:
        return Model()
    model.curve = _growing_curve(Scorer(model).evidence(texts), np.array(toxic, float))
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of at most so many different labelled texts that aren't held out, drawn by a hash of the text."""
    able = labels.where(~held_out("doc_id") & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumnRenamed("doc_id", "id_")
    texts = docs.select("doc_id", "text", text_key().alias("key")).where(F.col("text").isNotNull() & (F.length("text") <= TRAIN_MOST_CHARS))
    keys = able.join(texts.select("doc_id", "key"), F.col("doc_id") == F.col("id_")).groupBy("key").agg(F.max("toxic").alias("toxic"))
    # the share of the texts that are drawn comes from a count, so that no task sorts all of them
    count = keys.count()
    share = min(1.0, (1.5 * rows + 20) / max(1, count))
    drawn = keys.where(F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("key", F.lit(SEED)), "key").limit(rows)
    # rows keys at most
    few = texts.join(F.broadcast(drawn.withColumnRenamed("key", "key_")), F.col("key") == F.col("key_"))
    return few.groupBy("key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model learned from a bounded sample of the labelled rows that aren't held out."""
    got = sample(docs, labels).toPandas().sort_values(["text", "toxic"], kind="stable")  # TRAIN_ROWS at most
    return fit(got["text"].tolist(), got["toxic"].tolist())


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in slices(batches):
            s = scorer.score(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    rows = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def toxic_sentences(text: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, margin) of the text's sentences with a unit on the toxic side beyond the machine's margin (1)."""
    out = []
    for m in re.finditer(r"[^.!?\n]+[.!?]*", text):
        worst = float(model.margins(sorted({unit(t) for t in tokens(m[0])}) or [""]).max())
        if worst >= 1:
            out.append((m.start(), m.end(), worst))
    return out
