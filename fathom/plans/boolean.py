"""The boolean query language: a parser to a small tree, and its plan over scored leaves.

AND binds tightest, then ANDNOT, then OR; elements side by side are an implicit AND, which binds loosest: ``cat or dog tree`` is
``(cat or dog) and tree``. Parentheses nest; a phrase stands in single quotes.
Chains of one operator are flat. Operators: and & &&; andnot not -; or | ||.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.analyze import tokens
from ..operators.expand import SparseEncoder, encode, expand
from ..operators.score import DIGITS, FEW_TERMS, scores, small, top_k
from .index import Index

# Spellings of the operators.
SPELLINGS = {"and": "AND", "&": "AND", "&&": "AND", "andnot": "ANDNOT", "-": "ANDNOT", "not": "ANDNOT", "or": "OR", "|": "OR", "||": "OR"}
_LEVELS = ("OR", "ANDNOT", "AND")  # loosest first


@dataclass(frozen=True)
class Term:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Phrase:
    text: str

    def __str__(self) -> str:
        return f"'{self.text}'"


@dataclass(frozen=True)
class Op:
    name: str
    parts: tuple

    def __str__(self) -> str:
        word = {"AND": " and ", "OR": " or ", "ANDNOT": " and not "}[self.name]
        return word.join(f"({p})" if isinstance(p, Op) else str(p) for p in self.parts)


Node = Term | Phrase | Op


def lex(query: str) -> list[tuple[str, str]]:
    """(kind, text) of a query's elements: LEFT, RIGHT, an operator's name, PHRASE or TERM."""
    out, words = [], [w for w in re.sub(r"([()])", r" \1 ", query.lower()).split(" ") if w]
    i = 0
    while i < len(words):
        w = words[i]
        if w in "()":
            out.append(("LEFT" if w == "(" else "RIGHT", w))
        elif w in SPELLINGS:
            out.append((SPELLINGS[w], w))
        elif w.startswith("'") and w.count("'") == 1:
            # a phrase runs to the word that ends in a quote; without one it is a term
            end = next((j for j in range(i + 1, len(words)) if words[j].endswith("'")), None)
            if end is None:
                out.append(("TERM", w))
            else:
                out.append(("PHRASE", " ".join(words[i : end + 1]).strip("'")))
                i = end
        else:
            out.append(("TERM", w))
        i += 1
    return out


def parse(query: str) -> Node | None:
    """Tree of a query; None if it is empty. Misplaced operators and parentheses raise ValueError."""
    elements = lex(query)
    if not elements:
        return None
    node, rest = _side_by_side(elements)
    if rest:
        raise ValueError(f"unexpected {rest[0][1]!r} in {query!r}")
    return node


def _side_by_side(e: list[tuple[str, str]]) -> tuple[Node, list[tuple[str, str]]]:
    parts = []
    while not parts or (e and e[0][0] in ("LEFT", "TERM", "PHRASE")):
        node, e = _level(e, 0)
        parts.append(node)
    return (parts[0] if len(parts) == 1 else Op("AND", tuple(parts))), e


def _level(e: list[tuple[str, str]], depth: int) -> tuple[Node, list[tuple[str, str]]]:
    if depth == len(_LEVELS):
        return _operand(e)
    name = _LEVELS[depth]
    node, e = _level(e, depth + 1)
    parts = [node]
    while e and e[0][0] == name:
        node, e = _level(e[1:], depth + 1)
        parts.append(node)
    if len(parts) == 1:
        return parts[0], e
    if name == "ANDNOT":
        out = parts[0]
        for p in parts[1:]:
            out = Op(name, (out, p))
        return out, e
    return Op(name, tuple(parts)), e


def _operand(e: list[tuple[str, str]]) -> tuple[Node, list[tuple[str, str]]]:
    if not e or e[0][0] not in ("LEFT", "TERM", "PHRASE"):
        raise ValueError("an operator lacks an operand" if e else "the query ends in an operator")
    kind, text = e[0]
    if kind != "LEFT":
        return (Phrase(text) if kind == "PHRASE" else Term(text)), e[1:]
    node, e = _side_by_side(e[1:])
    if not e or e[0][0] != "RIGHT":
        raise ValueError("a parenthesis isn't closed")
    return node, e[1:]


def leaves(node: Node) -> list[Term | Phrase]:
    return [x for p in node.parts for x in leaves(p)] if isinstance(node, Op) else [node]


def phrase_matches(texts: DataFrame, index: Index, cfg: SearchConfig) -> DataFrame:
    """qid, doc_id of texts(qid, query) whose every window of max_phrase_len tokens stands in the document consecutively, in one field.

    The index needs positions. Windows meet postings on the term; a window's start in the document is the place of each
    of its terms less its offset.
    """
    n = F.size("t")
    length = F.least(F.lit(cfg.max_phrase_len), n)
    terms = texts.select("qid", tokens(F.col("query"), index.analyzer).alias("t")).where(n > 0)
    terms = terms.withColumn("len", length).withColumn("n_windows", n - length + 1)
    terms = terms.withColumn("w", F.explode(F.expr("sequence(0, n_windows - 1)"))).select("qid", "len", "n_windows", "w", F.posexplode(F.expr("slice(t, w + 1, len)")).alias("j", "term"))
    known = sorted({r["term"] for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()})
    postings = index.postings_of(known) if len(known) <= FEW_TERMS else index.postings
    at = postings.join(small(terms), "term").select("qid", "field", "doc_id", "len", "n_windows", "w", "j", F.explode("positions").alias("pos"))
    starts = at.groupBy("qid", "field", "doc_id", "w", "len", "n_windows", (F.col("pos") - F.col("j")).alias("start")).agg(F.count("*").alias("k")).where("k = len")
    found = starts.groupBy("qid", "field", "doc_id", "n_windows").agg(F.count_distinct("w").alias("k")).where("k = n_windows")
    return found.select("qid", "doc_id").distinct()


def leaf_scores(spark: SparkSession, nodes: list[Term | Phrase], index: Index, cfg: SearchConfig, ranker: str = "bm25", expander: SparseEncoder | None = None) -> DataFrame:
    """qid (place in nodes), doc_id, score: all leaves in one pass, each cut to its leaf_topn best. An encoder expands the text of terms; phrases stay."""
    texts = spark.createDataFrame([(i, n.text) for i, n in enumerate(nodes)], "qid long, query string")
    asked = texts
    if expander is not None:
        terms = [i for i, n in enumerate(nodes) if isinstance(n, Term)]
        asked = expand(encode(texts.where(F.col("qid").isin(terms)), expander)).unionByName(texts.where(~F.col("qid").isin(terms)))
    scored = scores(asked, index, cfg, ranker)
    phrases = [i for i, n in enumerate(nodes) if isinstance(n, Phrase)]
    if phrases:
        match = phrase_matches(texts.where(F.col("qid").isin(phrases)), index, cfg)
        scored = scored.where(~F.col("qid").isin(phrases)).unionByName(scored.join(match, ["qid", "doc_id"]))
    return scored if cfg.leaf_topn is None else top_k(scored, cfg.leaf_topn).select("qid", "doc_id", "score")


def execute(spark: SparkSession, query: str, index: Index, cfg: SearchConfig = SearchConfig(), ranker: str = "bm25", expander: SparseEncoder | None = None) -> DataFrame:
    """doc_id, score of the documents that match a boolean query.

    AND sums the scores of documents in all operands, OR of those in any, ANDNOT keeps the left score. An operand
    without a token (stopwords only) is neutral wherever it stands.
    """
    empty = spark.createDataFrame([], f"doc_id {index.doc_stats.schema['doc_id'].dataType.simpleString()}, score double")
    node = parse(query)
    if node is None:
        return empty
    flat = leaves(node)
    texts = spark.createDataFrame([(i, n.text) for i, n in enumerate(flat)], "qid long, query string")
    blank = {r[0] for r in texts.where(F.size(tokens(F.col("query"), index.analyzer)) == 0).select("qid").collect()}
    scored = leaf_scores(spark, flat, index, cfg, ranker, expander)
    number = iter(range(len(flat)))

    def plan(n: Node) -> DataFrame | None:
        if not isinstance(n, Op):
            i = next(number)
            return None if i in blank else scored.where(F.col("qid") == i).select("doc_id", "score")
        if n.name != "ANDNOT" and all(not isinstance(p, Op) for p in n.parts):
            # an operator over leaves is one aggregation, not a join for each
            ids = [i for i in (next(number) for _ in n.parts) if i not in blank]
            if not ids:
                return None
            both = scored.where(F.col("qid").isin(ids)).groupBy("doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"), F.count("*").alias("k"))
            return both.where(F.col("k") == len(ids)).drop("k") if n.name == "AND" else both.drop("k")
        parts = [plan(p) for p in n.parts]
        if n.name == "ANDNOT":
            left, right = parts
            return left if left is None or right is None else left.join(right, "doc_id", "left_anti")
        have = [p for p in parts if p is not None]
        if not have:
            return None
        union = have[0]
        for p in have[1:]:
            union = union.unionByName(p)
        both = union.groupBy("doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"), F.count("*").alias("k"))
        return both.where(F.col("k") == len(have)).drop("k") if n.name == "AND" else both.drop("k")

    out = plan(node)
    return empty if out is None else out


def search_boolean(spark: SparkSession, query: str, index: Index, cfg: SearchConfig = SearchConfig(), k: int | None = None, ranker: str = "bm25", ascending: bool = False, expander: SparseEncoder | None = None) -> tuple[DataFrame, int, str]:
    """(rank, doc_id, score of the best k; matches before the cut; the query as it was read). ascending: worst first, as a compatibility."""
    found = execute(spark, query, index, cfg, ranker, expander)
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("doc_id")]
    best = found.orderBy(*order).limit(cfg.max_results if k is None else k).collect()  # k rows
    ranked = spark.createDataFrame([(i, r["doc_id"], r["score"]) for i, r in enumerate(best, 1)], f"rank int, doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")
    node = parse(query)
    return ranked, found.count(), "" if node is None else str(node)
