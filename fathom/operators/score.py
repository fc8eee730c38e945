"""Ranked retrieval: scores of postings, sums per query and document, top-k and hydration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.analyze import tokens
from ..plans.index import Index
from .batch import top_many

#: Most rows of a side that is sent to every executor.
BROADCAST_ROWS = 50_000
#: As BROADCAST_ROWS, of rows that hold a few numbers or words.
NARROW_ROWS = 500_000
#: Most query terms that are read on the driver and reach the postings' scan as literals.
FEW_TERMS = 500
#: Scores are rounded so that sums don't depend on how rows were dealt out.
DIGITS = 6


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bm25(tf: Column, df: Column, doc_len: Column, field: Column, cfg: SearchConfig) -> Column:
    """The field's weight multiplies tf before saturation; N and average lengths are configured."""
    weight, avg = _by_field(field, cfg, "weight"), _by_field(field, cfg, "avg_len")
    idf = F.log((F.lit(float(cfg.num_docs)) - df + 0.5) / (df + 0.5) + 1.0)
    w = tf * weight
    return idf * (w * (cfg.k1 + 1.0)) / (w + cfg.k1 * (1.0 - cfg.b + cfg.b * doc_len / avg))


def tfidf(tf: Column, df: Column, doc_len: Column, field: Column, cfg: SearchConfig) -> Column:
    return F.log(1.0 + tf) * F.log(F.lit(float(cfg.num_docs)) / (df + 1)) * _by_field(field, cfg, "weight")


def _by_field(field: Column, cfg: SearchConfig, what: str) -> Column:
    out = F.lit(float(getattr(cfg.of(""), what)))
    for name, f in cfg.fields.items():
        out = F.when(field == name, F.lit(float(getattr(f, what)))).otherwise(out)
    return out


Scorer = Callable[[Column, Column, Column, Column, SearchConfig], Column]
#: Rankers by name: scorer, and whether terms above the postings cut are left out.
RANKERS: dict[str, tuple[Scorer, bool]] = {"bm25": (bm25, True), "tfidf": (tfidf, False)}


def register(name: str, scorer: Scorer, cut: bool = False) -> None:
    RANKERS[name] = scorer, cut


def get_ranker(name: str) -> tuple[Scorer, bool]:
    if name not in RANKERS:
        raise ValueError(f"no ranker {name!r}; there are {', '.join(sorted(RANKERS))}")
    return RANKERS[name]


def query_terms(queries: DataFrame, index: Index) -> DataFrame:
    """qid, term, qtf of queries(qid, query): a token that comes twice counts twice."""
    return queries.select("qid", F.explode(tokens(F.col("query"), index.analyzer)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def scores(queries: DataFrame, index: Index, cfg: SearchConfig = SearchConfig(), ranker: str = "bm25") -> DataFrame:
    """qid, doc_id, score of every document that holds a term of the query.

    The terms of a few queries are literals of the scans, so that a saved index reads their buckets and row groups only; those of many
    queries meet the postings in a join.
    """
    scorer, cut = get_ranker(ranker)
    terms, postings, stats = query_terms(queries, index), index.postings, index.term_stats
    few = terms.limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        known = sorted({r["term"] for r in few})
        terms = queries.sparkSession.createDataFrame([tuple(r) for r in few], terms.schema)
        postings, stats = index.postings_of(known), stats.where(F.col("term").isin(known))
    if cut:
        stats = stats.where(F.col("df") <= cfg.postings_cut)  # before the postings are touched
    # the terms asked for, with their df: the postings meet this side only
    wanted = terms.join(stats.select("field", "term", "df"), "term")
    wanted = F.broadcast(wanted) if len(few) <= FEW_TERMS else small(wanted)
    hits = postings.join(wanted, ["field", "term"])
    part = F.round(F.col("qtf") * scorer(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("field"), cfg), DIGITS)
    return hits.select("qid", "doc_id", part.alias("s")).groupBy("qid", "doc_id").agg(F.round(F.sum("s"), DIGITS).alias("score"))


def scores_of(pairs: DataFrame, queries: DataFrame, index: Index, cfg: SearchConfig = SearchConfig(), ranker: str = "bm25") -> DataFrame:
    """pairs(qid, doc_id, ...) with score, as in scores and null where no term is shared; only these pairs meet, with the terms that the index keeps of their documents."""
    scorer, cut = get_ranker(ranker)
    if index.doc_terms is None:
        return pairs.join(scores(queries, index, cfg, ranker), ["qid", "doc_id"], "left")
    stats = index.term_stats.where(F.col("df") <= cfg.postings_cut) if cut else index.term_stats
    wanted = query_terms(queries, index).join(stats.select("field", "term", "df"), "term").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("field", "term", "df", "qtf"))).alias("w_"))
    held = index.doc_terms.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    docs = held.groupBy("doc_id").agg(*[F.first(F.when(F.col("field") == f, F.col("tokens")), True).alias(f"t{i}_") for i, f in enumerate(index.fields)])
    at = pairs.join(docs, "doc_id", "left").join(small(wanted, NARROW_ROWS), "qid", "left")
    parts = [_parts(f, F.col(f"t{i}_"), scorer, cfg) for i, f in enumerate(index.fields)]
    at = at.select(*pairs.columns, F.concat(*parts).alias("s_"))
    return at.select(*pairs.columns, F.when(F.size("s_") > 0, F.round(F.aggregate("s_", F.lit(0.0), lambda a, b: a + b), DIGITS)).alias("score"))


def _parts(field: str, own: Column, scorer: Scorer, cfg: SearchConfig) -> Column:
    """Scores of the terms in w_ that stand in a field whose tokens are own."""
    here = F.filter("w_", lambda x: (x["field"] == field) & F.array_contains(own, x["term"]))
    counted = F.transform(here, lambda x: F.struct(x["df"].alias("df"), x["qtf"].alias("qtf"), F.size(F.filter(own, lambda t: t == x["term"])).alias("tf")))
    scored = F.transform(counted, lambda x: F.round(x["qtf"] * scorer(x["tf"], x["df"], F.size(own), F.lit(field), cfg), DIGITS))
    return F.coalesce(scored, F.expr("CAST(array() AS array<double>)"))


def top_k(scored: DataFrame, k: int, by: str = "score", ties: str = "doc_id") -> DataFrame:
    """scored with rank, the best k of each qid; ties go to the smaller id. Partitions cut to k before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.col(by).desc(), F.col(ties))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def listed(ranked: DataFrame, along: DataFrame | None = None) -> DataFrame:
    """A row for each query of ranked(qid, rank, doc_id, score): qid, what along(qid, ...) holds of it, docs and scores in order of rank."""
    by = ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r"))
    by = by if along is None else by.join(along, "qid", "left")
    return by.select(*[c for c in by.columns if c != "r"], F.col("r.doc_id").alias("docs"), F.col("r.score").alias("scores"))


def search(
    queries: DataFrame, index: Index, cfg: SearchConfig = SearchConfig(), k: int | None = None, ranker: str = "bm25", along: DataFrame | None = None, then: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """qid, rank, doc_id, score. Many queries are ranked at once, block by block, without a row for every pair that shares a term.

    With then: what it makes of the rows of ``listed``. Many queries' lists go to it as they are ranked, neither written nor shuffled.
    """
    k = cfg.max_results if k is None else k
    if k <= 0:
        none = scores(queries, index, cfg, ranker).withColumn("rank", F.lit(0)).limit(0).select("qid", "rank", "doc_id", "score")
        return none if then is None else then(listed(none, along))
    scorer, cut = get_ranker(ranker)
    terms = query_terms(queries, index)
    if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS:
        best = top_k(scores(queries, index, cfg, ranker), k).select("qid", "rank", "doc_id", "score")
        return best if then is None else then(listed(best, along))
    stats = index.term_stats.where(F.col("df") <= cfg.postings_cut) if cut else index.term_stats
    part = F.col("qtf") * scorer(F.col("tf"), F.col("df"), F.col("doc_len"), F.col("field"), cfg)
    return top_many(terms, stats, index, part, DIGITS, k, along, then)


def hydrate(ranked: DataFrame, corpus: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """ranked with columns of the corpus, joined after the cut to k so that few rows meet the wide table; a hit without a document keeps nulls."""
    found = corpus.join(small(ranked.select(F.col("doc_id").alias("hit_")).distinct()), F.col("doc_id") == F.col("hit_"), "left_semi").select("doc_id", *columns)
    return ranked.join(found, "doc_id", "left")
