"""Ranking metrics and reports as aggregations over per-query rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .score import DIGITS, NARROW_ROWS, small

RECALL_AT = (10, 50, 100, 500, 1000)


def with_hits(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """ranked(qid, doc_id, rank) with hit: whether the document is relevant to the query."""
    rel = qrels.where("rel > 0").select("qid", F.col("docid").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    return ranked.join(small(rel, NARROW_ROWS), ["qid", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def relevant(qrels: DataFrame) -> DataFrame:
    """qid, rel: each query's relevant documents, to go along with it through the ranking."""
    return qrels.where("rel > 0").groupBy("qid").agg(F.collect_set("docid").alias("rel"))


def ranks_of(lists: DataFrame) -> DataFrame:
    """qid, n_rel, ranks of lists(qid, rel, docs): how many documents are relevant, null without a judgement, and the ranks of those in the list, in order."""
    at = F.transform("rel", lambda d: F.array_position("docs", d))
    return lists.select("qid", F.when(F.col("rel").isNotNull(), F.size("rel")).alias("n_rel"), F.array_sort(F.filter(at, lambda r: r > 0)).alias("ranks"))


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, mrr, ndcg of the queries that have both a ranking and a relevant document.

    The ideal gain is over all relevant documents, whether they were retrieved or not; k of zero or less gives 0.
    """
    n_rel = qrels.where("rel > 0").groupBy("qid").agg(F.count_distinct("docid").alias("n_rel"))
    top = F.col("hit") & (F.col("rank") <= k)
    ln2 = F.log(F.lit(2.0))
    by = with_hits(ranked, qrels).groupBy("qid").agg(F.min(F.when(top, F.col("rank"))).alias("first"), F.sum(F.when(top, ln2 / F.log(F.col("rank") + 1.0))).alias("dcg"))
    return _gains(by.join(n_rel, "qid"), k)


def per_list(ranks: DataFrame, k: int = 10) -> DataFrame:
    """As per_query, of the rows of ranks_of."""
    top = F.filter("ranks", lambda r: r <= k)
    dcg = F.aggregate(top, F.lit(0.0), lambda s, r: s + F.log(F.lit(2.0)) / F.log(r + 1.0))
    return _gains(ranks.where("n_rel IS NOT NULL").select("qid", "n_rel", F.array_min(top).alias("first"), dcg.alias("dcg")), k)


def _gains(by: DataFrame, k: int) -> DataFrame:
    ln2 = F.log(F.lit(2.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("n_rel").cast("int")))), F.lit(0.0), lambda s, i: s + ln2 / F.log(i + 1.0))
    return by.select("qid", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def compare(rankings: dict[str, DataFrame], qrels: DataFrame, k: int = 10) -> DataFrame:
    """ranking, queries_evaluated, mrr, ndcg of several rankings(qid, docid, rank) of the same queries, a row each."""
    out: DataFrame | None = None
    for name, ranked in rankings.items():
        one = evaluate(ranked.select("qid", F.col("docid").alias("doc_id"), "rank"), qrels, k).select(F.lit(name).alias("ranking"), "queries_evaluated", "mrr", "ndcg")
        out = one if out is None else out.unionByName(one)
    return out


def containing(docs: DataFrame, passages: DataFrame, words: int = 4) -> DataFrame:
    """qid, doc_id of docs(doc_id, text) that hold a passage of passages(qid, passage) whole.

    Documents meet passages on the hash of a passage's first whole words, with what stands between them, and are then searched; passages of fewer words than that are
    met by a scan, broadcast if they are few.
    """
    # from the second word on, as the first may be cut; a passage of blanks and one word has no such run
    run = rf"(?<=\s)\S+(?:\s+\S+){{{words - 1}}}(?=\s)"
    keyed = passages.withColumn("key", F.regexp_extract("passage", run, 0))
    long, short = keyed.where("key != ''"), keyed.where("key = ''").drop("key")
    starts = F.expr(f"transform(regexp_extract_all(text, '(?<=\\\\s)(?=(\\\\S+(?:\\\\s+\\\\S+){{{words - 1}}})\\\\s)', 1), x -> xxhash64(x))")
    hashed = docs.select("doc_id", "text", F.explode(F.array_distinct(starts)).alias("h"))
    found = hashed.join(small(long.withColumn("h", F.xxhash64("key"))), "h").where(F.contains("text", "passage")).select("qid", "doc_id")
    if not short.isEmpty():
        found = found.unionByName(docs.join(small(short), F.contains("text", "passage")).select("qid", "doc_id"))
    return found.distinct()


def evaluate(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """queries_evaluated, mrr, ndcg in one row; means over nothing are 0."""
    p = per_query(ranked, qrels, k)
    return p.agg(F.count("*").alias("queries_evaluated"), *[F.round(F.coalesce(F.avg(m), F.lit(0.0)), DIGITS).alias(m) for m in ("mrr", "ndcg")])


def candidate_recall(candidates: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_count, recall_at_n, avg_pos_in_candidates in one row, over queries with candidates and relevant documents."""
    rel = qrels.where("rel > 0").select("qid").distinct()
    by = with_hits(candidates, qrels).join(rel, "qid").groupBy("qid").agg(F.count_if("hit").alias("hits"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), DIGITS)
    return by.agg(F.count("*").alias("query_count"), mean((F.col("hits") > 0).cast("double")).alias("recall_at_n"), mean(F.col("hits").cast("double")).alias("avg_pos_in_candidates"))


def funnel(qids: DataFrame, queries: DataFrame, qrels: DataFrame, docs: DataFrame, ranked: DataFrame, topn: int = 200) -> DataFrame:
    """stage, n, retention, step of how many qids have a text, relevant documents, any in the index, any in the top n. ranked: rows, or those of ranks_of."""
    rel = qrels.where("rel > 0").select("qid", F.col("docid").alias("doc_id")).distinct()
    text = queries.select("qid", F.lit(1).alias("a")).distinct()
    inside = rel.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("qid").distinct().withColumn("c", F.lit(1))
    hit = ranked.where(F.exists("ranks", lambda r: r <= topn)) if "ranks" in ranked.columns else with_hits(ranked.where(F.col("rank") <= topn), qrels).where("hit")
    top = hit.select("qid").distinct().withColumn("d", F.lit(1))
    status = qids.select("qid").distinct().join(text, "qid", "left").join(rel.select("qid").distinct().withColumn("b", F.lit(1)), "qid", "left").join(inside, "qid", "left").join(top, "qid", "left")
    names = ("total", "has_text", "has_positives", "positive_in_index", "positive_in_top")
    so_far, counts = F.lit(True), [F.count("*")]
    for c in "abcd":
        so_far = so_far & F.col(c).isNotNull()
        counts.append(F.count_if(so_far))
    row = status.agg(F.array(*counts).alias("n")).select(F.posexplode("n").alias("i", "n"), F.col("n").alias("all"))
    total, before = F.expr("all[0]"), F.expr("all[greatest(i - 1, 0)]")
    share = lambda d: F.round(F.when(d > 0, F.col("n") / d).otherwise(F.lit(0.0)), DIGITS)
    return row.select(F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("stage"), "n", share(total).alias("retention"), share(before).alias("step"))


def funnel_warnings(row: DataFrame, least: float = 0.5) -> list[str]:
    """What a funnel's rows(stage, n, retention, step) say is wrong: stages that keep less than a share of the one before. Five rows come to the driver."""
    return [f"{r['stage']}: {r['n']} queries left, {r['step']:.2f} of the stage before" for r in row.collect() if r["step"] < least]


def recall_curve(ranked: DataFrame, qrels: DataFrame, topn: int = 200) -> DataFrame:
    """n, recall: share of queries with a relevant document among the first n."""
    return _curve(with_hits(ranked, qrels).groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first")), topn)


def recall_of(ranks: DataFrame, topn: int = 200) -> DataFrame:
    """As recall_curve, of the rows of ranks_of."""
    return _curve(ranks.select(F.array_min("ranks").alias("first")), topn)


def _curve(by: DataFrame, topn: int) -> DataFrame:
    at = sorted({*RECALL_AT, topn})
    return by.select(F.explode(F.array(*map(F.lit, at))).alias("n"), "first").groupBy("n").agg(F.round(F.avg(F.coalesce((F.col("first") <= F.col("n")).cast("double"), F.lit(0.0))), DIGITS).alias("recall"))
