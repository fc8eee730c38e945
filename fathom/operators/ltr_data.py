"""Learning-to-rank data: splits, candidates, samples and features."""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEATURES, LtrConfig, SearchConfig
from ..functions.analyze import tokens
from ..plans.index import Index
from .score import DIGITS, NARROW_ROWS, search, small


def split_queries(qids: DataFrame, seed: int = 42, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """qid, split of the distinct qids, in order of the md5 of seed and qid: exact sizes, the rest goes to test.

    The places come from counts by hash range, so that no task sorts all qids.
    """
    if abs(sum(fractions) - 1) > 1e-6 or min(fractions) <= 0:
        raise ValueError("fractions have to be positive and sum to 1")
    from pyspark.sql import Window

    at = qids.select("qid").where("qid IS NOT NULL").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), "qid"))).withColumn("g", F.substring("h", 1, 3))
    total = at.count()
    if not total:
        raise ValueError("no qid to split")
    # one row for each of 4096 ranges
    ahead = at.groupBy("g").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("g").orderBy("h", "qid"))
    n_train, n_val = int(total * fractions[0]), int(total * fractions[1])
    return at.join(F.broadcast(ahead), "g").withColumn("p", place).select("qid", F.when(F.col("p") <= n_train, "train").when(F.col("p") <= n_train + n_val, "val").otherwise("test").alias("split"))


def split_exact(qids: list[int], seed: int = 42, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> dict[str, list[int]]:
    """The split of a list on the driver by Python's own shuffle, for small lists that have to agree with one made elsewhere."""
    own = sorted(set(qids))
    if not own:
        raise ValueError("no qid to split")
    if abs(sum(fractions) - 1) > 1e-6 or min(fractions) <= 0:
        raise ValueError("fractions have to be positive and sum to 1")
    random.Random(seed).shuffle(own)
    a, b = int(len(own) * fractions[0]), int(len(own) * fractions[1])
    return {"train": own[:a], "val": own[a : a + b], "test": own[a + b :]}


def candidates(queries: DataFrame, index: Index, cfg: SearchConfig = SearchConfig(), topn: int = 200) -> DataFrame:
    """qid, docid, bm25, rank: one plan for all queries."""
    return search(queries, index, cfg, topn).select("qid", F.col("doc_id").alias("docid"), F.col("score").alias("bm25"), "rank")


def labelled(cands: DataFrame, qrels: DataFrame) -> DataFrame:
    """Candidates with label: 1 if relevant, else 0."""
    rel = qrels.where("rel > 0").select("qid", "docid", F.lit(1).alias("label")).distinct()
    return cands.join(small(rel, NARROW_ROWS), ["qid", "docid"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def map_positives(qrels: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relevant pairs whose document is in the index; a row with the number of those that aren't)."""
    known = docs.select(F.col("doc_id").alias("docid")).distinct()
    rel = qrels.where("rel > 0")
    return rel.join(known, "docid", "left_semi"), rel.join(known, "docid", "left_anti").agg(F.count("*").alias("unmapped"))


def work_items(queries: DataFrame, qrels: DataFrame, limit: int | None = None) -> DataFrame:
    """Queries with a text and a relevant document; the first so many by qid."""
    out = queries.join(qrels.where("rel > 0").select("qid"), "qid", "left_semi")
    return out if limit is None else out.orderBy("qid").limit(limit)


def hard_pool(cands: DataFrame, qrels: DataFrame, size: int = 50) -> DataFrame:
    """The first so many candidates of each query that aren't relevant, in order of rank."""
    from pyspark.sql import Window

    negative = cands.join(small(qrels.where("rel > 0").select("qid", "docid"), NARROW_ROWS), ["qid", "docid"], "left_anti")
    return negative.withColumn("pool_rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("pool_rank") <= size)


def draw(seed: int, *what: Column | str) -> Column:
    """A number below 2^32 from the md5 of a seed and what is drawn for."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *what)), 1, 8), 16, 10).cast("long")


def pools_of(lists: DataFrame, cfg: LtrConfig = LtrConfig()) -> DataFrame:
    """qid, pos and pool of lists(qid, rel, docs, scores): relevant candidates by docid, and the hard pool by rank. What is drawn from them needs no other rows of the query."""
    at = lists.select("qid", "rel", F.arrays_zip(F.col("docs").alias("docid"), F.col("scores").alias("bm25")).alias("c"))
    hit = "coalesce(array_contains(rel, x.docid), false)"
    return at.select("qid", F.expr(f"array_sort(filter(c, x -> {hit}))").alias("pos"), F.expr(f"slice(filter(c, x -> NOT {hit}), 1, {cfg.hard_pool})").alias("pool"))


def _pools(cands: DataFrame, qrels: DataFrame, cfg: LtrConfig) -> DataFrame:
    """qid, pos and pool (arrays of docid and bm25) of queries: relevant candidates by docid, and the hard pool by rank. A query's candidates are at most topn."""
    of = labelled(cands, qrels).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "docid", "bm25", "label"))).alias("c"))
    pos = F.expr("array_sort(transform(filter(c, x -> x.label = 1), x -> struct(x.docid AS docid, x.bm25 AS bm25)))")
    return of.select("qid", pos.alias("pos"), F.expr(f"slice(transform(filter(c, x -> x.label = 0), x -> struct(x.docid AS docid, x.bm25 AS bm25)), 1, {cfg.hard_pool})").alias("pool"))


def pair_samples(cands: DataFrame, qrels: DataFrame, neg_per_pos: int = 4, cfg: LtrConfig = LtrConfig()) -> DataFrame:
    """qid, pos_docid, neg_docid, pos_bm25, neg_bm25: negatives drawn with replacement from the hard pool of each query.

    The draw is by md5 of seed, qid, positive and number, so reruns agree however rows are dealt out.
    """
    return pairs_of(_pools(cands, qrels, cfg), neg_per_pos, cfg)


def pairs_of(pools: DataFrame, neg_per_pos: int = 4, cfg: LtrConfig = LtrConfig()) -> DataFrame:
    """As pair_samples, of pools(qid, pos, pool)."""
    at = pools.where(F.size("pool") > 0).select("qid", "pool", F.explode("pos").alias("p")).select("qid", "pool", "p", F.explode(F.sequence(F.lit(1), F.lit(neg_per_pos))).alias("k"))
    one = F.get("pool", F.pmod(draw(cfg.seed, "qid", "p.docid", "k"), F.size("pool")).cast("int"))
    at = at.select("qid", "p", one.alias("n"))
    return at.select("qid", F.col("p.docid").alias("pos_docid"), F.col("n.docid").alias("neg_docid"), F.col("p.bm25").alias("pos_bm25"), F.col("n.bm25").alias("neg_bm25"))


def listwise_samples(cands: DataFrame, qrels: DataFrame, cfg: LtrConfig = LtrConfig()) -> DataFrame:
    """qid, docid, bm25, label, slot: for each query one positive and list_size - 1 hard negatives, in order of their draws.

    The positive is the first by draw; negatives are the first by draw without replacement if the pool is large enough, else each is drawn anew. A query without a
    positive among its candidates, or without a negative, gives nothing, as does a list size under 2. Draws are by md5 of seed, qid, and what is drawn.
    """
    size = cfg.list_size
    if size < 2:
        return cands.select("qid", "docid", "bm25", F.lit(0.0).cast("float").alias("label"), F.lit(0).alias("slot")).limit(0)
    at = _pools(cands, qrels, cfg).where((F.size("pos") > 0) & (F.size("pool") > 0))
    by_draw = lambda a, tag: F.array_sort(F.transform(a, lambda x: F.struct(draw(cfg.seed, "qid", x["docid"], F.lit(tag)).alias("d"), x["docid"].alias("docid"), x["bm25"].alias("bm25"))))
    fresh = F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda k: F.get("pool", F.pmod(draw(cfg.seed, "qid", k, F.lit("again")), F.size("pool")).cast("int")))
    first = F.transform(F.slice(by_draw("pool", "neg"), 1, size - 1), lambda x: F.struct(x["docid"].alias("docid"), x["bm25"].alias("bm25")))
    one = F.get(by_draw("pos", "pos"), F.lit(0))
    taken = F.concat(F.array(F.struct(one["docid"].alias("docid"), one["bm25"].alias("bm25"), F.lit(1).alias("y"))), F.transform(F.when(F.size("pool") >= size - 1, first).otherwise(fresh), lambda x: F.struct(x["docid"].alias("docid"), x["bm25"].alias("bm25"), F.lit(0).alias("y"))))
    at = at.select("qid", F.posexplode(taken).alias("k", "x")).select("qid", "k", "x.*")
    at = at.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(draw(cfg.seed, "qid", "k", F.lit("slot")).alias("d"), "k", "docid", "bm25", "y"))).alias("r"))
    return at.select("qid", F.posexplode("r").alias("slot", "x")).select("qid", "x.docid", "x.bm25", F.col("x.y").cast("float").alias("label"), "slot")


def sampling_status(queries: DataFrame, cands: DataFrame, qrels: DataFrame, cfg: LtrConfig = LtrConfig()) -> DataFrame:
    """qid, status of every query: ok, or why it gives no list (no_candidates, no_relevant, no_relevant_candidate, no_negative, list_size)."""
    return status_of(queries, pool_sizes(_pools(cands, qrels, cfg)), qrels, cfg)


def pool_sizes(pools: DataFrame) -> DataFrame:
    return pools.select("qid", F.size("pos").alias("p"), F.size("pool").alias("n"))


def status_of(queries: DataFrame, pools: DataFrame, qrels: DataFrame, cfg: LtrConfig = LtrConfig()) -> DataFrame:
    """As sampling_status, of the pools' sizes(qid, p, n)."""
    rel = qrels.where("rel > 0").select("qid").distinct().withColumn("r", F.lit(1))
    at = queries.select("qid").distinct().join(pools, "qid", "left").join(rel, "qid", "left")
    why = F.when(F.lit(cfg.list_size < 2), "list_size").when(F.col("r").isNull(), "no_relevant").when(F.col("p").isNull(), "no_candidates").when(F.col("p") == 0, "no_relevant_candidate").when(F.col("n") == 0, "no_negative")
    return at.select("qid", why.otherwise("ok").alias("status"))


def online_lists(queries: DataFrame, qrels: DataFrame, index: Index, search_cfg: SearchConfig = SearchConfig(), cfg: LtrConfig = LtrConfig(), max_queries: int | None = None) -> DataFrame:
    """Listwise samples from retrieval as it runs: candidates of the first max_queries queries (by qid) that have any hit. A list size under 2 is an error."""
    if cfg.list_size < 2:
        raise ValueError("a list needs a positive and a negative at least")
    cands = candidates(work_items(queries, qrels), index, search_cfg, cfg.topn)
    if max_queries is not None:
        cands = cands.join(F.broadcast(cands.select("qid").distinct().orderBy("qid").limit(max_queries)), "qid", "left_semi")
    return listwise_samples(cands, qrels, cfg)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def features(cands: DataFrame, queries: DataFrame, corpus: DataFrame, index: Index, cfg: SearchConfig = SearchConfig(), names: tuple[str, ...] = FEATURES) -> DataFrame:
    """qid, docid and the named features of each candidate(qid, docid, bm25).

    IDF comes from the body index for both fields and is 0 for terms that are absent or above the postings cut. Tokens are those that the index keeps; without
    them, the candidates' documents are analyzed.
    """
    q = queries.select("qid", tokens(F.col("query"), index.analyzer).alias("q")).select("qid", F.size("q").alias("ql"), F.array_distinct("q").alias("u"))
    stats = index.term_stats.where(F.col("field") == "body").select("term", "df")
    idf = F.when((F.col("df") > 0) & (F.col("df") <= cfg.postings_cut), F.log((F.lit(float(cfg.num_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).otherwise(F.lit(0.0))
    # terms sorted, so that sums of idf come out alike
    weights = q.select("qid", F.explode("u").alias("term")).join(stats, "term", "left").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", F.coalesce(idf, F.lit(0.0)).alias("idf")))).alias("w"))
    q = q.select("qid", "ql").join(weights, "qid", "left")
    empty = F.expr("CAST(array() AS array<struct<term: string, idf: double>>)")
    wanted = cands.select(F.col("docid").alias("doc_id")).distinct()
    # lengths and terms of a document; array_distinct of so many words takes far longer than looking them through
    if index.doc_terms is not None and {"title", "body"} <= set(index.fields):
        # the index keeps the analysis
        terms = index.doc_terms.where(F.col("field").isin("title", "body")).select("doc_id", "field", F.size("tokens").alias("n"), F.col("tokens").alias("d"))
        of = lambda field, c: F.first(F.when(F.col("field") == field, F.col(c)), True)
        docs = terms.join(wanted, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("docid")).agg(of("title", "n").alias("tl"), of("body", "n").alias("bl"), of("title", "d").alias("t"), of("body", "d").alias("b"))
    else:
        docs = corpus.select("doc_id", tokens(F.col("title"), index.analyzer).alias("t"), tokens(F.col("body"), index.analyzer).alias("b"))
        docs = docs.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("docid"), F.size("t").alias("tl"), F.size("b").alias("bl"), "t", "b")
    # the narrow rows of candidates meet the documents; what belongs to the queries comes to them after that
    at = cands.join(docs, "docid", "left").join(small(q, NARROW_ROWS), "qid")
    none = F.expr("CAST(array() AS array<string>)")
    at = at.withColumn("t", F.coalesce("t", none)).withColumn("b", F.coalesce("b", none)).withColumn("w", F.coalesce("w", empty))
    shared = lambda field: F.filter("w", lambda x: F.array_contains(F.col(field), x["term"]))
    at = at.select(*cands.columns, "ql", F.size("w").alias("ul"), F.coalesce("tl", F.lit(0)).alias("tl"), F.coalesce("bl", F.lit(0)).alias("bl"), shared("t").alias("t"), shared("b").alias("b"))
    over = lambda field: _sum(F.transform(field, lambda x: x["idf"]))
    made = {
        "bm25_score": F.col("bm25"), "query_len": F.col("ql"), "query_uniq_len": F.col("ul"), "title_len": F.col("tl"), "body_len": F.col("bl"), "title_overlap_cnt": F.size("t"), "body_overlap_cnt": F.size("b"),
        "body_overlap_ratio": F.size("b") / F.greatest(F.lit(1), F.col("ul")), "idf_body_overlap_sum": over("b"), "idf_title_overlap_sum": over("t"),
    }
    keep = [c for c in cands.columns if c not in ("qid", "docid", "bm25")]
    return at.select("qid", "docid", *keep, *[F.round(made[n].cast("double"), DIGITS).alias(n) for n in names])


def feature_lists(featured: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """qid, features array<array<float>>, labels array<float> of featured(qid, slot, label, names...), by slot: the feature cache."""
    row = F.struct("slot", F.array(*[F.col(n).cast("float") for n in names]).alias("x"), F.col("label").cast("float").alias("y"))
    by = featured.groupBy("qid").agg(F.sort_array(F.collect_list(row)).alias("r"))
    return by.select("qid", F.col("r.x").alias("features"), F.col("r.y").alias("labels"))


def training_lists(lists: DataFrame, cfg: LtrConfig = LtrConfig()) -> DataFrame:
    """At most max_lists of the lists, chosen by md5 of seed and qid, so that reruns take the same ones."""
    return lists.orderBy(F.md5(F.concat_ws(":", F.lit(cfg.seed), "qid")), "qid").limit(cfg.max_lists)


def write_lists(lists: DataFrame, path: str, force: bool = False) -> None:
    """The feature cache on disk."""
    lists.write.mode("overwrite" if force else "errorifexists").parquet(path)


def read_lists(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).select("qid", "features", "labels")


def lists_of(rows: DataFrame) -> Iterator[tuple[list, list]]:
    """(features, labels) of each query, one partition at a time."""
    for r in rows.orderBy("qid").toLocalIterator():
        yield r["features"], r["labels"]
