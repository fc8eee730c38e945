"""Named queries over the driver's tables, each with the same rows as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FEATURES, AnalyzerConfig, FieldConfig, LtrConfig, SearchConfig
from .functions.analyze import STOPWORDS, SUFFIXES, tokens
from .functions.snippet import highlight, snippets
from .operators import dense, ltr_data, ltr_model, metrics
from .operators.expand import encode, expand
from .operators.score import NARROW_ROWS, hydrate, scores, scores_of, search, small, top_k
from .plans import boolean
from .plans.index import Index
from .plans.store import kept, shared_folder, state
from .sources.corpus import PAGE_FIELDS, documents_corpus, pages_corpus
from .sources.trec import positives
from .sources.vectors import VectorStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: No cut of common terms but in the queries that are about it; the number of documents and mean lengths come from the index.
UNCUT = 1 << 62
CUT = 100
DOCS = SearchConfig(postings_cut=UNCUT, fields={"body": FieldConfig(1.0)})
PAGES = SearchConfig(postings_cut=UNCUT)
TEXT_QUERIES = {1: "apache license version", 2: "stupid moron", 3: "worthless trash trash", 4: "the general public license", 5: "token example com", 6: "and the of", 7: "loser clown disgusting pathetic"}
#: Candidates as deep as the engine reranks; short lists and a small model, to train in seconds.
LTR = LtrConfig(topn=200, list_size=10, hidden=(16, 8), epochs=5)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# --- SQL building blocks -----------------------------------------------------------------------


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_tokens(text: str, stem: bool = False) -> str:
    found = f"regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+(?:''[a-z0-9]+)?')"
    if stem:
        case = " ".join(f"WHEN length(t) > 3 AND ends_with(t, '{s}') THEN left(t, length(t) - {len(s)})" for s in SUFFIXES)
        found = f"list_transform({found}, lambda t: CASE {case} ELSE t END)"
    return f"list_filter({found}, lambda t: length(t) >= 2 AND NOT list_contains({_list(STOPWORDS)}, t))"


def _values(queries: dict[int, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({q}::BIGINT, '{t}')" for q, t in queries.items()) + ") v(qid, query)"


SQL_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
SQL_BODY = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
DOC_TERMS = f"dt AS (SELECT 'body' AS field, doc_id, {sql_tokens('text')} AS tokens FROM documents)"
PAGE_TERMS = f"pg AS (SELECT page_id AS doc_id, url, {SQL_TITLE} AS title, {SQL_BODY} AS body FROM pages), dt AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id, {sql_tokens(f)} AS tokens FROM pg" for f in PAGE_FIELDS) + ")"
POSTINGS = """post AS (SELECT field, term, doc_id, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT field, doc_id, len(tokens) AS n, unnest(tokens) AS term FROM dt) GROUP BY ALL),
ts AS (SELECT field, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY ALL),
fs AS (SELECT field, count(*) AS n_docs, sum(len(tokens))::DOUBLE / count(*) AS avg_len FROM dt GROUP BY field)"""


def sql_scores(queries: str, cfg: SearchConfig, ranker: str = "bm25", terms: str = DOC_TERMS) -> str:
    """CTEs that end in sc(qid, doc_id, score)."""
    field = lambda what: "CASE field " + " ".join(f"WHEN '{n}' THEN {float(getattr(f, what))}::DOUBLE" for n, f in cfg.fields.items()) + f" ELSE {float(getattr(FieldConfig(), what))}::DOUBLE END"
    n = "n_docs::DOUBLE"
    if ranker == "bm25":
        w = f"(tf * ({field('weight')}))"
        s = f"ln(({n} - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * ({w} * {cfg.k1 + 1.0}::DOUBLE) / ({w} + {cfg.k1}::DOUBLE * ({1.0 - cfg.b}::DOUBLE + {cfg.b}::DOUBLE * doc_len / avg_len))"
        cut = f"WHERE df <= {cfg.postings_cut}"
    else:
        s, cut = f"ln(1.0::DOUBLE + tf) * ln({n} / (df + 1)) * ({field('weight')})", ""
    return f"""WITH {terms}, {POSTINGS},
q AS ({queries}), qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({sql_tokens('query')}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT qid, doc_id, round(sum(round(qtf * ({s}), 6)), 6) AS score FROM qt JOIN ts USING (term) JOIN fs USING (field) JOIN post USING (field, term) {cut} GROUP BY ALL)"""


def sql_ranked(k: int, name: str = "rk", source: str = "sc") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k})"


TITLES = f"SELECT page_id AS qid, {SQL_TITLE} AS query FROM pages"
PASSAGES = "SELECT item_id AS qid, text AS query FROM benchmark"


# --- Inputs -------------------------------------------------------------------------------------


def text_queries(spark: SparkSession, which: dict[int, str] = TEXT_QUERIES) -> DataFrame:
    return spark.createDataFrame(list(which.items()), "qid long, query string")


def doc_index(spark: SparkSession, sf: str) -> Index:
    """The saved index of documents, with positions."""
    return kept(spark, f"{sf}/documents.parquet", "documents", lambda: Index.build(documents_corpus(spark, sf), ("body",), positions=True))


def page_index(spark: SparkSession, sf: str) -> Index:
    return kept(spark, f"{sf}/pages.parquet", "pages", lambda: Index.build(pages_corpus(spark, sf), PAGE_FIELDS))


def all_index(spark: SparkSession, sf: str) -> Index:
    return kept(spark, f"{sf}/pages.parquet", "pages-all", lambda: Index.build(pages_corpus(spark, sf), ("all",)))


def tuned(index: Index, cfg: SearchConfig) -> tuple[Index, SearchConfig]:
    return index, index.tuned(cfg)


def title_queries(spark: SparkSession, sf: str) -> DataFrame:
    return pages_corpus(spark, sf).select(F.col("doc_id").alias("qid"), F.col("title").alias("query"))


def title_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return pages_corpus(spark, sf).select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("docid"), F.lit(1).alias("rel"))


def title_candidates(spark: SparkSession, sf: str, topn: int = LTR.topn) -> DataFrame:
    return ltr_data.candidates(title_queries(spark, sf), *tuned(page_index(spark, sf), PAGES), topn)


# --- Analysis and index -------------------------------------------------------------------------


@query("tokenize_documents", f"SELECT doc_id, array_to_string(x, ' ') AS tokens, CAST(len(x) AS INTEGER) AS n FROM (SELECT doc_id, {sql_tokens('text')} AS x FROM documents)")
def _(spark, sf):
    t = documents_corpus(spark, sf).select("doc_id", tokens(F.col("body")).alias("x"))
    return t.select("doc_id", F.array_join("x", " ").alias("tokens"), F.size("x").alias("n"))


@query("stem_documents", f"SELECT doc_id, array_to_string(x, ' ') AS tokens FROM (SELECT doc_id, {sql_tokens('text', True)} AS x FROM documents)")
def _(spark, sf):
    return documents_corpus(spark, sf).select("doc_id", F.array_join(tokens(F.col("body"), AnalyzerConfig(stem=True)), " ").alias("tokens"))


@query("doc_lengths", f"WITH {PAGE_TERMS} SELECT field, doc_id, CAST(len(tokens) AS INTEGER) AS doc_len FROM dt")
def _(spark, sf):
    return page_index(spark, sf).doc_stats


@query("term_frequencies", f"WITH {DOC_TERMS}, {POSTINGS} SELECT field, term, doc_id, CAST(tf AS INTEGER) AS tf, CAST(doc_len AS INTEGER) AS doc_len FROM post")
def _(spark, sf):
    return doc_index(spark, sf).postings.select("field", "term", "doc_id", "tf", "doc_len")


@query("document_frequencies", f"WITH {DOC_TERMS}, {POSTINGS} SELECT * FROM ts")
def _(spark, sf):
    return doc_index(spark, sf).term_stats


@query("posting_cut_terms", f"WITH {DOC_TERMS}, {POSTINGS} SELECT term, df FROM ts WHERE df > {CUT}")
def _(spark, sf):
    return doc_index(spark, sf).term_stats.where(F.col("df") > CUT).select("term", "df")


@query(
    "phrase_positions",
    f"WITH {DOC_TERMS} SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM "
    "(SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM dt) GROUP BY term, doc_id",
)
def _(spark, sf):
    return doc_index(spark, sf).postings.select("term", "doc_id", "tf", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


# --- Ranking ------------------------------------------------------------------------------------


@query("bm25_topk", f"{sql_scores(_values(TEXT_QUERIES), DOCS)}, {sql_ranked(10)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk")
def _(spark, sf):
    return search(text_queries(spark), *tuned(doc_index(spark, sf), DOCS))


@query("bm25_postings_cut", f"{sql_scores(_values(TEXT_QUERIES), replace(DOCS, postings_cut=CUT))}, {sql_ranked(10)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk")
def _(spark, sf):
    """Terms in more than a hundred documents are left out."""
    return search(text_queries(spark), *tuned(doc_index(spark, sf), replace(DOCS, postings_cut=CUT)))


@query("bm25_passages", f"{sql_scores(PASSAGES, DOCS)}, {sql_ranked(10)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk")
def _(spark, sf):
    passages = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return search(passages, *tuned(doc_index(spark, sf), DOCS))


@query("bm25_fielded_batch", f"{sql_scores(TITLES, PAGES, terms=PAGE_TERMS)}, {sql_ranked(10)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk")
def _(spark, sf):
    return search(title_queries(spark, sf), *tuned(page_index(spark, sf), PAGES))


ALL_FIELD = f"dt AS (SELECT 'all' AS field, page_id AS doc_id, {sql_tokens(f'concat_ws({chr(39)} {chr(39)}, {SQL_TITLE}, {SQL_BODY})')} AS tokens FROM pages)"


@query("bm25_all_field", f"{sql_scores(TITLES, PAGES, terms=ALL_FIELD)}, {sql_ranked(10)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk")
def _(spark, sf):
    return search(title_queries(spark, sf), *tuned(all_index(spark, sf), PAGES))


TWICE = {1: "trash", 2: "trash trash", 3: "trash trash trash"}


@query("bm25_duplicate_terms", f"{sql_scores(_values(TWICE), DOCS)} SELECT qid, doc_id, score FROM sc")
def _(spark, sf):
    return scores(text_queries(spark, TWICE), *tuned(doc_index(spark, sf), DOCS))


@query("tfidf_topk", f"{sql_scores(_values(TEXT_QUERIES), DOCS, 'tfidf')}, {sql_ranked(10)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk")
def _(spark, sf):
    return search(text_queries(spark), *tuned(doc_index(spark, sf), DOCS), ranker="tfidf")


@query("hydrated_topk", f"{sql_scores(TITLES, PAGES, terms=PAGE_TERMS)}, {sql_ranked(3)} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score, url, title FROM rk JOIN pg USING (doc_id)")
def _(spark, sf):
    ranked = search(title_queries(spark, sf), *tuned(page_index(spark, sf), PAGES), 3)
    return hydrate(ranked, pages_corpus(spark, sf), ("url", "title")).select("qid", "rank", "doc_id", "score", "url", "title")


# --- Boolean and phrase queries -----------------------------------------------------------------

FULL = SearchConfig(postings_cut=UNCUT, fields=DOCS.fields, leaf_topn=None)
LEAVES = {1: "license", 2: "public", 3: "trash", 4: "idiot", 5: "moron"}
_L = lambda i: f"(SELECT doc_id, score FROM sc WHERE qid = {i})"
_BOOL = sql_scores(_values(LEAVES), FULL)
_BOOL6 = sql_scores(_values(LEAVES | {6: "version"}), FULL)
_BOOL10 = f"{sql_scores(_values(LEAVES), FULL)}, {sql_ranked(10)}, s10 AS (SELECT qid, doc_id, score FROM rk)"


def _boolean(text: str, cfg: SearchConfig = FULL) -> Query:
    return lambda spark, sf: boolean.execute(spark, text, *tuned(doc_index(spark, sf), cfg))


query("bool_and", f"{_BOOL} SELECT doc_id, round(a.score + b.score, 6) AS score FROM {_L(1)} a JOIN {_L(2)} b USING (doc_id)")(_boolean("license and public"))
query("bool_or", f"{_BOOL} SELECT doc_id, round(sum(score), 6) AS score FROM sc WHERE qid IN (3, 4, 5) GROUP BY doc_id")(_boolean("trash or idiot or moron"))
query("bool_andnot", f"{_BOOL} SELECT doc_id, score FROM {_L(1)} a WHERE doc_id NOT IN (SELECT doc_id FROM {_L(2)} b)")(_boolean("license andnot public"))
query(
    "bool_implicit_or",
    f"{_BOOL}, o AS (SELECT doc_id, round(sum(score), 6) AS score FROM sc WHERE qid IN (3, 4) GROUP BY doc_id) SELECT doc_id, round(o.score + b.score, 6) AS score FROM o JOIN {_L(5)} b USING (doc_id)",
)(_boolean("trash or idiot moron"))
query(
    "bool_implicit_andnot",
    f"{_BOOL6}, x AS (SELECT doc_id, score FROM {_L(1)} a WHERE doc_id NOT IN (SELECT doc_id FROM {_L(2)} b)) SELECT doc_id, round(x.score + c.score, 6) AS score FROM x JOIN {_L(6)} c USING (doc_id)",
)(_boolean("license andnot public version"))
query("bool_implicit_and", f"{_BOOL} SELECT doc_id, round(a.score + b.score, 6) AS score FROM {_L(3)} a JOIN {_L(4)} b USING (doc_id)")(_boolean("trash the idiot"))
query(
    "bool_nested",
    f"{_BOOL}, o AS (SELECT doc_id, round(sum(score), 6) AS score FROM sc WHERE qid IN (3, 4) GROUP BY doc_id), x AS (SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM {_L(5)} b)) "
    f"SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM x UNION ALL SELECT doc_id, round(a.score + b.score, 6) FROM {_L(1)} a JOIN {_L(2)} b USING (doc_id)) GROUP BY doc_id",
)(_boolean("((trash or idiot) andnot moron) or (license and public)"))
query(
    "bool_leaf_top10",
    f"{_BOOL10} SELECT doc_id, round(sum(score), 6) AS score FROM s10 WHERE qid IN (1, 3) GROUP BY doc_id",
)(_boolean("license or trash", SearchConfig(postings_cut=UNCUT, fields=DOCS.fields, leaf_topn=10)))

PHRASES = {1: "general public license", 2: "licensed under apache license version", 3: "license public"}


@query(
    "phrase_match",
    f"WITH {DOC_TERMS}, ph AS (SELECT qid, array_to_string({sql_tokens('query')}, ' ') AS p FROM ({_values(PHRASES)})) "
    "SELECT qid, doc_id FROM ph, dt WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' ' || p || ' ')",
)
def _(spark, sf):
    return boolean.phrase_matches(text_queries(spark, PHRASES), doc_index(spark, sf), DOCS)


@query("phrase_search", f"WITH {DOC_TERMS} SELECT doc_id FROM dt WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' general public license ') AND NOT list_contains(tokens, 'trash')")
def _(spark, sf):
    return boolean.execute(spark, "'general public license' andnot trash", *tuned(doc_index(spark, sf), FULL)).select("doc_id")


# --- Dense --------------------------------------------------------------------------------------

_DOT = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6)"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


@query("dense_topk", f"SELECT b.vec_id AS doc_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY score DESC, doc_id LIMIT 10")
def _(spark, sf):
    v = _vectors(spark, sf)
    return dense.dense_one(v, v.where("doc_id = 0").first()["vec"], 10)


@query(
    "dense_batch_topk",
    f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), {sql_ranked(10, source='s')} SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk",
)
def _(spark, sf):
    v = _vectors(spark, sf)
    return dense.dense_top_k(v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), 10)


@query("embedding_store", f"SELECT vec_id AS doc_id, CAST(len(embedding) AS INTEGER) AS dim, (SELECT count(*) FROM embeddings) AS num_docs, {_DOT.replace('a.embedding', 'embedding').replace('b.embedding', 'embedding')} AS norm FROM embeddings WHERE vec_id IN (0, 7, 333)")
def _(spark, sf):
    """A saved store of vectors: its size and width, and vectors looked up by id."""
    path = f"{shared_folder(spark)}/fathom-vectors/{state(spark, f'{sf}/embeddings.parquet')}"
    store = VectorStore(spark, path)
    if not store.exists():
        store.write(_vectors(spark, sf))
    found = store.get([0, 7, 333, -5])
    return found.select("doc_id", F.size("vec").alias("dim"), F.lit(store.num_docs).alias("num_docs"), F.round(dense.cosine(F.col("vec"), F.col("vec")), 6).alias("norm"))


@query(
    "embedding_post_process",
    """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
b AS (SELECT vec_id, v, list_avg(v) AS m FROM a), c AS (SELECT vec_id, list_transform(v, lambda x: x - m) AS v FROM b),
d AS (SELECT vec_id, v, sqrt(list_avg(list_transform(v, lambda x: x * x)) + 1e-5) AS s FROM c), e AS (SELECT vec_id, list_transform(v, lambda x: x / s)[1:32] AS v FROM d),
f AS (SELECT vec_id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-12) AS n FROM e)
SELECT vec_id AS doc_id, CAST(len(v) AS INTEGER) AS dim, round(v[1] / n, 4) + 0.0 AS first_value, round(v[32] / n, 4) + 0.0 AS last_value FROM f""",
)
def _(spark, sf):
    v = _vectors(spark, sf).select("doc_id", dense.post_process_column(F.col("vec"), 32).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), (F.round(F.element_at("v", 1).cast("double"), 4) + 0.0).alias("first_value"), (F.round(F.element_at("v", -1).cast("double"), 4) + 0.0).alias("last_value"))


@query("embed_documents", "SELECT page_id AS doc_id, 64 AS dim, 1.0::DOUBLE AS norm FROM pages")
def _(spark, sf):
    p = pages_corpus(spark, sf).select("doc_id", dense.document_text(F.col("title"), F.col("body")).alias("text"))
    return dense.embed(p, dense.HashingEncoder()).select("doc_id", F.size("vec").alias("dim"), F.round(dense.cosine(F.col("vec"), F.col("vec")), 4).alias("norm"))


@query(
    "embedding_text",
    f"SELECT page_id AS doc_id, CASE WHEN trim(x) = '' THEN 'empty' ELSE x END AS text FROM (SELECT page_id, CASE WHEN 2048 - length(title) - 1 > 0 AND body <> '' THEN title || ' ' || substring(body, 1, 2048 - length(title) - 1) ELSE title END AS x "
    f"FROM (SELECT page_id, {SQL_TITLE} AS title, {SQL_BODY} AS body FROM pages))",
)
def _(spark, sf):
    return pages_corpus(spark, sf).select("doc_id", dense.document_text(F.col("title"), F.col("body")).alias("text"))


# --- Relevance, candidates, metrics -------------------------------------------------------------

_PAGE_RANKED = f"{sql_scores(TITLES, PAGES, terms=PAGE_TERMS)}, {sql_ranked(LTR.topn)}"
_PER_QUERY = """pq AS (SELECT qid, coalesce(1.0::DOUBLE / min(CASE WHEN qid = doc_id AND rank <= 10 THEN rank END), 0) AS mrr,
  coalesce(sum(CASE WHEN qid = doc_id AND rank <= 10 THEN ln(2.0::DOUBLE) / ln(rank + 1.0::DOUBLE) END), 0) AS ndcg FROM rk GROUP BY qid)"""


@query("qrels_grouped", "SELECT qid, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) GROUP BY qid")
def _(spark, sf):
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    qrels = metrics.containing(d, b).select("qid", F.col("doc_id").alias("docid"), F.lit(1).alias("rel"))
    return positives(qrels).select("qid", F.size("docids").cast("long").alias("n"), F.array_min("docids").alias("first_doc"), F.array_max("docids").alias("last_doc"))


@query("candidates", f"{_PAGE_RANKED} SELECT qid, doc_id AS docid, score AS bm25, CAST(rank AS INTEGER) AS rank FROM rk")
def _(spark, sf):
    return title_candidates(spark, sf)


@query("candidate_recall", f"{_PAGE_RANKED} SELECT count(*) AS query_count, round(avg(CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_n, round(avg(h::DOUBLE), 6) AS avg_pos_in_candidates FROM (SELECT qid, count(*) FILTER (qid = doc_id) AS h FROM rk GROUP BY qid)")
def _(spark, sf):
    return metrics.candidate_recall(title_candidates(spark, sf).withColumnRenamed("docid", "doc_id"), title_qrels(spark, sf))


def _title_lists(spark: SparkSession, sf: str, qrels: DataFrame, then: Callable[[DataFrame], DataFrame], topn: int = LTR.topn) -> DataFrame:
    """What then makes of each title query's candidates and relevant documents: qid, rel, docs, scores."""
    return search(title_queries(spark, sf), *tuned(page_index(spark, sf), PAGES), topn, along=metrics.relevant(qrels), then=then)


def _page_ranking(spark: SparkSession, sf: str, topn: int = LTR.topn) -> DataFrame:
    return title_candidates(spark, sf, topn).select("qid", F.col("docid").alias("doc_id"), "rank")


@query("mrr_at_10", f"{_PAGE_RANKED}, {_PER_QUERY} SELECT qid, round(mrr, 6) AS mrr FROM pq")
def _(spark, sf):
    return metrics.per_list(_title_lists(spark, sf, title_qrels(spark, sf), metrics.ranks_of)).select("qid", F.round("mrr", 6).alias("mrr"))


@query("ndcg_at_10", f"{_PAGE_RANKED}, {_PER_QUERY} SELECT qid, round(ndcg, 6) AS ndcg FROM pq")
def _(spark, sf):
    return metrics.per_list(_title_lists(spark, sf, title_qrels(spark, sf), metrics.ranks_of)).select("qid", F.round("ndcg", 6).alias("ndcg"))


@query("eval_report", f"{_PAGE_RANKED}, {_PER_QUERY} SELECT count(*) AS queries_evaluated, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM pq")
def _(spark, sf):
    return metrics.evaluate(_page_ranking(spark, sf), title_qrels(spark, sf))


# judgements with all that a funnel loses: texts of every seventh query missing, of every fifth relevant rows, every third points to no document; rows of relevance 0 throughout
_LOSSY = "qx AS (SELECT page_id AS qid FROM pages), tx AS (SELECT qid FROM qx WHERE qid % 7 <> 0), rx AS (SELECT qid, CASE WHEN qid % 3 = 0 THEN -1 - qid ELSE qid END AS doc_id FROM qx WHERE qid % 5 <> 0)"


def _lossy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = title_queries(spark, sf)
    rel = q.where("qid % 5 != 0").select("qid", F.when(F.col("qid") % 3 == 0, -1 - F.col("qid")).otherwise(F.col("qid")).alias("docid"), F.lit(1).alias("rel"))
    return q, q.where("qid % 7 != 0"), rel.unionByName(q.select("qid", (F.col("qid") + 1).alias("docid"), F.lit(0).alias("rel")))


@query(
    "funnel",
    f"{_PAGE_RANKED}, {_LOSSY}, st AS (SELECT qid, qid IN (SELECT qid FROM tx) AS a, qid IN (SELECT qid FROM rx) AS b, qid IN (SELECT qid FROM rx WHERE doc_id IN (SELECT doc_id FROM pg)) AS c, qid IN (SELECT rk.qid FROM rk JOIN rx USING (qid, doc_id)) AS d FROM qx), "
    "n AS (SELECT count(*) AS t, count(*) FILTER (a) AS x1, count(*) FILTER (a AND b) AS x2, count(*) FILTER (a AND b AND c) AS x3, count(*) FILTER (a AND b AND c AND d) AS x4 FROM st) "
    "SELECT stage, n, round(n::DOUBLE / t, 6) AS retention, round(CASE WHEN p > 0 THEN n::DOUBLE / p ELSE 0 END, 6) AS step FROM (SELECT 'total' AS stage, t AS n, t, t AS p FROM n UNION ALL SELECT 'has_text', x1, t, t FROM n "
    "UNION ALL SELECT 'has_positives', x2, t, x1 FROM n UNION ALL SELECT 'positive_in_index', x3, t, x2 FROM n UNION ALL SELECT 'positive_in_top', x4, t, x3 FROM n)",
)
def _(spark, sf):
    q, texts, r = _lossy(spark, sf)
    return metrics.funnel(q, texts, r, pages_corpus(spark, sf), _title_lists(spark, sf, r, metrics.ranks_of), LTR.topn)


@query(
    "graded_metrics",
    f"{_PAGE_RANKED}, {_LOSSY}, pq AS (SELECT qid, coalesce(1.0::DOUBLE / min(CASE WHEN h AND rank <= 10 THEN rank END), 0) AS mrr, coalesce(sum(CASE WHEN h AND rank <= 10 THEN ln(2.0::DOUBLE) / ln(rank + 1.0::DOUBLE) END), 0) AS ndcg "
    "FROM (SELECT rk.qid, rank, rx.doc_id IS NOT NULL AS h FROM rk LEFT JOIN rx ON rk.qid = rx.qid AND rk.doc_id = rx.doc_id WHERE rk.qid IN (SELECT qid FROM rx)) GROUP BY qid) SELECT qid, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM pq",
)
def _(spark, sf):
    """Judgements with rows of relevance 0, queries without a relevant document, and documents that aren't in the index."""
    return metrics.per_list(_title_lists(spark, sf, _lossy(spark, sf)[2], metrics.ranks_of)).select("qid", F.round("mrr", 6).alias("mrr"), F.round("ndcg", 6).alias("ndcg"))


@query(
    "sampling_status",
    f"{_PAGE_RANKED}, {_LOSSY} SELECT qid, CASE WHEN qid NOT IN (SELECT qid FROM rx) THEN 'no_relevant' WHEN qid NOT IN (SELECT qid FROM rk) THEN 'no_candidates' WHEN qid NOT IN (SELECT rk.qid FROM rk JOIN rx USING (qid, doc_id)) THEN 'no_relevant_candidate' "
    "WHEN qid NOT IN (SELECT rk.qid FROM rk LEFT JOIN rx ON rk.qid = rx.qid AND rk.doc_id = rx.doc_id WHERE rx.qid IS NULL) THEN 'no_negative' ELSE 'ok' END AS status FROM qx",
)
def _(spark, sf):
    q, _, r = _lossy(spark, sf)
    return ltr_data.status_of(q, _title_lists(spark, sf, r, lambda x: ltr_data.pool_sizes(ltr_data.pools_of(x, LTR))), r, LTR)


@query("recall_curve", f"{sql_scores(TITLES, PAGES, terms=PAGE_TERMS)}, {sql_ranked(max(metrics.RECALL_AT))}, f AS (SELECT qid, min(CASE WHEN qid = doc_id THEN rank END) AS first FROM rk GROUP BY qid) SELECT CAST(n AS INTEGER) AS n, round(avg(CASE WHEN first <= n THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM f, (SELECT unnest([10, 50, 100, 200, 500, 1000]) AS n) GROUP BY n")
def _(spark, sf):
    return metrics.recall_of(_title_lists(spark, sf, title_qrels(spark, sf), metrics.ranks_of, max(metrics.RECALL_AT)))


@query("dense_recall", f"WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS doc_id, a.label = b.label AS hit, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), {sql_ranked(10, source='s')} SELECT qid, count(*) FILTER (hit) AS hits FROM rk GROUP BY qid")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    v = _vectors(spark, sf)
    near = dense.dense_top_k(v, v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), 11).where("qid != doc_id")
    near = top_k(near.drop("rank"), 10)
    named = near.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("a")), "doc_id").join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("b")), "qid")
    return named.groupBy("qid").agg(F.count_if(F.col("a") == F.col("b")).alias("hits"))


# --- Learning to rank ---------------------------------------------------------------------------

_IDF = f"CASE WHEN df > 0 AND df <= {PAGES.postings_cut} THEN ln(((SELECT max(n_docs) FROM fs)::DOUBLE - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) ELSE 0 END"
_FEATURES_SQL = f"""{_PAGE_RANKED}, qq AS (SELECT qid, {sql_tokens('query')} AS q FROM q), u AS (SELECT qid, q, list_distinct(q) AS u FROM qq),
bt AS (SELECT doc_id, tokens AS b FROM dt WHERE field = 'body'), tt AS (SELECT doc_id, tokens AS t FROM dt WHERE field = 'title'),
j AS (SELECT rk.qid, rk.doc_id, score, q, u, t, b FROM rk JOIN u USING (qid) JOIN bt USING (doc_id) JOIN tt USING (doc_id)),
w AS (SELECT j.qid, j.doc_id, x.term, list_contains(b, x.term) AS in_b, list_contains(t, x.term) AS in_t, coalesce({_IDF}, 0) AS idf FROM j, unnest(u) AS x(term) LEFT JOIN (SELECT term, df FROM ts WHERE field = 'body') s ON s.term = x.term),
s AS (SELECT qid, doc_id, round(coalesce(sum(idf) FILTER (in_b), 0), 6) AS sb, round(coalesce(sum(idf) FILTER (in_t), 0), 6) AS st FROM w GROUP BY ALL)
SELECT qid, doc_id AS docid, score AS bm25_score, len(q)::DOUBLE AS query_len, len(u)::DOUBLE AS query_uniq_len, len(t)::DOUBLE AS title_len, len(b)::DOUBLE AS body_len, len(list_intersect(u, t))::DOUBLE AS title_overlap_cnt,
len(list_intersect(u, b))::DOUBLE AS body_overlap_cnt, round(len(list_intersect(u, b))::DOUBLE / greatest(1, len(u)), 6) AS body_overlap_ratio, sb AS idf_body_overlap_sum, st AS idf_title_overlap_sum FROM j JOIN s USING (qid, doc_id)"""


def _title_features(spark: SparkSession, sf: str, cands: DataFrame) -> DataFrame:
    return ltr_data.features(cands, title_queries(spark, sf), pages_corpus(spark, sf), *tuned(page_index(spark, sf), PAGES))


@query("ltr_features", _FEATURES_SQL)
def _(spark, sf):
    return _title_features(spark, sf, title_candidates(spark, sf).drop("rank"))


@query("positives_semi", f"{_PAGE_RANKED} SELECT qid, doc_id AS docid FROM rk WHERE qid = doc_id")
def _(spark, sf):
    return title_candidates(spark, sf).join(small(title_qrels(spark, sf), NARROW_ROWS), ["qid", "docid"], "left_semi").select("qid", "docid")


@query("negatives_anti", f"{_PAGE_RANKED} SELECT qid, doc_id AS docid FROM rk WHERE qid <> doc_id")
def _(spark, sf):
    return title_candidates(spark, sf).join(small(title_qrels(spark, sf), NARROW_ROWS), ["qid", "docid"], "left_anti").select("qid", "docid")


@query("hard_negative_pool", f"{_PAGE_RANKED} SELECT qid, doc_id AS docid, CAST(p AS INTEGER) AS pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS p FROM rk WHERE qid <> doc_id) WHERE p <= 20")
def _(spark, sf):
    return ltr_data.hard_pool(title_candidates(spark, sf), title_qrels(spark, sf), 20).select("qid", "docid", "pool_rank")


def _draw(*what: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{LTR.seed}', {', '.join(what)})), 1, 8)) AS BIGINT)"


@query(
    "query_split",
    f"SELECT qid, CASE WHEN p <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train' WHEN p <= CAST(floor(n * 0.8) AS BIGINT) + CAST(floor(n * 0.1) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM "
    f"(SELECT page_id AS qid, row_number() OVER (ORDER BY md5(concat_ws(':', '42', page_id)), page_id) AS p, count(*) OVER () AS n FROM pages)",
)
def _(spark, sf):
    return ltr_data.split_queries(title_queries(spark, sf).select("qid"))


_POOL = f"{_PAGE_RANKED}, pool AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS p FROM rk WHERE qid <> doc_id) WHERE p <= {LTR.hard_pool}), pos AS (SELECT qid, doc_id, score FROM rk WHERE qid = doc_id)"


@query(
    "pair_samples",
    f"{_POOL}, d AS (SELECT qid, doc_id, score, k, {_draw('qid', 'doc_id', 'k')} AS d FROM pos, (SELECT unnest([1, 2]) AS k)) "
    "SELECT d.qid, d.doc_id AS pos_docid, pool.doc_id AS neg_docid, d.score AS pos_bm25, pool.score AS neg_bm25 FROM d JOIN pool ON d.qid = pool.qid AND pool.p = d.d % pool.n + 1",
)
def _(spark, sf):
    return _title_lists(spark, sf, title_qrels(spark, sf), lambda x: ltr_data.pairs_of(ltr_data.pools_of(x, LTR), 2, LTR))


_L1 = LTR.list_size - 1
_LISTS = f"""{_POOL}, one AS (SELECT qid, doc_id, score, 0 AS k, 1 AS y FROM pos WHERE qid IN (SELECT qid FROM pool)),
few AS (SELECT pool.qid, doc_id, score, CAST(row_number() OVER (PARTITION BY pool.qid ORDER BY {_draw('pool.qid', 'doc_id', "'neg'")}, doc_id) AS INTEGER) AS k, 0 AS y, n FROM pool WHERE qid IN (SELECT qid FROM pos)),
anew AS (SELECT x.qid, pool.doc_id, pool.score, k, 0 AS y FROM (SELECT qid, n, k, {_draw('qid', 'k', "'again'")} % n + 1 AS p FROM (SELECT DISTINCT qid, n FROM few WHERE n < {_L1}), (SELECT unnest(range(1, {_L1 + 1})) AS k)) x JOIN pool ON x.qid = pool.qid AND x.p = pool.p),
li AS (SELECT * FROM one UNION ALL SELECT qid, doc_id, score, k, y FROM few WHERE n >= {_L1} AND k <= {_L1} UNION ALL SELECT * FROM anew)
SELECT qid, doc_id AS docid, score AS bm25, y::FLOAT AS label, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_draw('qid', 'k', "'slot'")}, k) - 1 AS INTEGER) AS slot FROM li"""


@query("listwise_samples", _LISTS)
def _(spark, sf):
    return ltr_data.listwise_samples(title_candidates(spark, sf), title_qrels(spark, sf), LTR)


@query("feature_statistics", f"WITH f AS ({_FEATURES_SQL}) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({n}), 6) AS mean, round(var_pop({n}), 6) AS variance FROM f" for n in FEATURES))
def _(spark, sf):
    return ltr_model.feature_statistics(_title_features(spark, sf, title_candidates(spark, sf).drop("rank")), FEATURES)


@query("rerank_ltr")
def _(spark, sf):
    cands = title_candidates(spark, sf)
    sample = ltr_data.listwise_samples(cands, title_qrels(spark, sf), LTR)
    lists = ltr_data.feature_lists(_title_features(spark, sf, sample))
    model = ltr_model.train(ltr_data.lists_of(ltr_data.training_lists(lists, LTR)), LTR)
    return ltr_model.rerank(_title_features(spark, sf, cands), model, FEATURES, LTR.topn).withColumn("score", F.round("score", 4))


_LINEAR = {"title_overlap_cnt": 1.0, "idf_body_overlap_sum": 0.5}


@query(
    "rerank_evaluation",
    f"WITH f AS ({_FEATURES_SQL}), r AS (SELECT qid, docid AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, docid) AS before, row_number() OVER (PARTITION BY qid ORDER BY title_overlap_cnt * 1.0::DOUBLE + idf_body_overlap_sum * 0.5::DOUBLE DESC, bm25_score DESC, docid) AS after FROM f), "
    "m AS (SELECT qid, max(CASE WHEN qid = doc_id AND before <= 10 THEN 1.0::DOUBLE / before ELSE 0 END) AS a, max(CASE WHEN qid = doc_id AND before <= 10 THEN ln(2.0::DOUBLE) / ln(before + 1.0::DOUBLE) ELSE 0 END) AS b, "
    "max(CASE WHEN qid = doc_id AND after <= 10 THEN 1.0::DOUBLE / after ELSE 0 END) AS c, max(CASE WHEN qid = doc_id AND after <= 10 THEN ln(2.0::DOUBLE) / ln(after + 1.0::DOUBLE) ELSE 0 END) AS d FROM r GROUP BY qid) "
    "SELECT 'bm25' AS ranking, count(*) AS queries_evaluated, round(avg(a), 6) AS mrr, round(avg(b), 6) AS ndcg FROM m UNION ALL SELECT 'reranked', count(*), round(avg(c), 6), round(avg(d), 6) FROM m",
)
def _(spark, sf):
    """First-stage and reranked lists side by side, with a model of known weights."""
    cands = title_candidates(spark, sf)
    weights = np.array([[_LINEAR.get(n, 0.0)] for n in FEATURES])
    model = ltr_model.Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), [(weights, np.zeros(1))])
    again = ltr_model.rerank(_title_features(spark, sf, cands), model, FEATURES, LTR.topn)
    return metrics.compare({"bm25": cands, "reranked": again}, title_qrels(spark, sf))


@query("hybrid_rerank_semantic")
def _(spark, sf):
    """Dense candidates, reordered by lexical score: the semantic mode with a reranker."""
    p = pages_corpus(spark, sf)
    vectors = dense.embed(p.select("doc_id", dense.document_text(F.col("title"), F.col("body")).alias("text")), dense.HashingEncoder())
    asked = title_queries(spark, sf)
    q = dense.embed(asked.select("qid", F.col("query").alias("text")), dense.HashingEncoder(), "query", key="qid")
    near = dense.dense_top_k(vectors, q, 50)
    both = scores_of(near.withColumnRenamed("score", "near"), asked, *tuned(page_index(spark, sf), PAGES)).withColumnsRenamed({"score": "bm25", "near": "score"}).select("qid", "doc_id", F.round(F.coalesce("bm25", F.lit(0.0)) + F.col("score"), 6).alias("score"))
    return top_k(both, 10).select("qid", "rank", "doc_id", "score")


# --- Snippets and expansion ---------------------------------------------------------------------


@query(
    "snippets",
    f"""{sql_scores(_values(TEXT_QUERIES), DOCS)}, {sql_ranked(10)}, t AS (SELECT qid, rank, doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda x: x <> '')) AS qw
  FROM rk JOIN documents USING (doc_id) JOIN q USING (qid)),
n AS (SELECT *, greatest(1, 250 // (2 * greatest(1, length(array_to_string(w, '')) // len(w)))) AS n FROM t),
x AS (SELECT qid, rank, doc_id, qw, a, w[a + 1 : a + n] AS s FROM (SELECT *, unnest(range(0, len(w), greatest(1, n - 10))) AS a FROM n)),
y AS (SELECT *, list_filter(list_transform(s, lambda v: lower(v)), lambda v: list_contains(qw, v)) AS f FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY len(list_distinct(f)) DESC, len(f)::DOUBLE / len(s) DESC, len(f) DESC, a) AS k FROM y)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, '...' || array_to_string(s, ' ') || '...' AS snippet FROM z WHERE k = 1""",
)
def _(spark, sf):
    asked = text_queries(spark)
    ranked = search(asked, *tuned(doc_index(spark, sf), DOCS)).join(asked, "qid")
    return snippets(hydrate(ranked, documents_corpus(spark, sf), ("body",)), text="body").select("qid", "rank", "doc_id", "snippet")


@query(
    "highlight",
    "SELECT doc_id, array_to_string(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: CASE WHEN w <> '' AND list_contains(['license', 'apache', 'trash'], regexp_replace(lower(w), "
    "'^[`´.,!?;\"''()]+|[`´.,!?;\"''()]+$', '', 'g')) THEN '**' || w || '**' ELSE w END), ' ') AS shown FROM documents",
)
def _(spark, sf):
    return documents_corpus(spark, sf).select("doc_id", highlight(F.col("body"), F.lit("license apache trash")).alias("shown"))


def _related(texts: list[str]) -> list[list[tuple[str, float]]]:
    """A stand-in encoder: each word and its plural."""
    return [[(x, w) for i, t in enumerate(s.split()) for x, w in ((t, 1.0), (t + "s", 0.5 - i / 100))] for s in texts]


@query(
    "expansion",
    f"""WITH q AS ({_values(TEXT_QUERIES)}), t AS (SELECT qid, query, unnest(string_split(query, ' ')) AS w, generate_subscripts(string_split(query, ' '), 1) AS i FROM q),
p AS (SELECT qid, w || 's' AS p, min(i) AS i FROM t WHERE NOT list_contains(string_split(query, ' '), w || 's') GROUP BY ALL), r AS (SELECT qid, p, row_number() OVER (PARTITION BY qid ORDER BY i) AS k FROM p)
SELECT qid, (SELECT string_agg(p, ' ' ORDER BY k) FROM r WHERE r.qid = q.qid AND k <= 2) || ' ' || query AS query FROM q""",
)
def _(spark, sf):
    return expand(encode(text_queries(spark), _related))


@query("throughput", f"WITH {PAGE_TERMS} SELECT field, count(*) AS docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens, round(avg(len(tokens)), 6) AS mean_len FROM dt GROUP BY field")
def _(spark, sf):
    s = page_index(spark, sf).doc_stats
    return s.groupBy("field").agg(F.count("*").alias("docs"), F.sum("doc_len").alias("n_tokens"), F.round(F.avg("doc_len"), 6).alias("mean_len"))
