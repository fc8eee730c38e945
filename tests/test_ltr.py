import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.config import FEATURES, FieldConfig, LtrConfig, SearchConfig
from fathom.operators import dense, ltr_data, ltr_model, metrics
from fathom.operators.expand import encode, expand, pool
from fathom.operators.score import listed
from fathom.plans.index import Index
from fathom.sources import trec

CFG = SearchConfig(num_docs=5, postings_cut=100, fields={"title": FieldConfig(2.0, 5), "body": FieldConfig(1.0, 15)})


def test_readers(spark, tmp_path):
    (tmp_path / "q").write_text("1\tapple pie\trecipe\n\nx\tbad\n2\n3\tlast\n")
    assert [(r.qid, r.query) for r in trec.read_queries(spark, str(tmp_path / "q")).orderBy("qid").collect()] == [(1, "apple pie\trecipe"), (3, "last")]
    (tmp_path / "q2").write_text("1\tfirst\n2\tother\n1\tsecond\n")
    assert {(r.qid, r.query) for r in trec.last_query(trec.read_queries(spark, str(tmp_path / "q2"))).collect()} == {(1, "second"), (2, "other")}
    (tmp_path / "r").write_text("1 0 D1 1\n1\t0  D2 0 x\n2 0 D3\nq 0 D4 1\n")
    qrels = trec.read_qrels(spark, str(tmp_path / "r"))
    assert {tuple(r) for r in qrels.collect()} == {(1, "D1", 1), (1, "D2", 0)}
    assert trec.positives(qrels).first().docids == ["D1"]
    (tmp_path / "i").write_text("3\n\n4\n")
    assert {r.qid for r in trec.read_qids(spark, str(tmp_path / "i")).collect()} == {3, 4}
    (tmp_path / "j").write_text("word\n")
    with pytest.raises(Exception, match="not a qid"):
        trec.read_qids(spark, str(tmp_path / "j")).collect()
    c = spark.createDataFrame([(2, "b", 1.0, 2), (2, "a", 2.0, 1), (1, "c", 3.0, 1)], "qid long, docid string, bm25 double, rank int")
    trec.write_candidates(c, str(tmp_path / "c"))
    assert sorted(trec.read_candidates(spark, str(tmp_path / "c")).collect()) == sorted(c.select("qid", "docid", "bm25", "rank").collect())


def test_split(spark):
    got = ltr_data.split_queries(spark.range(1, 101).withColumnRenamed("id", "qid"), 7).collect()
    by = {s: {r.qid for r in got if r.split == s} for s in ("train", "val", "test")}
    assert [len(by[s]) for s in ("train", "val", "test")] == [80, 10, 10] and set().union(*by.values()) == set(range(1, 101))
    exact = ltr_data.split_exact(list(range(1, 101)), 123)
    assert exact["train"][:5] == [88, 30, 64, 51, 85] and exact["val"][:3] == [87, 32, 90] and exact["test"][-1] == 7
    with pytest.raises(ValueError):
        ltr_data.split_exact([])


def test_samples(spark):
    c = spark.createDataFrame([(1, "p", 10.0, 1), (1, "n1", 9.0, 2), (1, "n2", 8.0, 3), (2, "n1", 1.0, 1)], "qid long, docid string, bm25 double, rank int")
    r = spark.createDataFrame([(1, "p", 1), (2, "gone", 1)], "qid long, docid string, rel int")
    pairs = ltr_data.pair_samples(c, r, 5).collect()
    assert len(pairs) == 5 and {x.pos_docid for x in pairs} == {"p"} and {x.neg_docid for x in pairs} <= {"n1", "n2"}
    lists = ltr_data.listwise_samples(c, r, LtrConfig(list_size=3)).collect()
    assert len(lists) == 3 and sum(x.label for x in lists) == 1 and {x.qid for x in lists} == {1} and sorted(x.slot for x in lists) == [0, 1, 2]
    assert {x.docid for x in lists} == {"p", "n1", "n2"}  # without replacement where the pool is large enough
    again = ltr_data.listwise_samples(c, r, LtrConfig(list_size=6)).collect()
    assert len(again) == 6 and {x.docid for x in again} <= {"p", "n1", "n2"} and sorted(ltr_data.listwise_samples(c.repartition(3), r, LtrConfig(list_size=6)).collect()) == sorted(again)
    assert ltr_data.listwise_samples(c, r, LtrConfig(list_size=1)).count() == 0
    q = spark.createDataFrame([(i, "q") for i in (1, 2, 3, 4, 5)], "qid long, query string")
    r2 = r.unionByName(spark.createDataFrame([(4, "x", 1), (5, "only", 1)], r.schema))
    c2 = c.unionByName(spark.createDataFrame([(5, "only", 1.0, 1)], c.schema))
    got = {x.qid: x.status for x in ltr_data.sampling_status(q, c2, r2, LtrConfig(list_size=3)).collect()}
    assert got == {1: "ok", 2: "no_relevant_candidate", 3: "no_relevant", 4: "no_candidates", 5: "no_negative"}
    assert {x.status for x in ltr_data.sampling_status(q, c2, r2, LtrConfig(list_size=1)).collect()} == {"list_size"}
    positive, missing = ltr_data.map_positives(r, spark.createDataFrame([("p",)], "doc_id string"))
    assert [tuple(x[c] for c in ("qid", "docid")) for x in positive.collect()] == [(1, "p")] and missing.first().unmapped == 1
    assert [x.qid for x in ltr_data.work_items(q, r, 1).collect()] == [1]


def test_online_lists(spark, harbour):
    q = spark.createDataFrame([(1, "tide"), (2, "gate"), (3, "nowhere")], "qid long, query string")
    r = spark.createDataFrame([(1, "h1", 1), (2, "h4", 1), (3, "h5", 1)], "qid long, docid string, rel int")
    index = Index.build(harbour, ("title", "body"))
    got = ltr_data.online_lists(q, r, index, CFG, LtrConfig(list_size=2, topn=5), 1).collect()
    assert {x.qid for x in got} == {1} and len(got) == 2
    assert {x.qid for x in ltr_data.online_lists(q, r, index, CFG, LtrConfig(list_size=2, topn=5)).collect()} == {1, 2}
    with pytest.raises(ValueError):
        ltr_data.online_lists(q, r, index, CFG, LtrConfig(list_size=1))


def test_features(spark, harbour):
    q = spark.createDataFrame([(1, "bay tide walk")], "qid long, query string")
    c = harbour.select(F.lit(1).cast("long").alias("qid"), F.col("doc_id").alias("docid"), F.lit(0.5).alias("bm25"))
    index = Index.build(harbour, ("title", "body"))
    got = {r.docid: tuple(r[n] for n in FEATURES) for r in ltr_data.features(c, q, harbour, index, CFG).collect()}
    assert got["h1"] == pytest.approx((0.5, 3, 3, 2, 13, 1, 1, 0.333333, 0.875469, 0.875469), abs=2e-6)
    assert got["h5"] == pytest.approx((0.5, 3, 3, 3, 7, 3, 3, 1.0, 3.137232, 3.137232), abs=2e-6)
    assert got["h2"] == (0.5, 3, 3, 2, 9, 0, 0, 0.0, 0.0, 0.0)
    index.doc_terms = None  # without kept terms the documents are analyzed
    assert {r.docid: tuple(r[n] for n in FEATURES) for r in ltr_data.features(c, q, harbour, index, CFG).collect()} == got


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, d, i) for i, d in enumerate("xayb", 1)], "qid long, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "z", 1)], "qid long, docid string, rel int")
    row = metrics.per_query(ranked, qrels).first()
    assert row.mrr == 0.5 and row.ndcg == pytest.approx(0.650921, abs=1e-6)
    assert metrics.evaluate(ranked.limit(0), qrels).first()[:] == (0, 0.0, 0.0)
    assert metrics.candidate_recall(ranked, qrels).first()[:] == (1, 1.0, 2.0)
    rows = metrics.compare({"a": ranked.withColumnRenamed("doc_id", "docid"), "b": ranked.limit(0).withColumnRenamed("doc_id", "docid")}, qrels).collect()
    assert [(r.ranking, r.queries_evaluated, r.mrr) for r in rows] == [("a", 1, 0.5), ("b", 0, 0.0)]
    f = metrics.funnel(qrels.select("qid"), qrels.select("qid"), qrels, ranked.select("doc_id"), ranked)
    assert len(metrics.funnel_warnings(f, 0.6)) == 1 and metrics.funnel_warnings(f, 0.4) == []


@pytest.fixture(scope="module")
def lists(spark):
    """(candidates, judgements, candidates as rows, the same as a row a query)"""
    rows = [(q, d, 9.0 - r / 2, r) for q, docs in {1: "xaybz", 2: "zm", 3: "a", 5: "cd"}.items() for r, d in enumerate(docs, 1)]
    c = spark.createDataFrame(rows, "qid long, docid string, bm25 double, rank int")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "b", 2), (1, "gone", 1), (2, "m", 0), (3, "a", 1), (4, "q", 1), (5, "gone", 1), (5, None, 1)], "qid long, docid string, rel int")
    ranked = c.select("qid", "rank", F.col("docid").alias("doc_id"), F.col("bm25").alias("score"))
    return c, qrels, ranked, listed(ranked, metrics.relevant(qrels)).persist()


def test_pairs_of_lists(lists):
    c, qrels, _, at = lists
    pairs = ltr_data.pairs_of(ltr_data.pools_of(at), 5)
    assert sorted(pairs.collect()) == sorted(ltr_data.pair_samples(c, qrels, 5).collect()) and pairs.count() == 10
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]  # nothing of a list is shuffled


def test_status_of_lists(spark, lists):
    c, qrels, _, at = lists
    sizes = ltr_data.pool_sizes(ltr_data.pools_of(at))
    q = spark.range(1, 7).withColumnRenamed("id", "qid")
    got = sorted(ltr_data.status_of(q, sizes, qrels).collect())
    assert got == sorted(ltr_data.sampling_status(q, c, qrels).collect()) and len({r.status for r in got}) == 5
    assert "Exchange" not in sizes._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_metrics_of_lists(lists):
    _, qrels, ranked, at = lists
    ranks = metrics.ranks_of(at)
    for k in (10, 2, 0):
        assert sorted(metrics.per_list(ranks, k).collect()) == sorted(metrics.per_query(ranked, qrels, k).collect())
    assert "Exchange" not in metrics.per_list(ranks)._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_funnel_of_lists(lists):
    _, qrels, ranked, at = lists
    for n in (200, 1):
        by = [metrics.funnel(qrels.select("qid"), ranked.select("qid"), qrels, ranked.select("doc_id"), x, n).collect() for x in (ranked, metrics.ranks_of(at))]
        assert by[0] == by[1]


def test_passages_in_documents(spark):
    docs = [(1, "x one two three four five six y"), (2, "ne two three four five si"), (3, "a  b"), (4, "one two three four five six"), (5, None)]
    passages = [(1, "one two three four five six"), (2, "a  b"), (3, "two three four"), (4, "absent words that nobody ever wrote")]
    d, p = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "qid long, passage string")
    want = {(q, i) for i, t in docs for q, s in passages if t and s in t}
    assert {(r.qid, r.doc_id) for r in metrics.containing(d, p).collect()} == want


def test_dense(spark):
    v = np.random.default_rng(42).normal(size=(5, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)], "doc_id long, vec array<float>")
    got = dense.dense_top_k(rows, rows.withColumnRenamed("doc_id", "qid"), 3).where("rank = 1").collect()
    assert all(r.qid == r.doc_id for r in got) and len(got) == 5
    assert [r.doc_id for r in dense.dense_one(rows, v[2].tolist(), 1).collect()] == [2]
    x = dense.post_process(np.random.default_rng(1).normal(size=(3, 128)), 64)
    assert x.shape == (3, 64) and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-6)


def test_embedding_a_corpus_in_portions(spark, harbour, tmp_path):
    from fathom.sources.vectors import VectorStore

    store = VectorStore(spark, str(tmp_path / "v"))
    assert dense.embed_corpus(harbour, dense.HashingEncoder(), store, 16, part=2) == 2
    first = {r.doc_id: list(r.vec) for r in store.load().collect()}
    assert dense.embed_corpus(harbour, dense.HashingEncoder(), store, 16) == 5 and store.dim == 16
    assert {r.doc_id: list(r.vec) for r in store.get(list(first)).collect()} == first and dense.resume(harbour, store.load()).count() == 0


def test_split_and_report_files(spark, tmp_path):
    split = ltr_data.split_queries(spark.range(1, 21).withColumnRenamed("id", "qid"), 3)
    trec.write_split(split, str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s" / "qids")).where("split = 'train'").count() == 16
    assert '"train": 16' in spark.read.text(str(tmp_path / "s" / "split_meta")).first()[0]
    trec.write_report(spark, {"b": 1, "a": 2}, str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a": 2, "b": 1}'


def test_render(spark):
    from fathom.functions.snippet import render

    row = spark.range(1).select(render(F.lit(1), F.lit("Title"), F.lit("http://x"), F.lit(1.5), F.lit("text")).alias("r")).first()
    assert row.r == "1. [Title](http://x) (score 1.50)\ntext"


def test_expansion(spark):
    q = spark.createDataFrame([(1, "red apple")], "qid long, query string")
    enc = lambda ts: [[("apple", 2.0), ("fruit", 1.0), ("tree", 0.5), ("x", 0.001)] for _ in ts]
    assert expand(encode(q, enc)).first().query == "fruit tree red apple"
    assert np.allclose(pool(np.array([[1.0, -1], [3, 5]]), np.array([1, 0])), [np.log(2), 0])


def test_model_learns_and_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6, 4))
    y = (x[..., 0] == x[..., 0].max(1, keepdims=True)).astype(float)
    cfg = LtrConfig(hidden=(16, 8), epochs=40, learning_rate=0.01)
    m = ltr_model.train(zip(x, y, strict=True), cfg)
    assert m.history[-1] < m.history[0] - 0.1 and len(m.validation) == 40
    assert ltr_model.list_metrics(m.forward(x[54:]), y[54:]) == max(m.validation, key=lambda v: v["ndcg_10"])  # the best epoch's weights
    assert ltr_model.train(zip(x, y, strict=True), LtrConfig(hidden=(16, 8), epochs=2, dropout=0.3, schedule="exponential", validation=0.0)).validation == []
    assert ltr_model.list_metrics(np.array([[1.0, 3, 2], [3, 2, 1]]), np.array([[1, 0, 0], [1, 0, 0]])) == {"mrr_1": 0.5, "mrr_10": pytest.approx(2 / 3), "ndcg_10": 0.75, "recall_1": 0.5}
    assert [round(ltr_model.learning_rate(s, 10, 1.0, "cosine", alpha=0.2), 3) for s in (0, 5, 10, 15)] == [1.0, 0.6, 0.2, 0.2]
    assert (m.forward(x).argmax(1) == y.argmax(1)).mean() > 0.7
    s = rng.normal(size=(1, 6))
    _, g = ltr_model.approx_ndcg(s, y[:1], 0.5)
    e = np.zeros_like(s)
    e[0, 2] = 1e-5
    num = (ltr_model.approx_ndcg(s + e, y[:1], 0.5)[0] - ltr_model.approx_ndcg(s - e, y[:1], 0.5)[0]) / 2e-5
    assert g[0, 2] == pytest.approx(num, rel=1e-3, abs=1e-8)
    again = ltr_model.Model.from_json(m.to_json())
    assert np.allclose(again.forward(x), m.forward(x))
    att = ltr_model.Model.fresh(x, LtrConfig(hidden=(16, 8), attention=True))
    assert att.forward(x).shape == (60, 6)


def test_model_and_lists_on_disk(spark, tmp_path):
    m = ltr_model.Model(np.zeros(2), np.ones(2), [(np.ones((2, 1)), np.zeros(1))], history=[1.0], validation=[{"ndcg_10": 0.5}])
    m.save(spark, str(tmp_path / "m"), LtrConfig())
    again = ltr_model.Model.load(spark, str(tmp_path / "m"))
    assert again.history == [1.0] and again.validation == m.validation and (again.layers[0][0] == m.layers[0][0]).all()
    lists = spark.createDataFrame([(i, [[1.0]], [1.0]) for i in range(9)], "qid long, features array<array<float>>, labels array<float>")
    ltr_data.write_lists(lists, str(tmp_path / "l"))
    back = ltr_data.read_lists(spark, str(tmp_path / "l"))
    few = sorted(r.qid for r in ltr_data.training_lists(back, LtrConfig(max_lists=4)).collect())
    assert len(few) == 4 and few == sorted(r.qid for r in ltr_data.training_lists(back.repartition(5), LtrConfig(max_lists=4)).collect())
    assert sum(1 for _ in ltr_data.lists_of(back)) == 9


def test_documents_are_scored_without_a_call_for_each_query(spark):
    rng = np.random.default_rng(3)
    rows = [(q, d, d + 1, float(rng.integers(4)), float(rng.random())) for q in range(9) for d in range(12)]
    featured = spark.createDataFrame(rows, "qid long, docid long, rank int, f double, g double")
    m = ltr_model.Model(np.zeros(2), np.ones(2), [(rng.normal(size=(2, 3)), np.zeros(3)), (np.ones((3, 1)), np.zeros(1))])
    again = ltr_model.rerank(featured.withColumn("g", F.lit(0.0)), m, ("f", "g"), 5, 4)
    assert "FlatMapGroupsInPandas" not in again._jdf.queryExecution().toString()
    want = []
    for q in range(9):
        x = np.array([[r[3], 0.0] for r in rows if r[0] == q])
        want += [(q, i + 1, int(d)) for i, d in enumerate(np.lexsort((np.arange(12), -m.forward(x[None])[0].round(9)))[:4])]
    assert sorted((r.qid, r["rank"], r.docid) for r in again.collect()) == want


def test_candidates_meet_labels_and_queries_unshuffled(spark, harbour):
    q = spark.createDataFrame([(1, "bay tide walk")], "qid long, query string")
    cands = harbour.select(F.lit(1).cast("long").alias("qid"), F.col("doc_id").alias("docid"), F.lit(0.5).alias("bm25"), F.lit(1).alias("rank"))
    qrels = spark.createDataFrame([(1, "h1", 1)], "qid long, docid string, rel int")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan(ltr_data.labelled(cands, qrels)) and "rightHint=(strategy=broadcast)" in plan(ltr_data.hard_pool(cands, qrels))
    assert "rightHint=(strategy=broadcast)" in plan(metrics.with_hits(cands.withColumnRenamed("docid", "doc_id"), qrels))
    assert "rightHint=(strategy=broadcast)" in plan(ltr_data.features(cands, q, harbour, Index.build(harbour, ("title", "body")), CFG))


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "D1", 1, 0.1), (1, "D2", 2, 0.9)], "qid long, docid string, rank int, f double")
    m = ltr_model.Model(np.zeros(1), np.ones(1), [(np.ones((1, 1)), np.zeros(1))])
    got = ltr_model.rerank(rows, m, ("f",), 1).orderBy("rank").collect()
    assert [r.docid for r in got] == ["D2", "D1"]
    assert ltr_model.rerank(rows, m, ("f",), 1, compat=True).count() == 1 and ltr_model.rerank(rows.limit(0), m, ("f",), 5).count() == 0
