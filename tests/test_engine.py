import numpy as np
import pytest

from fathom.config import FEATURES, AnalyzerConfig, FieldConfig, SearchConfig, as_bool
from fathom.engine import Engine
from fathom.operators import dense, ltr_model
from fathom.plans.index import Index


def test_modes(spark, harbour):
    cfg = SearchConfig(num_docs=5, postings_cut=100, max_results=3, fields={"title": FieldConfig(2.0, 5), "body": FieldConfig(1.0, 15)})
    enc = dense.HashingEncoder()
    texts = harbour.selectExpr("doc_id", "concat(title, ' ', body) AS text")
    one = np.zeros((len(FEATURES), 1))
    one[0] = -1  # the model turns the retrieval order around
    model = ltr_model.Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), [(one, np.zeros(1))])
    e = Engine(spark, harbour, Index.build(harbour, ("title", "body")), cfg, vectors=dense.embed(texts, enc), encoder=enc, model=model)
    ids = lambda mode, k=None: [r.doc_id for r in e.search_one("tide lock", mode, k).orderBy("rank").collect()]
    assert ids("bm25") == ["h1", "h5", "h2"]
    assert ids("bm25+ltr", 4) == ["h4", "h2", "h5", "h1"]
    assert len(ids("semantic")) == 3 and set(ids("semantic+ltr", 5)) == {f"h{i}" for i in range(1, 6)}
    with pytest.raises(ValueError):
        e.search_one("x", "psychic")
    with pytest.raises(ValueError):
        Engine(spark, harbour, e.index, cfg).search_one("x", "semantic")
    q = spark.createDataFrame([(0, "tide lock")], "qid long, query string")
    shown = e.show(e.search(q), q).collect()
    assert [r["rank"] for r in shown] == [1, 2, 3] and shown[0].title == "Tide Tables" and shown[0].snippet.startswith("...")
    found, n, echo = e.boolean("lock and keeper")
    assert n == 2 and echo == "lock and keeper" and {r.doc_id for r in found.collect()} == {"h1", "h2"}


def test_config():
    assert as_bool("Yes") and not as_bool("0") and as_bool(None, True) and AnalyzerConfig().min_len == 2
    assert SearchConfig().of("title").weight == 2.0 and SearchConfig().of("other").avg_len == 100.0


def test_a_broken_import_is_not_an_absent_package():
    import __spark_entry__ as entry

    assert entry._absent(ModuleNotFoundError(name="fathom.llm")) and entry._absent(ModuleNotFoundError(name="corpus_pipeline"))
    assert not entry._absent(ModuleNotFoundError(name="fathom.llm.misspelt")) and not entry._absent(ModuleNotFoundError(name="ahocorasick"))


def test_entry_points_without_llm():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {"bm25_topk", "rerank_ltr", "phrase_match"} <= set(names) and set(entry.oracle_sql()) <= set(names)
