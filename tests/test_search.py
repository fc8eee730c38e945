import pytest
from pyspark.sql import functions as F

from fathom.config import AnalyzerConfig, FieldConfig, SearchConfig
from fathom.functions.analyze import ascii_fold, number_normalize, stem, tokens
from fathom.functions.snippet import highlight, snippets
from fathom.operators.score import get_ranker, hydrate, scores, scores_of, search
from fathom.plans import boolean
from fathom.plans.index import Index
from fathom.sources.corpus import read_corpus

CFG = SearchConfig(num_docs=5, postings_cut=100, max_results=5, fields={"title": FieldConfig(2.0, 5), "body": FieldConfig(1.0, 15), "url": FieldConfig(1.5, 5)})


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")


def toks(spark, text, **cfg):
    return spark.range(1).select(tokens(F.lit(text), AnalyzerConfig(**cfg))).first()[0]


def test_analyzer(spark, harbour):
    got = {r.doc_id: r.t for r in harbour.select("doc_id", tokens(F.col("body")).alias("t")).collect()}
    assert got["h2"] == "keeper greets every boat brass lamps burn along gate".split()
    assert [len(got[f"h{i}"]) for i in range(1, 6)] == [13, 9, 11, 9, 7]
    assert toks(spark, "It's café 1,000 A b2b") == ["it's", "caf", "000", "b2b"]
    assert toks(spark, None) == [] and toks(spark, "") == []
    assert toks(spark, "café 1,000", ascii_fold=True, number_normalize=True) == ["cafe", "1000"]
    assert toks(spark, "Running THE tested", lowercase=False, stem=True) == ["Runn", "THE", "test"]
    words = ["running", "markedly", "tested", "sadly", "boxes", "cats", "is", "thing"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w"))).collect()
    assert [r[0] for r in got] == ["runn", "mark", "test", "sad", "box", "cat", "is", "th"]
    assert spark.range(1).select(ascii_fold(F.lit("Žluťoučký")), number_normalize(F.lit("1,234,567, 8"))).first()[:] == ("Zlutoucky", "1234567, 8")


@pytest.mark.parametrize(
    ("text", "fields", "ranker", "want"),
    [
        ("tide lock", ("title", "body"), "bm25", {"h1": 4.162842, "h5": 2.587127, "h2": 2.453618, "h4": 1.067645}),
        ("lock gate", ("body",), "bm25", {"h1": 1.88007, "h4": 1.724958, "h2": 0.657313}),
        ("green lamps", ("body",), "bm25", {"h3": 3.470376, "h2": 1.067645}),
        ("bay tide walk", ("title", "body"), "bm25", {"h5": 10.108359, "h1": 2.856172, "h3": 0.994851}),
        ("tide tide", ("body",), "bm25", {"h1": 2.61334, "h5": 2.303865}),
        ("tide lock", ("title", "body"), "tfidf", {"h1": 1.830553, "h2": 1.270249, "h5": 1.062232, "h4": 0.354077}),
        ("bay tide walk", ("title", "body"), "tfidf", {"h5": 4.591931, "h1": 1.269354, "h3": 0.354077}),
    ],
)
def test_ranking_goldens(spark, harbour, text, fields, ranker, want):
    got = search(ask(spark, text), Index.build(harbour, fields), CFG, ranker=ranker).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(want)
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=5e-6)


def test_cut_k_and_registry(spark, harbour):
    index = Index.build(harbour, ("body",))
    few = SearchConfig(num_docs=5, postings_cut=2, fields=CFG.fields)
    assert {r.doc_id for r in search(ask(spark, "gate tide"), index, few).collect()} == {"h1", "h5"}  # gate is in three
    assert search(ask(spark, "gate tide"), index, few, ranker="tfidf").count() == 4
    assert search(ask(spark, "gate"), index, CFG, 2).count() == 2 and search(ask(spark, "gate"), index, CFG, 0).count() == 0
    assert search(ask(spark, "the of", ""), index, CFG).count() == 0
    with pytest.raises(ValueError):
        get_ranker("semantic")
    ranked = search(ask(spark, "market"), Index.build(harbour, ("title",)), CFG)
    assert hydrate(ranked, harbour, ("title", "url")).first().title == "Market Day"
    lost = hydrate(ranked, harbour.where("doc_id != 'h4'"), ("title",)).collect()
    assert [(r.doc_id, r.title) for r in lost] == [("h4", None)]
    tuned = index.tuned(CFG)
    assert tuned.num_docs == 5 and tuned.of("body").avg_len == 9.8


def test_many_terms_meet_the_postings_in_a_join(spark, harbour, monkeypatch):
    from fathom.operators import score

    index, asked = Index.build(harbour, ("title", "body")), ask(spark, "tide lock", "green lamps")
    one = sorted(search(asked, index, CFG).collect())
    monkeypatch.setattr(score, "FEW_TERMS", 1)
    assert sorted(search(asked, index, CFG).collect()) == one


@pytest.mark.parametrize(("ids", "ranker"), [("long", "bm25"), ("string", "tfidf")])
def test_many_queries_by_blocks(spark, monkeypatch, tmp_path, ids, ranker):
    """Blocks of postings and of queries give the same rows as the join: with ties at the cut, weights of zero and less, equal and empty queries, saved or not."""
    from fathom.operators import batch, score

    n = F.col("id")
    word = lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(n, F.lit(k)), F.lit(4 + k)).cast("string"))
    docs = spark.range(90).select(n.cast(ids).alias("doc_id"), F.concat_ws(" ", word(1), word(2)).alias("title"), F.concat_ws(" ", F.lit("every"), *[word(k) for k in (3, 5, 9)], word(20)).alias("body"))
    index = Index.build(docs, ("title", "body"))
    asked = ask(spark, "every w1", "w3 w2 w2", "w2 w3 w2", "w7", "", "of", "w11 every every w0 w5", "w1 every", "nowhere")
    cfg = SearchConfig(num_docs=90, postings_cut=200, fields={"title": FieldConfig(2.0, 2), "body": FieldConfig(1.0, 5)})
    one = {k: sorted(search(asked, index, cfg, k, ranker).collect()) for k in (3, 1000)}
    monkeypatch.setattr(score, "FEW_TERMS", 1)
    monkeypatch.setattr(score, "scores", None)  # no row for every pair that shares a term
    monkeypatch.setattr(batch, "BLOCK_POSTINGS", 250)
    monkeypatch.setattr(batch, "PIECE_POSTINGS", 40)
    monkeypatch.setattr(batch, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(batch, "TERMS_AT_ONCE", 30)
    index.save(str(tmp_path / "i"))
    for at, (k, want) in zip((index, Index.load(spark, str(tmp_path / "i"))), one.items(), strict=True):
        assert sorted(search(asked, at, cfg, k, ranker).collect()) == want


def test_blocks_of_queries_are_ranked_by_a_task_each(spark, monkeypatch):
    from fathom.operators import score

    docs = spark.createDataFrame([(i, f"all w{i % 7} v{i % 5}") for i in range(60)], "doc_id long, body string")
    monkeypatch.setattr(score, "FEW_TERMS", 1)
    got = search(ask(spark, *[f"all w{i}" for i in range(7)], *[f"v{i}" for i in range(5)]), Index.build(docs), CFG, 3)
    assert len([f for f in got.inputFiles() if f.endswith(".parquet")]) == 4 and got.count() == 36


def test_blocks_are_shuffled_a_part_at_a_time(spark, monkeypatch):
    from fathom.operators import batch, score

    docs = spark.createDataFrame([(i, f"all w{i % 7} v{i % 5}") for i in range(60)] + [(None, "all w1")], "doc_id long, body string")
    index, asked = Index.build(docs), ask(spark, "all w1", "v2 w3", "w5 w2 v1 v4 v0")
    monkeypatch.setattr(score, "FEW_TERMS", 1)
    want, cut, tables = sorted(search(asked, index, CFG, 30).collect(), key=str), batch.Scratch.cut, []
    monkeypatch.setattr(batch.Scratch, "cut", lambda self, df, **k: (tables.append({r.blk for r in df.select("blk").collect()}) if "blk" in df.columns else None, cut(self, df, **k))[1])
    monkeypatch.setattr(batch, "BLOCK_POSTINGS", 14)
    monkeypatch.setattr(batch, "ROUND_BLOCKS", 2)
    assert sorted(search(asked, index, CFG, 30).collect(), key=str) == want
    assert len(tables) > 1 and len(set().union(*tables)) == sum(map(len, tables)) > 4


@pytest.mark.parametrize("few", [1, 500])
def test_lists_are_not_written_whole(spark, monkeypatch, few):
    """Judgements go along with the queries, and what is made of each list is written instead of it."""
    from fathom.operators import metrics, score

    docs = spark.createDataFrame([(i, f"all w{i % 7} v{i % 5}") for i in range(60)], "doc_id long, body string")
    index, asked = Index.build(docs), ask(spark, "all w1", "v2 w3", "all w1", "nowhere", "v1 all")
    qrels = spark.createDataFrame([(0, 36, 1), (0, 50, 1), (0, 50, 2), (0, 1, 0), (0, 999, 1), (1, 17, 1), (2, None, 1), (3, 5, 1), (None, 1, 1)], "qid long, docid long, rel int")
    rows = search(asked, index, CFG, 40)
    want = {q: sorted(r["rank"] for r in rows.collect() if r.qid == q and r.doc_id in rel) for q, rel in {0: (36, 50), 1: (17,), 2: (), 4: ()}.items()}
    monkeypatch.setattr(score, "FEW_TERMS", few)
    made = search(asked, index, CFG, 40, along=metrics.relevant(qrels), then=metrics.ranks_of)
    got = {r.qid: (r.n_rel, r.ranks) for r in made.collect()}
    assert {q: r or [] for q, (_, r) in got.items()} == want and want[0] and want[1] and {q: n for q, (n, _) in got.items()} == {0: 3, 1: 1, 2: 0, 4: None}
    assert few > 1 or spark.read.parquet(*made.inputFiles()).columns == ["qid", "n_rel", "ranks"]
    assert sorted(metrics.recall_of(made, 3).collect()) == sorted(metrics.recall_curve(rows, qrels, 3).collect())
    assert search(asked, index, CFG, 0, along=metrics.relevant(qrels), then=metrics.ranks_of).count() == 0


def test_packed_postings_are_small():
    import numpy as np
    import pyarrow as pa

    from fathom.operators import batch

    rng = np.random.default_rng(1)
    for docs, most, width in ((2000, 3, 2), (1 << 17, 4, 4)):
        lid = np.repeat(np.arange(50), 1000)
        d = np.concatenate([rng.choice(docs, 1000, replace=False) for _ in range(50)]).astype(np.int32)
        w = rng.choice(20, len(d)) * 70_001 + 1
        packed = batch._row(0, pa.array(range(docs)), lid, d, w)
        got = {c: packed.column(c)[0].as_buffer() for c in ("lids", "starts", "d", "w")}
        assert sum(b.size for b in got.values()) < most * len(d)
        opened = batch._opened(got["d"], len(d))
        order = np.lexsort((d, lid))
        assert opened.itemsize == width and (opened == d[order]).all() and (batch._opened(got["w"], len(d)) == w[order]).all()
        assert (batch._opened(got["lids"]) == np.arange(50)).all() and (batch._opened(got["starts"]) == np.arange(51) * 1000).all()


@pytest.mark.parametrize("ranker", ["bm25", "tfidf"])
def test_scores_of_pairs(spark, harbour, ranker):
    asked, index = ask(spark, "tide lock tide", "bay walk", "of", "green lamps gate"), Index.build(harbour, ("title", "body"))
    pairs = asked.select("qid").crossJoin(harbour.select("doc_id")).where("doc_id != 'h1' OR qid > 0").withColumn("near", F.lit(1))
    want = {(r.qid, r.doc_id): r.score for r in scores(asked, index, CFG, ranker).collect()}
    got = scores_of(pairs, asked, index, CFG, ranker)
    assert {(r.qid, r.doc_id): r.score for r in got.collect()} == {(r.qid, r.doc_id): want.get((r.qid, r.doc_id)) for r in pairs.collect()}
    index.doc_terms = None
    assert sorted(map(str, scores_of(pairs, asked, index, CFG, ranker).select(got.columns).collect())) == sorted(map(str, got.collect()))


def test_postings_are_saved_in_rounds(spark, harbour, tmp_path, monkeypatch):
    from fathom.plans import index as plans

    monkeypatch.setattr(plans, "ROUND_TOKENS", 20, raising=False)
    built = Index.build(harbour, ("title", "body"), positions=True)
    built.save(str(tmp_path / "ix"))
    built.save(str(tmp_path / "ix"), force=True)
    again = Index.load(spark, str(tmp_path / "ix"))
    assert len({f.name.split("-", 2)[2] for f in (tmp_path / "ix/postings").rglob("*.parquet")}) > 1  # a name for each write
    assert sorted(again.postings.drop("bucket").collect()) == sorted(built.postings.collect())
    assert sorted(again.doc_stats.collect()) == sorted(built.doc_stats.collect()) and sorted(again.term_stats.collect()) == sorted(built.term_stats.collect())


def test_index_round_trip(spark, harbour, tmp_path):
    index = Index.build(harbour, ("title", "body"), positions=True)
    path = str(tmp_path / "ix")
    index.save(path)
    with pytest.raises(Exception, match="(?i)exist"):
        index.save(path)
    again = Index.load(spark, path)
    assert sorted(again.term_stats.collect()) == sorted(index.term_stats.select("field", "term", "df", "cf").select(again.term_stats.columns).collect())
    assert search(ask(spark, "tide lock"), again, CFG).orderBy("rank").first().doc_id == "h1"
    assert {r.term for r in again.postings_of(["tide", "nothing"]).collect()} == {"tide"}
    more = spark.createDataFrame([("h6", "u", "of the", "slow tide turns")], harbour.schema)
    again.append(more, path)
    both = Index.load(spark, path)
    assert both.term_stats.where("term = 'tide' AND field = 'body'").first().df == 3
    assert both.doc_stats.where("doc_id = 'h6' AND field = 'title'").first().doc_len == 0
    assert {r.doc_id for r in boolean.phrase_matches(ask(spark, "tide turns"), both, CFG).collect()} == {"h1", "h6"}


def test_kept_index_follows_its_table(spark, harbour, tmp_path):
    from fathom.plans.store import kept

    path, built = str(tmp_path / "t"), []

    def build():
        built.append(1)
        return Index.build(spark.read.parquet(path), ("body",))

    harbour.where("doc_id < 'h3'").write.parquet(path)
    assert kept(spark, path, "t", build).sizes()["body"][0] == 2 and kept(spark, path, "t", build).sizes()["body"][0] == 2 and len(built) == 1
    harbour.where("doc_id >= 'h3'").write.mode("append").parquet(path)
    assert kept(spark, path, "t", build).sizes()["body"][0] == 5 and len(built) == 2


def test_measured_build(spark, harbour, tmp_path):
    from fathom.plans.report import measured_build

    for _ in range(2):
        got = measured_build(harbour, str(tmp_path / "ix"), ("title", "body"), log=str(tmp_path / "log"))
    assert got["docs"] == 5 and got["docs_per_second"] > 0 and got["kib_per_doc"] > 0 and spark.read.text(str(tmp_path / "log")).count() == 2


def test_vector_store(spark, tmp_path):
    from fathom.sources.vectors import VectorStore

    store = VectorStore(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "doc_id long, vec array<float>")
    assert not store.exists()
    store.write(rows)
    with pytest.raises(FileExistsError):
        store.write(rows)
    assert store.exists() and store.num_docs == 30 and store.dim == 2
    assert {r.doc_id: list(r.vec) for r in store.get([3, 29, 99]).collect()} == {3: [3.0, 1.0], 29: [29.0, 1.0]} and store.get([]).count() == 0
    store.write(rows.limit(4), force=True)
    assert VectorStore(spark, str(tmp_path / "v")).num_docs == 4
    with pytest.raises(ValueError):
        store.write(rows.unionByName(spark.createDataFrame([(50, [1.0])], rows.schema)), force=True)


def test_stream_index(spark, harbour, tmp_path):
    from fathom.streaming.incremental import index_stream, load

    src = str(tmp_path / "in")
    for k in range(2):
        harbour.where(f"doc_id {'<' if k == 0 else '>='} 'h3'").coalesce(1).write.mode("append").parquet(src)
        index_stream(spark, src, "doc_id string, url string, title string, body string", str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    whole = Index.build(harbour, ("body",))
    both = load(spark, str(tmp_path / "ix"), [0, 1])
    cols = ["field", "term", "df", "cf"]
    assert sorted(both.term_stats.select(cols).collect()) == sorted(whole.term_stats.select(cols).collect())


def test_corpus_reader(spark, tmp_path):
    p = tmp_path / "c.tsv"
    p.write_text("a\tu\tt\tb\nbad line\nb\tu\t\tx\ry\nc\tu\tt\tb\textra\nd\t\t\t\n")
    got = read_corpus(spark, str(p)).orderBy("row_id").collect()
    assert [(r.row_id, r.doc_id) for r in got] == [(0, "a"), (2, "b"), (4, "d")]
    assert read_corpus(spark, str(p), limit=1, batch=3).count() == 2 and read_corpus(spark, str(p), limit=1, exact=True).count() == 1


# implicit AND binds loosest, then OR, ANDNOT and AND
TREES = {
    "red or blue": "red or blue",
    "red and red andnot blue": "(red and red) and not blue",
    "'deep sea' and 'cold air'": "'deep sea' and 'cold air'",
    "(red OR blue) & ship": "(red or blue) and ship",
    "(red - (old || new) | blue) && ship": "((red and not (old or new)) or blue) and ship",
    "don't stop now": "don't and stop and now",
    "'quoted'": "'quoted'",
    " word ": "word",
    "one two three": "one and two and three",
    "red and blue ship": "(red and blue) and ship",
    "red or blue ship": "(red or blue) and ship",
    "red not blue ship": "(red and not blue) and ship",
    "one two or three four": "one and (two or three) and four",
    "(one two) or three": "(one and two) or three",
    "'deep sea' cold or warm": "'deep sea' and (cold or warm)",
    "((nested))": "nested",
    " or ".join(f"w{i}" for i in range(15)): " or ".join(f"w{i}" for i in range(15)),
}


@pytest.mark.parametrize(("text", "tree"), TREES.items())
def test_parser(text, tree):
    assert str(boolean.parse(text)) == tree


@pytest.mark.parametrize("text", ["(a", "a)", "a and", "or b", "not x", "()"])
def test_parser_errors(text):
    with pytest.raises(ValueError):
        boolean.parse(text)


def test_boolean_execution(spark, harbour):
    index = Index.build(harbour, ("body",), positions=True)
    run = lambda q, **o: {r.doc_id: r.score for r in boolean.execute(spark, q, index, CFG, **o).collect()}
    gate, tide = run("gate"), run("tide")
    assert run("gate and tide") == {d: pytest.approx(gate[d] + tide[d], abs=2e-6) for d in gate.keys() & tide.keys()}
    assert set(run("gate or tide")) == gate.keys() | tide.keys()
    assert set(run("gate andnot tide")) == gate.keys() - tide.keys()
    assert run("gate and herring and tide") == {}
    assert run("gate andnot the") == gate and run("the and gate") == gate and run("") == {}
    assert set(run("'lock gate'")) == {"h4"} and run("'gate lock'") == {}
    assert set(run("'lock keeper opens the gate when the tide turns'")) == {"h1"}
    # implicit AND is the loosest
    assert set(run("herring or tide mussels")) == {"h4", "h5"} and set(run("gate not tide mussels")) == {"h4"}
    wider = lambda texts: [[("mussels", 2.0)] for _ in texts]
    assert set(run("herring", expander=wider)) == {"h4", "h5"} and set(run("herring andnot 'lock gate'", expander=wider)) == {"h5"}
    shown, n, echo = boolean.search_boolean(spark, "gate or tide", index, CFG, 2)
    assert [r["rank"] for r in shown.collect()] == [1, 2] and n == 4 and echo == "gate or tide"


def test_snippets(spark):
    text = " ".join(f"word{i:02d}" for i in range(60)) + " needle, needle End"
    rows = spark.createDataFrame([(text, "needle end"), (text, ""), ("", "x"), (None, "x")], "text string, query string")
    got = [r.snippet for r in snippets(rows).collect()]
    assert got[0].startswith("...") and "End" in got[0] and got[1].startswith("word00") and got[2:] == ["", ""]
    assert spark.range(1).select(highlight(F.lit('An "Apple, pie'), F.lit("apple"))).first()[0] == 'An **"Apple,** pie'
