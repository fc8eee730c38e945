"""The inverted index as tables: postings, document terms, document lengths and term statistics of each field."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AnalyzerConfig, FieldConfig, SearchConfig
from ..functions.analyze import tokens
from ..sources.corpus import unpivot

FORMAT = 2
TERM_BUCKETS = 64
#: Tokens whose postings are shuffled at once when an index is saved, about, and most rounds. A round reads all document terms.
ROUND_TOKENS = 8_000_000
MOST_ROUNDS = 8


@dataclass
class Index:
    """postings(field, term, doc_id, tf, doc_len[, positions]) carry the length so that scoring joins nothing else.

    doc_terms(field, doc_id, tokens) keeps the analysis, for features and phrases of known documents; doc_stats(field, doc_id, doc_len) holds every
    document, also those without a token; term_stats(field, term, df, cf).
    """

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    fields: tuple[str, ...]
    analyzer: AnalyzerConfig
    doc_terms: DataFrame | None = None
    positions: bool = False
    _sizes: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    @staticmethod
    def analyzed(corpus: DataFrame, fields: tuple[str, ...], analyzer: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
        """field, doc_id, tokens."""
        return unpivot(corpus, fields).select("field", "doc_id", tokens(F.col("text"), analyzer).alias("tokens"))

    @classmethod
    def build(cls, corpus: DataFrame, fields: tuple[str, ...] = ("body",), analyzer: AnalyzerConfig = AnalyzerConfig(), positions: bool = False) -> Index:
        """Analyzes corpus(doc_id, fields...) and inverts it."""
        return cls._of_terms(cls.analyzed(corpus, fields, analyzer), fields, analyzer, positions)

    @classmethod
    def _of_terms(cls, terms: DataFrame, fields: tuple[str, ...], analyzer: AnalyzerConfig, positions: bool, part: tuple[int, int] = (0, 1)) -> Index:
        """Terms are counted, and their positions listed, within each document's row, before any shuffle: the postings need none, term statistics one with partial sums.

        part (i, n): the postings of every n-th term bucket from the i-th on.
        """
        stats = terms.select("field", "doc_id", F.size("tokens").alias("doc_len"))
        # runs of the sorted tokens: a term's tf is the length of its run
        listed = "transform(tokens, (t, i) -> struct(t AS t, i AS i))" if positions else "transform(tokens, t -> struct(t AS t))"
        if part[1] > 1:
            listed = f"filter({listed}, x -> pmod(xxhash64(x.t), {TERM_BUCKETS}) % {part[1]} = {part[0]})"
        listed = F.expr(f"sort_array({listed})")
        flat = terms.select("field", "doc_id", F.size("tokens").alias("doc_len"), listed.alias("s")).where("doc_len > 0")
        flat = flat.withColumn("at", F.expr("filter(slice(sequence(0, size(s)), 1, size(s)), i -> i = 0 OR s[i].t != s[i - 1].t)"))
        end = "(CASE WHEN k + 1 < size(at) THEN at[k + 1] ELSE size(s) END)"
        places = f", 'positions', transform(slice(s, i + 1, {end} - i), x -> x.i)" if positions else ""
        runs = F.expr(f"transform(at, (i, k) -> named_struct('term', s[i].t, 'tf', {end} - i{places}))")
        postings = flat.select("field", "doc_id", "doc_len", F.explode(runs).alias("r")).select("field", "r.term", "doc_id", "r.tf", "doc_len", *(["r.positions"] if positions else []))
        return cls(postings, stats, cls._term_stats(postings), fields, analyzer, terms, positions)

    @staticmethod
    def _term_stats(postings: DataFrame) -> DataFrame:
        return postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def persist(self) -> Index:
        for t in (self.postings, self.doc_stats, self.term_stats):
            t.persist()
        return self

    def sizes(self) -> dict[str, tuple[int, float]]:
        """Of each field, the number of documents and their mean length."""
        if not self._sizes:
            rows = self.doc_stats.groupBy("field").agg(F.count("*").alias("n"), F.sum("doc_len").alias("s")).collect()  # a row a field
            self._sizes.update({r["field"]: (r["n"], r["s"] / r["n"]) for r in rows})
        return self._sizes

    def tuned(self, cfg: SearchConfig = SearchConfig()) -> SearchConfig:
        """cfg with the number of documents and the mean lengths of this index in place of configured ones."""
        sizes = self.sizes()
        fields = {f: FieldConfig(cfg.of(f).weight, sizes[f][1]) for f in sizes}
        return replace(cfg, num_docs=max((n for n, _ in sizes.values()), default=0), fields=cfg.fields | fields)

    def save(self, path: str, force: bool = False) -> None:
        """Parquet tables, postings split by field and term bucket and sorted by term, terms by field; existing ones are an error unless forced. ``meta`` comes last: an index without it isn't whole.

        Postings of a large index are shuffled a part of the term buckets at a time, so that the shuffle doesn't take several times the input.
        """
        mode = "overwrite" if force else "errorifexists"
        spark = self.postings.sparkSession
        self.doc_terms.write.mode(mode).option("compression", "zstd").partitionBy("field").parquet(f"{path}/doc_terms")
        # everything else from the written terms: the analysis runs once
        terms = spark.read.parquet(f"{path}/doc_terms").select("field", "doc_id", "tokens")
        of = lambda *part: Index._of_terms(terms, self.fields, self.analyzer, self.positions, part)
        of(0, 1).doc_stats.write.mode(mode).partitionBy("field").parquet(f"{path}/doc_stats")
        total = spark.read.parquet(f"{path}/doc_stats").agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]
        rounds = max(1, min(MOST_ROUNDS, -(-total // ROUND_TOKENS)))
        for i in range(rounds):
            dealt = of(i, rounds).postings.withColumn("bucket", term_bucket(F.col("term"))).repartition("field", "bucket").sortWithinPartitions("field", "bucket", "term", "doc_id")
            dealt.write.mode("append" if i else mode).option("compression", "zstd").partitionBy("field", "bucket").parquet(f"{path}/postings")
        self._term_stats(spark.read.parquet(f"{path}/postings")).repartition("field").sortWithinPartitions("field", "term").write.mode(mode).partitionBy("field").parquet(f"{path}/term_stats")
        meta = json.dumps({"format": FORMAT, "fields": self.fields, "analyzer": self.analyzer.__dict__, "positions": self.positions})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta["format"] != FORMAT:
            raise ValueError(f"index format {meta['format']}; this version reads {FORMAT}")
        read = lambda t, *c: spark.read.parquet(f"{path}/{t}").select(*c)
        own = ["field", "term", "doc_id", "tf", "doc_len", *(["positions"] if meta["positions"] else []), "bucket"]
        stats = read("term_stats", "field", "term", "df", "cf").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))  # a row for each batch of documents
        return cls(read("postings", *own), read("doc_stats", "field", "doc_id", "doc_len"), stats, tuple(meta["fields"]), AnalyzerConfig(**meta["analyzer"]), read("doc_terms", "field", "doc_id", "tokens"), meta["positions"])

    def postings_of(self, terms: list[str]) -> DataFrame:
        """Postings of a few terms: literals reach the scan, as partition and row-group filters."""
        p = self.postings.where(F.col("term").isin(terms))
        if "bucket" in self.postings.columns:
            # constants, folded without a job
            listed = ", ".join(f"pmod(xxhash64({_literal(t)}), {TERM_BUCKETS})" for t in terms)
            buckets = self.postings.sparkSession.sql(f"SELECT array({listed}) AS b FROM VALUES (1)").first()[0] if terms else []
            p = p.where(F.col("bucket").isin(sorted(set(buckets)))).drop("bucket")
        return p

    def append(self, corpus: DataFrame, path: str) -> None:
        """Adds documents with new ids to a saved index; document frequencies are summed when read."""
        terms = Index.analyzed(corpus, self.fields, self.analyzer).persist()
        try:
            more = Index._of_terms(terms, self.fields, self.analyzer, self.positions)
            more.doc_terms.write.mode("append").partitionBy("field").parquet(f"{path}/doc_terms")
            more.postings.withColumn("bucket", term_bucket(F.col("term"))).write.mode("append").partitionBy("field", "bucket").parquet(f"{path}/postings")
            more.doc_stats.write.mode("append").partitionBy("field").parquet(f"{path}/doc_stats")
            more.term_stats.write.mode("append").partitionBy("field").parquet(f"{path}/term_stats")
        finally:
            terms.unpersist()


def term_bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
