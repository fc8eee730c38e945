r"""Line deduplication by a suffix array over line ids, built by distributed prefix doubling.

Lines with a word are the letters of one long text; documents are separated. Suffix ranks by their first 2^k lines come from
range-sorting the distinct pairs (rank of the first half, rank of the second half); a rank is an id that
grows along the sort, so no global counter is needed, and pairs are made distinct before the sort, so a line that
a third of all rows hold is one row there. Lines that occur once end every repeat and leave after the first round.

An interval of suffixes with a longest common prefix of at least m lines is the set that agrees in the ranks of
its first and its last 2^k <= m lines (the two halves overlap). A run is a repeat if its text occurs at an earlier place
(by document id, null last, then text key, then line) and it has at least ``MIN_WORDS`` words. The union of all
maximal repeats is covered by the shortest runs with that many words that start or end at each line, so only
those intervals are looked up, and doubling stops at the longest of them (at most MIN_WORDS lines). Each is tied to its interval's first
member; neighbours with the same shift to it are joined to maximal runs (``repeated_runs``), and every line of a run is deleted; the
first copy stays. Lines, pairs and intervals that many suffixes share are joined by broadcast (``skewed_join``).

Defined results: null texts count as empty; lines without a word stay and repeat nothing; rows equal in id and
text are one document; rows of one id with different texts are different documents; an empty table gives an empty result; overlapping repeats within a
text keep the first. Ids may be of any type that sorts. The lines of a text, by number and rank, are one row, so a very long text needs memory in proportion to its lines.
Extra columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, fresh_name, row_key, skewed_join

MIN_WORDS = 8
_HAS_WORD = r"[^\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _place() -> Column:
    return F.struct("none", "doc_id", "doc", "i")


def _ranked(tables: Tables, distinct: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Distinct keys with a rank that grows with them."""
    return tables.cut(distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), rows)


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", tables: Tables | None = None) -> DataFrame:
    """The maximal later copies of repeated line runs: doc (key of id and text), doc_id, lines array<int> (numbers of the run's lines), first_doc_id and first_line (place of the first copy)."""
    tables = tables or Tables(docs.sparkSession)
    lines = docs.select("doc_id", row_key("doc_id", text).alias("doc"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("l"))
    lines = lines.select(F.col("doc_id").isNull().alias("none"), "doc_id", "doc", F.posexplode(F.filter(F.transform("l", lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda e: F.rlike(e["x"], F.lit(_HAS_WORD)))).alias("i", "e"))
    lines = tables.cut(lines.select("none", "doc_id", "doc", "i", F.col("e.n").alias("n"), F.unhex(F.md5("e.x")).alias("line"), F.least(F.lit(min_words), F.size(F.regexp_extract_all("e.x", F.lit(_WORD), F.lit(0)))).alias("words")))
    count = lines.count()
    ids = lines.groupBy("line").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.count("*").alias("times")).where("first != last")
    ids = _ranked(tables, ids.drop("last"), count, "line")
    at = skewed_join(lines, ids, ["line"], "times").select("none", "doc_id", "doc", "i", "n", "words", "rank", "first")
    own = ["none", "doc_id", "doc"]
    # a document's repeated lines; first is the place of each line's first copy
    seq = at.groupBy(*own).agg(F.sort_array(F.collect_set(F.struct("i", "n", "words", "rank", "first"))).alias("s"))
    # shortest runs of at least min_words words: from each line on, and up to each line
    runs = f"""filter(flatten(transform(s, (e, j) -> array(
      named_struct('a', j, 'm', aggregate(sequence(j, least(j + {min_words - 1}, size(s) - 1)), named_struct('w', 0, 'm', 0), (t, b) ->
        CASE WHEN t.w >= {min_words} OR s[b].i != e.i + (b - j) THEN t ELSE named_struct('w', t.w + s[b].words, 'm', t.m + 1) END, t -> CASE WHEN t.w >= {min_words} THEN t.m ELSE 0 END)),
      named_struct('a', j, 'm', -aggregate(sequence(0, least({min_words - 1}, j)), named_struct('w', 0, 'm', 0), (t, b) ->
        CASE WHEN t.w >= {min_words} OR s[j - b].i != e.i - b THEN t ELSE named_struct('w', t.w + s[j - b].words, 'm', t.m + 1) END, t -> CASE WHEN t.w >= {min_words} THEN t.m ELSE 0 END))))), r -> r.m != 0)"""
    seq = seq.withColumn("runs", F.expr(f"array_distinct(transform({runs}, r -> CASE WHEN r.m < 0 THEN named_struct('a', r.a + r.m + 1, 'm', -r.m) ELSE r END))"))
    seq = tables.cut(seq.where(F.size("runs") > 0), count)
    tables.drop(lines)
    # runs of one line: their interval's first member is the line's own
    single = seq.select(*own, F.explode(F.expr("transform(filter(runs, r -> r.m = 1), r -> s[r.a])")).alias("e"))
    later = single.where(F.struct("none", "doc_id", "doc", "e.i") > F.col("e.first")).select(*own, F.col("e.i").alias("i"), F.array("e.n").alias("lines"), F.col("e.first").alias("first"))
    # longer runs: doubling within the documents that have any
    deep = seq.select(*own, F.expr("transform(s, e -> struct(e.i AS i, e.n AS n))").alias("s"), F.expr("filter(runs, r -> r.m > 1)").alias("runs"), F.expr("transform(s, e -> e.rank)").alias("r")).where(F.size("runs") > 0)
    ranks, width, levels = tables.cut(deep, count), 1, []
    while True:
        # runs of width < m <= 2 * width (from width on at first) are told by two overlapping ranks of this level; a rank of -1 is of a run that occurs once
        wanted = ranks.select(*own, "s", "r", F.explode(F.expr(f"filter(runs, x -> x.m > {width} AND x.m <= {2 * width})")).alias("x"))
        wanted = wanted.select(*own, F.expr("s[x.a].i").alias("i"), F.col("x.m").alias("m"), F.expr("r[x.a]").alias("head"), F.expr(f"r[x.a + x.m - {width}]").alias("tail"), F.expr("transform(slice(s, x.a + 1, x.m), e -> e.n)").alias("lines"))
        levels.append(wanted.where("head >= 0 AND tail >= 0"))
        if 2 * width >= min_words:
            break
        pairs = ranks.where(F.expr(f"exists(runs, x -> x.m > {2 * width})"))
        pairs = pairs.select(*own, F.posexplode(F.expr(f"transform(r, (v, j) -> named_struct('a', v, 'b', CASE WHEN j + {width} < size(s) AND s[j + {width}].i = s[j].i + {width} THEN r[j + {width}] ELSE -1L END))")).alias("j", "p"))
        pairs = tables.cut(pairs.select(*own, "j", "p.a", "p.b").where("a >= 0 AND b >= 0"), count)
        named = _ranked(tables, pairs.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1"), count, "a", "b")
        again = skewed_join(pairs, named, ["a", "b"], "times").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("j", "rank"))).alias("named"))
        width *= 2
        known = ranks.drop("r").where(F.expr(f"exists(runs, x -> x.m > {width})")).join(again, "doc")
        ranks = tables.cut(known.withColumn("r", F.expr("transform(s, (e, j) -> coalesce(element_at(named, j), -1L))")).drop("named"), count)
        tables.drop(pairs, named)
    windows = levels[0]
    for more in levels[1:]:
        windows = windows.unionByName(more)
    windows = tables.cut(windows, 2 * count)
    interval = tables.cut(windows.groupBy("m", "head", "tail").agg(F.min(_place()).alias("first"), F.count("*").alias("times")).where("times > 1"), 2 * count)
    members = skewed_join(windows, interval, ["m", "head", "tail"], "times").where(_place() > F.col("first"))
    later = later.unionByName(members.select(*own, "i", "lines", "first"))
    # windows with one shift to the first copy join to a run where they touch or overlap
    by = Window.partitionBy("doc", "first.doc", F.col("i") - F.col("first.i")).orderBy("i", F.size("lines"))
    reach = F.max(F.col("i") + F.size("lines")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("i") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("shift", F.col("i") - F.col("first.i"))
    joined = later.groupBy("doc", F.col("first.doc").alias("first_doc"), "shift", "run").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"), F.min("first").alias("first"))
    return joined.select("doc", "doc_id", "lines", F.col("first.doc_id").alias("first_doc_id"), F.col("first.i").alias("first_line"))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text") -> DataFrame:
    """doc (key of id and text), gone array<int>: line numbers to delete, of documents with any."""
    return repeated_runs(docs, min_words, text).groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def _cleaned(docs: DataFrame, min_words: int) -> tuple[DataFrame, str, str]:
    """docs with the kept text and the number of removed lines under fresh names."""
    names = docs.columns
    kept, gone, key, own = (fresh_name(n, names) for n in ("kept_", "gone_", "key_", "own_"))
    removed = removed_lines(docs.select("doc_id", "text"), min_words).select(F.col("doc").alias(key), F.col("gone").alias(gone))
    at = docs.withColumn(own, row_key()).join(removed, F.col(own) == F.col(key), "left")
    lines = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return at.withColumn(kept, text).withColumn(gone, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone))), kept, gone


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of docs with the later copies of repeated lines deleted; columns as in docs.

    A row of which no word is left was a copy throughout and goes; rows that had no word before stay.
    """
    at, kept, gone = _cleaned(docs, min_words)
    at = at.where((F.col(gone) == 0) | F.rlike(F.col(kept), F.lit(_HAS_WORD)))
    return at.select(*[F.col(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def line_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 (of the text that is left, null as empty) of every row."""
    at, kept, gone = _cleaned(docs.select("doc_id", "text"), min_words)
    n = F.size(F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(_HAS_WORD))))
    return at.select("doc_id", n.cast("long").alias("n_lines"), F.col(gone).cast("long").alias("n_removed"), F.sha2(F.coalesce(F.col(kept), F.lit("")), 256).alias("kept_sha256"))
