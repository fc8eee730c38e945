r"""Mixing sources to target weights along a time-varying curriculum.

Targets. Sources, by code point with null last, weigh 5, 2, 1, repeating, and share the words of the
whole corpus; a target stops at three times its source's size and the excess is reshared by weight.
That is water filling: with sources in order of (limit / weight), the common level is the largest
(words left / weight left) that the next source's limit still admits.

Curriculum. Source s has the weight target_s * (1 + a_s * (2t - 1)) at training time t in [0, 1], with
a_s = -0.5, 0, 0.5 repeating, so its integral is its target and its cumulative demand is
target_s * (t + a_s * (t^2 - t)). A document's copy that begins q words into its source's stream gets
the time at which that demand reaches q (the root of a quadratic); the corpus is then range-sorted by time.

Stream order within a source is the order of a keyed md5 of the id and the text. Whole passes over the
source come first, then the copies that start before the rest of the target; the copy that crosses the
end is cut there (``part_words``), so the taken words miss a target by less than one.

Prefix sums run in two levels (source and the first hex digits of the key, more of them the larger the table, then within that), so
that no task holds a whole source. The table of sources is taken to be small (one row a source).

Defined results: null text has size 0; null source is a source of its own, sorted last; an empty table gives an empty
result; rows equal in id and text are ordered arbitrarily among themselves, being equal in size too; ties in time go to the source, then the id.
A very long text is one item of the stream, cut at the target's end like any other. Columns of docs are passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, fresh_name, salted_join

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)
MOST_COPIES = 3
BUCKET_ROWS = 4000
MOST_HEX = 4
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SEED = "fathom-mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n_source, target of each source of sizes(source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_source = everything.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("n_source", F.row_number().over(by_source) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("n_source") % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("most", (F.col("source_size") * most).cast("double")).withColumn("level", F.col("most") / F.col("weight"))
    order = everything.orderBy("level", "n_source")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("reach", (F.col("total") - before) / left)
    per = per.withColumn("common", F.max(F.when(F.col("level") >= F.col("reach"), F.col("reach"))).over(everything))
    return per.select("source", "source_size", "n_source", F.least("most", F.col("weight") * F.col("common")).alias("target"))


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    size = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN), F.lit(0))).cast("long")
    return docs.select(*keep, "doc_id", "source", size.alias("size"), key.alias("u"))


def plan_mix(sized: DataFrame) -> DataFrame:
    """sized(doc_id, source, size, u, ...) with row (a number of its own), source_size, n_source, target, start, whole (copies) and extra (words of the copy that is cut), taken."""
    tables = Tables(sized.sparkSession)
    sized = tables.cut(sized.withColumn("row", F.monotonically_increasing_id()))
    count, digits = sized.count(), 1
    while digits < MOST_HEX and count > BUCKET_ROWS * 16**digits:
        digits += 1
    sized = sized.withColumn("g", F.substring("u", 1, digits))
    targets = tables.cut(source_targets(sized.groupBy("source", "g").agg(F.sum("size").alias("size"))), 1)
    buckets = sized.groupBy("source", "g").agg(F.sum("size").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("ahead", ahead).drop("n").join(targets.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    right = buckets.select(F.col("source").alias("s_"), F.col("g").alias("g_"), "ahead", "source_size", "n_source", "target")
    at = sized.join(right, F.col("source").eqNullSafe(F.col("s_")) & (F.col("g") == F.col("g_"))).drop("s_", "g_")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "g").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("start", F.col("ahead") + inside)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target")) - F.col("whole") * F.col("source_size")
    at = at.withColumn("whole", F.least(whole, F.lit(MOST_COPIES)))
    at = at.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest.cast("long") - F.col("start"))))
    return at.withColumn("taken", F.col("whole") * F.col("size") + F.col("extra")).drop("g", "ahead", "u")


def training_copies(at: DataFrame) -> DataFrame:
    """row, n_source, doc_id, c, t, words of every copy that the plan takes, range-sorted by training time t; the last one may be cut."""
    n = (F.col("whole") * F.when(F.col("size") > 0, 1).otherwise(0) + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    words = lambda c: F.when(c <= F.col("whole"), F.col("size")).otherwise(F.col("extra"))
    copies = F.transform(F.sequence(F.lit(1), n), lambda c: F.struct(c.alias("c"), _time(F.col("start") + (c - 1) * F.col("source_size")).alias("t"), words(c).alias("words")))
    made = at.where(n > 0).select("row", "n_source", "doc_id", F.explode(copies).alias("x")).select("row", "n_source", "doc_id", "x.c", "x.t", "x.words")
    return made.orderBy("t", "n_source", "doc_id", "c")


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_copies (the last one may be cut), and the times of the first and the last copy (null if none is taken).

    What is taken of a row is read off its copies in the sorted mix.
    """
    tables = Tables(docs.sparkSession)
    at = tables.cut(plan_mix(_sized(docs, [])))
    mix = tables.cut(training_copies(at))
    time = lambda t: F.round(t, 9) + F.lit(0.0)
    per = mix.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("n_copies"), time(F.min("t")).alias("first_time"), time(F.max("t")).alias("last_time"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return at.drop("taken").join(per, "row", "left").select("doc_id", "size", "source_size", "target", none("taken"), none("n_copies"), "first_time", "last_time")


def _time(q):
    """The time at which a source's cumulative demand reaches q words."""
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q / F.col("target")))).otherwise(F.lit(0.0))
    a = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("n_source") % len(SLOPES) + 1).cast("int"))
    root = F.sqrt((1 - a) * (1 - a) + 4 * a * share)
    return F.when(a == 0, share).otherwise((root - (1 - a)) / (2 * a))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, range-sorted by training time; columns as in docs.

    The copy that crosses a target's end is taken whole when at least half of it lies before the end. The plan is made on keys and sizes;
    texts meet it once, by a digest of the whole row, and are sorted once: rows with one digest are equal, so one of them stands for all of their plans.
    """
    names = docs.columns
    key, t, s, c = (fresh_name(n, names) for n in ("key_", "t_", "s_", "c_"))
    own = F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]))))
    at = plan_mix(_sized(docs.withColumn(key, own), [key]))
    copies = (F.col("whole") + F.when(F.col("extra") * 2 >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0)).cast("int")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(copies)  # texts without a word cost nothing and stay once
    times = F.transform(F.sequence(F.lit(1), copies), lambda n: F.struct(F.coalesce(_time(F.col("start") + (n - 1) * F.col("source_size")), F.lit(0.0)).alias("t"), n.alias("c")))
    plan = at.where(copies > 0).select(key, F.col("n_source").alias(s), F.explode(times).alias("x")).select(key, s, F.col("x.t").alias(t), F.col("x.c").alias(c))
    plan = Tables(docs.sparkSession).cut(plan)
    rows = docs.withColumn(key, own).dropDuplicates([key])
    return salted_join(plan, rows, key, t).orderBy(t, s, "doc_id", c).select(*[F.col(f"`{n}`") for n in names])


def oracle() -> str:
    """DuckDB SQL for mix_digest of documents."""
    weights, slopes = f"[{', '.join(map(str, WEIGHTS))}]", f"[{', '.join(map(str, SLOPES))}]"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD_PATTERN}')) AS BIGINT) AS size,
  md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT *, {weights}[n % {len(WEIGHTS)} + 1]::DOUBLE AS weight, ({MOST_COPIES} * source_size)::DOUBLE AS most FROM s),
l AS (SELECT *, most / weight AS level, sum(source_size) OVER () AS total FROM w),
r AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY level, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY level, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM l),
t AS (SELECT source, source_size, n, least(most, weight * (SELECT max(reach) FROM r WHERE level >= reach)) AS target FROM r),
p AS (SELECT d.*, source_size, target, n, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, {MOST_COPIES})::BIGINT AS whole FROM p),
y AS (SELECT *, whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - start)) AS taken,
  whole * (size > 0)::BIGINT + (greatest(0, least(size, floor(target)::BIGINT - whole * source_size - start)) > 0)::BIGINT AS n_copies, {slopes}[n % {len(SLOPES)} + 1]::DOUBLE AS a FROM x)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken, n_copies, {_sql_time('start')} AS first_time, {_sql_time('(start + (n_copies - 1) * source_size)')} AS last_time
FROM y"""


def _sql_time(start: str) -> str:
    q = f"least(1.0, {start} / target)"
    return f"CASE WHEN taken > 0 THEN round(CASE WHEN a = 0 THEN {q} ELSE (sqrt((1 - a) * (1 - a) + 4 * a * {q}) - (1 - a)) / (2 * a) END, 9) + 0.0 END"
