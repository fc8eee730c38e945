"""Snippets and highlighting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkerConfig

SNIPPET_CHARS = 250
# Fixed value: characters stripped from a word before it is compared.
STRIP = "`´.,!?;\"'()"


def _words(text: str) -> str:
    return f"filter(split({text}, '[\\\\s]+'), w -> w != '')"


def snippets(rows: DataFrame, cfg: ChunkerConfig = ChunkerConfig(), text: str = "text", query: str = "query") -> DataFrame:
    """rows with snippet: the window of words with most query words.

    n = 250 // (2 * whole mean word length) words a window, n - overlap apart. Windows are compared by distinct hits, coverage and
    hits; the first of the best is taken. Words are compared as they stand, in lower case. Without a query: the first n words.
    """
    if not cfg.enable:
        return rows.withColumn("snippet", F.col(text))
    at = rows.withColumn("_w", F.expr(_words(f"coalesce({text}, '')"))).withColumn("_q", F.expr(f"array_distinct({_words(f'lower(coalesce({query}, {chr(39) * 2}))')})"))
    at = at.withColumn("_n", F.expr(f"CASE WHEN size(_w) > 0 THEN greatest(1, cast({SNIPPET_CHARS} div (2 * greatest(1, length(array_join(_w, '')) div size(_w))) as int)) ELSE 1 END"))
    at = at.withColumn("_s", F.expr(f"greatest(1, _n - {cfg.overlap})"))
    # each word's place in the query, once; a window then counts numbers
    at = at.withColumn("_h", F.expr("transform(_w, w -> array_position(_q, lower(w)))"))
    best = """array_max(transform(sequence(0, greatest(0, size(_w) - 1), _s), a -> transform(array(slice(_h, a + 1, _n)), s -> transform(array(filter(s, x -> x > 0)), f -> struct(
        size(array_distinct(f)) AS u, size(f) / size(s) AS c, size(f) AS t, -a AS b))[0])[0]))"""
    at = at.withColumn("_b", F.expr(f"CASE WHEN size(_w) > 0 AND size(_q) > 0 THEN {best} END"))
    shown = F.when(F.size("_w") == 0, F.lit("")).when(F.size("_q") == 0, F.expr("lower(array_join(slice(_w, 1, _n), ' '))")).otherwise(F.expr("concat('...', array_join(slice(_w, 1 - _b.b, _n), ' '), '...')"))
    return at.withColumn("snippet", shown).drop("_w", "_q", "_n", "_s", "_h", "_b")


def highlight(text: Column, query: Column) -> Column:
    """text with ** around words that, stripped and in lower case, are words of the query."""
    bare = "".join(f"\\{c}" for c in STRIP)
    q = F.split(F.lower(query), r"\s+")
    hit = lambda w: F.array_contains(q, F.regexp_replace(F.lower(w), f"^[{bare}]+|[{bare}]+$", ""))
    return F.array_join(F.transform(F.split(text, r"\s+"), lambda w: F.when((w != "") & hit(w), F.concat(F.lit("**"), w, F.lit("**"))).otherwise(w)), " ")


def render(rank: Column, title: Column, link: Column, score: Column, content: Column) -> Column:
    """A result in Markdown."""
    return F.format_string("%d. [%s](%s) (score %.2f)\n%s", rank, title, link, score, content)
