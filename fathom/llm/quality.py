r"""Quality rules, line first: lines that fail a rule are removed, documents that lose too much are rejected.

Per line with a word (lines are cut at \n), each rule is one regular expression or length test:

* punctuation: it ends in no sentence mark and has at most ``SHORT_WORDS`` words' worth of spaces;
* symbols: runs of markup symbols hang on its words, or it has no letter;
* navigation: it is a row of short cells between bars, bullets or arrows;
* boilerplate: it names cookies, scripts, log-ins, sharing or the like and is short.

A document is kept when it passes the base rules and the lines left hold at least ``KEEP_SHARE`` of
its characters. Everything is a Column expression: one scan, no shuffle, no Python.

Defined results: a null text has no words, 0 everywhere, and fails the base rules. Repeated rows give
repeated results; lines that tie with an earlier one count as its duplicates. An empty table gives an empty result. Other columns are ignored,
whatever their names; ``clean_lines`` lengthens its own names where they clash. Word windows are compared by their 64-bit hash within one text;
no pattern goes back over what it has read, so work per text is n log n and memory linear, also for one line of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SHORT_WORDS = 4
KEEP_SHARE = 0.5

# Fixed patterns of the line rules; they read alike in Java's and RE2's syntax.
ENDS_WELL = r"""[.!?:;…。！？"'”’»)\]][ \t\r]*$"""
LONG_LINE = rf"([^ ]+ +){{{SHORT_WORDS}}}[^ ]"
#: The same for an engine that backtracks: anchored, and nothing taken is given back.
LONG_LINE_ONCE = rf"^ *+(?:[^ ]++ ++){{{SHORT_WORDS}}}[^ ]"
HAS_LETTER = r"\p{L}"
HUNG_SYMBOLS = r"[#*$%&|<>]{3}"
CELL_BARS = r"[|»›•·>]"
MANY_SYMBOLS = 3
MANY_BARS = 3
CELL_CHARS = 40
BOILERPLATE = (
    r"(?i)(accept (all )?cookies|uses? cookies|cookie policy|enable javascript|terms of (use|service)|privacy policy|sign (in|up)|log ?in|subscribe|newsletter|share (this|on)|click here|read more|skip to|back to top|copyright ©|all rights reserved"
    r"|cookies (akzeptieren|zulassen)|verwendet cookies|datenschutz(erklärung)?|nutzungsbedingungen|impressum|anmelden|abonnieren|mehr lesen|weiterlesen|nach oben|alle rechte vorbehalten"
    r"|accepter les cookies|utilise des cookies|politique de confidentialité|mentions légales|se connecter|s'abonner|lire la suite|cliquez ici|haut de page|tous droits réservés"
    r"|aceptar (las )?cookies|utiliza cookies|política de privacidad|aviso legal|iniciar sesión|suscríbete|leer más|haga clic|volver arriba|todos los derechos reservados)"
)
BOILERPLATE_CHARS = 160

_WINDOWS = f"CASE WHEN size(w) >= {WINDOW} THEN transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) ELSE CAST(array() AS array<bigint>) END"
# positions of windows that have an equal one, by sorting (hash, position) and looking at both neighbours
_SORTED = "sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))"
_AGAIN = "sort_array(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k + 1 < size(s) AND s[k + 1].x = e.x)), e -> e.i))"
_COVERED = f"CASE WHEN size(p) = 0 THEN 0L ELSE aggregate(transform(p, (x, k) -> CASE WHEN k + 1 < size(p) THEN least({WINDOW}, p[k + 1] - x) ELSE {WINDOW} END), 0L, (a, b) -> a + b) END"


def line_passes(line: Column) -> Column:
    """Whether a line passes every rule."""
    hit = lambda pattern: F.rlike(line, F.lit(pattern))
    bars = F.length(line) - F.length(F.regexp_replace(line, CELL_BARS, ""))
    hung = F.length(line) - F.length(F.regexp_replace(line, HUNG_SYMBOLS, ""))
    return (hit(ENDS_WELL) | hit(LONG_LINE_ONCE)) & hit(HAS_LETTER) & (hung < 3 * MANY_SYMBOLS) & ~((bars >= MANY_BARS) & (F.length(line) <= CELL_CHARS * (bars + 1))) & ~((F.length(line) <= BOILERPLATE_CHARS) & hit(BOILERPLATE))


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with clean_text (lines that pass, joined) and clean_share (of the characters of lines with a word)."""
    taken = docs.columns
    kept, share = fresh_name("clean_text", taken), fresh_name("clean_share", taken)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(rf"[^{SPACE}]")))
    at = docs.withColumn(fresh_name("_l", taken), lines)
    lc = F.col(fresh_name("_l", taken))
    at = at.withColumn(kept, F.array_join(F.filter(lc, line_passes), "\n"))
    total = F.length(F.array_join(lc, "\n"))
    return at.withColumn(share, F.when(total > 0, F.length(F.col(kept)) / total).otherwise(F.lit(0.0))).drop(fresh_name("_l", taken))


def quality_verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, the base measures, base_failed, kept and clean_share of every row; map-only."""
    at = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    at = at.select("doc_id", "t", F.expr(f"regexp_extract_all(t, '{WORD.replace(chr(92), chr(92) * 2)}', 0)").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit(rf"[^{SPACE}]"))).alias("l"))
    at = at.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(_WINDOWS).alias("h"),
        F.length(F.array_join("l", "\n")).alias("all_chars"),
        F.length(F.array_join(F.filter("l", line_passes), "\n")).alias("good_chars"),
    )
    # the sort is only for texts in which some window comes twice
    at = at.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr(_SORTED)).otherwise(F.expr("CAST(array() AS array<struct<x: bigint, i: int>>)")))
    at = at.withColumn("p", F.expr(_AGAIN)).withColumn("n_repeat_words", F.expr(_COVERED).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return at.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("good_chars") >= KEEP_SHARE * F.col("all_chars"))).alias("kept"),
        F.when(F.col("all_chars") > 0, F.round(F.col("good_chars") / F.col("all_chars"), 9)).otherwise(F.lit(0.0)).alias("clean_share"),
    )


def oracle() -> str:
    """DuckDB SQL for quality_verdicts of documents."""
    q = lambda s: s.replace("'", "''")
    word, sp = q(WORD), q(f"[^{SPACE}]")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{sp}')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM a WHERE len(w) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM rep) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  length(array_to_string(l, chr(10))) AS all_chars,
  coalesce(length(array_to_string(list_filter(l, lambda x: (regexp_matches(x, '{q(ENDS_WELL)}') OR regexp_matches(x, '{q(LONG_LINE)}')) AND regexp_matches(x, '{q(HAS_LETTER)}')
    AND length(x) - length(regexp_replace(x, '{HUNG_SYMBOLS}', '', 'g')) < {3 * MANY_SYMBOLS}
    AND NOT (length(x) - length(regexp_replace(x, '{CELL_BARS}', '', 'g')) >= {MANY_BARS} AND length(x) <= {CELL_CHARS} * (length(x) - length(regexp_replace(x, '{CELL_BARS}', '', 'g')) + 1))
    AND NOT (length(x) <= {BOILERPLATE_CHARS} AND regexp_matches(x, '{q(BOILERPLATE)}'))), chr(10))), 0) AS good_chars
  FROM a LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND good_chars >= {KEEP_SHARE} * all_chars AS kept,
  CASE WHEN all_chars > 0 THEN round(good_chars::DOUBLE / all_chars, 9) ELSE 0.0::DOUBLE END AS clean_share
FROM m"""
