"""The analyzer as Column expressions: a token array from a text column, JVM-side throughout."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import AnalyzerConfig

TOKEN = "[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"

# English stopwords.
STOPWORDS = (
    "a about again all am an and any are as at be because both but by can cannot could did do does doing done down each else few for from further "
    "he her here hers him his how i if in into is it its just me mine more most my no not of on once only or other our ours over own same she should so some such than "
    "that the their theirs them then there these they this those to too under up very was we were what when which who whom why will with would yes you your yours"
).split()

# Suffixes in order of trial.
SUFFIXES = ("ing", "edly", "ed", "ly", "es", "s")


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and their plain forms, from Unicode's decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c.isascii())
        if len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def ascii_fold(text: Column) -> Column:
    return F.translate(text, *_fold_table())


def number_normalize(text: Column) -> Column:
    """Drops commas between digits."""
    return F.regexp_replace(text, r"(?<=\d),(?=\d)", "")


def stem(token: Column) -> Column:
    """Strips the first suffix that matches, once, from tokens of more than three letters."""
    out = F.when(F.length(token) <= 3, token)
    for s in SUFFIXES:
        out = out.when(F.endswith(token, F.lit(s)), F.left(token, F.length(token) - len(s)))
    return out.otherwise(token)


def tokens(text: Column, cfg: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """Tokens of a text, in order; null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    if cfg.ascii_fold:
        t = ascii_fold(t)
    if cfg.number_normalize:
        t = number_normalize(t)
    if cfg.lowercase:
        t = F.lower(t)
    out = F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    if cfg.stem:
        out = F.transform(out, stem)
    if cfg.remove_stopwords:
        return F.filter(out, lambda x: (F.length(x) >= cfg.min_len) & ~x.isin(STOPWORDS))
    return F.filter(out, lambda x: F.length(x) >= cfg.min_len)
