r"""License scans: ordered signature rules behind a keyword gate, with suppression of contained detections.

A text is lower-cased in A-Z and cut into words ([0-9a-z] and everything beyond ASCII); rules are regular
expressions over the words joined by single blanks. Only texts whose words hold a keyword that some rule's or base phrase's
matches hold are scanned, and a rule is tried only where its own keyword occurs. All rules' detections are then swept in order of start,
the longer first: one that lies within a detection of the same or better priority is suppressed (an
"apache" name inside "licensed under the apache license version 2 0"). Labels of the surviving detections join
those of the base phrases, which always stay.

Everything is a Column expression: one scan, no shuffle, no Python. Work per text is linear in its length times
the rules whose keyword it holds, plus n log n in its detections.

Defined results: null is read as empty (0 words, no label, score 0), as is a text without a word; repeated rows give repeated results; an empty table gives an
empty result; detections that tie in place and length are worked off in order of priority, then label; very long texts need memory in proportion to
their length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, keyword that every match of the name holds, name as a regular expression over words.
NAMES = [
    ("apache-2.0", "apache", r"apache( software)?( licen[sc]e)?( version)? 2( 0)?"),
    ("apache-1.1", "apache", r"apache( software)?( licen[sc]e)?( version)? 1 1"),
    ("apache", "apache", r"apache( software)?( licen[sc]e)?"),
    ("mit", "mit", r"mit( x11)?"),
    ("mit", "expat", r"expat( x11)?"),
    ("bsd-2-clause", "bsd", r"(simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    ("bsd-3-clause", "bsd", r"((new|modified|revised) bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    ("bsd-4-clause", "bsd", r"((original|old) bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    ("bsd", "bsd", r"bsd( style)?"),
    ("0bsd", "bsd", r"(bsd zero clause|zero clause bsd|0bsd)"),
    ("gpl-1.0", "gpl", r"gpl ?v?1( 0)?( only| or later)?"),
    ("gpl-2.0", "gpl", r"(gnu )?gpl ?(v|version )?2( 0)?( only| or later)?"),
    ("gpl-3.0", "gpl", r"(gnu )?gpl ?(v|version )?3( 0)?( only| or later)?"),
    ("gpl-2.0", "general public", r"(gnu )?general public licen[sc]e( version| v) ?2( 0)?"),
    ("gpl-3.0", "general public", r"(gnu )?general public licen[sc]e( version| v) ?3( 0)?"),
    ("lgpl-2.1", "lgpl", r"(gnu )?lgpl ?(v|version )?2 1( only| or later)?"),
    ("lgpl-3.0", "lgpl", r"(gnu )?lgpl ?(v|version )?3( 0)?( only| or later)?"),
    ("lgpl", "lesser general public", r"(gnu )?lesser general public"),
    ("agpl-3.0", "agpl", r"(gnu )?agpl ?(v|version )?3( 0)?( only| or later)?"),
    ("agpl", "affero general public", r"(gnu )?affero general public"),
    ("gfdl", "free documentation", r"(gnu )?free documentation"),
    ("mpl-1.1", "mozilla public", r"mozilla public( licen[sc]e)?( version)? 1 1"),
    ("mpl-2.0", "mozilla public", r"mozilla public( licen[sc]e)?( version)? 2( 0)?"),
    ("mpl", "mpl", r"mpl( 2 0| 1 1)?"),
    ("epl-1.0", "eclipse public", r"eclipse public( licen[sc]e)?( version| v)? ?1( 0)?"),
    ("epl-2.0", "eclipse public", r"eclipse public( licen[sc]e)?( version| v)? ?2( 0)?"),
    ("cddl", "common development and distribution", r"common development and distribution"),
    ("cpl", "common public", r"common public"),
    ("eupl", "european union public", r"european union public"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib( libpng)?"),
    ("boost", "boost software", r"boost software"),
    ("artistic-2.0", "artistic", r"artistic( licen[sc]e)? 2( 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("python", "python software foundation", r"python software foundation"),
    ("ruby", "ruby", r"ruby"),
    ("php", "php", r"php"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "do what the f", r"do what the f\S* you want to public"),
    ("ofl", "open font", r"(sil )?open font"),
    ("odbl", "open database", r"open database"),
    ("odc-by", "open data commons", r"open data commons attribution"),
    ("ms-pl", "microsoft public", r"microsoft public"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("afl", "academic free", r"academic free"),
    ("osl", "open software", r"open software"),
    ("cecill", "cecill", r"cecill( b| c)?( 2 1)?"),
    ("cc0", "cc0", r"cc0( 1 0)?( universal)?"),
    ("cc-by-sa", "attribution share", r"(creative commons )?attribution share ?alike( \d \d)?( international| unported)?"),
    ("cc-by-nc", "attribution non", r"(creative commons )?attribution non ?commercial( \d \d)?( international| unported)?"),
    ("cc-by-nd", "attribution no", r"(creative commons )?attribution no ?deriv\w*( \d \d)?( international| unported)?"),
    ("cc-by", "creative commons attribution", r"creative commons attribution( \d \d)?( international| unported)?"),
    ("creative-commons", "creative commons", r"creative commons"),
]
#: Ways in which a text invokes a named license, best first; each is a rule for every name.
INVOCATIONS = [
    r"(is |are |be )?(dual )?licen[sc]ed under (the |a )?(terms of )?(the )?{}( licen[sc]e)?",
    r"(distributed|released|available|published|provided|covered|governed) (under|by) (the |a )?(terms of )?(the )?{}( licen[sc]e)?",
    r"subject to (the )?(terms of )?(the )?{}( licen[sc]e)?",
    r"spdx licen[sc]e identifier {}",
    r"{}( public)? licen[sc]e(s)?",
]
#: Rules of their own: label, keyword, expression, priority (1 is best).
OWN = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 1),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software", 1),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms( with or without modification)?", 1),
    ("gpl", "free software", r"this (program|library) is free software you can redistribute it", 1),
    ("public-domain", "public domain", r"(released |dedicated |placed )?(in|into|to) the public domain", 2),
    ("warranty-disclaimer", "without warrant", r"without warrant(y|ies)( of any kind| or conditions of any kind)?", 3),
    ("warranty-disclaimer", "as is", r"provided (by the \w+ )?as is", 3),
    ("cc-by-sa", "cc by sa", r"cc by sa( \d \d)?", 1),
    ("cc-by-nc", "cc by nc", r"cc by nc( sa| nd)?( \d \d)?", 1),
    ("cc-by-nd", "cc by nd", r"cc by nd( \d \d)?", 1),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa( \d \d)?", 1),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc( sa| nd)?( \d \d)?", 1),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by( \d \d)?", 2),
    ("cc0", "creativecommons org", r"creativecommons org publicdomain zero( \d \d)?", 1),
    ("copyright", "copyright", r"copyright( c)?( \d{4})+( \d{4})*", 3),
    ("copyright", "copyright", r"copyright c", 4),
    ("reserved", "rights reserved", r"(all|some|no) rights reserved", 2),
    ("proprietary", "proprietary and confidential", r"proprietary and confidential", 2),
    ("proprietary", "may not be reproduced", r"may not be reproduced", 3),
    ("noai", "not be used for training", r"(may|must|shall) not be used for training", 2),
]
#: Words of which every match of an invocation holds one.
INVOKED = ("licen", " under ", " by ", "subject to ")


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, expression, label, priority) of every rule, in order."""
    out = [(key, rf"(?<= ){pattern}(?= )", label, prio) for label, key, pattern, prio in OWN]
    for k, how in enumerate(INVOCATIONS):
        out += [(key, rf"(?<= ){how.format(name)}(?= )", label, 1 + (k > 3)) for label, key, name in NAMES]
    return out


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _rules_sql() -> str:
    return "array(" + ", ".join(f"named_struct('k', {_literal(k)}, 'e', {_literal(e)}, 'l', {_literal(n)}, 'p', {p})" for k, e, n, p in rules()) + ")"


_NOTHING = "CAST(array() AS array<struct<s: int, z: int, p: int, l: string>>)"
# detections of one rule: matches m and the gaps g around them give each match's start s and, negated, end z
_SPANS = f"""flatten(transform(filter(rules, r -> contains(x, r.k)), r -> aggregate(
  regexp_extract_all(x, r.e, 0),
  named_struct('at', 0, 'k', 0, 'g', split(x, r.e, -1), 'out', {_NOTHING}),
  (a, m) -> named_struct('at', a.at + length(a.g[a.k]) + length(m), 'k', a.k + 1, 'g', a.g, 'out',
    concat(a.out, array(named_struct('s', a.at + length(a.g[a.k]), 'z', -(a.at + length(a.g[a.k]) + length(m)), 'p', r.p, 'l', r.l)))),
  a -> a.out)))"""
# sweep: furthest end so far by priority 1, 2, 3, 4; a detection within one of its own or a better priority is dropped
_SWEEP = """aggregate(sort_array(d), named_struct('a', 0, 'b', 0, 'c', 0, 'd', 0, 'n', 0L, 'l', CAST(array() AS array<string>)),
  (t, e) -> CASE WHEN -e.z <= t.a OR (e.p >= 2 AND -e.z <= t.b) OR (e.p >= 3 AND -e.z <= t.c) OR (e.p >= 4 AND -e.z <= t.d) THEN t
    ELSE named_struct('a', CASE WHEN e.p = 1 THEN greatest(t.a, -e.z) ELSE t.a END, 'b', CASE WHEN e.p = 2 THEN greatest(t.b, -e.z) ELSE t.b END,
      'c', CASE WHEN e.p = 3 THEN greatest(t.c, -e.z) ELSE t.c END, 'd', CASE WHEN e.p = 4 THEN greatest(t.d, -e.z) ELSE t.d END,
      'n', t.n + 1, 'l', array_union(t.l, array(e.l))) END)"""


def _places(phrase: str) -> str:
    words = phrase.split()
    test = " AND ".join(f"w[i + {k}] = {_literal(x)}" if k else f"w[i] = {_literal(x)}" for k, x in enumerate(words))
    return f"CASE WHEN contains(x, {_literal(' ' + phrase + ' ')}) THEN filter(sequence(0, size(w) - {len(words)}), i -> {test}) ELSE CAST(array() AS array<int>) END"


def _any_of(keys: Iterable[str]) -> Column:
    """Whether the words hold one of the keys."""
    return reduce(Column.__or__, [F.contains(F.col("x"), F.lit(key)) for key in keys])


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row; map-only."""
    at = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    at = at.select("doc_id", F.regexp_extract_all(F.translate("t", upper, upper.lower()), F.lit(WORD), F.lit(0)).alias("w"))
    at = at.select("doc_id", F.size("w").cast("long").alias("n_words"), "w", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("x"))
    own = _any_of([*BASE, *dict.fromkeys(key for _, key, _, _ in OWN)])
    gate = own | (_any_of(INVOKED) & _any_of(dict.fromkeys(key for _, key, _ in NAMES)))
    at = at.withColumn("w", F.when(gate, F.col("w")).otherwise(F.expr("CAST(array() AS array<string>)"))).withColumn("rules", F.expr(_rules_sql()))
    at = at.select("doc_id", "n_words", *[F.expr(_places(p)).alias(f"p{k}") for k, p in enumerate(BASE)], F.expr(f"CASE WHEN size(w) > 0 THEN {_SPANS} ELSE {_NOTHING} END").alias("d"))
    places = F.concat(*[F.col(f"p{k}") for k in range(len(BASE))])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(BASE.values())])))
    at = at.select("doc_id", "n_words", places.alias("places"), base.alias("base"), F.expr(_SWEEP).alias("found"))
    labels = F.array_sort(F.array_distinct(F.concat("base", "found.l")))
    return at.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (1 - F.pow(F.lit(0.5), F.least(F.size("places") + F.col("found.n"), F.lit(60)).cast("double"))).alias("score"),
        F.col("found.n").alias("n_detections"),
    )
