r"""Format-preserving pseudonyms: private values become keyed permutations of themselves, within their format.

Found are e-mail addresses, long hexadecimal secrets, IPv4 and IPv6 addresses, IBANs (also with letters and blanks), phone numbers (with separators,
international, and ten plain digits of which the first is 2 to 9), social security numbers,
dates (ISO, day first, and month first where the day tells), and card or account numbers of 13 to 19 digits. Numbers and dates are validated
(octets, IBAN remainder, Luhn digit, first digit, calendar) and permuted by an eight-round Feistel network on Z_a x Z_b, the mixed-radix halves of the
format's own domain. A value never leaves its class of validity: where the check digits tell it, they are worked out anew; elsewhere the
permutation walks its cycle until it is back in the class (valid or not). So two values of a format never share a pseudonym, a valid card stays
a valid card, and who holds the key can undo it; layout characters stay where they were. The round function is a keyed SHA-256, and nothing but the
key, the kind and the value enters, so equal values stay linked across documents, a phone number or date also across layouts. E-mail addresses and
secrets are replaced by keyed digests in their format.

Everything is SQL: one scan, no shuffle, no Python. Texts without a digit, a colon or an at sign aren't searched.

Defined results: a null text stays null with 0 found, an empty text stays empty; what looks like a value but fails a validation without a class of its own (a date that isn't
in the calendar, letters in an IBAN with a wrong remainder) is none and stays. Repeated rows get equal results; an empty table gives an empty result; matches are worked off one by
one, so very long texts need memory in proportion to their length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
WALK = 48  # steps of a cycle walk at most; classes hold at least two fifths of their domain, so all but one in 10^10 values end far sooner
_A, _Z = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_GROUP = "[0-9A-Fa-f]{1,4}"

_AMERICAN = rf"{_A}(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_Z}"

# Fixed patterns, in order of precedence.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": rf"{_A}[0-9a-fA-F]{{32,}}{_Z}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])",
    "iban": rf"{_A}[A-Z]{{2}}[0-9]{{2}}(?:[0-9A-Z]{{11,30}}|(?: [0-9A-Z]{{4}}){{2,7}}(?: [0-9A-Z]{{1,4}})?){_Z}",
    "phone": _AMERICAN + rf"|(?<![0-9A-Za-z+])\+[0-9]{{1,3}}(?:[ .-]?\(?[0-9]{{2,4}}\)?){{2,4}}{_Z}|{_A}[2-9][0-9]{{9}}{_Z}",
    "ssn": r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])",
    "date": r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9]([./])[01][0-9]\1(?:19|20)[0-9]{2}|[01][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-])",
    "number": rf"{_A}(?:[0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}\2[0-9]{{4}}\2[0-9]{{1,7}}){_Z}",
}
FIRST_DAY, DAYS = "1900-01-01", 73049  # through 2099
DAY_A, DAY_B = 271, 270


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(kind: str, key: str, a: str, b: str, left: str, right: str) -> str:
    """SQL struct (l, r) of a permuted pair in Z_a x Z_b; all arguments but the key are SQL, kind of a string, the others of bigint."""
    f = lambda half: f"cast(conv(substring(sha2(concat_ws(':', {_sql(key)}, {kind}, k, {a}, {b}, {half}), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, k) -> CASE WHEN k % 2 = 0 "
        f"THEN named_struct('l', pmod(s.l + pmod({f('s.r')}, {a}), {a}), 'r', s.r) ELSE named_struct('l', s.l, 'r', pmod(s.r + pmod({f('s.l')}, {b}), {b})) END)"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL that names a value within a body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _digits(kind: str, key: str, d: str) -> str:
    """SQL: a string of up to 36 digits permuted among the strings of its length."""
    n = f"length({d})"
    lo = f"cast({n} / 2 as int)"
    power = lambda e: f"cast(rpad('1', {e} + 1, '0') as bigint)"
    pair = _feistel(_sql(kind), key, power(lo), power(f"({n} - {lo})"), f"substring({d}, 1, {lo})", f"substring({d}, {lo} + 1)")
    return _let(pair, "q", f"concat(lpad(cast(q.l as string), {lo}, '0'), lpad(cast(q.r as string), {n} - {lo}, '0'))")


def _number_of(s: str, base: int) -> str:
    """SQL: value of a string of letters (base 26) or hexadecimal digits (base 16)."""
    if base == 16:
        return f"coalesce(cast(conv({s}, 16, 10) as bigint), 0L)"
    return f"aggregate(split({s}, ''), 0L, (t, c) -> t * 26 + CASE WHEN c = '' THEN 0 ELSE ascii(c) - 65 END)"


def _string_of(v: str, n: str, base: int) -> str:
    """SQL: a value as n letters or hexadecimal digits."""
    if base == 16:
        return f"CASE WHEN {n} = 0 THEN '' ELSE lpad(lower(hex({v})), {n}, '0') END"
    return f"CASE WHEN {n} = 0 THEN '' ELSE aggregate(sequence(1, {n}), named_struct('v', {v}, 't', ''), (t, k) -> named_struct('v', cast(floor(t.v / 26) as bigint), 't', concat(chr(65 + t.v % 26), t.t)), t -> t.t) END"


def _halves(kind: str, key: str, s: str, base: int, tweak: str) -> str:
    """SQL: a string of letters or of hexadecimal digits (26 or 16 at most) permuted among those of its length, by a network of its own for each tweak."""
    n = f"length({s})"
    lo = f"cast({n} / 2 as int)"
    power = lambda e: f"cast(pow({base}, {e}) as bigint)"
    pair = _feistel(f"concat({_sql(kind + '/')}, {tweak})", key, power(lo), power(f"({n} - {lo})"), _number_of(f"substring({s}, 1, {lo})", base), _number_of(f"substring({s}, {lo} + 1)", base))
    return _let(pair, "h", f"concat({_string_of('h.l', lo, base)}, {_string_of('h.r', f'({n} - {lo})', base)})")


def _hex(kind: str, key: str, s: str) -> str:
    """SQL: up to 32 hexadecimal digits permuted among the strings of their length: either half by a network that the other one picks, three times."""
    lo = f"cast(length({s}) / 2 as int)"
    turn = lambda n, this, other: _halves(f"{kind}{n}", key, this, 16, other)
    return _let(f"substring({s}, 1, {lo})", "a", _let(f"substring({s}, {lo} + 1)", "b", _let(turn(1, "b", "a"), "b1", _let(turn(2, "a", "b1"), "a1", f"concat(a1, {turn(3, 'b1', 'a1')})"))))


def _walk(start: str, step: str, inside: str) -> str:
    """SQL: step taken from start until the value is inside; step and inside are of x."""
    return f"aggregate(sequence(1, {WALK}), named_struct('x', {start}, 'done', false), (s, w) -> CASE WHEN s.done THEN s ELSE {_let('s.x', 'x', _let(step, 'x', f'named_struct({chr(39)}x{chr(39)}, x, {chr(39)}done{chr(39)}, {inside})'))} END, s -> s.x)"


def _luhn_sum(d: str, shift: int) -> str:
    """SQL: Luhn sum of digits; shift 0 if the last digit is the check digit, 1 if it is left out."""
    return f"aggregate(sequence(1, length({d})), 0, (t, k) -> t + {_let(f'cast(substring({d}, length({d}) + 1 - k, 1) as int) * CASE WHEN (k + {shift}) % 2 = 0 THEN 2 ELSE 1 END', 'v', 'CASE WHEN v > 9 THEN v - 9 ELSE v END')})"


def _fill(text: str, digits: str) -> str:
    """SQL: text with its last length(digits) digits replaced, in order."""
    c = f"substring({text}, length({text}) + 1 - k, 1)"
    return (
        f"aggregate(sequence(1, length({text})), named_struct('t', '', 'k', length({digits})), (s, k) -> CASE WHEN {c} BETWEEN '0' AND '9' AND s.k > 0 "
        f"THEN named_struct('t', concat(substring({digits}, s.k, 1), s.t), 'k', s.k - 1) ELSE named_struct('t', concat({c}, s.t), 'k', s.k) END, s -> s.t)"
    )


def _only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(text: str, made: str, kind: str) -> str:
    """SQL: text with its characters of a kind (a class of a regular expression) replaced in order by those of a string of as many."""
    c = f"substring({text}, k, 1)"
    return (
        f"aggregate(sequence(1, length({text})), named_struct('t', '', 'k', 1), (s, k) -> CASE WHEN rlike({c}, '{kind}') "
        f"THEN named_struct('t', concat(s.t, substring({made}, s.k, 1)), 'k', s.k + 1) ELSE named_struct('t', concat(s.t, {c}), 'k', s.k) END, s -> s.t)"
    )


def _mod97(d: str) -> str:
    """SQL: remainder of digits and letters, which count from 10 on."""
    return f"aggregate(split({d}, ''), 0, (t, c) -> CASE WHEN c = '' THEN t WHEN c BETWEEN 'A' AND 'Z' THEN (t * 100 + ascii(c) - 55) % 97 ELSE (t * 10 + cast(c as int)) % 97 END)"


def _iban_valid(v: str) -> str:
    """SQL: whether an IBAN without blanks has the right remainder, by check digits that are given out (02 to 98)."""
    return f"({_mod97(f'concat(substring({v}, 5), substring({v}, 1, 4))')} = 1 AND substring({v}, 3, 2) BETWEEN '02' AND '98')"


def _iban(m: str, key: str) -> str:
    bare = f"regexp_replace({m}, ' ', '')"
    # digits first, then letters by a network that the new digits pick
    letters = _halves("iban letters", key, "l", 26, "n")
    account = _let("regexp_replace(substring(v, 5), '[^0-9]', '')", "d", _let("regexp_replace(substring(v, 5), '[0-9]', '')", "l", _let(f"CASE WHEN d = '' THEN '' ELSE {_digits('iban', key, 'd')} END", "n", _let(f"CASE WHEN l = '' OR length(l) > 26 THEN l ELSE {letters} END", "y", _refill(_refill("substring(v, 5)", "n", "[0-9]"), "y", "[A-Z]")))))
    valid = _let(account, "b", f"concat(substring(v, 1, 2), lpad(cast(98 - {_mod97('concat(b, substring(v, 1, 2), chr(48), chr(48))')} as string), 2, '0'), b)")
    wrong = _walk("substring(v, 3)", _digits("iban wrong", key, "x"), f"NOT {_iban_valid('concat(substring(v, 1, 2), x)')}")
    made = f"CASE WHEN {_iban_valid('v')} THEN {valid} WHEN rlike(v, '^[A-Z]{{2}}[0-9]+$') AND {m} = v THEN concat(substring(v, 1, 2), {wrong}) END"
    return _let(bare, "v", _let(made, "z", f"CASE WHEN z IS NOT NULL THEN {_refill(m, 'z', '[0-9A-Z]')} END"))


def _phone(m: str, key: str) -> str:
    american = _let("right(d, 10)", "o", _let(_walk("o", _digits("phone", key, "x"), "(x >= '2') = (o >= '2')"), "n", _fill(m, "n")))
    # the country is the digits behind the plus sign up to a separator, or two
    country = f"CASE WHEN rlike({m}, '^[+][0-9]{{1,3}}[ .(-]') THEN length(regexp_extract({m}, '^[+]([0-9]+)', 1)) ELSE 2 END"
    abroad = _let(f"substring(d, 1 + {country})", "o", _let(_digits("phone abroad", key, "o"), "n", _fill(m, "n")))
    return _let(_only_digits(m), "d", f"CASE WHEN rlike({m}, {_sql('^(?:' + _AMERICAN + ')$')}) OR length({m}) = 10 THEN {american} ELSE {abroad} END")


def _date(m: str, key: str) -> str:
    q = lambda s: f"'{s}'"
    since = lambda d: f"datediff({d}, date'{FIRST_DAY}')"
    iso = f"{m} LIKE '____-__-__'"
    day_first = since(f"try_to_date(regexp_replace({m}, '/', '.'), 'dd.MM.yyyy')")
    month_first = since(f"try_to_date({m}, 'MM/dd/yyyy')")
    plain = f"CASE WHEN {iso} THEN {since(f'try_to_date({m}, {q("yyyy-MM-dd")})')} ELSE {day_first} END"
    step = _let(_feistel(_sql("date"), key, f"{DAY_A}L", f"{DAY_B}L", f"cast(floor(x / {DAY_B}) as bigint)", f"x % {DAY_B}"), "q", f"q.l * {DAY_B} + q.r")
    on = lambda n: f"date_add(date'{FIRST_DAY}', cast({n} as int))"
    shown = f"CASE WHEN {iso} THEN date_format({on('nd')}, 'yyyy-MM-dd') ELSE date_format({on('nd')}, concat('dd', substring({m}, 3, 1), 'MM', substring({m}, 3, 1), 'yyyy')) END"
    first = _let(_walk("cast(dd as bigint)", step, f"x < {DAYS}"), "nd", shown)
    # the month comes first only where the day is above 12, and has to stay so
    turned = _let(_walk("cast(md as bigint)", step, f"x < {DAYS} AND day({on('x')}) > 12"), "nd", f"date_format({on('nd')}, 'MM/dd/yyyy')")
    return _let(plain, "dd", _let(month_first, "md", f"CASE WHEN dd IS NOT NULL THEN {first} WHEN md IS NOT NULL AND {m} LIKE '__/__/____' THEN {turned} END"))


def _pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of a matched value, null if it fails its validation."""
    digest = lambda kind, v: f"sha2(concat_ws(':', {_sql(key)}, '{kind}', {v}), 256)"
    email = _let(digest("email", f"lower({m})"), "h", "concat('u', substring(h, 1, 10), '@', substring(h, 11, 8), '.example')")
    secret = _let(f"substring(repeat({digest('secret', f'lower({m})')}, cast(ceil(length({m}) / 64) as int)), 1, length({m}))", "h", f"CASE WHEN {m} = upper({m}) THEN upper(h) ELSE h END")
    octets = _let(f"split({m}, '\\\\.')", "o", _let(_feistel(_sql("ip"), key, "65536L", "65536L", "cast(o[0] as bigint) * 256 + cast(o[1] as bigint)", "cast(o[2] as bigint) * 256 + cast(o[3] as bigint)"), "q", "concat_ws('.', cast(q.l / 256 as int), q.l % 256, cast(q.r / 256 as int), q.r % 256)"))
    groups = _let(f"lower(regexp_replace({m}, ':', ''))", "d", f"CASE WHEN length(d) >= 4 AND rlike(d, '[0-9]') THEN {_let(_hex('ipv6', key, 'd'), 'n', _let(_refill(m, 'n', '[0-9A-Fa-f]'), 'z', f'CASE WHEN {m} = upper({m}) THEN upper(z) ELSE z END'))} END")
    area = f"cast(substring({m}, 1, 3) as bigint)"
    ssn = _let(
        _feistel(_sql("ssn"), key, "898L", "989901L", f"CASE WHEN {area} > 666 THEN {area} - 2 ELSE {area} - 1 END", f"(cast(substring({m}, 5, 2) as bigint) - 1) * 9999 + cast(substring({m}, 8, 4) as bigint) - 1"),
        "q",
        "concat_ws('-', lpad(cast(CASE WHEN q.l + 1 >= 666 THEN q.l + 2 ELSE q.l + 1 END as string), 3, '0'), lpad(cast(cast(q.r / 9999 as int) + 1 as string), 2, '0'), lpad(cast(q.r % 9999 + 1 as string), 4, '0'))",
    )
    card = _let(_digits("card", key, "substring(d, 1, length(d) - 1)"), "n", f"concat(n, cast((10 - {_luhn_sum('n', 1)} % 10) % 10 as string))")
    plain = _walk("d", _digits("number", key, "x"), f"{_luhn_sum('x', 0)} % 10 != 0")
    number = _let(_only_digits(m), "d", _let(f"CASE WHEN {_luhn_sum('d', 0)} % 10 = 0 THEN {card} ELSE {plain} END", "n", _fill(m, "n")))
    made = {"email": email, "secret": secret, "ip": octets, "ipv6": groups, "iban": _iban(m, key), "phone": _phone(m, key), "ssn": ssn, "date": _date(m, key), "number": number}
    return "CASE " + " ".join(f"WHEN kind = '{k}' THEN {made[k]}" for k in PATTERNS) + " END"


def _kind(m: str) -> str:
    whole = {k: p.replace(r"\2", r"\1") if k == "number" else p for k, p in PATTERNS.items()}
    return "CASE " + " ".join(f"WHEN rlike({m}, {_sql('^(?:' + whole[k] + ')$')}) THEN '{k}'" for k in PATTERNS) + " END"


def pseudonymize(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_found, kinds (sorted, comma-joined), text with every private value replaced; map-only. The key is the owner's secret."""
    if not key:
        raise ValueError("pseudonyms need a key")
    pattern = "|".join(PATTERNS.values())
    at = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    search = F.rlike("t", F.lit("[0-9@:]"))
    at = at.withColumn("m", F.when(search, F.regexp_extract_all("t", F.lit(pattern), F.lit(0))))
    at = at.withColumn("m", F.coalesce("m", F.expr("CAST(array() AS array<string>)")))
    value = _let(_kind("x"), "kind", _let(_pseudonym("x", key), "p", "named_struct('k', CASE WHEN p IS NOT NULL THEN kind END, 'p', coalesce(p, x))"))
    at = at.withColumn("v", F.expr(f"transform(m, x -> {value})"))
    gaps = F.split("t", pattern, -1)
    # gaps and pseudonyms in turn; there is one gap more
    filled = F.array_join(F.zip_with(gaps, F.col("v.p"), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    found = F.array_compact("v.k")
    return at.select("doc_id", F.size(found).cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("kinds"), F.when(F.size("m") > 0, filled).otherwise(F.col("t")).alias("text"))


def permute(kind: str, key: str, a: int, b: int, left: int, right: int, undo: bool = False) -> tuple[int, int]:
    """The Feistel network on one value, outside SQL: for tests, and to undo pseudonyms with the key."""
    for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
        half, n = (right, a) if k % 2 == 0 else (left, b)
        f = int(hashlib.sha256(":".join(map(str, (key, kind, k, a, b, half))).encode()).hexdigest()[:15], 16) % n
        if k % 2 == 0:
            left = (left - f if undo else left + f) % a
        else:
            right = (right - f if undo else right + f) % b
    return left, right
