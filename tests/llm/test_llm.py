import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from fathom.llm import common, components, langid, licenses, linededup, mixing, neardup, pii, piece_codec, quality, spotsigs, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("n", "key", "size", "u", "rank", "seq", "node", "h", "t", "i", "row_", "kept_", "tkey_", "id_", "comp")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "ka lo mi tre van os ul pe ri".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Null ids, null, empty, blank, repeated and long texts, ties, null sources, and extra columns whose names clash."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    base = [(1, words(rng, 40), "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \n\t ", "de", "b"), (None, words(rng, 30), None, "a"), (5, long, "en", "c"), (6, long + " more", "en", "c"), (7, "one", "en", None), (7, "one", "en", None), (8, words(rng, 20), "en", "a"), (8, "other text", "fr", "a"), (9, "!!! ... ???", "en", "a")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in base], SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(7))
    return df


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def prose(rng, vocabulary, n):
    return " ".join(rng.choice(vocabulary) for _ in range(n)) + "."


# --- 1 -------------------------------------------------------------------------------------------


def toxic_rows(n=900, seed=2):
    rng = random.Random(seed)
    clean = [words(rng, 1) for _ in range(300)]
    insults = ["idiotka", "moronul", "scumbago", "trashvan"]
    out = []
    for i in range(n):
        t = prose(rng, clean, 40).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                t.insert(rng.randrange(len(t)), rng.choice(insults))
        out.append((i, " ".join(t), int(toxic)))
    return out


def test_toxicity_learns_and_tolerates_gaps(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    plain, gapped, spaced, clean = (model.margins([toxicity.unit(w)])[0] for w in ("idiotka", "i-d-i-o-t-k-a", "idiiotka", "kalomi"))
    assert plain > 0 and gapped == plain and spaced > clean
    prose = "kalo mi tre vanos ul pe ri losmi {} vantre osul pemi"
    odd = ["idiotka", "idxiotka", "idxioxtka", "ixdxioxtka", "mornonul", "mxorxonul", "scuxmbago", "scuxmxbago", "id iot ka", "i d i o t k a"]
    told = toxicity.Scorer(model).score([prose.format(w) for w in [*odd, "kalovan"]])
    assert (told[:-1] >= 0.5).all() and told[-1] < 0.5, dict(zip(odd, told.round(2), strict=False))
    worse = toxicity.Scorer(model).score([prose.format("idiotka"), prose.format("idiotka moronul")])
    assert worse[1] >= worse[0]
    assert "idiotka" in toxicity.tokens("you i d i o t k a you")
    assert max(toxicity.toxic_sentences("kalo mi. you idiotka! lo", model), key=lambda x: x[2])[:2] == (8, 21)
    assert toxicity.Scorer(model).score([rows[0][1]])[0] == pytest.approx(got[0].score)


def test_toxicity_sample_is_bounded_by_rows(spark):
    """Many texts of one id, labels that contradict, and one text many times."""
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.range(1000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, 500).collect()
    assert len(got) <= 500 and all(r.toxic == (r.text != "same") for r in got) and len({r.text for r in got}) == len(got)


def test_string_kernel_against_brute_force():
    def brute(a, b):
        from itertools import combinations

        ta, tb = defaultdict(float), defaultdict(float)
        for s, t in ((a, ta), (b, tb)):
            for i, j, k in combinations(range(len(s)), 3):
                t[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i + 1)
        return sum(v * tb[x] for x, v in ta.items())

    for a in ("abcab", "aaaa", "idiot", "abc"):
        assert toxicity.norms(toxicity._codes([a]))[0] ** 2 == pytest.approx(brute(a, a))
        v = toxicity.explicit("idiotic")
        assert float(v @ toxicity.explicit(a)) == pytest.approx(brute("idiotic", a) / np.sqrt(brute("idiotic", "idiotic") * brute(a, a)))


def test_toxicity_edges(spark, awkward, nothing):
    none = toxicity.train(awkward, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = toxicity.score_documents(awkward, none).collect()
    assert len(got) == 12 and {r.score for r in got} == {0.0}
    rows = toxic_rows(200)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    got = toxicity.score_documents(awkward, model).collect()
    assert len(got) == 12 and len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score_documents(nothing, model).count() == 0


# --- 2 -------------------------------------------------------------------------------------------


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b):
            row.append(max(old[j + 1], row[j], old[j] + 1 if x == y else 0))
    return row[-1]


def likeness_of_words(s, t):
    a, b = (WORD.findall(x.lower()) for x in (s, t))
    run = longest_common(a, b)
    return run / (len(a) + len(b) - run)


def test_neardup_against_brute_force(spark):
    """Classes equal those of all pairs, aligned by a table of all prefixes."""
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        base = words(rng, rng.randint(40, 90)).split(" ")
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = words(rng, 1)
            texts.append(" ".join(t))
    texts += ["a b", "a b", "a c", "", ""]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] and (texts[i] == texts[j] or likeness_of_words(texts[i], texts[j]) >= 0.8):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: root(i) for i in range(len(texts))}


def test_alignment_against_a_table(monkeypatch):
    rng = random.Random(1)
    for block in (4096, 3, 7):
        monkeypatch.setattr(neardup, "ALIGN_BLOCK", block)
        for _ in range(150):
            a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 40))] for _ in range(2))
            band = rng.randint(0, 45)
            row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    row[i + 1][j + 1] = max(row[i][j + 1], row[i + 1][j], row[i][j] + 1 if x == y and abs(i - j) <= band else 0)
            assert neardup.aligned(np.array(a, np.uint32), np.array(b, np.uint32), band) == row[-1][-1]


def test_one_word_in_ten_is_a_link():
    rng = random.Random(2)
    base = words(rng, 200).split(" ")
    near = [words(rng, 1) if i % 10 == 0 else w for i, w in enumerate(base)]
    far = [words(rng, 1) if i % 8 == 0 else w for i, w in enumerate(base)]
    (a, b, c), _ = neardup.labelled([" ".join(x) for x in (base, near, far)])
    assert neardup.similarity(a, b) >= 0.8 and neardup.similarity(a, c) == 0 and neardup.similarity(a, a[::-1]) == 0


def test_neardup_recall_of_planted_copies(spark):
    """Copies with words replaced, dropped and put in, up to the threshold: nearly all join their original."""
    rng, rows, pairs = random.Random(7), [], []
    for k in range(150):
        base = words(rng, rng.randint(60, 300)).split(" ")
        t = list(base)
        for _ in range(int(len(base) * rng.uniform(0.02, 0.095))):
            at = rng.randrange(len(t))
            what = rng.random()
            if what < 0.7:
                t[at] = words(rng, 1)
            elif what < 0.85:
                del t[at]
            else:
                t.insert(at, words(rng, 1))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(t))]
        if likeness_of_words(rows[-1][1], rows[-2][1]) >= 0.8:
            pairs.append(2 * k)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and np.mean([got[i] == got[i + 1] for i in pairs]) >= 0.97
    assert all(got[i] // 2 == i // 2 for i in got)


def test_neardup_shared_passage_and_chain(spark):
    """Texts that share a passage with hundreds of others stay apart; two of them that are alike, and a chain, are joined."""
    rng = random.Random(3)
    passage = words(rng, 60)
    texts = [passage + " " + words(rng, 50) for _ in range(120)]
    twin = texts[17].split(" ")
    twin[70] = "other"
    texts.append(" ".join(twin))
    now = words(rng, 120).split(" ")
    for _ in range(40):
        now = list(now)
        now[rng.randrange(len(now))] = words(rng, 1)
        texts.append(" ".join(now))
    order = list(range(len(texts)))
    rng.shuffle(order)
    got = {order[r.doc_id]: r.class_id for r in neardup.near_duplicate_classes(spark.createDataFrame([(k, texts[i]) for k, i in enumerate(order)], "doc_id long, text string")).collect()}
    assert got[17] == got[120] and len({got[i] for i in range(120)}) == 120 and len({got[i] for i in range(121, 161)}) == 1


def test_prefix_filter_loses_nothing(spark):
    rng, rows = random.Random(5), []
    for k in range(30):
        base = words(rng, 30).split(" ")
        for v in range(3):
            t = list(base)
            for _ in range(v):
                t[rng.randrange(len(t))] = words(rng, 1)
            rows.append((3 * k + v, 3 * k + v, len(t), bytearray(neardup.labelled([" ".join(t)])[0][0].tobytes())))
    df = spark.createDataFrame(rows, "node long, comp long, n long, seq binary")
    met = {(r.u, r.v) for r in neardup._prefix_pairs(df, 0.8, common.Tables(spark)).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and neardup.similarity(np.frombuffer(a[3], np.uint32), np.frombuffer(b[3], np.uint32)) > 0}
    assert want and want <= met


def rows_of_joins(plan):
    """Rows that each join of an executed plan has made, largest first."""
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if "Join" in kind and p.metrics().contains("numOutputRows"):
                found.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return sorted(found, reverse=True)


def test_prefix_filter_meets_a_pair_once(spark):
    """Near copies without a link share most of their words: a pair of them is a row or two of the joins, not one for each word."""
    rng, rows, made = random.Random(8), [], []
    base = words(rng, 200).split(" ")
    for k in range(60):
        t = [words(rng, 1) if rng.random() < 0.06 else w for w in base]
        rows.append((k, k, len(t), bytearray(neardup.labelled([" ".join(t)])[0][0].tobytes())))

    class Counting(common.Tables):
        def cut(self, df, *args):
            df.collect()
            made.extend(rows_of_joins(df._jdf.queryExecution().executedPlan()))
            return super().cut(df, *args)

    pairs = neardup._prefix_pairs(spark.createDataFrame(rows, "node long, comp long, n long, seq binary"), 0.8, Counting(spark)).count()
    assert pairs > 1000 and made and max(made) <= max(2 * pairs, 60 * 50)


def test_marks_that_grow_with_the_text():
    """Bits differ by no more than words do, also where one text's bins are folded to half as many; a pair's sizes are equal or double."""
    rng = np.random.default_rng(4)
    for n in (400, 512, 513, 900, 1024, 1025, 3000):
        for m in {n, n * 9 // 10, -(-n * 4 // 5)}:
            a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            b = np.concatenate([a[: m * 9 // 10], rng.integers(0, 1 << 62, m - m * 9 // 10, dtype=np.uint64)])
            big, less = neardup.marks_size(n), neardup.marks_size(m)
            assert big in (less, 2 * less) and big >= 2 * n
            x, y = neardup.marks(a, big), neardup.marks(b, less)
            x = x if len(x) == len(y) else x[: len(y)] ^ x[len(y) :]
            assert (x == neardup.marks(a, less)).all() and int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_long_texts_that_share_a_rare_word_are_not_paired(spark):
    """Long unlike texts of one vocabulary all meet at some word; only pairs that are near, or nearly, are left to verify, those of two sizes of marks among them."""
    rng, rows = np.random.default_rng(6), []
    add = lambda t: rows.append((len(rows), len(rows), len(t), bytearray(np.asarray(t, np.uint32).tobytes())))
    for n in (1000, 2000, 3000, 4000):
        for _ in range(12):
            add(rng.integers(0, 6000, n))
    base = rng.integers(0, 6000, 1000)
    add(base)
    add(np.concatenate([base, rng.integers(0, 6000, 60)]))
    add(np.where(rng.random(1000) < 0.05, rng.integers(0, 6000, 1000), base))
    members = spark.createDataFrame(rows, "node long, comp long, n long, seq binary")
    met = [(r.u, r.v) for r in neardup._prefix_pairs(members, 0.8, common.Tables(spark)).collect()]
    texts = [np.frombuffer(bytes(r[3]), np.uint32) for r in rows]
    want = {(i, j) for j in range(len(rows)) for i in range(j) if rows[i][2] >= 0.8 * rows[j][2] and neardup.similarity(texts[i], texts[j]) > 0}
    assert {(48, 49), (48, 50), (49, 50)} == want and want <= set(met) and len(met) == len(set(met)) <= 5


def test_neardup_edges(awkward, nothing):
    got = [(r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicate_classes(awkward).collect()]
    assert Counter(got) == Counter([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (None, None, 1), (5, 5, 2), (6, 5, 2), (7, 7, 2), (7, 7, 2), (8, 8, 1), (8, 8, 1), (9, 9, 1)])
    kept = neardup.dedup_documents(awkward)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, None, 5, 7, 8, 8, 9]))
    assert neardup.near_duplicate_classes(nothing).count() == 0 and neardup.dedup_documents(nothing).count() == 0


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 200)}, **{301 + i: 300 for i in range(40)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_skewed_join(spark):
    big = spark.createDataFrame([(i % 3 if i < 300 else i, i) for i in range(400)], "k long, x long")
    side = common.Tables(spark).cut(big.groupBy("k").count().withColumnRenamed("count", "n").withColumn("y", F.col("k") * 2).where("k != 350"))
    got = common.skewed_join(big, side, ["k"])
    assert sorted(got.columns) == ["k", "x", "y"] and sorted(tuple(r) for r in got.select("k", "x", "y").collect()) == sorted((i % 3 if i < 300 else i, i, 2 * (i % 3 if i < 300 else i)) for i in range(400) if i != 350)


# --- 3 -------------------------------------------------------------------------------------------


def brute_lines(rows, least):
    rows = sorted(set(rows))
    seen, gone = {}, {r: set() for r in rows}
    for d, t in rows:
        s = [(n, x, len(WORD.findall(x))) for n, x in enumerate(t.split("\n")) if WORD.search(x)]
        for a in range(len(s)):
            w = 0
            for b in range(a, len(s)):
                w += s[b][2]
                k, p = tuple(x for _, x, _ in s[a : b + 1]), ((d, t), a)
                if k in seen and seen[k] < p and w >= least:
                    gone[d, t].update(n for n, _, _ in s[a : b + 1])
                seen.setdefault(k, p)
    return gone


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["a b", "c", "d e f", "one two three four five six seven eight", "", "x y z w", "g h i j k", "l m n o"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_lines(rows, linededup.MIN_WORDS)
    want = {}
    for d, t in rows:
        left = "\n".join(v for n, v in enumerate(t.split("\n")) if n not in gone[d, t])
        want[d] = (sum(bool(WORD.search(v)) for v in t.split("\n")), len(gone[d, t]), hashlib.sha256(left.encode()).hexdigest())
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in linededup.line_digests(df).collect()} == want


def test_lines_edges(spark, awkward, nothing):
    got = linededup.line_digests(awkward).collect()
    assert len(got) == 12 and all(r.n_removed == 0 for r in got)
    same = linededup.dedup_lines(awkward)
    assert same.columns == awkward.columns and same.count() == 12
    two = awkward.where("doc_id IN (1, 5)").union(awkward.where("doc_id = 1").withColumn("doc_id", F.lit(20).cast("long")))
    assert sorted(r.doc_id for r in linededup.dedup_lines(two).collect()) == [1, 5]  # a copy throughout goes
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_runs_and_other_ids(spark):
    rows = [("a", "x one two three\nfour five six\nseven eight nine\nown"), ("b", "own b\nx one two three\nfour five six\nseven eight nine"), (None, "z"), ("c", "four five six\nseven eight nine ten")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = [(r.doc_id, r.lines, r.first_doc_id, r.first_line) for r in linededup.repeated_runs(df).collect()]
    assert got == [("b", [1, 2, 3], "a", 0)]
    ends = spark.createDataFrame([(2**63 - 1, rows[0][1]), (None, rows[0][1])], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in linededup.line_digests(ends).collect()} == {(2**63 - 1, 0), (None, 4)}


# --- 4 -------------------------------------------------------------------------------------------


def luhn(d):
    return sum(v - 9 if v > 9 else v for i, c in enumerate(reversed(d)) for v in [int(c) * (2 if i % 2 else 1)]) % 10 == 0


def test_pseudonyms(spark, awkward, nothing):
    texts = ["a.b@c.org x A.B@C.ORG", "+1 (017) 555-7713, 555-123-4567", "97.51.17.173 but 999.1.1.1", "4845168114407329 4845-1681-1440-7329 4845168114407320", "token = \"" + "0A" * 20 + "\"", "123-45-6789 2024-02-29 31.12.1999 29/02/2023", "DE89370400440532013000", "plain 2024 text"]
    rows = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert [rows[i].n_found for i in range(8)] == [2, 2, 1, 3, 1, 3, 1, 0] and rows[7].text == texts[7]
    one, _, two = rows[0].text.split(" ")
    assert one == two and "@" in one
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}, \d{3}-\d{3}-\d{4}", rows[1].text)
    assert all(int(x) < 256 for x in rows[2].text.split(" ")[0].split(".")) and rows[2].text.endswith("but 999.1.1.1")
    a, b, c = rows[3].text.split(" ")
    assert luhn(a) and b.replace("-", "") == a and len(c) == 16 and c != "4845168114407320"
    l, r = pii.permute("card", "key", 10**7, 10**8, 4845168, 11440732)
    assert a[:15] == f"{l:07d}{r:08d}" and pii.permute("card", "key", 10**7, 10**8, l, r, True) == (4845168, 11440732)
    assert re.fullmatch(r'token = "[0-9A-F]{40}"', rows[4].text)
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4} \d{4}-\d{2}-\d{2} \d{2}\.\d{2}\.\d{4} 29/02/2023", rows[5].text)
    i = rows[6].text
    assert int(i[4:] + "1314" + i[2:4]) % 97 == 1
    got = pii.pseudonymize(awkward, "key").collect()
    assert len(got) == 12 and all(r.n_found == 0 for r in got) and [r.text for r in got if r.doc_id == 2] == [None]
    assert pii.pseudonymize(nothing, "key").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymize(nothing, "")


def pseudonyms(spark, values, key="key"):
    got = {r.doc_id: r.text for r in pii.pseudonymize(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), key).collect()}
    return [got[i] for i in range(len(values))]


def test_pseudonyms_are_one_to_one(spark):
    """All dates of 200 years, and thousands of numbers of each class: no two share a pseudonym, none leaves its class."""
    import datetime as dt

    days = [dt.date(1900, 1, 1) + dt.timedelta(d) for d in range(73049)]
    iso = pseudonyms(spark, [d.isoformat() for d in days])
    assert set(iso) == {d.isoformat() for d in days}
    same = pseudonyms(spark, [d.strftime("%d.%m.%Y") for d in days[:2000]])
    assert [dt.datetime.strptime(x, "%d.%m.%Y").date().isoformat() for x in same] == iso[:2000]
    late = [d for d in days if d.day > 12]
    turned = pseudonyms(spark, [d.strftime("%m/%d/%Y") for d in late])
    assert set(turned) == {d.strftime("%m/%d/%Y") for d in late}
    rng = random.Random(4)
    cards = list({f"{rng.randrange(10**13):013d}" for _ in range(6000)})
    made = pseudonyms(spark, cards)
    assert len(set(made)) == len(cards) and [luhn(x) for x in made] == [luhn(x) for x in cards]
    phones = list({f"{rng.randint(2, 9)}{rng.randrange(10**9):09d}" for _ in range(3000)})
    made = pseudonyms(spark, phones)
    assert len(set(made)) == len(phones) and all(x[0] >= "2" for x in made)
    assert pseudonyms(spark, [f"{x[:3]}-{x[3:6]}-{x[6:]}" for x in phones[:200]]) == [f"{x[:3]}-{x[3:6]}-{x[6:]}" for x in made[:200]]


def test_pseudonyms_against_a_second_writing(spark):
    """Numbers that fail the Luhn test, by the network outside SQL, walking until a number fails it again."""
    rng = random.Random(6)
    values = [v for v in (f"{rng.randrange(10**16):016d}" for _ in range(200)) if not luhn(v)]

    def step(v):
        left, right = pii.permute("number", "key", 10**8, 10**8, int(v[:8]), int(v[8:]))
        return f"{left:08d}{right:08d}"

    def walk(v):
        v = step(v)
        while luhn(v):
            v = step(v)
        return v

    assert pseudonyms(spark, values) == [walk(v) for v in values]


def test_pseudonyms_of_more_formats(spark):
    def remainder(v):
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97

    texts = ["GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "12/25/1990", "+44 20 7946 0958", "5551234567", "2001:db8::1", "2001:DB8:0:0:8:800:200C:417A", "AB12 WORD WORDS LOUD", "31.02.2020", "std::vector a::b", "DE11370400440532013000"]
    got = pseudonyms(spark, texts)
    assert all(g != t for g, t in zip(got[:8], texts, strict=False)) and got[8:11] == texts[8:11] and got[11] != texts[11]
    assert re.fullmatch(r"GB\d{2}[A-Z]{4}\d{14}", got[0]) and remainder(got[0]) == 1 and got[1].replace(" ", "") == got[0] and remainder(got[2]) == 1 and remainder(got[11]) != 1
    assert re.fullmatch(r"\+44 \d{2} \d{4} \d{4}", got[4]) and re.fullmatch(r"[2-9]\d{9}", got[5])
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]", got[6]) and re.fullmatch(r"[0-9A-F]{4}:[0-9A-F]{3}:[0-9A-F]:[0-9A-F]:[0-9A-F]:[0-9A-F]{3}:[0-9A-F]{4}:[0-9A-F]{4}", got[7])
    assert pseudonyms(spark, texts[:8], "other key") != got[:8]


def test_feistel_is_a_permutation():
    assert len({pii.permute("x", "k", 7, 11, i // 11, i % 11) for i in range(77)}) == 77


# --- 5 -------------------------------------------------------------------------------------------


def test_signatures_against_brute_force():
    """Chains of the two content words, two apart, behind each anchor, counted by their words."""
    rng = random.Random(14)
    anchors, pool = spotsigs.ANCHORS[:6], [words(rng, 1) for _ in range(40)]
    for _ in range(60):
        t = [rng.choice(anchors) if rng.random() < 0.4 else rng.choice(pool) for _ in range(rng.randint(40, 90))]
        content = [i for i, w in enumerate(t) if w not in spotsigs.ANCHORS]
        chains = set()
        for i, w in enumerate(t):
            ahead = [c for c in content if c > i]
            if w in spotsigs.ANCHORS and len(ahead) > (spotsigs.CHAIN - 1) * spotsigs.SPOT:
                chains.add((w, *[t[ahead[k * spotsigs.SPOT]] for k in range(spotsigs.CHAIN)]))
        if len(chains) >= spotsigs.FEW:
            assert len(spotsigs.signature_sets([" ".join(t)])[0]) == len(chains)


def test_fingerprints(spark, nothing):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "a", "of", words(rng, 1), words(rng, 1)]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["the the", "", "x"]
    texts.append(texts[3])
    rows = [(3 * i + 5, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in spotsigs.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort(reverse=True)
    for k, (d, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        a, b, c = (set(spotsigs.signature_sets([x])[0].tolist()) for x in (t, e, nxt))
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == spotsigs.write(np.array(sorted(a), np.uint64)) and r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))
    assert got[3 * 3 + 5].fingerprint == got[max(got)].fingerprint
    assert spotsigs.edited_likeness(nothing).count() == 0


def test_fingerprints_edges(awkward):
    got = spotsigs.edited_likeness(awkward).collect()
    assert len(got) == 12 and {r.n_chars for r in got if r.doc_id == 2} == {0} and len({r.fingerprint for r in got if r.doc_id == 7}) == 1


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(15):
        base = [w for _ in range(40) for w in (rng.choice(["the", "of", "and"]), words(rng, 1), words(rng, 1))]
        for _ in range(3):
            t = list(base)
            t[rng.randrange(len(t))] = words(rng, 1)
            texts.append(" ".join(t))
    got = {(r.a, r.b): r.likeness for r in spotsigs.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    first = {}
    for i, s in enumerate(spotsigs.signature_sets(texts)):
        first.setdefault(spotsigs.write(s), (i, s))
    sets = sorted(first.values(), key=lambda x: x[0])
    assert got == {(a, b): pytest.approx(q) for k, (b, t) in enumerate(sets) for a, s in sets[:k] if (q := spotsigs.likeness(s, t)) >= 0.8} and got


# --- 6 -------------------------------------------------------------------------------------------


def test_pieces_against_the_library(spark, awkward, nothing):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = piece_codec.public_model()
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path)
    rng = random.Random(1)
    letters = " ▁abcdetion\n\té日本\U0001f600\x00ﷺ.,'  the"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        ids = sp.encode(t)
        assert c.encode(t) == ids and c.decode(ids) == sp.decode(ids) == c.round_trip(t)[2]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in piece_codec.encode_digests(awkward).join(awkward.select("doc_id", "text"), "doc_id").where("doc_id NOT IN (7, 8)").collect():
        ids = sp.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert piece_codec.encode_digests(nothing).count() == 0 and piece_codec.encode_digests(awkward).count() == 12
    assert {tuple(r.ids) for r in piece_codec.encode_documents(awkward).where("doc_id = 7").collect()} == {tuple(sp.encode("one"))}


# --- 7 -------------------------------------------------------------------------------------------


def test_quality_against_brute_force(spark, awkward, nothing):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice("ab cd ef gh #* $x".split(" ")) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)
    clean = "This is a good line of prose that ends well.\nAnd here is another one, just as long as that.\nHome | About | Contact | Help"
    row = quality.clean_lines(spark.createDataFrame([(clean,)], "text string")).first()
    assert row.clean_text == "\n".join(clean.split("\n")[:2]) and 0.5 < row.clean_share < 1
    rows = quality.quality_verdicts(awkward).collect()
    assert len(rows) == 12 and all(r.base_failed for r in rows if r.doc_id in (2, 3, 4, 7, 9)) and quality.quality_verdicts(nothing).count() == 0


# --- 8 -------------------------------------------------------------------------------------------


def test_mix(spark, awkward, nothing):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(1, 30)), "en", s, 0) for i in range(300) for s in [rng.choice(["a"] * 20 + ["b"] * 6 + ["c", "d", "é", None])]]
    got = mixing.mix_digest(spark.createDataFrame(rows, SCHEMA)).collect()
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(t.split())
    names = sorted((s for s in size if s), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, total = {}, set(names), float(sum(size.values()))
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            free.discard(s)
    taken = Counter()
    of = {i: s for i, _, _, s, _ in rows}
    for r in got:
        s = of[r.doc_id]
        taken[s] += r.taken
        assert r.target == pytest.approx(target[s]) and r.source_size == size[s] and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    again = mixing.mix_digest(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(got) == sorted(again)
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA))
    assert mixed.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    sizes = Counter()
    for r in mixed.collect():
        sizes[r.source] += len(r.text.split())
    assert all(abs(sizes[s] - target[s]) <= 30 for s in names)
    assert mixing.mix_digest(awkward).count() == 12 and mixing.mixed_documents(awkward).columns == awkward.columns
    odd = Counter(r.doc_id for r in mixing.mixed_documents(awkward).collect())
    assert {2, 3, 4, None} <= set(odd)  # texts without a word stay once
    many = spark.createDataFrame([(1, "same words here", "en", "a", 0)] * 300 + [(2, "other words", "en", "b", 0)], SCHEMA)
    assert mixing.mixed_documents(many).where("doc_id = 1").count() in range(290, 301)
    assert mixing.mix_digest(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mix_digest_is_read_off_the_sorted_copies(spark, monkeypatch):
    rng, seen = random.Random(12), []
    docs = spark.createDataFrame([(i, words(rng, rng.randint(0, 30)), "en", rng.choice(["a", "a", "b", None]), 0) for i in range(200)], SCHEMA)
    sort = mixing.training_copies
    monkeypatch.setattr(mixing, "training_copies", lambda at: seen.append(sort(at)) or seen[0])
    got = {r.doc_id: r for r in mixing.mix_digest(docs).collect()}
    copies = seen[0].collect()
    order = [(r.t, r.n_source, r.doc_id, r.c) for r in copies]
    assert len(got) == 200 and order == sorted(order) and 0 <= order[0][0] and order[-1][0] <= 1
    taken, number = Counter(), Counter()
    for r in copies:
        taken[r.doc_id] += r.words
        number[r.doc_id] += 1
        assert 0 < r.words <= got[r.doc_id].size
    assert all((r.taken, r.n_copies) == (taken[i], number[i]) for i, r in got.items()) and max(number.values()) > 1


# --- 9 -------------------------------------------------------------------------------------------


def test_language(spark, awkward, nothing):
    rng = random.Random(12)
    tongues = {"aa": "ka lo mi tre".split(), "bb": "van os ul pe".split(), "cc": "zsch ich ung keit".split()}
    rows = [(i, " ".join("".join(rng.choice(tongues[v]) for _ in range(rng.randint(1, 3))) for _ in range(20)), v, "s", 0) for i in range(300) for v in [rng.choice(list(tongues))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    assert np.mean([got[i].lang_pred == v for i, _, v, _, _ in rows if got[i].held_out]) > 0.98
    odd = langid.predict_languages(awkward, model).collect()
    assert len(odd) == 12 and all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (2, 3, 4, 9))
    kept = langid.keep_identified(awkward, model)
    assert kept.columns == awkward.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, None, 5, 6, 7, 7, 8]))  # two words that no language is near, labelled otherwise, go
    assert kept.where("doc_id IS NULL").first().lang in tongues
    assert langid.train(nothing).languages == [] and langid.keep_identified(nothing, langid.train(nothing)).count() == 0
    one = langid.fit(np.ones((2, langid.DIMENSIONS), np.float32), ["xx", "xx"])
    assert one.predict(["hello", "12"])[0] == ["xx", "und"]


def test_language_decoding_by_hand():
    """Loss-weighted decoding of one text, language by language and bit by bit."""
    import math

    texts, labels = ["kalo mi tre", "vanos ul pe", "zsch ich ung"] * 4, ["aa", "bb", "cc"] * 4
    m = langid.fit(langid.features(texts), labels)
    f = langid.features(["kalo ich pe"])[0] @ m.weights + m.bias
    loss = [sum(t * math.log1p(math.exp(-c * v)) for c, v, t in zip(code, f, m.trust, strict=True)) / sum(m.trust) for code in m.code]
    e = [math.exp(4 * (min(loss) - x)) for x in loss]
    langs, scores, close = m.predict(["kalo ich pe"])
    assert langs == [m.languages[loss.index(min(loss))]] and scores[0] == pytest.approx(max(e) / sum(e), rel=1e-4) and close[0] == (max(e) / sum(e) < langid.CLOSE)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert len({tuple(r) for r in c}) == n and not (abs(c.sum(0)) == n).any()


def test_counts_in_chunks(monkeypatch):
    t = "Größe und " * 50
    whole = langid.counts(t)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (langid.counts(t) == whole).all()


# --- 10 ------------------------------------------------------------------------------------------


def test_licenses(spark, awkward, nothing):
    assert len(licenses.rules()) >= 200
    texts = ["CC-BY cc by. CC by-SA 4.0", None, "", "Licensed under the Apache License, Version 2.0; General\nPublic License v3 ALL rights Reserved", "The MIT License", "cc byte general public", "Released under the MIT license. all rights reserved all rights reserved", "ÀCC by"]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        w = re.findall(licenses.WORD, (t or "").translate(lower))
        at = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
        every = [k for v in at.values() for k in v]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(every), min(every, default=None), max(every, default=None))
        assert r.base_labels == ",".join(sorted(x for x, v in at.items() if v)) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[3].labels == "apache-2.0,gpl,reserved" and got[4].labels == "mit" and got[0].labels == "cc-by,cc-by-sa" and got[1].score == 0
    assert got[6].labels == "mit,reserved" and got[3].n_detections >= 1
    rows = licenses.license_scan(awkward).collect()
    assert len(rows) == 12 and {r.labels for r in rows} == {""} and licenses.license_scan(nothing).count() == 0


def test_licenses_against_brute_force(spark):
    """Labels, detections and score of texts made of rules' matches, by Python's expressions and a sweep of all pairs of detections."""
    rng = random.Random(13)
    parts = [
        "licensed under the apache license version 2 0", "the mit license", "released under the gpl v3", "general public license", "cc by sa 4 0", "all rights reserved", "copyright c 2020", "isc license",
        "subject to the terms of the mozilla public license 2 0", "provided as is", "without warranty of any kind", "in the public domain", "bsd 3 clause license", "creative commons attribution 4 0 international license", "gnu general public license version 2",
    ]
    texts = [" ".join(rng.choice([rng.choice(parts), words(rng, rng.randint(1, 3))]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        x = f" {t} "
        found = sorted((m.start(), -m.end(), p, label) for _, e, label, p in licenses.rules() for m in re.finditer(e, x))
        left = []
        for k, (s, z, p, label) in enumerate(found):
            if not any(z2 <= z and p2 <= p for s2, z2, p2, _ in left if s2 <= s):
                left.append((s, z, p, label))
        base = sum(len(re.findall(f"(?= {b} )", x)) for b in licenses.BASE)
        labels = {f[3] for f in left} | {v for b, v in licenses.BASE.items() if f" {b} " in x}
        assert got[i].labels == ",".join(sorted(labels)) and got[i].n_detections == len(left) and got[i].n_base == base, t
        assert got[i].score == pytest.approx(1 - 0.5 ** min(60, base + len(left)))


def test_licenses_gate(spark):
    """Texts that hold no word but those of their one rule."""
    want = {
        "released under the MIT": "mit", "distributed under GPL v3": "gpl-3.0", "available under Apache 2.0": "apache-2.0", "subject to the terms of the BSD": "bsd",
        "provided AS-IS": "warranty-disclaimer", "this program is free\nsoftware; you can redistribute it": "gpl", "governed by zlib": "zlib",
    }
    _labels(spark, want)


def test_licenses_keywords(spark):
    """Alternatives of a name that don't hold the name's usual word, and every match of a rule holds its keyword."""
    want = {"zero clause bsd license": "0bsd", "bsd zero clause license": "0bsd", "licensed under the Expat license": "mit", "licensed under PHP": "php"}
    want |= {"released under the Artistic": "artistic", "released under Ruby": "ruby", "available under PostgreSQL": "postgresql", "released under the open software": "osl"}
    rng = random.Random(4)

    def made(tree):
        out = ""
        for op, x in tree:
            op = str(op)
            if op == "LITERAL":
                out += chr(x)
            elif op == "IN":
                out += {"LITERAL": lambda v: chr(v), "CATEGORY": lambda v: "7"}[str((y := rng.choice(x))[0])](y[1])
            elif op == "SUBPATTERN":
                out += made(x[-1])
            elif op == "BRANCH":
                out += made(rng.choice(x[1]))
            elif op == "MAX_REPEAT":
                out += "".join(made(x[2]) for _ in range(rng.randint(x[0], min(x[1], x[0] + 2))))
            else:
                assert op in ("ASSERT",), op
        return out

    for rule in licenses.rules():
        for _ in range(30):
            got = f" {made(re._parser.parse(rule[1]))} "
            assert re.search(rule[1], got) and rule[0] in got, rule
    _labels(spark, want)


def _labels(spark, want):
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()}
    for i, (t, label) in enumerate(want.items()):
        assert label in got[i].labels.split(",") and got[i].n_detections >= 1 and got[i].score > 0, (t, got[i].labels)


# --- the pipeline --------------------------------------------------------------------------------


def test_workers_keep_one_operators_things(spark):
    """A worker that has encoded drops the codec when it sketches next: workers outlive the stages that filled them."""
    common.kept.clear()
    encoder = common.lean("piece_codec", lambda batches: (bool(piece_codec.codec(None)) for _ in batches))
    assert list(encoder([1, 2])) == [True, True] and common.kept["codecs"]
    codecs = common.kept["codecs"]
    assert list(encoder([1])) == [True] and common.kept["codecs"] is codecs
    assert list(common.lean("neardup", iter)([1, 2])) == [1, 2] and "codecs" not in common.kept
    # as a worker gets it
    sent = cloudpickle.loads(cloudpickle.dumps(common.lean("piece_codec", iter)))
    assert list(sent([1])) == [1] and common.kept["owner"] == "piece_codec"


def test_tables_are_written_in_small_batches(spark):
    tables = common.Tables(spark)
    sizes = lambda batches: (b.iloc[:1].assign(id=len(b)) for b in batches)
    before = spark.conf.get(common.Tables.BATCH)
    got = tables.cut(spark.range(0, 9000, 1, 1).mapInPandas(sizes, "id long")).collect()
    assert max(r.id for r in got) <= common.ROWS_PER_BATCH and spark.conf.get(common.Tables.BATCH) == before


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(20)
    rows = [(i, "\n".join(words(rng, 15) + "." for _ in range(4)), "en", rng.choice("ab"), 0) for i in range(40)]
    near = rows[3][1].split(" ")
    near[7] = "changed"
    rows += [(100, rows[0][1], "en", "a", 0), (101, " ".join(near), "en", "a", 0), (102, "123 456", "en", "a", 0), (103, None, "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids and not ids & {100, 102, 103} and ids <= {r[0] for r in rows}


def test_pair_rule_against_merging():
    """The walk along two tokens' halves says the same as merging their joined text."""
    c, rng = piece_codec.PieceCodec(piece_codec.public_model()), random.Random(5)
    ids = sorted(c.ids)
    short = [p for p in ids if len(p) <= 3]
    for k in range(4000):
        a, b = (rng.choice(ids if k % 2 else short) for _ in range(2))
        if a in c.regular and b in c.regular:
            assert c._stay_apart(a, b) == (c.merge(a + b) == [a, b]), (a, b)


def test_quality_of_one_long_line(spark):
    """A line without a blank, and one of many short words, of 1 MB each: linear work."""
    import time

    df = spark.createDataFrame([(1, "x" * 1_000_000), (2, "ab " * 333_000), (3, " " * 500_000 + "a b c d e")], "doc_id long, text string")
    quality.quality_verdicts(df.limit(1)).collect()
    began = time.time()
    row = df.select(*[quality.line_passes(F.col("text")).alias("ok")]).collect()
    assert time.time() - began < 5 and [r.ok for r in row] == [False, True, True]
    short = spark.createDataFrame([("  a b c d e",), ("a b c d",), ("a  b  c  d  e",), (" a b c d ",)], "text string")
    assert [r[0] for r in short.select(F.rlike("text", F.lit(quality.LONG_LINE_ONCE)) == F.rlike("text", F.lit(quality.LONG_LINE))).collect()] == [True] * 4


def test_language_sample_is_bounded_by_rows(spark):
    """Many rows of one id, labels that contradict, one row many times, and many languages."""
    one = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("words of row "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"))
    same = spark.range(3000).select(F.lit(2).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    got = Counter(r.lang for r in langid.sample(one.unionByName(same), 300).collect())
    assert got == {"de": 300, "en": 300}
    assert langid.sample(one.unionByName(same), 300, 100).count() == 100
    assert langid.sample(same).count() <= 1


def test_codewords_without_a_good_random_code(monkeypatch):
    class Ones:
        def choice(self, values, size):
            return np.ones(size, dtype=int)

    monkeypatch.setattr(np.random, "default_rng", lambda seed=None: Ones())
    c = langid.codewords(8)
    assert c.shape == (8, 8) and len({tuple(r) for r in c}) == 8
