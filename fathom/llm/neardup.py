r"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Sketch. A text is the sequence of its windows of ``K`` words, each labelled with how often it came before. For each of ``SKETCHES``
hash functions the ``SAMPLE`` smallest labelled windows are taken *in the order of the text* and hashed: two texts agree in
a sketch if they share those windows and their order, so agreement follows edit similarity. Texts of fewer than K words
are one window.

Similarity. The words of two texts are aligned: the longest common subsequence within the band
|i - j| <= (n + m) * (1 - s) / (1 + s), which holds the best alignment of any pair that reaches the threshold s. Similarity is aligned / (n + m - aligned),
an ordered Jaccard similarity of words; links have at least ``THRESHOLD``. One word changed in ten is just a link.

Candidates. Equal texts are one node. Nodes that agree in a sketch share a bucket, which links its members to one of them (a star, never
all pairs), the one that shares most buckets with others; the links are verified. Members of buckets that then lie in several components may still be alike without being like that
one. They meet by a prefix filter, which is exact: a pair that reaches the threshold shares at least ceil(s * n) labelled
words, so under any order of all words it shares one among the first n - ceil(s * n) + 1 of each; with rare words first such meetings are few. Every pair across
components that meets is verified, if its lengths, the words left from the first shared one on and the bins of its words (``marks``) admit the threshold, which all hold for any pair that reaches it.
A pair that shares many words is taken at the first of them, which always stands: it is passed over where one of the ``RECENT`` words before, in that order, is shared too. Bins of a fixed number
are all full in long texts, so pairs of those are held against each other once more by bins that grow with their words, before their texts are fetched. Nothing is capped, and no bucket is treated by its size.

Defined results: null texts and texts without a word are classes of their own row; rows equal in text are one
class; class_id is the least doc_id of the class (null only where all ids are null, ties by text key); rows equal in id and text are both in their
class and one of them is kept; an empty table gives an empty result; very long texts cost in proportion to their length, their alignment to length times band over 64.
Columns of docs other than doc_id and text are passed on whatever their names.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, fresh_name, lean, salted_join, skewed_join, slices, text_key
from .components import components
from .words import ascii_lower, byte_class, mix, windows, word_hashes

K = 5
SKETCHES = 32
SAMPLE = 2
THRESHOLD = 0.8
BINS = 256
MARKS = 1024
RECENT = 8
PAIRS_PER_TASK = 4000
RARITY_BINS = 1 << 16
ALIGN_BLOCK = 4096
ROWS_AT_ONCE = 250
FEW_PLACES = 64

_WORD = byte_class(b" \t\n\x0b\x0c\r")
_HAS_WORD = r"[^\x20\x09-\x0D]"
_LOWER = ascii_lower()
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def occurrences(h: np.ndarray) -> np.ndarray:
    """Values made unique by the number of their earlier occurrences."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    if new.all():
        return h
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    nth = np.empty(len(s), np.uint64)
    nth[order] = np.arange(len(s)) - first
    with np.errstate(over="ignore"):
        return np.where(nth > 0, mix(h + nth * np.uint64(0xD6E8FEB86659FD93)), h)


def labelled(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each text, its words as 32-bit values and its labelled windows as unique 64-bit values, both in order."""
    h, starts = word_hashes(texts, _WORD, _LOWER)
    w, at = windows(h, starts, K)
    words, seqs = [], []
    for i in range(len(texts)):
        own, all_words = w[at[i] : at[i + 1]], h[starts[i] : starts[i + 1]]
        if not len(own) and len(all_words):
            own = np.zeros(1, np.uint64)
            with np.errstate(over="ignore"):
                for x in all_words:
                    own = mix(own * np.uint64(9) + x)
        words.append((all_words >> np.uint64(32)).astype(np.uint32))
        seqs.append(occurrences(own))
    return words, seqs


def sketch(w: np.ndarray) -> np.ndarray:
    """Order MinHash sketches of a labelled sequence, as signed 64-bit values."""
    with np.errstate(over="ignore"):
        if len(w) <= SAMPLE:
            picked = np.broadcast_to(w, (SKETCHES, len(w)))
        else:
            at = np.empty((SKETCHES, SAMPLE), dtype=np.int64)
            step = max(1, (1 << 20) // len(w))
            for lo in range(0, SKETCHES, step):
                v = (w[None, :] ^ _SEEDS[lo : lo + step]) * np.uint64(0xBF58476D1CE4E5B9)
                v ^= v >> np.uint64(29)
                rows = np.arange(len(v))
                for k in range(SAMPLE):
                    least = v.argmin(axis=1)
                    at[lo : lo + step, k] = least
                    v[rows, least] = np.iinfo(np.uint64).max
            at.sort(axis=1)
            picked = w[at]
        out = _SEEDS[:, 0].copy()
        for k in range(picked.shape[1]):
            out = mix(out * np.uint64(3) + picked[:, k])
    return out.view(np.int64)


def bins(words: np.ndarray) -> np.ndarray:
    """Words of a text by their value's bin. As many words of two texts aren't aligned at least as their bins differ; clipped, they differ less, never more."""
    return np.minimum(np.bincount(words % BINS, minlength=BINS), np.iinfo(np.int8).max)


def marks(tokens: np.ndarray, size: int = MARKS) -> np.ndarray:
    """A bit for each of size bins of labelled words, set if it holds an odd number of them. As many words of two texts aren't shared at least as bits differ."""
    return np.packbits(np.bincount((tokens % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1).view(np.int64)


def marks_size(n: int) -> int:
    """Bins for a text of n words: a power of two, at least two a word. Those of texts that may be alike are equal or double."""
    return max(MARKS, 1 << (2 * n - 1).bit_length())


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two word sequences whose matches lie at |i - j| <= band.

    Bit-parallel along b: bit i of the row is 0 where the subsequence grows at a's word i. b is worked off in blocks; a block
    touches only the part of the row that its band covers, so masks are of that part.
    """
    row, matched = -1, 0  # all ones
    low = 0  # bits below it are done and counted
    for lo in range(0, len(b), ALIGN_BLOCK):
        hi = min(lo + ALIGN_BLOCK, len(b))
        start, end = max(0, lo - band), min(len(a), hi + band)
        if start > low:
            done = min(start, len(a)) - low
            matched += done - (row & ((1 << done) - 1)).bit_count()
            row >>= done
            low += done
        width = max(0, end - low)
        full = (1 << width) - 1
        places: dict[int, list[int]] = {}
        for i, x in enumerate(a[low:end].tolist()):
            places.setdefault(x, []).append(i)
        masks: dict[int, int] = {}
        part = row & full
        near = (1 << (2 * band + 1)) - 1
        banded = band < max(len(a), len(b))
        for j, x in enumerate(b[lo:hi].tolist(), lo):
            m = masks.get(x)
            if m is None:
                at = places.get(x)
                if at is None:
                    continue
                m = 0
                for i in at:
                    m |= 1 << i
                if width <= 2 * ALIGN_BLOCK or len(at) > FEW_PLACES:
                    masks[x] = m
            if banded:
                left = j - band - low
                m &= near << left if left >= 0 else near >> -left
            u = part & m
            if u:
                part = ((part + u) | (part - u)) & full
        row = (row & ~full) | part
    rest = len(a) - low
    return matched + rest - (row & ((1 << rest) - 1)).bit_count() if rest > 0 else matched


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Ordered Jaccard similarity of two word sequences; exact from the threshold on, else 0."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    apart = (n + m) * (1 - threshold) / (1 + threshold) + 1e-9  # most words that aren't aligned, of both
    if abs(n - m) > apart:
        return 0.0
    if np.abs(bins(a) - bins(b)).sum() > apart:
        return 0.0
    run = aligned(a, b, int(apart))
    s = run / (n + m - run)
    return s if s >= threshold - 1e-12 else 0.0


def prefix_length(n: int, threshold: float) -> int:
    return n - math.ceil(threshold * n - 1e-9) + 1


def _sketched(docs: DataFrame) -> DataFrame:
    """tkey, n, sk, seq (bytes of the words) of every row with a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, ROWS_AT_ONCE):
            words, seqs = labelled(b["text"].tolist())
            yield pd.DataFrame({"tkey": b["tkey"], "n": [len(s) for s in words], "sk": [sketch(s) for s in seqs], "seq": [s.tobytes() for s in words]})

    return docs.where(F.rlike("text", F.lit(_HAS_WORD))).select(text_key().alias("tkey"), "text").mapInPandas(lean("neardup", run), "tkey binary, n long, sk array<bigint>, seq binary")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float, tables: Tables, rows: int | None = None) -> tuple[DataFrame, int]:
    """Those of pairs(u, v) that align at the threshold, and how many were tried; rows: a bound of the pairs, if one is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) > 0 for x, y in zip(b["x"], b["y"], strict=True)]
            yield b.loc[ok, ["u", "v"]]

    pairs = tables.cut(pairs, rows)
    tried = pairs.count()
    both = salted_join(pairs, nodes.select(F.col("node").alias("v"), F.col("seq").alias("y")), "v", "u")
    # the other end is a leader too in few pairs only
    both = both.join(nodes.select(F.col("node").alias("u"), F.col("seq").alias("x")), "u")
    out = tables.cut(both.select("u", "v", "x", "y").mapInPandas(lean("neardup", run), "u long, v long"), tried, PAIRS_PER_TASK)
    tables.drop(pairs)
    return out, tried


def tokens(seq: bytes) -> np.ndarray:
    """The labelled words of a text, as unique 64-bit values."""
    with np.errstate(over="ignore"):
        return occurrences(mix(np.frombuffer(seq, np.uint32).astype(np.uint64) + np.uint64(1)))


def _close_by_marks(pairs: DataFrame, members: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """u, v of those pairs(u, v) whose words, by marks of a size that fits them, admit the threshold; members(node, n, seq) are the texts that they may be of."""

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield pd.DataFrame({"node": b["node"], "n": b["n"], "marks": [marks(tokens(s), marks_size(n)) for s, n in zip(b["seq"], b["n"], strict=True)]})

    def halved(c: str, other: str) -> Column:
        """c, brought to half its size where the other's is less: bins that fall together by the lesser size."""
        half = F.size(other)
        return F.when(F.size(c) > half, F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(c))

    wide = tables.cut(members.select("node", "n", "seq").mapInPandas(lean("neardup", sized), "node long, n long, marks array<bigint>"))
    both = salted_join(pairs, wide.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("marks").alias("y")), "v", "u")
    both = both.join(wide.select(F.col("node").alias("u"), "n", F.col("marks").alias("x")), "u")
    differ = F.aggregate(F.zip_with(halved("x", "y"), halved("y", "x"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, k: s + k)
    out = tables.cut(both.where(differ <= (F.col("n") + F.col("m")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select("u", "v"))
    tables.drop(wide)
    return out


def _prefix_pairs(members: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """u, v of members(node, comp, n, seq) in different components that may reach the threshold: they share a word of their prefixes, rare words first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(RARITY_BINS, np.int64)
        for b in batches:
            for s in b["seq"]:
                out += np.bincount((tokens(s) >> np.uint64(48)).astype(np.int64), minlength=RARITY_BINS)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"bin": at, "n": out[at]})

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield pd.DataFrame({**{c: b[c] for c in ("node", "comp", "n")}, "marks": [marks(tokens(s)) for s in b["seq"]]})

    often = np.zeros(RARITY_BINS, np.int64)
    for r in members.select("seq").mapInPandas(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # RARITY_BINS rows at most
        often[r["bin"]] = r["n"]

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            found = []
            for s in b["seq"]:
                t = tokens(s)
                found.append(t[np.lexsort((t, often[(t >> np.uint64(48)).astype(np.int64)]))[: prefix_length(len(t), threshold)]].view(np.int64))
            size = [len(f) for f in found]
            if not found:
                continue
            yield pd.DataFrame({"token": np.concatenate(found), **{c: np.repeat(b[c].to_numpy(), size) for c in ("node", "comp")}, "at": np.concatenate([np.arange(k) for k in size])})

    words = tables.cut(members.mapInPandas(prefixes, "token long, node long, comp long, at int"))
    rows = words.count()
    shared = tables.cut(words.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("times")).where("a != b").select("token", "times"), rows)
    own = skewed_join(words.select("token", "node", "at"), shared, ["token"], "times").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("own"))
    own = own.join(members.mapInPandas(marked, "node long, comp long, n long, marks array<bigint>"), "node")
    own = own.select("node", "comp", "n", "marks", "own", F.posexplode("own").alias("k", "w"))
    recent = F.slice("own", F.greatest(F.col("k") - RECENT, F.lit(0)) + 1, F.least("k", F.lit(RECENT)))["token"]  # its shared words just before this one
    words_shared = tables.cut(own.select("w.token", "node", "comp", "n", "w.at", "marks", recent.alias("recent")), rows)
    tables.drop(words, shared)
    # a word's largest component meets the others, and those each other, but never itself
    major = words_shared.groupBy("token", "comp").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"))
    names = {"node": "v", "comp": "d", "n": "m", "at": "place", "marks": "other", "recent": "before"}
    minor = words_shared.join(major, "token").where("comp != major").select("token", "major", *[F.col(c).alias(to) for c, to in names.items()])
    both = F.col("n") + F.col("m")
    alike = F.least("n", "m") >= threshold * F.greatest("n", "m")
    # no word before the first that both have is common to both: so many are left at most
    left = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) >= both * (threshold / (1 + threshold)) - 1e-6
    before = F.arrays_overlap("recent", "before")  # a pair that has met at one of these words, so not at its first
    differ = reduce(operator.add, [F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("other")[i])) for i in range(MARKS // 64)])
    close = alike & left & ~before & (differ <= both * ((1 - threshold) / (1 + threshold)) + 1e-6)
    most = MARKS // 2  # words of a text that marks_size gives MARKS bins
    meet = words_shared.join(minor, "token").where((F.col("comp") != F.col("d")) & ((F.col("comp") == F.col("major")) | (F.col("node") < F.col("v"))) & close)
    met = tables.cut(meet.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"), (F.greatest("n", "m") > most).alias("long")).distinct())
    tables.drop(words_shared)
    pairs, long = met.where("NOT long").select("u", "v"), met.where("long").select("u", "v")
    if long.isEmpty():
        return pairs
    return pairs.unionByName(_close_by_marks(long, members.where(F.col("n") >= threshold * most), threshold, tables))


def links(docs: DataFrame, threshold: float = THRESHOLD, tables: Tables | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(node, tkey, ...) of the different texts with a word; u, v of the nodes that aren't the least of their class, and that one)."""
    tables = tables or Tables(docs.sparkSession)
    nodes = _sketched(docs).groupBy("tkey").agg(F.first("n").alias("n"), F.first("sk").alias("sk"), F.first("seq").alias("seq"))
    nodes = tables.cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    count = nodes.count()
    most = count * SKETCHES
    buckets = nodes.select("node", F.explode("sk").alias("h"))
    shared = tables.cut(buckets.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").withColumn("size", F.col("times")), most)
    held = tables.cut(skewed_join(buckets, shared, ["h"], "times"), most)
    # a bucket's leader is its member that meets most others in all of its buckets: the text that copies were made from before any copy
    degree = held.groupBy("node").agg(F.sum("size").alias("degree"))
    lead = held.join(degree, "node").groupBy("h").agg(F.max(F.struct("degree", (-F.col("node")).alias("least"))).alias("top"), F.count("*").alias("times")).select("h", (-F.col("top.least")).alias("lead"), "times")
    lead = tables.cut(lead, most)
    members = tables.cut(skewed_join(held.drop("size"), lead, ["h"], "times"), most)
    tables.drop(shared, held)
    pairs = members.where("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
    linked, tried = _verified(pairs, nodes, threshold, tables, most)
    parts = components(linked, tables, tried)
    placed = members.select("h", "node").join(parts.select(F.col("u").alias("node"), F.col("v").alias("c_")), "node", "left").select("h", "node", F.coalesce("c_", "node").alias("comp"))
    placed = tables.cut(placed, most)
    tables.drop(members)
    # buckets of three and more whose members lie in several components
    mixed = placed.groupBy("h").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("times")).where("a != b AND times > 2").select("h", "times")
    mixed = tables.cut(mixed, most)
    loose = tables.cut(skewed_join(placed, mixed, ["h"], "times").select("node", "comp").distinct().join(nodes.select("node", "n", "seq"), "node"), count, PAIRS_PER_TASK)
    tables.drop(placed, mixed, lead)
    more, tried = _verified(_prefix_pairs(loose, threshold, tables), loose, threshold, tables)
    if tried:
        parts = components(parts.unionByName(more), tables, count + tried)
    tables.drop(loose, linked)
    return nodes, parts


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, tkey (of the text), class_id, class_size (rows), keep (the row stands for its class) of every row of docs(doc_id, text)."""
    tables = Tables(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    nodes, parts = links(docs, threshold, tables)
    rows = tables.cut(docs.select("doc_id", text_key().alias("tkey"), F.coalesce(F.rlike("text", F.lit(_HAS_WORD)), F.lit(False)).alias("worded")))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    texts = rows.where("worded").groupBy("tkey").agg(F.min(least).alias("first"), F.count("*").alias("times"))
    named = nodes.select("tkey", "node").join(parts.select(F.col("u").alias("node"), "v"), "node", "left").select(F.col("tkey").alias("t_"), F.coalesce("v", "node").alias("comp"))
    count = rows.count()
    texts = tables.cut(texts.join(named, F.col("tkey") == F.col("t_")).drop("t_"), count)
    tables.drop(nodes, parts)
    classes = tables.cut(texts.groupBy("comp").agg(F.min("first").alias("head"), F.sum("times").alias("class_size"), F.count("*").alias("n_texts")), count)
    of_text = tables.cut(skewed_join(texts.select("comp", "tkey", "times"), classes, ["comp"], "n_texts").select("tkey", "head", "class_size", "times"), count)
    tables.drop(texts, classes)
    placed = skewed_join(rows.where("worded").drop("worded"), of_text, ["tkey"], "times")
    keep = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tkey") == F.col("head.tkey"))
    placed = placed.select("doc_id", "tkey", F.col("head.doc_id").alias("class_id"), "class_size", keep.alias("keep"))
    alone = rows.where("NOT worded").select("doc_id", "tkey", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("keep"))
    return placed.unionByName(alone)


def dedup_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each near-duplicate class (the least id's, by text key where that is tied); columns as in docs.

    Rows without a word are classes of their own and stay.
    """
    names = docs.columns
    tkey, ident = fresh_name("tkey_", names), fresh_name("id_", names)
    classes = near_duplicate_classes(docs, threshold)
    has_word: Column = F.coalesce(F.rlike("text", F.lit(_HAS_WORD)), F.lit(False))
    keep = classes.where("keep").select(F.col("doc_id").alias(ident), F.col("tkey").alias(tkey + "k")).distinct()
    rows = docs.where(has_word).withColumn(tkey, text_key()).join(keep, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.col(tkey) == F.col(tkey + "k")))
    return rows.dropDuplicates(["doc_id", tkey]).select(*[F.col(f"`{c}`") for c in names]).unionByName(docs.where(~has_word))
