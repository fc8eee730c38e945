r"""SpotSigs document fingerprints: signatures are chains of content words that follow common-word anchors.

An anchor is a common word of one of four languages (a fixed list). Each anchor's signature is the anchor and the next ``CHAIN``
content words after it, ``SPOT`` content words apart; a text's fingerprint is its set of signatures, written as a sorted
list of 40-bit values in hexadecimal behind their number. In a text with fewer than ``FEW`` signatures every word
is an anchor too. Words are runs of letters and digits, ASCII lower-cased. Likeness is the
Jaccard similarity of the sets; the comparison is pruned by length: sets whose sizes differ by more
than the threshold allows are not compared (``similar_pairs``).

The query's edited text takes its last third from the next document; documents meet their successor by parts that hold a run of ids each
(cut at quantiles of a bounded sample of ids), with the first document of each part copied to the part before it: one
shuffle of the texts, no window over them. The query compares fixed neighbours; the pruned comparison of all fingerprints is ``similar_pairs``.

Defined results: null and empty texts have the fingerprint of the empty word list and are alike with
likeness 1; equal texts have equal fingerprints; rows with equal ids, and those without one, which come last, follow each other in order of their
text's md5; a table of one row is its own successor, an empty table gives an empty result. Ids may be of any type that sorts. Very long texts
cost in proportion to their length. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, skewed_join, slices
from .words import ascii_lower, byte_class, mix, word_hashes

CHAIN = 2
SPOT = 2
BITS = 40
PART_ROWS = 2000
MOST_PARTS = 1 << 13
IDS_PER_PART = 40  # of the sample that parts are cut by
NULL_PARTS = 16
FEW = 8
ROWS_AT_ONCE = 256

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an and or but of to in on at by for with from is are was were be been has have had this that these those it its he she they as not which there "
    "der die das und oder aber ein eine einen einem von zu im in mit auf für ist sind war wird werden nicht den dem des sich als auch es an "
    "le la les un une des du de et ou mais est sont dans pour par sur avec que qui au aux ce cette il elle pas ne "
    "el los las uno una unos y o pero es son en por para con del al que se no su sus lo como más"
).split()

_WORD = byte_class(bytes(range(48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 128)))
_LOWER = ascii_lower()
_ANCHOR_HASHES = np.unique(word_hashes(ANCHORS, _WORD, _LOWER)[0])


def signature_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct signatures of each text."""
    h, starts = word_hashes(texts, _WORD, _LOWER)
    at = np.minimum(np.searchsorted(_ANCHOR_HASHES, h), len(_ANCHOR_HASHES) - 1)
    anchor = _ANCHOR_HASHES[at] == h
    content = np.flatnonzero(~anchor)
    ahead = np.searchsorted(content, np.flatnonzero(anchor))  # the first content word after each anchor
    where = np.flatnonzero(anchor)
    last = ahead + (CHAIN - 1) * SPOT
    text_end = np.repeat(starts[1:], np.diff(starts))
    ok = last < len(content)
    ok[ok] = content[last[ok]] < text_end[where[ok]]
    where, ahead = where[ok], ahead[ok]
    with np.errstate(over="ignore"):
        sig = h[where]
        for k in range(CHAIN):
            sig = mix(sig * np.uint64(5) + h[content[ahead + k * SPOT]])
    bounds = np.searchsorted(where, starts)
    out = []
    for i in range(len(texts)):
        own = sig[bounds[i] : bounds[i + 1]]
        if len(own) < FEW and starts[i + 1] > starts[i]:
            own = np.concatenate([own, _every_word(h[starts[i] : starts[i + 1]])])
        if not len(own):
            own = np.zeros(1, dtype=np.uint64)  # no word
        out.append(np.unique(own >> np.uint64(64 - BITS)))
    return out


def _every_word(h: np.ndarray) -> np.ndarray:
    """Signatures of a text with few anchors: each word is one, with the word after it; in shorter texts, alone."""
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(5) + h[1:])
        return pairs if len(pairs) >= FEW else np.concatenate([pairs, mix(h + np.uint64(11))])


def write(signatures: np.ndarray) -> str:
    raw = signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return f"{len(signatures)}:{raw.tobytes().hex()}"


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint.partition(":")[2]), dtype=np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (8 - BITS // 8, 0))).copy().view(">u8").astype(np.uint64).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) - both else 1.0


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fingerprint of every row; map-only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield pd.DataFrame({"doc_id": b["i"], "fingerprint": [write(s) for s in signature_sets(b["t"].tolist())]})

    return docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fingerprint string")


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with likeness at least the threshold: a and b, the least ids that have them (a <= b, null last), and the likeness.

    Fingerprints are grouped first, so copies count once. Sets are cut into length ranges such that two sets above
    the threshold lie in the same or neighbouring ranges; within them, pairs meet on the signatures of a prefix of
    each set in order of rarity, long enough that any pair above the threshold shares one, and are then compared in full.
    """
    tables = Tables(docs.sparkSession)
    prints = fingerprints(docs).groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    prints = tables.cut(prints.withColumn("f", F.monotonically_increasing_id()))
    wide = BITS // 4
    sigs = prints.select("f", "doc_id", F.expr(f"transform(sequence(1, length(split_part(fingerprint, chr(58), 2)), {wide}), i -> substring(split_part(fingerprint, chr(58), 2), i, {wide}))").alias("s")).withColumn("n", F.size("s"))
    long = sigs.select("f", "n", F.explode("s").alias("sig"))
    rarity = tables.cut(long.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1").withColumn("times", F.col("df")))
    ordered = skewed_join(long, rarity, ["sig"], "times")
    prefix = ordered.groupBy("f", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("o"), F.count("*").alias("shared"))
    # with n - shared signatures that no other set holds, the prefix runs n - ceil(threshold * n) + 1 over all of them, unshared first
    take = F.expr(f"n - cast(ceil({threshold} * n) as int) + 1 - (n - cast(shared as int))")
    keys = prefix.withColumn("take", take).where("take > 0").select("f", "n", F.explode(F.expr("slice(o, 1, least(take, size(o)))")).alias("k")).select("f", "n", F.col("k.sig").alias("sig"))
    base = 1 / threshold
    part = F.floor(F.log("n") / F.log(F.lit(base))).cast("int")
    left = tables.cut(keys.withColumn("part", part))
    right = left.select(F.col("f").alias("other"), F.col("n").alias("m"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    close = left.join(right, ["sig", "part"]).where((F.col("f") != F.col("other")) & (F.least("n", "m") >= threshold * F.greatest("n", "m")))
    pairs = close.select(F.least("f", "other").alias("a"), F.greatest("f", "other").alias("b")).distinct()
    both = pairs.join(sigs.select(F.col("f").alias("a"), F.col("s").alias("sa"), F.col("doc_id").alias("da")), "a").join(sigs.select(F.col("f").alias("b"), F.col("s").alias("sb"), F.col("doc_id").alias("db")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("sa", "sb"))).withColumn("likeness", F.col("i") / (F.size("sa") + F.size("sb") - F.col("i"))).where(F.col("likeness") >= threshold)
    turned = F.col("da").isNull() | (F.col("db").isNotNull() & (F.col("db") < F.col("da")))
    return both.select(F.when(turned, F.col("db")).otherwise(F.col("da")).alias("a"), F.when(turned, F.col("da")).otherwise(F.col("db")).alias("b"), "likeness")


def _part(ids: DataFrame, count: int) -> Column:
    """The part of each doc_id, growing with it from NULL_PARTS on; those below are of rows without an id, by the first digit of the text's md5.

    Parts are cut at quantiles of a sample of different ids, bounded by MOST_PARTS * IDS_PER_PART, so they hold as many rows each; two levels of cuts keep the search short.
    """
    parts = max(1, min(MOST_PARTS, count // PART_ROWS))
    share = min(1.0, parts * IDS_PER_PART / max(1, count))
    drawn = ids.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id").distinct().limit(2 * parts * IDS_PER_PART)
    known = sorted(r[0] for r in drawn.collect())
    cuts = sorted({known[k * len(known) // parts] for k in range(1, parts)}) if known else []
    null = F.conv(F.substring("tie", 1, 1), 16, 10).cast("int")
    if not cuts:
        return F.when(F.col("doc_id").isNull(), null).otherwise(F.lit(NULL_PARTS))
    kind, wide = ids.schema["doc_id"].dataType, max(1, int(len(cuts) ** 0.5))
    rows = [cuts[k : k + wide] for k in range(0, len(cuts), wide)]
    lit = lambda v: F.lit(v).cast(kind)
    row = F.size(F.filter(F.array(*[lit(r[0]) for r in rows[1:]]), lambda e: e <= F.col("doc_id"))) if len(rows) > 1 else F.lit(0)
    cells = F.element_at(F.array(*[F.array(*[lit(v) for v in r]) for r in rows]), row + 1)
    return F.when(F.col("doc_id").isNull(), null).otherwise(NULL_PARTS + row * wide + F.size(F.filter(cells, lambda e: e <= F.col("doc_id")))).cast("int")


def with_successor(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, tie (md5 of the text), part, last of docs such that each part holds a run of ids and, marked last, the document after it; the number of parts."""
    rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("tie"))
    count = rows.count()
    ranged = rows.withColumn("part", _part(rows, count))
    # ids descend: the head of a part (its highest row) follows the end of the part above; the topmost head follows the lowest id
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    top = ranged.groupBy("part").agg(F.max(F.struct("doc_id", "tie")).alias("top"))  # MOST_PARTS + NULL_PARTS rows at most
    above = top.select(F.col("part").alias("p_"), "top", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("above"))
    heads = ranged.join(F.broadcast(above), (F.col("part") == F.col("p_")) & F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("tie") == F.col("top.tie")))
    heads = heads.groupBy("above").agg(F.first("text").alias("text"), F.first("tie").alias("tie"), F.first("doc_id").alias("doc_id"))
    copies = heads.select("doc_id", "text", "tie", F.col("above").alias("part"), F.lit(True).alias("last"))
    return ranged.withColumn("last", F.lit(False)).unionByName(copies), max(1, min(MOST_PARTS, count // PART_ROWS)) + NULL_PARTS


def edited_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = kind in ("bigint", "int", "smallint", "tinyint")  # pandas reads them as floats where one is null
    rows, parts = with_successor(docs)
    # a part to a task
    laid = rows.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("part"), F.col("last"), F.col("doc_id").desc_nulls_last(), F.col("tie").desc()).select("doc_id", "text", "part")

    def batch(ids: list, texts: list[str], nexts: list[str], own: list[np.ndarray]) -> pd.DataFrame:
        """own: signature sets of texts and, behind them, of the last text's successor."""
        edited = []
        for t, s in zip(texts, nexts, strict=True):
            k = len(t) // 3
            edited.append(t[: len(t) - k] + s[:k])
        changed = signature_sets(edited)
        return pd.DataFrame({
            "doc_id": pd.Series(ids, dtype=object), "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
            "fingerprint": [write(s) for s in own[:-1]], "edited_fingerprint": [write(s) for s in changed],
            "near_edited": [likeness(a, b) for a, b in zip(own, changed, strict=False)], "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ids, texts, sets = None, [], [], []

        def rest() -> Iterator[pd.DataFrame]:
            # all but the last text, whose successor is still to come
            if len(texts) > 1:
                sets.extend(signature_sets(texts[len(sets) :]))
                yield batch(ids[:-1], texts[:-1], texts[1:], sets)
                del ids[:-1], texts[:-1], sets[:-1]

        for b in batches:
            for i, t, p in zip(b["doc_id"], b["text"], b["part"], strict=True):
                if p != part:
                    yield from rest()
                    part, ids, texts, sets = p, [], [], []
                ids.append(None if pd.isna(i) else int(i) if whole else i)
                texts.append(t or "")
                if len(texts) > ROWS_AT_ONCE:
                    yield from rest()
        yield from rest()

    out = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return laid.mapInPandas(run, out)
