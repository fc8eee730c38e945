"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Method. A BPE encoding is *locally decidable*: a token sequence is the encoding of its text exactly
when every adjacent pair (a, b) is the encoding of the two tokens' joined text, because a merge that
crosses a token boundary depends on nothing but the two tokens that meet there. So each prefix of a
text has one encoding and one last token. The table stores that last token per prefix: vocabulary
matches that end at the prefix (found by an Aho-Corasick automaton over the pieces) are tested in
turn; a match t is the one if it is the first token of the text or if it forms a valid
pair with the last token stored for the prefix that t leaves over. Ids are recovered from the end of
the table backwards. Pair tests run the merge rule on the pair's text alone and are memoized.

No piece of the model holds the space mark after another character, nor a line feed at all, so merges never cross the start
of a run of space marks or a line feed; texts are cut there and the table is built once per distinct chunk. The
chunk cache is bounded; results do not depend on it. It keeps a chunk's ids as text; a chunk whose ids decode to the chunk itself,
as nearly all do, needs no more.

Defined results: null is read as empty; an empty text has no ids and decodes to the empty text; an empty table gives an empty result;
characters outside the vocabulary become their UTF-8 byte pieces. Repeated rows give repeated
results; extra columns are ignored, whatever their names. Very long texts need memory in proportion to their length only.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, kept, lean, slices

MARK = "▁"
CACHE_ENTRIES = 200_000  # twice as many at most
PAIR_ENTRIES = 600_000


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodec:
    """Encoder and decoder for a BPE model with byte fallback, identity normalizer and dummy prefix."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        self.surface: list[str | int] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(int(piece[3:5], 16))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append("")
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.surface.append(piece.replace(MARK, " "))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the model has pieces that run on past a space mark; chunks can't be cut there")
        self.feeds_apart = not any("\n" in p for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            # with each piece, the tokens that have been tested before it and the outcome
            self.automaton.add_word(piece, (len(piece), piece, {}))
        self.automaton.make_automaton()
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        # a token made by a last merge of two others, each made before it: its halves
        self.halves: dict[str, tuple[str, str]] = {}
        self.regular = {p for p in self.ids if len(p) == 1}
        for piece in sorted(self.ids, key=len):
            made = self._last_merge(piece) if len(piece) > 1 else None
            if made and all(h in self.regular and (len(h) == 1 or self.score[h] > self.score[piece]) for h in made):
                self.halves[piece] = made
                self.regular.add(piece)
        self.tested = 0
        self.cache = Recent(CACHE_ENTRIES)

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two tokens whose merge is the last when a piece's own text is encoded; None if that isn't the piece."""
        steps: list[tuple[str, str]] = []
        return steps[-1] if self.merge(piece, steps) == [piece] else None

    def merge(self, text: str, steps: list[tuple[str, str]] | None = None) -> list[str]:
        """The merge rule itself: best-scored adjacent pair first, leftmost on ties. For short texts. steps collects the merges."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts):
                s = self.score.get(joined := parts[i] + parts[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, j, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str, known: dict[str, bool]) -> bool:
        """Whether the text of a followed by that of b encodes to just these tokens; a is empty at a text's start."""
        if self.tested >= PAIR_ENTRIES:
            for _, _, old in self.automaton.values():
                old.clear()
            self.tested = 0
        self.tested += 1
        if b in self.regular and (not a or a in self.regular):
            known[a] = ok = not a or self._stay_apart(a, b)
        else:
            known[a] = ok = self.merge(a + b) == ([a, b] if a else [b])
        return ok

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether no merge crosses from a to b while both are made.

        What ends at the border are the right halves of a, what starts there the left halves of b. Two of them stand side by
        side until the larger token of either is made, and merge if their own merge comes before both (on ties, the left one first).
        """
        score, halves = self.score, self.halves
        up_a = up_b = float("-inf")  # scores of the tokens that x and y go into
        x, y = a, b
        while True:
            own = score.get(x + y)
            if own is not None and own > up_a and own >= up_b:
                return False
            # step back to before the later of the two was made
            at_x = score[x] if x in halves else None
            at_y = score[y] if y in halves else None
            if at_x is None and at_y is None:
                return True
            if at_y is None or (at_x is not None and at_x <= at_y):
                up_a, x = at_x, halves[x][1]
            else:
                up_b, y = at_y, halves[y][0]

    def tokens(self, chunk: str) -> list[str]:
        """Tokens of a text by the prefix table; single characters outside the vocabulary stand for themselves."""
        last, filled = [""], 0
        for at, (size, piece, known) in self.automaton.iter(chunk):
            if at < filled:  # the last token of this prefix is known
                continue
            while filled < at:  # a character that no token ends in is a token of its own
                last.append(chunk[filled])
                filled += 1
            before = last[at + 1 - size]
            ok = known.get(before)
            if self.compatible(before, piece, known) if ok is None else ok:
                last.append(piece)
                filled += 1
        while filled < len(chunk):
            last.append(chunk[filled])
            filled += 1
        out, end = [], filled
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for t in self.tokens(chunk):
            i = self.ids.get(t)
            out.extend([i] if i is not None else (self.bytes[b] for b in t.encode("utf-8", "surrogatepass")))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces are joined and read as UTF-8, the dummy prefix's space is dropped."""
        return self._text("".join(self._parts(ids)))

    def _parts(self, ids: list[int]) -> Iterator[str]:
        run = bytearray()
        for i in ids:
            s = self.surface[i]
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                yield run.decode("utf-8", "replace")
                run.clear()
            yield s
        if run:
            yield run.decode("utf-8", "replace")

    @staticmethod
    def _text(joined: str) -> str:
        return joined[1:] if joined.startswith(" ") else joined

    def chunk(self, chunk: str) -> tuple[str, str]:
        """Ids as decimal text, and decoded text of a chunk."""
        ids = self.chunk_ids(chunk)
        return ",".join(map(str, ids)), "".join(self._parts(ids))

    def known(self, word: str) -> str | tuple[str, str]:
        """Ids as decimal text of a word without blanks, space mark before it unless it starts with a line feed; a pair with its decoded text if that isn't the word itself."""
        got = self.cache.find(word)
        if got is None:
            chunk = word if word.startswith("\n") else MARK + word
            if len(chunk) > 2 and chunk[-2:] not in self.joints:
                # no token joins the last two characters, so the last one stands apart
                front, last = self.cache.find(word[:-1]) or self.known(word[:-1]), self.ids.get(chunk[-1])
                got = f"{front},{last}" if last is not None and isinstance(front, str) else None
            if got is None:
                got = self.chunk(chunk)
                if got[1] == chunk.replace(MARK, " "):
                    got = got[0]
            if len(word) <= 64:
                self.cache.put(word, got)
        return got

    _cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def chunks(self, text: str) -> list[str]:
        return self._cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for c in self.chunks(text or "") for i in self.chunk_ids(c)]

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        marked = text.replace("\n", " \n") if self.feeds_apart else text
        if MARK in text or "  " in marked or text[0] in " \n" or text[-1] == " ":
            # runs of blanks are chunks with what follows them
            found = [self.chunk(c) for c in self.chunks(text)]
            ids = ",".join([x[0] for x in found])
            return ids.count(",") + 1, ids, self._text("".join([x[1] for x in found]))
        get, make = self.cache.get, self.known
        found = [get(w) or make(w) for w in marked.split(" ")]
        try:
            ids, decoded = ",".join(found), text
        except TypeError:  # a pair: some chunk decodes to something else
            words = marked.split(" ")
            ids = ",".join([x if isinstance(x, str) else x[0] for x in found])
            decoded = self._text("".join([(w if w.startswith("\n") else " " + w) if isinstance(x, str) else x[1] for w, x in zip(words, found, strict=True)]))
        return ids.count(",") + 1, ids, decoded


def codec(model_file: str | None) -> PieceCodec:
    """One codec a process; the public model's path is looked up where it is opened."""
    codecs = kept.setdefault("codecs", {})
    if model_file not in codecs:
        codecs[model_file] = PieceCodec(model_file or public_model())
    return codecs[model_file]


def encode_documents(docs: DataFrame, model_file: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every row; map-only."""
    path = model_file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in slices(batches):
            ids = [c.encode(t) for t in b["t"]]
            yield pd.DataFrame({doc_id: b["i"], "ids": ids, "decoded": [c.decode(x) for x in ids]})

    return _narrow(docs, doc_id, text).mapInPandas(lean("piece_codec", run), f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, model_file: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; map-only."""
    path = model_file

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for b in slices(batches):
            found = [(n, digest(ids), digest(decoded)) for n, ids, decoded in map(c.round_trip, b["t"])]
            yield pd.DataFrame({doc_id: b["i"], "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]})

    return _narrow(docs, doc_id, text).mapInPandas(lean("piece_codec", run), f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
