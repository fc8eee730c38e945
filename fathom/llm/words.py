"""Words of many texts at once as 64-bit hashes, by prefix sums over their bytes.

Null texts have no words; texts are worked off in chunks of some megabytes, a longer one in a chunk of its own; equal words have equal hashes.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_table: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_table, default=0)
    if size < n:
        _table.clear()
        size = 1 << (n - 1).bit_length()
        _table[size] = _powers(size, _STEP), _powers(size, _INVERSE)
    return _table[size]


def word_hashes(texts: list[str | None], is_word: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text by text, and the offsets at which each text's words begin (one more than texts).

    is_word: for each byte of UTF-8, whether it is part of a word. fold: for each byte, what it is read as.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, dtype=np.int64)
    lo = 0
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) + 1 <= _CHUNK):
            size += len(raw[hi]) + 1
            hi += 1
        b = np.frombuffer(b" ".join(raw[lo:hi]) + b" ", dtype=np.uint8)
        inside = is_word[b]
        inside[np.cumsum([len(r) + 1 for r in raw[lo:hi]]) - 1] = False
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        up, down = _power_tables(len(b) + 1)
        with np.errstate(over="ignore"):
            v = (b if fold is None else fold[b]).astype(np.uint64) + np.uint64(1)
            v *= up[: len(b)]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])
            h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        hashes.append(h)
        ends = np.cumsum([len(r) + 1 for r in raw[lo:hi]])
        counts[lo + 1 : hi + 1] = np.searchsorted(start, ends)
        counts[lo + 1 : hi + 1] += counts[lo]
        lo = hi
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def byte_class(separators: bytes) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


def ascii_lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def windows(h: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words within each text, and their offsets."""
    per = np.maximum(np.diff(starts) - n + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(per)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], per) + np.repeat(starts[:-1], per)
    with np.errstate(over="ignore"):
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(3) + h[at + k])
    return out, offsets
