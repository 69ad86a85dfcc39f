"""Word and shingle hashing over Arrow string columns, vectorised with numpy.

A word is a maximal run of bytes outside space and ``\\x09-\\x0d``; A-Z are
lower-cased first.  Each word becomes a 64-bit polynomial hash, each window of
``k`` words a 64-bit shingle.  Two different shingles of a corpus share a
fingerprint with a chance of about 2**-64 per pair.

Texts are hashed in slices of about ``SLICE`` bytes so that a worker needs a
bounded amount of memory; only a single text longer than that makes a slice
larger (about 60 bytes per byte of that text).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 20
_P = U64(0x9E3779B97F4A7C15 | 1)
_P_INV = U64(pow(int(_P), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit constants for ``seed``."""
    return mix64(U64(seed * 0xD1342543DE82EF95 % 2**64) + np.arange(1, n + 1, dtype=U64) * _P)


_BYTES = stream(1, 256)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each slice."""
    raw, offsets = buffers(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        yield at, min(to, n), raw[offsets[at] : offsets[min(to, n)]], offsets[at : min(to, n) + 1] - offsets[at]
        at = min(to, n)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice and, per text, where its words begin (with the end appended)."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < n]
    first[begins] |= inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= inside[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(max(SLICE * 2, 1 << int(n - 1).bit_length()) if n > 1 else SLICE * 2)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTES[raw] * up[:n], out=sums[1:])
    return mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(U64)), np.searchsorted(s, offsets)


def shingles(words: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``k``-word shingles in order, and where each text's begin.

    A text of 1 to k-1 words has its whole sequence as one shingle; one
    without words has none.
    """
    n = np.diff(starts)
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    if not at[-1]:
        return np.zeros(0, U64), at
    odd = stream(2, k) | U64(1)
    padded = np.concatenate([words, np.zeros(k, U64)])
    full = sum((padded[j : j + len(words)] * odd[j] for j in range(k)), start=np.zeros(len(words), U64))
    own = np.repeat(starts[:-1] - at[:-1], counts) + np.arange(at[-1])
    out = full[own]
    for d in np.flatnonzero((n > 0) & (n < k)):
        w = words[starts[d] : starts[d + 1]]
        out[at[d]] = np.sum(w * odd[: len(w)]) + U64(len(w))
    return mix64(out), at
