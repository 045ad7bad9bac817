"""Vectorised byte, word and shingle helpers; all work on whole Arrow batches of UTF-8 texts.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * _MIX1
    x ^= x >> U(27)
    x *= _MIX2
    x ^= x >> U(31)
    return x


def utf8_column(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, grown on demand and kept by each worker."""
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 2 * len(_POW), 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        _POW, _INV = (np.concatenate([[U(1)], np.full(m - 1, U(b))]).astype(np.uint64) for b in (_BASE, inv))
        with np.errstate(over="ignore"):
            _POW, _INV = np.multiply.accumulate(_POW), np.multiply.accumulate(_INV)
    return _POW, _INV


_POW, _INV = np.empty(0, np.uint64), np.empty(0, np.uint64)


def word_spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of each text) of the words in concatenated texts."""
    inside = ~SPACE[low]
    n = len(low)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of words by prefix sums of a polynomial, mixed with the length; ``step``: bytes that are summed at once."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, lo + step, "right")))
            part = low[lo : ends[j - 1]].astype(np.uint64) + U(1)
            pw, inv = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * pw[: len(part)], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
            i = j
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of every text, and their offsets.

    A text of fewer than k words, but at least one, has its whole word sequence as one shingle.
    """
    low = LOWER[raw]
    starts, ends, at = word_spans(low, offsets)
    h = word_hashes(low, starts, ends, 1 << 17)
    n_words = np.diff(at)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            acc = mix(acc * U(3) + h[j : j + len(acc)] + U(j + 1))
        sets, sizes = [], np.zeros(len(n_words), np.int64)
        for i, n in enumerate(n_words):
            a = at[i]
            if n >= k:
                s = np.unique(acc[a : a + n - k + 1])
            elif n:
                x = np.zeros(1, np.uint64)
                for j in range(n):
                    x = mix(x * U(3) + h[a + j] + U(j + 1))
                s = mix(x + U(0xABCD + int(n)))
            else:
                continue
            sets.append(s)
            sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def slices(batch: pa.RecordBatch, col: int, limit: int = 2 << 20):
    """Runs of rows of a batch whose texts have about ``limit`` bytes together, one row at least."""
    _, offsets = utf8_column(batch.column(col))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
