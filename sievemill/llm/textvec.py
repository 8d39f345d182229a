"""Vectorised text primitives over Arrow string buffers: words, prefix hashes, shingles.

Everything works on UTF-8 bytes. A batch of texts is one uint8 array with offsets; it is cut at
document borders into chunks of a bounded number of bytes, so that temporary arrays stay small
however many documents a batch holds (one longer document is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U64 = np.uint64
BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = True
WORD[128:] = True
#: [\x20\x09-\x0D], the white space of the contracts.
SPACE = np.zeros(256, dtype=bool)
SPACE[9:14] = SPACE[32] = True

_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i in 0..n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            factors = np.full(n + 1, base, U64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of uint64 values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes: out[i] = sum of (values[j] + 1) * BASE**j for j < i."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=out[1:])
    return out


def span_hash(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the spans [a, b), alike for equal content at any place of any chunk."""
    _, down = powers(len(h))
    return (h[b] - h[a]) * down[a]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets) of pieces with at most limit bytes or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; no run crosses an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, lower-cased in ASCII: starts, ends, document of each, 64-bit hashes."""
    low = LOWER[data]
    a, b = runs(WORD[low], offsets)
    doc = np.searchsorted(offsets, a, side="right") - 1
    return a, b, doc, mix(span_hash(prefix(low), a, b) + (b - a).astype(U64))


def doc_slices(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each document's items in an array that is ordered by document."""
    return np.searchsorted(doc, np.arange(n + 1))


def shingles(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k-word shingles, their documents, and the word at which each starts.

    A document with 1 to k - 1 words has a single shingle of all its words.
    """
    n = len(word_hash)
    at = doc_slices(doc, n_docs)
    sizes = np.diff(at)
    out = np.zeros(max(0, n - k + 1), U64)
    for i in range(k if n >= k else 0):
        out += mix(word_hash[i : n - k + 1 + i] + U64(i + 1))
    whole = doc[: n - k + 1] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
    h, d, w = mix(out[whole]), doc[: n - k + 1][whole] if n >= k else doc[:0], np.flatnonzero(whole)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = np.array([mix(np.array([sum(int(x) for x in mix(word_hash[at[s] : at[s + 1]] + np.arange(1, sizes[s] + 1).astype(U64))) % (1 << 64)], U64))[0] for s in short], U64)
        h, d, w = np.concatenate([h, extra]), np.concatenate([d, short]), np.concatenate([w, at[short]])
        order = np.argsort(d, kind="stable")
        h, d, w = h[order], d[order], w[order]
    return h, d, w
