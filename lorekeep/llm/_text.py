"""Vectorised work on Arrow string batches: words and their hashes without one Python string per word.

A batch's UTF-8 bytes are taken as one array. Words are maximal runs of bytes outside space and 0x09-0x0D, so no UTF-8
sequence is ever split. Hashes are 64-bit polynomial prefix sums, finished by a mixing step; A-Z count as a-z if asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes of text taken at once; a longer document is taken alone.
CHUNK = 300_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, U)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about size bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; data holds just the rows' bytes and offsets begin at 0."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _IS_WORD[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:] & ~first[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, U)
    b = _LOWER[data] if lower else data
    sums = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * _powers(_P, len(b)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(_P_INV, len(b))[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of k words of a row; a row with fewer words has its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    h = np.zeros(max(len(words) - k + 1, 0), U)
    for j in range(k):
        h = h * U(0x2545F4914F6CDD1D) + words[j : j + len(h)]
    same = rows[: len(h)] == rows[k - 1 :] if len(h) else np.zeros(0, bool)
    at, out = rows[: len(h)][same], mix(h[same])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        extra = np.full(len(short), 0x51, U) + counts[short].astype(U)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = extra[has] * U(0x2545F4914F6CDD1D) + words[first[has] + j]
        at, out = np.concatenate([at, short]), np.concatenate([out, mix(extra)])
    return at, out


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of rows: (first row, last row, row of each entry counted from the first, hash): distinct, sorted by row and hash."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = word_bounds(part, off)
        at, h = shingles(word_hashes(part, starts, ends), rows, b - a, k)
        order = np.lexsort((h, at))
        at, h = at[order], h[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        yield a, b, at[keep], h[keep]
