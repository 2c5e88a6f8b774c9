"""Word, line and shingle hashing over Arrow string buffers with numpy, without Python strings.

A span's hash is the sum over its bytes of (folded byte + 1) times a random odd-or-even 64-bit
coefficient of the byte's position, then mixed: a universal hash, so that two different spans
collide with a chance of about 2**-57 or less. Everything is a pure function of the bytes, alike
in every worker and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Bytes that are hashed at once, whatever the length of a row.
HASHED_BYTES = 1 << 22
_PERIOD = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def coefficients(seed: int, n: int = _PERIOD) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_COEF = {seed: coefficients(seed) for seed in (1, 2)}
_POW = {seed: coefficients(seed + 77, 4096) | U64(1) for seed in (1, 2)}
for _power in _POW.values():
    _power[0] = 1

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All but ASCII letters, digits and bytes of multi-byte characters.
IS_PUNCT = np.ones(256, bool)
IS_PUNCT[48:58] = IS_PUNCT[65:91] = IS_PUNCT[97:123] = IS_PUNCT[128:] = False


#: What workers keep between tasks; an operator drops what others have kept.
KEPT: list[dict] = []


def kept() -> dict:
    KEPT.append({})
    return KEPT[-1]


def release(own: dict | None = None) -> None:
    for cache in KEPT:
        if cache is not own:
            cache.clear()


class Block(NamedTuple):
    """Rows ``first`` to ``first + len(starts)`` of a column: their bytes, and each row's start and end."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Spans(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Block]:
    """Cut a string column (null: empty) into blocks of about ``limit`` bytes; a longer row is a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        base = offs[i]
        yield Block(i, data[base : offs[j]], offs[i:j] - base, offs[i + 1 : j + 1] - base)
        i = j


def words(b: Block, sep: np.ndarray = IS_SPACE) -> Spans:
    """Maximal runs of bytes that are no separators; no run crosses rows."""
    if not len(b.data):
        z = np.zeros(0, np.int64)
        return Spans(z, z, z)
    inside = ~sep[b.data]
    cut = np.zeros(len(b.data) + 1, bool)
    cut[b.starts] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start = np.flatnonzero(begins)
    return Spans(np.searchsorted(b.starts, start, "right") - 1, start, np.flatnonzero(last) + 1)


def lines(b: Block) -> tuple[Spans, Spans]:
    """Lines (split at \\n; an empty row is one empty line), and the same without white space at both ends."""
    n = len(b.starts)
    nl = np.flatnonzero(b.data == 10)
    start = np.sort(np.concatenate([b.starts, nl + 1]), kind="stable")
    end = np.sort(np.concatenate([b.ends, nl]), kind="stable")
    per_row = np.searchsorted(nl, b.ends) - np.searchsorted(nl, b.starts) + 1
    row = np.repeat(np.arange(n), per_row)
    solid = np.flatnonzero(~IS_SPACE[b.data])
    if not len(solid):
        return Spans(row, start, end), Spans(row, start, start)
    lo = np.searchsorted(solid, start)
    hi = np.searchsorted(solid, end)
    some = hi > lo
    first = np.where(some, solid[np.minimum(lo, len(solid) - 1)], start)
    final = np.where(some, solid[np.maximum(hi - 1, 0)] + 1, start)
    return Spans(row, start, end), Spans(row, first, final)


def hash_spans(b: Block, s: Spans, seed: int = 1, fold: np.ndarray = ASCII_LOWER) -> np.ndarray:
    """A 64-bit hash of each span's folded bytes; an empty span hashes alike everywhere."""
    size = (s.end - s.start).astype(np.int64)
    out = np.zeros(len(size), U64)
    edge = np.concatenate([[0], np.cumsum(size)])
    for lo in range(0, int(edge[-1]), HASHED_BYTES):
        hi = min(int(edge[-1]), lo + HASHED_BYTES)
        spans = np.arange(np.searchsorted(edge, lo, "right") - 1, np.searchsorted(edge, hi, "left"))
        skip = np.maximum(lo - edge[spans], 0)
        n = np.minimum(edge[spans + 1], hi) - edge[spans] - skip
        spans, skip, n = spans[n > 0], skip[n > 0], n[n > 0]
        at = np.cumsum(n) - n
        rel = np.arange(hi - lo, dtype=np.int64) - np.repeat(at - skip, n)
        byte = fold[b.data[rel + np.repeat(s.start[spans], n)]].astype(U64) + U64(1)
        coef = _COEF[seed][rel & (_PERIOD - 1)]
        if int((n + skip).max()) > _PERIOD:
            coef = coef * _POW[seed][(rel >> 15) & 4095]
        out[spans] += np.add.reduceat(byte * coef, at)
    return mix(out + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the index of each one's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    out = np.zeros(m, U64)
    for k in range(n):
        out += h[k : k + m] * _COEF[2][k]
    return mix(out[at]), at


def arrow_list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
