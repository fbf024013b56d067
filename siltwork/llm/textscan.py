"""Vectorised word scanning of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only. A word is known by
a 64-bit hash of its bytes. Everything works on bytes of UTF-8 (all separators
are ASCII), in slices of a bounded number of bytes, a longer text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SEP = np.zeros(256, dtype=bool)
IS_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE[IS_SEP] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(256, 1 << (n - 1).bit_length())
        _powers = np.full(size, _STEP, dtype=np.uint64)
        _powers[0] = 1
        _powers = np.cumprod(_powers, dtype=np.uint64)
    return _powers[:n]


@dataclass
class Words:
    """Words of some rows; ``row`` is non-decreasing, ``per_row`` counts words by row."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    per_row: np.ndarray
    hash: np.ndarray


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return offsets, data


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(offsets: np.ndarray, data: np.ndarray, i: int, j: int) -> Words:
    """The words of rows i to j."""
    base = offsets[i]
    b = LOWER[data[base : offsets[j]]]
    n = len(b)
    first = offsets[i:j] - base
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(b, none, none, none, np.zeros(j - i, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    inside = ~IS_SEP[b]
    cut = np.zeros(n + 1, dtype=bool)
    cut[first] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    row = np.searchsorted(first, start, side="right") - 1
    per_row = np.bincount(row, minlength=j - i)
    if not len(start):
        return Words(b, start, end, row, per_row, np.zeros(0, dtype=np.uint64))
    lead = start[0]
    span = np.diff(start, append=n)
    at = np.arange(lead, n) - np.repeat(start, span)
    code = _BYTE_CODE[b[lead:]] * powers(int(span.max()) + 1)[at]
    h = mix(np.add.reduceat(code, start - lead) + (end - start).astype(np.uint64) * _STEP)
    return Words(b, start, end, row, per_row, h)


def rows_of(per_row: np.ndarray) -> np.ndarray:
    """Where each row's words begin."""
    return np.concatenate(([0], np.cumsum(per_row)))


_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words; a row with fewer words gives its whole sequence once."""
    n = len(w.hash)
    begin = rows_of(w.per_row)
    short = np.flatnonzero((w.per_row > 0) & (w.per_row < width))
    out = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        out += mix(w.hash[k : n - width + 1 + k] ^ _SHINGLE[k % len(_SHINGLE)]) * (_SHINGLE[(k + 1) % len(_SHINGLE)] + np.uint64(2 * k))
    whole = w.row[: len(out)] == w.row[width - 1 :] if len(out) else np.zeros(0, dtype=bool)
    rows, hashes = w.row[: len(out)][whole], mix(out[whole])
    if len(short):
        extra = np.empty(len(short), dtype=np.uint64)
        for k, r in enumerate(short):
            own = w.hash[begin[r] : begin[r + 1]]
            extra[k] = (mix(own ^ _SHINGLE[:1]) * powers(len(own) + 1)[1:]).sum(dtype=np.uint64) + np.uint64(len(own))
        rows, hashes = np.concatenate((rows, short)), np.concatenate((hashes, mix(extra)))
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    return rows, hashes
