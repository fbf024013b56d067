"""Terms of other alphabets than words: bytes outside an alphabet become spaces, the rest is scanned as words."""

from __future__ import annotations

import numpy as np

from . import textscan


def alphabet(*kept: tuple[int, int]) -> np.ndarray:
    """Maps bytes: those of the ranges (both ends included) and all of non-ASCII text stay, A-Z lower-cased; others become spaces."""
    out = np.full(256, 0x20, dtype=np.uint8)
    for first, last in (*kept, (0x80, 0xFF)):
        out[first : last + 1] = textscan.LOWER[first : last + 1]
    return out


LETTERS = alphabet((0x41, 0x5A), (0x61, 0x7A))
ALPHANUMERIC = alphabet((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def scan(offsets: np.ndarray, data: np.ndarray, i: int, j: int, table: np.ndarray) -> textscan.Words:
    """The terms of rows i to j."""
    base = offsets[i]
    return textscan.words(offsets[i : j + 1] - base, table[data[base : offsets[j]]], 0, j - i)


def profiles(w: textscan.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times, index of one occurrence) of each distinct term of each row, in order of row and hash."""
    order = np.lexsort((w.hash, w.row))
    r, h = w.row[order], w.hash[order]
    new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return r[new], h[new], np.diff(new, append=len(h)), order[new]
