"""Hashes over whole Arrow columns: bytes, words and word shingles, without a Python loop per text.

The 64-bit hashes are seeded by rule and alike on every executor. Two different strings of a corpus share a hash with a
chance of about 2**-64 a pair. The sums are polynomials modulo 2**64, so strings that are made for the purpose can share
one: Thue-Morse words of 1,024 letters and more do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed in one go; a longer text goes by itself.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(BASE))
#: ASCII letters and digits, and every byte of a non-ASCII character, make up words.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Any byte but white space makes up words.
MARKED = np.ones(256, dtype=bool)
MARKED[[32, *range(9, 14)]] = False
#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + (1 << 16))
        found = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, dtype=U)
            p[0] = 1
            found.append(np.multiply.accumulate(p))
        _powers[:] = found
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any [start, end) of a sequence in constant time each."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * power[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE):
    """Row ranges [i, j) of at most size bytes, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the index of each text's first word. kind tells which bytes make up words."""
    inside = kind[data]
    before = np.concatenate(([False], inside[:-1]))
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.concatenate((inside[1:], [False]))
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return mix(Rolling(BYTE[data]).of(starts, ends) + (ends - starts).astype(U)), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the index of each text's first run.

    With short, a text of one to k - 1 words has one run of all of them.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1) if short else 0)
    begin = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(begin[-1]) - begin[row] + first[row]
    padded, stubs = np.concatenate((hashes, np.zeros(k, dtype=U))), bool(short and (n < k).any())
    out = np.zeros(len(at), dtype=U)
    for i in range(k):
        x = padded[at + i]
        out = (out + (np.where(i < n[row], x, U(0)) if stubs else x)) * U(BASE)
    return mix(out), begin


def lowered(column):
    return pc.utf8_lower(column.cast(pa.large_string()))
