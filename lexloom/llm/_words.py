"""Hashes of all words of many texts at once, in numpy over Arrow's UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_R = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser); works on a copy."""
    x = x ^ (x >> U(30))
    x *= _A
    x ^= x >> U(27)
    x *= _B
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), U(base & (2**64 - 1)))
        got[0] = U(1)
        got = np.cumprod(got, dtype=np.uint64)
        _powers[base] = got
    return got[:n]


_RINV = pow(_R, -1, 2**64)


def _byte_table(fold: bool) -> np.ndarray:
    table = mix((np.arange(256, dtype=np.uint64) + U(1)) * U(_R))
    if fold:
        table[65:91] = table[97:123]
    return table


FOLDED, PLAIN = _byte_table(True), _byte_table(False)

#: Words of the shingle operators: runs of bytes that are neither space nor \x09-\x0D.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words of the classifiers: runs of ASCII letters and of bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def prefix_sums(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """n + 1 sums S with S[j] - S[i] = sum of table[byte k] * R^k over i <= k < j, modulo 2^64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(_R, len(data)), out=sums[1:])
    return sums


def ranges_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand."""
    inverse = powers(_RINV, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of texts laid end to end: start, end, number of its text."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = kind[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
