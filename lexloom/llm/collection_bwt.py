"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

All strings are read from their ends at once.  Each round prepends one symbol to the current
suffix of every unfinished string and inserts these suffixes into the transform of the last round:
a new suffix c.S stands in the part of suffixes that start with c, after as many as there are c's
before S's place.  Its common prefix with the suffix before it is one more than the least common
prefix between S and the place of the c before; so with the one after it.  Transform and common
prefixes lie in two pairs of buffers that are read and written in order, one pair to the other, as
the external files of the method are.  The caller bounds a collection, so the buffers are held in
memory: a file of a task's own would lie in a machine-local folder, which a cluster's tasks shouldn't use.

No strings, or none but empty ones: transforms of ends alone, nothing repeated.  Equal strings are
told apart by their ends only, so all their substrings are repeated.
"""

from __future__ import annotations

import numpy as np


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]) of many ranges, each from two overlapping runs of a power of two."""
    power = np.frexp((high - low + 1).astype(np.float64))[1].astype(np.int64) - 1
    levels = [values]
    for k in range(int(power.max())):
        half = 1 << k
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    base = np.cumsum([0, *(len(x) for x in levels[:-1])])[power]
    flat = np.concatenate(levels)
    return np.minimum(flat[base + low], flat[base + high + 1 - (1 << power)])


def build(data: np.ndarray, offsets: np.ndarray):
    """(transform, common prefixes) of the strings data[offsets[i] : offsets[i + 1]] of unsigned numbers.

    Symbols are ranks of the numbers that occur, from 1; 0 ends a string, string i's end sorting as i.
    """
    m = len(offsets) - 1
    present, ranks = np.unique(data, return_inverse=True)
    kind = np.uint16 if len(present) < 65535 else np.uint32  # 16-bit symbols are sorted by counting
    symbols = (ranks + 1).astype(kind)
    lengths = np.diff(offsets)
    total = len(data) + m
    wide = np.uint8 if lengths.max(initial=0) < 255 else np.uint16 if lengths.max() < 65535 else np.uint32  # of a common prefix
    old, new = (np.zeros(total, kind) for _ in range(2))
    old_p, new_p = (np.zeros(total, wide) for _ in range(2))
    ends = offsets[1:] - 1
    old[:m] = np.where(lengths > 0, symbols[np.maximum(ends, 0)] if len(symbols) else 0, 0)
    n = m
    live = np.flatnonzero(lengths > 0)
    place = live.copy()  # of each unfinished string's current suffix
    left = lengths[live].copy()  # symbols not yet prepended
    rank = np.empty(total, np.int64)
    while len(live):
        now = old[:n]
        order = np.argsort(now, kind="stable")
        rank[order] = np.arange(n)
        counts = np.bincount(now, minlength=len(present) + 1)
        starts = np.concatenate(([0], np.cumsum(counts)))
        at = rank[place]  # in `order`
        by = np.argsort(at)
        live, place, left, at = live[by], place[by], left[by], at[by]
        c = now[place].astype(np.int64)
        before, after = np.flatnonzero(at > starts[c]), np.flatnonzero(at + 1 < starts[c + 1])
        low = np.concatenate((order[at[before] - 1] + 1, place[after] + 1))
        high = np.concatenate((place[before], order[at[after] + 1]))
        least = range_min(old_p[:n], low, high) + wide(1) if len(low) else np.empty(0, wide)
        prefix = np.zeros(len(c), wide)
        prefix[before] = least[: len(before)]
        # The ends of all m strings sort first; only those of finished ones are in `now` as 0.
        target = at + (m - counts[0])
        size = n + len(c)
        kept = np.ones(size, bool)
        kept[target] = False
        left -= 1
        following = np.where(left > 0, symbols[offsets[live] + np.maximum(left, 1) - 1], 0)
        new[:size][kept] = now
        new_p[:size][kept] = old_p[:n]
        new[target] = following
        new_p[target] = prefix
        new_p[target[after] + 1] = least[len(before) :]
        old, new, old_p, new_p, n, place = new, old, new_p, old_p, size, target
        going = left > 0
        live, place, left = live[going], place[going], left[going]
    return old[:n], old_p[:n]


def repeated_starts(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every substring of `length` symbols that starts elsewhere in the collection too, in no order."""
    m, lengths = len(offsets) - 1, np.diff(offsets)
    transform, prefixes = build(data, offsets)
    step = np.empty(len(transform), np.int64)
    step[np.argsort(transform, kind="stable")] = np.arange(len(transform))
    best = np.maximum(prefixes, np.append(prefixes[1:], prefixes[:1] * 0))
    strings, starts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    live, place, done = np.arange(m), np.arange(m), 0
    while len(live):
        if done >= length:
            hit = live[best[place] >= length]
            strings.append(hit)
            starts.append(lengths[hit] - done)
        going = lengths[live] > done
        live, place = live[going], step[place[going]]
        done += 1
    return np.concatenate(strings), np.concatenate(starts)
