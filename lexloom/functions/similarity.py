"""Similarity functions as Column expressions; one Arrow UDF where none can express it."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import split_words


def ngram_jaccard(a: Column, b: Column) -> Column:
    """Shared over united elements of two arrays of distinct elements; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def indel_distance(a: Column, b: Column) -> Column:
    """Edit distance with insertions and deletions of cost 1 and substitutions of cost 2.

    Equals both lengths less twice the longest common subsequence; the dynamic programme runs
    along b with one row of the table as its state.
    """
    letters_b = F.split(b, "")
    start = F.transform(F.sequence(F.lit(0), F.length(a)), lambda i: i)

    def row(above: Column, c: Column) -> Column:
        # State: the new row so far; its j-th entry from its left, upper and diagonal neighbours.
        first = F.array(F.get(above, 0) + 1)
        step = lambda acc, j: F.concat(
            acc,
            F.array(
                F.when(F.substring(a, j, F.lit(1)) == c, F.get(above, j - 1)).otherwise(F.least(F.get(above, j), F.get(acc, j - 1)) + 1)
            ),
        )
        return F.when(F.length(a) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), first, step)).otherwise(first)

    last = F.aggregate(F.filter(letters_b, lambda c: c != ""), start, row)
    return F.get(last, F.length(a))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as rows of one array, and their lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), max(1, sizes.max(initial=1))), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def matching_characters(a: list[str], b: list[str]) -> np.ndarray:
    """Characters in matching blocks of many pairs of words at once.

    All open intervals of all pairs are worked on together: one table of common endings, a letter of
    the first words at a time, gives each interval's longest block (the first in the first word, then in the
    second); what is left and right of it in both words are the next round's intervals.
    """
    (x, left), (y, right) = _codes(a), _codes(b)
    out = np.zeros(len(a), np.int64)
    own = np.flatnonzero((left > 0) & (right > 0))
    spans = np.stack([np.zeros(len(own), np.int64), left[own], np.zeros(len(own), np.int64), right[own]])
    while len(own):
        a0, a1, b0, b1 = spans
        # Intervals are moved to the beginning of their rows, so that tables are no larger than the longest.
        u, v = (rows[own[:, None], np.minimum(at[:, None] + np.arange((to - at).max()), rows.shape[1] - 1)] for rows, at, to in ((x, a0, a1), (y, b0, b1)))
        inside = np.arange(v.shape[1]) < (b1 - b0)[:, None]
        common, best, at, start = np.zeros((len(own), v.shape[1] + 1), np.int32), *(np.zeros(len(own), np.int64) for _ in range(3))
        for i in range(u.shape[1]):
            same = inside & (u[:, i : i + 1] == v) & (i < a1 - a0)[:, None]
            common[:, 1:] = np.where(same, common[:, :-1] + 1, 0)
            j = common.argmax(axis=1)
            n = common[np.arange(len(own)), j]
            more = n > best
            best, at, start = np.where(more, n, best), np.where(more, i + 1 - n, at), np.where(more, j - n, start)
        np.add.at(out, own, best)
        i, j = a0 + at, b0 + start
        rest = np.concatenate([np.stack([a0, i, b0, j]), np.stack([i + best, a1, j + best, b1])], axis=1)
        some = (np.concatenate([best, best]) > 0) & (rest[0] < rest[1]) & (rest[2] < rest[3])
        own, spans = np.concatenate([own, own])[some], rest[:, some]
    return out


#: From this length of the second word on, the definition leaves out its most frequent characters.
POPULAR = 200


@F.pandas_udf(T.DoubleType())
def ratcliff_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity 2 M / T, a first; not symmetric."""
    out = np.empty(len(a), np.float64)
    x, y = list(a), list(b)
    sizes = np.array([max(len(u), len(v)) for u, v in zip(x, y, strict=True)], np.int64)
    long = np.flatnonzero(sizes >= POPULAR)
    for i in long:
        out[i] = difflib.SequenceMatcher(None, x[i], y[i]).ratio()
    order = np.argsort(sizes, kind="stable")[: len(sizes) - len(long)]  # pairs of like length side by side
    for at in range(0, len(order), 4096):
        part = order[at : at + 4096]
        own = [[w[i] for i in part] for w in (x, y)]
        whole = np.array([len(u) + len(v) for u, v in zip(*own, strict=True)], np.float64)
        out[part] = np.where(whole > 0, 2.0 * matching_characters(*own) / np.maximum(whole, 1), 1.0)
    return pd.Series(out)


def blended(jaccard: Column, ratio: Column, ngram_weight: float = 0.5, edit_weight: float = 0.5) -> Column:
    return ngram_weight * jaccard + edit_weight * ratio


#: The letters of each digit of the phonetic code.
SOUND_LETTERS, SOUND_DIGITS = "BFPVCGJKQSXZDTLMNR", "111122222222334556"


def soundex_variant(word: Column) -> Column:
    """First character, then digits of the coded letters that differ from the digit last written; four long.

    Vowels don't part equal digits and the first letter's own digit doesn't hide the next, unlike in
    the built-in soundex.
    """
    up = F.upper(word)
    tail = F.translate(F.regexp_replace(F.substring(up, 2, 2**31 - 1), f"[^{SOUND_LETTERS}]", ""), SOUND_LETTERS, SOUND_DIGITS)
    runs = F.regexp_replace(tail, "([1-6])\\1+", "$1")
    return F.rpad(F.substring(F.concat(F.substring(up, 1, 1), runs), 1, 4), 4, "0")


def soundex_phrase(phrase: Column) -> Column:
    return F.transform(split_words(phrase), soundex_variant)
