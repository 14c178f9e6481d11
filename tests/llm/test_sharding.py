import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm.sharding import Feistel, shard


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    f = Feistel(n, 3)
    there = f.forward(np.arange(n))
    assert sorted(there) == list(range(n))
    assert (f.inverse(there) == np.arange(n)).all()


def scrambled(x):
    """The 64-bit finaliser, in plain integers."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def permuted(number, n, seed):
    """Cycle walking through a network of six rounds on the two halves of a number."""
    half = 1
    while 4**half < n:
        half += 1
    keys = [scrambled((i * 0xD1342543DE82EF95 + seed) % 2**64) for i in range(1, 7)]
    while True:
        left, right = divmod(number, 2**half)
        for key in keys:
            left, right = right, left ^ scrambled((right + key) % 2**64) % 2**half
        number = left * 2**half + right
        if number < n:
            return number


@pytest.mark.parametrize(("n", "seed"), [(1, 0), (5, 9), (16, 1), (1000, 20240501)])
def test_feistel_by_hand(n, seed):
    assert Feistel(n, seed).forward(np.arange(n)).tolist() == [permuted(i, n, seed) for i in range(n)]


def test_shard_by_hand(spark):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)]
    got = {r.doc_id: (r.shard, r.slot) for r in shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 24, seed=3).collect()}
    assert got == {i: (permuted(i, 101, 3) % 24, permuted(i, 101, 3) // 24) for i in range(101)}


def test_shard(docs, rows):
    got = shard(docs, 7).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 7 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = shard(docs.repartition(5), 7).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, again), key=repr) == sorted(map(key, got), key=repr)


def test_empty(empty):
    assert shard(empty).count() == 0
