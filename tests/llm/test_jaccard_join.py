import re
import time
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import components, jaccard_join


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def groups(rows, k, percent):
    """Sets, and the number of each row's component."""
    sets = [shingles(r[1], k) for r in rows]
    label = list(range(len(rows)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def brute(rows, k, percent):
    sets, label = groups(rows, k, percent)
    least = {}
    for r, c in zip(rows, label, strict=True):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return Counter((r[0], len(s), least.get(c) if s else r[0]) for r, s, c in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components(docs, rows, k, percent):
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(docs, k, percent).collect())
    assert got == brute(rows, k, percent)


def near_copies(seed=4, size=160):
    """One group of near copies whose similarities lie on both sides of the threshold, and a shared passage."""
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for i in range(size):
        own = list(base)
        for _ in range(rng.randrange(9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append((i, " ".join(own)))
    passage = " ".join(rng.choice(words) for _ in range(60))
    return out + [(1000 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))) + " " + passage) for i in range(60)]


@pytest.mark.parametrize(("limit", "small"), [(1 << 21, 1 << 20), (2000, 0)])
def test_one_hot_group(spark, monkeypatch, limit, small):
    """Whole clusters in a task, and clusters cut into blocks with components by stars."""
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    monkeypatch.setattr(components, "SMALL", small)
    rows = near_copies()
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 5, 80).collect())
    want = brute(rows, 5, 80)
    assert 3 < len({c for _, _, c in want if c < 1000}) < 150
    assert got == want


def test_keep_one(docs, rows):
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.schema == docs.schema
    assert {tuple(r) for r in kept.collect()} <= set(rows)
    all_sets, label = groups(rows, 5, 80)
    got = kept.collect()
    sets = Counter((r.doc_id, shingles(r.text, 5)) for r in got if shingles(r.text, 5))
    assert max(sets.values()) == 1
    assert len(sets) == len({c for s, c in zip(all_sets, label, strict=True) if s})
    assert sum(not shingles(r.text, 5) for r in got) == sum(not shingles(r[1], 5) for r in rows)


def test_empty(empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


@pytest.mark.parametrize("sides", [False, True])
def test_forest(sides):
    """Components of sets in one task, by all pairs."""
    rng = np.random.default_rng(3)
    for percent in (50, 80, 100):
        base = [rng.choice(400, rng.integers(1, 40), replace=False) for _ in range(25)]
        sets = [np.unique(np.where(rng.random(len(b)) < rng.choice([0, 0.1, 0.4]), rng.integers(0, 400, len(b)), b)) for b in base for _ in range(8)]
        n, tokens = np.array([len(x) for x in sets]), np.concatenate(sets).astype(np.uint64)
        side = rng.integers(0, 2, len(sets)) if sides else None
        label = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both) and (side is None or side[i] != side[j]):
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
        assert jaccard_join.forest(tokens, n, percent, side).tolist() == label


def test_forest_of_many_unlinked_sets():
    """What a cluster holds without links costs in proportion to its size."""
    rng, took = np.random.default_rng(5), []
    for size in (20_000, 80_000):
        sets = np.sort(rng.integers(0, 2**62, (size, 5)), axis=1).astype(np.uint64)
        began = time.process_time()
        assert (jaccard_join.forest(sets.ravel(), np.full(size, 5), 80) == np.arange(size)).all()
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1
