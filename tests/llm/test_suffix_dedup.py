import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexloom.llm import suffix_dedup
from lexloom.llm.collection_bwt import build, repeated_starts


def collections():
    rng = np.random.default_rng(2)
    for _ in range(25):
        yield [bytes(rng.integers(97, 100, rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]


def laid(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64)


def test_build():
    for strings in collections():
        transform, prefixes = build(*laid(strings))
        # Ends sort before all bytes, in the order of the strings; they are equal to nothing.
        suffixes = sorted(([*(b + 10**6 for b in s[i:]), k], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        present = sorted(set(b"".join(strings)))
        assert transform.tolist() == [0 if i == 0 else present.index(strings[k][i - 1]) + 1 for _, k, i in suffixes]
        want = [0]
        for (a, _, _), (b, _, _) in zip(suffixes, suffixes[1:], strict=False):
            want.append(next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b))))
        assert prefixes.tolist() == want


def test_repeated_starts():
    for strings in collections():
        for n in (1, 2, 5):
            seen = Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
            want = [[i for i in range(len(s) - n + 1) if seen[s[i : i + n]] > 1] for s in strings]
            string, start = repeated_starts(*laid(strings), n)
            assert [sorted(start[string == i].tolist()) for i in range(len(strings))] == want


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = Counter()
    kept_texts = []
    for (doc, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        kept_texts.append(kept)
        out[doc, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out, kept_texts


@pytest.mark.parametrize(("length", "collection"), [(400, 1 << 20), (200, 300)])
def test_cut(docs, rows, monkeypatch, length, collection):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    got = Counter(tuple(r) for r in suffix_dedup.cut_digests(docs, length).collect())
    want, kept = brute(rows, length)
    assert got == want
    texts = suffix_dedup.cut_texts(docs, length)
    assert texts.schema == docs.schema
    assert {(r[0], *r[2:]) for r in texts.collect()} == {(r[0], *r[2:]) for r in rows}
    assert Counter(r.text or "" for r in texts.collect()) == Counter(k.decode("utf-8", "ignore") for k in kept)


def test_runs_of_starts_cross_chunks():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 103, n).astype(np.uint8)) for n in (0, 5, 90, 300, 64, 1000, 70)]
    for chunk in (37, 256, 1 << 20):
        before, suffix_dedup.CHUNK = suffix_dedup.CHUNK, chunk
        data, offsets = laid(texts)
        seen = {64: Counter(), 80: Counter()}
        for length, whose, first, counts, anchors, s, _, _ in suffix_dedup.runs(data, offsets, (80, 64)):
            for t, a, n, anchor in zip(whose, first, counts, anchors, strict=True):
                for at in range(a, a + n):
                    assert at <= anchor <= at + length - suffix_dedup.K
                    seen[length][int(t), int(at + s - offsets[t])] += 1
        suffix_dedup.CHUNK = before
        assert all(seen[n] == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x) - n + 1)) for n in seen)


def test_merged():
    rng = np.random.default_rng(4)
    lists = [[{"length": int(rng.integers(1, 3)), "a": int(a), "b": int(a + rng.integers(1, 20))} for a in rng.integers(0, 60, rng.integers(0, 9))] for _ in range(50)] + [None, []]
    kind = pa.list_(pa.struct([("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))
    row, a, b = suffix_dedup.merged(pa.array(lists, kind), 2)
    got = [[] for _ in lists]
    for r, x, y in zip(row, a, b, strict=True):
        got[r].append((x, y))
    for own, spans in zip(lists, got, strict=True):
        covered = {i for s in own or [] if s["length"] == 2 for i in range(s["a"], s["b"])}
        assert {i for x, y in spans for i in range(x, y)} == covered
        assert all(y < z for (_, y), (z, _) in zip(spans, spans[1:], strict=False))


def test_shorter_strings_beside(docs, rows):
    got = Counter(tuple(r) for r in suffix_dedup.cut_digests(docs, 400, shorter=200).collect())
    shared = sorted((doc, n, removed) for (doc, n, removed, _, _), c in brute(rows, 200)[0].items() for _ in range(c) if doc is not None)
    assert sorted((r[0], r[1], r[5]) for r, c in got.items() for _ in range(c) if r[0] is not None) == shared
    assert Counter({k[:5]: 0 for k in got}).keys() == brute(rows, 400)[0].keys()


def test_nothing_but_the_transform_removes(docs, monkeypatch):
    none = lambda data, offsets, length: (np.empty(0, np.int64), np.empty(0, np.int64))
    string, start = suffix_dedup.repeated_starts(*laid([b"abcdefghij", b"xabcdefghi"]), 8)
    assert sorted(zip(string, start, strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2)]
    monkeypatch.setattr(suffix_dedup, "repeated_starts", none)
    core = np.array([5, 5, 5], np.uint64)
    sides = np.full(3, (7 << 56) + 0x61626364656667, np.uint64)
    assert not suffix_dedup._repeated(core, sides, sides, np.array([1, 2, 1])).any()
    monkeypatch.undo()
    assert suffix_dedup._repeated(core, sides, sides, np.array([1, 2, 1])).tolist() == [255] * 3


def test_empty(empty):
    assert suffix_dedup.cut_digests(empty).count() == 0
    assert suffix_dedup.cut_texts(empty).count() == 0
