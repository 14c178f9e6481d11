import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lexloom.llm.importance_resampling import resample

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(r[0], *found(r[1], n)) for r in rows]
    s = Counter(bucket(f) for *_, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in found(x, n)[1])
    a, b = s.total() + buckets, t.total() + buckets
    gain = lambda i: math.floor(1000 * math.log(((t[i] + 1) * a) / ((s[i] + 1) * b)))
    out = []
    for doc, words, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = percent * len(able) // 100
    ranked = [(*r, i + 1 if i < drawn else None) for i, r in enumerate(able)]
    return Counter((r[0], *r[2:]) for r in [*ranked, *((*r, None) for r in out if r[1] < least)])


@pytest.mark.parametrize(("n", "buckets", "percent", "least", "block"), [(1, 10_000, 10, 20, 1 << 24), (3, 97, 60, 3, 4000), (2, 1000, 100, 0, 1)])
def test_by_brute_force(spark, docs, rows, n, buckets, percent, least, block):
    """One dictionary a task, many, and one for each text or so give the same."""
    target = [rows[3][1], None, "", "released under the mit license", rows[8][1]]
    aim = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, name string")
    got = resample(docs, aim, n, buckets, percent, least, block=block)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, target, n, buckets, percent, least)


def test_words_are_told_apart(spark):
    """Abutting texts, several separators between words and folded letters only of ASCII."""
    texts = ["ab", "cd ab", "AB--Ab ÀB àb", "x" * 70 + " 漢字 1a", "", "ab"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = Counter(tuple(r) for r in resample(frame, frame.limit(2), 2, 50, 50, 1).collect())
    assert got == brute(list(enumerate(texts)), texts[:2], 2, 50, 50, 1)


def test_no_rows(spark, docs, empty, rows):
    aim = docs.limit(0)
    assert Counter(tuple(r) for r in resample(docs, aim, 1, 100).collect()) == brute(rows, [], 1, 100, 10, 20)
    assert resample(empty, docs, 1, 100).count() == 0
