import hashlib

import numpy as np

from lexloom.llm import order_minhash as omh


def brute(text):
    """The same hashes of elements, but with plain occurrence counting and full sorts."""
    e = omh.elements(text)
    out = []
    for f in omh._FUNCTIONS[:, 0]:
        values = e * f
        chosen = sorted(np.lexsort((np.arange(len(e)), values))[: omh.L])
        h = np.array([len(e) if len(e) <= omh.L else omh.L + 1], np.uint64)
        for i in chosen:
            h = omh.W.mix(h * omh._TUPLE + e[i])
        out.append(int(h[0] >> np.uint64(32)))
    return out


def test_fingerprint():
    rng = np.random.default_rng(1)
    for n in (0, 1, 11, 12, 13, 14, 40, 150, 5000):
        text = "".join(rng.choice(list("abcdé🎉"), n))
        assert list(omh.fingerprint(text)) == brute(text)
    a, b = "abcdefghij klmnopqrst uvwxyz " * 9, "uvwxyz klmnopqrst abcdefghij " * 9
    assert omh.likeness(omh.fingerprint(a), omh.fingerprint(a)) == 1
    assert omh.likeness(omh.fingerprint(a), omh.fingerprint(b)) < 1


def test_occurrences_count():
    e = omh.elements("x" * 40)
    assert len(set(e.tolist())) == len(e)


def test_queries(docs, rows):
    got = omh.fingerprints(docs).collect()
    order = sorted(((t or "", i) for i, t, *_ in rows), key=lambda x: (x[1] is None, -(x[1] or 0)))
    assert len(got) == len(rows)
    unique = [(t, i) for t, i in order if sum(j == i for _, j in order) == 1]
    following = {i: order[(k + 1) % len(order)] for k, (_, i) in enumerate(order)}
    ids = [i for _, i in order]
    for text, i in unique:
        nxt, j = following[i]
        if ids.count(j) > 1:
            continue
        third = len(text) // 3
        changed = text[: len(text) - third] + nxt[:third]
        r = next(r for r in got if r.doc_id == i)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = (omh.fingerprint(x) for x in (text, changed, nxt))
        assert (r.fingerprint, r.edited_fingerprint) == (a.tobytes().hex(), b.tobytes().hex())
        assert (r.near_edited, r.near_next) == (omh.likeness(a, b), omh.likeness(a, c))


def test_small_tables(spark, empty):
    assert omh.fingerprints(empty).count() == 0
    alone = omh.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
