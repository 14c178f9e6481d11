"""Candidates that share no n-gram with the query."""

import difflib

from lexloom.operators import candidates
from tests.test_correction import ASKED, WORDS, frames, jac


def test_hybrid(spark):
    _, d = frames(spark)
    d = d.union(spark.createDataFrame([("x",), ("hxi",)], "word string"))
    words = [*WORDS, "x", "hxi"]
    asked = [*ASKED, "hi"]
    q = spark.createDataFrame([(a,) for a in asked], "query string")
    for weights in ((0.5, 0.5, 0.5), (0.1, 0.9, 0.5)):
        got = {(r.query, r.word): r.score for r in candidates.hybrid_candidates(q, d, 2, *weights).collect()}
        want = {}
        for a in asked:
            scored = {w: weights[0] * jac(a, w) + weights[1] * difflib.SequenceMatcher(None, a, w).ratio() for w in words}
            want |= {(a, w): s for w, s in scored.items() if s >= weights[2]} or {(a, a): 0.0}
        assert got == want
        assert got["x", "x"] == weights[1]


def test_soundex_ngram(spark):
    q = spark.createDataFrame([("bat",), ("bpd",)], "query string")
    d = spark.createDataFrame([("bed",), ("bid",), ("bats",), ("cat",), ("bpt",)], "word string")
    got = {(r.query, r.word, r.jaccard) for r in candidates.soundex_ngram(q, d).collect()}
    assert got == {("bat", "bed", 0.0), ("bat", "bid", 0.0), ("bpd", "bpt", 1 / 3)}
