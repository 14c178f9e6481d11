"""N-gram pairs go by blocks: what is exchanged are words and queries, not shared n-grams."""

import random

import pytest

from lexloom.operators import candidates, index, setjoin
from tests.test_correction import jac


@pytest.mark.parametrize("block", [7, 4096])
def test_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    monkeypatch.setattr(setjoin, "PAIRS", 50)
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("aabcé🎉") for _ in range(rng.randrange(0, 9)))
    words, asked = sorted({make() for _ in range(80)}), sorted({make().upper() for _ in range(30)})
    q, d = (spark.createDataFrame([(w,) for w in own], f"{c} string") for own, c in ((asked, "query"), (words, "word")))
    found = candidates.ngram_pairs(q, d)
    got = [(r.query, r.word, r.jaccard) for r in found.collect()]
    assert sorted(got) == sorted((a, w, jac(a.lower(), w)) for a in asked for w in words if jac(a.lower(), w))
    best = {(r.query, r.word) for r in setjoin.best_by_jaccard(q, d).collect()}
    assert best == {(a, w) for a, w, x in got if x == max(y for b, _, y in got if b == a)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "gram" not in plan


def test_words_are_exchanged_without_their_documents(spark):
    docs = spark.createDataFrame([(i, "the same words", "", "", "the same words") for i in range(5)], "Index long, Title string, Author string, bib_source string, Abstract string")
    assert sorted(r.word for r in index.words(docs).collect()) == ["same", "the", "words"]
    plan = index.words(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(word" in plan and "doc_id" not in plan
