import random

import pytest

from lexloom.operators import boolean

DOCS = {1: "a b", 2: "a c", 3: "b", 4: "c d"}


@pytest.fixture(scope="module")
def post(spark):
    return spark.createDataFrame([(t, i) for i, ts in DOCS.items() for t in ts.split()], "term string, doc_id long")


def brute(tree):
    if isinstance(tree, str):
        return {i for i, ts in DOCS.items() if tree in ts.split()}
    if tree[0] == "NOT":
        return set(DOCS) - brute(tree[1])
    left, right = brute(tree[1]), brute(tree[2])
    return left & right if tree[0] == "AND" else left | right


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("a AND b OR c", ("AND", "a", ("OR", "b", "c"))),
        ("NOT a AND b", ("NOT", ("AND", "a", "b"))),
        ("a AND NOT b", ("AND", "a", ("NOT", "b"))),
        ("( a OR b ) AND c", ("AND", ("OR", "a", "b"), "c")),
        ("a b", "b"),
        ("and", "and"),
        ("", None),
    ],
)
def test_parse(query, tree):
    assert boolean.parse(query) == tree


@pytest.mark.parametrize("query", ["( a", "a )", "a AND", "NOT", "( a OR b", "a AND ( b", "AND a", "( )"])
def test_malformed(query):
    with pytest.raises(ValueError, match="query"):
        boolean.parse(query)


def test_retrieve(spark, post):
    rng = random.Random(3)

    def make(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice("abcde")
        if kind < 0.5:
            return ("NOT", make(depth - 1))
        return (rng.choice(["AND", "OR"]), make(depth - 1), make(depth - 1))

    def write(tree):
        if isinstance(tree, str):
            return tree
        return f"NOT ( {write(tree[1])} )" if tree[0] == "NOT" else f"( {write(tree[1])} ) {tree[0]} ( {write(tree[2])} )"

    for tree in [make(3) for _ in range(12)]:
        assert {r[0] for r in boolean.retrieve(post, write(tree)).collect()} == brute(tree), write(tree)
    assert boolean.retrieve(post, "").count() == 0
