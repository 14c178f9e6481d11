"""Boolean retrieval: a query is parsed to a tree and evaluated over the bits of posting segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.index import SEGMENT, StoredIndex, members, segments

#: A tree is a term, or (operator, operands).
Tree = str | tuple


def parse(query: str) -> Tree | None:
    """The tree of a query; None for an empty one.

        expr := NOT expr | primary ((AND | OR) expr)?      primary := TERM | ( expr )

    Operators have no precedence and bind to the right; NOT holds for all that follows.  Of operands
    side by side the last stands.  Parentheses are tokens of their own; what doesn't close or
    lacks an operand is a ValueError.
    """
    tokens = query.split()
    if not tokens:
        return None
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def expression() -> Tree:
        nonlocal at
        if peek() == "NOT":
            at += 1
            return ("NOT", expression())
        left = primary()
        while peek() not in (None, "AND", "OR", ")"):
            left = expression() if peek() == "NOT" else primary()
        if peek() in ("AND", "OR"):
            operator = tokens[at]
            at += 1
            return (operator, left, expression())
        return left

    def primary() -> Tree:
        nonlocal at
        token = peek()
        if token is None or token in ("AND", "OR", ")"):
            raise ValueError(f"operand expected in query: {query!r}")
        at += 1
        if token != "(":
            return token
        inner = expression()
        if peek() != ")":
            raise ValueError(f"unclosed parenthesis in query: {query!r}")
        at += 1
        return inner

    tree = expression()
    if peek() is not None:
        raise ValueError(f"unexpected {peek()!r} in query: {query!r}")
    return tree


def terms(tree: Tree) -> list[str]:
    return [tree] if isinstance(tree, str) else sorted({t for x in tree[1:] for t in terms(x)})


def negates(tree: Tree) -> bool:
    return not isinstance(tree, str) and (tree[0] == "NOT" or any(map(negates, tree[1:])))


def condition(tree: Tree, held: dict[str, np.ndarray], everything: np.ndarray | None) -> np.ndarray:
    """The flags of a segment's documents that a query finds; everything: the universe's."""
    if isinstance(tree, str):
        return held[tree]
    if tree[0] == "NOT":
        return everything & ~condition(tree[1], held, everything)
    left, right = (condition(x, held, everything) for x in tree[1:])
    return left & right if tree[0] == "AND" else left | right


def evaluate(lists: DataFrame, tree: Tree, everything: DataFrame) -> DataFrame:
    """doc_id of the documents that a query finds in posting segments (term, segment, places, bits).

    The segments of the query's terms, and the universe's if it has a NOT, meet by their number, a few packed rows
    each; AND, OR and NOT work on a segment's bits at once.  No list is taken apart before the result.
    """
    words = terms(tree)
    rows = lists.where(F.col("term").isin(words)).select("segment", "term", "places", "bits")
    if negates(tree):
        rows = rows.union(everything.select("segment", F.lit(None).cast("string"), "places", "bits"))
    of = [F.col("term") == w for w in words] + [F.col("term").isNull()]
    packed = rows.groupBy("segment").agg(*[F.first(F.when(own, F.col(c)), ignorenulls=True).alias(f"{c}{i}") for i, own in enumerate(of) for c in ("places", "bits")])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at] for c in batch.schema.names}
                flags = [members(row[f"places{i}"].values.to_numpy() if row[f"places{i}"].is_valid else None, row[f"bits{i}"].as_py()) for i in range(len(words) + 1)]
                found = np.flatnonzero(condition(tree, dict(zip(words, flags, strict=False)), flags[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(found + row["segment"].as_py() * SEGMENT, pa.int64())], names=["doc_id"])

    return packed.mapInArrow(run, "doc_id long")


def retrieve(post: DataFrame, query: str, everything: DataFrame | None = None) -> DataFrame:
    """doc_id of the documents that a query finds in postings (term, doc_id).

    Terms are matched as they stand.  Only postings of the query's terms are packed; the universe of
    documents with any term (by default made from the postings) is needed only for queries with NOT.
    """
    tree = parse(query)
    if tree is None:
        return post.select("doc_id").where(F.lit(False))
    own = post.where(F.col("term").isin(terms(tree)))
    return evaluate(segments(own, "term"), tree, segments(post if everything is None else everything))


def retrieve_stored(index: StoredIndex, query: str) -> DataFrame:
    """The same from a stored index: its terms' row groups are all that is read, and the universe for NOT."""
    tree = parse(query)
    if tree is None:
        return index.universe.select(F.lit(0).cast("long").alias("doc_id")).where(F.lit(False))
    return evaluate(index.segments(terms(tree)), tree, index.universe)
