"""Connected components of a link table by alternating large-star and small-star steps.

All state is in tables: links are rewritten until none changes; neither links nor labels
come to the driver, only a count and a checksum of each round.  A table of at most SMALL links (some
16 MB) is solved by one task instead, for rounds of jobs over so few rows cost more than they spread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import Scratch

SMALL = 1 << 20


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node that each reaches) of links between arrays of nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], low)
        np.minimum.at(after, label[y], low)
        after = after[after]
        if (after == label).all():
            return nodes, nodes[label]
        label = after


def _solve(batches):
    links = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if links:
        nodes, labels = least_labels(*(np.concatenate(x) for x in zip(*links, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "component"])


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Each node hands its neighbours (the larger ones, or the smaller ones and itself) to the least of them."""
    both = links if not larger else links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # A hub with many neighbours is spread over tasks by the neighbour after the join.
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        # here a > b for every link
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node, component (least node reached) for every node of a link table (a, b); others are alone."""
    now = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.table(now, f"{name}-0")
    if now.count() <= SMALL:
        return now.coalesce(1).mapInArrow(_solve, "node long, component long")
    before, step = None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before, step = seen, step + 1
        after = scratch.table(_star(_star(now, True), False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
