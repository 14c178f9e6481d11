"""Reproducible shuffle into shards by a Feistel permutation.

Each row has a global number (order of doc_id, then text checksum and hash).  A keyed Feistel
network permutes the smallest domain of an even number of bits that holds all numbers, and
walks its cycle until it is back inside 0..n-1, so it permutes exactly the row numbers.  Place p
belongs to shard p mod k at slot p div k: shard row counts are at most one apart (law `rows`),
slots are gapless, and either direction can be computed from the seed and n alone.

Null or repeated doc_ids keep their rows (nulls first); a null text has no bytes, size 8 and
checksum 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import Scratch, map_arrow, numbered
from lexloom.llm._words import U, mix

ROUNDS = 6


class Feistel:
    """A permutation of 0..n-1 given by a seed."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = U((1 << self.half) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * U(0xD1342543DE82EF95) + U(seed))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> U(self.half), x & self.mask
        for key in keys:
            if back:
                left, right = right ^ (mix(left + key) & self.mask), left
            else:
                left, right = right, left ^ (mix(right + key) & self.mask)
        return (left << U(self.half)) | right

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(x.astype(np.uint64), keys, back)
        away = np.flatnonzero(out >= U(self.n))
        while len(away):
            out[away] = self._once(out[away], keys, back)
            away = away[out[away] >= U(self.n)]
        return out.astype(np.int64)

    def forward(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys, False)

    def inverse(self, places: np.ndarray) -> np.ndarray:
        return self._walk(places, self.keys[::-1], True)


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240501) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row."""
    spark = docs.sparkSession
    text = F.col("text")
    # The text goes no further than its length and checksums; only these are shuffled.
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    )
    rows, n = numbered(small, ["doc_id", "text_crc32", "_hash", "size"], Scratch(spark, "shard"), "rows")
    order = Feistel(n, seed)

    def place(batch: pa.RecordBatch):
        at = order.forward(batch.column("row_number").to_numpy())
        names = ["doc_id", "size", "text_crc32", "row_number"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in names), pa.array(at % shards, pa.int32()), pa.array(at // shards, pa.int64())],
            names=[*names, "shard", "slot"],
        )

    kept = rows.select("doc_id", "size", "text_crc32", "row_number")
    return map_arrow(kept, place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
