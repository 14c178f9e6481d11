"""N-gram Jaccard similarity of all queries with all words, without a row for each n-gram that a pair shares.

Words are dealt out to tasks, and blocks of queries go to each deal.  A task holds one block of queries as an
inverted index of their n-grams, and lets its words stream by, some at a time: their n-grams' lists of queries,
counted, are the sizes of the intersections.  So nothing is shuffled but words and queries, a task's memory
doesn't grow with either, and only pairs of the result become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import shared_dir

#: About so many queries are one block.
BLOCK = 4096
#: A task counts so many pairs of words and queries at a time.
PAIRS = 1 << 20
EDGE = 1e-9


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram) as two arrays, each n-gram of a text once, and how many a text has."""
    sizes = np.maximum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) - n + 1, 0)
    letters = np.array(texts.to_pylist(), dtype=str)
    width = letters.dtype.itemsize // 4
    letters = letters.view(np.uint32).reshape(len(texts), width).astype(np.uint64)
    if len(texts) == 0 or width < n:
        # Texts shorter than they seem end with NUL letters, which numpy drops.
        letters = np.pad(letters, ((0, 0), (0, max(0, n - width))))
    letters = np.pad(letters, ((0, 0), (0, max(0, int(sizes.max(initial=0)) + n - 1 - letters.shape[1]))))
    places = letters.shape[1] - n + 1
    # Up to three letters of 21 bits are a key of their own, more a hash.
    factor = np.uint64(1 << 21 if n <= 3 else 0x9E3779B97F4A7C15)
    keys = np.zeros((len(texts), places), np.uint64)
    for i in range(n):
        keys = keys * factor + letters[:, i : i + places]
    inside = np.arange(places) < sizes[:, None]
    keys[~inside] = np.iinfo(np.uint64).max
    keys.sort(axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    fresh &= np.arange(places) < sizes[:, None]
    text, place = np.nonzero(fresh)
    return text, keys[text, place], fresh.sum(axis=1)


class _Block:
    """Queries as lists by n-gram."""

    def __init__(self, queries: pa.Array, lowered: pa.Array, n: int):
        self.queries, self.n = queries, n
        query, keys, self.sizes = _grams(lowered, n)
        order = np.argsort(keys, kind="stable")
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.query, self.starts = query[order], np.append(starts, len(keys))
        self.best = np.zeros(len(queries))

    def shared(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many n-grams each word (row) shares with each query, and how many the words have."""
        word, keys, sizes = _grams(words, self.n)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        word, at = word[known], at[known]
        counts = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(counts)
        # Places in the lists, one list after the other, and the number of the pair that each stands for.
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + counts, counts)
        pair = self.query[place] + np.repeat(word * len(self.queries), counts)
        return np.bincount(pair, minlength=len(words) * len(self.queries)).reshape(len(words), len(self.queries)), sizes

    def pairs(self, words: pa.Array, best: bool):
        """query, word, jaccard of words that share an n-gram; best: only of what no word before them beats."""
        step = max(1, PAIRS // max(len(self.queries), 1))
        for first in range(0, len(words), step):
            part = words.slice(first, step)
            both, sizes = self.shared(part)
            if best:
                # What a word of each size has to share to come up to the best so far.
                size = np.arange(sizes.max() + 1)[:, None]
                least = np.maximum(np.ceil(self.best * (self.sizes + size) / (1 + self.best) - EDGE), 1).astype(np.int64)
                word, query = np.nonzero(both >= least[sizes])
            else:
                word, query = np.nonzero(both)
            shared = both[word, query]
            alike = shared / (sizes[word] + self.sizes[query] - shared)
            if best:
                np.maximum.at(self.best, query, alike)
                top = alike >= self.best[query]
                word, query, alike = word[top], query[top], alike[top]
            yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(query)), part.take(pa.array(word)), pa.array(alike)], names=["query", "word", "jaccard"])


def _met(queries: DataFrame, words: DataFrame, n: int, best: bool) -> DataFrame:
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deals = 4 * parts
    asked = queries.select("query").where("query is not null").distinct()
    blocks = max(1, -(-asked.count() // BLOCK))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = asked.select(deal("query", blocks).alias("block"), every(deals).alias("deal"), "query", F.lower("query").alias("text"))
    right = words.select("word").where("word is not null").distinct().select(every(blocks).alias("block"), deal("word", deals).alias("deal"), F.lit(None).cast("string").alias("query"), F.col("word").alias("text"))
    # A deal's queries of a block come before its words.
    rows = left.union(right).repartition(parts, "block", "deal").sortWithinPartitions("block", "deal", F.desc_nulls_last("query"))

    def run(batches):
        now, held, block = None, [], None
        for batch in batches:
            key = batch.column("block").to_numpy().astype(np.int64) * deals + batch.column("deal").to_numpy()
            word = batch.column("query").is_null().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (word[1:] != word[:-1])) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if last == first:
                    continue
                if key[first] != now:
                    now, held, block = key[first], [], None
                part = batch.slice(first, last - first)
                if not word[first]:
                    held.append(part)
                elif held or block:
                    if block is None:
                        whole = pa.Table.from_batches(held).combine_chunks()
                        block, held = _Block(whole.column("query").combine_chunks(), whole.column("text").combine_chunks(), n), []
                    yield from block.pairs(part.column("text"), best)

    return rows.mapInArrow(run, "query string, word string, jaccard double")


def pairs_by_jaccard(queries: DataFrame, words: DataFrame, n: int = 2) -> DataFrame:
    """query, word, jaccard of all pairs that share an n-gram of the lower-cased query and the word."""
    return _met(queries, words, n, best=False)


def best_by_jaccard(queries: DataFrame, words: DataFrame, n: int = 2) -> DataFrame:
    """query, word, jaccard of every distinct query that shares an n-gram with a word, and all words of the greatest similarity."""
    shared_dir(words.sparkSession)  # so that a checkpoint has its folder
    told = _met(queries, words, n, best=True)
    return told.withColumn("top", F.max("jaccard").over(Window.partitionBy("query"))).where("jaccard = top").select("query", "word", "jaccard").checkpoint()
