"""Importance resampling towards a target distribution, by a dictionary of distinct features.

Features of a text are its runs of 1 to n consecutive words (ASCII letters folded to lower case; words
are runs of digits, letters and characters beyond ASCII), joined by one space, each as often as it
stands.  Texts are worked on in blocks of some BLOCK bytes: a block keeps a dictionary of its distinct
features, and its documents' counts refer to places in it.  So a feature, however frequent, is one row
a block and no key holds more than one row of a block's dictionary.  Block dictionaries are summed
to one global dictionary of strings, each string is hashed once, buckets are summed from the
dictionary, and their gains go back the same way: bucket to string, string to block, block to document.

    gain of a bucket = floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))

with s of S features in the raw texts, t of T in the target's, and B buckets.  A document's weight is
the floored mean of its features' gains, its score adds Gumbel noise drawn from its doc_id, and
`percent` of the documents with at least `least_words` words are drawn, highest score first.

Within a block, strings are told apart by 64 bits of hash.  Null or empty texts have no features, weight
0 and are never drawn (least_words of 0 draws them too).  Repeated rows count and are ranked one by
one; ties go to the smaller doc_id (null last), then to fewer features.  A null doc_id draws its noise
from an empty name.  Without target texts or with empty tables all formulas still hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import _words as W
from lexloom.llm._common import Scratch, blocks_by_bytes, forget, list_array, numbered, text_buffers, trim

#: Bytes of text that share a dictionary, and of a part of them that is hashed at once.
BLOCK, PART = 1 << 24, 1 << 20
#: Words here: runs of ASCII digits and letters and of bytes of characters beyond ASCII.
WORDS = np.zeros(256, bool)
WORDS[48:58] = WORDS[65:91] = WORDS[97:123] = WORDS[128:] = True
#: Lower case of bytes, A to Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end: folded bytes with one space between words, and of each feature its start, end, text number; words a text."""
    starts, ends, rows = W.words(data, offsets, WORDS)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    keep, folded = WORDS[data], LOWER[data]
    between = ends[ends < len(data)]
    between = between[~keep[between]]  # a text may begin where the last one's word ended
    folded[between], keep[between] = 32, True
    place = np.concatenate(([0], np.cumsum(keep)))
    starts, ends = place[starts], place[ends]
    spans = [(starts[: len(starts) - k], ends[k:], rows[: len(rows) - k], rows[: len(rows) - k] == rows[k:]) for k in range(min(n, len(starts)))]
    pick = lambda i: np.concatenate([s[i][s[3]] for s in spans]) if spans else np.empty(0, np.int64)
    return folded[keep], pick(0), pick(1), pick(2), words


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


BLOCKS = "block long, doc_id long, n_words long, n_features long, places array<int>, counts array<int>, names array<string>, sums array<long>"


class Block:
    """Texts of one dictionary: distinct features by hash, and each document's counts by the places of parts' features."""

    def __init__(self):
        self.size, self.docs = 0, 0
        self.ids, self.words, self.lengths, self.parts = [], [], [], []

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray, n: int) -> None:
        joined, starts, ends, rows, words = features(data, offsets, n)
        m = len(ids)
        self.size, self.docs = self.size + len(data), self.docs + m
        self.ids.append(ids)
        self.words.append(words)
        self.lengths.append(np.bincount(rows, minlength=m))
        hashes = W.ranges_hash(W.prefix_sums(joined, W.PLAIN), starts, ends) if len(starts) else np.empty(0, W.U)
        hashes, first, which, sums = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        pairs, counts = np.unique(rows * len(first) + which, return_counts=True)
        some = max(len(first), 1)
        self.parts.append((hashes, strings(joined, starts[first], ends[first]), sums, (pairs % some).astype(np.int32), counts.astype(np.int32), np.bincount(pairs // some, minlength=m)))

    def rows(self, block: int):
        """A row for each document, then one with the dictionary."""
        hashes, names, sums, places, counts, sizes = zip(*self.parts, strict=True)
        starts = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
        _, first, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        places = np.concatenate([which[a + p] for a, p in zip(starts, places, strict=False)]).astype(np.int32)
        sizes, m = np.concatenate(sizes), self.docs
        whole = np.bincount(which, np.concatenate(sums), len(first)).astype(np.int64) if len(which) else np.empty(0, np.int64)
        none = lambda kind: pa.nulls(m, kind)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m, block)), pa.concat_arrays(self.ids), pa.array(np.concatenate(self.words), pa.int64()), pa.array(np.concatenate(self.lengths), pa.int64()),
                list_array(places, sizes, pa.int32()), list_array(np.concatenate(counts), sizes, pa.int32()), none(pa.list_(pa.string())), none(pa.list_(pa.int64())),
            ],
            names=NAMES,
        )
        one = lambda kind: pa.nulls(1, kind)
        ends = pa.array([0, len(first)], pa.int32())
        names = pa.concat_arrays(names).take(pa.array(first))
        yield pa.RecordBatch.from_arrays(
            [pa.array([block]), *[one(pa.int64())] * 3, *[one(pa.list_(pa.int32()))] * 2, pa.ListArray.from_arrays(ends, names), pa.ListArray.from_arrays(ends, pa.array(whole))], names=NAMES
        )


def in_blocks(docs: DataFrame, n: int, size: int = BLOCK) -> DataFrame:
    """A row of names and sums for each block's dictionary, and one of places and counts for each document."""

    def run(batches):
        forget(__name__)
        number, part, block = 0, 0, Block()
        for batch in batches:
            if not batch.num_rows:
                continue
            part, ids = batch.column("part")[0].as_py(), batch.column("doc_id")
            data, offsets = text_buffers(batch.column("text"))
            for at, to in blocks_by_bytes(offsets, PART):
                block.add(ids.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], n)
                if block.size >= size:
                    yield from block.rows((part << 32) + number)
                    number, block = number + 1, Block()
        if block.docs:
            yield from block.rows((part << 32) + number)
        trim()

    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCKS)


NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _named(blocks: DataFrame) -> DataFrame:
    """block, place, name, sum of the blocks' dictionaries."""
    found = blocks.where("names is not null").select("block", F.posexplode(F.arrays_zip("names", "sums")).alias("place", "f"))
    return found.select("block", "place", F.col("f.names").alias("name"), F.col("f.sums").alias("sum"))


def dictionary(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """name, raw, target, bucket: every distinct feature of both with its counts, hashed once."""
    none = F.lit(0).cast("long")
    sides = _named(raw).select("name", F.col("sum").alias("raw"), none.alias("target")).union(_named(target).select("name", none, F.col("sum")))
    whole = sides.groupBy("name").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    return whole.withColumn("bucket", F.crc32(F.col("name").cast("binary")) % buckets)


def bucket_gains(words: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of the buckets that hold a feature: `buckets` rows at most."""
    sums = words.groupBy("bucket").agg(F.sum("raw").alias("s"), F.sum("target").alias("t"))
    whole = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = ((F.col("t") + 1).cast("double") * (whole["s"] + buckets)) / ((F.col("s") + 1).cast("double") * (whole["t"] + buckets))
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def _weigh(key, docs: pa.Table, gains: pa.Table) -> pa.Table:
    """Sums of gains of one block's documents, from the gains of its dictionary."""
    gain = np.zeros(gains.num_rows, np.int64)
    gain[gains.column("place").to_numpy()] = gains.column("gain").to_numpy()
    places, counts = (docs.column(c).combine_chunks() for c in ("places", "counts"))
    each = gain[places.flatten().to_numpy()] * counts.flatten().to_numpy()
    ends = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(places.value_lengths().to_numpy())))]
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": docs.column("n_words"), "n_features": docs.column("n_features"), "total": pa.array(np.diff(ends), pa.int64())})


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024", block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every row of docs (doc_id, text), towards target (text)."""
    scratch = Scratch(docs.sparkSession, "resample")
    raw = scratch.table(in_blocks(docs, n, block), "raw", many=True)
    aim = scratch.table(in_blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, block), "target", many=True)
    words = scratch.table(dictionary(raw, aim, buckets), "words", many=True)
    gained = words.join(F.broadcast(bucket_gains(words, buckets)), "bucket").select("name", "gain")
    back = _named(raw).select("block", "place", "name").join(gained, "name").select(F.col("block").alias("of"), "place", "gain")
    held = raw.where("names is null").select("block", "doc_id", "n_words", "n_features", "places", "counts")
    weighed = held.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_weigh, "doc_id long, n_words long, n_features long, total long")
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.table(weighed.withColumn("weight", weight.cast("long")).withColumn("score", F.col("weight") + noise.cast("long")), "scored", many=True)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    able, rest = scored.where(F.col("n_words") >= least_words), scored.where(F.col("n_words") < least_words)
    ranked, count = numbered(able, order, scratch, "ranked")
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = F.when(F.col("row_number") < percent * count // 100, F.col("row_number") + 1)
    return ranked.select(*columns, drawn.alias("rank")).union(rest.select(*columns, F.lit(None).cast("long")))
