"""Order MinHash fingerprints (sensitive to edit distance), over texts and over edited texts.

A text's k-mers of characters are numbered by occurrence, so a k-mer that stands again is another
element.  For each of M hash functions the L elements of least hash are taken, put in the order in
which they stand in the text, and hashed as a tuple: 32 bits of a fingerprint of M of them.
Likeness of two fingerprints is the share of equal tuples: it falls with edits, and with changes of
order that leave the k-mer set alone.  A text shorter than k characters is its one k-mer; the empty
text has a fingerprint of its own.  Hash functions depend on nothing but constants, so equal texts
have equal fingerprints.

`neighbours` brings each text and the next by descending doc_id together in one range
partitioning by blocks of doc_ids; the first row of each block also goes to the block before it (and
that of the first to the last), so no window over the whole table is needed.  What the driver
holds is a boundary a block, as many as partitions.  Null text is empty; null doc_ids come last; rows
of one doc_id are ordered by text hash; a row that stands alone is its own next; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import _words as W
from lexloom.llm._common import partitions

K, L, M = 12, 2, 32
U = W.U
_FUNCTIONS = (W.mix(np.arange(101, 101 + M, dtype=np.uint64)) | U(1))[:, None]
_R1 = U(0xD6E8FEB86659FD93)
with np.errstate(over="ignore"):
    _R2 = _R1 * _R1
    _R4 = _R2 * _R2
    _R8 = _R4 * _R4
_TUPLE = U(0xCA5A826395121157)


def elements(text: str, k: int = K) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers in text order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    if n < k:
        seed = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return np.array([seed], np.uint64)
    two = c[:-1] * _R1 + c[1:]
    four = two[:-2] * _R2 + two[2:]
    eight = four[:-4] * _R4 + four[4:]
    grams = W.mix(eight[: n - k + 1] * _R4 + four[8:])
    m = len(grams)
    bits = max(1, (m - 1).bit_length())
    low = U((1 << bits) - 1)
    order = np.sort((grams & ~low) | np.arange(m, dtype=np.uint64))
    place, key = (order & low).astype(np.int64), order >> U(bits)
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    if len(again):
        new = np.ones(m, bool)
        new[again] = False
        at = np.flatnonzero(new)
        number = np.arange(m) - np.repeat(at, np.diff(np.append(at, m)))
        occurrence = np.empty(m, np.uint64)
        occurrence[place] = number
        some = np.flatnonzero(occurrence)
        grams[some] = W.mix(grams[some] + occurrence[some] * _TUPLE)
    return grams


def fingerprint(text: str) -> np.ndarray:
    """M values of 32 bits."""
    e = elements(text)
    n = len(e)
    if n <= L:
        chosen = np.broadcast_to(np.arange(n), (M, n))
    elif n <= 96:
        chosen = np.argpartition(e[None, :] * _FUNCTIONS, L - 1, axis=1)[:, :L]
    else:
        # About 24 elements a function lie below the bound; where fewer than L do, all are looked at.
        bound = U(int(24 / n * 2**64))
        chosen = np.empty((M, L), np.int64)
        step = max(1, 65536 // n)
        for a in range(0, M, step):
            values = e[None, :] * _FUNCTIONS[a : a + step]
            rows, places = np.nonzero(values < bound)
            found = values[rows, places]
            order = np.lexsort((places, found, rows))
            rows, places = rows[order], places[order]
            first = np.searchsorted(rows, np.arange(len(values) + 1))
            for i in range(len(values)):
                if first[i + 1] - first[i] >= L:
                    chosen[a + i] = places[first[i] : first[i] + L]
                else:
                    chosen[a + i] = np.lexsort((np.arange(n), values[i]))[:L]
    inorder = np.sort(chosen, axis=1)
    out = np.full(M, U(n if n <= L else L + 1))
    for j in range(inorder.shape[1]):
        out = W.mix(out * _TUPLE + e[inorder[:, j]])
    return (out >> U(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / M


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many first characters of the following one, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def neighbours(docs: DataFrame) -> DataFrame:
    """block, doc_id, text, sentinel: rows to be read in order within a block, a sentinel last."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    blocks = 4 * partitions(spark)
    shares = [i / blocks for i in range(1, blocks)]
    cuts = rows.agg(F.percentile_approx("doc_id", shares, 100 * blocks).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))

    def block_of(ids: pa.Array) -> np.ndarray:
        """From 0 for the largest doc_ids; nulls are in the last."""
        known = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return len(cuts) - np.searchsorted(cuts, known, side="left")

    def firsts(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(batch.column("doc_id")), pa.int32()), batch.column("doc_id"), batch.column("tie")], names=["block", "doc_id", "tie"])

    order = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("back"), F.col("tie"))
    heads = rows.select("doc_id", "tie").mapInArrow(firsts, "block int, doc_id long, tie long").groupBy("block").agg(F.min(order).alias("o")).collect()
    heads = sorted((h["block"], None if h["o"]["none"] else -h["o"]["back"], h["o"]["tie"]) for h in heads)
    before = {(doc, tie): heads[i - 1][0] for i, (_, doc, tie) in enumerate(heads)}

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            where = pa.array(block_of(batch.column("doc_id")), pa.int32())
            no = pa.array(np.zeros(batch.num_rows, bool))
            yield pa.RecordBatch.from_arrays([where, batch.column("doc_id"), batch.column("text"), batch.column("tie"), no], names=names)
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), strict=True)
            extra = [(i, before[key]) for i, key in enumerate(keys) if key in before]
            if extra:
                part = batch.take(pa.array([i for i, _ in extra]))
                yield pa.RecordBatch.from_arrays([pa.array([b for _, b in extra], pa.int32()), part.column("doc_id"), part.column("text"), part.column("tie"), pa.array(np.ones(len(extra), bool))], names=names)

    names = ["block", "doc_id", "text", "tie", "sentinel"]
    dealt = rows.mapInArrow(deal, "block int, doc_id long, text string, tie long, sentinel boolean")
    return dealt.repartition("block").sortWithinPartitions("block", "sentinel", F.col("doc_id").desc_nulls_last(), "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held = None  # the row that waits for the next: block, doc_id, text, fingerprint
        for batch in batches:
            out = []
            for block, doc, text, sentinel in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "text", "sentinel")), strict=True):
                if sentinel and (held is None or held[0] != block):
                    continue  # of repeated first rows one is enough
                own = fingerprint(text)
                if held is not None and held[0] == block:
                    changed = edited(held[2], text)
                    mark = held[3] if changed == held[2] else fingerprint(changed)
                    out.append(
                        (held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), held[3].tobytes().hex(), mark.tobytes().hex(), likeness(held[3], mark), likeness(held[3], own))
                    )
                held = None if sentinel else (block, doc, text, own)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return neighbours(docs).mapInArrow(run, schema)
