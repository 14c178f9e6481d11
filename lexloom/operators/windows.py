"""Search of documents for any number of phrases by one scan, without an index and without a shuffle of texts.

A phrase is told by its anchor, its first 16 bytes (8, 4, 2 or 1 if it is shorter), and the anchor by a hash.
A scan hashes every window of that many bytes in a batch of texts at once, and keeps those whose bit is set
in a bitmap of the anchors, of one fixed size.  What is kept goes with the bytes that follow it to a join with
the table of phrases, which verifies it.  Neither phrases nor texts come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import shared_dir

#: Bytes of an anchor, the longest first.
WIDTHS = (16, 8, 4, 2, 1)
#: The bitmap has 2^BITS bits, however many phrases there are.
BITS = 22
#: So many bytes of text are hashed at a time.
CHUNK = 4 << 20
#: An odd factor for each doubling of a window.
FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def _hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """By width, the 32-bit hashes of all windows of so many bytes."""
    byte = np.arange(1, 257, dtype=np.uint32) * np.uint32(0x165667B1)
    h, width, out = (byte ^ (byte >> np.uint32(15)))[data], 1, {}
    for factor in (*FACTORS, None):
        out[width] = h
        if factor is None or len(h) <= width:
            break
        h, width = h[:-width] * factor + h[width:], 2 * width
    return out


def _bits(h: np.ndarray, width: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(width * 0x9E3779B1 & 0xFFFFFFFF)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - BITS)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each begins, with the end."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _anchored(phrases: DataFrame) -> DataFrame:
    """phrase, width, h, bit, size of phrases that aren't empty."""

    def run(batches):
        for batch in batches:
            width, h, bit = [], [], []
            for phrase in batch.column("phrase").to_pylist():
                data = np.frombuffer(phrase.encode(), np.uint8)
                own = next(w for w in WIDTHS if w <= len(data))
                key = _hashes(data[:own])[own]
                width.append(own)
                h.append(int(key[0]))
                bit.append(int(_bits(key, own)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("phrase"), pa.array(width, pa.int32()), pa.array(h, pa.int64()), pa.array(bit, pa.int32())], names=["phrase", "width", "h", "bit"])

    return phrases.mapInArrow(run, "phrase string, width int, h long, bit int").withColumn("size", F.octet_length("phrase"))


def _kept(column: pa.Array, rows: pa.Array, docs: pa.Array, sizes: dict[int, int], flags: np.ndarray) -> pa.Table:
    """row, doc_id, width, h, text: the windows of a chunk of texts whose bit is set, with what follows them."""
    data, ends = _bytes(column)
    hashes, parts = _hashes(data), []
    for width, size in sizes.items():
        if width not in hashes:
            continue
        h = hashes[width]
        at = np.flatnonzero(flags[_bits(h, width)])
        of = np.searchsorted(ends, at, "right") - 1
        inside = at + width <= ends[of + 1]
        at, of = at[inside], of[inside]
        until, whole = np.minimum(at + size, ends[of + 1]), data.tobytes() if len(at) else b""
        texts = pa.array([whole[a:b] for a, b in zip(at.tolist(), until.tolist(), strict=True)], pa.binary())
        columns = [rows.take(pa.array(of)), docs.take(pa.array(of)), pa.array(np.full(len(at), width), pa.int32()), pa.array(h[at].astype(np.int64)), texts]
        parts.append(pa.table(columns, names=["row", "doc_id", "width", "h", "text"]))
    return pa.concat_tables(parts) if parts else None


def search(docs: DataFrame, phrases: DataFrame, *fields: Column) -> DataFrame:
    """phrase, doc_id of every phrase in every document that holds it in one of the fields, whatever the case; an empty phrase is in all."""
    spark = docs.sparkSession
    shared_dir(spark)  # so that a checkpoint has its folder
    asked = phrases.select(F.lower("phrase").alias("phrase")).where("phrase is not null").distinct().checkpoint()
    anchored = _anchored(asked.where("phrase != ''")).checkpoint()
    # As many rows as the bitmap has bits at most.
    set_bits = anchored.groupBy("width", "bit").agg(F.max("size").alias("size")).toArrow()
    flags = np.zeros(1 << BITS, bool)
    flags[set_bits.column("bit").to_numpy()] = True
    sizes = {r["width"]: r["size_max"] for r in set_bits.group_by("width").aggregate([("size", "max")]).to_pylist()}
    held = spark.sparkContext.broadcast(np.packbits(flags).tobytes())
    names = [f"f{i}" for i in range(len(fields))]
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("Index").alias("doc_id"), *[F.lower(F.coalesce(f, F.lit(""))).alias(c) for f, c in zip(fields, names, strict=True)])

    def scan(batches):
        flags = np.unpackbits(np.frombuffer(held.value, np.uint8)).view(bool)
        for batch in batches:
            for name in names:
                column = batch.column(name)
                ends, first = np.cumsum(_bytes(column)[1][1:] - _bytes(column)[1][:-1]), 0
                while first < len(column):
                    begun = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, begun + CHUNK, "right")))
                    cut = [c.slice(first, last - first) for c in (column, batch.column("row"), batch.column("doc_id"))]
                    found = _kept(*cut, sizes, flags)
                    if found is not None:
                        yield from found.group_by(found.column_names).aggregate([]).to_batches()
                    first = last

    windows = texts.mapInArrow(scan, "row long, doc_id long, width int, h long, text binary")
    met = windows.join(anchored.select("phrase", "width", "h"), ["width", "h"]).where(F.startswith("text", F.encode("phrase", "UTF-8")))
    everywhere = texts.select(F.lit("").alias("phrase"), "doc_id").join(F.broadcast(asked.where("phrase = ''")), "phrase", "left_semi")  # a row at most
    return met.select("phrase", "doc_id", "row").distinct().drop("row").union(everywhere)
