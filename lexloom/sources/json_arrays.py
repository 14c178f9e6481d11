"""JSON arrays read by many tasks: one large file is cut into byte ranges at lines, and records are put together over the cuts.

A line of JSON never begins within a string, so each line's braces can be counted by itself.  One scan sums them for
each byte range; from the sums (as many numbers as Spark's own list of ranges, which the driver holds
anyway) follows how deep within a record each range begins.  The second scan gives out whole records, and
the parts of those that lie across ranges, which meet by the range in which their record begins.
A file without line breaks is one range, as is a compressed one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A string (up to the line's end, should it be broken off) or a brace.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]')


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch], begin: Callable, each: Callable, end: Callable):
    """Calls begin(file, start) at each byte range, each(line) for its lines and end() after them; passes on what they yield."""
    now = None
    for batch in batches:
        for value, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != now:
                if now is not None:
                    yield from end()
                now = at
                begin(*at)
            each(value)
        if now is not None:
            yield from end(False)
    if now is not None:
        yield from end()


def _depths(lines: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """For each byte range: how many braces are open where it begins, and the start of the range that began the record there (-1: none)."""

    def run(batches):
        state = []

        def begin(file, start):
            state[:] = [file, start, 0, 0]

        def each(line):
            if "{" in line or "}" in line:
                for m in TOKEN.finditer(line):
                    state[2] += (m[0] == "{") - (m[0] == "}")
                    state[3] = min(state[3], state[2])

        def end(whole=True):
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in state], names=["file", "start", "change", "least"])

        yield from _ranges(batches, begin, each, end)

    out, file, depth, owner = {}, None, 0, -1
    for r in sorted(map(tuple, lines.mapInArrow(run, "file string, start long, change long, least long").collect())):
        if r[0] != file:
            file, depth, owner = r[0], 0, -1
        out[r[0], r[1]] = (depth, owner)
        if depth + r[3] <= 0:  # between records somewhere in it
            owner = r[1] if depth + r[2] > 0 else -1
        depth += r[2]
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """record: the text of each object of the JSON arrays (or objects, or lines of them) at a path."""
    lines = _lines(spark, path)
    known = spark.sparkContext.broadcast(_depths(lines))

    def run(batches):
        file, start, depth, owner, held, done, parts = "", 0, 0, -1, [], [], []

        def begin(f, s):
            nonlocal file, start, depth, owner
            file, start = f, s
            depth, owner = known.value[f, s]

        def each(line):
            nonlocal depth, owner
            if "{" not in line and "}" not in line:
                if depth > 0:
                    held.append(line)
                return
            at = 0
            for m in TOKEN.finditer(line):
                if m[0] == "{":
                    if depth == 0:
                        at, owner = m.start(), start
                    depth += 1
                elif m[0] == "}":
                    depth -= 1
                    if depth == 0:
                        text = "\n".join([*held, line[at : m.end()]])
                        held.clear()
                        if owner == start:
                            done.append(text)
                        else:
                            parts.append((file, owner, start, text))
            if depth > 0:
                held.append(line[at:])

        def end(whole=True):
            if whole and held:
                parts.append((file, owner, start, "\n".join(held)))
                held.clear()
            if done:
                yield batch_of([(None, None, None, t) for t in done])
                done.clear()
            if whole and parts:
                yield batch_of(parts)
                parts.clear()

        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "owner", "start", "text"])

        yield from _ranges(batches, begin, each, end)

    found = lines.mapInArrow(run, "file string, owner long, start long, text string")
    whole = found.where("file is null").select(F.col("text").alias("record"))
    met = found.where("file is not null").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    return whole.union(met.select(F.array_join(F.transform("parts", lambda p: p["text"]), "\n")))


def read(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """The objects of JSON arrays with a fixed schema."""
    return records(spark, path).select(F.from_json("record", schema, {"mode": mode}).alias("r")).select("r.*")
