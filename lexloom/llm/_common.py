"""Tables written in the shared folder, and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm._words import mix
from lexloom.session import shared_dir


class Scratch:
    """Parquet tables below the shared folder; each cuts lineage and survives lost executors.

    drop() removes those that later steps don't read, so that a job's disk use follows its
    live intermediate tables.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, many: bool = False) -> DataFrame:
        """Writes and rereads a table.

        What an exchange has made goes into no more files than tasks can read at once, or an eighth of
        the shuffle partitions; many: as many files as there are partitions (of a scan, say).
        """
        path = self.path(name)
        if not many:
            df = df.coalesce(max(3 * self.spark.sparkContext.defaultParallelism, partitions(self.spark) // 8))
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        # Spark removes the shuffle files of a finished step once its plan is garbage, in Python and then on the driver.
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        self.drop("")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks_by_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row stands alone, whole."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


#: What modules hold from task to task in a worker, by module: vocabularies and tables of words.
HELD: dict[str, dict] = {}


def forget(owner: str) -> None:
    """Drops what modules other than `owner` hold in this worker, since workers serve one query after another."""
    for module, held in HELD.items():
        if module != owner:
            held.clear()


def trim() -> None:
    """Gives freed memory back to the system at the end of a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def let_go(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All batches of a task, then memory back to the system.

    The writer holds the last batch until it has another: it gets an empty one, for workers stay idle beside
    those of later steps, and what is freed after trim() would stay with them.
    """
    schema = None
    for batch in found:
        schema = batch.schema
        yield batch
        del batch
    if schema is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(0, f.type) for f in schema], schema=schema)
    trim()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with a function of a task's batches, whose memory is let go at its end."""
    return df.mapInArrow(lambda batches: let_go(run(batches)), schema)


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, held: bool = True) -> DataFrame:
    """mapInArrow with a function of one batch that yields batches; held: it uses what its module holds in HELD."""

    owner = each.__module__ if held else ""

    def run(batches):
        forget(owner)
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return map_batches(df, run, schema)


def numbered(df: DataFrame, keys: list, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """Rows with their global number `row_number` from 0 in the order of `keys`, and their count.

    A range partitioning by the keys is written once with each row's partition and place; what the
    driver sees are the partitions' row counts, so its state follows the partition count.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    placed = scratch.table(placed, name, many=True)
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    bounds = spark.createDataFrame(starts or [(-1, 0)], "_part bigint, _start bigint")
    out = placed.join(F.broadcast(bounds), "_part").withColumn("row_number", F.col("_start") + F.col("_place"))
    return out.drop("_part", "_place", "_start"), total


def fresh(columns: list[str], name: str) -> str:
    """A column name made of `name` that is none of `columns`, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_part(df: DataFrame, solve: Callable[[int, dict[str, np.ndarray]], pa.RecordBatch], schema: str, key: str = "part") -> DataFrame:
    """Brings the rows of each `key` together; solve gets the key and each list column's values, laid end to end.

    Rows hold packed lists, so a shuffle moves a few wide rows instead of one for each value.
    """
    names = [c for c in df.columns if c != key]

    def run(batches):
        forget(solve.__module__)
        held: list[pa.RecordBatch] = []
        now = None

        def flush():
            columns = {}
            for c in names:
                lists = [b.column(c) for b in held]
                flat = [x.flatten() if pa.types.is_list(x.type) else x for x in lists]
                columns[c] = np.concatenate([x.to_numpy(zero_copy_only=False) for x in flat])
            return solve(now, columns)

        for batch in batches:
            keys = batch.column(key).to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])) if len(keys) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and keys[a] != now:
                    yield flush()
                    held = []
                now = int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return map_batches(df.repartition(key).sortWithinPartitions(key), run, schema)


class KeyFilter:
    """A Bloom filter of 2^bits bits over 64-bit keys: what it leaves out surely isn't among them.

    It is of one size whatever the corpus, and only lessens what a later join is sent; results don't
    depend on it.  Tasks give the pieces of it that they fill, pieces are united by tasks, and the
    driver gets each piece once.
    """

    PIECE = 1 << 18

    def __init__(self, keys: DataFrame, bits: int = 24):
        self.bits = bits
        places, size = self.places, self.PIECE

        def build(batches):
            got = np.zeros(1 << (bits - 3), np.uint8)
            for batch in batches:
                at = np.unique(places(batch.column(0).to_numpy(), bits))
                if len(at):
                    first = np.flatnonzero(np.diff(at >> 3, prepend=-1))
                    got[at[first] >> 3] |= np.bitwise_or.reduceat(np.uint8(1) << (at & 7).astype(np.uint8), first)
            pieces = got.reshape(-1, min(size, 1 << bits) >> 3)
            some = np.flatnonzero(pieces.any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pieces[i].tobytes() for i in some], pa.binary())], names=["part", "bits"])

        def unite(batches):
            got: dict[int, np.ndarray] = {}
            for batch in batches:
                for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    now = np.frombuffer(raw.as_buffer(), np.uint8)
                    got[part] = got[part] | now if part in got else now
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), pa.array([x.tobytes() for x in got.values()], pa.binary())], names=["part", "bits"])

        schema = "part int, bits binary"
        whole = np.zeros(1 << (bits - 3), np.uint8)
        for row in map_batches(keys, build, schema).repartition("part").mapInArrow(unite, schema).collect():
            own = np.frombuffer(row["bits"], np.uint8)
            whole[row["part"] * len(own) :][: len(own)] |= own
        self.spread = keys.sparkSession.sparkContext.broadcast(whole)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        h = mix(keys.view(np.uint64))
        return np.stack([(h >> np.uint64(i * 32)) & np.uint64((1 << bits) - 1) for i in (0, 1)]).astype(np.int64)

    def tester(self) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
        """A picklable maker of the test, for use within a task."""
        spread, places, bits = self.spread, self.places, self.bits

        def make():
            have = spread.value

            def test(keys: np.ndarray) -> np.ndarray:
                at = places(keys, bits)
                return ((have[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

            return test

        return make

    def keep(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        make, at = self.tester(), df.columns.index(column)

        def run(batches):
            test = make()
            for batch in batches:
                yield batch.filter(pa.array(test(batch.column(at).to_numpy()) == inside))

        return map_batches(df, run, df.schema)
