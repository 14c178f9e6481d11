"""Peak concurrency of sales by a sweep over step functions.

A sale is open from its sold_at until a week after the last line of it was shipped; both as whole minutes
since 1970, rounded down.  Each task folds the starts and ends of whatever sales it has into compact step
functions: per nation, the minutes at which something changes, and by how much.  Functions are cut by
day, so one never has more than 1,440 steps.  Pieces of one nation and day are added in pairs, as a tree:
FAN pieces to a task and round, in as many rounds as the number of tasks asks for, so no task gets more
than FAN functions of a nation and day however many tasks made them.  A last scan over the days of each
nation (one row a day, not its steps) carries open sales, sums and peaks from day to day, and the
days are written out by themselves.

The order in which pieces are added doesn't matter: they are sums of whole numbers.  Sales meet their
last shipment and their client by joins whose hot keys Spark's adaptive execution splits, since both
other sides are stored with one row a key.

Sales without sold_at, or whose end isn't after their start, take no part; those without a line or with
unshipped lines only stay open.  A null or unknown client counts as nation -1, and so does a client
without a nation; of repeated clients the last updated one holds (then the least nation_id).  Every row of
`sales` is a sale, repeated ones too.  A total that is null or not finite counts 0.  Empty tables give no rows.
Columns beside those named are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm._common import Scratch, forget, list_array, trim

DAY = 1440
#: Pieces of one nation and day that one task adds up in one round.
FAN = 32
#: A task's function is written when it has so many steps.
STEPS = 1 << 18
EVERYWHERE, NOWHERE = -2, -1


def minute(df: DataFrame, column: str) -> Column:
    """Whole minutes since 1970 of a time; one without a zone is taken as UTC."""
    zoned = dict(df.dtypes)[column] == "timestamp"
    micros = f"unix_micros(`{column}`)" if zoned else f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{column}`)"
    return F.expr(f"({micros} - pmod({micros}, 60000000)) div 60000000")


def intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, scratch: Scratch, days: int = 7) -> DataFrame:
    """nation, start, end (null: stays open), cents of every sale that is open at all."""
    last = lines.where("sale_id is not null and shipped_at is not null").select("sale_id", (minute(lines, "shipped_at") + days * DAY).alias("end"))
    ends = scratch.table(last.groupBy("sale_id").agg(F.max("end").alias("end")), "ends")
    known = clients.where("client_id is not null").groupBy("client_id").agg(F.max_by("nation_id", F.struct("updated_at", -F.col("nation_id"))).alias("nation"))
    nations = scratch.table(known.where("nation is not null"), "nations")
    cents = F.when(F.abs("total") < float("inf"), F.floor(100 * F.col("total") + 0.5)).otherwise(0).cast("long")
    sold = sales.where("sold_at is not null").select("sale_id", "client_id", minute(sales, "sold_at").alias("start"), cents.alias("cents"))
    open_ = sold.join(ends, "sale_id", "left").where("end is null or end > start").select("client_id", "start", "end", "cents")
    return open_.join(nations, "client_id", "left").select(F.coalesce("nation", F.lit(NOWHERE)).cast("int").alias("nation"), "start", "end", "cents")


def added(keys: tuple[np.ndarray, ...], opened: np.ndarray, cents: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """Steps with equal keys added up, in the order of the keys; steps that come to nothing go."""
    if not len(opened):
        return keys, opened, cents
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    opened, cents = np.add.reduceat(opened[order], first), np.add.reduceat(cents[order], first)
    some = (opened != 0) | (cents != 0)
    return tuple(k[first[some]] for k in keys), opened[some], cents[some]


FUNCTIONS = "nation int, day long, part long, flush long, minutes array<int>, opened array<long>, cents array<long>"
_KEYS = ("nation", "day", "part", "flush")


def _rows(keys: tuple[np.ndarray, ...], steps: np.ndarray, opened: np.ndarray, cents: np.ndarray) -> pa.RecordBatch:
    """A row for each run of equal keys, with its steps as lists."""
    new = np.ones(len(steps), bool)
    if len(steps):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(steps)))
    lists = [list_array(v, sizes, kind) for v, kind in ((steps.astype(np.int32), pa.int32()), (opened, pa.int64()), (cents, pa.int64()))]
    kinds = (pa.int32(), *[pa.int64()] * 3)
    return pa.RecordBatch.from_arrays([*(pa.array(k[first], t) for k, t in zip(keys, kinds, strict=True)), *lists], names=[*_KEYS, "minutes", "opened", "cents"])


def step_functions(spans: DataFrame, steps: int = STEPS) -> DataFrame:
    """The step functions of each task's sales, by nation and day; written anew (`flush`) whenever they have `steps` steps."""

    def run(batches):
        forget(__name__)
        flush, part = 0, 0
        none = np.empty(0, np.int64)
        held = ((none, none), none, none)

        def piece():
            (nation, at), opened, cents = held
            day = at // DAY
            return _rows((nation, day, np.full(len(at), part), np.full(len(at), flush)), at - day * DAY, opened, cents)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            nation, start, cents = (batch.column(c).to_numpy().astype(np.int64) for c in ("nation", "start", "cents"))
            closed = np.flatnonzero(batch.column("end").is_valid().to_numpy(zero_copy_only=False))
            end = batch.column("end").take(pa.array(closed)).to_numpy()
            at, own = np.concatenate((start, end)), np.concatenate((nation, nation[closed]))
            opened = np.concatenate((np.ones(len(start), np.int64), np.full(len(end), -1)))
            cents = np.concatenate((cents, -cents[closed]))
            nations = np.concatenate((own, np.full(len(own), EVERYWHERE)))
            (n, t), o, c = held
            held = added((np.concatenate((n, nations)), np.concatenate((t, at, at))), np.concatenate((o, opened, opened)), np.concatenate((c, cents, cents)))
            if len(held[1]) >= steps:
                yield piece()
                flush, held = flush + 1, ((none, none), none, none)
        if len(held[1]):
            yield piece()
        trim()

    return spans.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(run, FUNCTIONS)


def _tree(nation: np.ndarray, day: np.ndarray, group: np.ndarray, slot: np.ndarray, sizes: np.ndarray, minutes: np.ndarray, opened: np.ndarray, cents: np.ndarray, fan: int) -> pa.RecordBatch:
    """Functions of equal (nation, day, group) added in pairs of neighbouring slots until one is left."""
    keys = [np.repeat(k.astype(np.int64), sizes) for k in (nation, day, group)]
    slot, at = np.repeat(slot, sizes), minutes.astype(np.int64)
    width = fan
    while width > 1:
        slot, width = slot // 2, (width + 1) // 2
        (*keys, slot, at), opened, cents = added((*keys, slot, at), opened, cents)
    return _rows((keys[0], keys[1], keys[2], np.zeros(len(at), np.int64)), at, opened, cents)


def merge(functions: DataFrame, fan: int = FAN, steps: int = STEPS) -> DataFrame:
    """One round: the pieces part // fan of each nation and day become one function."""

    def run(batches):
        forget(__name__)
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]):
            table = pa.Table.from_batches(rows).combine_chunks()
            flat = {c: table.column(c).combine_chunks() for c in table.column_names}
            part = flat["part"].to_numpy()
            lists = [flat[c].flatten().to_numpy() for c in ("minutes", "opened", "cents")]
            return _tree(flat["nation"].to_numpy(), flat["day"].to_numpy(), part // fan, part % fan, flat["minutes"].value_lengths().to_numpy(), *lists, fan)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column("nation").to_numpy(), batch.column("day").to_numpy(), batch.column("part").to_numpy() // fan])
            ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            sizes = np.concatenate(([0], np.cumsum(batch.column("minutes").value_lengths().to_numpy())))
            at = 0
            last = held[-1] if held else None
            if last is not None and [last.column(c)[-1].as_py() // (fan if c == "part" else 1) for c in ("nation", "day", "part")] != list(key[:, 0]):
                yield flush(held)
                held = []
            # Whole groups go on as soon as they hold `steps` steps together; the last stays until its end is seen.
            for end in ends:
                if sizes[end] - sizes[at] >= steps or end == ends[-1]:
                    yield flush([*held, batch.slice(at, end - at)])
                    held, at = [], int(end)
            held.append(batch.slice(at))
        if held:
            yield flush(held)
        trim()

    placed = functions.withColumn("group", F.floor(F.col("part") / fan)).repartition("nation", "day", "group").drop("group")
    return placed.sortWithinPartitions("nation", "day", "part").mapInArrow(run, FUNCTIONS)


def merged(functions: DataFrame, fan: int = FAN, steps: int = STEPS) -> DataFrame:
    """One function for each nation and day, from stored pieces: rounds of `fan` until no pair is left."""
    top = functions.agg(F.coalesce(F.max("part"), F.lit(0)).alias("part"), F.coalesce(F.max("flush"), F.lit(0)).alias("flush")).first()
    count = (top["part"] + 1) * (top["flush"] + 1)
    out = functions.withColumn("part", F.col("flush") * (top["part"] + 1) + F.col("part"))
    while count > 1:
        out, count = merge(out, fan, steps), -(-count // fan)
    return out.select("nation", "day", "minutes", "opened", "cents")


def stitched(functions: DataFrame) -> DataFrame:
    """nation, day, and what a day gets from the days before it: open sales, their sum, the highest so far, the next change, the peak of all."""
    zero = F.lit(0).cast("long")
    rise = F.aggregate("opened", F.struct(zero.alias("now"), F.lit(None).cast("long").alias("high")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["high"], s["now"] + x).alias("high")))
    total = F.aggregate("cents", zero, lambda s, x: s + x)
    days = functions.select("nation", "day", rise.alias("rise"), total.alias("total"), (F.col("day") * DAY + F.col("minutes")[0]).alias("first"))
    by = Window.partitionBy("nation").orderBy("day")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    sums = days.select(
        "nation", "day", "first", F.col("rise.high").alias("high"),
        F.coalesce(F.sum("rise.now").over(before), zero).alias("from_open"), F.coalesce(F.sum("total").over(before), zero).alias("from_cents"),
    )
    top = F.col("from_open") + F.col("high")
    return sums.select(
        "nation", "day", "from_open", "from_cents", F.max(top).over(before).alias("high"), F.lead("first").over(by).alias("next"), F.max(top).over(Window.partitionBy("nation")).alias("peak")
    )


RESULT = "nation_id int, from_s long, to_s long, n_open long, open_cents long, high_open long, is_peak boolean"


def _write_out(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes = batch.column("minutes").value_lengths().to_numpy()
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    spread = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), sizes)

    def running(name: str, base: str) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(batch.column(name).flatten().to_numpy())))
        return sums[1:] - np.repeat(sums[starts], sizes) + spread(base)

    opened, cents = running("opened", "from_open"), running("cents", "from_cents")
    high = opened.copy()
    for at, n, before in zip(starts, sizes, batch.column("high").to_pylist(), strict=True):
        own = high[at : at + n]
        np.maximum.accumulate(own, out=own)
        if before is not None:
            np.maximum(own, before, out=own)
    moment = 60 * (spread("day") * DAY + batch.column("minutes").flatten().to_numpy())
    until, last = np.append(moment[1:], 0), starts + sizes - 1
    missing = np.zeros(len(moment), bool)
    next_ = batch.column("next")
    missing[last] = next_.is_null().to_numpy(zero_copy_only=False)
    until[last] = 60 * next_.fill_null(0).to_numpy()
    columns = [pa.array(spread("nation"), pa.int32()), pa.array(moment), pa.array(until, mask=missing), pa.array(opened), pa.array(cents), pa.array(high), pa.array(opened == spread("peak"))]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])


def sweep(sales: DataFrame, lines: DataFrame, clients: DataFrame, fan: int = FAN, steps: int = STEPS) -> DataFrame:
    """nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak: a row for each moment at which a nation's open sales change."""
    scratch = Scratch(sales.sparkSession, "sweep")
    pieces = scratch.table(step_functions(intervals(sales, lines, clients, scratch), steps), "pieces", many=True)
    functions = scratch.table(merged(pieces, fan, steps), "functions")
    scratch.drop("ends", "nations", "pieces")
    own, carried = functions.where(F.size("minutes") > 0), stitched(functions.where(F.size("minutes") > 0))

    def run(batches):
        forget(__name__)
        for batch in batches:
            sizes = np.concatenate(([0], np.cumsum(batch.column("minutes").value_lengths().to_numpy())))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + STEPS, side="right")) - 1)
                yield _write_out(batch.slice(at, to - at))
                at = to
        trim()

    return own.join(carried, ["nation", "day"]).mapInArrow(run, RESULT)
