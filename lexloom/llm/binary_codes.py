"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector o is rotated by a random orthogonal matrix; its code is the signs of the rotated
coordinates, and its stored factor f is the inner product of the rotated vector with the unit vector
of those signs.  A vector also has its rotated coordinates in eight bits each, rounded at random, with
their least value and step.  For a query q the inner product of the sign vector with the four high bits of
q comes from bit counts; divided by f it is an unbiased estimate of o.q, with a deviation of at most
sqrt((1 - f^2) / f^2) / sqrt(d - 1) times a normal one.  A pair whose estimate and EPSILON deviations stay
below the threshold is dropped; the others are estimated once more from all bits of both, whose deviation is some
hundred times less, and dropped by the same rule.

Codes, factors and levels are computed once and stored; buckets are of sign bits of further rotations:
T tables of b bits, b by the logarithm of the number of vectors, T so that a pair just at the threshold
meets in some table with probability RECALL or more.  Only codes go to the buckets.  There the bounds
tell which pairs may be linked, and a task returns a spanning forest of these (a row a member at
most; pairs that are connected already aren't looked at again, so a dense bucket costs little).  Classes
are told apart in clusters (components of those forests) by a bound that holds for certain: a code also has the
length `rest` of what rounding lost, and an inner product is off by rest + rest' + rest rest' at most.  Pairs whose
interval lies above the threshold are links, those below it aren't, from codes alone.  Only the vectors of
members that have a pair with the threshold within its interval are sent, once, and only such pairs are
recomputed exactly, in double precision; so no link is below the threshold.  Equal vectors are one class with a multiplicity
before anything else; a bucket or cluster of more than HOT classes is cut into blocks, each pair of
which is a task's group.

Null, empty, zero and non-finite vectors (or with a null component) link with nothing; vectors of
different lengths don't link; repeated vec_ids keep their rows; empty tables give no rows; labels
and other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import Scratch, map_arrow
from lexloom.llm.components import components

EPSILON, RECALL, HOT, BLOCK, ROWS, PAIRS, SLACK = 4.0, 0.995, 2000, 1000, 20_000, 1 << 16, 1e-9
KEY = ["d", "slot", "bucket", "block", "other"]  # of a group that a task has whole
_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(d: int, count: int, seed: int = 7) -> np.ndarray:
    """`count` random orthogonal d x d matrices, one below the other."""
    if (d, count) not in _rotations:
        rng = np.random.default_rng([seed, d])
        made = []
        for _ in range(count):
            q, r = np.linalg.qr(rng.standard_normal((d, d)))
            made.append(q * np.sign(np.diag(r)))
        _rotations[d, count] = np.concatenate(made)
    return _rotations[d, count]


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (n, d) as (n, words) of uint64."""
    n, d = bits.shape
    wide = np.zeros((n, -(-d // 64) * 64), bool)
    wide[:, :d] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def codes(unit: np.ndarray):
    """code, factor, levels (n, d), low, step, total, rest of the rotated unit vectors (n, d)."""
    d = unit.shape[1]
    turned = unit @ rotation(d, 1).T
    code = _words(turned > 0)
    factor = np.abs(turned).sum(axis=1) / math.sqrt(d)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 255, 1e-12)
    noise = np.random.default_rng(3).random(d)  # unbiased rounding, the same for equal vectors
    levels = np.clip(np.floor((turned - low[:, None]) / step[:, None] + noise), 0, 255).astype(np.uint8)
    rest = np.linalg.norm(turned - (low[:, None] + step[:, None] * levels), axis=1)
    return code, factor, levels, low, step, turned.sum(axis=1), rest


def planes(levels: np.ndarray) -> np.ndarray:
    """The four high bits of levels, a plane a bit."""
    return np.stack([_words((levels >> (4 + j)) & 1 == 1) for j in range(4)], axis=1)


def estimate(d: int, data, query, high: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of data rows i with query rows j (high: their planes), and one deviation."""
    code, factor = data[0][i], data[1][i]
    own, low, step = high[j], query[3][j] + 7.5 * query[4][j], 16 * query[4][j]
    inside = np.bitwise_count(code).sum(axis=1, dtype=np.float64) * low
    for bit in range(4):
        inside += step * (1 << bit) * np.bitwise_count(code & own[:, bit]).sum(axis=1, dtype=np.float64)
    got = (2 * inside - query[5][j]) / math.sqrt(d)
    deviation = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(d - 1, 1))
    return got / factor, deviation + step


def refined(d: int, coded, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates from all eight bits of both vectors, and one deviation: each level is off by a step's sixth in variance."""
    levels, low, step = coded[2:5]
    a, b = levels[i].astype(np.float32), levels[j].astype(np.float32)
    both = np.einsum("ij,ij->i", a, b).astype(np.float64)
    got = d * low[i] * low[j] + low[i] * step[j] * b.sum(axis=1) + low[j] * step[i] * a.sum(axis=1) + step[i] * step[j] * both
    return got, np.sqrt((step[i] ** 2 + step[j] ** 2) / 6) + 1e-6


def intervals(d: int, coded, part: slice) -> tuple[np.ndarray, np.ndarray]:
    """Middles and half widths of intervals that hold the inner products of rows `part` with all rows, for certain.

    Of a pair both orders, and any group it is in, give the same bits: products of levels are whole numbers below
    2^53, and each of the sums has operands that may change places.
    """
    _, _, levels, low, step, _, rest = coded
    whole = levels.astype(np.float64)
    sums = step * whole.sum(axis=1)
    middle = d * (low[part, None] * low) + (low[part, None] * sums + low * sums[part, None])
    middle += (step[part, None] * step) * (whole[part] @ whole.T)
    return middle, rest[part, None] + rest + rest[part, None] * rest + SLACK


def tables(count: int, cosine: float) -> tuple[int, int]:
    """(bits, tables) of the buckets for so many vectors."""
    bits = max(4, int(math.log2(max(count, 1) / 4 + 1)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of each length: row numbers and their vectors as doubles."""
    lengths = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        out[int(d)] = rows, flat[starts[rows][:, None] + np.arange(d)]
    return out


def _coded(classes: DataFrame, bits: int, count: int) -> DataFrame:
    """d, node, many, code (sign words, factor, low, step, total, rest and levels as bytes) and buckets (one a table) of each class."""

    def each(batch):
        for d, (rows, vectors) in _matrix(batch.column("embedding")).items():
            code, factor, levels, *numbers = codes(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
            packed = np.concatenate((code, *(x[:, None].view(np.uint64) for x in (factor, *numbers))), axis=1).view(np.uint8)
            packed = np.concatenate((packed, levels), axis=1)
            signs = vectors @ rotation(d, 1 + -(-bits * count // d))[d:].T > 0
            buckets = np.zeros((len(rows), count), np.int64)
            for b in range(bits):
                buckets = buckets * 2 + signs[:, b : bits * count : bits]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(rows), d, np.int32)),
                    *(batch.column(c).take(pa.array(rows)) for c in ("node", "many")),
                    pa.array([x.tobytes() for x in packed], pa.binary()),
                    pa.array(list(buckets), pa.list_(pa.int64())),
                ],
                names=["d", "node", "many", "code", "buckets"],
            )

    return map_arrow(classes.select("node", "many", "embedding"), each, "d int, node long, many long, code binary, buckets array<long>")


def _unpacked(d: int, column: pa.Array):
    """code, factor, levels, low, step, total, rest of packed codes."""
    words = -(-d // 64)
    whole = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 8 * words + 40 + d)
    numbers = np.ascontiguousarray(whole[:, : 8 * words + 40]).view(np.uint64)
    factor, low, step, total, rest = (np.ascontiguousarray(numbers[:, words + i]).view(np.float64) for i in range(5))
    return numbers[:, :words], factor, whole[:, 8 * words + 40 :], low, step, total, rest


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after links between a and b: the least row that each reaches."""
    while True:
        least = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], least)
        np.minimum.at(after, label[b], least)
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _candidates(rows: pa.Table, cosine: float) -> pa.RecordBatch:
    """A spanning forest (a, b) of the pairs that bounds don't rule out, of whole groups, sorted by group."""
    keys = [rows.column(c).to_numpy() for c in KEY]
    new = np.zeros(rows.num_rows, np.int64)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new)
    node, lengths, own = (rows.column(c).to_numpy() for c in ("node", "d", "own"))
    within = rows.column("block").to_numpy() == rows.column("other").to_numpy()
    packed, label = rows.column("code").combine_chunks(), np.arange(rows.num_rows)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        coded = _unpacked(int(d), packed.take(pa.array(at)))
        high = planes(coded[2])
        g, shift, i = group[at], 0, np.arange(len(at))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            shift += 1
            i = i[i + shift < len(at)]
            i = i[g[i] == g[i + shift]]
            if not len(i):
                break
            x, y = i, i + shift
            a, b = at[x], at[y]
            # Of a pair of blocks only pairs across count; rows of one block meet in that block's own group.
            ok = (within[a] | (own[a] != own[b])) & (label[a] != label[b])
            a, b, x, y = a[ok], b[ok], x[ok], y[ok]
            if len(a):
                guess, deviation = estimate(int(d), coded, coded, high, x, y)
                near = guess + EPSILON * deviation >= cosine
                a, b, x, y = a[near], b[near], x[near], y[near]
                guess, deviation = refined(int(d), coded, x, y)
                near = guess + EPSILON * deviation >= cosine
                found.append((a[near], b[near]))
            if shift % 16 == 0 and found:
                label, found = _joined(label, *(np.concatenate(z) for z in zip(*found, strict=True))), []
        if found:
            label = _joined(label, *(np.concatenate(z) for z in zip(*found, strict=True)))
    some = np.flatnonzero(label != np.arange(rows.num_rows))
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]])], names=["a", "b"])


def _within(rows: pa.Table, cosine: float) -> pa.RecordBatch:
    """node, links, root, unsure of members of whole groups: links and a spanning forest of them.

    Without vectors links are what intervals tell for certain, and unsure are members with a pair that they leave
    open; with vectors links are those of such pairs, recomputed.
    """
    keys = np.stack([rows.column(c).to_numpy() for c in KEY], axis=1)
    edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
    node, many, own = (rows.column(c).to_numpy() for c in ("node", "many", "own"))
    packed, exact = rows.column("code").combine_chunks(), "embedding" in rows.column_names
    links, label, unsure = np.zeros(len(node), np.int64), np.arange(len(node)), np.zeros(len(node), bool)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        d, across = int(keys[lo, 0]), keys[lo, 3] != keys[lo, 4]
        coded = _unpacked(d, packed.slice(lo, hi - lo))
        if exact:
            ((_, values),) = _matrix(rows.column("embedding").slice(lo, hi - lo).combine_chunks()).values()
            norms = np.linalg.norm(values, axis=1)
        for s in range(0, hi - lo, BLOCK):
            part = slice(s, min(s + BLOCK, hi - lo))
            middle, half = intervals(d, coded, part)
            later = np.arange(hi - lo) > np.arange(part.start, part.stop)[:, None]  # each pair once
            if across:
                later &= own[lo:hi][part, None] != own[lo:hi]
            sure = middle - half >= cosine
            x, y = np.nonzero(later & ~sure & (middle + half >= cosine))
            x += s
            if exact:
                hits = []
                for at in range(0, len(x), PAIRS):
                    i, j = x[at : at + PAIRS], y[at : at + PAIRS]
                    hits.append(np.einsum("ij,ij->i", values[i], values[j]) / (norms[i] * norms[j]) >= cosine)
                hit = np.concatenate(hits) if hits else np.zeros(0, bool)
                x, y = x[hit], y[hit]
            else:
                unsure[lo + x] = unsure[lo + y] = True
                x, y = np.nonzero(later & sure)
                x += s
            if len(x):
                np.add.at(links, lo + x, many[lo + y])
                np.add.at(links, lo + y, many[lo + x])
                label = _joined(label, lo + x, lo + y)
    some = np.flatnonzero((links > 0) | unsure)
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[label[some]]), pa.array(unsure[some])], names=["node", "links", "root", "unsure"])


def _grouped(rows: DataFrame, each: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Whole groups of KEY, some ROWS rows at a time."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(c).to_numpy() for c in KEY]
            same = np.logical_and.reduce([c == c[-1] for c in columns])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield each(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
        if size:
            yield each(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, schema)


def _in_blocks(rows: DataFrame, *key: str) -> DataFrame:
    """Rows with block, other, own: groups of more than HOT rows are cut into blocks, and their rows go to every pair of blocks."""
    hot = rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > HOT)
    hot = hot.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    spread = rows.join(hot, list(key), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("block", F.least("own", "to")).withColumn("other", F.greatest("own", "to")).drop("to", "blocks")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    scratch = Scratch(vectors.sparkSession, "codes")
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    usable = e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e, usable.alias("usable"))
    classes = rows.where("usable").groupBy("embedding").agg(F.count("*").alias("many"), F.min("vec_id").alias("least"))
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    coded = scratch.table(_coded(classes, *tables(classes.count(), cosine)), "coded")
    dealt = coded.select("d", "node", "code", F.posexplode("buckets").alias("slot", "bucket"))
    maybe = _grouped(_in_blocks(dealt, "d", "slot", "bucket"), lambda t: _candidates(t, cosine), "a long, b long")
    clusters = scratch.table(components(maybe, scratch, "maybe").withColumnRenamed("component", "bucket"), "clusters")
    members = clusters.join(coded, "node").select("d", F.lit(0).alias("slot"), "bucket", "node", "many", "code")
    kind = "node long, links long, root long, unsure boolean"
    told = scratch.table(_grouped(_in_blocks(members, "d", "slot", "bucket"), lambda t: _within(t, cosine), kind), "told")
    unsure = members.join(told.where("unsure").select("node").distinct(), "node", "left_semi").join(classes.select("node", "embedding"), "node")
    found = scratch.table(told.union(_grouped(_in_blocks(unsure, "d", "slot", "bucket"), lambda t: _within(t, cosine), kind)), "found")
    scratch.drop("coded", "told")
    whole = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").join(links, "node", "left")
    named = scratch.table(named.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id"), "named")
    scratch.drop("found", "classes", "clusters")
    good = rows.where("usable").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
