"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

A document is its token ids and an end id; only one longer than the sequence is cut, into full
pieces after a possibly shorter first one.  Full pieces fill a sequence each.  The others are dealt
by a hash into blocks of about BLOCK_ITEMS pieces, and each block is a bin-packing problem.

For a block several islands evolve packings.  A chromosome is a list of bins.  Crossover takes
well-filled bins of one parent whole into a copy of the other, removes the bins that hold any of
the same pieces, and best-fits what these displaced, longest first; the fittest have the fewest
bins, then the largest sum of squared fills.  Between epochs each island's best packing also goes to
the next island of a ring: populations are rows, migration is one shuffle of them, so an epoch is
a restartable task.  An island stops early when it reaches the bound ceil(sum of lengths / size).

Blocks round up apart, so a last round packs the LOOSE emptiest bins of each, of JOINED blocks together, by the same
search, and takes its packing where it needs fewer bins.

Null text is empty: one piece, the end id alone.  Repeated rows, null or repeated doc_ids are packed
as rows of their own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import HELD, Scratch, fresh, map_arrow, partitions
from lexloom.llm.wordpiece_counts import byte_names

SIZE, BLOCK_ITEMS, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1024, 4096, 3, 2, 6, 6
#: Blocks whose emptiest bins are packed together in the end, and how many bins of each.
JOINED, LOOSE = 64, 4
#: Words whose ids a worker keeps, and the bytes of these words and ids; an executor has several workers, idle ones among them.
#: As many words are looked up at a time.
CACHED, CACHED_BYTES, AT_ONCE = 100_000, 1 << 23, 4096
#: A word by itself takes some three times as long as within a text: where the table is full and more than one in NEW words
#: isn't in it, texts are encoded whole, and the table is tried again after RESTS texts.
NEW, RESTS = 8, 64
#: Characters of a text encoded whole that go to the encoder at a time, as it gives out a list of numbers.
STRETCH = 1 << 16


#: Fixed value: the public word pattern of byte-level vocabularies of this kind.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a text can be cut: no match of the pattern goes across the beginning of such a space.
GAP = re.compile(r"(?<=\S) (?=\S)")


def stretches(text: str) -> Iterator[str]:
    """A text in pieces that are encoded one by one, of STRETCH characters and what is left until a gap."""
    at = 0
    while len(text) - at > STRETCH and (gap := GAP.search(text, at + STRETCH)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, by the vocabulary of one tokenizer file.

    Ids are the tokenizer's own (its merges are ranked by id, so a rank encoder gives them, several
    times as fast).  A text is first cut at the file's added tokens, which have ids of their own.  The
    pattern never matches across a GAP, so ids of what stands between them are those of its space-led
    words in turn; ids of the first words are kept in a table bounded in words and bytes, within a long
    text too.  Where texts bring many words that a full table lacks, they are encoded in long stretches,
    to the same ids.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary, added = whole["model"]["vocab"], whole.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in what is beside them aren't supported")
        byte_of = {name: byte for byte, name in byte_names().items()}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.led: dict[str, bytes] = {}
        self.led_bytes = 0
        self.rests = 0
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if added else None

    def _raw(self, text: str) -> bytes:
        return array("I", self.encoding.encode_ordinary(text)).tobytes()

    def ids(self, text: str) -> bytes:
        """The tokenizer's ids of a text, added tokens among them."""
        if self.cuts is None or not any(t in text for t in self.added):
            return self.encode(text)
        return b"".join(self.added[part] if part in self.added else self.encode(part) for part in self.cuts.split(text))

    def encode(self, text: str) -> bytes:
        """The ids of a text without added tokens, or with these read as plain text."""
        if self.rests:
            self.rests -= 1
            return b"".join(map(self._raw, stretches(text)))
        parts = GAP.split(text)
        return self._raw(parts[0]) + b"".join(self._words(parts[at : at + AT_ONCE]) for at in range(1, len(parts), AT_ONCE))

    def _words(self, words: list[str]) -> bytes:
        """The ids of words that a space leads, in turn."""
        led = self.led
        try:
            return b"".join(map(led.__getitem__, words))
        except KeyError:
            new = set(words).difference(led)
            full = len(led) > CACHED or self.led_bytes > CACHED_BYTES
            if full and len(new) * NEW > len(words):
                self.rests = RESTS
                return self._raw(" " + " ".join(words))
            for w in new:
                led[w] = self._raw(" " + w)
            ids = b"".join(map(led.__getitem__, words))
            if full:
                for w in new:
                    del led[w]
            else:
                self.led_bytes += sum(len(w) + len(led[w]) for w in new)
            return ids


_encoders: dict[str, Encoder] = HELD.setdefault(__name__, {})


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    end = np.array([end_id], "<u4").tobytes()

    def each(batch):
        tool = encoder(tokenizer)
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        out: list[list] = [[], [], [], [], []]
        for doc, text in zip(ids, texts, strict=True):
            got = tool.ids(text.as_py() or "") + end
            for i, (start, length) in enumerate(cut(len(got) // 4, size)):
                for column, value in zip(out, (doc, i, start, length, zlib.crc32(memoryview(got)[4 * start : 4 * (start + length)])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, each, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of pieces with best-fit insertion: a bit set of the free amounts in use finds the tightest bin."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0

    def open(self, items: list[int], left: int | None = None) -> None:
        if left is None:
            left = self.size - sum(self.lengths[i] for i in items)
        self.bins.append(list(items))
        self.free.append(left)
        self.by_free[left].append(len(self.bins) - 1)
        self.mask |= 1 << left

    def best_fit(self, item: int) -> None:
        length = self.lengths[item]
        fits = self.mask >> length
        if not fits:
            return self.open([item])
        left = (fits & -fits).bit_length() - 1 + length
        where = self.by_free[left].pop()
        if not self.by_free[left]:
            self.mask &= ~(1 << left)
        self.bins[where].append(item)
        left -= length
        self.free[where] = left
        self.by_free[left].append(where)
        self.mask |= 1 << left
        return None

    def fitness(self) -> tuple[int, int]:
        return -len(self.bins), sum((self.size - f) ** 2 for f in self.free)


def packed(lengths: list[int], order, size: int) -> Packing:
    out = Packing(lengths, size)
    for item in order:
        out.best_fit(item)
    return out


def crossover(one: Packing, other: Packing, rng: random.Random) -> Packing:
    """`one` with a random half of the well-filled bins of `other`, repaired by best fit."""
    full = sorted(range(len(other.bins)), key=other.free.__getitem__)
    full = full[: max(1, len(full) * 9 // 10)]
    taken = rng.sample(full, max(1, len(full) // 2))
    inside = {i for b in taken for i in other.bins[b]}
    bins, free = [other.bins[b] for b in taken], [other.free[b] for b in taken]
    displaced = []
    for items, left in zip(one.bins, one.free, strict=True):
        if inside.isdisjoint(items):
            bins.append(items)
            free.append(left)
        else:
            displaced += [i for i in items if i not in inside]
    # The emptiest bins are dissolved too, so that their pieces may fill others.
    order = sorted(range(len(bins)), key=free.__getitem__, reverse=True)[: max(1, len(bins) // 50)]
    drop = set(order)
    displaced += [i for b in drop for i in bins[b]]
    fresh = Packing(one.lengths, one.size)
    for b, items in enumerate(bins):
        if b not in drop:
            fresh.open(items, free[b])
    for item in sorted(displaced, key=lambda i: (-one.lengths[i], i)):
        fresh.best_fit(item)
    return fresh


def evolve(lengths: list[int], start: list[list[int]], seed: int, size: int = SIZE) -> list[Packing]:
    """A population after GENERATIONS, fittest first; start: bin numbers of each piece, by packing."""
    rng = random.Random(seed)
    n = len(lengths)
    people: list[tuple[tuple[int, int], Packing]] = []
    add = lambda p: people.append((p.fitness(), p))
    fittest = lambda: sorted(people, key=lambda x: x[0], reverse=True)[:POPULATION]
    for bins in start:
        groups: dict[int, list[int]] = {}
        for item, b in enumerate(bins):
            groups.setdefault(b, []).append(item)
        p = Packing(lengths, size)
        for items in groups.values():
            p.open(items)
        add(p)
    if not people:
        add(packed(lengths, sorted(range(n), key=lambda i: (-lengths[i], i)), size))
    bound = -(-sum(lengths) // size)
    if len(fittest()[0][1].bins) <= bound:
        return [p for _, p in fittest()]
    while len(people) < POPULATION:
        noise = [x * rng.uniform(0.7, 1.3) for x in lengths]
        add(packed(lengths, sorted(range(n), key=lambda i: -noise[i]), size))
    for _ in range(GENERATIONS):
        people = fittest()
        if len(people[0][1].bins) <= bound:
            break
        for _ in range(POPULATION // 2):
            (_, one), (_, other) = rng.sample(people[: max(2, POPULATION * 2 // 3)], 2)
            add(crossover(one, other, rng))
    return [p for _, p in fittest()]


def _numbers(p: Packing) -> np.ndarray:
    out = np.zeros(len(p.lengths), np.int32)
    for b, items in enumerate(p.bins):
        out[items] = b
    return out


def loosest(lengths: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """The pieces in the LOOSE emptiest bins that aren't full, bin by bin."""
    fill = np.bincount(bins, lengths).astype(np.int64)
    chosen = np.argsort(fill, kind="stable")[:LOOSE]
    chosen = chosen[(fill[chosen] < size) & (fill[chosen] > 0)]
    return np.flatnonzero(np.isin(bins, chosen))


def repack(best: DataFrame, size: int) -> DataFrame:
    """_block, moved (places of pieces), bins, offsets of pieces that a joint packing of many blocks' emptiest bins places anew; best: _block, lengths, best."""

    def loose(batch):
        for block, lengths, bins in zip(*(batch.column(c) for c in ("_block", "lengths", "best")), strict=True):
            lengths, bins = lengths.values.to_numpy(), bins.values.to_numpy()
            at = loosest(lengths, bins, size)
            columns = [pa.array([block.as_py() // JOINED]), pa.array([block.as_py()]), *(pa.array([x], pa.list_(pa.int32())) for x in (at, lengths[at], bins[at]))]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "_block", "moved", "lengths", "bins"])

    def solve(batch):
        for group, rows in zip(batch.column("group").to_pylist(), batch.column("rows").to_pylist(), strict=True):
            lengths = [n for r in rows for n in r["lengths"]]
            numbers: dict[tuple[int, int], int] = {}
            old = [numbers.setdefault((r["_block"], b), len(numbers)) for r in rows for b in r["bins"]]
            new = evolve(lengths, [old, _numbers(packed(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), size)).tolist()], group & 0xFFFFFFFF, size)[0]  # noqa: B023
            if not lengths or len(new.bins) >= len(numbers):
                continue
            bins, fill, offsets = _numbers(new).tolist(), [0] * len(new.bins), []
            for b, n in zip(bins, lengths, strict=True):
                offsets.append(fill[b])
                fill[b] += n
            at = np.cumsum([0, *(len(r["moved"]) for r in rows)]).tolist()
            cut = lambda x: [x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]  # noqa: E731, B023
            columns = [pa.array([r["_block"] for r in rows], pa.int64()), pa.array([r["moved"] for r in rows], pa.list_(pa.int32())), pa.array(cut(bins), pa.list_(pa.int32())), pa.array(cut(offsets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["_block", "moved", "bins", "offsets"])

    one = map_arrow(best.select("_block", F.col("lengths").cast("array<int>").alias("lengths"), "best"), loose, "group long, _block long, moved array<int>, lengths array<int>, bins array<int>", held=False)
    many = one.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("_block", "moved", "lengths", "bins"))).alias("rows"))
    return map_arrow(many, solve, "_block long, moved array<int>, bins array<int>, offsets array<long>", held=False)


def _placed(batch: pa.RecordBatch):
    """_block, sequences, offsets of each block's pieces: where the last round has placed them, or else the block's own."""
    for row in batch.to_pylist():
        sequences, offsets = (row["_block"] << 24) | np.array(row["best"], np.int64), np.array(row["offsets"], np.int64)
        if row["moved"] is not None:
            sequences[row["moved"]] = (1 << 61) | ((row["_block"] // JOINED) << 24) | np.array(row["bins"], np.int64)
            offsets[row["moved"]] = row["again"]
        yield pa.RecordBatch.from_arrays([pa.array([row["_block"]]), pa.array([sequences], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64()))], names=["_block", "sequences", "offsets"])


def pack(items: DataFrame, size: int = SIZE) -> DataFrame:
    """All columns of a piece table (with `length`), and sequence_id and offset, which take the place of columns so named."""
    spark = items.sparkSession
    scratch = Scratch(spark, "pack")
    columns = [c for c in items.columns if c.lower() not in ("sequence_id", "offset")]
    key, home = fresh(columns, "_key"), fresh(columns, "_home")
    rows = scratch.table(items.select(*(F.col(f"`{c}`") for c in columns), F.monotonically_increasing_id().alias(key)), "pieces", many=True)
    full = rows.where(F.col("length") >= size).withColumn("sequence_id", -1 - F.col(key)).withColumn("offset", F.lit(0).cast("long"))
    part = rows.where(F.col("length") < size)
    blocks = max(1, -(-part.count() // BLOCK_ITEMS))
    dealt = part.withColumn(home, F.pmod(F.xxhash64(key), F.lit(blocks)))
    grouped = dealt.groupBy(F.col(home).alias("_block")).agg(F.sort_array(F.collect_list(F.struct(key, *(F.col(f"`{c}`") for c in columns)))).alias("items"))
    grouped = scratch.table(grouped, "blocks")
    lengths = grouped.select("_block", F.col("items.length").alias("lengths"))

    def epoch(number: int):
        def each(batch):
            for block, island, own, start in zip(*(batch.column(c).to_pylist() for c in ("_block", "island", "lengths", "start")), strict=True):
                people = evolve(own, start, hash((block, island, number)) & 0xFFFFFFFF, size)
                best = people[0]
                fill, offsets, at = np.zeros(len(best.bins), np.int64), np.zeros(len(own), np.int64), _numbers(best)
                if number == EPOCHS - 1:
                    for i, b in enumerate(at):
                        offsets[i] = fill[b]
                        fill[b] += own[i]
                bins, squares = best.fitness()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([island], pa.int32()), pa.array([-bins], pa.int32()), pa.array([-squares], pa.int64()), pa.array([at], pa.list_(pa.int32())), pa.array([offsets], pa.list_(pa.int64())), pa.array([[_numbers(p) for p in people]], pa.list_(pa.list_(pa.int32())))],
                    names=["_block", "island", "bins", "squares", "best", "offsets", "people"],
                )

        return each

    schema = "_block long, island int, bins int, squares long, best array<int>, offsets array<long>, people array<array<int>>"
    state = lengths.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))))
    state = state.withColumn("start", F.array().cast("array<array<int>>"))
    for number in range(EPOCHS):
        ready = state.select("_block", "island", "lengths", "start").repartition(partitions(spark), "_block", "island")
        done = scratch.table(map_arrow(ready, epoch(number), schema, held=False), f"epoch-{number}")
        if number:
            scratch.drop(f"epoch-{number - 1}")
        elites = done.select("_block", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.array("best").alias("people"))
        moved = done.select("_block", "island", "people").union(elites)
        moved = moved.groupBy("_block", "island").agg(F.flatten(F.collect_list("people")).alias("start"))
        state = moved.join(lengths, "_block")
    best = done.groupBy("_block").agg(F.min_by(F.struct("best", "offsets"), F.struct("bins", "squares", "island")).alias("b")).select("_block", "b.*")
    best = scratch.table(best.join(lengths, "_block"), "best")
    again = repack(best, size).withColumnRenamed("offsets", "again")
    placed = map_arrow(best.drop("lengths").join(again, "_block", "left"), _placed, "_block long, sequences array<long>, offsets array<long>", held=False)
    joined = grouped.join(placed, "_block").select(F.explode(F.arrays_zip("items", "sequences", "offsets")).alias("z"))
    out = joined.select(*(F.col(f"z.items.`{c}`").alias(c) for c in columns), F.col("z.sequences").alias("sequence_id"), F.col("z.offsets").alias("offset"))
    return full.select(*(F.col(f"`{c}`") for c in columns), "sequence_id", "offset").union(out)
