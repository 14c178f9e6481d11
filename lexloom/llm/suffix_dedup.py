"""Removal of every byte that lies in a repeated L-byte string, by collection suffix order.

Texts are UTF-8 bytes; strings are judged on the input, matches never cross documents, and all
occurrences go.  The suffix order of the whole corpus isn't needed at once, for equal strings can
be brought together first:

1. Each L-byte string is put under its anchor, the k-byte string within it of least hash (the
   leftmost of equals).  Equal strings have equal anchors at equal distance.  Neighbouring starts
   share an anchor, so a text yields a row for each run of about L / 2 starts.  Most anchors that occur
   once end here; the others' runs are parted by the anchor's distance, so that all strings of
   a part share a core of some L / 2 bytes.  Parts whose core occurs once end here.
2. Equal parts (128 bits of hashes of their bytes) are one piece.  A piece is parted again by the
   anchor's distance into groups of FINE starts, whose strings have all but FINE - 1 bytes in common;
   these are one symbol, unlike any byte, and with the bytes left and right of it they are a short
   document of 2 FINE - 1 symbols at most.  A piece that occurs several times gives two of each.
3. Short documents are dealt by their core; of equal ones two stay.  So what a core gets is bounded by
   the different contexts of FINE - 1 bytes beside it, not by how many texts hold it.  Whole cores go
   into collections of some COLLECTION symbols, whose Burrows-Wheeler transform and common prefixes are
   built column by column (collection_bwt): starts of suffixes that share FINE symbols, that is L
   bytes, with a neighbour are repeated.  Nothing else decides what goes.
4. What was found for a piece holds for all its places; the spans of each text are merged and cut.

A core's symbol is told by 64 bits of hash, and FINE - 1 bytes beside it are compared as such.

Null text is empty; texts shorter than L keep all; repeated rows are repeats of each other; repeated
or null doc_ids stay apart by their text; empty tables give no rows; other columns are ignored (and
kept by `cut_texts` whatever their names, where a character cut in half goes whole).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import _words as W
from lexloom.llm._common import KeyFilter, Scratch, by_part, fresh, list_array, map_arrow, map_batches, text_buffers
from lexloom.llm.collection_bwt import repeated_starts

K, CHUNK, FINE, COLLECTION, CORES, PART = 32, 1 << 18, 8, 1 << 18, 60_000, 1 << 18
_LOW = W.U((1 << 22) - 1)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, W.U(2**64 - 1))
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    right = np.minimum.accumulate(grid, axis=1).ravel()
    left = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]):
    """Runs of starts under one anchor: (length, text number, first start, starts, anchor place, base, hash sums, hashes).

    Yields for each length and chunk of the bytes laid end to end; places are within the chunk, which
    begins at `base`.  The hashes of a chunk serve all lengths.
    """
    for s in range(0, max(0, len(data) - min(lengths) + 1), CHUNK):
        part = data[s : s + CHUNK + max(lengths) - 1]
        sums = W.prefix_sums(part, W.PLAIN)
        n = max(0, len(part) - K + 1)
        hashes = W.mix((sums[K:] - sums[:-K]) * W.powers(W._RINV, n) + W.U(K))
        marked = (hashes & ~_LOW) | np.arange(n, dtype=np.uint64)
        for length in lengths:
            size = min(CHUNK, len(part) - length + 1)  # starts
            if size < 1:
                continue
            least = _window_min(marked, length - K + 1)[:size]
            # Runs end where the anchor or the text changes, and before starts whose string would leave the text.
            first, last = np.searchsorted(offsets, (s, s + size), side="right") - 1
            inside = offsets[first : last + 1] - s
            outside = offsets[first + 1 : last + 2] - s - length + 1
            edges = np.concatenate(([0, size], np.flatnonzero(least[1:] != least[:-1]) + 1, inside, outside))
            edges = np.unique(edges[(edges >= 0) & (edges <= size)])
            starts, ends = edges[:-1], edges[1:]
            texts = np.searchsorted(offsets, starts + s, side="right") - 1
            valid = starts + s + length <= offsets[texts + 1]
            starts, ends, texts = starts[valid], ends[valid], texts[valid]
            if len(starts):
                yield length, texts, starts, ends - starts, (least[starts] & _LOW).astype(np.int64), s, sums, hashes


def _salted(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of one length, unlike those of another."""
    return W.mix(hashes + W.U(length))


def anchors_twice(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """anchor: salted hashes that stand over more than one run of starts."""

    def each(batch):
        for length, _, _, _, anchors, _, _, hashes in runs(*text_buffers(batch.column("text")), lengths):
            yield pa.RecordBatch.from_arrays([pa.array(_salted(hashes[anchors], length).view(np.int64))], names=["anchor"])

    found = map_arrow(docs.select("text"), each, "anchor long")
    return found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")


def anchor_rows(docs: DataFrame, lengths: tuple[int, ...], filtered: KeyFilter) -> DataFrame:
    """Of runs whose anchor passes the filter: length, doc_id, dk, lo, n, off and, for both parts, core and document hashes."""
    make = filtered.tester()

    def each(batch):
        data, offsets = text_buffers(batch.column("text"))
        ids, keys, test = batch.column("doc_id"), batch.column("dk"), make()
        for length, texts, first, counts, anchors, s, sums, hashes in runs(data, offsets, lengths):
            half = (length - K) // 2
            some = test(_salted(hashes[anchors], length).view(np.int64))
            texts, first, counts, anchors = texts[some], first[some], counts[some], anchors[some]
            end = first + counts  # one past the last start
            split = np.clip(anchors - half + 1, first, end)  # starts before it: the anchor is `half` or more away
            ends = np.minimum(anchors + length - half, len(sums) - 1)
            near, far = W.ranges_hash(sums, anchors, ends), W.ranges_hash(sums, np.maximum(anchors - half, 0), anchors + K)
            near, far = _salted(near, length), _salted(far, length)
            own = [W.ranges_hash(sums, a, np.maximum(b - 1 + length, a)) ^ W.mix((anchors - a).astype(np.uint64)) for a, b in ((first, split), (split, end))]
            as_long = lambda x: pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(texts), length, np.int32)), ids.take(pa.array(texts)), keys.take(pa.array(texts)),
                    pa.array(first + s - offsets[texts]), pa.array((split - first).astype(np.int32)), pa.array((end - split).astype(np.int32)), pa.array((anchors - first).astype(np.int32)),
                    as_long(far), as_long(near), as_long(own[0]), as_long(own[1]),
                ],
                names=["length", "doc_id", "dk", "lo", "n0", "n1", "off", "core0", "core1", "own0", "own1"],
            )

    schema = "length int, doc_id long, dk long, lo long, n0 int, n1 int, off int, core0 long, core1 long, own0 long, own1 long"
    return map_arrow(docs, each, schema)


def _packed(data: np.ndarray, place: np.ndarray, count: np.ndarray, step: int) -> np.ndarray:
    """Up to seven bytes from a place on, or back from it, in 64 bits whose highest byte is their count."""
    out = count.astype(np.uint64) << W.U(56)
    for j in range(FINE - 1):
        some = np.flatnonzero(count > j)
        out[some] |= data[place[some] + step * j].astype(np.uint64) << W.U(8 * j)
    return out


def _documents(pieces: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """Short documents of pieces (pid, length, doc_id, dk, lo, n, off, twice), packed: part (of the core), cores, lefts, rights, pids, ats.

    lefts and rights are the bytes beside the core, ats twice the first start within the piece, and 1 if the piece stands twice.
    """
    fields = ("pid", "length", "lo", "n", "off")
    listed = pieces.groupBy("doc_id", "dk").agg(F.collect_list(F.struct(*fields, "twice")).alias("parts"))
    wanted = KeyFilter(listed.select("dk")).keep(texts, "dk")
    joined = wanted.join(listed, wanted.doc_id.eqNullSafe(listed.doc_id) & (wanted.dk == listed.dk)).select("text", "parts")
    names = ["cores", "lefts", "rights", "pids", "ats"]

    def each(batch):
        data, offsets = text_buffers(batch.column("text"))
        lists = batch.column("parts")
        own = lists.flatten()
        pid, length, lo, n, off = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in fields)
        twice = own.field("twice").to_numpy(zero_copy_only=False).astype(np.int64)
        begin = lo + np.repeat(offsets[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))  # in data
        window = begin // CHUNK
        by = np.argsort(window, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(window[by])) + 1) if len(by) else []:
            base = int(window[some[0]]) * CHUNK
            part = data[base : base + CHUNK + 3 * int(length[some].max())]
            low = begin[some] - base
            anchor, end = low + off[some], low + n[some]
            far, near = (anchor - low) // FINE, (anchor - end + 1) // FINE
            counts = far - near + 1
            which = np.repeat(np.arange(len(some)), counts)
            quotient = np.repeat(far, counts) - (np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts))
            whole = anchor[which] - quotient * FINE  # the start nearest to the anchor that such a document can hold
            at, to = np.maximum(low[which], whole - FINE + 1), np.minimum(end[which], whole + 1)
            after = whole - FINE + 1 + length[some][which]
            cores = W.ranges_hash(W.prefix_sums(part, W.PLAIN), whole, after)  # that of another length is another
            columns = [
                cores,
                _packed(part, whole - 1, whole - at, -1),
                _packed(part, after, to + FINE - 2 - whole, 1),
                pid[some][which],
                2 * (at - low[which]) + twice[some][which],
            ]
            home = (W.mix(cores) % W.U(parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            present, sizes = np.unique(home, return_counts=True)
            packed = [list_array(c[order].view(np.int64), sizes, pa.int64()) for c in columns[:-1]]
            packed.append(list_array(columns[-1][order].astype(np.int32), sizes, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *packed], names=["part", *names])

    return map_arrow(joined, each, "part int, " + "".join(f"{c} array<long>, " for c in names[:-1]) + "ats array<int>")


def _strings(cores: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short documents as symbols laid end to end, and their offsets; cores are numbered from 256."""
    left, right = ((x >> W.U(56)).astype(np.int64) for x in (lefts, rights))
    offsets = np.concatenate(([0], np.cumsum(left + right + 1)))
    data = np.empty(offsets[-1], np.uint32)
    middle = offsets[:-1] + left
    data[middle] = 256 + np.unique(cores, return_inverse=True)[1]
    for j in range(FINE - 1):
        for packed, count, sign in ((lefts, left, -1), (rights, right, 1)):
            some = np.flatnonzero(count > j)
            data[middle[some] + sign * (j + 1)] = ((packed[some] >> W.U(8 * j)) & W.U(255)).astype(np.uint32)
    return data, offsets


def _repeated(cores: np.ndarray, lefts: np.ndarray, rights: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each short document the bits of its starts that are repeated; weight: 2 for those that stand twice."""
    by = np.lexsort((rights, lefts, cores))
    c, x, y = cores[by], lefts[by], rights[by]
    new_core = np.concatenate(([True], c[1:] != c[:-1]))
    new = new_core | np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    document = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    copies = np.minimum(np.add.reduceat(weight[by], first), 2)
    c, x, y = c[first], x[first], y[first]
    group = np.cumsum(new_core[first]) - 1
    several = np.bincount(group, weights=copies)[group] > 1
    bits = np.zeros(len(first), np.uint8)
    chosen = np.flatnonzero(several)
    sizes = copies[chosen] * (1 + 2 * (FINE - 1))
    # Whole cores to a collection, up to so many symbols and cores.
    ends = np.cumsum(sizes)
    ordinal = np.cumsum(np.concatenate(([0], np.diff(group[chosen]) > 0))) if len(chosen) else np.empty(0, np.int64)
    slot = np.maximum(ends // COLLECTION, ordinal // CORES)
    lead = np.flatnonzero(np.diff(group[chosen], prepend=-1))
    slot = np.repeat(slot[lead], np.diff(np.append(lead, len(chosen)))) if len(chosen) else slot
    for part in np.split(chosen, np.flatnonzero(np.diff(slot)) + 1) if len(chosen) else []:
        row = np.repeat(part, copies[part])
        string, start = repeated_starts(*_strings(c[row], x[row], y[row]), FINE)
        np.bitwise_or.at(bits, row[string], (np.uint8(1) << start.astype(np.uint8)))
    out = np.empty(len(by), np.uint8)
    out[by] = bits[document]
    return out


_BITS = np.arange(256, dtype=np.uint8)
_RISES = np.unpackbits(_BITS[:, None] & ~(_BITS[:, None] << 1), axis=1, bitorder="little").sum(axis=1)  # runs of ones
_LOWEST, _ONES = np.array([(x & -x).bit_length() - 1 for x in range(256)]), np.bitwise_count(_BITS).astype(np.int64)


def _runs_of_bits(ats: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of ones; bit i of a row stands for its start + i."""
    one = np.flatnonzero(_RISES[bits] == 1)
    first = ats[one] + _LOWEST[bits[one]]
    more = np.flatnonzero(_RISES[bits] > 1)
    row, bit = np.nonzero(np.unpackbits(bits[more][:, None], axis=1, bitorder="little"))
    single = ats[more][row] + bit
    return np.concatenate((one, more[row])), np.concatenate((first, single)), np.concatenate((first + _ONES[bits[one]] - 1, single))


def _spans_of_pieces(documents: DataFrame, parts: int) -> DataFrame:
    """pid, a, b: runs [a, b) of repeated starts within pieces, from the collections' transforms."""

    def solve(_, got):
        bits = _repeated(got["cores"].view(np.uint64), got["lefts"].view(np.uint64), got["rights"].view(np.uint64), 1 + (got["ats"] & 1))
        row, first, last = _runs_of_bits((got["ats"] >> 1).astype(np.int64), bits)
        pids = got["pids"][row]
        home = (W.mix(pids.view(np.uint64)) % W.U(parts)).astype(np.int64)
        by = np.argsort(home, kind="stable")
        present, sizes = np.unique(home, return_counts=True)
        lists = [list_array(v[by], sizes, pa.int64()) for v in (pids, first, last)]
        return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *lists], names=["part", "pids", "firsts", "lasts"])

    def join(_, got):
        by = np.lexsort((got["firsts"], got["pids"]))
        pids, first, last = (got[c][by] for c in ("pids", "firsts", "lasts"))
        new = np.concatenate(([True], (pids[1:] != pids[:-1]) | (first[1:] > last[:-1] + 1)))
        at = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(pids[at]), pa.array(first[at]), pa.array(last[np.append(at[1:], len(pids)) - 1] + 1)], names=["pid", "a", "b"])

    found = by_part(documents, solve, "part int, pids array<long>, firsts array<long>, lasts array<long>")
    return by_part(found, join, "pid long, a long, b long")


def spans(texts: DataFrame, lengths: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """doc_id, dk and the list of repeated spans (length, a, b) of every text (doc_id, dk, text) that has any.

    Strings of each length are judged by themselves; runs and pieces of all lengths go through the same jobs.
    """
    if min(lengths) < 2 * K or max(lengths) >= 1 << 20:
        raise ValueError(f"lengths outside {2 * K} to {(1 << 20) - 1}: {lengths}")
    # Runs of an anchor that occurs once are kept out by the filter, or else below, where their cores occur once.
    rows = scratch.table(anchor_rows(texts, lengths, KeyFilter(anchors_twice(texts, lengths), 26)), "twice", many=True)
    side = lambda i, lo, off: rows.where(f"n{i} > 0").select(F.col(f"core{i}").alias("core"), F.col(f"own{i}").alias("own"), "length", "doc_id", "dk", lo, F.col(f"n{i}").alias("n"), off)
    parts = side(0, "lo", "off").union(side(1, (F.col("lo") + F.col("n0")).alias("lo"), (F.col("off") - F.col("n0")).alias("off")))
    # Lengths, starts and distances of a run are one number on their way.
    shape = F.shiftleft(F.col("length").cast("long"), 42).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 21)).bitwiseOR(F.col("off").cast("long"))
    known = parts.groupBy("core", "own").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "dk", "lo", shape.alias("shape"))).alias("r"))
    unpacked = [F.shiftright("r.shape", by).bitwiseAND((1 << 21) - 1).cast("int").alias(name) for name, by in (("length", 42), ("n", 21), ("off", 0))]
    known = known.select("core", "own", "c", "r.doc_id", "r.dk", "r.lo", *unpacked)
    known = scratch.table(known.withColumn("pid", F.monotonically_increasing_id()), "known")
    several = known.groupBy("core").agg(F.sum("c").alias("m")).where("m > 1").select("core")
    pieces = known.join(several, "core", "left_semi").select("pid", "doc_id", "dk", "lo", "length", "n", "off", (F.col("c") > 1).alias("twice"))
    pieces = scratch.table(pieces, "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    deal = max(8, -(-total // FINE // PART))
    # One length at a time, so that the short documents of one are gone before those of the next are made.
    found = None
    for length in lengths:
        documents = _documents(pieces.where(F.col("length") == length), texts, deal)
        part = scratch.table(_spans_of_pieces(documents, deal), f"found-{length}")
        found = part if found is None else found.union(part)
    scratch.drop("pieces")
    told = found.join(known.select("pid", "core", "own", "length"), "pid").select("core", "own", "length", "a", "b")
    every = parts.drop("length", "n", "off").join(told, ["core", "own"]).select("doc_id", "dk", "length", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b") - 1 + F.col("length")).alias("b"))
    out = scratch.table(every.groupBy("doc_id", "dk").agg(F.collect_list(F.struct("length", "a", "b")).alias("spans")), "spans")
    scratch.drop("twice", "known", *(f"found-{length}" for length in lengths))
    return out


def merged(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): maximal spans of one length of each row of a column of span lists, in order."""
    own = column.flatten()
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    kind, a, b = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "a", "b"))
    some = np.flatnonzero(kind == length)
    some = some[np.lexsort((a[some], row[some]))]
    row, a, b = row[some], a[some], b[some]
    if not len(row):
        return row, a, b
    # Ends so far, row by row: rows are told apart by a step that no place within a text reaches.
    step = row * (b.max() + 2)
    reach = np.maximum.accumulate(b + step)
    new = np.concatenate(([True], a[1:] + step[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return row[at], a[at], (reach - step)[np.append(at[1:], len(row)) - 1]


def _cut(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray):
    """What is left of each text, as a list of pieces of bytes."""
    first = np.searchsorted(row, np.arange(len(offsets)))
    for i in range(len(offsets) - 1):
        raw, at, out = data[offsets[i] : offsets[i + 1]], 0, []
        for j in range(first[i], first[i + 1]):
            out.append(raw[at : a[j]])
            at = b[j]
        out.append(raw[at:])
        yield out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("dk", F.xxhash64("doc_id", "text"))


def cut_digests(docs: DataFrame, length: int = 400, shorter: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; shorter: and n_shared, its bytes in repeated strings of that length."""
    texts = _keyed(docs)
    found = spans(texts, (length,) if shorter is None else (length, shorter), Scratch(docs.sparkSession, "suffix"))
    found = found.select(F.col("doc_id").alias("doc"), F.col("dk").alias("key"), "spans")
    keys = KeyFilter(found.select("key"))
    none = F.lit(0).cast("long")
    whole = keys.keep(texts, "dk", False).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), none.alias("n_shared")
    )
    some = keys.keep(texts, "dk")
    joined = some.join(found, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("dk") == F.col("key")), "left").select("doc_id", "text", "spans")

    def each(batch):
        data, offsets = text_buffers(batch.column("text"))
        row, a, b = merged(batch.column("spans"), length)
        digests = []
        for kept in _cut(data, offsets, row, a, b):
            digest = hashlib.sha256()
            for piece in kept:
                digest.update(piece.tobytes())
            digests.append(digest.hexdigest())
        n = batch.num_rows
        count = lambda row, weights=None: pa.array(np.bincount(row, weights, n).astype(np.int64))
        row2, a2, b2 = (row, a, b) if shorter is None else merged(batch.column("spans"), shorter)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), count(row, b - a), count(row), pa.array(digests, pa.string()), count(row2, b2 - a2)],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared"],
        )

    out = whole.union(map_arrow(joined, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long"))
    return out if shorter is not None else out.drop("n_shared")


def cut_texts(docs: DataFrame, length: int = 400) -> DataFrame:
    """All rows and columns, each text without its repeated strings; a text of which nothing is left is empty."""
    scratch = Scratch(docs.sparkSession, "suffix")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Columns of our own get names that no column of the table has.
    dk, doc, key, cuts = (fresh(docs.columns, c) for c in ("dk", "_doc", "_dk", "_spans"))
    keyed = docs.withColumn(dk, F.xxhash64(F.col("doc_id").cast("long"), text))
    found = spans(_keyed(docs), (length,), scratch)
    keys = KeyFilter(found.select("dk"))
    hits = found.select(F.col("doc_id").alias(doc), F.col("dk").alias(key), F.col("spans").alias(cuts))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(dk) == F.col(key))
    joined = keys.keep(keyed, dk).join(hits, match, "left").drop(doc, key, dk)
    columns, place = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(place))
            row, a, b = merged(batch.column(len(columns)), length)
            texts = []
            for i, kept in enumerate(_cut(data, offsets, row, a, b)):
                texts.append(batch.column(place)[i].as_py() if len(kept) == 1 else "".join(k.tobytes().decode("utf-8", "ignore") for k in kept))
            out = [batch.column(i) for i in range(len(columns))]
            out[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return keys.keep(keyed, dk, False).drop(dk).union(map_batches(joined, run, docs.schema))
