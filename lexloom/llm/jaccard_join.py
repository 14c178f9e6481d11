"""Exact Jaccard similarity join of documents on word shingles, with several global token orders.

A document's set is its distinct k-word shingles (64-bit hashes of ASCII-lower-cased words).
Documents with equal sets (64-bit digest) are one node; only nodes are joined.  Two sets with Jaccard
similarity of t or more share at least ceil(t n) of either's n tokens, so they share a token among
the first n - ceil(t n) + 1 under any order of all tokens.  Several orders are used, the first of
them corpus-wide, the others where it has brought nodes together:

1. A node more than n - ceil(t n) of whose tokens stand in no other node is linked with nothing.
   Tokens below a hash bound are counted first (half of a node's tokens need be unique then),
   which drops most nodes; no node that has a link is dropped.
2. Order 1 is by the number of the remaining nodes that hold a token, rare first, counted exactly.  Nodes
   that share a prefix token under it are connected through that token's least node; linked
   nodes so stand in one cluster (a component of these connections), and clusters are small, since
   what many documents hold comes last in the order.
3. Within a cluster three orders are used: by the number of the cluster's nodes that hold a
   token, and two by hash.  A pair is a candidate only if its prefixes meet under all three and its
   sizes allow the similarity; candidates that aren't connected yet are verified on the whole sets.

A task gives a cluster's spanning forest, one row a node at most; pairs are never rows.  A cluster of
more than LIMIT tokens is cut into blocks, each pair of which is a task's group, so none is left out.

Results: components of the link graph, whole.  Null or empty text: empty set, linked with nothing.
Fewer than k words: the whole sequence is the one shingle.  Repeated rows and doc_ids keep their
rows; component_id is the least doc_id, nulls aside.  Empty tables give no rows.  Other columns are
ignored, and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import _words as W
from lexloom.llm._common import KeyFilter, Scratch, blocks_by_bytes, by_part, fresh, list_array, map_batches, text_buffers
from lexloom.llm.components import components

BLOCK = 1 << 18
_WORD = [W.U(x) for x in W.mix(np.arange(11, 11 + 64, dtype=np.uint64)) | W.U(1)]
_SAMPLE, _DEAL, _DIGEST = W.U(0x51ED270B7A9F3C11), W.U(0xA24BAED4963EE407), W.U(0x9FB21C651E98DF25)
_ORDERS = (W.U(0xD6E8FEB86659FD93), W.U(0xC2B2AE3D27D4EB4F))
MET, PART, LIMIT = 500_000, 1 << 20, 1 << 21


def shingle_sets(column: pa.Array, k: int):
    """Yields (row, sorted distinct uint64 shingle hashes) for every row of a text column."""
    data, offsets = text_buffers(column)
    for at, to in blocks_by_bytes(offsets, BLOCK):
        local = offsets[at : to + 1] - offsets[at]
        part = data[offsets[at] : offsets[to]]
        starts, ends, rows = W.words(part, local, W.SPACED)
        hashes = W.ranges_hash(W.prefix_sums(part, W.FOLDED), starts, ends) if len(starts) else np.empty(0, np.uint64)
        grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for i in range(k):
            grams += hashes[i : i + len(grams)] * _WORD[i]
        grams = W.mix(grams)
        first = np.searchsorted(rows, np.arange(to - at + 1))
        for i in range(to - at):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1])
                if len(own) > 1:
                    own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                total = np.sum(hashes[a:b] * np.array(_WORD[: b - a]), keepdims=True, dtype=np.uint64)
                own = W.mix(total + W.U(b - a))
            else:
                own = np.empty(0, np.uint64)
            yield at + i, own


def need(n: np.ndarray | int, percent: int):
    """Least intersection with any set that is as similar as asked."""
    return -(-percent * n // 100)


def digest(own: np.ndarray) -> int:
    """64 bits that stand for a set, as a signed number."""
    return int(W.mix(np.array([own.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(W.mix(own + _DIGEST))], np.uint64)).view(np.int64)[0]) if len(own) else 0


def share(percent: int) -> float:
    """The part of its tokens, by hash, that is looked at to rule a node out."""
    return min(1.0, 2 * (100 - percent) / 100)


def _sample(own: np.ndarray, percent: int) -> np.ndarray:
    return own[W.mix(own ^ _SAMPLE) <= W.U(int(share(percent) * (2**64 - 1)))]


def encode(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_key, n, node (64-bit digest of the set), bare: no token of the set is in its sample."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, nodes, bare = [], [], []
            for _, own in shingle_sets(batch.column("text"), k):
                n.append(len(own))
                nodes.append(digest(own))
                bare.append(len(own) > 0 and not len(_sample(own, percent)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bare)], names=["doc_id", "text_key", "n", "node", "bare"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "text_key")
    return map_batches(rows, run, "doc_id long, text_key long, n long, node long, bare boolean")


def samples(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """node, n, tokens: tokens below a hash bound.  A task gives a node once or seldom more, several tasks may give it.

    A pass over the texts of its own: made again, samples needn't be stored beside the shuffle that they go through.
    """

    def run(batches):
        met: set[int] = set()
        for batch in batches:
            if len(met) > MET:
                met.clear()
            found = {}
            for _, own in shingle_sets(batch.column("text"), k):
                node = digest(own)
                if len(own) and node not in met:
                    met.add(node)
                    found[node] = len(own), _sample(own, percent)
            if found:
                n, taken = zip(*found.values(), strict=True)
                tokens = list_array(np.concatenate(taken).view(np.int64), np.array([len(x) for x in taken]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(n, pa.int64()), tokens], names=["node", "n", "tokens"])

    return map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "node long, n long, tokens array<long>")


def _deal(sets: DataFrame, parts: int) -> DataFrame:
    """Tokens (node, n, tokens) dealt by their hash: part, nodes, sizes, counts (of tokens of each), keys (32 more bits).

    Tokens of equal part and key count as one; that only makes a token look more frequent.
    """
    small = np.uint16 if parts < 1 << 16 else np.uint32

    def run(batches):
        for batch in batches:
            lists = batch.column("tokens")
            lengths, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy().view(np.uint64)
            if not len(flat):
                continue
            hashes = W.mix(flat + _DEAL)
            part = ((hashes >> W.U(32)) % W.U(parts)).astype(small)
            by = np.argsort(part, kind="stable")
            part, keys, row = part[by], hashes[by].astype(np.uint32).view(np.int32), np.repeat(np.arange(len(lengths)), lengths)[by]
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            present, where, tokens = np.unique(part, return_index=True, return_counts=True)
            runs = np.diff(np.append(np.searchsorted(at, where), len(at)))
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_numpy().astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(present.astype(np.int32)),
                    list_array(nodes[row[at]], runs, pa.int64()),
                    list_array(sizes[row[at]], runs, pa.int32()),
                    list_array(np.diff(np.append(at, len(part))).astype(np.int32), runs, pa.int32()),
                    list_array(keys, tokens, pa.int32()),
                ],
                names=["part", "nodes", "sizes", "counts", "keys"],
            )

    return map_batches(sets.select("node", "n", "tokens"), run, "part int, nodes array<long>, sizes array<int>, counts array<int>, keys array<int>")


def _to_nodes(parts: int, nodes: np.ndarray, sizes: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    """Values of nodes packed by a hash of the node."""
    part = (W.mix(nodes.view(np.uint64)) % W.U(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    present, counts = np.unique(part, return_counts=True)
    columns = {"nodes": nodes, "sizes": sizes.astype(np.int32)} | values
    kinds = {"nodes": pa.int64(), "sizes": pa.int32()}
    lists = [list_array(v[by], counts, kinds.get(c) or pa.from_numpy_dtype(v.dtype)) for c, v in columns.items()]
    return pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *lists], names=["part", *columns])


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it each group of equals starts."""
    by = np.argsort(keys, kind="stable")
    sorted_keys = keys[by]
    return by, np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def hopeful(sampled: DataFrame, percent: int, total: int) -> DataFrame:
    """node of the nodes (node, n, tokens: some of its tokens, by hash; may repeat) that aren't ruled out by unique tokens.

    total: about how many tokens there are.  Nodes without tokens aren't given back.
    """
    parts = max(8, -(-total // PART))

    def count(_, got):
        local, inverse = np.unique(got["nodes"], return_inverse=True)
        holder = np.repeat(inverse, got["counts"])
        by, starts = _groups(got["keys"])
        holder = holder[by]
        low, high = np.minimum.reduceat(holder, starts), np.maximum.reduceat(holder, starts)
        sizes = np.zeros(len(local), np.int32)
        sizes[inverse] = got["sizes"]
        return _to_nodes(parts, local, sizes, unique=np.bincount(low[low == high], minlength=len(local)).astype(np.int32))

    def decide(_, got):
        by, starts = _groups(got["nodes"])
        sizes, unique = got["sizes"][by][starts].astype(np.int64), np.add.reduceat(got["unique"][by].astype(np.int64), starts)
        return pa.RecordBatch.from_arrays([pa.array(got["nodes"][by][starts][unique <= sizes - need(sizes, percent)])], names=["node"])

    counted = by_part(_deal(sampled, parts), count, "part int, nodes array<long>, sizes array<int>, unique array<int>")
    return by_part(counted, decide, "node long")


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, token: prefixes under order 1, without tokens that one node alone holds; sets: node, n, tokens."""
    parts = max(8, -(-(sets.agg(F.sum("n")).first()[0] or 0) // PART))

    def count(part, got):
        sizes, nodes = np.repeat(got["sizes"], got["counts"]), np.repeat(got["nodes"], got["counts"])
        by, starts = _groups(got["keys"])
        held = np.diff(np.append(starts, len(by)))
        held = np.repeat(held, held)
        some = by[held > 1]
        tokens = (W.U(part) << W.U(32)) | got["keys"][some].view(np.uint32).astype(np.uint64)
        return _to_nodes(parts, nodes[some], sizes[some], tokens=tokens.view(np.int64), held=held[held > 1].astype(np.int32))

    def decide(_, got):
        by = np.lexsort((got["tokens"], got["held"], got["nodes"]))
        nodes, sizes, tokens = got["nodes"][by], got["sizes"][by].astype(np.int64), got["tokens"][by]
        starts = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))) if len(nodes) else np.empty(0, np.int64)
        shared = np.diff(np.append(starts, len(nodes)))
        place = np.arange(len(nodes)) - np.repeat(starts, shared)
        first = sizes - np.repeat(shared, shared)  # places before them are of tokens of its own
        some = first + place < sizes - need(sizes, percent) + 1
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(tokens[some])], names=["node", "token"])

    counted = by_part(_deal(sets, parts), count, "part int, nodes array<long>, sizes array<int>, tokens array<long>, held array<int>")
    return by_part(counted, decide, "node long, token long")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """node, n, tokens of the wanted nodes, from one more pass over the texts, of which a filter leaves those that may be theirs."""
    some = rows.where("n > 0").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    some = scratch.table(some, "wanted")
    texts = docs.select("text_key", F.col("text").cast("string").alias("text"))
    make = KeyFilter(some.select("text_key")).tester()

    def run(batches):
        met: set[int] = set()
        test = make()
        for batch in batches:
            batch = batch.filter(pa.array(test(batch.column("text_key").to_numpy())))
            if len(met) > MET:
                met.clear()
            found = {}
            for _, own in shingle_sets(batch.column("text"), k):
                node = digest(own)
                if len(own) and node not in met:
                    met.add(node)
                    found[node] = own
            if found:
                lengths = np.array([len(x) for x in found.values()])
                tokens = list_array(np.concatenate(list(found.values())).view(np.int64), lengths, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(lengths, pa.int64()), tokens], names=["node", "n", "tokens"])

    made = map_batches(texts, run, "node long, n long, tokens array<long>")
    return scratch.table(made.join(some.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")


class _Prefixes:
    """The sets' prefixes under one order, as an inverted index: which earlier sets hold a token of a set's prefix."""

    def __init__(self, tokens: np.ndarray, p: np.ndarray):
        self.offsets = np.concatenate(([0], np.cumsum(p)))
        own = np.repeat(np.arange(len(p)), p)
        by = np.argsort(tokens, kind="stable")  # sets of a token stay in order
        self.sets, told = own[by], tokens[by]
        new = np.concatenate(([True], told[1:] != told[:-1]))
        self.ends, self.starts = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        self.ends[by] = np.arange(len(by))
        self.starts[by] = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        self.earlier = np.add.reduceat(self.ends - self.starts, self.offsets[:-1])

    def meet(self, x: int) -> np.ndarray:
        """Earlier sets that share a token of the prefix of x, with repeats."""
        at = slice(self.offsets[x], self.offsets[x + 1])
        starts, ends = self.starts[at], self.ends[at]
        some = np.flatnonzero(ends > starts)
        return np.concatenate([self.sets[a:b] for a, b in zip(starts[some], ends[some], strict=True)])

    def last(self, x: int) -> np.ndarray:
        """The last of these of each token."""
        at = slice(self.offsets[x], self.offsets[x + 1])
        ends = self.ends[at]
        return self.sets[ends[ends > self.starts[at]] - 1]


def forest(tokens: np.ndarray, n: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the least number of a set that it reaches by links; with sides, links are between the two sides only.

    A set looks at the earlier ones that an inverted index of prefixes gives under every order; those that
    are connected with it by then need no look, and the others are verified a few at a time, since the first
    link often connects the rest.
    """
    m = len(n)
    offsets = np.concatenate(([0], np.cumsum(n)))
    distinct, ids = np.unique(tokens, return_inverse=True)
    held, row = np.bincount(ids), np.repeat(np.arange(m), n)
    place = np.arange(len(ids)) - offsets[row]
    p = n - need(n, percent) + 1
    indexes = []
    for order in (np.lexsort((distinct, held)), *(np.argsort(W.mix(distinct ^ salt)) for salt in _ORDERS)):
        rank = np.empty(len(distinct), np.int64)
        rank[order] = np.arange(len(distinct))
        by = np.lexsort((rank[ids], row))
        indexes.append(_Prefixes(ids[by][place < p[row]], p))
    own, met = np.zeros(len(distinct), bool), np.zeros(m, bool)
    label, members = np.arange(m), {}

    def join(x: int, ys: np.ndarray) -> None:
        """One label for the components of x and ys: the largest's, so that a set changes its own seldom."""
        roots = np.unique(np.append(label[ys], label[x]))
        groups = [members.pop(r, [r]) for r in roots.tolist()]
        groups.sort(key=len)
        largest = groups.pop()
        name = label[largest[0]]
        for group in groups:
            label[group] = name
            largest += group
        members[int(name)] = largest

    def able(x: int, ys: np.ndarray) -> np.ndarray:
        """Those that aren't connected with x and may be linked with it by their sizes."""
        ys = ys[label[ys] != label[x]]
        ys = ys[100 * np.minimum(n[x], n[ys]) >= percent * np.maximum(n[x], n[ys])]
        return np.unique(ys if side is None else ys[side[ys] != side[x]])

    def verify(x: int, ys: np.ndarray) -> None:
        """Joins x with those of ys that are linked with it; its tokens are in `own`."""
        at, few = 0, 1
        while at < len(ys):
            some = ys[at : at + few]
            at, few = at + few, min(2 * few, 256)
            some = some[label[some] != label[x]]
            if len(some):
                flat = np.concatenate([own[ids[offsets[y] : offsets[y + 1]]] for y in some])
                common = np.add.reduceat(flat.astype(np.int64), np.cumsum(n[some]) - n[some])
                linked = some[100 * common >= percent * (n[x] + n[some] - common)]
                if len(linked):
                    join(x, linked)

    for x in np.flatnonzero(np.logical_and.reduce([index.earlier > 0 for index in indexes])).tolist():
        own[ids[offsets[x] : offsets[x + 1]]] = True
        verify(x, able(x, indexes[0].last(x))[-4:])
        ys = able(x, indexes[0].meet(x))
        for index in indexes[1:]:
            if len(ys):
                found = index.meet(x)
                met[found] = True
                ys = ys[met[ys]]
                met[found] = False
        verify(x, ys)
        own[ids[offsets[x] : offsets[x + 1]]] = False
    least = np.full(m, m)
    np.minimum.at(least, label, np.arange(m))
    return least[label]


def _links(grouped: DataFrame, percent: int) -> DataFrame:
    """(a, b): a node and a node that it reaches, within groups (cluster, block, other)."""
    key = ["cluster", "block", "other"]

    def solve(held):
        nodes = np.concatenate([b.column("node").to_numpy() for b in held])
        if len(nodes) < 2:
            return None
        tokens = np.concatenate([b.column("tokens").flatten().to_numpy() for b in held]).view(np.uint64)
        n = np.concatenate([b.column("n").to_numpy() for b in held])
        block, other = held[0].column("block")[0].as_py(), held[0].column("other")[0].as_py()
        side = None if block == other else np.concatenate([b.column("own").to_numpy() for b in held])
        label = forest(tokens, n, percent, side)
        some = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[label[some]])], names=["a", "b"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in key], axis=1)
            edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)])) if len(keys) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and tuple(keys[a]) != now and (made := solve(held)) is not None:
                    yield made
                if tuple(keys[a]) != now:
                    held, now = [], tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held and (made := solve(held)) is not None:
            yield made

    return map_batches(grouped.repartition(*key).sortWithinPartitions(*key), run, "a long, b long")


def _labels(docs: DataFrame, rows: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """node, component of the nodes that are linked with others."""
    total = math.ceil(share(percent) * (rows.agg(F.sum("n")).first()[0] or 0))
    wanted = hopeful(samples(docs, k, percent), percent, total).union(rows.where("bare").select("node").distinct())
    sets = _sets(docs, rows, wanted, k, scratch)
    scratch.drop("wanted")
    prefixes = scratch.table(rare_prefixes(sets, percent), "prefixes")
    hubs = prefixes.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").select("token", "hub")
    met = prefixes.join(hubs, "token").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = scratch.table(components(met, scratch, "clusters").withColumnRenamed("component", "cluster"), "clusters")
    scratch.drop("prefixes")
    total = sets.select("node", "n").join(clusters, "node").groupBy("cluster").agg(F.sum("n").alias("total"))
    blocks = total.select("cluster", F.ceil(F.col("total") / LIMIT).cast("int").alias("blocks"))
    dealt = sets.join(clusters, "node").join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("block", F.least("own", "to")).withColumn("other", F.greatest("own", "to")).drop("to", "blocks")
    found = components(_links(dealt, percent), scratch, "linked")
    scratch.drop("sets", "clusters")
    return found


def _components(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, n, component (a node, null without words), component_id of every row; docs has a text_key."""
    rows = scratch.table(encode(docs, k, percent), "rows", many=True)
    whole = _labels(docs, rows, k, percent, scratch)
    # Least doc_ids of equal sets first: copies are folded before the shuffle.
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(whole, "node", "left")
    least = least.withColumn("component", F.coalesce("component", "node"))
    names = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(names, "component").select("node", "component", "component_id")
    out = rows.select("doc_id", "text_key", "n", "node").join(named, "node", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id", "text_key", "n", F.when(~alone, F.col("component")).alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("text_key"))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    scratch, own = Scratch(docs.sparkSession, "components"), Scratch(docs.sparkSession, "jaccard")
    out = _components(_keyed(docs), k, percent, own).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = scratch.table(out, "out")
    own.clear()
    return out


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """All columns of the documents that stay: of each component the one of least doc_id (nulls first), once; all without words."""
    columns = docs.columns
    scratch, own = Scratch(docs.sparkSession, "keep"), Scratch(docs.sparkSession, "jaccard")
    found = scratch.table(_components(_keyed(docs), k, percent, own).where("component is not null").select("doc_id", "text_key", "component"), "rows")
    own.clear()
    # Of the rows of a component, (doc_id, text) stays if it is the least; rows that stand twice are folded.
    # They meet by themselves, not by their component, which may hold a third of all rows.
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").alias("doc"), F.col("text_key").alias("key"))).alias("first")).select("first.*")
    told = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("c"))
    told = told.join(first, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("key")), "left").withColumn("goes", F.col("key").isNull())
    told = told.where("goes or c > 1").select("doc_id", "text_key", "goes", F.xxhash64("doc_id", "text_key").alias("both"))
    told = scratch.table(told, "told")
    # Columns of our own get names that no column of the table has.
    id_, key, both, goes = (fresh(columns, c) for c in ("_id", "_key", "_both", "_goes"))
    of_id, of_key = (fresh([*columns, id_, key, both, goes], c) for c in ("_idm", "_keym"))
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(F.col("text").cast("string"))).withColumn(both, F.xxhash64(id_, key))
    keys = KeyFilter(told.select("both"))
    marks = told.select(F.col("doc_id").alias(of_id), F.col("text_key").alias(of_key), F.col("goes").alias(goes))
    some = keys.keep(keyed, both).join(marks, F.col(id_).eqNullSafe(F.col(of_id)) & (F.col(key) == F.col(of_key)), "left")
    once = some.where(f"not `{goes}`").dropDuplicates([id_, key])
    out = keys.keep(keyed, both, False).select(*columns).union(some.where(f"`{goes}` is null").select(*columns))
    return out.union(once.select(*columns))
