"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse text features.

Features: presence of hashed words and of word beginnings of 4 to 8 bytes (ASCII letters folded
to lower case), so marker words and marker stems of other languages count alike.  Grades: 0 for
rows labelled clean; rows labelled toxic get 1, or 2 if at least as many different marker features
(those seen mostly in toxic rows) occur as in the median toxic row.  One weight vector is shared by
the ordered thresholds: P(grade > k) = sigmoid(x.w - theta_k), theta_0 < theta_1.  The score is the
expected severity, the sum of P(grade > k); a text is toxic if P(grade > 0) >= 0.5.

The model is fitted on a bounded sample of the labelled rows: the SAMPLE_TOXIC toxic and
SAMPLE_CLEAN clean ones whose hashed doc_id is least (weighted back to the label shares).  Scoring
covers every row and its whole text.  A doc_id that documents or labels repeat counts once in the sample.  Null or empty text: grade 0 by its intercept.  No labels,
or of one kind only: every row gets severity 0.  Repeated rows score alike; null labels and labels
without a document are left out; other columns are ignored by `score` and kept by `keep_clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import _words as W
from lexloom.llm._common import Scratch, blocks_by_bytes, list_array, map_arrow, map_batches, text_buffers

SAMPLE_TOXIC, SAMPLE_CLEAN, FEATURES = 4000, 8000, 1024
PREFIXES = (4, 5, 6, 7, 8)
BLOCK = 1 << 18
#: Features are told by 64-bit keys; a table of so many leading bits only spares most of them the search.
NEAR = 20


class Model:
    def __init__(self, keys: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights, self.thresholds = keys[order], weights[order], thresholds
        self.near = np.zeros(1 << NEAR, bool)
        self.near[self.keys >> W.U(64 - NEAR)] = True

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.keys, self.weights, self.thresholds

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the features have a weight, and its place."""
        some = np.flatnonzero(self.near[found >> W.U(64 - NEAR)])
        at = np.searchsorted(self.keys, found[some])
        same = np.flatnonzero(at < len(self.keys))
        same = same[self.keys[at[same]] == found[some[same]]]
        return some[same], at[same]


def _features(part: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and beginning, with repeats."""
    starts, ends, rows = W.words(part, local, W.LETTERS)
    if not len(starts):
        return rows, np.empty(0, W.U)
    sums = W.prefix_sums(part, W.FOLDED)
    found, whose = [W.ranges_hash(sums, starts, ends)], [rows]
    for n in PREFIXES:
        at = np.flatnonzero(ends - starts > n)
        hashes = W.ranges_hash(sums, starts[at], starts[at] + n)
        found.append(W.mix(hashes + W.U(n)))
        whose.append(rows[at])
    return np.concatenate(whose), np.concatenate(found)


def _blocks(column: pa.Array):
    data, offsets = text_buffers(column)
    for at, to in blocks_by_bytes(offsets, BLOCK):
        yield at, to, *_features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])


def labelled_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, weight and distinct features of the bounded training sample."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    kinds = []
    for toxic, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC)):
        part = rows.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        kinds.append(part.withColumn("weight", F.lit(max(1.0, total.get(toxic, 0) / most))))
    sample = kinds[0].union(kinds[1])
    # Bounded: at most SAMPLE_CLEAN + SAMPLE_TOXIC rows of three numbers.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # A doc_id counts once, whatever repeats it: as toxic if any label says so, with the least of its texts.
    joined = joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max_by("weight", "toxic").alias("weight"), F.min("text").alias("text"))

    def each(batch):
        lists, sizes = [], []
        for at, to, rows_, found in _blocks(batch.column("text")):
            order = np.lexsort((found, rows_))
            rows_, found = rows_[order], found[order]
            first = np.ones(len(found), bool)
            first[1:] = (rows_[1:] != rows_[:-1]) | (found[1:] != found[:-1])
            lists.append(found[first].view(np.int64))
            sizes.append(np.bincount(rows_[first], minlength=to - at))
        column = list_array(np.concatenate(lists), np.concatenate(sizes), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), column], names=["toxic", "weight", "features"])

    return map_arrow(joined.select("toxic", "weight", "text"), each, "toxic int, weight double, features array<long>")


def cumulative_fit(rows: np.ndarray, cols: np.ndarray, n: int, width: int, grades: np.ndarray, weight: np.ndarray, steps: int = 400, l2: float = 0.3):
    """Weights and ordered thresholds by Adam on the penalised log-likelihood."""
    top = int(grades.max())
    w, first, gaps = np.zeros(width), np.array([3.0]), np.zeros(max(0, top - 1))
    theta = lambda: np.concatenate((first, first[0] + np.cumsum(np.exp(gaps))))[:top]
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, first, gaps)]
    scale = weight / weight.sum()
    for step in range(1, steps + 1):
        th = np.concatenate(([-np.inf], theta(), [np.inf]))
        eta = np.bincount(rows, w[cols], n)
        above = 1 / (1 + np.exp(-np.clip(eta - th[grades], -60, 60)))
        beyond = 1 / (1 + np.exp(-np.clip(eta - th[grades + 1], -60, 60)))
        p = np.maximum(above - beyond, 1e-12)
        d_eta = (1 - above - beyond) * scale
        d_theta = np.bincount(grades, -above * (1 - above) / p * scale, top + 2)[: top + 2]
        d_theta[1:] += np.bincount(grades, beyond * (1 - beyond) / p * scale, top + 1)[: top + 1]
        inner = d_theta[1 : top + 1]
        grads = [np.bincount(cols, d_eta[rows], width) - l2 * w / n, inner.sum(keepdims=True), np.array([inner[i + 1 :].sum() for i in range(top - 1)]) * np.exp(gaps)]
        for x, g, (m, v) in zip((w, first, gaps), grads, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w, theta()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = fit_rows(scratch.table(labelled_features(docs, labels), "sample", many=True))
    scratch.clear()
    pa.default_memory_pool().release_unused()
    return model


def telling(table: DataFrame, n1: int, n0: int) -> DataFrame:
    """feature, p1, p0 of the most telling features: by the gap between the two kinds in standard errors."""
    counts = table.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("c1"), F.count("*").alias("c"))
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1), (F.col("c") - F.col("c1") + 0.5) / (n0 + 1)
    shares = counts.where("c >= 4").select("feature", p1.alias("p1"), p0.alias("p0"))
    z = F.abs(F.col("p1") - F.col("p0")) / F.sqrt(F.col("p1") * (1 - F.col("p1")) / n1 + F.col("p0") * (1 - F.col("p0")) / n0)
    return shares.withColumn("z", z).where("z > 0").orderBy(F.desc("z"), "feature").limit(FEATURES)


def fit_rows(table: DataFrame) -> Model:
    """The model of rows toxic, weight, features; the driver sees only the chosen features of them."""
    none = Model(np.empty(0, W.U), np.empty(0, np.float32), np.array([60.0, 61.0]))
    total = {r["toxic"]: r["n"] for r in table.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return none
    best = telling(table, total[1], total[0]).collect()
    chosen = Model(np.array([r["feature"] for r in best], np.int64).view(W.U), np.array([r["p1"] > 4 * r["p0"] for r in best], bool), none.thresholds)
    spread = table.sparkSession.sparkContext.broadcast(chosen.parts())

    def each(batch):
        lists = batch.column("features")
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(W.U)
        rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        some, place = Model(*spread.value).find(flat)
        column = list_array(place.astype(np.int32), np.bincount(rows[some], minlength=len(lists)), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("weight"), column], names=["toxic", "weight", "places"])

    got = map_arrow(table, each, "toxic int, weight double, places array<int>").toArrow()
    toxic, weight = got.column("toxic").to_numpy().astype(np.int64), got.column("weight").to_numpy()
    lists = got.column("places").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    cols = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(toxic), dtype=np.int32), lists.value_lengths().to_numpy())
    hits = np.bincount(rows, chosen.weights[cols], len(toxic))  # of markers
    grades = np.where(toxic == 1, 1 + (hits >= np.median(hits[toxic == 1])), 0).astype(np.int64)
    if (grades == 1).sum() == 0:
        grades = np.minimum(grades, 1)
    w, theta = cumulative_fit(rows, cols, len(toxic), len(chosen.keys), grades, weight)
    return Model(chosen.keys, w.astype(np.float32), theta)


def score_column(column: pa.Array, model: Model) -> np.ndarray:
    """P(grade > k) of each text: an array (texts, thresholds)."""
    eta = np.zeros(len(column))
    for at, to, rows, found in _blocks(column):
        some, place = model.find(found)
        keys = np.unique(rows[some] * FEATURES + place)
        eta[at:to] = np.bincount(keys // FEATURES, model.weights[keys % FEATURES].astype(np.float64), to - at)
    return 1 / (1 + np.exp(-np.clip(eta[:, None] - model.thresholds[None, :], -60, 60)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, grade, p_toxic and toxic of every row."""
    spread = docs.sparkSession.sparkContext.broadcast(model.parts())  # at most FEATURES weights go to the executors
    held: dict = {}

    def each(batch):
        if not held:
            held["model"] = Model(*spread.value)
        p = score_column(batch.column("text"), held["model"])
        severity = p.sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(severity), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)],
            names=["doc_id", "severity", "grade", "p_toxic", "toxic"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, each, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that aren't toxic, with all their columns, in one pass and without a join."""
    spread = docs.sparkSession.sparkContext.broadcast(model.parts())
    held: dict = {}
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if not held:
                held["model"] = Model(*spread.value)
            keep = score_column(batch.column(place), held["model"])[:, 0] < 0.5
            yield batch.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)
