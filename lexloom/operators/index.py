"""Inverted indexes: postings, document frequency, block-wise construction and merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import all_text, analyze, char_ngrams, split_words, word_characters

#: Ids of one posting row span at most so many numbers, so no row grows with the corpus.
SEGMENT = 1 << 16
#: A segment of more ids is stored as a bitmap.
DENSE = SEGMENT // 32


def record_text() -> Column:
    """Every field of a record, its number first, in one lower-cased text."""
    return all_text(*map(F.col, ("Index", "Title", "Author", "bib_source", "Abstract")))


def postings(docs: DataFrame, analyzer=analyze) -> DataFrame:
    """term, doc_id: the distinct terms of each record's four text fields.

    Tokens are made distinct within the record, so nothing is shuffled yet.
    """
    text = F.concat_ws(" ", "Title", "Author", "bib_source", "Abstract")
    return docs.select(F.explode(F.array_distinct(analyzer(text))).alias("term"), F.col("Index").alias("doc_id"))


def document_frequency(post: DataFrame) -> DataFrame:
    """term, df: records that hold a term (a repeated Index counts as often as it stands)."""
    return post.groupBy("term").agg(F.count("*").alias("df"))


def inverted_index(post: DataFrame) -> DataFrame:
    """term, df, segment, ids: posting lists in segments of ids, sorted, each id once."""
    cut = post.groupBy("term", F.floor(F.col("doc_id") / SEGMENT).alias("segment")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("doc_id")).alias("ids"))
    df = cut.groupBy("term").agg(F.sum("n").alias("df"))
    return cut.join(df, "term").select("term", "df", "segment", "ids")


def universe(post: DataFrame) -> DataFrame:
    """doc_id of documents with at least one term."""
    return post.select("doc_id").distinct()


def numbered(words: DataFrame, column: str, prefix: int = 3) -> DataFrame:
    """Rows with their `number` from 0 in the order of a column of distinct words.

    Words are counted within their first letters; only the counts of these, as many as there are
    beginnings of so few letters, are summed up in one task.
    """
    head = F.substring(column, 1, prefix)
    counts = words.groupBy(head.alias("head")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    starts = counts.select("head", before.alias("start"))
    placed = words.withColumn("head", head).withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(column)) - 1)
    return placed.join(starts, "head").withColumn("number", F.col("start") + F.col("place")).drop("head", "place", "start")


def lemmatized(post: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Postings whose terms are replaced by their lemma where a table (term, lemma) has one; each pair once."""
    known = lemmas.groupBy("term").agg(F.min("lemma").alias("lemma"))
    return post.join(known, "term", "left").select(F.coalesce("lemma", "term").alias("term"), "doc_id").distinct()


def segments(post: DataFrame, *by: str) -> DataFrame:
    """by, segment, n, places, bits: each segment's ids of each `by` (all, without) as one row.

    More than DENSE ids are a bitmap of SEGMENT bits, fewer are their places in the segment, so a row takes
    8 KB at most.  Null ids have no place.
    """
    where = F.floor(F.col("doc_id") / SEGMENT)
    place = (F.col("doc_id") - where * SEGMENT).cast("int")
    lists = post.where("doc_id is not null").groupBy(*by, where.alias("segment")).agg(F.sort_array(F.collect_set(place)).alias("places"))

    def pack(batches):
        for batch in batches:
            places = batch.column("places")
            sizes = places.value_lengths().to_numpy()
            ends, flat, bits = np.cumsum(sizes), places.flatten().to_numpy(), [None] * len(sizes)
            for i in np.flatnonzero(sizes > DENSE):
                held = np.zeros(SEGMENT, bool)
                held[flat[ends[i] - sizes[i] : ends[i]]] = True
                bits[i] = np.packbits(held).tobytes()
            few = pc.if_else(pa.array(sizes > DENSE), pa.scalar(None, places.type), places)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int32()), few, pa.array(bits, pa.binary())], names=[*batch.schema.names[:-1], "n", "places", "bits"])

    kinds = dict(lists.dtypes)
    return lists.mapInArrow(pack, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, "segment")), "n int, places array<int>, bits binary"]))


def members(places: np.ndarray | None, bits: bytes | None) -> np.ndarray:
    """The SEGMENT flags of a row of segments(); none of them for a missing row."""
    if bits is not None:
        return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    held = np.zeros(SEGMENT, bool)
    if places is not None:
        held[places] = True
    return held


def store(post: DataFrame, path: str) -> None:
    """Writes an index once, to be read by many queries: posting segments in ranges of terms, and the universe's beside them."""
    segments(post, "term").repartitionByRange("term").sortWithinPartitions("term", "segment").write.mode("overwrite").parquet(f"{path}/postings")
    stored = post.sparkSession.read.parquet(f"{path}/postings")
    segments(_documents(stored)).write.mode("overwrite").parquet(f"{path}/universe")


def _documents(lists: DataFrame) -> DataFrame:
    """doc_id of segments (segment, places, bits), each once for some terms: the terms' bits are put together within tasks."""

    def run(batches):
        flags = {}

        def told():
            for segment, held in flags.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(held) + segment * SEGMENT, pa.int64())], names=["doc_id"])
            flags.clear()

        for batch in batches:
            numbers, places, bits = batch.column("segment").to_pylist(), batch.column("places"), batch.column("bits")
            of = np.repeat(np.array(numbers, np.int64), pc.fill_null(pc.list_value_length(places), 0).to_numpy())
            flat = places.flatten().to_numpy()
            for segment in np.unique(of).tolist():
                flags.setdefault(segment, np.zeros(SEGMENT, bool))[flat[of == segment]] = True
            for i in np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False)).tolist():
                flags.setdefault(numbers[i], np.zeros(SEGMENT, bool))[:] |= members(None, bits[i].as_py())
            if len(flags) > 256:
                yield from told()
        yield from told()

    return lists.select("segment", "places", "bits").mapInArrow(run, "doc_id long")


class StoredIndex:
    """A stored index: a lookup reads only the row groups whose range of terms holds the asked ones."""

    def __init__(self, spark: SparkSession, path: str):
        self.lists, self.universe = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/universe")

    def segments(self, terms: list[str]) -> DataFrame:
        return self.lists.where(F.col("term").isin(terms))


def word_documents(docs: DataFrame) -> DataFrame:
    """word, doc_id: words of more than two characters of all text."""
    words = docs.select(F.explode(F.array_distinct(word_characters(record_text()))).alias("word"), F.col("Index").alias("doc_id"))
    return words.where(F.length("word") > 2).distinct()


def words(docs: DataFrame) -> DataFrame:
    """word: the distinct words of more than two characters of all text, counted out within tasks before they are exchanged."""
    each = docs.select(F.explode(F.array_distinct(word_characters(record_text()))).alias("word"))
    return each.where(F.length("word") > 2).distinct()


def ngram_words(dictionary: DataFrame, n: int = 2) -> DataFrame:
    """ngram, word."""
    return dictionary.select(F.explode(char_ngrams(F.col("word"), n)).alias("ngram"), "word")


def occurrences(docs: DataFrame) -> DataFrame:
    """term, doc_id of every white-space token of title and abstract: case, punctuation and repeats kept."""
    return docs.select(F.explode(split_words(F.concat_ws(" ", "Title", "Abstract"))).alias("term"), F.col("Index").alias("doc_id"))


def parse_blocks(tokens: DataFrame, block_size: int) -> DataFrame:
    """block_id, term, ids: tokens cut into blocks of so many distinct terms, as they come in each partition.

    A block ends as soon as it holds block_size distinct terms; a document may lie in two.  Blocks
    are numbered within partitions (partition number first), terms of a block are sorted, and
    ids stand once for each occurrence.  Terms are numbered in the order of their first occurrence
    a batch at a time, so no step is taken for each token; an open block is held as arrays.
    """

    def cut(batches):
        number, part, terms, docs = 0, None, pa.array([], pa.string()), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            terms = pa.concat_arrays([terms, batch.column("term").cast(pa.string())])
            docs = np.concatenate((docs, batch.column("doc_id").to_numpy()))
            while True:
                numbers = terms.dictionary_encode()  # in the order of first occurrence
                # The token that brings the block's last term; what follows it is numbered anew.
                full = np.flatnonzero(numbers.indices.to_numpy() == block_size - 1) if len(numbers.dictionary) >= block_size else []
                if not len(full):
                    break
                end = int(full[0]) + 1
                yield _block(part, number, terms[:end], docs[:end])
                number, terms, docs = number + 1, terms[end:], docs[end:]
        if len(terms):
            yield _block(part, number, terms, docs)

    placed = tokens.select(F.spark_partition_id().cast("long").alias("part"), "term", F.col("doc_id").cast("long").alias("doc_id"))
    return placed.mapInArrow(cut, "block_id string, term string, ids array<long>")


def _block(part: int, number: int, terms: pa.Array, docs: np.ndarray) -> pa.RecordBatch:
    coded = terms.dictionary_encode()
    sorted_terms = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(sorted_terms), np.int64)
    rank[sorted_terms] = np.arange(len(sorted_terms))
    place = rank[coded.indices.to_numpy()]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(rank)))))
    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(docs[np.argsort(place, kind="stable")]))
    names = pa.array([f"{part:06d}-{number:06d}"] * len(rank), pa.string())
    return pa.RecordBatch.from_arrays([names, coded.dictionary.take(pa.array(sorted_terms)), ids], names=["block_id", "term", "ids"])


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """term, segment, ids of all blocks: numeric, sorted, each once."""
    flat = blocks.select("term", F.explode("ids").alias("doc_id"))
    return merge_postings(flat)


def merge_postings(flat: DataFrame) -> DataFrame:
    """term, segment, ids of postings (term, doc_id): one shuffle whose sort spills is the n-way merge."""
    return flat.groupBy("term", F.floor(F.col("doc_id") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))


def term_statistics(tokens: DataFrame) -> DataFrame:
    """term, df, cf: documents and occurrences."""
    each = tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
