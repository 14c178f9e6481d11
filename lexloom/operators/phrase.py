"""Phrase correction and search of documents for phrases."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import join_tokens, split_words, word_characters

PHRASE_BLOCK = 20_000
#: A scan takes so many texts out of a batch at a time, and gives its finds away in batches of about so many.
TEXTS, FOUND = 16, 20_000


def phrase_tokens(phrases: DataFrame, words: bool = False) -> DataFrame:
    """phrase_id, pos, token; words: word characters of the lower-cased phrase instead of white-space parts."""
    parts = word_characters(F.lower("phrase")) if words else split_words(F.col("phrase"))
    return phrases.select("phrase_id", F.posexplode(parts).alias("pos", "token"))


def options(tokens: DataFrame, candidates: DataFrame, *order) -> DataFrame:
    """phrase_id, places: for each place of a phrase, in order, the sorted candidates (structs of `order`)."""
    met = tokens.join(candidates, tokens.token == candidates["query"])
    each = met.groupBy("phrase_id", "pos").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("options"))
    return each.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "options"))).alias("places"))


def phrase_topk(tokens: DataFrame, candidates: DataFrame, most: int = 10) -> DataFrame:
    """phrase_id, rank, words, total: the best combinations of candidates by summed distance, for phrases of any length.

    Ties go by the candidates' ranks from the first word on.  After each place only the best `most`
    beginnings of a phrase are kept, which loses none of its best combinations; a word without a
    candidate takes no place.
    """
    kind = "array<struct<total:long,ranks:array<int>,words:array<string>>>"
    start = F.array(F.struct(F.lit(0).alias("total"), F.array().alias("ranks"), F.array().alias("words"))).cast(kind)

    def grow(state: Column, place: Column) -> Column:
        step = lambda s: lambda o: F.struct((s["total"] + o["distance"]).alias("total"), F.concat(s["ranks"], F.array(o["rank"])).alias("ranks"), F.concat(s["words"], F.array(o["word"])).alias("words"))
        grown = F.flatten(F.transform(state, lambda s: F.transform(place["options"], step(s))))
        return F.slice(F.array_sort(grown), 1, most).cast(kind)

    places = options(tokens, candidates.where(F.col("rank") <= most), F.col("rank").cast("int").alias("rank"), "word", F.col("distance").cast("long").alias("distance"))
    whole = tokens.select("phrase_id").distinct().join(places, "phrase_id", "left")
    none = F.array().cast("array<struct<pos:int,options:array<struct<rank:int,word:string,distance:bigint>>>>")
    found = whole.select("phrase_id", F.posexplode(F.aggregate(F.coalesce("places", none), start, grow)).alias("rank", "best"))
    return found.select("phrase_id", (F.col("rank") + 1).alias("rank"), F.array_join("best.words", " ").alias("words"), "best.total")


def phrase_best(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """phrase_id, corrected: each word's first candidate, joined; a word without one stays."""
    first = candidates.where("rank = 1").select("query", "word")
    joined = tokens.join(first, tokens.token == first["query"], "left").select("phrase_id", "pos", F.coalesce("word", "token").alias("token"))
    return joined.groupBy("phrase_id").agg(join_tokens(F.collect_list(F.struct("pos", "token"))).alias("corrected"))


def hybrid_choice(tokens: DataFrame, dictionary: DataFrame, candidates: DataFrame) -> DataFrame:
    """phrase_id, pos, token, score: a dictionary word in its own case at 1, else the first candidate."""
    known = dictionary.select(F.col("word").alias("known")).distinct()
    first = candidates.where("rank = 1").select("query", "word", "score")
    joined = tokens.join(known, F.lower("token") == F.col("known"), "left").join(first, F.col("token") == F.col("query"), "left")
    return joined.select(
        "phrase_id", "pos", F.when(F.col("known").isNotNull(), F.col("token")).otherwise(F.coalesce("word", "token")).alias("token"), F.when(F.col("known").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score")
    )


def soundex_products(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """phrase_id, n: how many combinations of phonetic candidates a phrase has, none of them made.

    n is a double, since the product of a long phrase passes 64 bits; it is exact up to 2^53.
    """
    counts = candidates.groupBy("query").agg(F.count("*").alias("c"))
    joined = tokens.join(counts, tokens.token == counts["query"], "left")
    sizes = joined.groupBy("phrase_id").agg(F.collect_list(F.coalesce("c", F.lit(0))).alias("c"))
    return sizes.select("phrase_id", F.aggregate("c", F.lit(1.0), lambda a, x: a * x).alias("n"))


def soundex_quality(phrases: DataFrame, tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """phrase_id, tp, fp, precision, accuracy of all combinations against the corrected phrase.

    One combination at most equals it: if both have as many words and each corrected word is among
    its place's candidates.
    """
    wanted = phrases.select("phrase_id", F.posexplode(split_words(F.col("corrected"))).alias("pos", "want"))
    sizes = wanted.groupBy("phrase_id").agg(F.count("*").alias("wanted"))
    hits = tokens.join(wanted, ["phrase_id", "pos"]).join(candidates.select(F.col("query").alias("token"), F.col("word").alias("want")).distinct(), ["token", "want"])
    hits = hits.groupBy("phrase_id").agg(F.count("*").alias("hits"))
    own = tokens.groupBy("phrase_id").agg(F.count("*").alias("own"))
    joined = soundex_products(tokens, candidates).join(own, "phrase_id").join(sizes, "phrase_id", "left").join(hits, "phrase_id", "left")
    tp = F.when((F.col("own") == F.col("wanted")) & (F.col("hits") == F.col("own")), 1).otherwise(0).cast("long")
    out = joined.select("phrase_id", tp.alias("tp"), (F.col("n") - tp).alias("fp"), "n")
    share = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    return out.select("phrase_id", "tp", "fp", share.alias("precision"), share.alias("accuracy"))


def search(docs: DataFrame, phrases: DataFrame, *fields) -> DataFrame:
    """phrase, doc_id of every phrase in every document that holds it in one of the fields, whatever the case.

    The distinct phrases are the query set; in blocks of about PHRASE_BLOCK, dealt by a hash, they become
    one automaton each, and a block is one scan of the documents, with no join of documents and
    phrases.  The driver holds one block at a time.  An empty phrase is in every document.
    """
    spark = docs.sparkSession
    asked = phrases.select(F.lower("phrase").alias("phrase")).where("phrase is not null").distinct().persist(StorageLevel.DISK_ONLY)
    blocks = max(1, -(-asked.count() // PHRASE_BLOCK))
    texts = docs.select(F.col("Index").alias("doc_id"), *[F.lower(F.coalesce(f, F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)])
    out = None
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == number)
        part = _scan(texts, spark.sparkContext.broadcast(sorted(r["phrase"] for r in block.collect())))
        out = part if out is None else out.union(part)
    asked.unpersist()
    return out


def _scan(texts: DataFrame, block: Broadcast) -> DataFrame:
    def run(batches):
        automaton, everywhere = ahocorasick.Automaton(), [p for p in block.value if not p]
        for p in block.value:
            if p:
                automaton.add_word(p, p)
        if len(automaton):
            automaton.make_automaton()
        found_p, found_d = [], []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(found_p, pa.string()), pa.array(found_d, pa.int64())], names=["phrase", "doc_id"])
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):  # neither a batch's texts nor its finds are held as Python objects at once
                for doc, *fields in zip(*(c.to_pylist() for c in batch.slice(first, TEXTS).columns), strict=True):
                    hits = set(everywhere)
                    if len(automaton):
                        for text in fields:
                            hits.update(p for _, p in automaton.iter(text))
                    found_p += hits
                    found_d += [doc] * len(hits)
                    if len(found_p) >= FOUND:
                        yield told()
                        found_p, found_d = [], []
        yield told()

    return texts.mapInArrow(run, "phrase string, doc_id long")


def first_documents(found: DataFrame) -> DataFrame:
    """phrase, doc_id: the first document of each phrase in file order (the order of ids)."""
    return found.groupBy("phrase").agg(F.min("doc_id").alias("doc_id"))


def first_of_combinations(combinations: DataFrame, found: DataFrame) -> DataFrame:
    """phrase_id, rank, words, total, doc_id: of ranked combinations those found (phrase, doc_id), with the first document that holds them."""
    return combinations.join(first_documents(found), F.lower("words") == F.col("phrase")).select("phrase_id", "rank", "words", "total", "doc_id")
