"""Search of documents for any number of phrases over a stored trigram index.

The index holds, for every three characters that stand together in a field, the documents that have
them, in segments of 65,536 ids; beside it the texts.  A phrase's rarest trigrams are looked up, their
segments intersected, the shortest first, and what is left is verified in the text.  Phrases are a
table like any other: none of them comes to the driver, and the index is read once for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.index import SEGMENT

#: A lookup intersects so many of a phrase's trigrams, the rarest.
LOOKED_UP = 4
#: Two of these end each field, so that its last characters begin a trigram too.
END = "\x00"


def trigrams(text: Column) -> Column:
    """Every three characters that stand together, by one pass over the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), 1))


def store(docs: DataFrame, path: str, *fields: Column) -> None:
    """Writes the index of lower-cased fields of documents (Index, ...): postings in ranges of trigrams, and texts in ranges of ids."""
    columns = [F.lower(F.coalesce(f, F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)]
    texts = docs.select(F.col("Index").alias("doc_id"), *columns)
    texts.repartitionByRange("doc_id").write.mode("overwrite").parquet(f"{path}/texts")
    grams = texts.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[trigrams(F.concat(f"f{i}", F.lit(2 * END))) for i in range(len(fields))])))).alias("gram"))
    lists = grams.groupBy("gram", F.floor(F.col("doc_id") / SEGMENT).alias("segment")).agg(F.sort_array(F.collect_set("doc_id")).alias("ids"))
    lists = lists.withColumn("n", F.size("ids"))
    lists.repartitionByRange("gram").sortWithinPartitions("gram", "segment").write.mode("overwrite").parquet(f"{path}/postings")


class TextIndex:
    """A stored index."""

    def __init__(self, spark: SparkSession, path: str):
        self.texts, self.postings = spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/postings")

    def _long(self, asked: DataFrame) -> DataFrame:
        """phrase, doc_id of documents that have the rarest trigrams of phrases of three characters or more."""
        wanted = asked.where(F.length("phrase") >= 3).select("phrase", F.explode(trigrams(F.col("phrase"))).alias("gram"))
        sizes = self.postings.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("df"))
        # A trigram that no document has stands first, with nothing to meet.
        ranked = wanted.join(sizes, "gram", "left").withColumn("place", F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("df", F.lit(0)), "gram")))
        chosen = ranked.where(F.col("place") <= LOOKED_UP)
        needed = chosen.groupBy("phrase").agg(F.count("*").alias("needed"))
        met = chosen.select("phrase", "gram").join(self.postings, "gram").groupBy("phrase", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "ids"))).alias("lists"))
        full = met.join(needed, "phrase").where(F.size("lists") == F.col("needed"))
        both = F.aggregate(F.slice("lists", 2, LOOKED_UP), F.col("lists")[0]["ids"], lambda s, x: F.array_intersect(s, x["ids"]))
        return full.select("phrase", F.explode(both).alias("doc_id"))

    def _short(self, asked: DataFrame) -> DataFrame:
        """The same of shorter phrases: some trigram begins with them."""
        parts = [asked.where(F.length("phrase") == k).join(self.postings.withColumn("phrase", F.substring("gram", 1, k)), "phrase") for k in (1, 2)]
        return parts[0].union(parts[1]).select("phrase", F.explode("ids").alias("doc_id")).distinct()

    def search(self, phrases: DataFrame) -> DataFrame:
        """phrase, doc_id of every phrase in every document that holds it in one of the fields, whatever the case; an empty phrase is in all."""
        asked = phrases.select(F.lower("phrase").alias("phrase")).where("phrase is not null").distinct()
        found = self._long(asked).union(self._short(asked))
        held = F.lit(False)
        for c in self.texts.columns[1:]:
            held = held | F.contains(c, "phrase")
        empty = F.broadcast(asked.where("phrase = ''").limit(1))  # a row at most
        everywhere = self.texts.select(F.lit("").alias("phrase"), "doc_id").join(empty, "phrase", "left_semi")
        return self.texts.join(found, "doc_id").where(held).select("phrase", "doc_id").union(everywhere)
