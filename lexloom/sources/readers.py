"""Readers: document collections, dictionaries, labelled queries, index blocks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import split_words, word_characters
from lexloom.sources import json_arrays, writers

#: The text fields of a record.
TEXT_FIELDS = ["Title", "Author", "Bibliographic Source", "Abstract"]
DOCUMENTS = T.StructType([T.StructField("Index", T.LongType()), *(T.StructField(f, T.StringType()) for f in TEXT_FIELDS)])
QUERIES = T.StructType([T.StructField("query", T.StringType()), T.StructField("corrected", T.StringType())])


def normalized(raw: DataFrame) -> DataFrame:
    """Index, Title, Author, bib_source, Abstract; what is missing or null is ''."""
    have = set(raw.columns)
    text = lambda name: (F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in have else F.lit("")).alias("bib_source" if " " in name else name)
    return raw.select(F.col("Index").cast("long"), *map(text, TEXT_FIELDS))


def read_documents(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """A JSON array of records, scanned in byte ranges with a fixed schema; tolerant: a missing path gives no rows."""
    try:
        return normalized(json_arrays.read(spark, path, DOCUMENTS, "PERMISSIVE" if tolerant else "FAILFAST"))
    except AnalysisException:
        if not tolerant:
            raise
        return normalized(spark.createDataFrame([], DOCUMENTS))


def latest(docs: DataFrame, order: str) -> DataFrame:
    """Of records with one Index the last by `order` stands."""
    rest = [c for c in docs.columns if c != "Index"]
    return docs.groupBy("Index").agg(F.max_by(F.struct(*rest), order).alias("r")).select("Index", *[F.col(f"r.{c}").alias(c) for c in rest])


def from_table(documents: DataFrame) -> DataFrame:
    """The document schema over a table (doc_id, text, source): the first line is the title."""
    return documents.select(
        F.col("doc_id").alias("Index"),
        F.coalesce(F.regexp_extract("text", "^[^\n]*", 0), F.lit("")).alias("Title"),
        F.lit("").alias("Author"),
        F.coalesce("source", F.lit("")).alias("bib_source"),
        F.coalesce("text", F.lit("")).alias("Abstract"),
    )


def dictionary(lines: DataFrame, mode: str = "lines") -> DataFrame:
    """word of a one-column frame of lines.

    tokens: every token of each lower-cased line; long_lines: trimmed lower-cased lines of more than two
    characters; lines: trimmed lower-cased lines; raw: trimmed lines, case and repeats kept, empty ones left out.
    """
    line = F.col(lines.columns[0])
    trimmed = F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")
    if mode == "tokens":
        return lines.select(F.explode(split_words(F.lower(line))).alias("word")).distinct()
    if mode == "raw":
        return lines.select(trimmed.alias("word")).where("word != ''")
    words = lines.select(F.lower(trimmed).alias("word"))
    return (words.where(F.length("word") > 2) if mode == "long_lines" else words).distinct()


def read_dictionary(spark: SparkSession, path: str, mode: str = "lines") -> DataFrame:
    return dictionary(spark.read.text(path), mode)


def corpus_vocabulary(text: DataFrame) -> DataFrame:
    """Distinct lower-cased words of more than two characters of a one-column frame of texts."""
    words = text.select(F.explode(word_characters(F.lower(F.col(text.columns[0])))).alias("word"))
    return words.where(F.length("word") > 2).distinct()


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return json_arrays.read(spark, path, QUERIES)


def _listed(line: Column) -> Column:
    """(term, doc_id) of a line `term:id,id`; a term may hold colons."""
    term, ids = (F.regexp_extract(line, "^(.*):([^:]*)$", i) for i in (1, 2))
    return F.transform(F.filter(F.split(ids, ","), lambda x: x != ""), lambda x: F.struct(term.alias("term"), x.cast("long").alias("doc_id")))


def read_blocks(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """term, doc_id of block files of lines `term:id,id`, whatever their names."""
    return spark.read.option("pathGlobFilter", glob).text(path).select(F.explode(_listed(F.col("value"))).alias("p")).select("p.term", "p.doc_id")


def read_run(spark: SparkSession, path: str, run: int | None = None) -> DataFrame:
    """block, size, term, doc_id of the block files of one complete run, the last if none is named; blocks of other runs aren't read."""
    known = writers.runs(spark, path)
    if (run if run is not None else -1) not in known and (run is not None or not known):
        raise FileNotFoundError(f"no complete run {'' if run is None else run} below {path}")
    lines = spark.read.option("pathGlobFilter", "block*size*.txt").text(f"{path}/{writers.RUN.format(known[-1] if run is None else run)}")
    name = F.regexp_extract(F.input_file_name(), "block([0-9]+)size([0-9]+)[.]txt$", 1), F.regexp_extract(F.input_file_name(), "block([0-9]+)size([0-9]+)[.]txt$", 2)
    named = lines.select(name[0].cast("long").alias("block"), name[1].cast("long").alias("size"), "value")
    return named.select("block", "size", F.explode(_listed(F.col("value"))).alias("p")).select("block", "size", "p.term", "p.doc_id")
