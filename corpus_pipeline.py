"""Corpus preparation in stages; each stage works on all that its predecessor kept.

toxicity: documents that the classifier rejects go.  jaccard: of each group of near copies (word
5-shingles, similarity 0.8 or more) the document of least doc_id stays.  suffix: strings of 200 bytes
(a passage of some fifty short words is shorter than 400) that occur elsewhere are cut; a document
of which nothing is left goes, one that had no text stays.  packing: token sequences.

Null and empty texts pass the first three stages and are packed as their end token alone.  Of rows with one
doc_id or one text each is judged by itself; rows alike in both are one to the jaccard stage.  Ties go to the
smaller doc_id, null first.  Extra columns of any name and type are kept as they are by the first three stages.
An empty table gives no rows.

SQL can't express a fitted classifier, so there is no ORACLE_SQL; tests hold the stages against
brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import packing, toxicity
from lexloom.llm._common import Scratch, fresh
from lexloom.llm.jaccard_join import keep_one
from lexloom.llm.queries import tokenizer_path
from lexloom.llm.suffix_dedup import cut_texts


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, k=5, percent=80)


def stage_suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    had = fresh(docs.columns, "_had")
    out = cut_texts(docs.withColumn(had, F.coalesce(F.col("text") != "", F.lit(False))), length=200).where(f"text != '' or not {had}").drop(had)
    kinds = dict(docs.dtypes)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(kinds["n_chars"]), "n_chars")) if "n_chars" in kinds else out


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("jaccard", stage_jaccard),
    ("suffix", stage_suffix),
    ("packing", stage_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`, each written as Parquet and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs, name, many=True)
    return docs
