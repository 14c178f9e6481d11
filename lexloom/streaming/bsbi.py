"""Incremental block-sort-based indexing: a micro-batch is a block, compaction is the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.index import merge_postings, occurrences


def index_stream(documents: DataFrame, blocks_path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of a document stream as one sorted block of postings.

    A block's folder is named by its batch and overwritten when the batch is run again, so a block
    is there once whatever fails.
    """

    def write(batch: DataFrame, number: int) -> None:
        block = occurrences(batch).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
        block.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{blocks_path}/block={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, blocks_path: str) -> DataFrame:
    """term, segment, ids of all blocks written so far."""
    return merge_postings(spark.read.parquet(blocks_path).select("term", "doc_id"))
