"""Quality of corrections, and what a benchmark run reports."""

from __future__ import annotations

import os
import platform
import time
from collections.abc import Callable, Iterable

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import format_bytes


def suggestion_quality(queries: DataFrame, suggestions: DataFrame) -> DataFrame:
    """query, tp, fp, precision, accuracy of suggestions (query, word) against queries (query, corrected)."""
    joined = queries.join(suggestions, "query", "left")
    hit = F.when(F.col("word") == F.col("corrected"), 1).otherwise(0)
    out = joined.groupBy("query", "corrected").agg(F.sum(hit).alias("tp"), F.count("word").alias("n"))
    share = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    return out.select("query", "tp", (F.col("n") - F.col("tp")).alias("fp"), share.alias("precision"), share.alias("accuracy"))


def corpus_quality(quality: DataFrame) -> DataFrame:
    """precision (hits a query), accuracy (hits of all suggestions), hit_rate (queries with a hit)."""
    n, tp, whole = F.count("*"), F.sum("tp"), F.sum(F.col("tp") + F.col("fp"))
    return quality.agg(
        F.when(n > 0, tp / n).otherwise(0.0).alias("precision"), F.when(whole > 0, tp / whole).otherwise(0.0).alias("accuracy"), F.when(n > 0, F.sum((F.col("tp") > 0).cast("int")) / n).otherwise(0.0).alias("hit_rate")
    )


def correction_accuracy(queries: DataFrame, corrected: DataFrame) -> DataFrame:
    """total, correct, accuracy of corrections (query, word): equal strings count."""
    joined = queries.join(corrected, "query", "left")
    right = F.coalesce((F.col("word") == F.col("corrected")).cast("int"), F.lit(0))
    return joined.agg(F.count("*").alias("total"), F.coalesce(F.sum(right), F.lit(0)).alias("correct"), F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"))


def machine(spark: SparkSession) -> dict[str, str]:
    """What a report says of where it ran."""
    pages = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
    return {
        "Spark": f"{spark.version}, {spark.sparkContext.master}, {spark.sparkContext.defaultParallelism} tasks at once",
        "Driver": f"{platform.system()} on {platform.machine()}, Python {platform.python_version()}, {format_bytes(pages)} of memory",
    }


def timed(runs: Iterable[tuple[str, Callable[[], object]]]) -> dict[str, float]:
    """Seconds of named steps, in turn, and of all of them (`total`): a break-down of the set-up."""
    out = {}
    for name, step in runs:
        began = time.perf_counter()
        step()
        out[name] = time.perf_counter() - began
    return out | {"total": sum(out.values())}


class _Greatest(AccumulatorParam):
    """Figures by name, the greatest of each."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, value1: dict, value2: dict) -> dict:
        return value1 | {k: max(v, value1.get(k, 0)) for k, v in value2.items()}


def _peak(pid: int) -> int:
    """The most bytes that a process has had in memory at once; 0 where the system doesn't tell."""
    try:
        with open(f"/proc/{pid}/status") as f:
            return next((1024 * int(line.split()[1]) for line in f if line.startswith("VmHWM:")), 0)
    except OSError:
        return 0


def _parent(pid: int) -> int:
    try:
        with open(f"/proc/{pid}/stat") as f:
            return int(f.read().rpartition(")")[2].split()[1])
    except OSError:
        return 0


def _children(pid: int) -> list[int]:
    try:
        with open(f"/proc/{pid}/task/{pid}/children") as f:
            return [int(x) for x in f.read().split()]
    except OSError:
        return []


class Peaks:
    """Peak memory of the executors that work on a frame, as their tasks see it.

    Rows pass through unchanged; with every batch a task looks at the peaks, since they began, of the executor that
    runs it and of all its Python workers together, and an accumulator keeps the greatest of each.
    """

    def __init__(self, spark: SparkSession):
        self.seen = spark.sparkContext.accumulator({}, _Greatest())

    def through(self, df: DataFrame) -> DataFrame:
        seen = self.seen

        def look(batches):
            for batch in batches:
                # Workers are forked by a daemon, which the executor has started.
                daemon = os.getppid()
                seen.add({"workers": sum(map(_peak, _children(daemon) or [os.getpid()])), "executor": _peak(_parent(daemon))})
                yield batch

        return df.mapInArrow(look, df.schema)

    @property
    def bytes(self) -> dict[str, int]:
        """Of the frames that have run so far."""
        return {"workers": 0, "executor": 0} | self.seen.value


def benchmark(queries: DataFrame, correct: Callable[[DataFrame], DataFrame]) -> tuple[dict, DataFrame]:
    """Figures of a correction over labelled queries (query, corrected), and query, corrected, word, right of each.

    correct gives (query, word).  All queries are corrected by one job, which counts as it goes;
    nothing of a query comes to the driver.  Figures: asked, right, share, seconds, each (seconds a query), and the
    peak memory of an executor and of its Python workers in bytes.
    """
    spark, counted = queries.sparkSession, Observation()
    peaks = Peaks(spark)
    found = queries.join(peaks.through(correct(queries.select("query")).select("query", "word")), "query", "left")
    found = found.select("query", "corrected", "word", F.coalesce(F.col("word") == F.col("corrected"), F.lit(False)).alias("right"))
    began = time.perf_counter()
    found.observe(counted, F.count("*").alias("asked"), F.count_if("right").alias("right")).write.format("noop").mode("overwrite").save()
    figures = {"seconds": time.perf_counter() - began, **counted.get}
    asked = max(figures["asked"], 1)
    return figures | {"each": figures["seconds"] / asked, "share": figures["right"] / asked, **peaks.bytes}, found


#: Misspelled words whose corrections are shown after a benchmark.
SAMPLES = ("akoustic", "abzorption", "bureacratic", "aproximatley")


def sample_corrections(spark: SparkSession, correct: Callable[[DataFrame], DataFrame], words: Iterable[str] = SAMPLES) -> DataFrame:
    """query, line of each sample word and its correction; correct gives (query, word)."""
    asked = spark.createDataFrame([(w,) for w in words], "query string")
    both = asked.join(correct(asked), "query", "left")
    return both.select("query", F.format_string("'%s' -> '%s'", "query", F.coalesce("word", "query")).alias("line"))
