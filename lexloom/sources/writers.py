"""Writers and renderings of indexes, reports and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import format_bytes, render_ids


def index_lines(index: DataFrame) -> DataFrame:
    """line `term -> df: N | docs: 1, 2` of an index (term, df, segment, ids); a long list has a line a segment."""
    return index.select("term", "segment", F.format_string("%s -> df: %d | docs: %s", "term", "df", render_ids(F.col("ids"), ", ")).alias("line"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """line `term:1,2,2` of a block index (term, ids)."""
    return blocks.select(*[c for c in blocks.columns if c != "ids"], F.concat("term", F.lit(":"), render_ids(F.col("ids"))).alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Lines as text files that follow each other in order; each task writes its own range."""
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_index(index: DataFrame, path: str) -> None:
    """Parquet in ranges of terms, so a lookup reads few row groups."""
    index.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def display_lines(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Index, line `- Index i | Title: t` of found ids; titles that are missing read N/A."""
    joined = found.join(docs.select(F.col("Index").alias("doc_id"), "Title"), "doc_id", "left")
    return joined.select("doc_id", F.format_string("- Index %d | Title: %s", "doc_id", F.coalesce("Title", F.lit("N/A"))).alias("line"))


def suggestion_lines(phrases: DataFrame, suggestions: DataFrame) -> DataFrame:
    """phrase_id, line `for <phrase>, did you mean: [...]` of ranked suggestions (phrase_id, rank, suggestion)."""
    quoted = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))), lambda s: F.concat(F.lit("'"), s["suggestion"], F.lit("'"))), ", ")
    lists = suggestions.groupBy("phrase_id").agg(quoted.alias("list"))
    return phrases.join(lists, "phrase_id", "left").select("phrase_id", F.format_string("for %s, did you mean: [%s]", "phrase", F.coalesce("list", F.lit(""))).alias("line"))


def phonetic_report(suggested: DataFrame, quality: DataFrame, phrases: DataFrame) -> DataFrame:
    """part, phrase_id, line: a line of suggestions for each phrase, its figures, and one summary, in the order (part, phrase_id)."""
    figures = quality.join(phrases.select("phrase_id", "phrase"), "phrase_id")
    row = F.format_string("%s\t%.0f\t%.0f\t%.6f\t%.6f", "phrase", F.col("tp").cast("double"), F.col("fp").cast("double"), F.round("precision", 6), F.round("accuracy", 6))
    n, tp, whole = F.count("*").cast("double"), F.coalesce(F.sum("tp"), F.lit(0)).cast("double"), F.coalesce(F.sum(F.col("tp") + F.col("fp")), F.lit(0.0)).cast("double")
    right = F.coalesce(F.sum((F.col("tp") > 0).cast("int")), F.lit(0)).cast("double")
    share = lambda a, b, places: F.round(F.when(b > 0, a / b).otherwise(0.0), places)
    summary = F.format_string("Precision = %.3f | Accuracy = %.6f | Correct Results = %.0f/%.0f | Accuracy (based on Correct Results) = %.3f", share(tp, n, 3), share(tp, whole, 6), right, n, share(right, n, 3))
    parts = [suggested.select(F.lit(0).alias("part"), "phrase_id", "line"), figures.select(F.lit(1).alias("part"), "phrase_id", row.alias("line"))]
    return parts[0].union(parts[1]).union(figures.agg(summary.alias("line")).select(F.lit(2).alias("part"), F.lit(-1).cast("long").alias("phrase_id"), "line"))


def correction_lines(combinations: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """phrase_id, rank, part, line of ranked combinations and of the documents found for them (phrase_id, rank, words, total, doc_id)."""
    top = combinations.select("phrase_id", "rank", F.lit(0).alias("part"), F.format_string("- %s (total distance: %d)", "words", "total").alias("line"))
    titles = docs.select(F.col("Index").alias("doc_id"), "Title")
    match = F.format_string("- Index %d: %s | Matched with correction: %s (distance: %d)", "doc_id", F.coalesce("Title", F.lit("N/A")), "words", "total")
    return top.union(found.join(titles, "doc_id", "left").select("phrase_id", "rank", F.lit(1).alias("part"), match.alias("line")))


#: The four lines of a benchmark summary.
SUMMARY = (
    "- Total Queries: {asked}",
    "- Total Time: {seconds:.4f} seconds",
    "- Average Time per Query: {each:.4f} seconds",
    "- Correct Results: {right}/{asked} ({share:.2%})",
)


def summary_lines(figures: dict) -> list[str]:
    """The lines of a benchmark's figures (metrics.benchmark)."""
    return [line.format(**figures) for line in SUMMARY]


def benchmark_lines(title: str, place: dict[str, str], figures: dict) -> list[str]:
    """A benchmark for the console: where it ran, its summary, and what the executors held."""
    held = [f"{who}: {format_bytes(figures[who])} at most" for who in ("executor", "workers")]
    return [title, *(f"{what}: {said}" for what, said in place.items()), *summary_lines(figures), *held]


def outcome_lines(found: DataFrame) -> DataFrame:
    """query, line of every query of a benchmark and what became of it."""
    outcome = F.when(F.col("right"), "right").otherwise(F.concat(F.lit("should be "), F.coalesce("corrected", F.lit("nothing"))))
    return found.select("query", F.format_string("%s: %s (%s)", "query", F.coalesce("word", F.lit("nothing found")), outcome).alias("line"))


RUN = "run-{:06d}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, through Hadoop, so that any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete runs below a path, in order."""
    files, at = _files(spark, path)
    if not files.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at(path)) if s.isDirectory()]
    return sorted(int(n.removeprefix("run-")) for n in names if n.startswith("run-") and files.exists(at(f"{path}/{n}/_SUCCESS")))


def write_run(blocks: DataFrame, path: str, block_size: int) -> int:
    """Block indexes as files `block{ID}size{SIZE}.txt` of a new run below a path, and the run's number.

    IDs go from 0 in the order of block_id.  Tasks write the files where the run isn't seen; they get their
    names by renaming, and the run its marker, when all are there.  Of a block what crosses to the driver is its file's name.
    """
    spark = blocks.sparkSession
    files, at = _files(spark, path)
    number = max(runs(spark, path), default=-1) + 1
    hidden, run = f"{path}/_{RUN.format(number)}", f"{path}/{RUN.format(number)}"
    for stale in (hidden, run):  # of a run that broke off
        files.delete(at(stale), True)
    # Blocks are numbered within the partition that made them, so partitions' counts number all of them.
    parts = blocks.select(F.split("block_id", "-").alias("b")).groupBy(F.col("b")[0].alias("part")).agg((F.max(F.col("b")[1].cast("long")) + 1).alias("n"))
    starts, total = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in parts.collect()):
        starts.append((part, total))
        total += n
    starts = spark.createDataFrame(starts, "part string, start long")
    numbered = block_lines(blocks).join(F.broadcast(starts), F.split("block_id", "-")[0] == F.col("part"))
    numbered = numbered.select((F.col("start") + F.split("block_id", "-")[1].cast("long")).alias("block"), "term", "line")
    numbered.repartition("block").sortWithinPartitions("block", "term").select("block", "line").write.partitionBy("block").text(hidden)
    files.mkdirs(at(run))
    for folder in files.listStatus(at(hidden)):
        name = folder.getPath().getName()
        if name.startswith("block="):
            (part,) = [s.getPath() for s in files.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-")]
            files.rename(part, at(f"{run}/block{name.removeprefix('block=')}size{block_size}.txt"))
    files.create(at(f"{run}/_SUCCESS")).close()
    files.delete(at(hidden), True)
    return number
