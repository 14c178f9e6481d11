import json
import random
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom.operators import boolean, index
from lexloom.sources import json_arrays, readers, writers
from lexloom.streaming import bsbi

RECORDS = [
    {"Index": 10, "Title": "Deep Water", "Author": "Ann", "Bibliographic Source": "J", "Abstract": "water a:b the Water"},
    {"Index": 9, "Title": "Fire", "Abstract": None},
    {"Index": 9, "Title": "Fire again"},
]


def documents(spark, tmp_path):
    (tmp_path / "docs.json").write_text(json.dumps(RECORDS))
    return readers.read_documents(spark, str(tmp_path / "docs.json"))


def test_documents_and_index(spark, tmp_path):
    docs = documents(spark, tmp_path)
    assert {(r.Index, r.Title, r.bib_source, r.Abstract) for r in docs.collect()} == {(10, "Deep Water", "J", "water a:b the Water"), (9, "Fire", "", ""), (9, "Fire again", "", "")}
    post = index.postings(docs, lambda t: F.filter(F.split(F.lower(t), " "), lambda w: w != ""))
    df = {r.term: r.df for r in index.document_frequency(post).collect()}
    assert df["fire"] == 2 and df["water"] == 1
    lists = {r.term: r.ids for r in index.inverted_index(post).collect()}
    assert lists["fire"] == [9]
    lines = {r.line for r in writers.index_lines(index.inverted_index(post)).collect()}
    assert "fire -> df: 2 | docs: 9" in lines
    assert readers.read_documents(spark, str(tmp_path / "none.json"), tolerant=True).count() == 0
    assert readers.latest(docs.withColumn("o", F.length("Title")), "o").where("Index = 9").first().Title == "Fire again"


@pytest.mark.parametrize("form", [{"indent": 2}, {}, {"separators": (",", ":")}, "lines"])
def test_json_arrays_in_byte_ranges(spark, tmp_path, form):
    """One file is read by many tasks, whatever its records look like and wherever they are cut."""
    rng = random.Random(1)
    odd = ['}{"', "a\\", "[{", "line\nbreak", "\u2028é🎉", 'q"}', ""]
    own = lambda i: {"Index": i, "Title": rng.choice(odd) * rng.randrange(3), "Author": None, "Bibliographic Source": "x" * rng.randrange(60), "Abstract": " ".join(rng.choices([*odd, "w"], k=rng.randrange(80))), "more": {"a": [{"b": 1}]}}
    rows = [own(i) for i in range(120)] + [own(120) | {"Abstract": "y" * 3000, "more": [{"deep": [{"x": i, "s": "}"} for i in range(300)]}]}] + [own(i) for i in range(121, 160)]
    text = "\n".join(map(json.dumps, rows)) if form == "lines" else json.dumps(rows, **form)
    (tmp_path / "many").mkdir()
    (tmp_path / "many/a.json").write_text(text)
    (tmp_path / "many/b.json").write_text(json.dumps(rows[:3], indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        docs = readers.read_documents(spark, str(tmp_path / "many"))
        ranges = json_arrays._lines(spark, str(tmp_path / "many")).select("file", "start").distinct().count()
        got = sorted((r.Index, r.Title, r.Author, r.bib_source, r.Abstract) for r in docs.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((r["Index"], r["Title"], "", r["Bibliographic Source"], r["Abstract"]) for r in [*rows, *rows[:3]])
    assert ranges > (10 if form in ({"indent": 2}, "lines") else 1)
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    with pytest.raises(Exception, match="MALFORMED"):
        readers.read_documents(spark, str(tmp_path / "cut.json")).collect()


def test_blocks_round_trip(spark, tmp_path):
    tokens = index.occurrences(documents(spark, tmp_path))
    blocks = index.parse_blocks(tokens.coalesce(1), 2)
    assert blocks.groupBy("block_id").agg(F.countDistinct("term").alias("n")).where("n > 2").count() == 0
    path = str(tmp_path / "blocks")
    assert writers.write_run(blocks, path, 2) == 0
    back = readers.read_run(spark, path)
    names = sorted(p.name for p in (tmp_path / "blocks/run-000000").iterdir() if p.name.startswith("block"))
    assert names == sorted(f"block{i}size2.txt" for i in range(blocks.select("block_id").distinct().count()))
    # A file holds one block, sorted; lines are as readers of other tools expect them.
    lines = (tmp_path / "blocks/run-000000/block0size2.txt").read_text().splitlines()
    assert len(lines) == 2 and lines == sorted(lines) and {(r.block, r.size) for r in back.select("block", "size").collect()} == {(i, 2) for i in range(len(names))}
    # What an earlier run, or one that broke off, has left isn't read.
    assert writers.write_run(blocks.where("term = 'Fire'"), path, 7) == 1
    (tmp_path / "blocks/run-000002").mkdir()
    (tmp_path / "blocks/run-000002/block0size9.txt").write_text("half:1,")
    assert [(r.term, r.doc_id, r["size"]) for r in readers.read_run(spark, path).distinct().collect()] == [("Fire", 9, 7)]
    assert readers.read_run(spark, path, 0).count() == back.count()
    with pytest.raises(FileNotFoundError):
        readers.read_run(spark, path, 2)
    assert writers.write_run(blocks, path, 2) == 2 and readers.read_run(spark, path).count() == back.count()
    merged = {(r.term, tuple(r.ids)) for r in index.merge_postings(back).collect()}
    assert {(r.term, r.doc_id) for r in readers.read_blocks(spark, f"{path}/run-000002", "block*").collect()} == {(r.term, r.doc_id) for r in back.collect()}
    assert merged == {(r.term, tuple(r.ids)) for r in index.merge_blocks(blocks).collect()} == {(r.term, tuple(r.ids)) for r in index.merge_postings(tokens).collect()}
    assert ("a:b", (10,)) in merged and ("Fire", (9,)) in merged


def test_dictionaries(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Alpha beta\n\n  It \nAlpha beta\n")
    read = lambda mode: sorted(r.word for r in readers.read_dictionary(spark, str(tmp_path / "words.txt"), mode).collect())
    assert read("tokens") == ["alpha", "beta", "it"]
    assert read("long_lines") == ["alpha beta"]
    assert read("lines") == ["", "alpha beta", "it"]
    assert read("raw") == ["Alpha beta", "Alpha beta", "It"]
    (tmp_path / "q.json").write_text(json.dumps([{"query": "hihg", "corrected": "high"}]))
    assert readers.read_queries(spark, str(tmp_path / "q.json")).first().corrected == "high"


def test_stream(spark, tmp_path):
    docs = documents(spark, tmp_path)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    bsbi.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.term, tuple(r.ids)) for r in bsbi.compact(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.term, tuple(r.ids)) for r in index.merge_postings(index.occurrences(docs)).collect()}


def test_lines(spark, tmp_path):
    run = {"asked": 38, "seconds": 34.9989, "each": 0.921, "right": 29, "share": 29 / 38}
    assert writers.summary_lines(run)[3] == "- Correct Results: 29/38 (76.32%)"
    found = spark.createDataFrame([(10,), (4,)], "doc_id long")
    assert {r.line for r in writers.display_lines(found, documents(spark, tmp_path)).collect()} == {"- Index 10 | Title: Deep Water", "- Index 4 | Title: N/A"}


def test_stored_index_reads_only_its_terms(spark, tmp_path):
    docs = documents(spark, tmp_path)
    post, path = index.postings(docs), str(tmp_path / "index")
    index.store(post, path)
    stored = index.StoredIndex(spark, path)
    for query in ("deep", "deep AND water", "NOT deep", "( deep OR river ) AND NOT water", ""):
        got = {r.doc_id for r in boolean.retrieve_stored(stored, query).collect()}
        assert got == {r.doc_id for r in boolean.retrieve(post, query).collect()}
    plan = stored.segments(["deep", "water"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [deep,water])" in plan
    # Packed segments meet by their number; no id is exchanged, no list taken apart.
    plan = boolean.retrieve_stored(stored, "deep AND NOT water")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(segment") == 1 and "Generate" not in plan


def test_segments_are_places_or_bitmaps(spark, monkeypatch):
    few, many = [5, index.SEGMENT + 1, -3, 2 * index.SEGMENT], list(range(0, 3 * index.DENSE))
    post = spark.createDataFrame([("few", i) for i in [*few, 5, None]] + [("many", i) for i in many], "term string, doc_id long")
    rows = index.segments(post, "term").collect()
    assert {(r.term, r.segment, r.n, r.bits is not None) for r in rows} == {("few", 0, 1, False), ("few", 1, 1, False), ("few", -1, 1, False), ("few", 2, 1, False), ("many", 0, len(many), True)}
    for query, want in (("few", set(few)), ("few OR many", {*few, *many}), ("many AND NOT few", {*many} - {5}), ("NOT many", {*few} - {5}), ("none", set())):
        assert {r.doc_id for r in boolean.retrieve(post, query).collect()} == want, query


def test_lemmas_and_analyzers(spark, tmp_path):
    docs = documents(spark, tmp_path)
    lemmas = spark.createDataFrame([("deep", "depth"), ("unused", "x")], "term string, lemma string")
    plain = {(r.term, r.doc_id) for r in index.postings(docs).collect()}
    got = {(r.term, r.doc_id) for r in index.lemmatized(index.postings(docs), lemmas).collect()}
    assert got == {("depth" if t == "deep" else t, d) for t, d in plain}

    @F.pandas_udf("array<string>")
    def reversed_terms(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:  # where a linguistic tokenizer would stand
        for part in texts:
            yield part.map(lambda t: [w[::-1] for w in t.lower().split()])

    assert {r.term for r in index.postings(docs, reversed_terms).collect()} >= {"peed", "retaw"}


def test_blocks_are_cut_at_their_last_term(spark):
    words = "a b a c d a a e f b g a".split()
    tokens = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "term string, doc_id long").coalesce(1)
    want, held, number = set(), {}, 0
    for i, w in enumerate(words):
        held.setdefault(w, []).append(i)
        if len(held) == 3:
            want |= {(number, t, tuple(ids)) for t, ids in held.items()}
            held, number = {}, number + 1
    want |= {(number, t, tuple(ids)) for t, ids in held.items()}
    for batch in ("10000", "2"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {(int(r.block_id[-6:]), r.term, tuple(r.ids)) for r in index.parse_blocks(tokens, 3).collect()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_merged_file_is_in_term_order(spark, tmp_path):
    docs = documents(spark, tmp_path)
    merged = index.merge_blocks(index.parse_blocks(index.occurrences(docs), 2))
    writers.write_lines(writers.block_lines(merged), str(tmp_path / "merged"), "term", "segment")
    files = sorted(p for p in (tmp_path / "merged").iterdir() if p.name.startswith("part-"))
    lines = [x for p in files for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines == [f"{r.term}:{','.join(map(str, r.ids))}" for r in sorted(merged.collect(), key=lambda r: (r.term, r.segment))]


def test_numbers_follow_the_order_of_words(spark):
    words = ["b", "ba", "bac", "bacd", "bace", "a", "ab", "über", "zz", "zza", "", "bac1"]
    got = {r.word: r.number for r in index.numbered(spark.createDataFrame([(w,) for w in words], "word string").repartition(4), "word").collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}
