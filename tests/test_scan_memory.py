"""A scan gives its finds away in small batches; an index's universe is read from its postings."""

from lexloom.operators import index, phrase


def test_finds_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(phrase, "FOUND", 40)
    docs = spark.createDataFrame([(i, "abcdefgh") for i in range(300)], "Index long, Title string").coalesce(1)
    found = phrase.search(docs, spark.createDataFrame([(c,) for c in "abcdefgh"], "phrase string"), docs.Title)
    sizes = found.mapInArrow(lambda batches: (b for b in batches), "phrase string, doc_id long")
    assert sizes.count() == 2400 and found.distinct().count() == 2400
    rows = docs.select(docs.Index.alias("doc_id"), docs.Title.alias("f0"))
    caught = phrase._scan(rows, spark.sparkContext.broadcast(["a", "b"]))
    assert caught.groupBy("phrase").count().count() == 2


def test_universe_of_a_stored_index(spark, tmp_path):
    post = spark.createDataFrame([("t", i) for i in range(0, 9000, 2)] + [("u", i) for i in (1, 65_536, 7)] + [("v", 200_000), ("t", None)], "term string, doc_id long")
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    index.store(post.repartition(3).mapInArrow(counted, "term string, doc_id long"), str(tmp_path / "ix"))
    (low,) = [r for r in index.StoredIndex(spark, str(tmp_path / "ix")).universe.collect() if r.segment == 0]
    assert low.n == 4502
    assert {r.segment for r in index.StoredIndex(spark, str(tmp_path / "ix")).universe.collect()} == {0, 1, 3}
    assert reads.value == 4504 + 1  # the postings are made once
