from collections import Counter

import corpus_pipeline
from lexloom.llm import toxicity
from tests.llm.test_jaccard_join import brute, groups, shingles
from tests.llm.test_suffix_dedup import brute as cut_by_brute_force


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "suffix", "packing"]
    now, before = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, sf_dir)
        now = spark.createDataFrame(now.collect(), now.schema)
        if name != "packing":
            assert now.schema.names == docs.schema.names
            assert 0 < now.count() <= before.count()
        if name == "jaccard":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in now.collect()} == {c for (_, _, c) in brute(rows, 5, 80)}
    assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}


def test_suffix_keeps_rows_without_text(spark, sf_dir):
    passage = "abcdefghij" * 30
    rows = [(1, None, 0), (2, "", 0), (3, passage, 300), (4, passage, 300), (5, "own words", 9), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.stage_suffix(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} == {rows[0], rows[1], rows[4], rows[5]}
    assert {r.doc_id for r in corpus_pipeline.stage_packing(spark, kept, sf_dir).collect()} == {1, 2, 5, None}


def test_toxicity_stage_keeps_what_the_score_lets_pass(docs, rows, spark, sf_dir):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    passed = Counter((r.doc_id, r.toxic) for r in toxicity.score(docs, model).collect())
    kept = corpus_pipeline.stage_toxicity(spark, docs, sf_dir)
    assert kept.schema == docs.schema
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, toxic), n in passed.items() if not toxic})


def test_jaccard_stage_by_brute_force(docs, rows, spark, sf_dir):
    kept = corpus_pipeline.stage_jaccard(spark, docs, sf_dir)
    assert kept.schema == docs.schema
    sets, label = groups(rows, 5, 80)
    got = [(r.doc_id, shingles(r.text, 5)) for r in kept.collect()]
    least = {}
    for r, own, c in zip(rows, sets, label, strict=True):
        if own:
            least.setdefault(c, []).append(r[0])
    first = Counter(min(ids, key=lambda i: (i is not None, i or 0)) for ids in least.values())
    assert Counter(i for i, own in got if own) == first
    assert Counter(i for i, own in got if not own) == Counter(r[0] for r, own in zip(rows, sets, strict=True) if not own)


def test_suffix_stage_by_brute_force(docs, rows, spark, sf_dir):
    kept = corpus_pipeline.stage_suffix(spark, docs, sf_dir)
    assert kept.schema == docs.schema
    left = cut_by_brute_force(rows, 200)[1]
    want = Counter()
    for r, raw in zip(rows, left, strict=True):
        text = raw.decode("utf-8", "ignore")
        if text or not r[1]:
            want[r[0], text or r[1]] += 1
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_packing_stage_takes_every_row(docs, rows, spark, sf_dir):
    got = corpus_pipeline.stage_packing(spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
    fill = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_stages_on_an_empty_table(empty, spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_with_nulls_repeats_and_clashing_names(docs, rows, spark, tmp_path):
    """The whole pipeline over a stored table gives what its stages give one after the other."""
    docs.withColumn("n_chars", docs.n).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows) if i % 3 == 0], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kinds = now.schema
    for name, stage in corpus_pipeline.STAGES:
        if name != "packing":
            assert now.schema == kinds, name
        now = stage(spark, now, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    told = lambda rs: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert told(got) == told(now.collect()) and 0 < len({r.doc_id for r in got}) < len({r[0] for r in rows})
    fill = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length


def test_run_on_an_empty_table(empty, spark, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
