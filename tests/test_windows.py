"""Search by windows: as a search by brute force, and nothing is stored for the documents."""

import os
import random

import pytest

from lexloom.operators import windows
from lexloom.plans import catalogue
from lexloom.session import shared_dir


@pytest.mark.parametrize("chunk", [1, 4 << 20])
def test_windows(spark, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    rng = random.Random(4)
    make = lambda most=40: "".join(rng.choice("abc é") for _ in range(rng.randrange(0, most)))
    rows = [(i * 40_000, make() or None, make(80)) for i in range(60)] + [(1, "Tail ab", "x\nyz🎉q"), (2, "", None), (3, "one and the same", "one and the same"), (3, "ONE and the same!", "")]
    docs = spark.createDataFrame(rows, "Index long, Title string, Abstract string")
    long = [t[k : k + 25] for _, _, t in rows if t for k in (0, 7)]
    asked = ["", "a", "é", "ab", "b ", "abc", "AIL", "cab a", "a\x00", "\nyz🎉", "🎉", "zzz", "ab é", None, "x\nyz🎉q", "one and the same", "one and the same!"] + [make()[:6] for _ in range(40)] + long
    found = windows.search(docs, spark.createDataFrame([(p,) for p in asked], "phrase string"), docs.Title, docs.Abstract)
    asked = {p.lower() for p in asked if p is not None}
    want = [(p, i) for p in asked for i, *fs in rows if any(p in (f or "").lower() for f in fs)]
    assert sorted((r.phrase, r.doc_id) for r in found.collect()) == sorted(want)
    assert windows.search(docs, spark.createDataFrame([], "phrase string"), docs.Title).count() == 0


@pytest.mark.parametrize("name", ["edit_topk_search", "edit_topk_lines", "edit_phrase_search", "ngram_phrase_search", "hybrid_phrase_search"])
def test_no_index_is_stored(spark, tmp_path, name):
    spark.createDataFrame([(i, f"Words of title {i}\nsome letters before night", "web") for i in range(9)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some letters before the night")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    kept = set(os.listdir(folder)) | set(os.listdir(os.path.dirname(folder)))
    assert catalogue.queries()[name](spark, str(tmp_path)).count() >= (9 if "phrase" in name else 1)
    now = set(os.listdir(folder)) | set(os.listdir(os.path.dirname(folder)))
    assert not [f for f in now - kept if f.startswith("text-index")]
