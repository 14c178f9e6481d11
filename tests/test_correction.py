import difflib
import itertools
import random

from lexloom.operators import candidates, metrics, phrase, products, setjoin, textindex
from lexloom.sources import writers
from tests.test_functions import indel

WORDS = ["high", "hi", "night", "speed", "spread", "spear", "before", "behavior", "zzz", "letter", "better"]
ASKED = ["hihg", "spead", "befroe", "high", "letetr", "qq", "x"]


def frames(spark):
    return spark.createDataFrame([(q, q) for q in ASKED], "query string, corrected string"), spark.createDataFrame([(w,) for w in WORDS], "word string")


def grams(w):
    return {w[i : i + 2] for i in range(len(w) - 1)}


def jac(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_edit_candidates(spark):
    q, d = frames(spark)
    got = {(r.query, r.word, r.distance, r.rank) for r in candidates.edit_candidates(q, d).collect()}
    want = set()
    for a in ASKED:
        near = [(0, a)] if a in WORDS else sorted((indel(a, w), w) for w in WORDS if indel(a, w) <= 2) or [(0, a)]
        want |= {(a, w, n, i) for i, (n, w) in enumerate(near, 1)}
    assert got == want


def test_indel_pairs_of_any_distance(spark):
    rng = random.Random(9)
    make = lambda least, most: "".join(rng.choice("abcd") for _ in range(rng.randrange(least, most)))
    words = sorted({make(0, 9) for _ in range(40)} | {make(14, 30) for _ in range(30)})
    asked = sorted({make(0, 9) for _ in range(20)} | {"".join(c for c in w if rng.random() > 0.12) + make(0, 2) for w in words})
    q, d = (spark.createDataFrame([(w,) for w in own], f"{c} string") for own, c in ((asked, "query"), (words, "word")))
    for k in (0, 2, 3, 5):
        got = [(r.query, r.word, r.distance) for r in candidates.indel_pairs(q, d, k).collect()]
        want = {(a, w, indel(a, w)) for a in asked for w in words if indel(a, w) <= k}
        assert set(got) == want and len(got) == len(want), k


def test_ngram_best(spark):
    q, d = frames(spark)
    got = {(r.query, r.word): r.jaccard for r in candidates.ngram_best(q, d).collect()}
    want = {}
    for a in ASKED:
        top = max(jac(a, w) for w in WORDS)
        want |= {(a, w): top for w in WORDS if jac(a, w) == top} if top else {(a, min(WORDS)): 0.0}
    assert got == want


def test_ngram_best_of_many_words(spark):
    """Bounds from the rarest n-grams lose no best word and no tie, for words of any length and n."""
    rng = random.Random(6)
    make = lambda most: "".join(rng.choice("aaabbcde") for _ in range(rng.randrange(1, most)))
    words, asked = sorted({make(12) for _ in range(400)}), sorted({make(14) for _ in range(60)} | {"zzz", "q", ""})
    q, d = (spark.createDataFrame([(w,) for w in own], f"{c} string") for own, c in ((asked, "query"), (words, "word")))
    for n in (2, 3):
        sets = lambda w: {w[i : i + n] for i in range(len(w) - n + 1)}  # noqa: B023, E731
        got = {(r.query, r.word): r.jaccard for r in setjoin.best_by_jaccard(q, d, n).collect()}
        want = {}
        for a in asked:
            alike = {w: len(sets(a) & sets(w)) / max(len(sets(a) | sets(w)), 1) for w in words}
            top = max(alike.values())
            want |= {(a, w): x for w, x in alike.items() if x == top} if top else {}
        assert got == want


def test_hybrid_candidates(spark):
    q, d = frames(spark)
    got = {(r.query, r.word): r.score for r in candidates.hybrid_candidates(q, d).collect()}
    want = {}
    for a in ASKED:
        scored = {w: 0.5 * jac(a, w) + 0.5 * difflib.SequenceMatcher(None, a, w).ratio() for w in WORDS}
        kept = {(a, w): s for w, s in scored.items() if s >= 0.5}
        want |= kept or {(a, a): 0.0}
    assert got == want


def test_phrase_topk(spark):
    q, d = frames(spark)
    phrases = spark.createDataFrame([(1, "hihg spead befroe"), (2, "letetr"), (3, "")], "phrase_id long, phrase string")
    cands = candidates.edit_candidates(q, d)
    got = [(r.phrase_id, r.rank, r.words, r.total) for r in phrase.phrase_topk(phrase.phrase_tokens(phrases), cands).orderBy("phrase_id", "rank").collect()]
    options = {}
    for r in cands.orderBy("query", "rank").collect():
        options.setdefault(r.query, []).append((r.word, r.distance))
    want = []
    for i, text in ((1, "hihg spead befroe"), (2, "letetr")):
        whole = sorted(((" ".join(w for w, _ in c), sum(n for _, n in c)) for c in itertools.product(*(options[t] for t in text.split()))), key=lambda x: x[1])
        want += [(i, k, w, n) for k, (w, n) in enumerate(whole[:10], 1)]
    assert got == want


def test_phrase_topk_of_any_length(spark):
    cands = spark.createDataFrame([(f"q{i}", f"w{i}{j}", (3 * i + j * j) % 5, j + 1) for i in range(7) for j in range(3)], "query string, word string, distance int, rank int")
    phrases = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(7))), (2, "q3 missing q1")], "phrase_id long, phrase string")
    got = [(r.phrase_id, r.words, r.total) for r in phrase.phrase_topk(phrase.phrase_tokens(phrases), cands, most=12).orderBy("phrase_id", "rank").collect()]
    options = {}
    for r in cands.orderBy("query", "rank").collect():
        options.setdefault(r.query, []).append((r.word, r.distance))
    want = []
    for i, places in ((1, [f"q{i}" for i in range(7)]), (2, ["q3", "q1"])):
        whole = sorted(((" ".join(w for w, _ in c), sum(n for _, n in c)) for c in itertools.product(*(options[t] for t in places))), key=lambda x: x[1])
        want += [(i, w, n) for w, n in whole[:12]]
    assert got == want


def test_listing_of_combinations(spark, monkeypatch):
    monkeypatch.setattr(products, "LISTED", 5)
    cands = spark.createDataFrame([(q, q + w) for q in "abc" for w in "zyxw"], "query string, word string")
    phrases = spark.createDataFrame([(1, "a b c", "ax by cz"), (2, "a none", "a b"), (3, " ".join("abc" * 25), "x")], "phrase_id long, phrase string, corrected string")
    tokens = phrase.phrase_tokens(phrases)
    whole = [" ".join(c) for c in sorted(itertools.product(*([q + w for w in "zyxw"] for q in "abc")))]
    listed = lambda *part: [(r.phrase_id, r["rank"], r.suggestion) for r in products.listing(tokens.where("phrase_id < 3"), cands, *part).orderBy("phrase_id", "rank").collect()]
    assert listed() == [(1, i, c) for i, c in enumerate(whole, 1)]
    assert listed(18, 31) == [(1, i, whole[i - 1]) for i in range(18, 32)]
    assert listed(60, 99) == [(1, i, whole[i - 1]) for i in range(60, 65)] and listed(65, 99) == []
    # A part far within a list too long to be made: 4^75 combinations, number 4^30 + 2.
    deep = products.listing(tokens.where("phrase_id = 3"), cands, 4**30 + 2, 4**30 + 2).first().suggestion.split()
    assert [w[1] for w in deep] == ["w"] * 44 + ["x"] + ["w"] * 29 + ["x"]
    counts = {r.phrase_id: r.n for r in phrase.soundex_products(tokens, cands).collect()}
    assert counts == {1: 64.0, 2: 0.0, 3: 4.0**75}


def test_search_of_all_combinations(spark):
    docs = spark.createDataFrame(
        [(1, "Xax by czz!", ""), (2, "ax  by cz", ""), (3, "ay bw", "cz"), (4, "ay bw cy ay bz cx", ""), (5, "q\nay", "bw cxx by"), (6, "solo", "dxe"), (7, None, "AX BY CZ")],
        "Index long, Title string, Abstract string",
    )
    cands = spark.createDataFrame([(q, q + w) for q in "abcd" for w in "zyxw"], "query string, word string")
    phrases = spark.createDataFrame([(1, "a b c"), (2, "b c"), (3, "d"), (4, "a none c"), (5, "a b c"), (6, "c b")], "phrase_id long, phrase string")
    got = {(r.phrase, r.doc_id) for r in products.search_all(docs, phrase.phrase_tokens(phrases), cands, docs.Title, docs.Abstract).collect()}
    want = set()
    for text in ("a b c", "b c", "d", "c b"):
        for c in itertools.product(*([q + w for w in "zyxw"] for q in text.split())):
            want |= {(" ".join(c), r.Index) for r in docs.collect() if any(" ".join(c) in (f or "").lower() for f in (r.Title, r.Abstract))}
    assert got == want and len(want) > 6


def test_text_index(spark, tmp_path):
    rng = random.Random(4)
    make = lambda: "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 40)))
    rows = [(i * 40_000, make() or None, make()) for i in range(60)] + [(1, "Tail ab", "x\nyz🎉q"), (2, "", None)]
    docs = spark.createDataFrame(rows, "Index long, Title string, Abstract string")
    textindex.store(docs, str(tmp_path / "text"), docs.Title, docs.Abstract)
    asked = ["", "a", "é", "ab", "b ", "abc", "AIL", "cab a", "a\x00", "\nyz🎉", "🎉", "zzz", "ab é", None, "x\nyz🎉q"] + [make()[:6] for _ in range(40)]
    found = textindex.TextIndex(spark, str(tmp_path / "text")).search(spark.createDataFrame([(p,) for p in asked], "phrase string"))
    want = {(p.lower(), i) for p in asked if p is not None for i, *fs in rows if any(p.lower() in (f or "").lower() for f in fs)}
    got = [(r.phrase, r.doc_id) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_benchmark_report(spark):
    q = spark.createDataFrame([("spead", "spread"), ("letetr", "better")], "query string, corrected string")
    _, d = frames(spark)
    fix = lambda asked: candidates.edit_candidates(asked, d).where("rank = 1").select("query", "word")
    figures, found = metrics.benchmark(q, fix)
    assert (figures["asked"], figures["right"], figures["share"]) == (2, 1, 0.5)
    assert figures["seconds"] > 0 and figures["executor"] > 1 << 20 and figures["workers"] > 1 << 20
    lines = writers.benchmark_lines("EDIT DISTANCE", metrics.machine(spark), figures)
    assert lines[0] == "EDIT DISTANCE" and "- Correct Results: 1/2 (50.00%)" in lines and any(x.startswith("executor: ") and x.endswith("B at most") for x in lines)
    assert {r.query: r.line for r in writers.outcome_lines(found).collect()}["letetr"] == "letetr: letter (should be better)"
    assert metrics.benchmark(q.limit(0), fix)[0]["each"] < 60


def test_peaks_follow_the_executors(spark):
    """What tasks hold shows in the report; the driver's own memory doesn't."""

    def hold(megabytes):
        def run(batches):
            for batch in batches:
                held = b"x" * (megabytes << 20)  # noqa: F841
                yield batch

        peaks = metrics.Peaks(spark)
        rows = peaks.through(spark.range(0, 20, 1, 1).mapInArrow(run, "id long"))
        assert rows.count() == 20
        return peaks.bytes["workers"]

    assert metrics.Peaks(spark).bytes == {"workers": 0, "executor": 0}
    little = hold(0)
    assert hold(300) - little > 200 << 20


def test_samples_and_steps(spark):
    q = spark.createDataFrame([("spead", "spread"), ("letetr", "better")], "query string, corrected string")
    _, d = frames(spark)
    fix = lambda asked: candidates.edit_candidates(asked, d).where("rank = 1").select("query", "word")
    steps = metrics.timed([("read", lambda: d.count()), ("ask", lambda: q.count())])
    assert list(steps) == ["read", "ask", "total"]
    shown = {r.query: r.line for r in metrics.sample_corrections(spark, fix, ["spead", "qqqq"]).collect()}
    assert shown["qqqq"] == "'qqqq' -> 'qqqq'" and shown["spead"].startswith("'spead' -> '")


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrase, "PHRASE_BLOCK", 3)
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(20)], "Index long, Title string")
    asked = spark.createDataFrame([(f"W{i}",) for i in range(5, 15)] + [("",), (None,)], "phrase string")
    got = {(r.phrase, r.doc_id) for r in phrase.search(docs, asked, docs.Title).collect()}
    texts = {i: f"w{i} w{i + 1}" for i in range(20)}
    assert got == {(p, i) for p in ["", *(f"w{i}" for i in range(5, 15))] for i, t in texts.items() if p in t}


def test_soundex_quality(spark):
    d = spark.createDataFrame([(w,) for w in ("behavior", "before", "behaviour")], "word string")
    phrases = spark.createDataFrame([(1, "befroe befroe", "before before"), (2, "befroe", "before before"), (3, "qqq", "x")], "phrase_id long, phrase string, corrected string")
    tokens = phrase.phrase_tokens(phrases)
    cands = candidates.soundex_candidates(tokens.withColumnRenamed("token", "query"), d)
    got = {r.phrase_id: (r.tp, r.fp) for r in phrase.soundex_quality(phrases, tokens, cands).collect()}
    assert got == {1: (1, 8), 2: (0, 3), 3: (0, 0)}


def test_word_quality(spark):
    q = spark.createDataFrame([("befroe", "before"), ("x", "y")], "query string, corrected string")
    s = spark.createDataFrame([("befroe", "before"), ("befroe", "behavior"), ("befroe", "behaviour")], "query string, word string")
    quality = metrics.suggestion_quality(q, s)
    assert {(r.query, r.tp, r.fp) for r in quality.collect()} == {("befroe", 1, 2), ("x", 0, 0)}
    assert metrics.corpus_quality(quality).first().asDict() == {"precision": 0.5, "accuracy": 1 / 3, "hit_rate": 0.5}


def test_search(spark):
    docs = spark.createDataFrame([(2, "A cat", "dog"), (1, "concatenate", None)], "Index long, Title string, Abstract string")
    asked = spark.createDataFrame([("CAT",), ("dog",), ("nothing",)], "phrase string")
    found = phrase.search(docs, asked, docs.Title, docs.Abstract)
    assert {(r.phrase, r.doc_id) for r in found.collect()} == {("cat", 1), ("cat", 2), ("dog", 2)}
    assert {(r.phrase, r.doc_id) for r in phrase.first_documents(found).collect()} == {("cat", 1), ("dog", 2)}
