import random

import numpy as np

from lexloom.llm import toxicity
from tests.llm.conftest import WORDS, prose

BAD = ["fiend", "wretch", "vileness"]


def corpus(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randrange(20, 80)).split()
        toxic = i % 4 == 0
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int"), dict(labels)


def test_held_out(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit(docs, labels.where("doc_id % 3 != 0"))
    assert (np.diff(model.thresholds) > 0).all()
    got = [r for r in toxicity.score(docs, model).collect() if r.doc_id % 3 == 0]
    assert np.mean([r.toxic == bool(truth[r.doc_id]) for r in got]) > 0.97
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in got)
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.toxic}


def test_cumulative_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 900)
    rows, cols = np.repeat(np.arange(900), 3), rng.integers(3, 20, 2700)
    marked = grades > 0
    cols[::3][marked] = np.where(grades[marked] == 2, 1, 0)
    w, theta = toxicity.cumulative_fit(rows, cols, 900, 20, grades, np.ones(900))
    assert theta[0] < theta[1] and w[1] > w[0] > np.abs(w[3:]).max()


def test_edges(spark, docs, rows, empty):
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.score(docs, none).collect()
    assert len(got) == len(rows) and not any(r.toxic for r in got)
    assert toxicity.score(empty, none).count() == 0 and toxicity.keep_clean(empty, none).count() == 0
    assert toxicity.keep_clean(docs, none).count() == len(rows)
    assert WORDS


def test_unseen_words_have_no_weight(spark):
    docs, labels, _ = corpus(spark)
    model = toxicity.fit(docs, labels)
    letters = random.Random(3)
    unseen = " ".join("qx" + "".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(200_000))
    asked = spark.createDataFrame([(1, unseen), (2, "")], "doc_id long, text string")
    long, none = sorted(toxicity.score(asked, model).collect())
    assert (long.p_toxic, long.severity) == (none.p_toxic, none.severity)


def test_gradient(monkeypatch):
    """One step of the fit against numeric differences of the penalised log-likelihood."""
    rng = np.random.default_rng(5)
    n, width = 30, 6
    dense = rng.random((n, width)) < 0.4
    rows, cols = np.nonzero(dense)
    grades, weight = rng.integers(0, 3, n), rng.random(n) + 0.5
    w, theta = toxicity.cumulative_fit(rows, cols, n, width, grades, weight, steps=3000)
    scale = weight / weight.sum()

    def loss(w, theta):
        edges = np.concatenate(([-np.inf], theta, [np.inf]))
        above, beyond = (1 / (1 + np.exp(-np.clip(dense @ w - edges[grades + i], -60, 60))) for i in (0, 1))
        return -(scale * np.log(above - beyond)).sum() + 0.3 * (w * w).sum() / 2 / n

    best = loss(w, theta)
    for i in range(width):
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(width) == i), theta) >= best - 1e-6
    for step in ((0.05, 0), (-0.05, 0), (0, 0.05), (0, -0.05)):
        assert loss(w, theta + np.array(step)) >= best - 1e-6


def test_repeated_doc_ids_count_once(spark):
    docs = spark.createDataFrame([(i % 5, f"word{i} text") for i in range(40)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(5)] * 3 + [(None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    assert toxicity.labelled_features(docs, labels).count() == 5
