import numpy as np
import pytest

from lexloom.llm import binary_codes


def vectors():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 24))
    near = base[:20] + 0.03 * rng.standard_normal((20, 24))
    cloud = base[40] + 0.2 * rng.standard_normal((40, 24))
    rows = [v.astype(np.float32).tolist() for v in (*base, *near, *cloud)]
    rows += [rows[0]] * 5 + [[x * 2 for x in rows[1]], None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [float("inf")] * 24, rows[2][:12]]
    return [(i * 2, v, 1, i) for i, v in enumerate(rows)] + [(None, rows[3], 1, 0), (4, rows[50], 1, 0)]


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("hot", [2000, 6])
def test_links(spark, monkeypatch, hot):
    monkeypatch.setattr(binary_codes, "HOT", hot)
    monkeypatch.setattr(binary_codes, "BLOCK", max(2, hot // 2))
    rows = vectors()
    got = binary_codes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, many int"), 0.95).collect()
    n = len(rows)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            a, b = rows[i][1], rows[j][1]
            if i != j and good(a) and good(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                linked[i, j] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95
    label = np.arange(n)
    for _ in range(n):
        label = np.array([min([label[i], *label[linked[i]]]) for i in range(n)])
    least = {c: min((rows[i][0] for i in range(n) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    want = sorted(((rows[i][0], int(linked[i].sum()), least[label[i]] if good(rows[i][1]) else rows[i][0]) for i in range(n)), key=repr)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_recall(spark):
    """Links planted just above the threshold among many vectors: all but a few are found, and none below it."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((1500, 64))
    other -= (other * base[:1500]).sum(axis=1, keepdims=True) * base[:1500]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.9501, 0.96, (1500, 1))
    rows = np.concatenate((base, cos * base[:1500] + np.sqrt(1 - cos**2) * other))
    got = binary_codes.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>"), 0.95)
    found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    near = rows @ rows.T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() == 3000
    hits = sum(found[4000 + i] == (1, i) for i in range(1500))
    assert hits >= 0.99 * 1500
    assert all(found[i][0] <= near[i].sum() for i in range(len(rows)))


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.05 * rng.standard_normal((400, 64))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    data, query, at = binary_codes.codes(x), binary_codes.codes(y), np.arange(400)
    guess, deviation = binary_codes.estimate(64, data, query, binary_codes.planes(query[2]), at, at)
    exact = (x * y).sum(axis=1)
    assert abs((guess - exact).mean()) < 0.02
    assert (np.abs(guess - exact) <= binary_codes.EPSILON * deviation).all()
    both = [np.concatenate(z) for z in zip(data, query, strict=True)]
    guess, deviation = binary_codes.refined(64, both, at, at + 400)
    assert abs((guess - exact).mean()) < 0.001
    assert (np.abs(guess - exact) <= binary_codes.EPSILON * deviation).all() and deviation.max() < 0.003


def test_intervals_hold_and_leave_little_open():
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    x = np.concatenate([centre + scale * rng.standard_normal((150, 64)) for scale in (0, 0.01, 0.1, 0.16, 0.3, 3)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coded = binary_codes.codes(x)
    middle, half = binary_codes.intervals(64, coded, slice(0, len(x)))
    assert (np.abs(middle - x @ x.T) <= half).all()
    assert (middle == middle.T).all() and (half == half.T).all()
    open_ = np.abs(middle - 0.95) <= half
    assert 0 < open_.mean() < 0.2
    # The same bits for a part, and for rows among others.
    some = np.arange(7, len(x), 11)
    part, width = binary_codes.intervals(64, [z[some] for z in coded], slice(3, 20))
    assert (part == middle[np.ix_(some[3:20], some)]).all() and (width == half[np.ix_(some[3:20], some)]).all()


def test_links_of_a_cluster_by_bounds_and_by_vectors(spark):
    """A hot cluster on both sides of the threshold, in blocks: what bounds decide and what they leave is every pair, once."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal(64) + 0.2 * rng.standard_normal((2600, 64))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in binary_codes.near_duplicates(rows, 0.955).collect()}
    norms = np.linalg.norm(x, axis=1)
    near = x @ x.T / norms[:, None] / norms >= 0.955
    np.fill_diagonal(near, False)
    assert near.sum() > 100_000
    label = np.arange(len(x))
    for _ in range(20):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    assert got == {i: (int(near[i].sum()), int(label[i])) for i in range(len(x))}


def test_empty(spark):
    assert binary_codes.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
