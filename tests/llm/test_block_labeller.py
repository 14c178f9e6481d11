import random

import numpy as np
import pytest

from lexloom.llm import block_labeller as L
from lexloom.llm.html_blocks import blocks
from tests.llm.conftest import prose


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class='a-b cD' id=x1><!-- <p>no</p> --><script>"</p>"</script>
      <div>one<p>two <b>bold<br>line<p>three&nbsp;&lt;b&gt; <a href="/">lin<i>k</i></a></div>four<ul><li>l1<li>l2</ul>
      <table><tr><td>c1<td>c2</table><p title="a > b">five</p></nav></p>six <textarea>gone</textarea><img src=x>seven<p"""
    got = [(b.text, b.path[-1], b.linked) for b in blocks(page)]
    want = [
        ("T & t", "l:title", 0), ("one", "l:div", 0), ("two bold line", "l:p", 0), ("three <b> link", "l:p", 4), ("four", "l:body", 0),
        ("l1", "l:li", 0), ("l2", "l:li", 0), ("c1", "l:td", 0), ("c2", "l:td", 0), ("five", "l:p", 0), ("six seven<p", "l:body", 0),
    ]
    assert got == want
    assert blocks(page)[4].path == ("t:html", "t:body", "c:a", "c:b", "c:c", "c:d", "c:x", "l:body")
    assert [b.path for b in blocks("<article><p>a<p>b</article>c")] == [("t:article", "t:p", "l:p")] * 2 + [("l:",)]
    assert blocks("") == blocks("<p> &nbsp; </p><script>x") == [] and blocks("just text")[0].text == "just text"
    assert len(blocks("<div>" * 3000 + "x" + "<p>y" * 3000)) == 3001


def page(rng, paragraphs):
    body = "".join(f"<p>{prose(rng, rng.randrange(1, 60)).capitalize()}.</p>" for _ in range(paragraphs))
    menu = "".join(f"<li><a href=/>{prose(rng, 1)}</a></li>" for _ in range(rng.randrange(2, 8)))
    return f"<html><body><nav><ul>{menu}</ul></nav><div class=ad>{prose(rng, 9)}.</div><article><h1>{prose(rng, 5)}</h1>{body}</article><footer>&copy; {prose(rng, 4)}</footer></body></html>"


def test_gradients_are_those_of_the_loss():
    """Every weight's gradient through both directions, by differences."""
    rng = random.Random(1)
    pages, labels = L.examples([page(rng, n) for n in (1, 4, 2)], 1)
    model, e, y = L.Labeller.fresh(np.random.default_rng(0)), L.Encoded(pages), np.concatenate(labels)
    _, grads = model.gradients(e, y)
    for name, w in model.weights.items():
        for at in np.argsort(-np.abs(grads[name]).ravel())[:3]:
            i = np.unravel_index(at, w.shape)
            old = w[i]
            losses = []
            for step in (1e-5, -1e-5):
                w[i] = old + step
                losses.append(model.gradients(e, y)[0])
            w[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][i]) < 1e-6, name


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, page(rng, rng.randrange(1, 12)), "x") for i in range(90)] + [(None, None, "x"), (3, "", "x")], "page_id long, html string, text string")
    return L.fit(frame, 80)


def test_held_out_pages(model):
    """Pages of the sample's template, and pages in clothes that the sample has never worn in this order."""
    rng = random.Random(77)
    pages, labels = L.examples([page(rng, rng.randrange(1, 12)) for _ in range(60)], 3, seed=78)
    plain, rest = [], []
    for i, (p, y) in enumerate(zip(pages, labels, strict=True)):
        (plain if i < 120 else rest).append((model.chances(L.Encoded([p])) >= 0.5) == y)
    assert np.concatenate(plain).mean() > 0.995
    assert np.concatenate(rest).mean() > 0.95


def test_pages_side_by_side_dont_matter(model, monkeypatch):
    rng = random.Random(5)
    pages = [page(rng, rng.randrange(0, 30)) for _ in range(25)] + ["", "<p></p>", page(rng, 900)]
    alone = [L.main_texts(model, [p])[0] for p in pages]
    for cells in (1, 300, 1 << 20):
        monkeypatch.setattr(L, "CELLS", cells)
        assert L.main_texts(model, pages) == alone


def test_extract(spark, model):
    rng = random.Random(6)
    rows = [(i % 7, f"u{i}", page(rng, 1 + i % 5), 5, "c") for i in range(30)] + [(None, None, page(rng, 2), 5, "c"), (1, "u", None, 5, "c"), (2, "u", "", 5, "c"), (3, "u", "<div>", 5, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string").repartition(3)
    got = L.extract(pages, model)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = sorted((r[0], r[1], t, len(t)) for r, t in zip(rows, L.main_texts(model, [r[2] or "" for r in rows]), strict=True) if r[0] is not None)
    whole = got.collect()
    assert sorted(tuple(r) for r in whole if r.page_id is not None) == want and len(whole) == len(rows)
    assert [r.text for r in whole if r.page_id in (1, 2, 3) and r.url == "u"] == [""] * 3
    assert "\n\n" in next(t for *_, t, n in want if n > 200)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id string, url string, html string")
    model = L.fit(empty, 5)  # of a fixed vocabulary
    assert L.extract(empty, model).count() == 0
    rng = random.Random(8)
    pages, labels = L.examples([page(rng, 5) for _ in range(10)], 1)
    assert np.mean((model.chances(L.Encoded(pages)) >= 0.5) == np.concatenate(labels)) > 0.7
