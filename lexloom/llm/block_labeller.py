"""Main text of HTML pages by a recurrent labeller of blocks.

A page is read into its sequence of text blocks (leaves).  A block's vector holds the mean of the
vectors of its tag path's hashed marks, the mean of those of its hashed words, and a few measures (length,
share of links, ending).  A bidirectional LSTM, in numpy, runs over all blocks of a page in both directions,
so every block is labelled with the whole page as its context; what is labelled main text stays.

Training: SAMPLE pages, those of least hashed page_id, give blocks that stand within `article` or `main`
(and not in a nav, aside, footer or form there) as main text and all others as not; pages
without such an element are left out.  Each is taken as it stands, and DRESSED times more in other clothes: its main text in
another container (named by class or id, or not at all), with menus, headers, adverts, notices, forms,
side bars, reader comments and footers made of other pages' words around and within it, so the labels
don't hang on one template.  Without any such page the model is trained on dressed pages of a fixed
vocabulary.  The fit is seeded, and runs on the driver over this bounded sample; labelling covers every
page and its whole text, pages of like length side by side.

Null or empty html, and a page with no main block: empty text, n_chars 0.  Scripts, styles, templates and
comments hold no blocks.  Repeated or null page_ids and urls are kept row by row; other columns are ignored; no
pages give no rows.  Very long pages are one sequence, whole.
"""

from __future__ import annotations

import html
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import HELD, map_arrow
from lexloom.llm.html_blocks import Block, blocks

SAMPLE, DRESSED, EPOCHS, SEED = 240, 3, 10, 11
MARKS, WORDS, MARK_SIZE, WORD_SIZE, MEASURES, HIDDEN = 1 << 11, 1 << 12, 12, 8, 6, 16
#: Cells of one padded set of pages in a task: pages times blocks of the longest.
CELLS = 1 << 14

_ids: dict[str, int] = {}
HELD[__name__] = _ids


def _hashed(word: str) -> int:
    got = _ids.get(word)
    if got is None:
        if len(_ids) > 500_000:
            _ids.clear()
        got = _ids[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return got


class Encoded:
    """The blocks of some pages as arrays: hashed marks and words laid end to end, measures, blocks a page."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for page in pages for b in page]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        words = [b.text.lower().split() for b in flat]
        self.mark_ends = np.cumsum([len(b.path) for b in flat], dtype=np.int64)
        self.word_ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        self.marks = np.fromiter((_hashed(m) for b in flat for m in b.path), np.int64) % MARKS
        self.words = np.fromiter((_hashed(x) for w in words for x in w), np.int64) % WORDS
        sizes = np.array([len(b.text) for b in flat], np.float64)
        linked = np.array([b.linked for b in flat], np.float64)
        place = np.concatenate([(np.arange(n) + 0.5) / n for n in self.lengths if n] or [np.empty(0)])
        ends = np.array([b.text[-1] in ".!?…:;\"”»" for b in flat], np.float64)
        counts = np.array([len(w) for w in words], np.float64)
        self.measures = np.stack([np.log1p(sizes) / 6, np.log1p(counts) / 4, np.minimum(linked / np.maximum(sizes, 1), 1), ends, place, (counts > 12).astype(np.float64)], axis=1) if flat else np.empty((0, MEASURES))

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Row (within its page) and page of each block."""
        page = np.repeat(np.arange(len(self.lengths)), self.lengths)
        return np.arange(len(page)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths), page


def _means(table: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean vector of each run of ids; every block has a mark and a word."""
    starts = np.concatenate(([0], ends[:-1]))
    return np.add.reduceat(table[ids], starts, axis=0) / (ends - starts)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (steps, pages, HIDDEN) of inputs (steps, pages, size), and what the way back needs."""
    steps, pages, _ = x.shape
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    fed, out, kept = x @ wx + b, np.empty((steps, pages, HIDDEN)), []
    for t in range(steps):
        z = fed[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[t] = h
        kept.append((i, f, o, g, before, squashed, h_before))
    return out, kept


def lstm_back(d_out: np.ndarray, x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the three weights."""
    steps, pages, _ = x.shape
    d_z = np.empty((steps, pages, 4 * HIDDEN))
    d_h, d_c, d_wh = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN)), np.zeros_like(wh)
    for t in reversed(range(steps)):
        i, f, o, g, before, squashed, h_before = kept[t]
        d = d_out[t] + d_h
        d_c = d_c + d * o * (1 - squashed**2)
        d_z[t] = np.concatenate((d_c * g * i * (1 - i), d_c * before * f * (1 - f), d * squashed * o * (1 - o), d_c * i * (1 - g**2)), axis=1)
        d_wh += h_before.T @ d_z[t]
        d_h, d_c = d_z[t] @ wh.T, d_c * f
    return d_z @ wx.T, np.einsum("tpi,tpo->io", x, d_z), d_wh, d_z.sum((0, 1))


class Labeller:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Labeller:
        size = MARK_SIZE + WORD_SIZE + MEASURES
        w = {"marks": rng.normal(0, 0.3, (MARKS, MARK_SIZE)), "words": rng.normal(0, 0.1, (WORDS, WORD_SIZE)), "out": rng.normal(0, 0.2, 2 * HIDDEN + size), "bias": np.zeros(1)}
        for way in ("on", "back"):
            w[f"{way}_x"], w[f"{way}_h"] = rng.normal(0, 0.2, (size, 4 * HIDDEN)), rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"{way}_b"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # it remembers at first
        return cls(w)

    def _run(self, e: Encoded):
        """Chances of all blocks, and what the way back needs."""
        w, (row, page) = self.weights, e.places()
        v = np.concatenate((_means(w["marks"], e.marks, e.mark_ends), _means(w["words"], e.words, e.word_ends), e.measures), axis=1)
        steps, pages = int(e.lengths.max()), len(e.lengths)
        mirrored = e.lengths[page] - 1 - row
        x, y = np.zeros((steps, pages, v.shape[1])), np.zeros((steps, pages, v.shape[1]))
        x[row, page], y[mirrored, page] = v, v  # what pads a page stands behind its end in either direction
        on, on_kept = lstm(x, w["on_x"], w["on_h"], w["on_b"])
        back, back_kept = lstm(y, w["back_x"], w["back_h"], w["back_b"])
        seen = np.concatenate((on[row, page], back[mirrored, page], v), axis=1)
        return _sigmoid(seen @ w["out"] + w["bias"]), (row, page, mirrored, x, y, on_kept, back_kept, seen)

    def chances(self, e: Encoded) -> np.ndarray:
        return self._run(e)[0] if len(e.marks) else np.empty(0)

    def gradients(self, e: Encoded, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the blocks, and its gradients."""
        w = self.weights
        p, (row, page, mirrored, x, y, on_kept, back_kept, seen) = self._run(e)
        loss = -np.mean(np.log(np.where(labels == 1, p, 1 - p) + 1e-12))
        d = (p - labels) / len(p)
        grads = {"out": seen.T @ d, "bias": d.sum(keepdims=True)}
        d_seen = d[:, None] * w["out"]
        d_v = d_seen[:, 2 * HIDDEN :].copy()
        for way, at, inputs, kept, part in (("on", row, x, on_kept, slice(0, HIDDEN)), ("back", mirrored, y, back_kept, slice(HIDDEN, 2 * HIDDEN))):
            d_out = np.zeros((*inputs.shape[:2], HIDDEN))
            d_out[at, page] = d_seen[:, part]
            d_x, grads[f"{way}_x"], grads[f"{way}_h"], grads[f"{way}_b"] = lstm_back(d_out, inputs, w[f"{way}_x"], w[f"{way}_h"], kept)
            d_v += d_x[at, page]
        for name, ids, ends, part in (("marks", e.marks, e.mark_ends, slice(0, MARK_SIZE)), ("words", e.words, e.word_ends, slice(MARK_SIZE, MARK_SIZE + WORD_SIZE))):
            sizes = np.diff(ends, prepend=0)
            grads[name] = np.zeros_like(w[name])
            np.add.at(grads[name], ids, np.repeat(d_v[:, part] / sizes[:, None], sizes, axis=0))
        return loss, grads


def fit_blocks(pages: list[list[Block]], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller by Adam over sets of 16 pages of like length; at each step a tenth of the marks and half of the words are exchanged for others, so that no rare word decides."""
    rng = np.random.default_rng(seed)
    model, step = Labeller.fresh(rng), 0
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    some = [i for i, p in enumerate(pages) if p]
    for epoch in range(epochs):
        order = rng.permutation(some)
        order = np.concatenate([sorted(order[at : at + 160], key=lambda i: len(pages[i])) for at in range(0, len(order), 160)])
        for at in rng.permutation(range(0, len(order), 16)):
            chosen = order[at : at + 16]
            e = Encoded([pages[i] for i in chosen])
            for ids, top, share in ((e.marks, MARKS, 0.1), (e.words, WORDS, 0.5)):
                hidden = rng.random(len(ids)) < share
                ids[hidden] = rng.integers(0, top, hidden.sum())
            _, grads = model.gradients(e, np.concatenate([labels[i] for i in chosen]))
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 1e-4
            for k, g in grads.items():
                m, v = state[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.weights[k] -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + {"words": 2e-2, "marks": 1e-3}.get(k, 0) * model.weights[k])
    return model


#: Markup that tells main text from the rest in the sample.
MAIN, REST = ("t:article", "t:main"), ("t:nav", "t:aside", "t:footer", "t:form")


def is_main(block: Block) -> bool:
    return any(m in block.path for m in MAIN) and not any(m in block.path for m in REST)


#: Containers of main text; what stands around it, by kind: opening, closing, tag of each text, number of texts; usual words.
HOMES = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<article class="post">', "</article>"), ('<div class="content">', "</div>"),
    ('<div id="content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<div class="article-body">', "</div>"), ('<div class="post-body">', "</div>"), ('<section class="story">', "</section>"),
    ('<div id="main"><div class="text">', "</div></div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", ""), ('<div class="wrapper"><div class="row">', "</div></div>"),
]
MENUS = [
    ("<nav><ul>", "</ul></nav>", "li"), ('<div class="menu"><ul>', "</ul></div>", "li"), ('<ul id="navigation">', "</ul>", "li"), ('<div class="breadcrumbs">', "</div>", "span"), ('<div role="navigation">', "</div>", "div"),
    ('<nav class="navbar">', "</nav>", "div"), ('<div class="pagination">', "</div>", "span"), ('<div class="topbar">', "</div>", "div"),
]
HEADS = [("<header>", "</header>", "h1"), ('<div class="header">', "</div>", "h2"), ('<header class="site-header">', "</header>", "p"), ('<div id="masthead">', "</div>", "div"), ('<div class="logo">', "</div>", "div")]
ASIDES = [
    ('<div class="ad">', "</div>", ""), ('<div class="advert">', "</div>", "p"), ('<div class="banner">', "</div>", "p"), ('<ins class="ads">', "</ins>", "div"), ('<section class="sponsored">', "</section>", "p"), ('<div class="promo">', "</div>", "p"),
    ("<aside>", "</aside>", "p"), ('<aside class="sidebar">', "</aside>", "p"), ('<div class="sidebar">', "</div>", "p"), ('<div id="sidebar">', "</div>", "li"), ('<div class="widget">', "</div>", "div"), ('<div class="related">', "</div>", "li"),
    ('<div class="cookie-notice">', "</div>", "p"), ('<div class="notice">', "</div>", ""), ('<div class="alert">', "</div>", "p"), ('<div role="alert">', "</div>", "p"), ('<div class="popup">', "</div>", "p"), ('<div class="cookie-banner">', "</div>", ""), ('<div id="gdpr-consent">', "</div>", "p"),
    ('<form class="newsletter">', "</form>", "label"), ("<form>", "</form>", "label"), ('<form class="search">', "</form>", "button"), ('<div class="subscribe">', "</div>", "p"), ('<div class="share">', "</div>", "span"), ('<div class="social">', "</div>", "li"),
]
REMARKS = [
    ('<div class="comments">', "</div>", "p"), ('<section id="comments">', "</section>", "li"), ('<div id="comments"><h3>Comments</h3>', "</div>", 'div class="comment"'), ('<ol class="comment-list">', "</ol>", 'li class="comment"'),
    ('<section class="comments"><h2>Reader comments</h2>', "</section>", "p"), ('<div class="discussion">', "</div>", 'div class="reply"'), ('<section class="responses">', "</section>", "article"),
]
FEET = [("<footer>", "</footer>", ""), ("<footer>", "</footer>", "p"), ('<div class="footer">', "</div>", "p"), ('<div id="footer">', "</div>", "li"), ('<div class="copyright">', "</div>", "p"), ('<footer class="site-footer">', "</footer>", "div")]
SAID = {
    "menu": "home about contact news archive login sitemap help products services blog search next previous".split(),
    "aside": "advertisement sponsored subscribe cookies newsletter accept privacy share follow offer buy now sign up related".split(),
    "foot": "copyright © all rights reserved terms privacy imprint contact 2023 2024".split(),
    "remark": "comment reply says thanks agree posted ago disagree".split(),
}


#: Stands before each main text of a dressed page until it is read.
MARK = "\ue000"


def dressed(rng: random.Random, main: list[str], rest: list[str]) -> str:
    """A page of main texts (marked) in other clothes; rest: texts of other pages, for what stands around."""
    out = ["<!DOCTYPE html><html><head><meta charset=utf-8><title>"]

    def prose(least: int, most: int, kind: str) -> str:
        own = rng.choice(rest).split() if rest else []
        at, n = rng.randrange(len(own) + 1), rng.randint(least, most)
        words = own[at : at + n] if rng.random() < 0.75 else []
        words += rng.choices(SAID[kind], k=rng.randint(0 if words else 1, 3))
        return html.escape(" ".join(words))

    def box(options: list, kind: str, count: tuple[int, int], size: tuple[int, int], link: float):
        start, end, tag = rng.choice(options)
        out.append(start)
        for _ in range(1 if not tag else rng.randint(*count)):
            text = prose(*size, kind)
            text = f'<a href="/{rng.randrange(99)}">{text}</a>' if rng.random() < link else text
            out.append(f"<{tag}>{text}</{tag.split()[0]}>" if tag else text)
        out.append(end)

    def aside():
        box(ASIDES, "aside", (1, 4), (1, 40), 0.3)

    def tell(name: str, text: str):
        out.append(f"<{name}>{MARK}{html.escape(text)}" + ("" if name == "p" and rng.random() < 0.2 else f"</{name}>"))

    out.append(html.escape(main[0][:60]) + "</title><style>p{margin:0}</style><script>var a='</p>';</script></head><body>")
    for options, kind, often, sizes in ((HEADS, "menu", 0.5, ((1, 2), (1, 4), 0.3)), (MENUS, "menu", 0.8, ((2, 9), (1, 2), 0.9))):
        if rng.random() < often:
            box(options, kind, *sizes)
    for _ in range(rng.choice((0, 0, 1, 2))):
        aside()
    start, end = rng.choice(HOMES)
    holder, lists = rng.choice(("p", "p", "p", "p", "div", "section")), rng.random() < 0.2
    out.append(start)
    if rng.random() < 0.15:
        out.append("<header>")
        tell("h1", main[0])
        out.append("</header>")
        main = main[1:]
    elif rng.random() < 0.75:
        tell(rng.choice(("h1", "h2")), main[0])
        main = main[1:]
    for text in main:
        if rng.random() < 0.06:
            aside()
        if lists and rng.random() < 0.3:
            out.append("<ul>")
            for piece in text.split(". ")[:4]:
                if piece.strip():
                    tell("li", piece)
            out.append("</ul>")
            continue
        tell(rng.choice(("h2", "h3", "blockquote", "pre")) if rng.random() < 0.08 else holder, text)
    inside = rng.random() < 0.25
    if not inside:
        out.append(end)
    for _ in range(rng.choice((0, 1, 1, 2))):
        aside()
    if rng.random() < 0.45:
        box(REMARKS, "remark", (1, 8), (2, 60), 0.05)
    if inside:
        out.append(end)
    if rng.random() < 0.85:
        box(FEET, "foot", (1, 3), (1, 14), 0.3)
    out.append("</body></html>")
    return "".join(out)


#: A fixed vocabulary, for tables without a page to learn from.
PLAIN = [" ".join(["The river rose in spring and the town moved its market up the hill."] * n) for n in (1, 3, 6, 2)]


def examples(pages: list[str], dressings: int = DRESSED, seed: int = SEED) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks and labels of pages with marked main text, as they stand (twice) and in other clothes."""
    rng = random.Random(seed)
    read = [page for page in map(blocks, pages) if any(map(is_main, page))]
    texts = [[b.text for b in page if is_main(b)] for page in read] or [PLAIN] * 40
    prose = [t for page in texts for t in page]
    out, labels = [*read, *read], [np.array([is_main(b) for b in page], np.float64) for page in read] * 2
    for main in texts:
        for _ in range(dressings):
            # Of a long page a stretch of some 40 texts at most, so that it doesn't outweigh the others.
            at, n = rng.randrange(max(1, len(main) - 1)), rng.choice((1, 2, 5, 12, 40))
            page = blocks(dressed(rng, main[at : at + n], prose))
            labels.append(np.array([b.text.startswith(MARK) for b in page], np.float64))
            for b in page:
                b.text = b.text.removeprefix(MARK) or "-"
            out.append(page)
    return out, labels


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """A labeller from the `sample` pages of least hashed page_id; the only rows that come to the driver."""
    own = pages.where("html is not null").select("page_id", "html", F.xxhash64("page_id").alias("a"), F.xxhash64("html").alias("b"))
    # The sample is chosen by keys alone, so that no task sends more pages than are asked for.
    chosen = own.select("a", "page_id", "b").orderBy("a", "page_id", "b").limit(sample).distinct().withColumnRenamed("page_id", "of")
    same = (own["a"] == chosen["a"]) & (own["b"] == chosen["b"]) & own["page_id"].eqNullSafe(chosen["of"])
    rows = own.join(F.broadcast(chosen), same).select("page_id", "html").distinct().orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).collect()
    return fit_blocks(*examples([r["html"] for r in rows]))


def main_texts(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page: its blocks labelled so, parted by an empty line."""
    read = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(read[i]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(read[order[to]]) <= CELLS:
            to += 1
        chosen, at = order[at:to], to
        p, n = model.chances(Encoded([read[i] for i in chosen])), 0
        for i in chosen:
            own = read[i]
            out[i] = "\n\n".join(b.text for b, x in zip(own, p[n : n + len(own)], strict=True) if x >= 0.5)
            n += len(own)
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    # Fixed size: the tables of marks and words and two small cells, half a megabyte.
    sent = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.weights.items()})

    def each(batch: pa.RecordBatch):
        own = Labeller({k: v.astype(np.float64) for k, v in sent.value.items()})
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = main_texts(own, [h or "" for h in part.column("html").to_pylist()])
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return map_arrow(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), each, f"page_id {kind}, url string, text string, n_chars long")
