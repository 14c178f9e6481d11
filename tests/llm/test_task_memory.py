"""What a worker keeps within and after a task."""

import random
import tracemalloc
import weakref

import pyarrow as pa
import pytest

from lexloom.llm import _common, jaccard_join, packing, suffix_dedup, toxicity
from lexloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


class Frame:
    """Gives the function of a task's batches."""

    def mapInArrow(self, run, schema):
        return run


def test_table_of_words_is_bounded_within_a_long_text(monkeypatch):
    whole = packing.encoder(PATH)
    text = "a" + "".join(f" w{i} same  x" for i in range(3000))
    for name, most in (("CACHED", 50), ("CACHED_BYTES", 400)):
        with monkeypatch.context() as m:
            m.setattr(packing, name, most)
            m.setattr(packing, "AT_ONCE", 16, raising=False)
            tool = packing.Encoder(PATH)
            assert tool.encode(text) == whole.encode(text) == whole._raw(text)
            assert len(tool.led) <= 50 + 16


def test_table_of_words_is_small():
    tool = packing.Encoder(PATH)
    for at in range(0, 300_000, 1000):
        tool.encode("a" + "".join(f" {at + i}" for i in range(1000)))
    assert len(tool.led) <= 110_000


def test_batches_are_let_go_before_memory_is_given_back(monkeypatch):
    seen, given = [], []
    monkeypatch.setattr(_common, "trim", lambda: seen.append([ref() is None for ref in given]))

    def each(batch):
        yield pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([["a"], None])], names=["x", "y"])

    run = _common.map_arrow(Frame(), each, "x long, y array<string>")
    total = 0

    def source():
        for _ in range(2):
            batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
            given.append(weakref.ref(batch))
            yield batch

    for out in run(source()):  # as the writer does, `out` holds a batch until the next
        total += out.num_rows
        if out.num_rows:
            given.append(weakref.ref(out))
    assert total == 4 and len(given) == 4
    assert seen == [[True] * 4]


@pytest.mark.parametrize("held", [True, False])
def test_modules_hold_only_what_a_step_uses(held):
    def each(batch):
        yield pa.RecordBatch.from_arrays([pa.array([len(_common.HELD["another"]) + len(_common.HELD[__name__])])], names=["n"])

    each.__module__ = __name__
    try:
        _common.HELD["another"], _common.HELD[__name__] = {1: 1}, {2: 2}
        run = _common.map_arrow(Frame(), each, "n long", held=held)
        batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["x"])
        assert [out.column(0)[0].as_py() for out in run(iter([batch])) if out.num_rows] == [int(held)]
    finally:
        _common.HELD.pop("another"), _common.HELD.pop(__name__)


def test_working_memory_over_a_batch_of_texts():
    """Texts of a batch are worked on in pieces; several workers of an executor do so at once."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    texts = pa.array([" ".join(rng.choices(words, k=500)) for _ in range(1000)])
    steps = {
        "runs": lambda: suffix_dedup.runs(*_common.text_buffers(texts), (400, 200)),
        "sets": lambda: jaccard_join.shingle_sets(texts, 5),
        "features": lambda: toxicity._blocks(texts),
    }
    for name, step in steps.items():
        tracemalloc.start()
        try:
            for _ in step():
                pass
            peak = tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()
        assert peak < 45, (name, peak)
