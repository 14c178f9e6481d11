import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from lexloom.llm import packing
from lexloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_encoder():
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    tool = packing.encoder(PATH)
    for text in ["", " ", "a", "a  b", "  a", "a   b \n c", "x  y  ", "it's  ok\n\n b", "\n a", "a \n", "<|endoftext|> x", "Ünï 漢字 🎉", "a  b", "\t\t x "]:
        assert tool.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_encoder_with_a_small_table(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 3)
    tool, whole = packing.Encoder(PATH), packing.encoder(PATH)
    for text in ["a b c d e f", "b c x y z", "a a a q r s t"]:
        assert tool.encode(text) == whole.encode(text)


def test_texts_of_new_words_are_encoded_whole(monkeypatch):
    """Words that a full table lacks aren't encoded one by one."""
    monkeypatch.setattr(packing, "CACHED", 500)
    rng = random.Random(7)
    texts = [" ".join(f"the {rng.randrange(10**6)}" for _ in range(100)) for _ in range(300)]
    tool, calls = packing.Encoder(PATH), []
    raw = tool._raw
    monkeypatch.setattr(tool, "_raw", lambda text: calls.append(1) or raw(text))
    assert [tool.encode(text) for text in texts] == list(map(raw, texts))
    assert len(calls) < 2000  # 30,000 words are new
    # Where texts repeat their words, the table is used again after a while.
    known = " ".join(["", *list(tool.led)[:400]])
    for _ in range(packing.RESTS):
        tool.encode(known)
    calls.clear()
    assert tool.encode(known) == raw(known)
    assert len(calls) == 1


def test_stretches(monkeypatch):
    """Long texts encoded whole are cut only where the tokenizer's pattern never matches across."""
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    monkeypatch.setattr(packing, "STRETCH", 3)
    rng, tool, most = random.Random(5), packing.Encoder(PATH), 0
    for _ in range(3000):
        text = "".join(rng.choice(["a", "B", "'s", "1", ".", " ", " ", "\n", "\t", "\x1c", "\x85", "\u3000", "é", "漢"]) for _ in range(rng.randrange(40)))
        tool.rests = 1
        assert tool.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
        most = max(most, len(list(packing.stretches(text))))
    assert most > 3
    assert list(packing.stretches("ab cd ef gh")) == ["ab cd", " ef", " gh"]


def test_added_tokens(spark):
    whole = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>  b", "a  <|endoftext|>\n<|endoftext|", " <|endoftext|> it's", "no token"]
    want = {}
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == want


def test_cut():
    assert packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut(2048) == [(0, 1024), (1024, 1024)]


def check(bins, lengths, size):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= size for b in bins)


def test_evolve():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 90) for _ in range(300)]
    first = packing.packed(lengths, sorted(range(300), key=lambda i: -lengths[i]), 100)
    people = packing.evolve(lengths, [], 1, 100)
    for p in people:
        check(p.bins, lengths, 100)
    assert len(people[0].bins) <= len(first.bins)
    child = packing.crossover(people[0], people[-1], rng)
    check(child.bins, lengths, 100)


def test_search_is_whole(monkeypatch):
    """Each generation's crossovers are made until the bound is reached, and the islands are three."""
    made = []
    one = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: made.append(1) or one(*a))
    packing.evolve([51] * 40, [], 1, 100)  # 40 bins against a bound of 21
    assert (len(made), packing.ISLANDS, packing.EPOCHS) == (18, 3, 2)


def test_search_beats_best_fit():
    """Triples that fill a bin exactly: best fit, longest first, pairs the wrong pieces; the search needs fewer bins."""
    for seed in range(4):
        rng = random.Random(seed)
        lengths = []
        for _ in range(40):
            a = rng.randrange(380, 490)
            b = rng.randrange(250, (1000 - a) // 2 + 1)
            lengths += [a, b, 1000 - a - b]
        first = packing.packed(lengths, sorted(range(len(lengths)), key=lambda i: -lengths[i]), 1000)
        best = min((packing.evolve(lengths, [], island, 1000)[0] for island in range(packing.ISLANDS)), key=lambda p: len(p.bins))
        check(best.bins, lengths, 1000)
        assert len(best.bins) < len(first.bins)


def test_pack(docs, rows):
    tool = packing.encoder(PATH)
    got = packing.pack(packing.pieces(docs, PATH)).collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = tool.encode(text or "") + np.array([2], "<u4").tobytes()
        for i, (start, length) in enumerate(packing.cut(len(ids) // 4)):
            want[doc, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 2


def test_emptiest_bins_of_all_blocks_are_packed_together(spark, monkeypatch):
    """Blocks that each round up are one sequence above the bound together, at most."""
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 60)
    rng = random.Random(12)
    lengths = [rng.randrange(1, 300) for _ in range(900)]
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long").repartition(3)
    bound = -(-sum(lengths) // 1024)
    got = packing.pack(items).collect()
    assert sorted((r["item"], r.length) for r in got) == list(enumerate(lengths))
    parts = {}
    for r in got:
        parts.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in parts.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(parts) <= bound + 1
    monkeypatch.setattr(packing, "repack", lambda best, size: spark.createDataFrame([], "_block long, moved array<int>, bins array<int>, offsets array<long>"))
    assert packing.pack(items).select("sequence_id").distinct().count() > bound + 3


def test_clashing_names(spark):
    rows = [(i, 300 + 40 * i, "kept", "goes", "goes", "a.b") for i in range(20)]
    items = spark.createDataFrame(rows, "_key int, length int, _block string, sequence_id string, Offset string, `x.y` string")
    out = packing.pack(items)
    assert out.columns == ["_key", "length", "_block", "x.y", "sequence_id", "offset"]
    got = out.collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted((r[0], r[1], r[2], r[5]) for r in rows)
    fill = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 or max(r[1] for r in rows) > 1024


def test_empty(empty):
    assert packing.pack(packing.pieces(empty, PATH)).count() == 0
