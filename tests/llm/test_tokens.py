import json
import unicodedata

import numpy as np
import pytest

from lexloom.llm import piece_viterbi, wordpiece_counts
from lexloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tool():
    return piece_viterbi.pieces(tokenizer_path("piece_bpe_32k.model"))


def brute_score(tool, word):
    best, longest = [0.0], max(map(len, tool.ids))
    for end in range(1, len(word) + 1):
        options = [best[s] + tool.ids[word[s:end]][1] for s in range(max(0, end - longest), end) if word[s:end] in tool.ids]
        if word[end - 1] not in tool.ids:
            options.append(best[end - 1] + tool.unknown_score)
        best.append(max(options))
    return best[-1]


def test_viterbi(docs, rows, tool):
    path = tokenizer_path("piece_bpe_32k.model")
    got = piece_viterbi.decode(piece_viterbi.encode(docs, path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.ids is None) == (r.text is None)
        assert r.decoded == r.text
    scores = {i: s for i, s in tool.ids.values()}
    words = {w for _, t, *_ in rows if t for w in tool.marked(t)}
    for word, raw in tool.segment(list(words)).items():
        ids = np.frombuffer(raw, np.int32).tolist()
        unknown, spelled = 0, []
        for i in ids:
            spelled.append(tool.bytes_of[i] if i in tool.bytes_of else tool.names[i])
        unknown = sum(c not in tool.ids for c in word)
        total = sum(scores[i] for i in ids if i not in tool.bytes_of) + unknown * tool.unknown_score
        assert total == pytest.approx(brute_score(tool, word))


def test_marked(tool):
    for text in ("", " ", "a", " a  b ", "a\n b", "▁x y"):
        assert "".join(tool.marked(text)) == ("▁" + text.replace(" ", "▁") if text else "")


def test_counts(docs, rows):
    path = tokenizer_path("word_bpe_49k.json")
    counter = wordpiece_counts.counter(path)
    with open(path, encoding="utf-8") as f:
        vocabulary = {t.replace("</w>", "\0") for t in json.load(f)["model"]["vocab"] if not t.startswith("<|")}

    def greedy(word):
        n = 0
        while word and word != "\0":
            size = next(k for k in range(min(len(word), 60), 0, -1) if word[:k] in vocabulary)
            word, n = word[size:], n + 1
        return n

    def whole(text):
        words = wordpiece_counts.PATTERN.findall(unicodedata.normalize("NFC", text or "").lower())
        return len(words), sum(greedy(w.encode().decode("latin-1").translate(counter.names) + "\0") for w in words)

    want = sorted(((r[0], *whole(r[1])) for r in rows), key=repr)
    assert sorted(map(tuple, wordpiece_counts.count_tokens(docs, path).collect()), key=repr) == want


def test_empty(empty):
    assert piece_viterbi.encode(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0
    assert wordpiece_counts.count_tokens(empty, tokenizer_path("word_bpe_49k.json")).count() == 0
