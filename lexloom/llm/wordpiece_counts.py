"""Token counts by a linear longest-match automaton.

Greedy word pieces: of what is left of a word, the longest token of the vocabulary is taken, again
and again.  The automaton counts them without building any: its states are the prefixes of tokens;
a state's failure link leads to the prefix that is left once the longest tokens at its front have
been popped, and the number popped is stored with the link.  A character follows a trie edge or else
failure links, adding their counts, so a word takes time in proportion to its length.  Every byte is
a token, so no word is without pieces.

The vocabulary marks word ends (`</w>`): a word is its characters and an end symbol, so a token
that ends words matches only there.  Words are parted by the vocabulary's public pattern after lower
casing.  Counts of distinct space-parted strings are kept in a bounded table; whole texts are
counted.  Null or empty text: 0 words, 0 tokens.  Repeated rows count alike; empty tables give no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import HELD, map_arrow

CACHED, END, MARK = 500_000, "\0", "</w>"
#: Fixed value: the public word pattern of the vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    names = {b: chr(b) for b in plain}
    names |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in names)}
    return names


class Automaton:
    """Trie of tokens with failure links and popped-token counts."""

    def __init__(self, tokens: list[str]):
        self.next: list[dict[str, int]] = [{}]
        final, parent, letter = [False], [0], [""]
        for token in tokens:
            at = 0
            for c in token:
                to = self.next[at].get(c)
                if to is None:
                    to = len(self.next)
                    self.next[at][c] = to
                    self.next.append({})
                    final.append(False)
                    parent.append(at)
                    letter.append(c)
                at = to
            final[at] = True
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [0]
        while level:
            below = [v for u in level for v in self.next[u].values()]
            for v in below:
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                # What the parent leaves after popping, led on by this letter.
                at, count, c = self.fail[parent[v]], self.popped[parent[v]], letter[v]
                while at >= 0 and c not in self.next[at]:
                    count += self.popped[at]
                    at = self.fail[at]
                if at < 0:
                    raise ValueError("every character of a token must be a token")
                self.fail[v], self.popped[v] = self.next[at][c], count
            level = below

    def count(self, word: str) -> int:
        """Greedy pieces of a word and its end symbol; the symbol alone, left over, is none."""
        following, fail, popped = self.next, self.fail, self.popped
        at, total = 0, 0
        for c in word:
            to = following[at].get(c)
            while to is None and at:
                total += popped[at]
                at = fail[at]
                to = following[at].get(c)
            if to is None:
                total += c != END
            else:
                at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total


class Counter:
    """Counts of the words and tokens of texts, by a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        tokens = [t[: -len(MARK)] + END if t.endswith(MARK) else t for t in vocabulary if not t.startswith("<|")]
        names = byte_names()
        known = set(tokens)
        self.automaton = Automaton(tokens + [n + e for n in names.values() for e in ("", END) if n + e not in known])
        self.names = str.maketrans({chr(b): n for b, n in names.items()})
        self.cache: dict[str, tuple[int, int]] = {}

    def string(self, text: str) -> tuple[int, int]:
        words = PATTERN.findall(text)
        spelled = (w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.names) + END for w in words)
        return len(words), sum(map(self.automaton.count, spelled))

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cache = self.cache
        words, tokens = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = unicodedata.normalize("NFC", text).lower().split()
            if len(cache) > CACHED:
                cache.clear()
            for p in set(parts):
                if p not in cache:
                    cache[p] = self.string(p)
            got = [cache[p] for p in parts]
            words[i], tokens[i] = sum(g[0] for g in got), sum(g[1] for g in got)
        return words, tokens


_loaded: dict[str, Counter] = HELD.setdefault(__name__, {})


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every row."""

    def each(batch):
        words, tokens = counter(vocabulary).counts(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, each, "doc_id long, n_words long, n_tokens long")
