"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Segmentation maximises the sum of piece scores (the unigram decoder) over the vocabulary of a model
file; characters that no piece covers become byte pieces (or the unknown id, without byte fallback)
at the unigram penalty of 10 below the least score.  Spaces are marks (U+2581), one is led in, and
a text is parted into marked words - a run of marks and what follows - since no piece holds a mark
after another character.  The distinct marked words of a batch of texts are sorted and walked as
a trie, depth first: best scores up to the prefix shared with the word before are reused, only
the rest is scored.  Ids of words are kept in a bounded table.

Sums start at each marked word and are exact in double precision; of equal sums the one whose last
piece is longest stands.  (A library that adds 32-bit floats along a whole text rounds differently
after pieces of very low score, such as a lone mark.)  Null text gives null ids; empty
text gives none; repeated rows encode alike; any length is encoded whole; empty tables give no
rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm._common import HELD, list_array, map_arrow

MARK, CACHED, STEP, LEARNT = "▁", 500_000, 256, 300_000


class Pieces:
    """The pieces of a model file, and encoding and decoding by them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(count)]
        self.bytes_of, self.ids, scores = {}, {}, []
        self.unknown = model.unk_id()
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes_of[i] = int(name[3:5], 16)
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.ids[name] = (i, model.get_score(i))
                scores.append(model.get_score(i))
        self.byte_ids = {b: i for i, b in self.bytes_of.items()}
        self.names = names
        self.silent = {i for i in range(count) if model.is_control(i)}
        self.plain = np.ones(count, bool)  # ids whose piece is their text
        self.plain[[*self.bytes_of, *self.silent, self.unknown]] = False
        self.unknown_score = min(scores) - 10.0
        self._automaton()
        inner = [n for n in self.ids if MARK in n.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces with an inner mark can't be parted into words: {inner[:3]}")
        self.cache: dict[str, bytes] = {}

    def _automaton(self) -> None:
        """A trie of the pieces with failure links; `ends` lists what ends at a state, longest first.

        Each entry is (length, score, id).  Where no piece of one character ends, the character itself
        stands as unknown.
        """
        self.goto, self.fail, own = [{}], [0], [None]
        for name, (number, score) in self.ids.items():
            state = 0
            for c in name:
                after = self.goto[state].get(c)
                if after is None:
                    after = self.goto[state][c] = len(self.goto)
                    self.goto.append({})
                    self.fail.append(0)
                    own.append(None)
                state = after
            own[state] = (len(name), score, number)
        unknown = (1, self.unknown_score, self.unknown)
        self.ends = [(unknown,)] * len(self.goto)
        queue = list(self.goto[0].values())
        for state in queue:
            rest = self.ends[self.fail[state]]
            if own[state] is not None:
                rest = (own[state],) if own[state][0] == 1 else (own[state], *rest)
            self.ends[state] = rest
            for c, after in self.goto[state].items():
                back = self.fail[state]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                below = self.goto[back].get(c, 0)
                self.fail[after] = below if below != after else 0
                queue.append(after)
        self.learnt = 0

    def _step(self, state: int, c: str) -> int:
        """The state after a character that has no edge at this one; the first LEARNT such steps are kept."""
        at = state
        while at and c not in self.goto[at]:
            at = self.fail[at]
        after = self.goto[at].get(c, 0)
        if self.learnt < LEARNT:
            self.goto[state][c] = after
            self.learnt += 1
        return after

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct marked words as 32-bit bytes, by one depth-first walk over them in sorted order."""
        goto, ends = self.goto, self.ends
        out: dict[str, bytes] = {}
        # By depth: the automaton's state, the best sum, the piece that ends there; deeper entries are stale.
        longest = max(map(len, words), default=0)
        states, best, back = [0] * (longest + 1), [0.0] * (longest + 1), [(0, 0.0, 0)] * (longest + 1)
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            state, depth = states[shared], shared
            for c in word[shared:]:
                after = goto[state].get(c)
                state = self._step(state, c) if after is None else after
                depth += 1
                # Longer pieces, that is earlier starts, first: only a greater sum replaces one.
                options = ends[state]
                arrow = options[0]
                top = best[depth - arrow[0]] + arrow[1]
                for entry in options[1:]:
                    total = best[depth - entry[0]] + entry[1]
                    if total > top:
                        top, arrow = total, entry
                states[depth], best[depth], back[depth] = state, top, arrow
            path, at = [], len(word)
            while at:
                length, _, number = back[at]
                if number == self.unknown:
                    raw = word[at - length : at].encode("utf-8", "surrogatepass")
                    path += [self.byte_ids[b] for b in reversed(raw)] if self.byte_ids else [number]
                else:
                    path.append(number)
                at -= length
            path.reverse()
            out[word] = array("i", path).tobytes()
            before = word
        return out

    @staticmethod
    def marked(text: str) -> list[str]:
        """The marked words of a text, laid end to end the marked text."""
        if not text:
            return []
        parts = text.replace(" ", MARK).split(MARK)
        # An empty part is a mark with nothing after it; it leads the next word.
        words, lead = [], ""
        for part in parts:
            lead += MARK
            if part:
                words.append(lead + part)
                lead = ""
        if lead:
            words.append(lead)
        return words

    @classmethod
    def led(cls, text: str) -> list[str]:
        """The marked words without their first mark, which all of them have."""
        parts = text.split(" ")
        if "" in parts or MARK in text:
            return [word[1:] for word in cls.marked(text)]
        return parts

    def encode_batch(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of each text as 32-bit bytes."""
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        parted = [None if t is None else self.led(t) for t in texts]
        fresh = set().union(*(words for words in parted if words)) - cache.keys()
        cache.update((word[1:], ids) for word, ids in self.segment([MARK + w for w in fresh]).items())
        return [None if words is None else b"".join(map(cache.__getitem__, words)) for words in parted]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8, wrong bytes as U+FFFD each."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.silent:
                continue
            out.append(" ⁇ " if i == self.unknown else self.names[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_batch(self, column: pa.Array) -> list[str | None]:
        """Texts of a column of id lists; texts without byte pieces are joined at once."""
        flat, out, at = column.flatten().to_numpy(zero_copy_only=False), [], 0
        odd = np.concatenate(([0], np.cumsum(~self.plain[flat])))
        names = self.names
        for n in column.value_lengths().to_pylist():
            if n is None:
                out.append(None)
                continue
            ids = flat[at : at + n].tolist()
            if odd[at + n] == odd[at]:
                text = "".join(map(names.__getitem__, ids)).replace(MARK, " ")
                out.append(text[1:] if text.startswith(" ") else text)
            else:
                out.append(self.decode(ids))
            at += n
        return out


_loaded: dict[str, Pieces] = HELD.setdefault(__name__, {})


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids of every row."""

    def each(batch):
        tool = pieces(model)
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            got = tool.encode_batch(part.column("text").to_pylist())
            lengths = np.array([0 if x is None else len(x) // 4 for x in got])
            ids = list_array(np.frombuffer(b"".join(x for x in got if x), np.int32), lengths, pa.int32())
            ids = pc.if_else(pa.array([x is not None for x in got]), ids, pa.scalar(None, ids.type))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), ids], names=["doc_id", "text", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, each, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The columns of `encode` and the decoded text."""

    def each(batch):
        tool = pieces(model)
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            texts = tool.decode_batch(part.column("ids"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return map_arrow(encoded, each, "doc_id long, text string, ids array<int>, decoded string")


