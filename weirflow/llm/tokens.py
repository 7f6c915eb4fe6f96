"""Token ids of a public byte-level BPE tokenizer, in time linear in the text.

The vocabulary's byte strings, mapped to Latin-1, form one automaton that finds all tokens in a piece of text. From the longest match at
each place the encoder goes on as long as adjacent tokens are compatible, that is, as long as merging would leave the two apart; else it falls back to the
next shorter token or steps back. Compatibility is memoised per pair, encodings per piece. The result is that of the merges, exactly.

Defined cases: null and empty texts have no ids (an empty list). Texts that contain a special token's string are ordinary text. Long texts and pieces are encoded whole.
"""

from __future__ import annotations

import json
import os
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; they are read, never copied.
VOCABULARY_DIR = os.environ.get("WEIRFLOW_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k.json"

#: Fixed value: how byte-level BPE splits text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces kept per worker; when full, the memory starts anew, which changes no result.
MEMORY = 400_000


@cache
def _printable() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """An exact encoder of one vocabulary (the text of its JSON file)."""

    def __init__(self, source: str) -> None:
        import ahocorasick
        import regex

        model = json.loads(source)["model"]
        letters = _printable()
        latin = lambda written: "".join(chr(letters[c]) for c in written)
        self.ids = {latin(w): i for w, i in model["vocab"].items() if all(c in letters for c in w)}
        self.lengths = {i: len(t) for t, i in self.ids.items()}
        self.halves = {i: (i, i) for t, i in self.ids.items() if len(t) == 1}
        self.merged: dict[tuple[int, int], int] = {}
        youngest = -1
        for pair in model["merges"]:
            a, b = map(latin, pair.split(" ") if isinstance(pair, str) else pair)
            whole = self.ids[a + b]
            if whole not in self.halves:
                if whole < youngest:
                    raise ValueError("this encoder takes ids for the ranks of merges, and the vocabulary's ids aren't in the order of its merges")
                youngest = whole
                self.halves[whole] = (self.ids[a], self.ids[b])
                self.merged[self.ids[a], self.ids[b]] = whole
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.texts = {i: t for t, i in self.ids.items()}
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of token."""
        if token not in self.shorter:
            t = self.texts[token]
            self.shorter[token] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), None)
        return self.shorter[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b apart when their texts are adjacent."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the younger of the two tokens again and again: a merge across the border that is older than those undone would have come first.
        before = 1 << 62
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            for left in (True, False) if a > b else (False, True):
                if left:
                    before, a = a, self.halves[a][1]
                    undone = a != before
                else:
                    old, b = b, self.halves[b][0]
                    before, undone = old + 1, b != old
                if undone:
                    break
            else:
                return True

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece, given in Latin-1 letters for its bytes."""
        n = len(text)
        whole = self.ids.get(text)
        if n == 1:
            return (whole,)
        longest = [0] * n
        size = [0] * n
        lengths = self.lengths
        for end, token in self.automaton.iter(text):
            length = lengths[token]
            if length > size[end + 1 - length]:
                size[end + 1 - length], longest[end + 1 - length] = length, token
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + lengths[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, token = end, longest[end]
                continue
            short = self._shorter(token)
            while short is None:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                short = self._shorter(token) if not alive[at + lengths[token]] else token
            token = short

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for p in self.pieces.findall(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = self.piece(p.encode("utf-8").decode("latin-1"))
                if len(p) <= 64:
                    known[p] = ids
            out += ids
        return out


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one per process."""
    with open(path, encoding="utf-8") as f:
        return Encoder(f.read())


def vocabulary(name: str = DEFAULT, folder: str | None = None) -> str:
    return os.path.join(folder or VOCABULARY_DIR, name)


def token_ids(text: Column, path: str | None = None) -> Column:
    """array<int> of a text's ids. Every worker reads the vocabulary file itself."""
    path = path or vocabulary()

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([e.encode(t) for t in texts], dtype=object)

    return run(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of a text's ids; 0 for null and empty texts."""
    path = path or vocabulary()

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([len(e.encode(t)) for t in texts], dtype="int32")

    return run(text)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches small enough for long texts beside their ids; set by the queries that send whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
