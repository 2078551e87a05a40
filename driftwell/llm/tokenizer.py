"""Encoding by a byte-level BPE vocabulary (problem 8) through a tokenization automaton.

The automaton reads token labels and accepts just the token sequences that the merges yield.  It starts with one state
that allows every byte.  A merge (u, v) -> w adds its gadget: what may follow u and had an arc v gets, from every state with
an arc u, an arc w to where v led; then u's state loses its arc v.  Each arc's target depends on its label alone, so a state
is named by the token read last, and the arcs are kept in factored form: whether an arc x -> t was there when a given
merge came follows from the two tokens' own merges, and is tabled once it has been asked for.

Every prefix of a word has exactly one accepted spelling.  Encoding therefore runs left to right: the state at a byte
position is the one token that ends there and that the state at its start allows.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are, unless a path is given.
FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Fixed value: the published split pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encoding a worker keeps.
KEPT = 1 << 18
#: Arcs whose presence is tabled.
ARCS = 1 << 22


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """A tokenization automaton compiled from a ranked list of merges over byte tokens.

    Two tables drive it.  The reading table has a row for each beginning of a token and tells by the next byte which row follows
    and which token, if any, ends there; only tokens that are the accepted spelling of their own text are in it.  The arc
    table tells whether a state has an arc; its places are numbers, filled from the gadgets when they are first read.
    """

    def __init__(self, ids: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: t for t, i in ids.items()}
        size = max(self.label, default=-1) + 1
        # when a token's merge came (bytes before all), and its two parts
        self.time, self.left, self.right = [-2] * size, [-1] * size, [-1] * size
        for t, i in ids.items():
            if len(t) == 1:
                self.time[i] = -1
        self.size = size
        self.cut: dict[int, int] = {}
        for time, (u, v) in enumerate(merges):
            w, a, b = ids[u + v], ids[u], ids[v]
            self.cut.setdefault(a * size + b, time)
            if self.time[w] == -2:
                self.time[w], self.left[w], self.right[w] = time, a, b
        self.arcs: dict[int, bool] = {}
        self.rows: list[dict[int, int]] = [{}]  # reading table: byte -> row
        self.ends: list[int] = [-1]  # the token that ends at a row
        whole: dict[int, bool] = {}
        for i in sorted((i for i in self.label if self.time[i] > -2), key=lambda i: self.time[i]):  # parts come before the whole
            a, b = self.left[i], self.right[i]
            whole[i] = self.time[i] < 0 or (whole[a] and whole[b] and self._arc(a, b, self.time[i]))
            if whole[i]:
                row = 0
                for c in self.label[i]:
                    nxt = self.rows[row].get(c)
                    if nxt is None:
                        nxt = self.rows[row][c] = len(self.rows)
                        self.rows.append({})
                        self.ends.append(-1)
                    row = nxt
                self.ends[row] = i

    def _arc(self, x: int, t: int, before: int) -> bool:
        """Whether state x has an arc t before the merge of time ``before`` came.

        Where both tokens are merged ones, x's state copies that of its right part, made when x came, and the arc t that of its
        left part, made when t came (of u u u the first two merge); the later of the two is undone until bytes are left.
        """
        time, left, right, cut, size = self.time, self.left, self.right, self.cut, self.size
        while True:
            at = cut.get(x * size + t)
            if at is not None and at < before:
                return False
            a, b = time[x], time[t]
            if a < 0 and b < 0:
                return True
            if a > b:
                x, before = right[x], a
            elif b > a:
                t, before = left[t], b + 1
            else:  # x is t: its state copies its right part's, and the new arc there came of the arc of its left part
                x, t, before = right[x], left[t], a

    def allowed(self, x: int, t: int) -> bool:
        """Whether state x has an arc t in the end."""
        key = x * self.size + t
        got = self.arcs.get(key)
        if got is None:
            if len(self.arcs) > ARCS:
                self.arcs.clear()
            got = self.arcs[key] = self._arc(x, t, 1 << 60)
        return got

    def encode(self, word: bytes) -> list[int]:
        """The labels of the accepted path that spells ``word``."""
        n, rows, ends, arcs, size = len(word), self.rows, self.ends, self.arcs, self.size
        last, start = [-1] * (n + 1), [-1] * (n + 1)
        start[0] = 0
        for i in range(n):
            if start[i] < 0:
                continue
            state, row = last[i], 0
            for j in range(i, n):
                row = rows[row].get(word[j], -1)
                if row < 0:
                    break
                t = ends[row]
                if t >= 0 and start[j + 1] < 0:
                    ok = state < 0 or arcs.get(state * size + t)
                    if ok or ok is None and self.allowed(state, t):
                        last[j + 1], start[j + 1] = t, i
        if start[n] < 0:
            raise ValueError(f"no accepted spelling of {word!r}")
        path, at = [], n
        while at:
            path.append(last[at])
            at = start[at]
        return path[::-1]

    def decode(self, path: list[int]) -> bytes:
        """The text along a path: its arcs' labels."""
        return b"".join(self.label[t] for t in path)


class Tokenizer:
    """Splits a text into words and encodes each by the automaton."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        byte = _alphabet()
        raw = lambda s: bytes(byte[c] for c in s)
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(ids, [(raw(a), raw(b)) for a, b in merges])
        self.split = regex.compile(PATTERN)
        self.words: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for a null or empty one.  Lone surrogates are replaced as in UTF-8 with 'replace'."""
        if not text:
            return []
        out: list[int] = []
        words, encode = self.words, self.automaton.encode
        for w in self.split.findall(text):
            got = words.get(w)
            if got is None:
                got = encode(w.encode("utf-8", "replace"))
                if len(w) <= 64:
                    if len(words) >= KEPT:
                        words.clear()
                    words[w] = got
            out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        return self.automaton.decode(ids).decode("utf-8", "replace")


_held: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a vocabulary file, compiled once in a process."""
    if path not in _held:
        _held[path] = Tokenizer(path)
    return _held[path]


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids): the token ids of every row, without special tokens.

    Null and empty texts give an empty list.  Strings of special tokens in a text are ordinary text.  Rows are kept as they
    are: repeated or null keys stay.  An empty table gives an empty result; other columns are dropped.  The vocabulary file
    must be at ``folder`` on every executor.
    """
    path = f"{folder}/{vocabulary}.json"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": [own.encode(t) for t in pdf["_text"]]})

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInPandas(run, f"`{key}` {kind}, ids array<int>")
