"""Evaluation texts that leaked into documents (problem 9).

One Aho-Corasick automaton holds every run of a few words of the evaluation texts, normalised to bare letters and digits.
A document is scanned once in the same form; each hit has an offset in the original text.  Hits of one item that lie in
one line of agreement (their distance in the item is about that in the document) form a passage, whose words are counted.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.llm.common import spread

#: Words in a pattern, and letters in it at least (shorter ones take more words).
RUN, LETTERS = 3, 12
#: Characters of evaluation texts that one automaton is built from, and that one pass over the documents looks for.
AUTOMATON, PASS = 2_000_000, 64_000_000
#: Characters of documents that a task holds while it goes through several automata.
HELD = 16_000_000
#: Share of a passage's words that hits must cover.
DENSE = 0.7
#: Letters by which two hits of a passage may lie further apart in the document than in the item, and half of their distance at most.
SLACK = 40
#: Words of the item that may lie between two hits of a passage.
GAP = 6
#: Items that a phrase may be in before it counts as shared by many.
COMMON = 6

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*+>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|\[/?\w{1,12}\]")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"[<&\[]")


def _plain(text: str) -> str:
    """``text`` with tags and entities blanked, each place as it was."""
    return _TAG.sub(lambda m: " " * len(m.group()), text) if _MARK.search(text) else text


@lru_cache(1 << 16)
def _letters(word: str) -> str:
    """The folded letters and digits of a word."""
    return "".join(f for c in word for f in _folded(c))


def _folded(c: str) -> str:
    return c.lower() if c.isascii() else "".join(f for f in unicodedata.normalize("NFKD", c).casefold() if f.isalnum())


def bare(text: str) -> tuple[str, list[int]]:
    """(letters, starts): the letters and digits of a text, folded, and where its words start in them.

    Tags, entities, marks, spaces and invisible characters leave no trace, so that a word cut by one of them is whole again.
    """
    clean = _plain(text)
    words = _WORD.findall(clean.lower() if clean.isascii() else clean)
    if not clean.isascii():
        words = [w.lower() if w.isascii() else _letters(w) for w in words]
    ends = list(accumulate(map(len, words)))
    return "".join(words), [0, *ends[:-1]] if ends else []


def place(text: str, starts: list[int], at: int) -> int:
    """Where in ``text`` the letter number ``at`` of its bare form stands."""
    k = bisect.bisect_right(starts, at) - 1
    m = next(islice(_WORD.finditer(_plain(text)), k, None))
    rest = at - starts[k]
    for i, c in enumerate(m.group()):
        rest -= len(_folded(c))
        if rest < 0:
            return m.start() + i
    return m.end() - 1


class Scanner:
    """The automaton over the evaluation items and the passages that its hits make."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, letters: int = LETTERS):
        found: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        self.words: dict[int, list[int]] = {}
        self.spelt: dict[int, list[str]] = {}
        for k, (_, text) in enumerate(items):
            s, starts = bare(text)
            ends = [*starts[1:], len(s)] if starts else []
            self.words[k], self.spelt[k] = starts, [s[a:b] for a, b in zip(starts, ends, strict=True)]
            for i in range(len(starts)):
                j = i + run - 1
                while j < len(starts) and ends[j] - starts[i] < letters:
                    j += 1
                if j < len(starts):
                    found[s[starts[i] : ends[j]]].append((k, i, j + 1))
        self.items = [i for i, _ in items]
        self.automaton = ahocorasick.Automaton()
        for p, v in found.items():
            common = None
            if len(v) > COMMON:
                common = defaultdict(list)
                for k, i, j in v:
                    common[k].append((i, j))
            self.automaton.add_word(p, (len(p), v, common))
        self.size = len(found)
        if found:
            self.automaton.make_automaton()

    def scan(self, text: str, least: int) -> list[tuple[int, int, int, int]]:
        """(item, words, start, end) of the best passage of each item with ``least`` words or more; offsets are the original's."""
        if not self.size:
            return []
        s, starts = bare(text)
        hits: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        shared: list[tuple[int, int, list, dict]] = []
        for end, (n, where, common) in self.automaton.iter(s):
            if common is None:
                for k, i, j in where:
                    hits[k].append((end + 1 - n, end + 1, i, j))
            else:
                shared.append((end + 1 - n, end + 1, where, common))
        # phrases that many items share count for the items that other hits point to, and for all of theirs where they come so
        # close together that they could be a passage on their own; others can't be one, as hits must cover half of its words
        sure = list(hits)
        lo = 0
        for hi in range(1, len(shared) + 1):
            if hi < len(shared) and shared[hi][0] - shared[hi - 1][1] <= 2 * SLACK:
                continue
            alone = sum(where[0][2] - where[0][1] for _, _, where, _ in shared[lo:hi]) >= least // 2
            for a, b, where, common in shared[lo:hi]:
                if alone:
                    for k, i, j in where:
                        hits[k].append((a, b, i, j))
                else:
                    for k in sure:
                        for i, j in common.get(k, ()):
                            hits[k].append((a, b, i, j))
            lo = hi
        out = []
        for k, own in hits.items():
            if sum(j - i for _, _, i, j in own) < least // 2:
                continue
            best = self._grown(k, self._passage(k, own, least // 2), s, starts)
            if best[0] >= least:
                out.append((self.items[k], best[0], place(text, starts, best[1]), place(text, starts, best[2] - 1) + 1))
        return out

    def _passage(self, k: int, hits: list[tuple[int, int, int, int]], floor: int = 1) -> list:
        """[first word, word after the last, start, end, words covered] of the longest dense passage; 0 covered if there is none.

        Hits chain where both places move on and the gap between them is of a few words and alike on both sides.  Chains stand
        under the item word that they expect next, so that a hit looks at those that it can go on, however many there are; one
        that ended too far back in the document is taken out.  Hits must cover DENSE of a passage and ``floor`` words.
        """
        starts = self.words[k]
        open_: dict[int, list[list]] = {}
        chains: list[list] = []  # [first word, word after the last, start, end, words that hits cover, hits]
        for a, b, i, j in sorted(hits):
            best = None
            for e in range(max(0, i - GAP), j):
                row = open_.get(e)
                if not row:
                    continue
                if a - row[0][3] > 2 * SLACK:
                    row[:] = [c for c in row if a - c[3] <= 2 * SLACK]
                meant = starts[i] - (starts[e] if e < len(starts) else starts[-1] + 8)
                for c in row:
                    if i >= c[0] and abs(a - c[3] - meant) <= SLACK and (best is None or c[4] > best[4]) and a - c[3] <= 2 * SLACK:
                        best = c
            if best is None:
                best = [i, j, a, b, j - i, [(a, b, i, j, j - i)]]
                chains.append(best)
            else:
                own = open_[best[1]]
                own.pop(next(n for n, c in enumerate(own) if c is best))
                new = j - max(i, best[1])
                best[4] += new
                best[1], best[3] = j, b
                best[5].append((a, b, i, j, new))
            open_.setdefault(j, []).append(best)
        top = [0, 0, 0, 0, 0]
        for c in chains:
            if c[4] >= floor and c[1] - c[0] > top[1] - top[0]:
                got = c[:5] if c[4] >= DENSE * (c[1] - c[0]) else self._dense(c[5])
                if got[4] >= floor and got[1] - got[0] > top[1] - top[0]:
                    top = got
        return top

    @staticmethod
    def _dense(hits: list[tuple[int, int, int, int, int]]) -> list:
        """The longest stretch of a chain's hits that cover DENSE of its words."""
        sums = [0, *accumulate(h[4] for h in hits)]
        low: list[tuple[float, int]] = []  # starts whose debt is below that of all earlier ones
        for p, (_, _, i, j, _) in enumerate(hits):
            debt = sums[p + 1] - (j - i) - DENSE * i
            if not low or debt < low[-1][0]:
                low.append((debt, p))
        best = [0, 0, 0, 0, 0]
        for q in range(len(hits) - 1, -1, -1):
            have = sums[q + 1] - DENSE * hits[q][3]
            while low and low[-1][1] > q:
                low.pop()
            while low and low[-1][0] <= have + 1e-9:
                p = low.pop()[1]
                (a, _, i, j, _), (_, b, _, end, _) = hits[p], hits[q]
                if end - i > best[1] - best[0]:
                    best = [i, end, a, b, sums[q + 1] - sums[p + 1] + j - i]
        return best

    def _grown(self, k: int, chain: list, s: str, starts: list[int]) -> tuple[int, int, int]:
        """(words, start, end) of a passage after both its ends have been followed word by word over single differences."""
        i, j, a, b, covered = chain
        if not covered:
            return 0, a, b
        words = self.spelt[k]

        def follow(n: int, p: int, sure: int) -> tuple[int, int]:
            """Word n of the item and place p of the document after the agreeing words from there on; ``sure`` words must agree."""
            m, q, ok = n, p, 0
            while m < len(words) and s.startswith(words[m], q):
                ok += len(words[m])
                q += len(words[m])
                m += 1
                if sure and (m - n >= sure or ok >= 5):
                    sure = 0
            return (n, p) if sure else (m, q)

        def back(n: int, p: int, sure: int) -> tuple[int, int]:
            m, q, ok = n, p, 0
            while m > 0 and s.endswith(words[m - 1], 0, q):
                ok += len(words[m - 1])
                q -= len(words[m - 1])
                m -= 1
                if sure and (n - m >= sure or ok >= 5):
                    sure = 0
            return (n, p) if sure else (m, q)

        j, b = follow(j, b, 0)
        i, a = back(i, a, 0)
        while True:  # a changed, an added, a lost word; each step moves on in the item
            at = bisect.bisect_right(starts, b)
            after = starts[at] if at < len(starts) else len(s)
            n, p = max(follow(j + 1, after, 2) if j < len(words) else (j, b), follow(j, after, 2), follow(j + 1, b, 2), key=lambda x: x[1])
            if p <= b or n <= j or (n == j + 1 and p == after):
                break
            j, b = n, p
        while True:
            at = bisect.bisect_left(starts, a) - 1
            before = starts[at] if at >= 0 else 0
            n, p = min(back(i - 1, before, 2) if i else (i, a), back(i, before, 2), back(i - 1, a, 2) if i else (i, a), key=lambda x: x[1])
            if p >= a or n >= i or (n == i - 1 and p == before):
                break
            i, a = n, p
        return j - i, a, b


_held: dict[str, Scanner] = {}


def _shards(items: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """``items`` in order, in lists of about AUTOMATON characters; an item is never cut."""
    out: list[list[tuple[int, str]]] = []
    size = AUTOMATON
    for k, t in items:
        if size + len(t) > AUTOMATON:
            out.append([])
            size = 0
        out[-1].append((k, t))
        size += len(t)
    return out


def leaks(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, least: int = 20) -> DataFrame:
    """(key, item, words, start, end): each document and evaluation item of which it holds a passage of ``least`` words or more.

    Letter case, punctuation, spacing, line breaks, marks and single changed, lost or added words don't matter; words counts
    the item's words from the passage's first to its last, and [start, end) is the passage in the original text.  Null and empty texts hold nothing; repeated rows give one row (the longest passage); null keys are
    left out.  Empty tables give an empty result.

    The documents are read once for PASS characters of items.  Up to AUTOMATON characters make one automaton, which a worker
    keeps; with more, a task holds about HELD characters of documents and goes through the automata one after another.
    """
    spark = docs.sparkSession
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item}` {items.schema[item].dataType.simpleString()}, words int, `start` int, `end` int"
    own = items.select(item, item_text).where(F.col(item).isNotNull() & F.col(item_text).isNotNull())
    size = own.agg(F.sum(F.length(item_text))).first()[0] or 0
    if not size:
        return spark.createDataFrame([], schema)
    passes = -(-size // PASS)
    read = spread(docs.select(key, F.col(text).alias("_text")).where(F.col(key).isNotNull() & (F.length("_text") > 0)))
    out = None
    for b in range(passes):
        part = own.where(F.pmod(F.xxhash64(item), F.lit(passes)) == b).orderBy(item, item_text).collect()  # about PASS characters
        sent = [spark.sparkContext.broadcast(x) for x in _shards([(r[0], r[1]) for r in part])]  # AUTOMATON characters each

        def run(batches: Iterator[pd.DataFrame], sent=sent, name=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            chars = 0

            def found(n: int) -> Iterator[pd.DataFrame]:
                if f"{name}/{n}" not in _held:  # one automaton at a time; a lone one is built once for each worker
                    _held.clear()
                    _held[f"{name}/{n}"] = Scanner(sent[n].value)
                scan = _held[f"{name}/{n}"].scan
                for pdf in held:
                    rows = [(k, *x) for k, t in zip(pdf[key], pdf["_text"], strict=True) for x in scan(t, least)]
                    yield pd.DataFrame(rows, columns=[key, item, "words", "start", "end"])

            for pdf in batches:
                held.append(pdf)
                chars += int(pdf["_text"].str.len().sum())
                if len(sent) > 1 and chars < HELD:
                    continue
                for n in range(len(sent)):
                    yield from found(n)
                held, chars = [], 0
            for n in range(len(sent) if held else 0):
                yield from found(n)

        got = read.mapInPandas(run, schema)
        out = got if out is None else out.unionByName(got)
    best = F.max(F.struct("words", (-F.col("start")).alias("s"), F.col("end").alias("e"))).alias("_b")
    return out.groupBy(key, item).agg(best).select(key, item, F.col("_b.words").alias("words"), (-F.col("_b.s")).alias("start"), F.col("_b.e").alias("end"))
