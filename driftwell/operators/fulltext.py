"""Keyword search: a web-style query language, matching and cover-density rank.

Queries: words are ANDed, "quoted words" must follow each other, OR separates alternatives, -word excludes.  Any text is a
query; one without words matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions import text as tx
from driftwell.functions import vectors as V


@dataclass(frozen=True)
class Term:
    lexeme: str


@dataclass(frozen=True)
class Phrase:
    """Lexemes with the distance of each from the first."""

    lexemes: tuple[str, ...]
    offsets: tuple[int, ...]


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def _simple(text: str) -> list[tuple[str, int]]:
    return [(w, i) for i, w in enumerate(tx.simple_words(text), 1)]


def analyse(text: str, analyser: str) -> list[tuple[str, int]]:
    """(lexeme, position) of a query's or a text's words by the named analyser."""
    return _simple(text) if analyser == "simple" else tx.english_positions(text)


def parse(query: str, analyser: str = "simple"):
    """The query's tree; None if it has no searchable word.  Never raises."""
    pieces = re.findall(r'(-?)"([^"]*)"?|(\S+)', query or "")
    groups: list[list] = [[]]
    for minus, quoted, word in pieces:
        if word and word.upper() == "OR" and word.isupper():
            groups.append([])
            continue
        negated = bool(minus) or word.startswith("-")
        body = quoted if not word else word.lstrip("-") if negated else word
        found = analyse(body.replace('"', " "), analyser)
        if not found:
            continue
        if len(found) == 1:
            node = Term(found[0][0])
        else:  # a quoted text, or one word that the analyser splits
            node = Phrase(tuple(a for a, _ in found), tuple(p - found[0][1] for _, p in found))
        groups[-1].append(Not(node) if negated else node)
    alternatives = [g[0] if len(g) == 1 else And(tuple(g)) for g in groups if g]
    if not alternatives:
        return None
    return alternatives[0] if len(alternatives) == 1 else Or(tuple(alternatives))


def lexemes(node) -> list[str]:
    """The lexemes of a tree that count for the rank (those under a Not don't), in order, without repeats."""
    if node is None or isinstance(node, Not):
        return []
    if isinstance(node, Term):
        return [node.lexeme]
    if isinstance(node, Phrase):
        return list(dict.fromkeys(node.lexemes))
    return list(dict.fromkeys(x for p in node.parts for x in lexemes(p)))


def matches(node, words: Column) -> Column:
    """Whether an array of words in order (``simple``) satisfies the tree."""
    if node is None:
        return F.lit(False)
    if isinstance(node, Term):
        return F.array_contains(words, node.lexeme)
    if isinstance(node, Not):
        return ~matches(node.part, words)
    if isinstance(node, Phrase):
        every = reduce(lambda a, b: a & b, [F.array_contains(words, x) for x in dict.fromkeys(node.lexemes)])
        starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
        runs = F.exists(starts, lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.try_element_at(words, i + o) == x, F.lit(False)) for x, o in zip(node.lexemes, node.offsets, strict=True)]))
        return every & runs
    parts = [matches(p, words) for p in node.parts]
    return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts)


def contains(node, words: Column) -> Column:
    """``matches`` with the words bound to a variable, so that a text is split once and not for each word or place."""
    return V.let(words, lambda w: matches(node, w))


def satisfied(node, at: dict[str, list[int]]) -> bool:
    """Whether the positions of a text's lexemes satisfy the tree."""
    if node is None:
        return False
    if isinstance(node, Term):
        return node.lexeme in at
    if isinstance(node, Not):
        return not satisfied(node.part, at)
    if isinstance(node, Phrase):
        rest = [(set(at.get(x, ())), o) for x, o in zip(node.lexemes, node.offsets, strict=True)]
        return any(all(p + o in own for own, o in rest) for p in at.get(node.lexemes[0], ()))
    own = (satisfied(p, at) for p in node.parts)
    return all(own) if isinstance(node, And) else any(own)


def cover_density(node, at: dict[str, list[int]], weight: float = 0.1) -> float:
    """Sum over the minimal covers of weight / (1 + noise): noise counts the words in a cover beyond those it needs.

    A cover is a stretch of the text that satisfies the query and holds no smaller one that does.
    """
    own = lexemes(node)
    if len(own) < 2:
        return weight * sum(len(at.get(x, ())) for x in own)
    marks = sorted(p for x in own for p in at.get(x, ()))
    place = {p: i for i, p in enumerate(marks)}
    latest = _latest(node, at)
    total, last = 0.0, float("-inf")
    for hi, end in enumerate(marks):
        start = latest(end)
        if start > last:  # a cover that no smaller one lies in
            total += weight / (1 + max(0, (end - start) - (hi - place[start])))
            last = start
    return total


def _latest(node, at: dict[str, list[int]]) -> Callable[[int], float]:
    """A function of growing places: the last one from which on the text up to there satisfies the tree (exclusions left aside)."""
    none = float("-inf")
    if isinstance(node, Term | Phrase):
        if isinstance(node, Term):
            runs = [(p, p) for p in at.get(node.lexeme, ())]
        else:
            rest = [(set(at.get(x, ())), o) for x, o in zip(node.lexemes, node.offsets, strict=True)]
            runs = [(p, p + node.offsets[-1]) for p in at.get(node.lexemes[0], ()) if all(p + o in own for own, o in rest)]
        runs.sort(key=lambda r: r[1])
        k = 0

        def leaf(end: int) -> float:
            nonlocal k
            while k < len(runs) and runs[k][1] <= end:
                k += 1
            return runs[k - 1][0] if k else none

        return leaf
    parts = [_latest(p, at) for p in node.parts if not isinstance(p, Not)]
    if isinstance(node, And):
        return lambda end: min((f(end) for f in parts), default=none)
    return lambda end: max((f(end) for f in parts), default=none)


def may_match(node, text: Column) -> Column:
    """Whether a text can match a tree of English stems, by the beginnings of its words; exclusions don't count."""
    if isinstance(node, Term):
        return tx.may_hold(node.lexeme, text)
    if isinstance(node, Phrase):
        return reduce(lambda a, b: a & b, [tx.may_hold(x, text) for x in node.lexemes])
    if isinstance(node, Not):
        return F.lit(True)
    parts = [may_match(p, text) for p in node.parts]
    return reduce((lambda a, b: a & b) if isinstance(node, And) else (lambda a, b: a | b), parts)


def rank_column(node, words: Column) -> Column | None:
    """The rank as a Column where it is one term's or two terms' (0.1 for each occurrence); None otherwise."""
    own = lexemes(node)
    if len(own) != 1:
        return None
    return F.lit(0.1) * F.size(F.filter(words, lambda w: w == own[0]))


def keyword_scores(rows: DataFrame, key: str, text: str, query: str, analyser: str = "simple") -> DataFrame:
    """(key, kw_score) of the rows whose text matches; null texts match nothing but a pure exclusion.

    One-term queries under ``simple`` stay in the JVM; the others rank in an Arrow batch, after a JVM match under ``simple`` and a
    JVM test for the beginnings of the words under ``english``.
    """
    node = parse(query, analyser)
    if node is None:
        return rows.select(key, F.lit(0.0).alias("kw_score")).where(F.lit(False))
    if analyser == "simple":
        words = tx.simple_terms(F.col(text))
        hit = rows.where(contains(node, words))
        if len(lexemes(node)) == 1:
            return hit.select(key, rank_column(node, words).alias("kw_score"))
        hit = hit.select(key, F.col(text).alias("_t"))
    else:
        hit = rows.select(key, F.col(text).alias("_t"))
        hit = hit if satisfied(node, {}) else hit.where(may_match(node, F.col("_t")))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, scores = [], []
            for k, t in zip(pdf[key], pdf["_t"], strict=True):
                at: dict[str, list[int]] = {}
                for x, p in analyse(t or "", analyser):
                    at.setdefault(x, []).append(p)
                if satisfied(node, at):
                    keys.append(k)
                    scores.append(cover_density(node, at))
            yield pd.DataFrame({key: keys, "kw_score": scores})

    return hit.mapInPandas(run, f"`{key}` {kind}, kw_score double")
