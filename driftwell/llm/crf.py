"""A linear-chain conditional random field over sparse binary features, in numpy."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np


class LinearChainCRF:
    """Labels sequences of blocks; each block is a list of feature names.  Decoded by Viterbi."""

    def __init__(self, labels: tuple[str, ...]):
        self.labels = labels
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, len(labels)))
        self.move = np.zeros((len(labels), len(labels)))

    def fit(self, pages: list[tuple[list[list[str]], list[str]]], rounds: int = 60, rate: float = 0.25, decay: float = 2e-4, least: int = 2) -> None:
        """Maximises the regularised conditional likelihood of the pages' labels by AdaGrad over all pages at once."""
        pages = [p for p in pages if p[0]]
        if not pages:
            return
        seen = Counter(f for blocks, _ in pages for b in blocks for f in b)
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
        own = {x: i for i, x in enumerate(self.labels)}
        k, n = len(self.labels), len(pages)
        length = np.asarray([len(b) for b, _ in pages])
        first = np.cumsum(length) - length
        gold = np.asarray([own[y] for _, ys in pages for y in ys])
        flat = [[x for f in b if (x := self.index.get(f)) is not None] for blocks, _ in pages for b in blocks]
        size = np.asarray([len(x) for x in flat])
        feature = np.asarray([x for b in flat for x in b], np.int64)
        place = np.repeat(np.arange(len(flat)), size)
        filled = np.nonzero(size)[0]
        starts = (np.cumsum(size) - size)[filled]
        by_feature = np.argsort(feature, kind="stable")
        heads = np.r_[0, np.nonzero(np.diff(feature[by_feature]))[0] + 1] if len(feature) else np.zeros(0, np.int64)
        used = feature[by_feature][heads]
        self.emit = np.zeros((len(self.index), k))
        true_emit = np.zeros_like(self.emit)
        np.add.at(true_emit, (feature, gold[place]), 1)
        true_move = np.zeros((k, k))
        inner = np.ones(len(gold), bool)
        inner[first] = False
        np.add.at(true_move, (gold[np.nonzero(inner)[0] - 1], gold[inner]), 1)
        g1, g2 = np.full_like(self.emit, 1e-3), np.full_like(self.move, 1e-3)
        for _ in range(rounds):
            score = np.zeros((len(gold), k))
            if len(feature):
                score[filled] = np.add.reduceat(self.emit[feature], starts, axis=0)
            one, two = self._marginals(score, first, length)
            d1 = decay * n * self.emit - true_emit
            if len(feature):
                d1[used] += np.add.reduceat(one[place[by_feature]], heads, axis=0)
            d2 = two - true_move + decay * n * self.move
            g1 += d1**2
            g2 += d2**2
            self.emit -= rate * d1 / np.sqrt(g1)
            self.move -= rate * d2 / np.sqrt(g2)

    def _marginals(self, score: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block marginals, expected moves) by a scaled forward-backward pass over all pages that are as long as the step.

        ``score`` has a row for each block; a page's blocks stand together from ``first`` on.
        """
        order = np.argsort(-length, kind="stable")
        first, length = first[order], length[order]
        alive = [int(np.searchsorted(-length, -j)) for j in range(int(length[0]) + 1)]  # pages longer than j
        e = np.exp(score - score.max(axis=1, keepdims=True))
        m = np.exp(self.move - self.move.max())
        fore, back, sums = np.zeros_like(e), np.zeros_like(e), np.ones(len(e))
        for j in range(int(length[0])):
            at = first[: alive[j]] + j
            x = e[at] if j == 0 else (fore[at - 1] @ m) * e[at]
            sums[at] = x.sum(axis=1)
            fore[at] = x / sums[at, None]
        back[first + length - 1] = 1
        two = np.zeros_like(m)
        for j in range(int(length[0]) - 1, 0, -1):
            at = first[: alive[j]] + j
            x = e[at] * back[at] / sums[at, None]
            back[at - 1] = x @ m.T
            two += m * (fore[at - 1].T @ x)
        one = fore * back
        return one / one.sum(axis=1, keepdims=True), two

    def decode(self, blocks: list[list[str]]) -> list[str]:
        """The most likely labels of a sequence (Viterbi)."""
        if not blocks:
            return []
        k = len(self.labels)
        score = np.zeros((len(blocks), k))
        for j, b in enumerate(blocks):
            own = [x for f in b if (x := self.index.get(f)) is not None]
            if own:
                score[j] = self.emit[own].sum(axis=0)
        best, trail = score[0], []
        for j in range(1, len(blocks)):
            x = best[:, None] + self.move
            trail.append(x.argmax(axis=0))
            best = x.max(axis=0) + score[j]
        path = [int(best.argmax())]
        for step in reversed(trail):
            path.append(int(step[path[-1]]))
        return [self.labels[y] for y in reversed(path)]

    def dump(self) -> bytes:
        """The weights as JSON."""
        return json.dumps({"labels": self.labels, "features": sorted(self.index, key=self.index.get), "emit": self.emit.tolist(), "move": self.move.tolist()}).encode()

    @classmethod
    def load(cls, data: bytes) -> LinearChainCRF:
        held = json.loads(data)
        own = cls(tuple(held["labels"]))
        own.index = {f: i for i, f in enumerate(held["features"])}
        own.emit, own.move = np.asarray(held["emit"]).reshape(len(own.index), -1), np.asarray(held["move"])
        return own
