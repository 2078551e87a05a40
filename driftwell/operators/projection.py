"""Projection of image vectors into the text space: forward pass and training."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.sources.store import cut

_erf = np.vectorize(math.erf)


def layer(x: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Unit rows of x through dense layers with GELU between them (one layer: the linear form)."""
    for i, (w, b) in enumerate(weights):
        x = x @ w.T + b
        if i + 1 < len(weights):
            x = 0.5 * x * (1 + _erf(x / math.sqrt(2)))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def project(rows: DataFrame, vector: str, weights: list[tuple[np.ndarray, np.ndarray]], out: str = "projected") -> DataFrame:
    """``rows`` with the projection of a vector; null stays null."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)  # the size of the model

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna().to_numpy()
            made = iter(layer(np.stack(s[known].to_numpy()).astype(np.float64), sent.value)) if known.any() else iter(())
            yield pd.Series([next(made) if k else None for k in known])

    return rows.withColumn(out, run(F.col(vector)))


def fit_linear(pairs: DataFrame, x: str, y: str, ridge: float = 1e-2) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ridge weights from x to y: each partition sums its part of the Gram matrix; only those sums come to the driver."""
    own = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = b = None
        for pdf in batches:
            if not len(pdf):
                continue
            m = np.stack(pdf["_x"].to_numpy()).astype(np.float64)
            m = np.c_[m, np.ones(len(m))]
            t = np.stack(pdf["_y"].to_numpy()).astype(np.float64)
            a = m.T @ m + (0 if a is None else a)
            b = m.T @ t + (0 if b is None else b)
        if a is not None:
            yield pd.DataFrame({"i": range(len(a)), "a": list(a), "b": list(b)})

    parts = own.mapInPandas(gram, "i int, a array<double>, b array<double>")
    flat = lambda c: parts.select("i", F.posexplode(c).alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    cells = {c: flat(c) for c in ("a", "b")}  # (dimensions + 1) squared numbers, whatever the number of pairs
    if not len(cells["a"]):
        raise ValueError("no pairs to fit on")
    dense = {}
    for c, t in cells.items():
        m = np.zeros((t["i"].max() + 1, t["j"].max() + 1))
        m[t["i"], t["j"]] = t["v"]
        dense[c] = m
    w = np.linalg.solve(dense["a"] + ridge * np.eye(len(dense["a"])), dense["b"])
    return [(w[:-1].T.copy(), w[-1].copy())]


def fit_layers_spread(pairs: DataFrame, x: str, y: str, hidden: int = 768, epochs: int = 80, rate: float = 3e-3, decay: float = 1e-4, seed: int = 42, groups: int = 8) -> tuple[list, float]:
    """(weights, mean cosine at the end) of the same network over any number of pairs, by AdamW over all of them.

    Each epoch is a job: a partition sums the gradient of its pairs, ``groups`` tasks add those sums up, and only their results,
    each of the model's size, come to the driver.  The pairs are written once to the shared folder.
    """
    own = cut(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("array<double>").alias("_y")))
    first, n = own.first(), own.count()
    if not n:
        raise ValueError("no pairs to fit on")
    d, e = len(first["_x"]), len(first["_y"])
    p = _start(d, e, hidden, seed)
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    shapes, cos = [q.shape for q in p], 0.0
    for epoch in range(epochs):
        sent = own.sparkSession.sparkContext.broadcast(p)  # the size of the model

        def partial(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            total, cosines = None, 0.0
            for pdf in batches:
                if len(pdf):
                    grads, c = _gradient(sent.value, np.stack(pdf["_x"].to_numpy()), np.stack(pdf["_y"].to_numpy()), n)
                    flat = np.concatenate([g.ravel() for g in grads])
                    total, cosines = (flat if total is None else total + flat), cosines + c
            if total is not None:
                yield pd.DataFrame({"g": [total.tobytes()], "c": [cosines]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"g": [sum(np.frombuffer(g, np.float64) for g in pdf["g"]).tobytes()], "c": [pdf["c"].sum()]})

        parts = own.mapInPandas(partial, "g binary, c double").withColumn("_p", F.pmod(F.spark_partition_id(), F.lit(groups)))
        got = parts.groupBy("_p").applyInPandas(lambda pdf: add(pdf), "g binary, c double").collect()  # as many rows as groups
        sent.destroy()
        flat, cos = sum(np.frombuffer(r["g"], np.float64) for r in got), sum(r["c"] for r in got) / n
        lr, at = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs)), 0
        for i, shape in enumerate(shapes):
            size = math.prod(shape)
            _adam(p, m, v, i, flat[at : at + size].reshape(shape), epoch + 1, lr, decay)
            at += size
    return [(p[0], p[1]), (p[2], p[3])], float(cos)


def _start(d: int, e: int, hidden: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, math.sqrt(2 / d), (hidden, d)), np.zeros(hidden), rng.normal(0, math.sqrt(2 / hidden), (e, hidden)), np.zeros(e)]


def _gradient(p: list[np.ndarray], a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[np.ndarray], float]:
    """(gradient of squared error + half of one minus cosine over ``n`` pairs, sum of the cosines) of some of the pairs."""
    h = a @ p[0].T + p[1]
    phi = 0.5 * (1 + _erf(h / math.sqrt(2)))
    g = h * phi
    o = g @ p[2].T + p[3]
    size = np.maximum(np.linalg.norm(o, axis=1, keepdims=True), 1e-12)
    u = o / size
    du = 2 * (u - b) / (n * b.shape[1]) - 0.5 * b / n
    do = (du - u * (du * u).sum(axis=1, keepdims=True)) / size
    dh = (do @ p[2]) * (phi + h * np.exp(-(h**2) / 2) / math.sqrt(2 * math.pi))
    return [dh.T @ a, dh.sum(axis=0), do.T @ g, do.sum(axis=0)], float((u * b).sum())


def _adam(p: list, m: list, v: list, i: int, grad: np.ndarray, t: int, lr: float, decay: float) -> None:
    m[i] = 0.9 * m[i] + 0.1 * grad
    v[i] = 0.999 * v[i] + 0.001 * grad * grad
    p[i] -= lr * ((m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8) + decay * p[i])


def fit_layers(x: np.ndarray, y: np.ndarray, hidden: int = 768, epochs: int = 80, batch: int = 256, rate: float = 3e-4, decay: float = 0.01, validate: int = 500, seed: int = 42) -> tuple[list, float]:
    """(weights, mean validation cosine) of a two-layer GELU network: MSE + half of one minus cosine, AdamW, cosine schedule.

    For a bounded set of pairs on the driver.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = order[: min(validate, len(x) // 5)]
    used = order[len(held) :]
    p = _start(x.shape[1], y.shape[1], hidden, seed)
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        lr = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        perm = rng.permutation(used)
        for lo in range(0, len(perm), batch):
            own = perm[lo : lo + batch]
            grads, _ = _gradient(p, x[own], y[own], len(own))
            t += 1
            for i, g in enumerate(grads):
                _adam(p, m, v, i, g, t, lr, decay)
    weights = [(p[0], p[1]), (p[2], p[3])]
    cos = float((layer(x[held], weights) * y[held]).sum(axis=1).mean()) if len(held) else float("nan")
    return weights, cos
