"""Approximate vector search: vectors kept by cell, a query reads the cells nearest to it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.operators import gather, retrieve

#: Vectors that the cells are fitted on, at most; all vectors are put into cells.
SAMPLE = 20_000


class NoVectors(ValueError):
    """There is no vector other than zero."""


def in_sample(key: str, n: int) -> Column:
    """Whether a row is of the share of ``n`` rows that cells are fitted on."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 20)) < max(1, int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)))


def fit_cells(rows: DataFrame, key: str, vector: str, cells: int, seed: int = 42, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means on a fixed share of the rows."""
    own = rows.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(key, F.col(vector).alias("_v"))
    kind = rows.schema[key].dataType.simpleString()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "_b": [np.asarray(v, "<f4").tobytes() for v in pdf["_v"]]})

    return _fit(own.where(in_sample(key, own.count())).mapInPandas(packed, f"`{key}` {kind}, _b binary"), cells, seed, rounds)


def fit_gathered(rows: DataFrame, parts: str, blocks: gather.Blocks, n: int, cells: int, key: str = "id", seed: int = 42, rounds: int = 12) -> np.ndarray:
    """The same for ``n`` rows whose vectors are means of those that ``parts`` names."""

    def packed(b: pa.RecordBatch, m: np.ndarray) -> pa.RecordBatch:
        ok = np.any(m != 0, axis=1)
        return pa.RecordBatch.from_arrays([b.filter(pa.array(ok)).column(0), pa.array([v.tobytes() for v in m[ok].astype("<f4")], pa.binary())], [key, "_b"])

    own = rows.where(in_sample(key, n)).select(key, parts)
    return _fit(gather.each(own, parts, blocks, packed, f"`{key}` {rows.schema[key].dataType.simpleString()}, _b binary"), cells, seed, rounds)


def _fit(packed: DataFrame, cells: int, seed: int, rounds: int) -> np.ndarray:
    # as bytes: as a list of numbers each vector would take the driver twenty times its size
    picked = sorted(packed.limit(2 * SAMPLE).collect(), key=lambda r: r[0])
    if not picked:
        raise NoVectors("no vectors to fit cells on")
    m = np.stack([np.frombuffer(r["_b"], "<f4") for r in picked])
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    at = m[np.random.default_rng(seed).choice(len(m), min(cells, len(m)), replace=False)].copy()
    for _ in range(rounds):
        near = (m @ at.T).argmax(axis=1)
        for c in np.unique(near):
            at[c] = m[near == c].mean(axis=0)
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)
    return at


def assign(rows: DataFrame, key: str, vector: str, centroids: np.ndarray, keep: Sequence[str] = ()) -> DataFrame:
    """(key, vector, keep..., cell); write it with partitionBy("cell") so that a query's other cells aren't read.  Zero vectors are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # the number of cells times the dimension

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf[vector].to_numpy()).astype(np.float32)
                ok = np.linalg.norm(m, axis=1) > 0
                yield pdf[ok].assign(cell=(m[ok] @ sent.value.T).argmax(axis=1).astype(np.int32))

    own = rows.where(F.size(vector) == centroids.shape[1]).select(key, vector, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInPandas(run, f"{fields}, cell int")


def assign_gathered(rows: DataFrame, parts: str, blocks: gather.Blocks, centroids: np.ndarray) -> DataFrame:
    """``rows`` and cell, by the mean of the vectors that ``parts`` names.  Rows without a vector, or with a zero one, are left out."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # the number of cells times the dimension

    def cell(b: pa.RecordBatch, m: np.ndarray) -> pa.RecordBatch:
        m = m.astype(np.float32)
        ok = np.linalg.norm(m, axis=1) > 0
        return pa.RecordBatch.from_arrays([*b.filter(pa.array(ok)).columns, pa.array((m[ok] @ sent.value.T).argmax(axis=1).astype(np.int32))], [*b.schema.names, "cell"])

    return gather.each(rows, parts, blocks, cell, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def nearest_cells(centroids: np.ndarray, query: Sequence[float], probes: int) -> list[int]:
    """The ``probes`` cells nearest to the query."""
    return [int(c) for c in np.argsort(-(centroids @ np.asarray(query, np.float32)), kind="stable")[:probes]]


def topk(indexed: DataFrame, key: str, vector: str, centroids: np.ndarray, query: Sequence[float], k: int = 100, probes: int = 8) -> DataFrame:
    """(key, cosine): the ``k`` best rows of the ``probes`` cells nearest to the query; all cells give the exact answer."""
    return retrieve.vector_topk(indexed.where(F.col("cell").isin(nearest_cells(centroids, query, probes))), key, vector, query, k)
