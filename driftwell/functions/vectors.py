"""Vectors as Column expressions over array<float|double>; sums are in double precision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Norms below this count as zero.
TINY = 1e-10
#: Sums that a task adds up at a time.
ROWS = 2000


def literal(v: Sequence[float]) -> Column:
    """A vector as a constant array<double>."""
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null or their lengths differ in content."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is (nearly) zero."""
    return let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n))


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is.  The length is computed once, not once for each element."""

    def unit(v: Column) -> Column:
        scaled = F.zip_with(v, F.array_repeat(norm(v), F.size(v)), lambda x, n: x.cast("double") / n)
        return F.when(norm(v) >= TINY, scaled).otherwise(F.transform(v, lambda x: x.cast("double")))

    return let(a, unit)


def nonzero(a: Column) -> Column:
    """The vector, null if it is null or all zero."""
    return F.when(F.exists(a, lambda x: x != 0), a)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def fuse(parts: list[tuple[Column, float]], size: int) -> Column:
    """Unit vector of the weighted sum of parts, a null part counting as zero; all null or zero gives zeros."""
    none = F.array_repeat(F.lit(0.0), size)
    total = None
    for v, w in parts:
        own = F.coalesce(scale(v, float(w)), none)
        total = own if total is None else add(total, own)
    return normalise(total)


def mean_pool(rows: DataFrame, keys: list[str], vector: str, out: str = "vector", round_to: int | None = None) -> DataFrame:
    """The element-wise mean of each group's non-null vectors, in two aggregations that both combine before the shuffle."""
    flat = rows.where(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("_pos", "_x"))
    mean = F.avg(F.col("_x").cast("double"))
    cells = flat.groupBy(*keys, "_pos").agg((F.round(mean, round_to) if round_to is not None else mean).alias("_m"))
    pairs = F.array_sort(F.collect_list(F.struct("_pos", "_m")))  # as many entries as the vector is long
    return cells.groupBy(*keys).agg(F.transform(pairs, lambda p: p["_m"]).alias(out))


def softmax_unsafe(scores: Column, unsafe: int) -> Column:
    """The share of the first ``unsafe`` entries in the softmax of an array of scores."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    e = F.zip_with(scores, F.array_repeat(F.array_max(scores), F.size(scores)), lambda x, top: F.exp(x - top))
    return let(e, lambda v: total(F.slice(v, 1, unsafe)) / total(v))


def mean_pool_fast(rows: DataFrame, key: str, vector: str, out: str = "vector", together: bool = False) -> DataFrame:
    """(key, out, n): the mean of each key's non-null vectors of one length, summed in numpy.

    Each partition adds up its own rows first, so a key with a third of all rows sends one sum from each partition; the sums
    then meet sorted by key and are added in one pass.  Where the rows of a key stand ``together`` in one partition already, no
    vector is shuffled.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, _sum array<double>, _n long"

    def fold(keys: np.ndarray, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, m, n = keys[order], m[order], n[order]
        at = np.r_[0, np.nonzero(keys[1:] != keys[:-1])[0] + 1]
        return keys[at], np.add.reduceat(m, at, axis=0), np.add.reduceat(n, at)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                k, m, n = fold(pdf[key].to_numpy(), np.stack(pdf["_v"].to_numpy()).astype(np.float64), np.ones(len(pdf), np.int64))
                yield pd.DataFrame({key: k, "_sum": list(m), "_n": n})

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in (b.iloc[at : at + ROWS] for b in batches for at in range(0, len(b), ROWS)):
            k, m, n = pdf[key].to_numpy(), np.stack(pdf["_sum"].to_numpy()), pdf["_n"].to_numpy()
            if last is not None:
                k, m, n = np.r_[last[0], k], np.vstack([last[1], m]), np.r_[last[2], n]
            k, m, n = fold(k, m, n)
            last = (k[-1:], m[-1:], n[-1:])
            if len(k) > 1:
                yield pd.DataFrame({key: k[:-1], out: list(m[:-1] / n[:-1, None]), "n": n[:-1]})
        if last is not None:
            yield pd.DataFrame({key: last[0], out: list(last[1] / last[2][:, None]), "n": last[2]})

    own = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).alias("_v"))
    if together:
        sums = own.select(key, F.col("_v").cast("array<double>").alias("_sum"), F.lit(1).cast("long").alias("_n"))
    else:
        sums = own.mapInPandas(partial, schema).repartition(key).sortWithinPartitions(key)
    return sums.mapInPandas(final, f"`{key}` {kind}, `{out}` array<double>, n long")
