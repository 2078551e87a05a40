"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir`` (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A table that comes in one row group would otherwise be handled by one Python worker.  Large inputs,
    whose scan already has more partitions than the cluster has cores, are returned as they are.
    """
    cores = max(1, df.sparkSession.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, key) if key else df.repartition(cores * 2)


#: Rows of two numbers that are sent to every task (16 MB); longer tables are joined by salt.
SENT = 1_000_000
SALTS = 16


def join_keys(rows: DataFrame, keys: DataFrame, on: str, spread_by: str, count: int) -> DataFrame:
    """``rows`` joined with ``keys`` (unique in ``on``, ``count`` rows of a few numbers), safe for a key with a third of all rows.

    Up to SENT keys go to every task; more are repeated for each salt, and a row's salt comes from its ``spread_by`` column.
    """
    if count <= SENT:
        return rows.join(F.broadcast(keys), on)
    salted = keys.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"]).drop("_salt")


def current(df: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """One row for each ``key``: the ``values`` of its last version by ``order`` (nulls first, ties by value).

    The versions of a key are folded by a map-side maximum, so a key with many versions is no hot group.
    Rows with a null key are left out.
    """
    cols = [*order, *[v for v in values if v not in order]]
    best = F.max(F.struct(*cols)).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{v}").alias(v) for v in values])


def map_text(df: DataFrame, fn: Callable[[list], list], text: str, out: str, kind: str, keep: list[str]) -> DataFrame:
    """Column ``out`` = ``fn`` of the texts of an Arrow batch, beside the columns ``keep``; other columns are dropped.

    ``fn`` maps a list of texts (None for null) to a list of as many results.  It is pickled by reference, so what
    it compiles is built once for each Python worker.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + f", `{out}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["_text"]]
            got = pdf[keep].copy()
            got[out] = pd.Series(fn(texts), index=pdf.index, dtype=object)
            yield got

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInPandas(run, schema)


#: Characters that show nothing and are dropped before words are read.
INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ո": "n", "һ": "h", "ӏ": "l", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
}
_MIXED = re.compile(r"[^\W\d_]+")
_OTHER = re.compile("[" + "".join(LOOKALIKE) + "]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_LOOK = str.maketrans(LOOKALIKE)


def latin_words(text: str) -> str:
    """``text`` with look-alike letters made Latin in every word that also has a Latin letter."""
    if not _OTHER.search(text):
        return text

    def one(m: re.Match) -> str:
        w = m.group()
        return w.translate(_LOOK) if not w.isascii() and _LATIN.search(w) else w

    return _MIXED.sub(one, text)


def fold(text: str) -> str:
    """Lower case, compatibility forms, no invisible characters."""
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
