"""Frequency of every distinct term (problem 7).

A global integer dictionary is built over the terms, rows are encoded by it, each partition accumulates blockwise
count arrays (occurrences and record presence), and the arrays are summed by identifier range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.common import join_keys

#: Terms in a block of the count arrays.
BLOCK = 4096


def tag_term(name: Column) -> Column:
    """The term of a tag name: no blanks at the ends, no leading # with the blanks after it, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"^#\s*", ""), r"\s+$", ""))


def dictionary(terms: DataFrame, term: str) -> DataFrame:
    """(term, term_id): the distinct non-null terms, numbered from 0 without gaps.

    Numbers are a partition's offset plus the place in the partition; only one count for each partition is windowed,
    never the terms.  The terms are hash-partitioned, so numbering the parts again after a loss gives the same numbers.
    """
    own = terms.select(F.col(term).alias("term")).where(F.col("term").isNotNull()).distinct()
    parts = max(1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = own.withColumn("_part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("term")) - 1
    offset = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = offset.select("_part", before.alias("_from"))  # one row for each part: bounded by the number of partitions
    return own.withColumn("_place", place).join(F.broadcast(offset), "_part").select("term", (F.col("_from") + F.col("_place")).cast("long").alias("term_id"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Count arrays of a partition's rows, one row for each block that occurs; flushed when many blocks are open."""
    held: dict[int, np.ndarray] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for b, a in held.items():
            at = np.nonzero(a[0])[0]
            yield pd.DataFrame({"block": b, "at": [at.astype(np.int32)], "occurrences": [a[0][at]], "records": [a[1][at]]})
        held.clear()

    for pdf in batches:
        ids, n = pdf["term_id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        block = ids // BLOCK
        for b in np.unique(block):
            own = block == b
            a = held.setdefault(int(b), np.zeros((2, BLOCK), np.int64))
            at = ids[own] % BLOCK
            a[0] += np.bincount(at, n[own], BLOCK).astype(np.int64)
            a[1] += np.bincount(at, minlength=BLOCK)
        if len(held) > 1024:
            yield from flush()
    yield from flush()


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the arrays of the blocks in this partition, one after the other (rows come sorted by block)."""
    at, total = None, np.zeros((2, BLOCK), np.int64)

    def out() -> pd.DataFrame:
        k = np.nonzero(total[0])[0]
        return pd.DataFrame({"term_id": at * BLOCK + k, "occurrences": total[0][k], "records": total[1][k]})

    for pdf in batches:
        for b, k, o, r in zip(pdf["block"], pdf["at"], pdf["occurrences"], pdf["records"], strict=True):
            if b != at:
                if at is not None:
                    yield out()
                at, total = int(b), np.zeros((2, BLOCK), np.int64)
            total[0][k] += o
            total[1][k] += r
    if at is not None:
        yield out()


def term_counts(rows: DataFrame, names: DataFrame, record: str, key: str, name_key: str, term: Column) -> DataFrame:
    """(term, occurrences, records) of every term of ``names``.

    ``rows`` has a ``record`` and a ``key`` column, ``names`` says which term a ``name_key`` stands for.  Several keys may
    stand for one term; they count together and a record with several of them counts once.  Terms without rows get zeros.
    Null keys, null records and rows whose key has no term are left out; a null or empty term is no term.  Repeated rows
    count as occurrences, not as records.  Empty tables give an empty result (no names) or zeros (no rows).

    A key with a third of all rows is no hot task: rows are first folded to (record, key), and meet the dictionary by broadcast
    while that is small, which is checked, else by salt.
    """
    named = names.select(F.col(name_key).alias("_key"), term.alias("term")).where("_key is not null and term is not null and term <> ''").distinct()
    ids = dictionary(named, "term")
    codes = named.join(ids, "term").select("_key", "term_id")
    folded = rows.select(F.col(record).alias("_record"), F.col(key).alias("_key")).where("_record is not null and _key is not null").groupBy("_record", "_key").agg(F.count(F.lit(1)).alias("n"))
    encoded = join_keys(folded, codes, "_key", "_record", names.count()).groupBy("_record", "term_id").agg(F.sum("n").alias("n")).select("term_id", "n")
    blocks = encoded.mapInPandas(_blocks, "block long, at array<int>, occurrences array<long>, records array<long>")
    sums = blocks.repartition("block").sortWithinPartitions("block").mapInPandas(_sum, "term_id long, occurrences long, records long")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return ids.join(sums, "term_id", "left").select("term", zero("occurrences"), zero("records"))


def mark(counts: DataFrame, total: DataFrame, rare: int = 2, common: float = 0.02) -> DataFrame:
    """``counts`` with mark: rare (at most ``rare`` records), else common (over ``common`` of all), else null.

    ``total`` is a table of one row and one column: the number of records.
    """
    n = total.toDF("_total")
    tag = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * F.col("_total"), "common")
    return counts.crossJoin(F.broadcast(n)).withColumn("mark", tag).drop("_total")  # one row
