"""Items that appear together (problem 5): a blocked Gram matrix over binary baskets.

Items are numbered, the most frequent ones first: they are the head block, the others follow in blocks.  A task turns its baskets
into binary sparse record blocks, sums their transpose-products (the head's in one dense block, the rest in sorted cells), equal
cells are added, and counts are set against what the marginals lead one to expect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.llm.common import join_keys
from driftwell.sources.store import cut

#: Items of the head block, and of a record that are handled at once; wider records go block pair by block pair.
HEAD, WIDTH = 2048, 4096
#: Cells that a task holds before it adds up equal ones, and at most before it passes them on.
CELLS = 1 << 21
#: Baskets multiplied at once.
RECORDS = 4096


def _cells(flat: np.ndarray, n: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The cells a * k + b, a < b, of the transpose-product of baskets of ``n`` sorted item numbers each, about CELLS at a time."""
    start = np.cumsum(n) - n
    after = np.repeat(start + n, n) - np.arange(len(flat)) - 1  # items behind each one in its basket
    ends = np.cumsum(after)
    lo = 0
    while lo < len(flat):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
        m = after[lo:hi]
        left = np.repeat(np.arange(lo, hi), m)
        step = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
        yield flat[left] * k + flat[left + 1 + step]
        lo = hi


def _faces(x: np.ndarray, y: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The cells of the product of one record's items in two blocks, x before y."""
    rows = max(1, CELLS // max(1, len(y)))
    for lo in range(0, len(x), rows):
        yield (x[lo : lo + rows, None] * k + y[None]).ravel()


class _Sums:
    """Counts of cells: dense for the head block, sorted for the rest."""

    def __init__(self, k: int, head: int):
        self.k, self.head = k, min(k, head)
        self.dense = np.zeros(self.head**2, np.int64)
        self.held: list[np.ndarray] = []
        self.top: list[np.ndarray] = []
        self.size = self.tops = 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def multiply(self, flat: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
        """Adds a block of baskets; a block in which head items stand dense is multiplied as a matrix."""
        inside = flat < self.head
        record = np.repeat(np.arange(len(n)), n)
        m = np.bincount(record[inside], minlength=len(n))
        if (m.astype(float) ** 2).sum() > len(n) * self.head**2 / 64:  # a matrix product takes less time than the pairs
            x = np.zeros((len(n), self.head), np.float32)
            x[record[inside], flat[inside]] = 1
            self.dense += np.triu(x.T @ x, 1).astype(np.int64).ravel()  # exact: a block has fewer than 2**24 records
            for c in _cells(flat, n, self.k):
                yield from self.add(c[c % self.k >= self.head])
            return
        for c in _cells(flat, n, self.k):
            yield from self.add(c)

    def add(self, cells: np.ndarray) -> Iterator[pd.DataFrame]:
        """Adds cells; passes sums on where there are too many to hold."""
        if self.head < self.k:
            a, b = np.divmod(cells, self.k)
            top = b < self.head  # a < b, so both are in the head
            self._head(a[top] * self.head + b[top])
            cells = cells[~top]
        else:
            self._head(cells)
            cells = cells[:0]
        self.held.append(cells)
        self.size += len(cells)
        if self.size > CELLS:
            self._fold()
            if len(self.keys) > CELLS:
                yield self._out(self.keys, self.counts)
                self.keys, self.counts = self.keys[:0], self.counts[:0]

    def _head(self, cells: np.ndarray, most: int = CELLS) -> None:
        self.top.append(cells)
        self.tops += len(cells)
        if self.tops > most:
            self.dense += np.bincount(np.concatenate(self.top), minlength=len(self.dense))
            self.top, self.tops = [], 0

    def _fold(self) -> None:
        keys, counts = np.unique(np.concatenate(self.held), return_counts=True) if self.held else (np.zeros(0, np.int64),) * 2
        every = np.concatenate([self.keys, keys])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], np.concatenate([self.counts, counts])[order]
        first = np.nonzero(np.r_[True, every[1:] != every[:-1]])[0] if len(every) else np.zeros(0, np.int64)
        self.keys, self.counts = every[first], np.add.reduceat(counts, first) if len(first) else counts
        self.held, self.size = [], 0

    def _out(self, keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": keys // self.k, "b": keys % self.k, "n": counts})

    def rest(self) -> Iterator[pd.DataFrame]:
        self._fold()
        self._head(np.zeros(0, np.int64), -1)
        at = np.nonzero(self.dense)[0]
        yield pd.DataFrame({"a": at // self.head, "b": at % self.head, "n": self.dense[at]})
        yield self._out(self.keys, self.counts)


def _gram(k: int, head: int):
    """Partial cells (a, b, n) of a partition's baskets x, or of the products of x and y where y is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = _Sums(k, head)
        for pdf in batches:
            whole = pdf["y"].isna().to_numpy()
            own = list(pdf["x"][whole])
            for lo in range(0, len(own), RECORDS):
                part = own[lo : lo + RECORDS]
                yield from sums.multiply(np.concatenate(part).astype(np.int64), np.fromiter(map(len, part), np.int64, len(part)))
            for x, y in zip(pdf["x"][~whole], pdf["y"][~whole], strict=True):
                for c in _faces(np.asarray(x, np.int64), np.asarray(y, np.int64), k):
                    yield from sums.add(c)
        if k:
            yield from sums.rest()

    return run


def _numbered(known: DataFrame, head: int) -> tuple[DataFrame, int]:
    """(``known`` (_i, _n) with the number _c of each item, how many there are): the most frequent first, the others part by part."""
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = known.orderBy(F.desc("_n"), "_i").limit(head).select("_i", (F.row_number().over(Window.orderBy(F.desc("_n"), "_i")) - 1).alias("_h"))
    part = F.pmod(F.xxhash64("_i"), F.lit(parts))
    own = known.join(F.broadcast(most), "_i", "left").withColumn("_p", F.when(F.col("_h").isNull(), part).otherwise(-1))
    own = cut(own.withColumn("_q", F.row_number().over(Window.partitionBy("_p").orderBy("_h", "_i")) - 1))
    sizes = {r["_p"]: r["n"] for r in own.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each part
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    begin = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in start.items() for x in kv]), F.col("_p").cast("long")) if start else F.lit(0)
    return own.select("_i", "_n", (begin + F.col("_q")).cast("long").alias("_c")), at


def together(rows: DataFrame, record: str, item: str, least: int = 5, lift: float = 10.0, width: int = WIDTH, head: int = HEAD) -> DataFrame:
    """(tag_a, tag_b, n, n_a, n_b, total, lift) of all item pairs, tag_a < tag_b, in at least ``least`` records and with lift >= ``lift``.

    lift is n * total / (n_a * n_b): how much more often than chance.  Repeated rows count once; rows with a null record or
    item are left out; an empty table gives an empty result.  Items in fewer than ``least`` records can't be in such a pair and
    leave before pairs are made, which loses nothing.

    A record of up to ``width`` items is one row.  A wider one is cut into blocks of ``width`` item numbers, and each pair of its
    blocks is a row of its own, found by record and block pair, so that neither a record with a third of all rows nor an item
    with a third of them makes an unbounded group.
    """
    own = rows.select(F.col(record).cast("long").alias("_r"), F.col(item).cast("long").alias("_i")).where("_r is not null and _i is not null").distinct()
    total = own.select("_r").distinct().agg(F.count(F.lit(1)).alias("total"))
    known, k = _numbered(own.groupBy("_i").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least), head)
    left = join_keys(own, known.select("_i", "_c"), "_i", "_r", k).select("_r", "_c")
    none = F.lit(None).cast("array<long>").alias("y")
    listed = F.sort_array(F.collect_list("_c"))
    large = None
    if k > width:
        large = left.groupBy("_r").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > width).select("_r")
        large = large if large.take(1) else None
    small = left if large is None else left.join(large, "_r", "left_anti")
    faces = small.groupBy("_r").agg(listed.alias("x")).where(F.size("x") > 1).select("x", none)
    if large is not None:
        block = F.floor(F.col("_c") / width).cast("int")
        part = left.join(large, "_r", "left_semi").groupBy("_r", block.alias("_b")).agg(listed.alias("v"))
        each = part.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit((k - 1) // width)))).where("_o <> _b")
        side = F.col("_b") < F.col("_o")
        pair = each.groupBy("_r", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j")).agg(F.max(F.when(side, F.col("v"))).alias("x"), F.max(F.when(~side, F.col("v"))).alias("y"))
        faces = faces.unionByName(part.where(F.size("v") > 1).select(F.col("v").alias("x"), none)).unionByName(pair.where("x is not null and y is not null").select("x", "y"))
    cells = faces.mapInPandas(_gram(k, head), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    side_of = lambda c: known.select(F.col("_c").alias(c), F.col("_i").alias(f"i_{c}"), F.col("_n").alias(f"n_{c}"))
    pairs = join_keys(join_keys(cells, side_of("a"), "a", "b", k), side_of("b"), "b", "a", k).crossJoin(F.broadcast(total))  # total: one row
    enough = F.col("n") * F.col("total") >= F.lit(lift) * F.col("n_a") * F.col("n_b")
    low = F.col("i_a") < F.col("i_b")
    swap = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    over = F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))
    return pairs.where(enough).select(F.least("i_a", "i_b").alias("tag_a"), F.greatest("i_a", "i_b").alias("tag_b"), "n", swap("n_a", "n_b").alias("n_a"), swap("n_b", "n_a").alias("n_b"), "total", over.alias("lift"))
