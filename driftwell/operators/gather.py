"""Means of the vectors that rows name by number, gathered from blocks in the shared folder.

Neither the driver nor a shuffle of the rows holds a vector: the vectors are written once, in order of their numbers, and each task
maps the blocks that its rows need.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block at most, and vectors that a task gathers at a time.
BLOCK, TAKE = 16 << 20, 4096


@dataclass(frozen=True)
class Blocks:
    """Where the vectors are: (file name, lowest number, highest number, vectors) of each block."""

    folder: str
    dtype: str
    size: int
    held: tuple[tuple[str, int, int, int], ...]

    def json(self) -> dict:
        return {"folder": self.folder, "dtype": self.dtype, "size": self.size, "held": [list(x) for x in self.held]}

    @classmethod
    def of(cls, held: dict) -> Blocks:
        return cls(held["folder"], held["dtype"], held["size"], tuple(tuple(x) for x in held["held"]))


def write(rows: DataFrame, key: str, vector: str, folder: str, most: int = BLOCK) -> Blocks:
    """Writes (key, vector), vectors of one length, to a folder that all machines share; null vectors are left out."""
    dtype = "<f4" if isinstance(rows.schema[vector].dataType.elementType, T.FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pfs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        for b in batches:
            ids, vs = b.column(0).to_numpy(zero_copy_only=False).astype("<i8"), b.column(1)
            lengths = np.unique(pc.list_value_length(vs).to_numpy(zero_copy_only=False))
            if not len(lengths):
                continue
            if len(lengths) > 1:
                raise ValueError("vectors of several lengths")
            m = vs.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(ids), -1)
            step = max(1, most // max(1, m.shape[1] * m.itemsize))
            for at in range(0, len(ids), step):
                own, name = ids[at : at + step], os.urandom(12).hex()  # a task that is run again writes others
                with fs.open_output_stream(f"{path}/{name}") as f:
                    f.write(own.tobytes())
                    f.write(m[at : at + step].tobytes())
                yield pa.RecordBatch.from_pydict({"name": [name], "low": [int(own[0])], "high": [int(own[-1])], "n": [len(own)], "size": [m.shape[1]]})

    own = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    got = own.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(run, "name string, low long, high long, n long, size long").collect()  # a row for each block
    sizes = {r["size"] for r in got}
    if len(sizes) > 1:
        raise ValueError("vectors of several lengths")
    return Blocks(folder, dtype, sizes.pop() if sizes else 0, tuple(sorted(((r["name"], r["low"], r["high"], r["n"]) for r in got), key=lambda x: (x[1], x[2], x[0]))))


class _Reader:
    """The blocks as a task sees them: mapped where the folder is local, read when asked for elsewhere."""

    def __init__(self, blocks: Blocks):
        self.b = blocks
        self.fs, self.path = pfs.FileSystem.from_uri(blocks.folder)
        self.low, self.high = (np.array([x[i] for x in blocks.held], np.int64) for i in (1, 2))
        self.maps: dict[int, np.ndarray] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        name, _, _, n = self.b.held[k]
        if isinstance(self.fs, pfs.LocalFileSystem):
            if k not in self.maps:
                self.maps[k] = np.memmap(f"{self.path}/{name}", np.uint8, "r")
            raw = self.maps[k]
        else:
            with self.fs.open_input_stream(f"{self.path}/{name}") as f:
                raw = np.frombuffer(f.read(), np.uint8)
        return raw[: 8 * n].view("<i8"), raw[8 * n :].view(self.b.dtype).reshape(n, self.b.size)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``ids``, their vectors), in order of the places; a number that occurs twice has two vectors, one that is unknown none."""
        order = np.argsort(ids, kind="stable")
        s = ids[order]
        lo, hi = np.searchsorted(s, self.low, "left"), np.searchsorted(s, self.high, "right")
        places, found = [np.zeros(0, np.int64)], [np.zeros((0, self.b.size), self.b.dtype)]
        for k in np.nonzero(hi > lo)[0]:
            own, m = self.block(int(k))
            want = s[lo[k] : hi[k]]
            a = np.searchsorted(own, want, "left")
            n = np.searchsorted(own, want, "right") - a
            places.append(np.repeat(order[lo[k] : hi[k]], n))
            found.append(m[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
        at = np.concatenate(places)
        back = np.argsort(at, kind="stable")
        return at[back], np.concatenate(found)[back]

    def has(self, ids: np.ndarray) -> np.ndarray:
        """Whether each number is known."""
        out, order = np.zeros(len(ids), bool), np.argsort(ids, kind="stable")
        s = ids[order]
        lo, hi = np.searchsorted(s, self.low, "left"), np.searchsorted(s, self.high, "right")
        for k in np.nonzero(hi > lo)[0]:
            own, want = self.block(int(k))[0], s[lo[k] : hi[k]]
            out[order[lo[k] : hi[k]]] |= own[np.searchsorted(own, want, "left")] == want  # none is above the block's highest
        return out


def known(rows: DataFrame, parts: str, blocks: Blocks) -> DataFrame:
    """The rows of whose array ``parts`` at least one number has a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(blocks)
        for b in batches:
            n = pc.fill_null(pc.list_value_length(b.column(parts)), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)[reader.has(b.column(parts).flatten().to_numpy(zero_copy_only=False))]
            yield b.take(pa.array(np.unique(row)))

    return rows.mapInArrow(run, rows.schema)


def gathered(batches: Iterator[pa.RecordBatch], parts: str, blocks: Blocks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, places of those with a known number, the means of these), a few thousand vectors at a time."""
    reader = _Reader(blocks)
    for batch in batches:
        n = pc.fill_null(pc.list_value_length(batch.column(parts)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(n), 0
        while at < len(n):
            upto = min(at + TAKE, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TAKE, "right"))))
            b, own = batch.slice(at, upto - at), n[at:upto]
            at = upto
            places, m = reader.find(b.column(parts).flatten().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(own)), own)[places]
            start = np.r_[0, np.nonzero(row[1:] != row[:-1])[0] + 1][: len(row)].astype(np.int64)
            count = np.diff(np.r_[start, len(row)])
            yield b, row[start], np.add.reduceat(m.astype(np.float64), start, axis=0) / count[:, None] if len(row) else np.zeros((0, blocks.size))


def each(rows: DataFrame, parts: str, blocks: Blocks, use: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """What ``use`` makes of rows and the means of the vectors whose numbers are in their array ``parts``; no vector leaves the task.

    A row without a known number is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, has, m in gathered(batches, parts, blocks):
            yield use(b.take(pa.array(has)), m)

    return rows.mapInArrow(run, schema)


def means(rows: DataFrame, parts: str, blocks: Blocks, out: str = "vector", keep: bool = False) -> DataFrame:
    """``rows`` with ``out``, the mean of the vectors whose numbers are in the array ``parts``; the other columns stay as they are.

    A row without a known number is left out, or with ``keep`` has a null.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, has, m in gathered(batches, parts, blocks):
            if not keep:
                b, has = b.take(pa.array(has)), np.arange(len(has))
            full = np.zeros(b.num_rows, bool)
            full[has] = True
            ends = np.r_[0, np.cumsum(full * m.shape[1])].astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()), mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays([*b.columns, v], [*b.schema.names, out])

    return rows.mapInArrow(run, schema)
