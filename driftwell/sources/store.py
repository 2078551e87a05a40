"""Tables in a folder that all executors share: intermediate data, and tables whose rows are replaced by key."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one in spark.checkpoint.dir, or one of the driver's own on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="driftwell-")
    return _local[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder that all machines share."""
    return f"{shared_folder(spark)}/{name}-{os.urandom(6).hex()}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which ends its lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Files:
    """Small files and listings of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.spark, self.folder = spark, folder
        self.own = self.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self.own.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.own.listStatus(self.path(name))) if self.exists(name) else []

    def write(self, name: str, text: str) -> None:
        """Writes beside and renames, so that readers never see half a file."""
        half = self.path(f"{name}.{os.urandom(4).hex()}.part")
        out = self.own.create(half, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name):
            self.own.delete(self.path(name), False)
        self.own.rename(half, self.path(name))

    def read(self, name: str) -> str:
        lines = self.spark._jvm.org.apache.hadoop.io.IOUtils
        stream = self.own.open(self.path(name))
        try:
            return bytes(lines.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()


class BucketTable:
    """A table in hash buckets of its key: a write folds a batch into the buckets that it touches and leaves the others alone.

    Each write has a number and adds a list of which version of each bucket holds; a write whose number is known does nothing,
    so a batch that is run again changes nothing, and readers see whole writes only.  A bucket is a file that one task writes:
    take so many that it is of a few hundred megabytes.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType | None = None, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.files = Files(spark, folder)
        if schema is not None and not self.files.exists("schema.json"):  # creating it twice does no harm
            self.files.write("schema.json", json.dumps({"schema": schema.jsonValue(), "buckets": buckets}))
        if self.files.exists("schema.json"):
            self.buckets = json.loads(self.files.read("schema.json"))["buckets"]

    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(self.files.read("schema.json"))["schema"]) if self.files.exists("schema.json") else None

    def writes(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("writes") if n.endswith(".json")]

    def _held(self) -> dict[str, str]:
        done = self.writes()
        return json.loads(self.files.read(f"writes/{max(done):012d}.json")) if done else {}

    def _read(self, held: dict[str, str]) -> DataFrame:
        schema = self.schema()
        if not held:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{path}" for path in sorted(held.values())])

    def table(self) -> DataFrame | None:
        """The rows; None if the table was never made."""
        return None if self.schema() is None else self._read(self._held())

    def write(self, batch: DataFrame, number: int, fold: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replaces the buckets of ``batch`` by ``fold(their rows, batch)``; gives how many were touched (0 for a known number)."""
        if number in self.writes():
            return 0
        if self.schema() is None:
            self.files.write("schema.json", json.dumps({"schema": batch.schema.jsonValue(), "buckets": self.buckets}))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # as many as there are buckets at most
        held = self._held()
        old = self._read({str(b): held[str(b)] for b in touched if str(b) in held})
        data = f"data/{number:012d}"
        names = [f.name for f in self.schema()]
        fold(old, batch).select(*names, bucket.alias("_bucket")).repartition(len(touched) or 1, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/{data}")
        for b in touched:
            if self.files.exists(f"{data}/_bucket={b}"):
                held[str(b)] = f"{data}/_bucket={b}"
            else:
                held.pop(str(b), None)
        self.files.write(f"writes/{number:012d}.json", json.dumps(held))
        return len(touched)

    def next_number(self) -> int:
        return max(self.writes(), default=-1) + 1

    def compact(self) -> dict[str, object]:
        """Rewrites every bucket as one file and drops versions that no longer hold; tells rows and bytes, or the error."""
        try:
            rows = self.table()
            if rows is None:
                return {"folder": self.folder, "error": "no such table"}
            number = self.next_number()
            self.write(rows, number, lambda old, new: new)
            kept = {p.split("/")[1] for p in self._held().values()}
            for name in self.files.names("data"):
                if name not in kept:
                    self.files.own.delete(self.files.path(f"data/{name}"), True)
            size = self.files.own.getContentSummary(self.files.path("data")).getLength()
            return {"folder": self.folder, "rows": self.table().count(), "bytes": size, "error": None}
        except Exception as e:  # one collection's failure doesn't stop the others
            return {"folder": self.folder, "error": str(e).split("\n")[0]}
