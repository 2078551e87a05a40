"""Every query of the core, by name."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application (a local master shares the driver's path already).

    The archive goes to the folder that the cluster names in spark.checkpoint.dir, which all machines share; only where none is
    named does the driver serve it from a temporary file.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped or spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        where = f"{shared}/driftwell-{app}.zip"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(held.getvalue()))
        out.close()
    else:
        fd, where = tempfile.mkstemp(suffix=".zip", prefix="driftwell-")
        with os.fdopen(fd, "wb") as f:
            f.write(held.getvalue())
    spark.sparkContext.addPyFile(where)
    _shipped.add(app)


def _entries() -> dict:
    from driftwell.plans import queries_content, queries_data, queries_files, queries_search

    return queries_search.QUERIES | queries_content.QUERIES | queries_data.QUERIES | queries_files.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _entries().items() if sql}
