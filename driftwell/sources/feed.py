"""A data source over a folder of feed posts (JSON lines): a blog's or a tag's page before a time, a blog's info, a stream.

    spark.dataSource.register(FeedSource)
    spark.read.format("feed").option("path", p).option("blog", "a").option("before", 1700000000).option("limit", 20).load()
    spark.read.format("feed").option("path", p).option("info", "a").load()
    spark.readStream.format("feed").option("path", p).load()

Files are found and read by pyarrow's file systems (local paths, file:, hdfs:, s3: and the like), a task for each file.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_SCHEMA = "id long, type string, blog_name string, timestamp long, body string, tags array<string>, note_count long, raw string, bad boolean"
_INFO = "blog_name string, posts long, first long, last long, notes long"
#: Posts of a page unless told otherwise.
PAGE = 20


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The JSON files of a folder in the order of their names, or the file itself."""
    from pyarrow import fs

    system, own = _system(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(own, allow_not_found=True))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.type == fs.FileType.File and ".json" in f.base_name and not f.base_name.startswith(("_", "."))]


def _number(x: object) -> int | None:
    try:
        return int(x)
    except (TypeError, ValueError):
        return None


def _rows(path: str) -> Iterator[tuple]:
    """The posts of a file; a line that is no post is a row of its own that is marked as bad."""
    system, own = _system(path)
    with system.open_input_stream(own) as f:
        for line in _lines(f):
            if not line.strip():
                continue
            try:
                p = json.loads(line)
            except ValueError:
                p = None
            if isinstance(p, dict) and _number(p.get("id")) is not None:
                tags = p.get("tags")
                yield (_number(p["id"]), p.get("type"), p.get("blog_name"), _number(p.get("timestamp")), p.get("body"), [str(t) for t in tags] if isinstance(tags, list) else [], _number(p.get("note_count")) or 0, line, False)
            else:
                yield (None, None, None, None, None, [], None, line, True)


def _lines(stream) -> Iterator[str]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        for x in whole:
            yield x.decode("utf-8", "replace")
    if rest:
        yield rest.decode("utf-8", "replace")


class FeedSource(DataSource):
    """Options: path; blog or tag; before (epoch seconds, exclusive); limit (newest first, the first ones of each file: ``page`` cuts
    the whole to a page); info (a blog's name, or * for all: one row for each blog and file, added up by ``blog_info``)."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return _INFO if self.options.get("info") else _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedStream(self.options)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FeedReader(DataSourceReader):
    """A task for each file."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.options["path"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        if o.get("info"):
            yield from self._info(partition.path, o["info"])
            return
        before = int(o["before"]) if o.get("before") else None
        rows = (r for r in _rows(partition.path) if not (o.get("blog") or o.get("tag") or before is not None) or self._wanted(r, before))
        if o.get("limit"):  # those of a file beyond the limit can't be among the first of all
            rows = heapq.nlargest(int(o["limit"]), (r for r in rows if not r[8]), key=lambda r: (r[3] or 0, r[0]))
        yield from rows

    def _wanted(self, r: tuple, before: int | None) -> bool:
        o = self.options
        return not r[8] and (not o.get("blog") or r[2] == o["blog"]) and (not o.get("tag") or o["tag"] in r[5]) and (before is None or (r[3] is not None and r[3] < before))

    @staticmethod
    def _info(path: str, blog: str) -> Iterator[tuple]:
        own: dict[str, list] = {}
        for r in _rows(path):
            if r[2] is not None and blog in ("*", r[2]):
                at = own.setdefault(r[2], [0, None, None, 0])
                at[0] += 1
                at[3] += r[6] or 0
                if r[3] is not None:
                    at[1] = r[3] if at[1] is None else min(at[1], r[3])
                    at[2] = r[3] if at[2] is None else max(at[2], r[3])
        yield from ((k, *v) for k, v in own.items())


class FeedStream(DataSourceStreamReader):
    """Files in order of their names (new ones must come last); the offset is how many there are, and each new one is a task's."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)[start["files"] : end["files"]]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(partition.path)

    def commit(self, end: dict) -> None:
        pass


def _load(spark: SparkSession, **options: object) -> DataFrame:
    spark.dataSource.register(FeedSource)
    return reduce(lambda r, kv: r.option(kv[0], str(kv[1])), ((k, v) for k, v in options.items() if v is not None), spark.read.format("feed")).load()


def page(spark: SparkSession, path: str, blog: str | None = None, tag: str | None = None, before: int | None = None, limit: int = PAGE) -> DataFrame:
    """The ``limit`` newest posts of a blog or a tag before a time: one page of the whole folder, ties to the greater id."""
    return _load(spark, path=path, blog=blog, tag=tag, before=before, limit=limit).orderBy(F.desc_nulls_last("timestamp"), F.desc("id")).limit(limit)


def blog_info(spark: SparkSession, path: str, blog: str = "*") -> DataFrame:
    """(blog_name, posts, first, last, notes) of a blog, or of all."""
    own = _load(spark, path=path, info=blog).groupBy("blog_name")
    return own.agg(F.sum("posts").alias("posts"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("notes").alias("notes"))


def page_back(spark: SparkSession, path: str, take, blog: str | None = None, tag: str | None = None, before: int | None = None, limit: int = PAGE, go_on=lambda: True) -> int | None:
    """Gives page after page, newest first, to ``take`` until one is empty or ``go_on`` says no; the time before which to go on.

    The cursor moves after a page has been taken, so that a crash takes a page twice rather than never.  Posts of one second that a
    page's end falls on come whole: a page of them all takes the place of one that would leave some out.
    """
    while go_on():
        rows = page(spark, path, blog, tag, before, limit)
        last = rows.agg(F.min("timestamp").alias("t"), F.max("timestamp").alias("m")).first()
        if last["t"] is None:
            return before
        if last["t"] < last["m"]:  # posts of the page's last second wait for the next page
            rows, before = rows.where(F.col("timestamp") > last["t"]), last["t"] + 1
        else:
            rows, before = _load(spark, path=path, blog=blog, tag=tag, before=last["t"] + 1).where(F.col("timestamp") == last["t"]), last["t"]
        take(rows)
    return before
