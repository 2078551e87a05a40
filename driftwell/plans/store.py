"""A stored search collection: what a query needs, laid out once so that it reads little of it.

posts (last versions, in order of their ids), vectors with their payload by cell, postings by bucket.  Pooling and analysing is done when it
is built; a query reads its words' postings, the cells nearest to its vector (or all, for the exact answer), and the posts found.
Where posts' vectors are means of others (their tags'), those are stored once in blocks and each post has their numbers alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.config import Filters
from driftwell.operators import fulltext, gather, ivf, postings, retrieve
from driftwell.sources.store import Files, new_folder

#: Vectors in a cell aimed at, and cells at least and at most.
CELL, CELLS = 2000, (16, 4096)
PAYLOAD = ("account_id", "nsfw", "note_count", "lang", "published_at")


class SearchStore:
    """Opens a collection that ``build`` made."""

    def __init__(self, spark: SparkSession, folder: str):
        held = json.loads(Files(spark, folder).read("store.json"))
        self.spark, self.folder, self.analyser, self.buckets = spark, folder, held["analyser"], held["buckets"]
        self.centroids = np.asarray(held["centroids"], np.float32)
        self.blocks = gather.Blocks.of(held["blocks"]) if held.get("blocks") else None
        self.posts = spark.read.parquet(f"{folder}/posts")
        self.vectors = spark.read.schema(T.StructType.fromJson(held["vectors"])).parquet(f"{folder}/vectors")  # there may be none
        self.postings = spark.read.parquet(f"{folder}/postings")

    @classmethod
    def build(cls, spark: SparkSession, posts: DataFrame, vectors: DataFrame, analyser: str = "simple", folder: str | None = None, buckets: int = postings.BUCKETS, parts: DataFrame | None = None) -> SearchStore:
        """Writes a collection of ``posts`` (one row for each id) and ``vectors`` (id, vector), to a new shared folder by default.

        With ``parts`` (a number and a vector), ``vectors`` is (id, parts): the numbers of those that a post's vector is the mean of.
        A query reads a bucket of the postings for each of its words: take so many that a bucket is of a few hundred megabytes.
        """
        folder = folder or new_folder(spark, "store")
        pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
        posts.repartitionByRange(pieces, "id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{folder}/posts")
        own = spark.read.parquet(f"{folder}/posts")
        postings.write(postings.build(own, analyser=analyser, buckets=buckets), f"{folder}/postings")
        vectors.join(own.select("id", *PAYLOAD), "id").write.mode("overwrite").parquet(f"{folder}/flat")
        flat = spark.read.parquet(f"{folder}/flat")
        n = flat.count()
        cells = int(min(max(n // CELL, CELLS[0]), CELLS[1]))
        blocks = gather.write(parts, *parts.columns, f"{folder}/parts") if parts is not None else None
        try:
            at = ivf.fit_gathered(flat, "parts", blocks, n, cells) if blocks else ivf.fit_cells(flat, "id", "vector", cells)
            placed = ivf.assign_gathered(flat, "parts", blocks, at) if blocks else ivf.assign(flat, "id", "vector", at, keep=PAYLOAD)
        except ivf.NoVectors:
            at, placed = np.zeros((0, 0), np.float32), flat.withColumn("cell", F.lit(0)).limit(0)
        placed.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/vectors")
        files = Files(spark, folder)
        files.own.delete(files.path("flat"), True)
        files.write("store.json", json.dumps({"analyser": analyser, "buckets": buckets, "centroids": at.tolist(), "blocks": blocks and blocks.json(), "vectors": placed.schema.jsonValue()}))
        return cls(spark, folder)

    def keyword(self, query: str, k: int, f: Filters, post_tags: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
        """(id, kw_score): the ``k`` best posts that match and pass the filters; an exclusion alone is looked up in the texts."""
        ok = retrieve.allowed(self.posts, f, post_tags, tags)
        node = fulltext.parse(query, self.analyser)
        if node is not None and fulltext.satisfied(node, {}):
            return retrieve.keyword_topk(ok, query, k, self.analyser)
        hits = postings.search(self.postings, query, analyser=self.analyser, buckets=self.buckets).join(ok.select("id"), "id", "left_semi")
        return retrieve.top(hits.withColumn("kw_score", F.round("kw_score", 9)), "kw_score", "id", k)

    def nearest(self, query: Sequence[float], k: int, f: Filters, post_tags: DataFrame | None = None, tags: DataFrame | None = None, probes: int | None = None) -> DataFrame:
        """(id, cosine): the ``k`` most similar posts that pass the filters, from the ``probes`` nearest cells, or exactly from all."""
        ok = retrieve.allowed(self.vectors, f, post_tags, tags)
        if probes is not None and probes < len(self.centroids):
            ok = ok.where(F.col("cell").isin(ivf.nearest_cells(self.centroids, query, probes)))
        if self.blocks:
            return retrieve.gathered_topk(ok, "id", "parts", self.blocks, query, k)
        return retrieve.vector_topk(ok, "id", "vector", query, k)


_held: dict[tuple, SearchStore] = {}


def stored(spark: SparkSession, key: tuple, make) -> SearchStore:
    """The collection of ``key`` (which tells the state of what it is made from), built by ``make`` when it is first asked for.

    One whose files have been cleared away is built again.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key in _held:
        files = Files(spark, _held[key].folder)
        held = [f"parts/{b[0]}" for b in _held[key].blocks.held] if _held[key].blocks else []
        if not all(files.exists(x) for x in ("store.json", "posts/_SUCCESS", "vectors/_SUCCESS", "postings/_SUCCESS", *held)):
            del _held[key]
    if key not in _held:
        _held[key] = make()
    return _held[key]


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Size, number of files and time of change of each path."""
    out = []
    for p in paths:
        f = Files(spark, p)
        s = f.own.getContentSummary(f.path())
        out.append((p, s.getLength(), s.getFileCount(), f.own.getFileStatus(f.path()).getModificationTime()))
    return tuple(out)
