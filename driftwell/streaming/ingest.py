"""Streaming: feed ingestion into tables, rate limiting, crawl state, windowed statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftwell.functions import vectors as V
from driftwell.operators import gather, ingest
from driftwell.sources.store import BucketTable, Files


class PostSink:
    """Folds micro-batches of feed posts into a posts table in hash buckets; a batch that is run again changes nothing.

    A batch rewrites the buckets that it touches.  Rows without an id or a blog go to the dead letters beside the table.  Of
    several versions of a post in a batch the one of most notes counts.  At ``target`` safe posts further batches are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, target: int | None = None, buckets: int = 64):
        self.spark, self.folder, self.target = spark, folder, target
        self.posts = BucketTable(spark, f"{folder}/posts", "tumblr_id", buckets=buckets)

    def table(self) -> DataFrame | None:
        return self.posts.table()

    def dead(self) -> DataFrame | None:
        """The dead letters of all batches, with the reason."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/dead") if Files(self.spark, f"{self.folder}/dead").exists() else None

    def full(self) -> bool:
        old = self.table() if self.target is not None else None
        return old is not None and old.where("not nsfw").limit(self.target).count() >= self.target

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.full():
            return
        good, bad = ingest.dead_letters(batch)
        bad.select(F.to_json(F.struct(*[c for c in batch.columns])).alias("row"), "reason", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/dead/b{number:012d}")
        self.posts.write(ingest.normalise(good), number, lambda old, new: ingest.upsert(old, new, "tumblr_id", ["note_count", "image_urls"], F.col("note_count"), ("image_urls",)))


class AccountVectorSink:
    """Keeps each account's vector, the unit mean of its last posts' vectors, up to date with micro-batches of post points.

    A batch of (id, vector, account_id, published_at) is folded into the posts' points, and the vectors of the accounts in it, and
    of those alone, are made again.  With ``blocks`` a batch has parts, the numbers of the vectors that a post's vector is the
    mean of, in place of vector: points are as small as that, and their vectors are gathered last.
    """

    def __init__(self, spark: SparkSession, folder: str, window: int = 100, buckets: int = 64, blocks: gather.Blocks | None = None):
        self.points = BucketTable(spark, f"{folder}/points", "account_id", buckets=buckets)
        self.vectors = BucketTable(spark, f"{folder}/vectors", "id", buckets=buckets)
        self.window, self.blocks = window, blocks

    def __call__(self, batch: DataFrame, number: int) -> None:
        if self.blocks is None:
            new = batch.select("id", "account_id", F.col("vector").cast("array<double>").alias("vector"), "published_at").where("id is not null and account_id is not null and vector is not null")
        else:
            new = gather.known(batch.select("id", "account_id", F.col("parts").cast("array<long>").alias("parts"), "published_at").where("id is not null and account_id is not null"), "parts", self.blocks)
        self.points.write(new, number, self._kept)
        touched = new.select("account_id").distinct()
        own = self.points.table().join(touched, "account_id", "left_semi")
        if self.blocks is not None:
            own = gather.means(own.select("account_id", "parts").repartition("account_id").sortWithinPartitions("account_id"), "parts", self.blocks)
        m = V.mean_pool_fast(own, "account_id", "vector", "m", together=self.blocks is not None)
        made = m.select(F.col("account_id").alias("id"), V.normalise(F.col("m")).alias("vector"), F.col("n").alias("posts"))
        self.vectors.write(made, number, lambda old, fresh: ingest.last_write(old, fresh, "id"))

    def _kept(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """The points of each account's last posts: older ones will never count again."""
        every = ingest.last_write(old, new, "id", order=F.col("published_at"))
        order = [F.desc_nulls_last("published_at"), F.desc("id")]
        every = every.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("_r", F.row_number().over(Window.partitionBy("account_id", "_s").orderBy(*order))).where(F.col("_r") <= self.window)
        return every.withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy(*order))).where(F.col("_r") <= self.window).drop("_r", "_s")


def token_bucket(calls: DataFrame, key: str, at: str, capacity: float = 1000, per_seconds: float = 3600) -> DataFrame:
    """(key, at, granted): whether each call finds a token in its key's bucket, which refills evenly.  ``calls`` is a stream.

    Calls of a micro-batch are served in order of time; a call earlier than the bucket's last one doesn't refill it.
    """
    schema = f"`{key}` {calls.schema[key].dataType.simpleString()}, `{at}` timestamp, granted boolean"

    def serve(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(at)
        out = []
        for t in rows[at]:
            now = t.timestamp()
            if last is not None and now > last:
                tokens = min(float(capacity), tokens + (now - last) * capacity / per_seconds)
            last = now if last is None else max(last, now)
            granted = tokens >= 1
            tokens -= granted
            out.append(granted)
        state.update((tokens, last))
        yield pd.DataFrame({key: name[0], at: rows[at].to_numpy(), "granted": out})

    own = calls.select(key, F.col(at).cast("timestamp").alias(at))
    return own.groupBy(key).applyInPandasWithState(serve, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def crawl_states(outcomes: DataFrame, limit: int = 3) -> DataFrame:
    """(blog_name, status, fail_count, last_timestamp) after each micro-batch of (blog_name, at, ok, posts, last_timestamp).

    The state of each blog lives in the stream: three failures in a row make it dead, an empty page done, any page active.
    """
    schema = "blog_name string, status string, fail_count long, last_timestamp long"

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, fails, cursor = state.get if state.exists else ("pending", 0, None)
        for row in pd.concat(list(batches)).sort_values(["at", "last_timestamp"]).itertuples():
            if status in ("dead", "done"):
                continue
            if not row.ok:
                fails += 1
                status = "dead" if fails >= limit else status
            elif row.posts == 0:
                status = "done"
            else:
                status, fails, cursor = "active", 0, int(row.last_timestamp)
        state.update((status, fails, cursor))
        yield pd.DataFrame({"blog_name": [name[0]], "status": [status], "fail_count": [fails], "last_timestamp": pd.array([cursor], dtype="Int64")})

    return outcomes.groupBy("blog_name").applyInPandasWithState(step, schema, "status string, fail_count long, last_timestamp long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, at: str, by: list[str], size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events in tumbling windows, with late rows up to ``late``; a stream or a table."""
    own = events.withWatermark(at, late) if events.isStreaming else events
    return own.groupBy(F.window(at, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs what is there as micro-batches and ends; runs again from the checkpoint's offsets."""
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
