"""Ingestion of feed posts: normalising, upserts, discovery, crawl state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import text as tx
from driftwell.sources.store import cut

#: Post types that are never stored.
EXCLUDED = ("video",)


def without_types(rows: DataFrame, column: str = "type", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """``rows`` whose type isn't excluded; an unknown type stays."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*excluded))


def normalise(feed: DataFrame) -> DataFrame:
    """Feed posts as rows of posts: body by type, clean text, image addresses, time and notes; excluded types are left out.

    Columns that the feed lacks count as null.
    """
    have = set(feed.columns)
    col = lambda n, kind: F.col(n) if n in have else F.lit(None).cast(kind)
    parts = {n: col(n, "string") for n in ("body", "title", "caption", "text", "description", "question", "answer")}
    parts["dialogue"] = col("dialogue", "array<struct<label:string,phrase:string>>")
    raw = tx.body(F.col("type"), parts)
    rows = without_types(feed).where(F.col("id").isNotNull())
    photos = col("photos", "array<struct<original_size:struct<url:string>>>")
    return rows.select(
        F.col("id").alias("tumblr_id"),
        F.col("blog_name"),
        F.col("type").alias("post_type"),
        raw.alias("body_raw"),
        tx.clean_html(raw).alias("body_clean"),
        tx.image_urls(photos).alias("image_urls"),
        F.coalesce(col("note_count", "string").try_cast("long"), F.lit(0)).alias("note_count"),
        col("reblog_key", "string").alias("reblog_key"),
        F.coalesce(col("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
        F.timestamp_seconds(col("timestamp", "bigint")).alias("published_at"),
        F.coalesce(col("nsfw", "boolean"), F.lit(False)).alias("nsfw"),
    )


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` and the rows of ``new`` whose keys it lacks, one for each key."""
    fresh = new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh, allowMissingColumns=True)


def with_ids(table: DataFrame, new: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """``table`` and the new keys of ``new`` with ids after the highest one, in the order of the keys.

    Numbers are given by hash part and place in it, so no task sees all keys.
    """
    parts = max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fresh = new.select(key).where(F.col(key).isNotNull()).distinct().join(table.select(key), key, "left_anti").withColumn("_p", F.pmod(F.xxhash64(key), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    counts = fresh.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))  # a row for each part
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    fresh = fresh.withColumn("_place", place).join(F.broadcast(counts), "_p").crossJoin(F.broadcast(top))  # one row
    return table.unionByName(fresh.select((F.col("_top") + F.col("_from") + F.col("_place")).alias(id_col), key), allowMissingColumns=True)


def last_of(new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row for each ``key``: the last by ``order``, ties by the greatest row; rows with a null key are left out.

    Folded by a map-side maximum, so a key with many rows is no hot group.
    """
    cols = [c for c in new.columns if c != key]
    rank = F.struct(*([order.alias("_o")] if order is not None else []), F.to_json(F.struct(*cols)).alias("_j"))
    best = F.max_by(F.struct(*cols), rank).alias("_r")
    return new.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def upsert(table: DataFrame, new: DataFrame, key: str, refresh: list[str], order: Column | None = None, overwrite: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with the rows of ``new``: known keys get the ``refresh`` columns only, others are added.

    A null in ``new`` keeps the old value, but for the columns of ``overwrite``.  Of several new rows of a key the last by
    ``order`` counts (the greatest without one).
    """
    new = last_of(new, key, order)
    t, n = table.alias("t"), new.alias("n")
    own = t.join(n, F.col(f"t.{key}") == F.col(f"n.{key}"), "full_outer")
    known = F.col(f"t.{key}").isNotNull()
    out = []
    for c in table.columns:
        new_c = F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c == key:
            out.append(F.coalesce(F.col(f"t.{c}"), new_c).alias(c))
        elif c in refresh and c in new.columns:
            seen = F.col(f"n.{key}").isNotNull()
            kept = F.when(seen, new_c).otherwise(F.col(f"t.{c}")) if c in overwrite else F.coalesce(new_c, F.col(f"t.{c}"))
            out.append(F.when(known, kept).otherwise(new_c).alias(c))
        else:
            out.append(F.when(known, F.col(f"t.{c}")).otherwise(new_c).alias(c))
    return own.select(*out)


def count_up(tags: DataFrame, seen: DataFrame, key: str = "name", counter: str = "usage_count") -> DataFrame:
    """``tags`` with the number of new sightings added; unseen keys are added with their number."""
    delta = seen.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_d"))
    own = tags.join(delta, key, "full_outer")
    rest = [c for c in tags.columns if c not in (key, counter)]
    return own.select(*rest, key, (F.coalesce(F.col(counter), F.lit(0)) + F.coalesce("_d", F.lit(0))).alias(counter)).select(*tags.columns)


def last_write(table: DataFrame, new: DataFrame, key: str, required: list[str] | None = None, order: Column | None = None) -> DataFrame:
    """Vector points replaced or added by key; ValueError if a required payload column is missing.

    Of several new points of a key the last by ``order`` counts (the greatest without one).
    """
    lacking = [c for c in required or [] if c not in new.columns]
    if lacking:
        raise ValueError(f"missing payload: {', '.join(lacking)}")
    return table.join(new.select(key), key, "left_anti").unionByName(last_of(new, key, order), allowMissingColumns=True)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def page_cursor(page: DataFrame, by: list[str], timestamp: str) -> DataFrame:
    """Where the next page starts: the earliest time of this one."""
    return page.groupBy(*by).agg(F.min(timestamp).alias("last_timestamp"))


def discover(feed: DataFrame, known: DataFrame, trail: str = "trail", name: str = "blog_name") -> DataFrame:
    """(blog_name): blogs of reblog trails that aren't known yet."""
    names = feed.select(F.explode(F.col(trail)).alias("_t")).select(F.col("_t.blog.name").alias(name))
    return names.where(F.col(name).isNotNull() & (F.col(name) != "")).distinct().join(known.select(name), name, "left_anti")


def crawl_step(state: DataFrame, outcomes: DataFrame, indexed: int, target: int, limit: int = 3) -> DataFrame:
    """The crawl state after one fetch of each blog.

    ``outcomes`` is (blog_name, ok, posts, last_timestamp).  At the target a blog pauses; a failure counts up and the third in a
    row marks it dead; an empty page ends it; any page resets the count and moves the cursor.  Blogs without an outcome stay.
    """
    own = state.alias("s").join(outcomes.alias("o"), "blog_name", "left")
    got = F.col("o.ok").isNotNull()
    full = F.lit(indexed >= target)
    fails = F.when(got & ~full & ~F.col("o.ok"), F.coalesce("s.fail_count", F.lit(0)) + 1).when(got & ~full & (F.col("o.posts") > 0), 0).otherwise(F.coalesce("s.fail_count", F.lit(0)))
    status = (
        F.when(~got, F.col("s.status"))
        .when(full, "paused")
        .when(~F.col("o.ok") & (fails >= limit), "dead")
        .when(~F.col("o.ok"), F.col("s.status"))
        .when(F.col("o.posts") == 0, "done")
        .otherwise("active")
    )
    moved = F.when(got & ~full & F.col("o.ok") & (F.col("o.posts") > 0), F.col("o.last_timestamp")).otherwise(F.col("s.last_timestamp"))
    return own.select("blog_name", moved.alias("last_timestamp"), F.col("s.last_crawled_at").alias("last_crawled_at"), status.alias("status"), fails.cast("long").alias("fail_count"))


#: The order in which blogs are taken up.
PRIORITY = ("pending", "paused", "active")


def crawl_queue(state: DataFrame) -> DataFrame:
    """Blogs to crawl, pending before paused before active."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("status"))
    return state.where(F.col("status").isin(*PRIORITY)).withColumn("priority", place).orderBy("priority", "blog_name")


def reset_dead(state: DataFrame) -> DataFrame:
    """Dead blogs back to pending without failures."""
    dead = F.col("status") == "dead"
    return state.withColumn("fail_count", F.when(dead, 0).otherwise(F.col("fail_count")).cast("long")).withColumn("status", F.when(dead, "pending").otherwise(F.col("status")))


def chunks(ids: DataFrame, key: str = "id", size: int = 100) -> DataFrame:
    """(key, chunk): the distinct keys in order, cut into runs of ``size``.

    The keys are range-partitioned; a partition numbers its own, and one number for each carries over.
    """
    own = ids.select(key).where(F.col(key).isNotNull()).distinct()
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(own.repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()))
    counts = own.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))  # a row for each part
    place = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return own.withColumn("_place", place).join(F.broadcast(counts), "_p").select(key, F.floor((F.col("_from") + F.col("_place")) / size).cast("long").alias("chunk"))


def dead_letters(feed: DataFrame, need: tuple[str, ...] = ("id", "blog_name")) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with their reason): a dead letter lacks one of the needed fields."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in need]))
    own = feed.withColumn("_lacking", lacking)
    return own.where(F.size("_lacking") == 0).drop("_lacking"), own.where(F.size("_lacking") > 0).withColumn("reason", F.array_join("_lacking", ", ")).drop("_lacking")


def seed(state: DataFrame, names: DataFrame) -> DataFrame:
    """``state`` with unknown seed blogs as pending."""
    fresh = names.select("blog_name").distinct().withColumn("status", F.lit("pending")).withColumn("fail_count", F.lit(0).cast("long"))
    return insert_ignore(state, fresh, ["blog_name"])
