"""Queries of the file sources and sinks, the vector collections and the programming interface, each beside the SQL that checks it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import ingest
from driftwell.plans import indexing, search, stats
from driftwell.plans.queries_search import BASE, CUR, QUERY, as_of, collection, current_posts, query_vector
from driftwell.schema import read
from driftwell.sources import feed, files
from driftwell.sources.store import BucketTable, new_folder
from driftwell.streaming import ingest as streams


def _lines(spark: SparkSession, rows: DataFrame, name: str) -> str:
    """The text column of ``rows`` as files of lines, with a comment, a blank and a broken line among them."""
    path = new_folder(spark, name)
    extra = spark.createDataFrame([("# a comment",), ("",), ("broken",)], "line string")
    rows.unionByName(extra).write.text(path)
    return path


def file_judgements(spark, d):
    """Judgements written as tab-separated lines and read again."""
    r = read(spark, d, "post_results").where("query_id is not null and post_id is not null and note_count is not null").groupBy("query_id", "post_id").agg(F.max("note_count").alias("n"))
    return files.read_qrels(spark, _lines(spark, r.select(F.concat_ws("\t", "query_id", "post_id", F.col("n") % 4).alias("line")), "qrels"))


def file_queries(spark, d):
    """Search queries of two or three fields."""
    a = read(spark, d, "accounts").where("title is not null and trim(title) <> '' and not contains(title, '\t')")
    line = F.when(F.col("id") % 2 == 0, F.concat_ws("\t", F.col("id"), F.trim("title"))).otherwise(F.concat_ws("\t", F.col("id"), F.trim("title"), F.lit("tag")))
    return files.read_queries(spark, _lines(spark, a.select(line.alias("line")), "queries"))


def file_blocklist(spark, d):
    """Terms of a blocklist, in lower case and once each."""
    return files.read_blocklist(spark, _lines(spark, read(spark, d, "tags").where("name is not null and trim(name) <> '' and not startswith(trim(name), '#')").select(F.upper("name").alias("line")), "block"))


def report_lines(spark, d):
    """A report of statistics written as JSON lines and read again."""
    path = new_folder(spark, "report")
    files.write_report(stats.corpus(current_posts(spark, d), read(spark, d, "accounts"), read(spark, d, "tags")), path)
    return spark.read.json(path).select("name", "n")


def version_swap(spark, d):
    """A table written as a second version: readers see the second."""
    folder, t = new_folder(spark, "versions"), read(spark, d, "tags").select("id", "name")
    files.write_version(t.limit(0), folder, "1")
    files.write_version(t, folder, "2")
    return files.read_version(spark, folder)


def image_copies(spark, d):
    """One image for each post and hash, the first by origin; a post's addresses stand for its images, their lengths for hashes."""
    p = current_posts(spark, d).select(F.col("id").cast("string").alias("post_id"), F.explode("image_urls").alias("origin")).where("origin is not null")
    return files.dedupe_images(p.withColumn("phash", F.length("origin").cast("string")))


def storage_alarm(spark, d):
    """Whether the data folder's files pass a bound."""
    own = files.storage_bytes(spark, d, "*.parquet", 1)
    return own.select((F.col("files") > 0).alias("found"), "over")


def vector_collection(spark, d):
    """A collection of tag vectors: made twice, filled in two batches, one of them again, compacted, and read."""
    folder = new_folder(spark, "collection")
    t = read(spark, d, "tags").where("embedding is not null").select("id", F.col("embedding").alias("vector"), F.coalesce("usage_count", F.lit(0)).alias("usage_count"))
    for _ in range(2):
        own = indexing.bootstrap_collections(spark, folder, {"tags": t.schema})["tags"]
    indexing.upsert_points(own, t, 0)
    indexing.upsert_points(own, t.where("usage_count > 5").withColumn("usage_count", F.lit(-1).cast("long")), 1)
    indexing.upsert_points(own, t, 1)  # known already
    indexing.optimise([own])
    return own.table().select("id", F.size("vector").alias("size"), "usage_count")


def collection_report(spark, d):
    """Rows of each collection after compaction; one that isn't there is reported and stops nothing."""
    folder = new_folder(spark, "report")
    t = read(spark, d, "tags").where("embedding is not null").select("id", "embedding")
    own = indexing.bootstrap_collections(spark, folder, {"tags": t.schema, "accounts": t.schema})
    indexing.upsert_points(own["tags"], t, 0)
    missing = BucketTable(spark, f"{folder}/nowhere", "id")
    return indexing.optimise([*own.values(), missing]).select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("name"), "rows", F.col("error").isNotNull().alias("failed"))


def account_vectors_stream(spark, d):
    """Post points streamed in micro-batches: how many posts each account's vector is made of."""
    src = new_folder(spark, "points")
    p = current_posts(spark, d).join(search.tag_lists(read(spark, d, "post_tags")), "id").select("id", "account_id", "parts", "published_at")
    p.repartition(4).write.parquet(f"{src}/in")
    schema = spark.read.parquet(f"{src}/in").schema
    sink = streams.AccountVectorSink(spark, f"{src}/out", buckets=8, blocks=search.tag_blocks(read(spark, d, "tags")))
    streams.run_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{src}/in"), sink, f"{src}/cp")
    return sink.vectors.table().select(F.col("id").alias("account_id"), "posts")


def _feed(spark, d) -> str:
    """The posts as a folder of feed files."""
    path = new_folder(spark, "feed")
    p = current_posts(spark, d).where("tumblr_id is not null").join(read(spark, d, "accounts").select(F.col("id").alias("account_id"), "blog_name"), "account_id")
    p.select(F.col("tumblr_id").alias("id"), F.lit("text").alias("type"), "blog_name", F.unix_seconds("published_at").alias("timestamp"), F.coalesce("note_count", F.lit(0)).alias("note_count")).repartition(4).write.json(path)
    return path


def feed_page(spark, d):
    """The twenty newest posts of all blogs before a time, over all files of the feed."""
    return feed.page(spark, _feed(spark, d), before=1704067200).select("id", "blog_name", "timestamp")


def feed_blog_info(spark, d):
    """Posts, times and notes of every blog of the feed."""
    return feed.blog_info(spark, _feed(spark, d))


def feed_dead_letters(spark, d):
    """Posts of the feed that lack an id or a blog, with the reason."""
    f = current_posts(spark, d).select(F.when(F.col("id") % 7 != 0, F.col("tumblr_id")).alias("id"), F.when(F.col("id") % 5 != 0, F.lit("blog")).alias("blog_name"), F.col("id").alias("post"))
    return ingest.dead_letters(f)[1].select("post", "reason")


def engine_general(spark, d):
    """The first page through the programming interface."""
    q = query_vector(spark, d)
    t = {n: read(spark, d, n) for n in ("accounts", "tags", "post_tags")}
    held = collection(spark, d)
    e = search.Engine(t | {"posts": held.posts}, lambda texts: np.asarray([q] * len(texts)), as_of(), store=held)
    got = e.general(QUERY, limit_posts=20, limit_accounts=0)
    rows = [(x["id"], x["account_id"], x["blog_name"], float(x["score"]), int(x["place"])) for x in got["posts"]]
    return spark.createDataFrame(rows, "id long, account_id long, blog_name string, score double, place long").withColumn("total", F.lit(got["total"]).cast("long"))


_POINTS = f"""pts AS (SELECT id, account_id FROM cur WHERE account_id IS NOT NULL AND id IN (SELECT DISTINCT post_id FROM post_tags p JOIN tags t ON t.id = p.tag_id WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0))"""
_FEED = "f AS (SELECT tumblr_id AS id, blog_name, floor(epoch_us(published_at) / 1000000.0)::BIGINT AS timestamp, coalesce(note_count, 0) AS notes FROM cur JOIN accounts a ON a.id = account_id WHERE tumblr_id IS NOT NULL)"

QUERIES = {
    "file_judgements": (file_judgements, "SELECT query_id, post_id, (max(note_count) % 4)::INT AS relevance FROM post_results WHERE query_id IS NOT NULL AND post_id IS NOT NULL AND note_count IS NOT NULL GROUP BY 1, 2"),
    "file_queries": (file_queries, "SELECT id::VARCHAR AS query_id, trim(title) AS text, CASE WHEN id % 2 = 0 THEN 'general' ELSE 'tag' END AS type FROM accounts WHERE title IS NOT NULL AND trim(title) <> '' AND NOT contains(title, chr(9))"),
    "file_blocklist": (file_blocklist, "SELECT DISTINCT lower(trim(upper(name))) AS term FROM tags WHERE name IS NOT NULL AND trim(name) <> '' AND NOT starts_with(trim(name), '#') UNION SELECT 'broken'"),
    "report_lines": (report_lines, f"WITH {CUR} SELECT 'posts_safe' AS name, count(*) AS n FROM safe UNION ALL SELECT 'posts_unsafe', count(*) FROM cur WHERE nsfw UNION ALL SELECT 'accounts', count(*) FROM accounts UNION ALL SELECT 'tags', count(*) FROM tags"),
    "version_swap": (version_swap, "SELECT id, name FROM tags"),
    "image_copies": (image_copies, f"WITH {CUR}, u AS (SELECT id::VARCHAR AS post_id, unnest(image_urls) AS origin FROM cur) SELECT post_id, length(origin)::VARCHAR AS phash, min(origin) AS origin FROM u WHERE origin IS NOT NULL GROUP BY 1, 2"),
    "storage_alarm": (storage_alarm, "SELECT true AS found, true AS over"),
    "vector_collection": (vector_collection, "SELECT id, len(embedding)::INT AS size, CASE WHEN usage_count > 5 THEN -1 ELSE coalesce(usage_count, 0) END AS usage_count FROM tags WHERE embedding IS NOT NULL"),
    "collection_report": (collection_report, "SELECT 'tags' AS name, count(*) AS rows, false AS failed FROM tags WHERE embedding IS NOT NULL UNION ALL SELECT 'accounts', 0, false UNION ALL SELECT 'nowhere', NULL, true"),
    "account_vectors_stream": (account_vectors_stream, f"WITH {CUR}, {_POINTS} SELECT account_id, least(count(*), 100) AS posts FROM pts GROUP BY account_id"),
    "feed_page": (feed_page, f"WITH {CUR}, {_FEED} SELECT id, blog_name, timestamp FROM f WHERE timestamp < 1704067200 ORDER BY timestamp DESC, id DESC LIMIT 20"),
    "feed_blog_info": (feed_blog_info, f'WITH {CUR}, {_FEED} SELECT blog_name, count(*) AS posts, min(timestamp) AS "first", max(timestamp) AS "last", sum(notes)::BIGINT AS notes FROM f GROUP BY blog_name'),
    "feed_dead_letters": (feed_dead_letters, f"WITH {CUR}, l AS (SELECT id, id % 7 = 0 OR tumblr_id IS NULL AS a, id % 5 = 0 AS b FROM cur) SELECT id AS post, CASE WHEN a AND b THEN 'no id, no blog_name' WHEN a THEN 'no id' ELSE 'no blog_name' END AS reason FROM l WHERE a OR b"),
    "engine_general": (engine_general, f"WITH {BASE} SELECT rer.id, rer.account_id, a.blog_name, score, place, (SELECT count(*) FROM rer) AS total FROM rer LEFT JOIN accounts a ON a.id = rer.account_id WHERE place <= 20"),
}
