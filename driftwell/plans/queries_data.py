"""Queries of ingestion, crawl state, statistics, streams and ad-hoc SQL, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.config import Filters, SearchConfig
from driftwell.operators import ingest, retrieve
from driftwell.plans import stats
from driftwell.plans.queries_search import CUR, current_posts
from driftwell.schema import FEED_POST, read
from driftwell.sources.store import new_folder
from driftwell.streaming import ingest as streams


def _work(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return new_folder(spark, name)


def table_scan(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "accounts").select("id", "blog_name", "total_posts").where("total_posts is not null")


def browse_limit(spark, d):
    """Ten rows of a table that may be browsed: how many, and that its columns are all there."""
    got = stats.browse({"tags": read(spark, d, "tags")}, "tags", 10)
    return got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")).withColumn("columns", F.lit(",".join(sorted(got.columns))))


def vector_scroll(spark, d):
    """Every vector of a collection."""
    return read(spark, d, "tags").where("embedding is not null").select("id", F.size("embedding").cast("long").alias("size"))


def account_scroll(spark, d):
    """The last five posts of each account, newest first."""
    order = [F.desc_nulls_last("published_at"), F.desc("id")]
    p = current_posts(spark, d).select("id", "account_id", "published_at").withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(32)))
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("account_id", "_s").orderBy(*order))).where("_r <= 5")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("account_id").orderBy(*order)).cast("long")).where("place <= 5").select("account_id", "id", "place")


def optional_filters(spark, d):
    p = current_posts(spark, d)
    for c in retrieve.conditions(Filters(lang="en", date_from="2023-06-01", date_to="2025-01-01", min_notes=5)):
        p = p.where(c)
    return p.select("id")


def type_exclusion(spark, d):
    return ingest.without_types(current_posts(spark, d), "post_type", ("video", "photo")).select("id", "post_type")


def posts_of_accounts(spark, d):
    """Posts with their account's name."""
    return current_posts(spark, d).select("id", "account_id").join(read(spark, d, "accounts").select(F.col("id").alias("account_id"), "blog_name"), "account_id").select("id", "blog_name")


def tags_of_posts(spark, d):
    """Three tables joined and counted: safe posts of each tag name."""
    p = current_posts(spark, d).where(~F.coalesce("nsfw", F.lit(False))).select(F.col("id").alias("post_id"))
    t = read(spark, d, "post_tags").distinct().join(p, "post_id").groupBy("tag_id").agg(F.count(F.lit(1)).alias("posts"))
    return t.join(read(spark, d, "tags").select(F.col("id").alias("tag_id"), "name"), "tag_id").groupBy("name").agg(F.sum("posts").alias("posts"))


def posts_without_tags(spark, d):
    return current_posts(spark, d).select("id").join(read(spark, d, "post_tags").select(F.col("post_id").alias("id")), "id", "left_anti")


def blogs_by_posts(spark, d):
    """Every blog with its number of posts, blogs without any too."""
    n = current_posts(spark, d).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    a = read(spark, d, "accounts").select(F.col("id").alias("account_id"), "blog_name")
    return a.join(n, "account_id", "left").select("blog_name", F.coalesce("n", F.lit(0)).alias("posts"))


#: Posts crawled before this are stored, later ones come as a second batch.
CUT = "2025-03-01 00:00:00"


def _batches(spark, d):
    """Posts in two batches: the first is stored, the second brings later versions of known posts, and new ones."""
    p = read(spark, d, "posts").where("tumblr_id is not null").select("tumblr_id", "account_id", "body_raw", "note_count", "created_at")
    old, order = F.col("created_at") < F.lit(CUT).cast("timestamp"), F.struct("created_at", F.coalesce("note_count", F.lit(-1)))
    first = p.where(old).groupBy("tumblr_id").agg(F.max_by(F.struct("account_id", "body_raw", "note_count"), order).alias("r"))
    return first.select("tumblr_id", "r.account_id", "r.body_raw", "r.note_count"), p.where(~old | F.col("created_at").isNull()).withColumn("body_raw", F.lit("edited"))


def upsert_posts(spark, d):
    """Known posts get the new notes only; unknown ones are added; of several versions the last counts."""
    old, new = _batches(spark, d)
    got = ingest.upsert(old, new, "tumblr_id", ["note_count"], F.struct("created_at", F.coalesce("note_count", F.lit(-1))))
    return got.select("tumblr_id", "account_id", F.md5("body_raw").alias("digest"), F.coalesce("note_count", F.lit(-1)).alias("note_count"))


_UPS = f"""WITH p AS (SELECT tumblr_id, account_id, body_raw, note_count, created_at, coalesce(created_at < TIMESTAMPTZ '{CUT}+00', false) AS old FROM posts WHERE tumblr_id IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY tumblr_id, old ORDER BY created_at DESC, coalesce(note_count, -1) DESC) AS r FROM p),
a AS (SELECT * FROM l WHERE r = 1 AND old), b AS (SELECT tumblr_id, account_id, 'edited' AS body_raw, note_count FROM l WHERE r = 1 AND NOT old)
SELECT coalesce(a.tumblr_id, b.tumblr_id) AS tumblr_id, coalesce(a.account_id, b.account_id) AS account_id, md5(CASE WHEN a.tumblr_id IS NULL THEN b.body_raw ELSE a.body_raw END) AS digest, coalesce(CASE WHEN a.tumblr_id IS NULL THEN b.note_count ELSE coalesce(b.note_count, a.note_count) END, -1) AS note_count FROM a FULL JOIN b ON a.tumblr_id = b.tumblr_id"""


def insert_ignore_accounts(spark, d):
    """New blogs after those known, with ids after the highest one."""
    known = read(spark, d, "accounts").where("total_posts is not null").select("id", "blog_name")
    got = ingest.with_ids(known, read(spark, d, "accounts").select("blog_name"), "blog_name")
    old = known.select("blog_name", F.col("id").alias("known_id"))
    top = known.agg(F.max("id").alias("_top"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("blog_name"))  # an id that two blogs share would have a second place
    return got.withColumn("place", place.cast("long")).join(old, "blog_name", "left").crossJoin(F.broadcast(top)).select("blog_name", "known_id", (F.col("id") > F.col("_top")).alias("fresh"), "place", F.when(F.col("known_id").isNotNull(), F.col("id")).alias("id"))


def count_tag_usage(spark, d):
    """Usage counts after the sightings of all post tags."""
    tags = read(spark, d, "tags").where("usage_count is not null").select("name", "usage_count")
    seen = read(spark, d, "post_tags").join(read(spark, d, "tags").select(F.col("id").alias("tag_id"), "name"), "tag_id").select("name")
    return ingest.count_up(tags, seen)


def insert_ignore_post_tags(spark, d):
    """Pairs of posts with a known time are stored; then all pairs come."""
    t = read(spark, d, "post_tags")
    dated = read(spark, d, "posts").where("published_at is not null").select(F.col("id").alias("post_id"))
    return ingest.insert_ignore(t.join(dated, "post_id", "left_semi").distinct(), t, ["post_id", "tag_id"])


def last_write_vectors(spark, d):
    """Points replaced by id: those of tags without a usage count take the place of the stored ones, and three are new."""
    t = read(spark, d, "tags").where("embedding is not null").select("id", "usage_count", F.size("embedding").cast("long").alias("v"))
    new = t.where("usage_count is null").select("id", F.lit(1).cast("long").alias("v")).unionByName(spark.range(-3, 0).select("id", F.lit(2).cast("long").alias("v")))
    return ingest.last_write(t.drop("usage_count"), new, "id")


def delete_points(spark, d):
    return ingest.delete(read(spark, d, "tags").select("id"), read(spark, d, "tags").where("usage_count = 0").select("id"), "id")


def page_cursors(spark, d):
    return ingest.page_cursor(current_posts(spark, d).where("published_at is not null").select("account_id", F.unix_seconds("published_at").alias("t")), ["account_id"], "t")


def discover_new_blogs(spark, d):
    """Blogs of reblog trails (posts name them by account) that aren't among the crawled accounts (those with a post count)."""
    a = read(spark, d, "accounts").select("id", "blog_name")
    p = current_posts(spark, d).select(F.array("reblogged_from", "reblogged_root").alias("r"))
    names = p.select(F.explode("r").alias("id")).where("id is not null").join(a, "id").select(F.array(F.struct(F.struct(F.col("blog_name").alias("name")).alias("blog"))).alias("trail"))
    return ingest.discover(names, read(spark, d, "accounts").where("total_posts is not null").select("blog_name"))


def _state(spark, d):
    a = read(spark, d, "accounts")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "active", "paused", "done", "dead")]), (F.pmod("id", F.lit(5)) + 1).cast("int"))
    return a.select("blog_name", "id", F.lit(1000).cast("long").alias("last_timestamp"), F.col("updated_at").alias("last_crawled_at"), status.alias("status"), F.pmod("id", F.lit(3)).alias("fail_count"))


_STATE = "st AS (SELECT blog_name, id, 1000 AS last_timestamp, updated_at AS last_crawled_at, ['pending', 'active', 'paused', 'done', 'dead'][(id % 5 + 1)::INT] AS status, id % 3 AS fail_count FROM accounts)"


def crawl_step(spark, d):
    """The state after a fetch of every blog: some fail, some pages are empty."""
    s = _state(spark, d)
    o = s.select("blog_name", (F.pmod("id", F.lit(4)) != 0).alias("ok"), F.pmod("id", F.lit(6)).alias("posts"), F.col("id").alias("last_timestamp"))
    return ingest.crawl_step(s, o, 0, 10).select("blog_name", "last_timestamp", "status", "fail_count")


_STEP = f"""WITH {_STATE} SELECT blog_name, CASE WHEN id % 4 <> 0 AND id % 6 > 0 THEN id ELSE 1000 END AS last_timestamp,
CASE WHEN id % 4 = 0 AND fail_count + 1 >= 3 THEN 'dead' WHEN id % 4 = 0 THEN status WHEN id % 6 = 0 THEN 'done' ELSE 'active' END AS status, CASE WHEN id % 4 = 0 THEN fail_count + 1 WHEN id % 6 > 0 THEN 0 ELSE fail_count END AS fail_count FROM st"""


def crawl_queue(spark, d):
    return ingest.crawl_queue(_state(spark, d)).select("blog_name", "priority")


def crawl_reset(spark, d):
    """Dead blogs back to pending, unknown seeds added."""
    got = ingest.seed(ingest.reset_dead(_state(spark, d)).select("blog_name", "status", "fail_count"), spark.createDataFrame([("seed-one",), ("seed-two",)], "blog_name string"))
    return got


def crawl_states_listing(spark, d):
    """Active and pending blogs, latest crawl first, never crawled last."""
    s = _state(spark, d).where(F.col("status").isin("active", "pending"))
    return s.orderBy(F.desc_nulls_last("last_crawled_at"), "blog_name").limit(25).select("blog_name", "status")


def threshold_gate(spark, d):
    """Whether ingestion goes on: safe posts against the target."""
    n = current_posts(spark, d).where(~F.coalesce("nsfw", F.lit(False))).agg(F.count(F.lit(1)).alias("indexed"))
    return n.withColumn("open", F.col("indexed") < SearchConfig().target_post_count)


def reindex_ids(spark, d):
    """Safe posts in order of their ids, cut into chunks of a hundred."""
    p = ingest.chunks(current_posts(spark, d).where(~F.coalesce("nsfw", F.lit(False))))
    return p.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def corpus_stats(spark, d):
    return stats.corpus(current_posts(spark, d), read(spark, d, "accounts"), read(spark, d, "tags"))


def crawl_stats(spark, d):
    return stats.by_status(_state(spark, d))


def last_crawled(spark, d):
    return stats.last_crawl(_state(spark, d)).select(F.unix_seconds("last_crawled_at").alias("at"))


def table_counts(spark, d):
    """Rows of each table, in one union."""
    from functools import reduce

    return reduce(DataFrame.unionByName, [read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("accounts", "posts", "tags", "post_tags")])


def latency_stats(spark, d):
    """Mean, median and 95th percentile of the values of click events."""
    e = read(spark, d, "events")
    return stats.latencies(e.where("event_type = 'click'"), "value")


def seed_sets(spark, d):
    """Accounts with a title and a description, and those with a title only."""
    a = read(spark, d, "accounts")
    x, y = a.where("title is not null").select("blog_name"), a.where("description is not null").select("blog_name")
    return x.intersect(y).withColumn("side", F.lit("both")).unionByName(x.exceptAll(y).withColumn("side", F.lit("first")))


def sql_filter_aggregate(spark, d):
    """Conditional counts over the tables through SQL text."""
    current_posts(spark, d).createOrReplaceTempView("dw_posts")
    return spark.sql("SELECT post_type, count(*) AS n, count(*) FILTER (WHERE nsfw) AS flagged, count(*) FILTER (WHERE published_at IS NULL) AS undated FROM dw_posts GROUP BY post_type")


def _view(spark, d, *names):
    for n in names:
        read(spark, d, n).createOrReplaceTempView(n)


_SQL = {
    "sql_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_join_top": "SELECT o_orderkey, c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY o_orderkey, c_mktsegment ORDER BY revenue DESC, o_orderkey LIMIT 20",
    "sql_nations": "SELECT n_name, count(DISTINCT c_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name",
    "sql_rollup": "SELECT coalesce(o_orderpriority, 'all') AS priority, coalesce(o_orderstatus, 'all') AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "sql_window": "SELECT c_custkey, c_nationkey, place FROM (SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS place FROM customer) t WHERE place <= 3",
    "sql_subquery": "SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 100) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09 AND l_quantity > 49) GROUP BY p_brand",
    "sql_cte_union": "WITH a AS (SELECT s_nationkey AS k, s_acctbal AS v FROM supplier), b AS (SELECT c_nationkey AS k, c_acctbal AS v FROM customer) SELECT k, round(sum(v), 2) AS total, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) t GROUP BY k",
}


def _ad_hoc(text):
    def run(spark, d):
        _view(spark, d, "region", "nation", "customer", "supplier", "part", "orders", "lineitem")
        return spark.sql(text)

    return run


def sql_passthrough(spark, d):
    """What the read-only SQL door lets in and keeps out."""
    read(spark, d, "tags").createOrReplaceTempView("dw_tags")
    tries = ["SELECT count(*) AS n FROM dw_tags", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", "DROP TABLE dw_tags", "INSERT INTO dw_tags VALUES (1)", "WITH x AS (SELECT 1 AS a) INSERT INTO dw_tags SELECT a FROM x", "SELECT 'DropTable InsertInto' AS a FROM dw_tags"]
    return spark.createDataFrame([(i, "error" not in stats.run_sql(spark, t, 500)) for i, t in enumerate(tries)], "i int, ran boolean")


def event_windows(spark, d):
    """Events in day windows, as a table."""
    return streams.windowed(read(spark, d, "events"), "ts", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def _stream(spark, d, name, select, files=2):
    """The events as a stream of files, ``files`` in a micro-batch."""
    src = _work(spark, name)
    read(spark, d, "events").select(*select).repartition(4).write.mode("overwrite").parquet(f"{src}/in")
    schema = spark.read.parquet(f"{src}/in").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{src}/in"), src


def stream_windows(spark, d):
    """The same windows from a stream in micro-batches: the table of counts after the last one."""
    s, src = _stream(spark, d, "windows", [F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"])
    last: list[str] = []

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{src}/out/v{number}")
        last[:] = [f"{src}/out/v{number}"]

    streams.run_once(streams.windowed(s, "ts", ["event_type"], late="60 days"), sink, f"{src}/cp", "complete")
    return spark.read.parquet(last[0]).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_ingest(spark, d):
    """Feed posts streamed into the posts table in micro-batches, and the whole input once more: nothing changes."""
    src = _work(spark, "ingest")
    feed = current_posts(spark, d).where("tumblr_id is not null").select(F.col("tumblr_id").alias("id"), F.lit("text").alias("type"), F.concat(F.lit("blog"), "account_id").alias("blog_name"), F.unix_seconds("published_at").alias("timestamp"), F.col("body_raw").alias("body"), F.col("note_count").cast("string").alias("note_count"), F.col("nsfw"))
    feed.repartition(4).write.mode("overwrite").json(f"{src}/in")
    stream = lambda: spark.readStream.schema(FEED_POST).option("maxFilesPerTrigger", 2).json(f"{src}/in")
    sink = streams.PostSink(spark, f"{src}/posts", buckets=8)
    streams.run_once(stream(), sink, f"{src}/cp1")
    again = streams.PostSink(spark, f"{src}/posts", buckets=8)
    streams.run_once(stream(), lambda b, n: again(b, n + 100), f"{src}/cp2")
    return again.table().agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("tumblr_id").alias("ids"), F.sum("note_count").alias("notes"), F.min(F.unix_seconds("published_at")).alias("oldest"), F.max(F.unix_seconds("published_at")).alias("newest"))


_ING = f"WITH {CUR} SELECT count(DISTINCT tumblr_id) AS posts, count(DISTINCT tumblr_id) AS ids, sum(coalesce(note_count, 0))::BIGINT AS notes, min(floor(epoch_us(published_at) / 1000000.0)::BIGINT) AS oldest, max(floor(epoch_us(published_at) / 1000000.0)::BIGINT) AS newest FROM cur WHERE tumblr_id IS NOT NULL"


def stream_token_bucket(spark, d):
    """Calls granted to each user by a bucket of two tokens a day, from a stream of the events in one micro-batch."""
    s, src = _stream(spark, d, "bucket", ["user_id", F.col("ts").cast("timestamp").alias("ts")], 64)
    streams.run_once(streams.token_bucket(s, "user_id", "ts", 2, 86_400), lambda b, n: b.write.mode("overwrite").parquet(f"{src}/out/b={n}"), f"{src}/cp")
    return spark.read.parquet(f"{src}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("granted").cast("long")).alias("granted"))


_BUCKET = """WITH RECURSIVE e AS (SELECT user_id AS u, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT u, i, t, 1.0::DOUBLE AS left_, true AS granted FROM e WHERE i = 1 UNION ALL
  SELECT u, i, t, x - (x >= 1)::INT AS left_, x >= 1 AS granted FROM (SELECT e.u, e.i, e.t, least(2.0, r.left_ + (e.t - r.t) * 2 / 86400) AS x FROM r JOIN e ON e.u = r.u AND e.i = r.i + 1) n)
SELECT u AS user_id, count(*) AS calls, sum(granted::INT)::BIGINT AS granted FROM r GROUP BY u"""


def stream_crawl_state(spark, d):
    """Blogs (users) after a stream of fetches (events) in one micro-batch: the state of each."""
    s, src = _stream(spark, d, "crawl", [F.concat(F.lit("blog"), "user_id").alias("blog_name"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 4 != 0).alias("ok"), (F.col("event_id") % 50).alias("posts"), F.col("event_id").alias("last_timestamp")], 64)
    streams.run_once(streams.crawl_states(s), lambda b, n: b.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{src}/out/b={n}"), f"{src}/cp")
    last = spark.read.parquet(f"{src}/out").groupBy("blog_name").agg(F.max_by(F.struct("status", "fail_count", "last_timestamp"), "n").alias("s"))
    return last.select("blog_name", "s.*")


_CRAWL = """WITH RECURSIVE e AS (SELECT user_id AS u, event_id % 4 <> 0 AS ok, event_id % 50 AS posts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT u, 0::BIGINT AS i, 'pending' AS status, 0::BIGINT AS fails, NULL::BIGINT AS cursor FROM e UNION ALL
  SELECT e.u, e.i, CASE WHEN status IN ('dead', 'done') THEN status WHEN NOT ok AND fails >= 2 THEN 'dead' WHEN NOT ok THEN status WHEN posts = 0 THEN 'done' ELSE 'active' END,
    CASE WHEN status IN ('dead', 'done') THEN fails WHEN NOT ok THEN fails + 1 WHEN posts = 0 THEN fails ELSE 0 END,
    CASE WHEN status IN ('dead', 'done') OR NOT ok OR posts = 0 THEN cursor ELSE event_id END FROM r JOIN e ON e.u = r.u AND e.i = r.i + 1)
SELECT 'blog' || u AS blog_name, arg_max(status, i) AS status, arg_max(fails, i) AS fail_count, max(cursor) FILTER (WHERE i = (SELECT max(i) FROM e WHERE e.u = r.u)) AS last_timestamp FROM r GROUP BY u"""


QUERIES = {
    "table_scan": (table_scan, "SELECT id, blog_name, total_posts FROM accounts WHERE total_posts IS NOT NULL"),
    "browse_limit": (browse_limit, "SELECT count(*) AS n, count(DISTINCT id) AS ids, 'embedding,id,name,usage_count' AS columns FROM (SELECT * FROM tags LIMIT 10)"),
    "vector_scroll": (vector_scroll, "SELECT id, len(embedding) AS size FROM tags WHERE embedding IS NOT NULL"),
    "account_scroll": (account_scroll, f"WITH {CUR} SELECT account_id, id, row_number() OVER (PARTITION BY account_id ORDER BY published_at DESC NULLS LAST, id DESC) AS place FROM cur QUALIFY place <= 5"),
    "optional_filters": (optional_filters, f"WITH {CUR} SELECT id FROM cur WHERE lang = 'en' AND published_at >= TIMESTAMPTZ '2023-06-01 00:00:00+00' AND published_at <= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND note_count >= 5"),
    "type_exclusion": (type_exclusion, f"WITH {CUR} SELECT id, post_type FROM cur WHERE post_type IS NULL OR post_type NOT IN ('video', 'photo')"),
    "posts_of_accounts": (posts_of_accounts, f"WITH {CUR} SELECT cur.id, blog_name FROM cur JOIN accounts a ON a.id = account_id"),
    "tags_of_posts": (tags_of_posts, f"WITH {CUR} SELECT name, count(*) AS posts FROM (SELECT DISTINCT post_id, tag_id FROM post_tags) p JOIN safe ON safe.id = post_id JOIN tags t ON t.id = tag_id GROUP BY name"),
    "posts_without_tags": (posts_without_tags, f"WITH {CUR} SELECT id FROM cur WHERE id NOT IN (SELECT post_id FROM post_tags WHERE post_id IS NOT NULL)"),
    "blogs_by_posts": (blogs_by_posts, f"WITH {CUR} SELECT blog_name, count(cur.id) AS posts FROM accounts a LEFT JOIN cur ON cur.account_id = a.id GROUP BY blog_name"),
    "upsert_posts": (upsert_posts, _UPS),
    "insert_ignore_accounts": (insert_ignore_accounts, "SELECT blog_name, CASE WHEN total_posts IS NOT NULL THEN id END AS known_id, total_posts IS NULL AS fresh, 1::BIGINT AS place, CASE WHEN total_posts IS NOT NULL THEN id END AS id FROM accounts"),
    "count_tag_usage": (count_tag_usage, "WITH s AS (SELECT name, count(*) AS n FROM post_tags JOIN tags ON tags.id = tag_id GROUP BY name) SELECT coalesce(t.name, s.name) AS name, coalesce(t.u, 0) + coalesce(n, 0) AS usage_count FROM (SELECT name, usage_count AS u FROM tags WHERE usage_count IS NOT NULL) t FULL JOIN s ON s.name = t.name"),
    "insert_ignore_post_tags": (insert_ignore_post_tags, "SELECT DISTINCT post_id, tag_id FROM post_tags"),
    "last_write_vectors": (last_write_vectors, "SELECT id, CASE WHEN usage_count IS NULL THEN 1 ELSE len(embedding) END AS v FROM tags WHERE embedding IS NOT NULL UNION ALL SELECT unnest([-3, -2, -1]), 2"),
    "delete_points": (delete_points, "SELECT id FROM tags WHERE usage_count <> 0 OR usage_count IS NULL"),
    "page_cursors": (page_cursors, f"WITH {CUR} SELECT account_id, min(floor(epoch_us(published_at) / 1000000.0)::BIGINT) AS last_timestamp FROM cur WHERE published_at IS NOT NULL GROUP BY account_id"),
    "discover_new_blogs": (discover_new_blogs, f"WITH {CUR} SELECT DISTINCT blog_name FROM accounts WHERE id IN (SELECT reblogged_from FROM cur UNION SELECT reblogged_root FROM cur) AND total_posts IS NULL"),
    "crawl_step": (crawl_step, _STEP),
    "crawl_queue": (crawl_queue, f"WITH {_STATE} SELECT blog_name, list_position(['pending', 'paused', 'active'], status)::BIGINT AS priority FROM st WHERE status IN ('pending', 'paused', 'active')"),
    "crawl_reset": (crawl_reset, f"WITH {_STATE} SELECT blog_name, CASE WHEN status = 'dead' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead' THEN 0 ELSE fail_count END AS fail_count FROM st UNION ALL SELECT unnest(['seed-one', 'seed-two']), 'pending', 0"),
    "crawl_states_listing": (crawl_states_listing, f"WITH {_STATE} SELECT blog_name, status FROM st WHERE status IN ('active', 'pending') ORDER BY last_crawled_at DESC NULLS LAST, blog_name LIMIT 25"),
    "threshold_gate": (threshold_gate, f"WITH {CUR} SELECT count(*) AS indexed, count(*) < 50000 AS open FROM safe"),
    "reindex_ids": (reindex_ids, f"WITH {CUR} SELECT (r - 1) // 100 AS chunk, count(*) AS n, min(id) AS first FROM (SELECT id, row_number() OVER (ORDER BY id) AS r FROM safe) GROUP BY 1"),
    "corpus_stats": (corpus_stats, f"WITH {CUR} SELECT 'posts_safe' AS name, count(*) AS n FROM safe UNION ALL SELECT 'posts_unsafe', count(*) FROM cur WHERE nsfw UNION ALL SELECT 'accounts', count(*) FROM accounts UNION ALL SELECT 'tags', count(*) FROM tags"),
    "crawl_stats": (crawl_stats, f"WITH {_STATE} SELECT status, count(*) AS n FROM st GROUP BY status"),
    "last_crawled": (last_crawled, "SELECT floor(epoch_us(max(updated_at)) / 1000000.0)::BIGINT AS at FROM accounts"),
    "table_counts": (table_counts, "SELECT 'accounts' AS name, count(*) AS n FROM accounts UNION ALL SELECT 'posts', count(*) FROM posts UNION ALL SELECT 'tags', count(*) FROM tags UNION ALL SELECT 'post_tags', count(*) FROM post_tags"),
    "latency_stats": (latency_stats, "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(list_sort(list(value))[floor(count(*) * 0.95)::INT + 1], 6) AS p95 FROM events WHERE event_type = 'click' AND value IS NOT NULL"),
    "seed_sets": (seed_sets, "SELECT blog_name, CASE WHEN description IS NOT NULL THEN 'both' ELSE 'first' END AS side FROM accounts WHERE title IS NOT NULL"),
    "sql_filter_aggregate": (sql_filter_aggregate, f"WITH {CUR} SELECT post_type, count(*) AS n, count(*) FILTER (WHERE nsfw) AS flagged, count(*) FILTER (WHERE published_at IS NULL) AS undated FROM cur GROUP BY post_type"),
    **{k: (_ad_hoc(v), v) for k, v in _SQL.items()},
    "sql_passthrough": (sql_passthrough, "SELECT i::INT AS i, ran FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, true)) t(i, ran)"),
    "event_windows": (event_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "stream_windows": (stream_windows, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "stream_ingest": (stream_ingest, _ING),
    "stream_token_bucket": (stream_token_bucket, _BUCKET),
    "stream_crawl_state": (stream_crawl_state, _CRAWL),
}
