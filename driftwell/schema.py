"""Schemas of the tables and of the semi-structured feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
VECTOR = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ACCOUNTS = _struct(id=L, blog_name=S, title=S, description=S, avatar_url=S, total_posts=L, updated_at=TS, embedding=VECTOR, created_at=TS)
POSTS = _struct(
    id=L, tumblr_id=L, account_id=L, post_type=S, body_raw=S, body_clean=S, image_urls=T.ArrayType(S), note_count=L, reblog_key=S, reblogged_from=L, reblogged_root=L, nsfw=B, nsfw_score=D, lang=S, published_at=TS, created_at=TS
)
TAGS = _struct(id=L, name=S, usage_count=L, embedding=VECTOR)
POST_TAGS = _struct(post_id=L, tag_id=L)
COMMUNITIES = _struct(id=L, name=S, centroid=VECTOR, type=S, member_ids=T.ArrayType(L), updated_at=TS)
CRAWL_STATE = _struct(blog_name=S, last_timestamp=L, last_crawled_at=TS, status=S, fail_count=L)
TABLES = {"accounts": ACCOUNTS, "posts": POSTS, "tags": TAGS, "post_tags": POST_TAGS, "communities": COMMUNITIES, "crawl_state": CRAWL_STATE}

#: A post as the feed delivers it; which fields are filled depends on its type.
FEED_POST = _struct(
    id=L, type=S, blog_name=S, timestamp=L, body=S, title=S, caption=S, text=S, description=S, question=S, answer=S, note_count=S, reblog_key=S, tags=T.ArrayType(S), nsfw=B,
    dialogue=T.ArrayType(_struct(label=S, phrase=S)),
    photos=T.ArrayType(_struct(original_size=_struct(url=S, width=L, height=L), alt_sizes=T.ArrayType(_struct(url=S, width=L, height=L)))),
    trail=T.ArrayType(_struct(blog=_struct(name=S))), reblogged_from_name=S, reblogged_root_name=S,
)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{d}/{name}.parquet")
