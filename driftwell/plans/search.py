"""The four search modes as plans, and the engine's programming interface."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.config import Filters, SearchConfig, check_limit, check_query
from driftwell.functions import scoring, trigram
from driftwell.functions import vectors as V
from driftwell.operators import fusion, gather, retrieve
from driftwell.plans.store import SearchStore
from driftwell.sources.store import new_folder


def tag_vectors(tags: DataFrame) -> DataFrame:
    """(tag_id, embedding) of the tags that have a vector; null and zero vectors don't count."""
    return tags.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0)).select(F.col("id").alias("tag_id"), "embedding")


def tag_blocks(tags: DataFrame, most: int = gather.BLOCK) -> gather.Blocks:
    """The tags' vectors in blocks of ``most`` bytes in the shared folder."""
    return gather.write(tag_vectors(tags), "tag_id", "embedding", new_folder(tags.sparkSession, "tags"), most)


def tag_lists(post_tags: DataFrame) -> DataFrame:
    """(id, parts): the numbers of each post's tags, each once and in order."""
    pairs = post_tags.where("post_id is not null and tag_id is not null")
    return pairs.groupBy(F.col("post_id").alias("id")).agg(F.sort_array(F.collect_set("tag_id")).alias("parts"))


def post_vectors(post_tags: DataFrame, tags: DataFrame, most: int = gather.BLOCK) -> DataFrame:
    """(id, vector): the mean of the vectors of each post's tags; null and zero tag vectors don't count.

    Only post and tag numbers are shuffled; each task gathers vectors from blocks of ``most`` bytes in the shared folder.  To join
    posts to their vectors, join them to ``tag_lists`` and gather last.
    """
    return gather.means(tag_lists(post_tags), "parts", tag_blocks(tags, most)).select("id", "vector")


def ranked_posts(
    posts: DataFrame, vectors: DataFrame | None, query: str, query_vector: Sequence[float], as_of: Column, filters: Filters | None = None, config: SearchConfig | None = None, post_tags: DataFrame | None = None, tags: DataFrame | None = None, analyser: str | None = None, store: SearchStore | None = None, probes: int | None = None
) -> DataFrame:
    """(id, account_id, score, place): keyword and vector candidates fused by reciprocal rank and reranked, best first.

    With a ``store`` the candidates come from its postings and its vectors (of ``probes`` cells, or exactly), ``vectors`` isn't
    read, and ``posts`` are the store's own; without one the texts and vectors are scanned.
    """
    c, f = config or SearchConfig(), filters or Filters()
    analyser = analyser or c.analyser
    if store is not None:
        kw = retrieve.ranked(store.keyword(query, c.keyword_depth, f, post_tags, tags), "kw_score", "id")
        vec = retrieve.ranked(store.nearest(query_vector, c.vector_depth, f, post_tags, tags, probes), "cosine", "id")
        return fusion.rerank(fusion.rrf([kw, vec], "id", c.rrf_k), store.posts, as_of, c)
    safe = retrieve.allowed(posts, f, post_tags, tags)
    kw = retrieve.ranked(retrieve.keyword_topk(safe, query, c.keyword_depth, analyser), "kw_score", "id")
    near = vectors.join(safe.select("id"), "id", "left_semi")
    vec = retrieve.ranked(retrieve.vector_topk(near, "id", "vector", query_vector, c.vector_depth), "cosine", "id")
    return fusion.rerank(fusion.rrf([kw, vec], "id", c.rrf_k), safe, as_of, c)


def account_scores(reranked: DataFrame, accounts: DataFrame, query_vector: Sequence[float], config: SearchConfig | None = None) -> DataFrame:
    """(account_id, score) of the accounts that the posts or their own vectors point to."""
    c = config or SearchConfig()
    near = retrieve.vector_topk(accounts, "id", "embedding", query_vector, c.account_depth).withColumnRenamed("id", "account_id")
    return fusion.account_rollup(reranked, near, c.rollup_depth)


def post_metadata(ids: DataFrame, posts: DataFrame, accounts: DataFrame, post_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The display columns of candidate posts with their account's name (null without one) and sorted tag names; unsafe posts drop out.

    ``ids`` is a page of candidates, hence the broadcast; tags are collected for those posts only.
    """
    own = posts.where(~F.coalesce(F.col("nsfw"), F.lit(False))).join(F.broadcast(ids.select("id")), "id", "left_semi")
    named = post_tags.join(F.broadcast(ids.select(F.col("id").alias("post_id"))), "post_id", "left_semi").join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    listed = named.groupBy("post_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    out = own.join(accounts.select(F.col("id").alias("account_id"), "blog_name"), "account_id", "left").join(listed, F.col("id") == F.col("post_id"), "left")
    empty = F.array().cast("array<string>")
    return out.select("id", "account_id", "blog_name", "body_clean", F.coalesce("image_urls", empty).alias("image_urls"), "note_count", "published_at", "lang", F.coalesce("tags", empty).alias("tags"))


def search_accounts(accounts: DataFrame, query: str, limit: int = 10, config: SearchConfig | None = None) -> DataFrame:
    """Accounts by exact, prefix and trigram match of the name, in that order, with their score; blank queries find nothing."""
    c = config or SearchConfig()
    q = query.lower().strip()
    exact, prefix = (F.col("blog_name") == q).cast("int"), F.col("blog_name").startswith(q).cast("int")
    own = accounts.where(F.lit(bool(q))).select("blog_name", "total_posts", "avatar_url", "description", exact.alias("is_exact"), prefix.alias("is_prefix"), F.round(trigram.similarity(F.col("blog_name"), F.lit(q)), 6).alias("sim"))
    own = own.where((F.col("sim") > c.similarity_threshold) | (F.col("is_prefix") == 1))
    own = own.orderBy(F.desc("is_exact"), F.desc("is_prefix"), F.desc("sim"), "blog_name").limit(limit)
    score = F.round(scoring.account_name_score(F.col("is_exact"), F.col("is_prefix"), F.col("sim"), F.col("total_posts")), 6)
    return own.select("blog_name", scoring.match_type(F.col("is_exact"), F.col("is_prefix")).alias("match_type"), score.alias("score"), "avatar_url", scoring.snippet(F.col("description"), c.snippet_length).alias("description_snippet"))


def search_tags(tags: DataFrame, query: str, query_vector: Sequence[float], limit: int = 20, config: SearchConfig | None = None) -> DataFrame:
    """Tags by exact, prefix and semantic match, merged by name: an earlier kind keeps the entry, the best cosine counts."""
    c = config or SearchConfig()
    q = query.lower().strip()
    base = tags.where(F.lit(bool(q))).select("id", "name", F.coalesce("usage_count", F.lit(0)).alias("usage_count"))
    exact = base.where(F.col("name") == q).withColumn("kind", F.lit(0))
    prefix = base.where(F.col("name").startswith(q)).orderBy(F.desc("usage_count"), "id").limit(c.prefix_depth).withColumn("kind", F.lit(1))
    near = retrieve.vector_topk(tags.where(F.lit(bool(q))), "id", "embedding", query_vector, c.tag_depth)
    semantic = base.join(F.broadcast(near.select("id")), "id").withColumn("kind", F.lit(2))
    rows = exact.unionByName(prefix).unionByName(semantic).join(F.broadcast(near), "id", "left").na.fill(0.0, ["cosine"])
    merged = rows.groupBy("name").agg(F.min(F.struct("kind", "id", "usage_count")).alias("m"), F.max("cosine").alias("cosine"))
    merged = merged.select(F.col("m.id").alias("tag_id"), "name", F.col("m.kind").alias("kind"), F.col("m.usage_count").alias("usage_count"), "cosine")
    top = F.max(F.log2(F.lit(1) + F.col("usage_count"))).over(Window.partitionBy())  # at most the three depths
    top = F.when(top == 0, F.lit(1.0)).otherwise(top)
    score = F.round(scoring.tag_score((F.col("kind") == 0).cast("double"), F.col("cosine"), F.col("usage_count"), top), 6)
    kinds = F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("semantic")), F.col("kind") + 1)
    return merged.withColumn("score", score).orderBy(F.desc("score"), "kind", "tag_id").limit(limit).select("tag_id", "name", kinds.alias("match_type"), "usage_count", "cosine", "score")


def search_communities(communities: DataFrame, query: str, query_vector: Sequence[float], tags: DataFrame, accounts: DataFrame, limit: int = 10) -> DataFrame:
    """Communities by the cosine of their centroid and their size, with five tags or accounts and a link."""
    near = retrieve.cosine_scores(communities, "id", "centroid", query_vector)
    own = communities.select("id", "name", "type", "member_ids").join(near, "id")
    n = F.coalesce(F.size("member_ids"), F.lit(0)).cast("long")
    top = own.withColumn("member_count", n).withColumn("score", F.round(scoring.community_score(F.col("cosine"), F.col("member_count")), 6)).orderBy(F.desc("score"), "id").limit(limit)
    members = top.select("id", "type", F.explode("member_ids").alias("member"))
    t = members.where("type = 'tag_cluster'").join(tags.select(F.col("id").alias("member"), F.col("name").alias("label"), F.coalesce("usage_count", F.lit(0)).alias("weight")), "member")
    a = members.where("type = 'account_cluster'").join(accounts.select(F.col("id").alias("member"), F.col("blog_name").alias("label")), "member").withColumn("weight", F.lit(0))
    place = Window.partitionBy("id").orderBy(F.desc("weight"), "member")
    both = t.select("id", "type", "member", "label", "weight").unionByName(a.select("id", "type", "member", "label", "weight")).withColumn("p", F.row_number().over(place)).where("p <= 5")
    listed = both.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda x: x["label"]).alias("_l"))
    empty = F.array().cast("array<string>")
    out = top.join(F.broadcast(listed), "id", "left").withColumn("_l", F.coalesce("_l", empty))
    is_tags = F.col("type") == "tag_cluster"
    tag_names, blogs = F.when(is_tags, F.col("_l")).otherwise(empty), F.when(is_tags, empty).otherwise(F.col("_l"))
    return out.select(F.col("id").alias("community_id"), "name", "type", "member_count", tag_names.alias("top_tags"), blogs.alias("top_accounts"), "score", scoring.drill_down(tag_names, query).alias("drill_down"))


class Cache:
    """Results kept for a while; a store or a key that fails is passed over."""

    def __init__(self, ttl: float = 300, most: int = 256, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.clock = ttl, most, clock
        self.held: OrderedDict[str, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0
        self.lock = threading.Lock()

    def get(self, key: str) -> Any:
        with self.lock:
            got = self.held.get(key)
            if got is None or self.clock() - got[0] > self.ttl:
                self.held.pop(key, None)
                self.misses += 1
                return None
            self.held.move_to_end(key)
            self.hits += 1
            return got[1]

    def put(self, key: str, value: Any) -> None:
        with self.lock:
            self.held[key] = (self.clock(), value)
            self.held.move_to_end(key)
            while len(self.held) > self.most:
                self.held.popitem(last=False)

    def clear(self) -> int:
        with self.lock:
            n = len(self.held)
            self.held.clear()
            return n

    def purge(self) -> int:
        """Drops the results that are past their time; gives how many."""
        with self.lock:
            old = [k for k, (at, _) in self.held.items() if self.clock() - at > self.ttl]
            for k in old:
                del self.held[k]
            return len(old)

    def hit_rate(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0


class Engine:
    """Searches over a set of tables with one configuration, an encoder for queries and a result cache."""

    def __init__(self, tables: dict[str, DataFrame], encoder: Callable[[list[str]], np.ndarray], as_of: Column, config: SearchConfig | None = None, store: SearchStore | None = None, probes: int | None = None):
        """``store``, if given, is what posts are searched in; otherwise the tables posts and post_vectors are scanned."""
        self.t, self.encoder, self.as_of, self.c, self.store, self.probes = tables, encoder, as_of, config or SearchConfig(), store, probes
        self.cache = Cache(self.c.cache_ttl_seconds)

    def _cached(self, kind: str, query: str, run: Callable[[], Any], **parts: Any) -> Any:
        key = scoring.cache_key(kind, query, **parts)
        got = self.cache.get(key)
        if got is None:
            got = run()
            self.cache.put(key, got)
        return got

    def general(self, query: str, filters: Filters | None = None, limit_posts: int = 20, limit_accounts: int = 5, cursor: str | None = None) -> dict:
        q = check_query(query)
        check_limit(limit_posts, 1, 100, "limit_posts")
        check_limit(limit_accounts, 0, 50, "limit_accounts")
        if cursor:
            scoring.decode_cursor(cursor)

        def run() -> dict:
            v = [float(x) for x in self.encoder([q])[0]]
            ranked = ranked_posts(self.t["posts"], self.t.get("post_vectors"), q, v, self.as_of, filters, self.c, self.t.get("post_tags"), self.t.get("tags"), store=self.store, probes=self.probes).persist()
            try:
                page = fusion.page(ranked, limit_posts, cursor, self.c.cursor_tolerance)
                rows = page.join(post_metadata(page, self.t["posts"], self.t["accounts"], self.t["post_tags"], self.t["tags"]).drop("account_id"), "id").orderBy("place").collect()
                found = account_scores(ranked, self.t["accounts"], v, self.c).orderBy(F.desc("score"), "account_id").limit(limit_accounts).collect() if limit_accounts else []
                total = ranked.count()
            finally:
                ranked.unpersist()
            return {"posts": [r.asDict() for r in rows], "accounts": [r.asDict() for r in found], "total": total, "next_cursor": next((r["next_cursor"] for r in rows if r["next_cursor"]), None)}

        return self._cached("general", q, run, filters=filters or Filters(), posts=limit_posts, accounts=limit_accounts, cursor=cursor)

    def accounts(self, query: str, limit: int = 10) -> list[dict]:
        q = check_query(query, 100)
        check_limit(limit, 1, 50, "limit")
        return self._cached("accounts", q, lambda: [r.asDict() for r in search_accounts(self.t["accounts"], q, limit, self.c).collect()], limit=limit)

    def tags(self, query: str, limit: int = 20) -> list[dict]:
        q = check_query(query, 100)
        check_limit(limit, 1, 100, "limit")
        return self._cached("tags", q, lambda: [r.asDict() for r in search_tags(self.t["tags"], q, [float(x) for x in self.encoder([q])[0]], limit, self.c).collect()], limit=limit)

    def communities(self, query: str, limit: int = 10) -> list[dict]:
        q = check_query(query, 100)
        check_limit(limit, 1, 50, "limit")
        run = lambda: [r.asDict() for r in search_communities(self.t["communities"], q, [float(x) for x in self.encoder([q])[0]], self.t["tags"], self.t["accounts"], limit).collect()]
        return self._cached("communities", q, run, limit=limit)

    def dispatch(self, kind: str, query: str, limit: int = 20) -> Any:
        """The search of a kind; unknown kinds are general."""
        own = {"accounts": self.accounts, "account": self.accounts, "tags": self.tags, "tag": self.tags, "communities": self.communities, "community": self.communities}.get(kind)
        return own(query, limit) if own else self.general(query, limit_posts=limit)
