"""Fusion of ranked lists, reranking, account roll-up and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.config import SearchConfig
from driftwell.functions import scoring


def rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, rrf): the sum of 1 / (k + rank) over the lists, each (key, rank); one aggregation in place of outer joins."""
    parts = [x.select(key, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("_s")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.sum("_s").alias("rrf"))


def min_max(value: str, rows: DataFrame) -> Column:
    """Scaled to [0, 1] over all rows (a bounded candidate list); 1 for all if they are equal."""
    w = Window.partitionBy()
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((F.col(value) - lo) / (hi - lo))


def rerank(fused: DataFrame, posts: DataFrame, as_of: Column, c: SearchConfig, key: str = "id", digits: int = 9) -> DataFrame:
    """(key, account_id, score, place): fused candidates with their posts' engagement and recency, best first.

    The wide columns of ``posts`` are read for the candidates only: at most the two lists' depths, hence the broadcast.
    """
    slim = posts.select(key, "account_id", "note_count", "published_at")
    own = slim.join(F.broadcast(fused), key)
    score = F.round(scoring.rerank(F.col("rrf"), F.col("note_count"), F.col("published_at"), as_of, c), digits)
    own = own.select(key, "account_id", score.alias("score"))
    return own.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), F.desc(key))).cast("long"))


def account_rollup(reranked: DataFrame, vector_scores: DataFrame, depth: int = 200, digits: int = 9) -> DataFrame:
    """(account_id, score): 0.6 of the scaled sum / sqrt(n) of an account's posts and 0.4 of its scaled vector score.

    ``vector_scores`` is (account_id, cosine).  An account missing from a signal has 0 there before scaling.
    """
    a = reranked.where(F.col("place") <= depth).groupBy("account_id").agg((F.sum("score") / F.sqrt(F.count(F.lit(1)))).alias("a"))
    both = a.join(vector_scores.select("account_id", F.col("cosine").alias("b")), "account_id", "full_outer").na.fill(0.0, ["a", "b"])
    total = F.lit(0.6) * min_max("a", both) + F.lit(0.4) * min_max("b", both)
    return both.select("account_id", F.round(total, digits).alias("score"))


def page(reranked: DataFrame, size: int, cursor: str | None = None, tolerance: float = 1e-9, key: str = "id") -> DataFrame:
    """The ``size`` rows after the cursor's: after its item, or, if that is gone, from the first row that scores lower.

    Adds next_cursor to the last row of a page that others follow.
    """
    rows = reranked
    if cursor:
        score, item = scoring.decode_cursor(cursor)
        w = Window.partitionBy()
        at = F.max(F.when(F.col(key) == item, F.col("place"))).over(w)
        below = F.min(F.when(F.col("score") < F.lit(score - tolerance), F.col("place"))).over(w) - 1
        start = F.coalesce(at, below, F.count(F.lit(1)).over(w))
        rows = rows.withColumn("_start", start)
    else:
        rows = rows.withColumn("_start", F.lit(0))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    rows = rows.where((F.col("place") > F.col("_start")) & (F.col("place") <= F.col("_start") + size))
    last = (F.col("place") == F.least(F.col("_start") + size, F.col("_n"))) & (F.col("place") < F.col("_n"))
    return rows.withColumn("next_cursor", F.when(last, scoring.cursor(F.col("score"), F.col(key)))).drop("_start", "_n")
