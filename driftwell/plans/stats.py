"""Operational statistics, bounded table browsing and read-only SQL."""

from __future__ import annotations

import math
import time
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.config import check_limit

#: Tables that may be browsed, and the columns that are never shown.
BROWSABLE = ("accounts", "posts", "tags", "post_tags", "communities", "crawl_state", "api_keys")
HIDDEN = {"api_keys": ("key_hash",)}


def corpus(posts: DataFrame, accounts: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, n): safe and unsafe posts in one pass, accounts, tags."""
    flag = F.coalesce(F.col("nsfw"), F.lit(False))
    p = posts.agg(F.count_if(~flag).alias("posts_safe"), F.count_if(flag).alias("posts_unsafe")).unpivot([], ["posts_safe", "posts_unsafe"], "name", "n")
    return reduce(DataFrame.unionByName, [p, *[t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in (("accounts", accounts), ("tags", tags))]])


def by_status(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def last_crawl(state: DataFrame) -> DataFrame:
    return state.agg(F.max("last_crawled_at").alias("last_crawled_at"))


def browse(tables: dict[str, DataFrame], name: str, limit: int = 50) -> DataFrame:
    """Up to ``limit`` (1 to 500) rows of a table that may be shown; ValueError for others."""
    check_limit(limit, 1, 500, "limit")
    if name not in BROWSABLE or name not in tables:
        raise ValueError(f"no such table: {name}")
    return tables[name].drop(*HIDDEN.get(name, ())).limit(limit)


def missing_tables(have: list[str], expected: tuple[str, ...] = BROWSABLE) -> list[str]:
    return sorted(set(expected) - set(have))


def latencies(rows: DataFrame, ms: str) -> DataFrame:
    """(mean, p50, p95): p95 is the value at the place floor(0.95 n), counted from 0, of the sorted values; null without values.

    Exact percentiles are folded from counts of distinct values on the way; nothing is collected.
    """
    own = rows.where(F.col(ms).isNotNull())
    n = own.count()
    share = math.floor(0.95 * n) / max(1, n - 1) if n > 1 else 0.0
    return own.agg(F.round(F.avg(ms), 6).alias("mean"), F.round(F.percentile(ms, 0.5), 6).alias("p50"), F.round(F.percentile(ms, min(1.0, share)), 6).alias("p95"))


def _is_query(plan: Any) -> bool:
    """Whether no node of a parsed plan, nor of a plan in its expressions, is a command or a write."""
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        if "Command" in name or name.rsplit(".", 1)[-1].startswith(("InsertInto", "Create", "Drop", "Delete", "Update", "Merge", "Replace", "Alter", "Truncate", "Append", "Overwrite", "Set", "Refresh", "Cache", "Uncache")):
            return False
        for own in (node.children(), node.innerChildren(), node.subqueries()):
            todo += [own.apply(i) for i in range(own.size())]
    return True


def run_sql(spark: SparkSession, text: str, most: int | None = None) -> dict[str, Any]:
    """Rows and milliseconds of a SELECT or WITH query, or its error; nothing that changes data is run.

    The nodes of the parsed plan decide, not its text.  All rows come back; with ``most``, so many, and ``truncated`` tells whether
    there are more.
    """
    began = time.perf_counter()
    try:
        if not text.strip().lower().startswith(("select", "with")):
            raise ValueError("only SELECT and WITH")
        if not _is_query(spark._jsparkSession.sessionState().sqlParser().parsePlan(text)):
            raise ValueError("only queries")
        df = spark.sql(text)
        rows = [r.asDict() for r in (df if most is None else df.limit(most + 1)).collect()]
        cut = most is not None and len(rows) > most
        return {"columns": df.columns, "rows": rows[:most] if cut else rows, "truncated": cut, "ms": (time.perf_counter() - began) * 1000}
    except Exception as e:
        return {"error": str(e).split("\n")[0], "ms": (time.perf_counter() - began) * 1000}
