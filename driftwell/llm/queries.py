"""The queries of this folder's operators over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import abuse, frequency, language, leaks, markup, neighbours, pairs, quality, ranking, tokenizer
from driftwell.llm.common import current, table

#: "Now" of the data: a later publication is impossible and counts as unknown.
AS_OF = "2025-07-01 00:00:00"


def _latest(rows: DataFrame, *values: str) -> DataFrame:
    """The values of each post's last version (rows of id, created_at and values)."""
    return current(rows, "id", ["created_at"], *values)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    got = markup.find_residue(table(spark, d, "posts"), "id", "body_clean", "body_raw", ["created_at"])
    return _latest(got, "kinds").select(F.col("id").alias("post_id"), F.explode("kinds.kind").alias("kind"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every post and the form of each of its lines."""
    got = markup.clean_markup(table(spark, d, "posts"), "id", "body_clean", "body_raw", ["created_at"])
    return _latest(got, "text", "lines").withColumnRenamed("id", "post_id")


def _results(spark: SparkSession, d: str) -> DataFrame:
    """One row for each query and post, with the post's current note_count; impossible times are null."""
    rows = table(spark, d, "post_results").where("query_id is not null and post_id is not null")
    rows = rows.groupBy("query_id", "post_id").agg(F.max("score").alias("score"), F.max("note_count").alias("_stale"), F.max("published_at").alias("published_at"))
    posts = current(table(spark, d, "posts").select("id", "created_at", "note_count"), "id", ["created_at", "note_count"], "note_count")
    rows = rows.join(posts.select(F.col("id").alias("post_id"), "note_count", F.lit(True).alias("_known")), "post_id", "left")
    when = F.when((F.col("published_at") <= F.lit(AS_OF).cast("timestamp")) & (F.col("published_at") > F.lit("1970-01-02").cast("timestamp")), F.col("published_at"))
    return rows.select("query_id", "post_id", "score", F.when(F.col("_known"), F.col("note_count")).otherwise(F.col("_stale")).alias("note_count"), when.alias("published_at"))


def p2_order(spark: SparkSession, d: str) -> DataFrame:
    """The whole order of every query's results, with the ranks that make it."""
    got = ranking.median_rank(_results(spark, d), "query_id", "post_id", {"score": 1.0, "note_count": 1.0, "published_at": 1.0})
    return got.select("query_id", "post_id", F.col("median_rank").cast("long").alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), "place")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_order(spark, d).where("place <= 10").select("query_id", "post_id")


def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """How abusive each post is, of which class, and what its own flag says."""
    posts = table(spark, d, "posts")
    got = abuse.score(posts, table(spark, d, "post_labels"), "id", "body_clean", ["created_at", "account_id", "nsfw"], "post_id", "toxic", "created_at")
    return _latest(got, "account_id", "nsfw", "score", "kind").withColumnRenamed("id", "post_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_scores(spark, d).where(F.col("score") >= abuse.LIMIT).select("post_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of abusive posts of each account (null: posts without one), and of those the ones that its flags miss."""
    bad = (F.col("score") >= abuse.LIMIT).cast("long")
    missed = F.sum(F.when(~F.coalesce("nsfw", F.lit(False)), bad).otherwise(0))
    return p3_scores(spark, d).groupBy("account_id").agg(F.count(F.lit(1)).alias("posts"), F.sum(bad).alias("abusive"), missed.alias("missed"), F.round(F.avg(bad), 6).alias("rate"))


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every post with a confidence, the one of most letters first."""
    got = language.detect(table(spark, d, "posts"), "id", "body_clean", ["created_at"])
    got = _latest(got, "languages").select(F.col("id").alias("post_id"), F.posexplode("languages").alias("place", "x"))
    return got.select("post_id", "place", "x.lang", "x.confidence", "x.letters")


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    """The passages of every post: where they stand in body_clean, their language (und where it is none of those known), how sure."""
    got = language.segment(table(spark, d, "posts"), "id", "body_clean", ["created_at"])
    got = _latest(got, "segments").select(F.col("id").alias("post_id"), F.explode("segments").alias("x"))
    return got.select("post_id", "x.start", "x.end", "x.lang", "x.confidence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "post_results").where("post_id is not null").select("post_id", "lang").distinct()
    named = results.withColumn("lang", language.named(F.col("lang"))).where("lang is not null")
    found = p4_languages(spark, d).where(F.col("lang") != language.UNKNOWN).select("post_id", "lang").join(results.select("post_id").distinct(), "post_id", "left_semi")
    return found.join(named, ["post_id", "lang"], "left_anti")


def p5_lift(spark: SparkSession, d: str) -> DataFrame:
    """Every tag pair in five posts or more, with its lift."""
    return pairs.together(table(spark, d, "post_tags"), "post_id", "tag_id", 5, 0.0)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.together(table(spark, d, "post_tags"), "post_id", "tag_id", 5, 10.0).select("tag_a", "tag_b")


def _kinds(spark: SparkSession, d: str, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    both = [of(table(spark, d, t)).select(F.lit(k).alias("kind"), "*") for k, t in (("account", "accounts"), ("tag", "tags"))]
    return both[0].unionByName(both[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _kinds(spark, d, lambda t: neighbours.near_pairs(t, "id", "embedding", 10, 0.82).select("id_a", "id_b"))


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other vectors of every vector of accounts and tags."""
    return _kinds(spark, d, lambda t: neighbours.nearest(t, "id", "embedding", 10)).withColumn("cosine", F.round("cosine", 6))


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and posts of every term, marked."""
    counts = frequency.term_counts(table(spark, d, "post_tags"), table(spark, d, "tags"), "post_id", "tag_id", "id", frequency.tag_term(F.col("name")))
    posts = table(spark, d, "posts").select("id").where("id is not null").distinct().agg(F.count(F.lit(1)).alias("n"))
    return frequency.mark(counts, posts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_counts(spark, d).where("mark is not null").select("term", "mark")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages: how many words of which item, and where in the document."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document and the rules that it fails."""
    return quality.quality(table(spark, d, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_statistics(spark, d).where("not natural").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_clean, p2_found, p2_order, p3_found, p3_scores, p3_rates, p4_found, p4_languages, p4_segments, p5_found, p5_lift, p6_found, p6_neighbours, p7_found, p7_counts, p8_ids, p9_found, p9_passages, p10_found, p10_statistics]
    return {f.__name__: f for f in own}


_TERMS = r"""
terms AS (SELECT id, lower(regexp_replace(regexp_replace(regexp_replace(name, '^\s+|\s+$', '', 'g'), '^#\s*', ''), '\s+$', '')) AS term FROM tags WHERE name IS NOT NULL),
counts AS (SELECT t.term, count(p.tag_id) AS occurrences, count(DISTINCT p.post_id) AS records
  FROM terms t LEFT JOIN (SELECT * FROM post_tags WHERE post_id IS NOT NULL) p ON p.tag_id = t.id WHERE t.term <> '' GROUP BY t.term),
marked AS (SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.02 * (SELECT count(DISTINCT id) FROM posts) THEN 'common' END AS mark FROM counts)
"""
_PAIRS = """
own AS (SELECT DISTINCT post_id AS r, tag_id AS i FROM post_tags WHERE post_id IS NOT NULL AND tag_id IS NOT NULL),
n AS (SELECT i, count(*) AS n FROM own GROUP BY i),
cells AS (SELECT a.i AS tag_a, b.i AS tag_b, count(*) AS n FROM own a JOIN own b ON a.r = b.r AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 5),
lifts AS (SELECT tag_a, tag_b, cells.n AS n, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT r) FROM own) AS total FROM cells JOIN n x ON x.i = tag_a JOIN n y ON y.i = tag_b)
"""
_RANKS = f"""
cur2 AS (SELECT p.id, max(p.note_count) AS note_count FROM posts p JOIN (SELECT id, max(created_at) AS c FROM posts GROUP BY id) m ON m.id = p.id AND m.c = p.created_at GROUP BY p.id),
r AS (SELECT query_id, post_id, max(score) AS score, max(note_count) AS stale, max(published_at) AS pub FROM post_results WHERE query_id IS NOT NULL AND post_id IS NOT NULL GROUP BY 1, 2),
own AS (SELECT query_id, post_id, score, CASE WHEN c.id IS NULL THEN stale ELSE c.note_count END AS note_count,
  CASE WHEN pub <= TIMESTAMPTZ '{AS_OF}+00' AND pub > TIMESTAMPTZ '1970-01-02 00:00:00+00' THEN pub END AS published_at FROM r LEFT JOIN cur2 c ON c.id = r.post_id),
ranks AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST) AS a, rank() OVER (PARTITION BY query_id ORDER BY note_count DESC NULLS LAST) AS b,
  rank() OVER (PARTITION BY query_id ORDER BY published_at DESC NULLS LAST) AS c FROM own),
placed AS (SELECT *, a + b + c - greatest(a, b, c) - least(a, b, c) AS m FROM ranks),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY m, a + b + c, post_id) AS place FROM placed)
"""
_NEAR = """
v AS (SELECT 'account' AS kind, id, embedding::DOUBLE[384] AS e FROM accounts WHERE embedding IS NOT NULL AND len(embedding) = 384 UNION ALL
  SELECT 'tag', id, embedding::DOUBLE[384] FROM tags WHERE embedding IS NOT NULL AND len(embedding) = 384),
ok AS (SELECT * FROM v WHERE array_inner_product(e, e) > 0),
s AS (SELECT a.kind, a.id, b.id AS other, array_cosine_similarity(a.e, b.e) AS cosine FROM ok a JOIN ok b ON a.kind = b.kind AND a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY cosine DESC, other) AS place FROM s)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express over whole tables; the others are tested against brute force."""
    return {
        "p2_found": f"WITH {_RANKS} SELECT query_id, post_id FROM final WHERE place <= 10",
        "p2_order": f"WITH {_RANKS} SELECT query_id, post_id, m AS median_rank, round((a + b + c) / 3.0::DOUBLE, 6) AS mean_rank, place FROM final",
        "p5_found": f"WITH {_PAIRS} SELECT tag_a, tag_b FROM lifts WHERE n * total >= 10 * n_a * n_b",
        "p5_lift": f"WITH {_PAIRS} SELECT tag_a, tag_b, n, n_a, n_b, total, n::DOUBLE * total / (n_a::DOUBLE * n_b) AS lift FROM lifts",
        "p6_found": f"WITH {_NEAR} SELECT DISTINCT kind, least(id, other) AS id_a, greatest(id, other) AS id_b FROM near WHERE place <= 10 AND cosine >= 0.82",
        "p7_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p7_counts": f"WITH {_TERMS} SELECT term, occurrences, records, mark FROM marked",
    }
