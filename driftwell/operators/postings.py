"""An inverted index: postings laid out by lexeme, so that a query reads its own lexemes' postings only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.functions import text as tx
from driftwell.operators import fulltext

#: Folders that the index is cut into by the hash of the lexeme.
BUCKETS = 64


def build(posts: DataFrame, key: str = "id", text: str = "body_clean", analyser: str = "simple", buckets: int = BUCKETS) -> DataFrame:
    """(lexeme, key, positions, bucket): where each lexeme stands in each text, positions from 1 in order."""
    if analyser == "simple":
        flat = posts.select(key, F.posexplode(tx.simple_terms(F.col(text))).alias("pos", "lexeme")).select(key, "lexeme", (F.col("pos") + 1).alias("pos"))
    else:
        flat = posts.select(key, F.explode(tx.english_terms(F.col(text))).alias("x")).select(key, F.col("x.lexeme").alias("lexeme"), F.col("x.pos").alias("pos"))
    rows = flat.groupBy("lexeme", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))  # one text's places of one lexeme
    return rows.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)))


def write(postings: DataFrame, path: str) -> None:
    """Writes the index by bucket, sorted by lexeme, so that files and row groups are skipped by their statistics.

    Partitions are balanced at run time: a bucket with a very frequent lexeme is cut into several tasks, small ones share one.
    """
    postings.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "lexeme").write.mode("overwrite").partitionBy("bucket").parquet(path)


def bucket_of(spark: SparkSession, lexemes: list[str], buckets: int = BUCKETS) -> list[int]:
    """The buckets of a few lexemes."""
    if not lexemes:
        return []
    return [r.b for r in spark.createDataFrame([(x,) for x in lexemes], "x string").select(F.pmod(F.xxhash64("x"), F.lit(buckets)).alias("b")).distinct().collect()]


def _all_lexemes(node) -> list[str]:
    if node is None:
        return []
    if isinstance(node, fulltext.Not):
        return _all_lexemes(node.part)
    if isinstance(node, fulltext.And | fulltext.Or):
        return list(dict.fromkeys(x for p in node.parts for x in _all_lexemes(p)))
    return fulltext.lexemes(node)


def _needs_others(node) -> bool:
    """Whether texts without any of the query's lexemes can match (a pure exclusion)."""
    return fulltext.satisfied(node, {})


def search(postings: DataFrame, query: str, key: str = "id", analyser: str = "simple", buckets: int = BUCKETS) -> DataFrame:
    """(key, kw_score) of the matching texts, by their postings of the query's lexemes alone; the same as a scan gives.

    ValueError for a query that texts without any of its words match, which an inverted index can't answer.
    """
    node = fulltext.parse(query, analyser)
    kind = postings.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, kw_score double"
    if node is None:
        return postings.sparkSession.createDataFrame([], schema)
    if _needs_others(node):
        raise ValueError("an exclusion alone needs a scan")
    own = _all_lexemes(node)
    hit = postings.where(F.col("bucket").isin(bucket_of(postings.sparkSession, own, buckets)) & F.col("lexeme").isin(own))
    texts = hit.groupBy(key).agg(F.collect_list(F.struct("lexeme", "positions")).alias("_p"))  # as many entries as the query has lexemes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, scores = [], []
            for k, ps in zip(pdf[key], pdf["_p"], strict=True):
                at = {p["lexeme"]: list(p["positions"]) for p in ps}
                if fulltext.satisfied(node, at):
                    keys.append(k)
                    scores.append(fulltext.cover_density(node, at))
            yield pd.DataFrame({key: keys, "kw_score": scores})

    return texts.mapInPandas(run, schema)
