"""Offline ranking evaluation over (query, place, grade) rows."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(run: DataFrame, query: str = "query_id", place: str = "place", grade: str = "grade", k: int = 10, recall_k: int = 100, relevant: DataFrame | None = None) -> DataFrame:
    """(query, dcg, ndcg, rr, recall, ap) of each query's result list.

    The ideal order is that of the returned grades; average precision is divided by the hits.  ``relevant`` is (query, n): how many
    items are relevant in all (default: those returned).
    """
    g = F.coalesce(F.col(grade).cast("double"), F.lit(0.0))
    own = run.select(query, F.col(place).alias("_p"), g.alias("_g"))
    ideal = Window.partitionBy(query).orderBy(F.desc("_g"), "_p")
    hit = (F.col("_g") >= 1).cast("int")
    so_far = F.sum(hit).over(Window.partitionBy(query).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_i", F.row_number().over(ideal)).withColumn("_h", hit).withColumn("_c", so_far)
    gain = lambda p: F.sum(F.when(F.col(p) <= k, F.col("_g") / F.log2(F.col(p) + 1)))
    out = own.groupBy(query).agg(
        F.coalesce(gain("_p"), F.lit(0.0)).alias("dcg"),
        F.coalesce(gain("_i"), F.lit(0.0)).alias("_idcg"),
        F.coalesce(F.lit(1.0) / F.min(F.when(F.col("_h") == 1, F.col("_p"))), F.lit(0.0)).alias("rr"),
        F.sum(F.when(F.col("_p") <= recall_k, F.col("_h")).otherwise(0)).alias("_found"),
        F.sum("_h").alias("_hits"),
        F.sum(F.when(F.col("_h") == 1, F.col("_c") / F.col("_p")).otherwise(0.0)).alias("_prec"),
    )
    if relevant is not None:
        out = out.join(relevant.toDF(query, "_rel"), query, "left").na.fill(0, ["_rel"])
    else:
        out = out.withColumn("_rel", F.col("_hits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(query, "dcg", ratio("dcg", "_idcg").alias("ndcg"), "rr", ratio("_found", "_rel").alias("recall"), ratio("_prec", "_hits").alias("ap"))


def summary(per_query: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Means of the metrics, over all queries or by type, rounded."""
    aggs = [F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), digits).alias(c) for c in ("ndcg", "rr", "recall", "ap")]]
    return per_query.groupBy(*(by or [])).agg(*aggs)


def grid_metrics(lists: DataFrame, configs: list[tuple], query: str = "query_id", k: int = 10) -> DataFrame:
    """(config, query, ndcg) of each query's list under every configuration of ``grid``.

    ``lists`` is (query, r), r an array of (post_id, p1, p2, notes, g): a result's two ranks, its notes and its grade.  A query's
    lists are ordered in one task, an Arrow batch of queries at a time; ties go to the smaller post_id.
    """
    g = np.asarray([c[1:] for c in configs], float)
    names = np.asarray([c[0] for c in configs], np.int32)
    kind = lists.schema[query].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, r in zip(pdf[query], pdf["r"], strict=True):
                r = sorted(r, key=lambda x: x["post_id"])
                p1, p2, notes, grade = (np.asarray([x[c] for x in r], float) for c in ("p1", "p2", "notes", "g"))
                base = g[:, 0, None] / (g[:, 3, None] + p1) + g[:, 1, None] / (g[:, 3, None] + p2)
                score = np.round(base * (1 + g[:, 4, None] * np.log2(1 + notes)), 9)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                gain = 1 / np.log2(np.arange(2, top.shape[1] + 2))
                best = (np.sort(grade)[::-1][: len(gain)] * gain).sum()
                out.append(pd.DataFrame({"config": names, query: q, "ndcg": (grade[top] * gain).sum(axis=1) / best if best > 0 else 0.0}))
            if out:
                yield pd.concat(out)

    return lists.select(query, "r").mapInPandas(run, f"config int, `{query}` {kind}, ndcg double")


def split_rows(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows): the keys in the order of their salted hash, the first ``share`` of them for training.

    The same keys fall on the same side whatever the partitioning.
    """
    keys = rows.select(key).distinct().select(key, F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))).alias("_h"))
    place = F.row_number().over(Window.orderBy("_h", key))  # evaluation queries, each judged by hand: thousands
    keys = keys.withColumn("_train", place <= F.floor(F.lit(share) * F.count(F.lit(1)).over(Window.partitionBy())))
    own = rows.join(F.broadcast(keys.select(key, "_train")), key)
    return own.where("_train").drop("_train"), own.where("not _train").drop("_train")


def split(keys: list, share: float = 0.8, seed: int = 42) -> tuple[list, list]:
    """A seeded split of the sorted keys into training and test."""
    own = sorted(keys)
    random.Random(seed).shuffle(own)
    n = int(len(own) * share)
    return own[:n], own[n:]


#: The grid of weights and constants.
GRID = {"w_t": (0.4, 0.5, 0.6), "w_i": (0.25, 0.35), "rrf_k": (30, 60, 90), "boost": (0.05, 0.1, 0.2)}


def grid() -> list[tuple[int, float, float, float, int, float]]:
    """(config, text, image and tag weight, RRF constant, boost) of every combination whose tag weight is positive."""
    rows = [(wt, wi, round(1 - wt - wi, 4), k, b) for wt, wi, k, b in product(*GRID.values())]
    return [(i, *r) for i, r in enumerate(r for r in rows if r[2] > 0)]


def best(scores: DataFrame, config: str = "config", score: str = "ndcg") -> DataFrame:
    """The first configuration of highest mean score."""
    return scores.groupBy(config).agg(F.avg(score).alias("mean")).orderBy(F.desc(F.round("mean", 9)), config).limit(1)
