"""Candidate lists: filters, keyword top-k, vector top-k."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwell.config import Filters
from driftwell.functions import vectors as V
from driftwell.operators import fulltext, gather


def conditions(f: Filters, notes: str = "note_count", published: str = "published_at", lang: str = "lang") -> list[Column]:
    """A condition for each filter that is set; rows with a null in its column don't pass."""
    out: list[Column] = []
    if f.lang is not None:
        out.append(F.col(lang) == f.lang)
    if f.date_from is not None:
        out.append(F.col(published) >= F.lit(f.date_from).cast("timestamp"))
    if f.date_to is not None:
        out.append(F.col(published) <= F.lit(f.date_to).cast("timestamp"))
    if f.min_notes is not None:
        out.append(F.col(notes) >= f.min_notes)
    return out


def allowed(posts: DataFrame, f: Filters, post_tags: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
    """The safe posts that pass the filters; a tag filter keeps posts with at least one of the tags (a semi-join)."""
    out = posts.where(~F.coalesce(F.col("nsfw"), F.lit(False)))
    for c in conditions(f):
        out = out.where(c)
    if f.tags:
        if post_tags is None or tags is None:
            raise ValueError("a tag filter needs the tag tables")
        wanted = tags.where(F.col("name").isin(list(f.tags))).select(F.col("id").alias("tag_id"))
        own = post_tags.join(wanted, "tag_id", "left_semi").select("post_id")
        out = out.join(own, out["id"] == own["post_id"], "left_semi")
    return out


def top(rows: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of highest score, ties to the smaller key (each partition keeps k, then one merge)."""
    return rows.orderBy(F.desc(score), F.asc(key)).limit(k)


def ranked(rows: DataFrame, score: str, key: str, out: str = "rank") -> DataFrame:
    """Adds the place from 1; for candidate lists only, whose size is bounded by their depth."""
    return rows.withColumn(out, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def keyword_topk(posts: DataFrame, query: str, k: int = 100, analyser: str = "simple", key: str = "id", text: str = "body_clean") -> DataFrame:
    """(key, kw_score): the ``k`` best matching posts."""
    return top(fulltext.keyword_scores(posts, key, text, query, analyser).withColumn("kw_score", F.round("kw_score", 9)), "kw_score", key, k)


def cosine_scores(rows: DataFrame, key: str, vector: str, query: Sequence[float], out: str = "cosine", digits: int = 6) -> DataFrame:
    """(key, cosine) to a query vector by matrix products over Arrow batches; null, zero and other-length vectors are left out."""
    q = np.asarray(query, np.float64)
    size = float(np.linalg.norm(q))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf) or size < V.TINY:
                continue
            m = np.stack(pdf["_v"].to_numpy()).astype(np.float64)
            n = np.linalg.norm(m, axis=1)
            ok = n >= V.TINY
            yield pd.DataFrame({key: pdf[key][ok], out: np.round((m[ok] @ q) / (n[ok] * size), digits)})

    own = rows.select(key, F.col(vector).alias("_v")).where(F.size("_v") == len(q))
    return own.mapInPandas(run, f"`{key}` {kind}, `{out}` double")


def vector_topk(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 100) -> DataFrame:
    """(key, cosine): the ``k`` most similar rows (exact; filters go before it)."""
    return top(cosine_scores(rows, key, vector, query), "cosine", key, k)


def gathered_topk(rows: DataFrame, key: str, parts: str, blocks: gather.Blocks, query: Sequence[float], k: int = 100, digits: int = 6) -> DataFrame:
    """The same for rows whose vectors are means of those that ``parts`` names: they are gathered and compared in one pass."""
    q = np.asarray(query, np.float64)
    size = float(np.linalg.norm(q))

    def run(b: pa.RecordBatch, m: np.ndarray) -> pa.RecordBatch:
        n = np.linalg.norm(m, axis=1)
        ok = (n >= V.TINY) & (size >= V.TINY) & (m.shape[1] == len(q))
        cos = np.round((m[ok] @ q) / (n[ok] * size), digits) if ok.any() else np.zeros(0)
        return pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array(cos)], [key, "cosine"])

    return top(gather.each(rows.select(key, parts), parts, blocks, run, f"`{key}` {rows.schema[key].dataType.simpleString()}, cosine double"), "cosine", key, k)


def vector_topk_native(rows: DataFrame, key: str, vector: str, query: Sequence[float], k: int = 100) -> DataFrame:
    """The same in built-in expressions only, for where Python workers aren't wanted."""
    q = V.literal(query)
    own = rows.where(F.size(vector) == len(query)).select(key, F.round(V.cosine(F.col(vector), q), 6).alias("cosine")).where(F.col("cosine").isNotNull())
    return top(own, "cosine", key, k)
