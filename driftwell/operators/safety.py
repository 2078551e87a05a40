"""The safety gate over posts: blocklist, softmax score of images, their combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions import text as tx
from driftwell.functions import vectors as V


def image_scores(images: DataFrame, key: str, vector: str, prompts: list[list[float]], unsafe: int = 4, threshold: float = 0.75, logit_scale: float = 1.0) -> DataFrame:
    """(key, nsfw_score, nsfw): the softmax share of the first ``unsafe`` prompts in an image's cosines to all prompts."""
    cos = F.array(*[V.cosine(F.col(vector), V.literal(p)) * F.lit(logit_scale) for p in prompts])
    own = images.where(F.col(vector).isNotNull()).select(key, cos.alias("_c")).where(F.forall("_c", lambda x: x.isNotNull()))
    return own.select(key, F.round(V.softmax_unsafe(F.col("_c"), unsafe), 6).alias("nsfw_score")).withColumn("nsfw", F.col("nsfw_score") > threshold)


def gate(posts: DataFrame, images: DataFrame, terms: list[str], key: str = "id", text: str = "body_clean") -> DataFrame:
    """(key, nsfw_score, nsfw): the worst of a post's images; a post without images is judged by the blocklist alone (1 or 0).

    ``images`` is (key, nsfw_score, nsfw), any number for a post.
    """
    worst = images.groupBy(key).agg(F.max("nsfw_score").alias("_s"), F.bool_or("nsfw").alias("_f"))
    listed = tx.blocked(F.col(text), terms)
    own = posts.select(key, text).join(worst, key, "left")
    return own.select(key, F.coalesce(F.col("_s"), listed.cast("double")).alias("nsfw_score"), F.coalesce(F.col("_f"), listed).alias("nsfw"))
