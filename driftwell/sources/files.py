"""File sources and sinks: evaluation tables, blocklists, images, training pairs, results, versioned tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, post_id, relevance) of a tab-separated file; blank lines, comments and lines of another width are skipped."""
    cols = F.split(F.trim("value"), "\t")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(cols.alias("c")).where(F.size("c") == 3)
    own = lines.select(F.col("c")[0].alias("query_id"), F.col("c")[1].try_cast("long").alias("post_id"), F.col("c")[2].try_cast("int").alias("relevance"))
    return own.where("post_id is not null and relevance is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, type) of a tab-separated file; the type is general unless given."""
    cols = F.split(F.trim("value"), "\t")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#")).select(cols.alias("c")).where(F.size("c") >= 2)
    kind = F.when(F.size("c") > 2, F.col("c")[2])
    return lines.select(F.col("c")[0].alias("query_id"), F.col("c")[1].alias("text"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("general")).alias("type"))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """(term): the lower-case lines of a blocklist that are neither blank nor comments."""
    t = F.lower(F.trim("value"))
    return spark.read.text(path).select(t.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def read_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """(origin, post_id, height, width, channels, data) of the readable images under ``path``; the folder's name is the post."""
    own = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("image.origin", r"([^/]+)/[^/]+$", 1)
    return own.select(F.col("image.origin").alias("origin"), name.alias("post_id"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


#: Bytes of files from which the storage counts as too large.
STORAGE = 100 << 30


def storage_bytes(spark: SparkSession, path: str, pattern: str = "*", most: int = STORAGE) -> DataFrame:
    """(files, bytes, over) under a folder, from the listing alone; over tells whether the bytes pass ``most``."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return own.select("length").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("over", F.col("bytes") > most)


def _resize(img: np.ndarray, n: int) -> np.ndarray:
    """An n by n area average of a grey image."""
    h, w = img.shape
    rows = np.add.reduceat(img, np.arange(n) * h // n, axis=0) if h >= n else img[(np.arange(n) * h // n)]
    cols = np.add.reduceat(rows, np.arange(n) * w // n, axis=1) if w >= n else rows[:, (np.arange(n) * w // n)]
    nr = np.diff(np.r_[np.arange(n) * h // n, h]) if h >= n else np.ones(n)
    nc = np.diff(np.r_[np.arange(n) * w // n, w]) if w >= n else np.ones(n)
    return cols / nr[:, None] / nc[None]


def perceptual_hash(height: int, width: int, channels: int, data: bytes, size: int = 8) -> str:
    """64 bits, in hex: which low frequencies of the small grey picture lie above their median."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)
    grey = px[..., 0] if channels == 1 else px[..., 0] * 0.114 + px[..., 1] * 0.587 + px[..., 2] * 0.299  # stored blue first
    n = size * 4
    k = np.arange(n)
    dct = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    low = (dct @ _resize(grey, n) @ dct.T)[:size, :size]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{size * size // 4}x}"


def hash_images(images: DataFrame) -> DataFrame:
    """``images`` without pixels, with their perceptual hash."""
    keep = [c for c in images.columns if c != "data"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            out["phash"] = [perceptual_hash(h, w, c, d) for h, w, c, d in zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True)]
            yield out

    return images.mapInPandas(run, f"{fields}, phash string")


def dedupe_images(images: DataFrame) -> DataFrame:
    """One image for each post and hash, the first by origin."""
    rest = [c for c in images.columns if c not in ("post_id", "phash")]
    best = images.groupBy("post_id", "phash").agg(F.min_by(F.struct(*rest), "origin").alias("_r"))
    return best.select("post_id", "phash", *[F.col(f"_r.{c}").alias(c) for c in rest])


def encode_images(images: DataFrame, encoder, cache: DataFrame | None = None, batch: int = 32) -> tuple[DataFrame, DataFrame]:
    """((post_id, phash, vector) of every image, the grown cache): only hashes that the cache lacks are encoded.

    ``encoder`` maps a list of up to ``batch`` (height, width, channels, bytes) to as many vectors; where it fails, it is asked for
    each image alone, and one that it fails on is skipped.
    """

    def alone(image: tuple):
        try:
            return encoder([image])[0]
        except ValueError:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = list(zip(pdf["height"], pdf["width"], pdf["channels"], pdf["data"], strict=True))
            rows = []
            for lo in range(0, len(own), batch):
                names = pdf["phash"].iloc[lo : lo + batch]
                try:
                    got = list(encoder(own[lo : lo + batch]))
                except ValueError:
                    got = [alone(x) for x in own[lo : lo + batch]]
                rows += [(p, [float(x) for x in v]) for p, v in zip(names, got, strict=True) if v is not None]
            yield pd.DataFrame(rows, columns=["phash", "vector"])

    one = images.dropDuplicates(["phash"])
    new = one if cache is None else one.join(cache.select("phash"), "phash", "left_anti")
    fresh = new.select("phash", "height", "width", "channels", "data").mapInPandas(run, "phash string, vector array<float>")
    grown = fresh if cache is None else cache.unionByName(fresh)
    return images.select("post_id", "phash").join(grown, "phash"), grown


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs of two array columns as parquet."""
    pairs.write.mode("overwrite").parquet(path)


def write_version(rows: DataFrame, folder: str, version: str) -> str:
    """Writes a new version beside the old ones and points CURRENT at it last, so that readers never see half a table."""
    spark = rows.sparkSession
    path = f"{folder}/v={version}"
    rows.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{folder}/CURRENT")
    return path


def read_version(spark: SparkSession, folder: str) -> DataFrame:
    """The version that CURRENT points at."""
    return spark.read.parquet(f"{folder}/v={spark.read.text(f'{folder}/CURRENT').first()[0]}")


def compact(rows: DataFrame, path: str, files: int) -> None:
    """A rewrite in a given number of files."""
    rows.repartition(files).write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """Evaluation results as JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)
