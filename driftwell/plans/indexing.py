"""The index jobs: post, tag and account vectors, communities, training pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.config import SearchConfig
from driftwell.functions import text as tx
from driftwell.functions import vectors as V
from driftwell.operators import communities as cm
from driftwell.operators import gather, ingest
from driftwell.plans import search
from driftwell.sources import files
from driftwell.sources.store import BucketTable

#: Windows that are encoded at a time.
TEXTS = 512


def index_posts(posts: DataFrame, post_tags: DataFrame, tags: DataFrame, encoder: Callable[[list, int], np.ndarray], size: int, images: DataFrame | None = None, config: SearchConfig | None = None) -> DataFrame:
    """The vector collection of safe posts: (id, vector, payload) with text, image and tag vectors fused to a unit vector.

    ``images`` is (id, vector), any number for a post.  A part that is missing or all zero counts as zero; a post whose vector is
    zero isn't indexed.
    """
    rows, vectors = post_points(posts, post_tags, tags, encoder, size, images, config)
    return vectors(rows).select("id", "vector", "payload")


def post_points(posts: DataFrame, post_tags: DataFrame, tags: DataFrame, encoder: Callable[[list, int], np.ndarray], size: int, images: DataFrame | None = None, config: SearchConfig | None = None) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """What safe posts' vectors are made of, (id, payload, texts, parts, image), and the function that adds vector to such rows.

    Rows are texts and numbers of tags: take them to where they are needed and add vectors last, for these are many times larger.
    Encoding, gathering and fusing is one pass over a few thousand windows at a time.
    """
    c = config or SearchConfig()
    safe = posts.where(~F.coalesce("nsfw", F.lit(False)))
    texts = F.transform(F.filter(tx.windows(F.col("body_clean"), c.chunk_size, c.chunk_overlap), lambda w: F.size(w) > 0), lambda w: F.array_join(w, " "))
    payload = F.struct("account_id", "nsfw", "note_count", "lang", "published_at").alias("payload")
    own = safe.select("id", payload, texts.alias("texts")).join(search.tag_lists(post_tags), "id", "left")
    if images is not None:
        own = own.join(V.mean_pool_fast(images, "id", "vector").select("id", F.col("vector").alias("image")), "id", "left")
    else:
        own = own.withColumn("image", F.lit(None).cast("array<double>"))
    blocks = search.tag_blocks(tags)

    def means(texts: pa.Array, n: int) -> np.ndarray:
        """The mean of the vectors, other than zero, of each row's texts; zero for a row without one."""
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))
        sums, count, flat = np.zeros((n, size)), np.zeros(n), texts.flatten()
        for at in range(0, len(row), TEXTS):
            e, r = np.asarray(encoder(flat.slice(at, TEXTS).to_pylist(), size), np.float64), row[at : at + TEXTS]
            ok = np.any(e != 0, axis=1)
            np.add.at(sums, r[ok], e[ok])
            np.add.at(count, r[ok], 1)
        return sums / np.maximum(count, 1)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, has, g in gather.gathered(batches, "parts", blocks):
            total = means(b.column("texts"), b.num_rows) * c.weight_text
            image = b.column("image")
            at = np.nonzero(pc.fill_null(pc.list_value_length(image), 0).to_numpy(zero_copy_only=False))[0]
            if len(at):
                total[at] += c.weight_image * image.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            if len(has):
                total[has] += c.weight_tag * g
            length = np.linalg.norm(total, axis=1)
            ok = length >= V.TINY
            v = (total[ok] / length[ok, None]).astype(np.float32)
            ends = np.arange(len(v) + 1, dtype=np.int32) * np.int32(size)
            yield pa.RecordBatch.from_arrays([*b.filter(pa.array(ok)).columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(v.ravel()))], [*b.schema.names, "vector"])

    return own, lambda rows: rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def index_accounts(post_index: DataFrame, config: SearchConfig | None = None, salts: int = 32, accounts: DataFrame | None = None, points: tuple[DataFrame, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(id, vector, posts): the unit mean of the vectors of each account's last posts.

    ``accounts`` (id, embedding), if given, are all in the result: one without posts keeps the vector that it has.
    Posts are ranked by number and time alone, each part of an account before the whole; vectors are joined to the chosen ones.
    With ``points``, which ``post_index`` is made from, the chosen posts' texts and tag numbers go to their account and become
    vectors there.
    """
    c = config or SearchConfig()
    order = [F.desc_nulls_last("published_at"), F.desc("id")]
    p = post_index.select("id", F.col("payload.account_id").alias("account_id"), F.col("payload.published_at").alias("published_at")).withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(salts)))
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("account_id", "_s").orderBy(*order))).where(F.col("_r") <= c.account_window)
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy(*order))).where(F.col("_r") <= c.account_window)
    p = p.select("id", "account_id")
    if points is not None:
        near = points[0].join(p, "id").where("account_id is not null").repartition("account_id").sortWithinPartitions("account_id")
        m = V.mean_pool_fast(points[1](near), "account_id", "vector", "m", together=True)
    else:
        m = V.mean_pool_fast(p.join(post_index.select("id", "vector"), "id"), "account_id", "vector", "m")
    own = m.select(F.col("account_id").alias("id"), V.normalise(F.col("m")).alias("vector"), F.col("n").alias("posts"))
    if accounts is None:
        return own
    kept = accounts.select("id", F.col("embedding").cast("array<double>").alias("_old")).join(own, "id", "left")
    return kept.select("id", F.coalesce("vector", "_old").alias("vector"), F.coalesce("posts", F.lit(0)).alias("posts"))


def bootstrap_collections(spark: SparkSession, folder: str, schemas: dict[str, T.StructType], key: str = "id") -> dict[str, BucketTable]:
    """The vector collections of a folder, made where they aren't there yet; doing it again changes nothing."""
    return {name: BucketTable(spark, f"{folder}/{name}", key, schema) for name, schema in schemas.items()}


def upsert_points(collection: BucketTable, points: DataFrame, number: int, order: Column | None = None) -> int:
    """Folds a batch of points into a collection, the last of a key by ``order``; gives how many buckets were written."""
    return collection.write(points, number, lambda old, new: ingest.last_write(old, new, collection.key, order=order))


def optimise(collections: list[BucketTable]) -> DataFrame:
    """Compacts each collection: (folder, rows, bytes, error); one that fails stops none of the others."""
    rows = [c.compact() for c in collections]
    return collections[0].spark.createDataFrame([(r["folder"], r.get("rows"), r.get("bytes"), r.get("error")) for r in rows], "folder string, rows long, bytes long, error string")


def image_status(posts: DataFrame, asked: DataFrame, images: DataFrame) -> DataFrame:
    """(id, status, n_images) for each asked id: not_found, no_images, nsfw (any image is), or ok.

    ``images`` is (id, nsfw); with a third column, vector, the result also has norm, the length of the mean vector of an ok post.
    """
    n = images.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("nsfw").alias("bad"))
    own = asked.select("id").distinct().join(posts.select("id", F.lit(True).alias("_p")), "id", "left").join(n, "id", "left")
    status = F.when(F.col("_p").isNull(), "not_found").when(F.coalesce("n", F.lit(0)) == 0, "no_images").when(F.col("bad"), "nsfw").otherwise("ok")
    out = own.select("id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_images"))
    if "vector" not in images.columns:
        return out
    means = V.mean_pool_fast(images, "id", "vector", "_m").select("id", V.norm(F.col("_m")).alias("_n"))
    return out.join(means, "id", "left").select("id", "status", "n_images", F.when(F.col("status") == "ok", F.col("_n")).alias("norm"))


def rebuild_communities(tags: DataFrame, accounts: DataFrame, posts: DataFrame, post_tags: DataFrame, folder: str, version: str, candidates: tuple[int, ...] = cm.CANDIDATES, seeds: int = 10) -> DataFrame:
    """Builds tag clusters and account clusters and swaps them in as a new version; returns (id, name, type, member_ids, centroid).

    The old version stays readable until the new one is whole.
    """
    spark = tags.sparkSession
    t = tags.where(F.exists("embedding", lambda x: x != 0)).select("id", "name", "embedding")
    rows = []
    if t.limit(3).count() >= 3:
        _, _, labelled = cm.choose_k(t, "id", "embedding", candidates, seeds)
        near = cm.nearest_members(labelled, "id", "label", "embedding").join(t.select("id", "name"), "id", "left")
        members = labelled.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("member_ids"))
        rows.append(cm.centroids(labelled, "label", "embedding").join(members, "label").join(cm.names(near, "label", "name"), "label").select(F.col("label").alias("_l"), "name", F.lit("tag_cluster").alias("type"), "member_ids", "centroid"))
    a = accounts.where(F.exists("embedding", lambda x: x != 0)).select("id", "embedding")
    if a.limit(10).count() >= 10:
        found = cm.density_clusters(a, "id", "embedding").where("label >= 0")
        named = cm.names(cm.top_tags(found.select(F.col("id").alias("account_id"), "label"), "label", posts, post_tags, tags), "label", "name")
        members = found.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("member_ids"))
        c = cm.centroids(found.join(a, "id"), "label", "embedding").join(members, "label").join(named, "label", "left")
        rows.append(c.select(F.col("label").alias("_l"), F.coalesce("name", F.concat(F.lit("cluster_"), F.col("label").cast("string"))).alias("name"), F.lit("account_cluster").alias("type"), "member_ids", "centroid"))
    if not rows:
        return spark.createDataFrame([], "id long, name string, type string, member_ids array<long>, centroid array<double>")
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    numbered = both.withColumn("id", F.row_number().over(Window.orderBy("type", "_l")).cast("long")).drop("_l")  # a few hundred clusters
    files.write_version(numbered.select("id", "name", "type", "member_ids", "centroid"), folder, version)
    return files.read_version(spark, folder)


def expand_corpus(sentences: DataFrame, prefixes: list[str], suffixes: list[str], most: int | None = None) -> DataFrame:
    """(sentence): every sentence, each with every prefix, and each with every suffix; distinct, at most ``most`` in order."""
    pre = F.transform(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.concat(p, F.lit(" "), F.col("sentence")))
    suf = F.transform(F.array(*[F.lit(p) for p in suffixes]), lambda p: F.concat(F.col("sentence"), F.lit(" "), p))
    own = sentences.where("sentence is not null").select(F.explode(F.concat(F.array("sentence"), pre, suf)).alias("sentence")).distinct()
    return own.orderBy("sentence").limit(most) if most is not None else own


def bootstrap_pairs(sentences: DataFrame, source: Callable, target: Callable, sizes: tuple[int, int]) -> DataFrame:
    """(sentence, x, y): both encoders' vectors of each sentence, the second one of unit length."""
    own = tx.encode(tx.encode(sentences, "sentence", "x", source, sizes[0]), "sentence", "y", target, sizes[1])
    return own.withColumn("y", V.normalise(F.col("y")))


def training_pairs(sentences: DataFrame, images: DataFrame | None, captions: DataFrame | None, source: Callable, target: Callable, sizes: tuple[int, int]) -> tuple[str, DataFrame]:
    """("image" or "bootstrap", pairs): pairs of images and captions where there is any image, else of both encoders' sentences."""
    if images is not None and captions is not None and images.limit(1).count():
        return "image", image_pairs(images, captions, target, sizes[1])
    return "bootstrap", bootstrap_pairs(sentences, source, target, sizes)


def image_pairs(images: DataFrame, captions: DataFrame, encoder: Callable, size: int) -> DataFrame:
    """(post_id, phash, x, y): an image's vector and its caption's; without a caption the folder's name stands in.

    ``images`` is (post_id, phash, vector), ``captions`` (phash, caption).
    """
    own = images.join(captions, "phash", "left").withColumn("caption", F.coalesce(F.nullif("caption", F.lit("")), "post_id"))
    return tx.encode(own, "caption", "y", encoder, size).select("post_id", "phash", F.col("vector").alias("x"), V.normalise(F.col("y")).alias("y"))
