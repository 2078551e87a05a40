"""Communities: clusters of tag and account vectors, their quality, names and centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwell.functions import vectors as V
from driftwell.sources.store import cut

#: Numbers of clusters that are tried, points that the silhouette is taken on at most, and points up to which one task does density clustering.
CANDIDATES = (30, 50, 100, 150, 200)
SILHOUETTE_SAMPLE = 5000
DENSITY_POINTS = 20_000
#: Rows of a block whose distances to another block's are taken at once.
SILHOUETTE_BLOCK = 2000


def kmeans(rows: DataFrame, key: str, vector: str, k: int, seeds: int = 10, seed: int = 42) -> DataFrame:
    """(key, vector, label): the clustering of least cost over several seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = rows.where(F.col(vector).isNotNull()).select(key, vector, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    own = cut(own)  # read many times by each fit
    best = None
    for i in range(seeds):
        model = KMeans(k=k, seed=seed + i, maxIter=20).fit(own)
        cost = model.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, model)
    out = best[1].transform(own).select(key, vector, F.col("prediction").alias("label"))
    return out


def silhouette(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, silhouette) in Euclidean distance of every point; a point alone in its cluster has 0, as have points of one cluster only.

    Every point meets every other, block by block: a task holds its own blocks' sums of distances for each cluster and adds
    those to one block after another.
    """
    own = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).cast("long").alias("_l"), F.col(vector).alias("_v"))
    kind = rows.schema[key].dataType.simpleString()
    sizes = {r["_l"]: r["n"] for r in own.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each cluster
    names = np.asarray(sorted(sizes), np.int64)
    size = np.asarray([sizes[x] for x in names.tolist()], np.int64)
    blocks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-int(size.sum()) // SILHOUETTE_BLOCK))
    # sorted, so that a block's points stand in one order on both sides
    block = own.groupBy(F.pmod(F.xxhash64("_k", "_l", "_v"), F.lit(blocks)).cast("int").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_k", "_l", "_v"))).alias("_p"))
    block = block.select("_b", F.col("_p._k").alias("_k"), F.col("_p._l").alias("_l"), F.flatten("_p._v").alias("_v"))
    pairs = block.crossJoin(block.select(F.col("_b").alias("_o"), F.col("_l").alias("_ol"), F.col("_v").alias("_ov"))).repartition(blocks, "_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}  # block: keys, places of the labels, sums of distances
        for pdf in batches:
            for b, k, l, v, o, ol, ov in pdf.itertuples(index=False):
                if b not in held:
                    held[b] = [list(k), np.searchsorted(names, l), np.zeros((len(k), len(names)))]
                sums = held[b][2]
                x, y = (np.asarray(z, np.float64).reshape(n, -1) for z, n in ((v, len(k)), (ov, len(ol))))
                d = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T, 0))
                if b == o:
                    np.fill_diagonal(d, 0)
                for c, at in enumerate(np.searchsorted(names, ol)):
                    sums[:, at] += d[:, c]
        for k, code, sums in held.values():
            i, n = np.arange(len(k)), size[code]
            a = sums[i, code] / np.maximum(n - 1, 1)
            mean = sums / size[None]
            mean[i, code] = np.inf
            b = mean.min(axis=1)
            with np.errstate(invalid="ignore"):
                s = np.where((n > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pd.DataFrame({key: k, "silhouette": s})

    return pairs.select("_b", "_k", "_l", "_v", "_o", "_ol", "_ov").mapInPandas(run, f"`{key}` {kind}, silhouette double")


def choose_k(rows: DataFrame, key: str, vector: str, candidates: tuple[int, ...] = CANDIDATES, seeds: int = 10) -> tuple[int, float, DataFrame]:
    """(k, mean silhouette, labelled rows) of the first best candidate below the number of points.

    The mean is taken on SILHOUETTE_SAMPLE points, the ones of smallest hash.
    """
    n = rows.where(F.col(vector).isNotNull()).count()
    own = [k for k in candidates if k < n] or [max(2, n // 2)]
    best = None
    for k in own:
        got = kmeans(rows, key, vector, k, seeds)
        score = silhouette(got.orderBy(F.xxhash64(key), key).limit(SILHOUETTE_SAMPLE), key, vector, "label").agg(F.avg("silhouette")).first()[0] if n > k else -1.0
        if best is None or score > best[1]:
            best = (k, score, got)
    return best


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid, n): the mean vector of each cluster."""
    return V.mean_pool_fast(rows.withColumn(label, F.col(label).cast("long")), label, vector, "centroid")


def nearest_members(rows: DataFrame, key: str, label: str, vector: str, top: int = 5) -> DataFrame:
    """(label, key, similarity, place): the members closest to their cluster's centroid.

    Members meet their centroid by a join on the label; the top of a cluster is cut per part of it before it is cut as a whole.
    """
    c = centroids(rows, label, vector)
    own = rows.where(F.col(vector).isNotNull()).withColumn(label, F.col(label).cast("long")).join(c.select(label, "centroid"), label)
    sim = V.dot(F.col(vector), F.col("centroid")) / (V.norm(F.col(vector)) * V.norm(F.col("centroid")) + F.lit(1e-10))
    own = own.select(label, key, F.round(sim, 6).alias("similarity"))
    part = Window.partitionBy(label, "_s").orderBy(F.desc("similarity"), key)
    own = own.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("place", F.row_number().over(part)).where(F.col("place") <= top)
    return own.withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("similarity"), key)).cast("long")).where(F.col("place") <= top).drop("_s")


def names(members: DataFrame, label: str, name: str, most: int = 3) -> DataFrame:
    """(label, name): the first members' names joined by dots; cluster_<label> where there are none."""
    own = members.where(F.col("place") <= most).groupBy(label).agg(F.array_sort(F.collect_list(F.struct("place", name))).alias("_n"))
    joined = F.array_join(F.filter(F.transform("_n", lambda x: x[name]), lambda x: x.isNotNull()), " · ")
    return own.select(label, F.coalesce(F.nullif(joined, F.lit("")), F.concat(F.lit("cluster_"), F.col(label).cast("string"))).alias("name"))


def top_tags(members: DataFrame, label: str, posts: DataFrame, post_tags: DataFrame, tags: DataFrame, most: int = 3) -> DataFrame:
    """(label, name, posts, place): the most used tags in the posts of each group's accounts; ``members`` is (account_id, label)."""
    used = members.join(posts.select("id", "account_id"), "account_id").join(post_tags, F.col("id") == F.col("post_id")).groupBy(label, "tag_id").agg(F.count(F.lit(1)).alias("posts"))
    named = used.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.desc("posts"), "name")).cast("long")
    return named.withColumn("place", place).where(F.col("place") <= most).select(label, "name", "posts", "place")


def density_labels(x: np.ndarray, least: int = 5) -> np.ndarray:
    """Density clusters (-1 is noise): mutual reachability, its minimum spanning tree, condensed tree, most stable clusters."""
    return _most_stable(len(x), _spanning_tree(x, least), least) if len(x) >= 2 * least else np.full(len(x), -1)


def _spanning_tree(x: np.ndarray, least: int) -> list[tuple[float, int, int]]:
    """(distance, point, point) of the minimum spanning tree of mutual reachability."""
    n = len(x)
    square = (x**2).sum(axis=1)
    dist = lambda i: np.sqrt(np.maximum(square[i] + square - 2 * x @ x[i], 0))
    core = np.empty(n)
    for i in range(n):
        core[i] = np.partition(dist(i), least - 1)[least - 1]
    # minimum spanning tree by Prim
    reach, source, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    edges = []
    at = 0
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(dist(at), core), core[at])
        nearer = ~done & (d < reach)
        reach[nearer], source[nearer] = d[nearer], at
        at = int(np.where(done, np.inf, reach).argmin())
        edges.append((reach[at], int(source[at]), at))
    return edges


def _most_stable(n: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """The labels of the most stable clusters of a spanning tree."""
    edges = sorted(edges)
    # single linkage
    parent = list(range(2 * n - 1))
    size, kids, height = [1] * n + [0] * (n - 1), {}, {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    new = n
    for w, a, b in edges:
        ra, rb = find(a), find(b)
        parent[ra] = parent[rb] = new
        size[new], kids[new], height[new] = size[ra] + size[rb], (ra, rb), w
        new += 1
    # condensed tree: a split counts where both sides are large enough
    stable: dict[int, float] = {0: 0.0}
    birth: dict[int, float] = {0: 0.0}
    children: dict[int, list[int]] = {0: []}
    fell: list[tuple[int, int]] = []  # (cluster, point)
    todo, count = [(new - 1, 0)], 1

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v]
        return out

    while todo:
        node, cluster = todo.pop()
        if node < n:
            fell.append((cluster, node))
            continue
        a, b = kids[node]
        lam = 1 / max(height[node], 1e-12)
        big = [c for c in (a, b) if size[c] >= least]
        if len(big) == 2:
            stable[cluster] += (lam - birth[cluster]) * size[node]
            for c in big:
                stable[count], birth[count], children[count] = 0.0, lam, []
                children[cluster].append(count)
                todo.append((c, count))
                count += 1
        else:
            for c in (a, b):
                if c in big:
                    todo.append((c, cluster))
                else:
                    stable[cluster] += (lam - birth[cluster]) * size[c]
                    fell += [(cluster, p) for p in points(c)]
    # the most stable clusters; the root is none
    chosen: dict[int, bool] = {}
    for c in sorted(stable, reverse=True):
        below = sum(stable[k] for k in children[c])
        if c and (not children[c] or stable[c] >= below):
            chosen[c] = True
        else:
            chosen[c] = False
            stable[c] = below if children[c] else stable[c]
    owner = {0: -1}
    stack, label = [(0, -1)], 0
    while stack:
        c, own = stack.pop()
        if own < 0 and chosen[c]:
            own, label = label, label + 1
        owner[c] = own
        stack += [(k, own) for k in sorted(children[c], reverse=True)]
    out = np.full(n, -1)
    for c, p in fell:
        out[p] = owner[c]
    return out


def density_clusters(rows: DataFrame, key: str, vector: str, least: int = 5, most: int = DENSITY_POINTS) -> DataFrame:
    """(key, label) of density clustering, labels in the order of the clusters' first keys; label -1 is noise.  Fewer than 2 * ``least`` points are all noise.

    Up to ``most`` points are one task's.  More are cut into blocks that meet pair by pair: the spanning tree grows by joining every
    part of it to the nearest other one, a job for each round, of which there are as many as the logarithm of the points.  Only
    numbers, three for each part of the tree, come to the driver, never vectors or keys.
    """
    own = rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("_v"))
    kind = rows.schema[key].dataType.simpleString()
    n = own.count()
    if n > most and n >= 2 * least:
        return _in_order(_density_spread(own, key, kind, n, least), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({key: pdf[key], "label": density_labels(np.stack(pdf["_v"].to_numpy()).astype(np.float64), least).astype(np.int64)})

    return _in_order(own.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"`{key}` {kind}, label long"), key)


def _in_order(found: DataFrame, key: str) -> DataFrame:
    """``found`` with its clusters numbered in the order of their first keys."""
    found = cut(found)
    first = found.where("label >= 0").groupBy("label").agg(F.min(key).alias("_f"))
    first = first.select("label", (F.row_number().over(Window.orderBy("_f")) - 1).cast("long").alias("_new"))  # a row for each cluster
    return found.join(first, "label", "left").select(key, F.coalesce("_new", F.lit(-1).cast("long")).alias("label"))


def _density_spread(own: DataFrame, key: str, kind: str, n: int, least: int, size: int = SILHOUETTE_BLOCK) -> DataFrame:
    spark = own.sparkSession
    count = max(2, -(-n // size))
    block = own.groupBy(F.pmod(F.xxhash64(key, "_v"), F.lit(count)).cast("int").alias("_b")).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("_k"), "_v"))).alias("_p"))
    block = cut(block.select("_b", F.col("_p._k").alias("_k"), F.flatten("_p._v").alias("_v"), F.size("_p").alias("_n")))
    start, at = {}, 0
    for r in block.select("_b", "_n").orderBy("_b").collect():  # one row for each block
        start[r["_b"]], at = at, at + r["_n"]
    pairs = block.select("_b", "_n", "_v").crossJoin(block.select(F.col("_b").alias("_o"), F.col("_n").alias("_on"), F.col("_v").alias("_ov"))).repartition(len(start), "_b")

    def distances(v, m, ov, om) -> np.ndarray:
        x, y = np.asarray(v, np.float64).reshape(m, -1), np.asarray(ov, np.float64).reshape(om, -1)
        return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T, 0))

    def cores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for b, m, v, o, om, ov in pdf.itertuples(index=False):
                d = distances(v, m, ov, om)
                if b == o:
                    np.fill_diagonal(d, 0)
                d = np.hstack([held[b], d]) if b in held else d
                held[b] = np.partition(d, least - 1, axis=1)[:, :least] if d.shape[1] > least else d
        for b, d in held.items():
            yield pd.DataFrame({"i": np.arange(len(d)) + start[b], "c": d.max(axis=1)})

    core = np.empty(n)
    for r in pairs.mapInPandas(cores, "i long, c double").toLocalIterator():  # one number for each point
        core[r["i"]] = r["c"]
    part = np.arange(n)
    edges: list[tuple[float, int, int]] = []
    while len(edges) < n - 1:
        sent = spark.sparkContext.broadcast((core, part))  # two numbers for each point

        def nearest(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            core, part = sent.value
            for pdf in batches:
                for b, m, v, o, om, ov in pdf.itertuples(index=False):
                    i, j = np.arange(m) + start[b], np.arange(om) + start[o]
                    d = np.maximum(np.maximum(distances(v, m, ov, om), core[i][:, None]), core[j][None])
                    d[part[i][:, None] == part[j][None]] = np.inf
                    w = d.min(axis=1)
                    ok = np.isfinite(w)
                    if ok.any():
                        to = j[d.argmin(axis=1)]
                        got = pd.DataFrame({"part": part[i], "w": w, "lo": np.minimum(i, to), "hi": np.maximum(i, to)})[ok]
                        yield got.sort_values(["w", "lo", "hi"]).drop_duplicates("part")

        best = pairs.mapInPandas(nearest, "part long, w double, lo long, hi long").groupBy("part").agg(F.min(F.struct("w", "lo", "hi")).alias("e"))
        found = sorted({(r["e"]["w"], r["e"]["lo"], r["e"]["hi"]) for r in best.collect()})  # three numbers for each part
        sent.destroy()
        up = np.arange(n)

        def find(a: int) -> int:
            while up[a] != a:
                up[a] = up[up[a]]
                a = int(up[a])
            return a

        before = len(edges)
        for w, lo, hi in found:
            a, b = find(int(part[lo])), find(int(part[hi]))
            if a != b:
                up[max(a, b)] = min(a, b)
                edges.append((w, lo, hi))
        if len(edges) == before:
            raise ValueError("distances that are no numbers")
        part = np.asarray([find(int(p)) for p in part])
    labels = spark.sparkContext.broadcast(_most_stable(n, edges, least))  # one number for each point

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, k, m in pdf.itertuples(index=False):
                yield pd.DataFrame({key: list(k), "label": labels.value[start[b] : start[b] + m].astype(np.int64)})

    return block.select("_b", "_k", "_n").mapInPandas(name, f"`{key}` {kind}, label long")
