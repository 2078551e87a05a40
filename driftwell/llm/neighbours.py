"""Most similar vectors for every vector (problem 6): balanced posting lists.

Centroids come from hierarchical balanced clustering of a bounded sample; beyond what one sample can tell apart, each of its cells is
clustered again by a sample of its own, so that lists keep their length as the collection grows.  A graph over them, held in memory by every
worker, is searched for the lists of a vector; a vector near a boundary is replicated to every list whose centroid is,
by distance ratio, about as near as the nearest.  Each list is compared with itself by exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that one clustering is fitted on, at most, and the fewest in a cluster of the sample.  Every vector is indexed.
SAMPLE, LEAF = 16_384, 16
#: Centroids at most (they are sent to all tasks: 100 MB at 384 dimensions); beyond LIST times as many vectors lists grow.
CENTROIDS = 65_536
#: Vectors in a list aimed at; lists of more than twice BLOCK are compared block by block.
LIST, BLOCK = 1500, 4096
#: Lists of a vector at most, and how much further than the nearest centroid one of them may be.
LISTS, RATIO = 6, 1.1
#: Exact copies of one vector that go through the index one by one; of larger groups only the copies that can be among the nearest do.
COPIES = 64

NONE = pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "cosine": np.zeros(0)})


def _split(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster numbers of the rows by balanced spherical k-means: a penalty on size keeps clusters alike."""
    at = v[rng.choice(len(v), k, replace=False)].copy()
    own = np.zeros(len(v), np.int64)
    load = np.zeros(k, np.float32)
    for _ in range(8):
        sim = v @ at.T
        own = np.argmax(sim - 0.05 * load, axis=1)
        n = np.bincount(own, minlength=k)
        load = (0.5 * load + 0.5 * n / max(1.0, len(v) / k)).astype(np.float32)
        for c in np.nonzero(n)[0]:
            at[c] = v[own == c].mean(axis=0)
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-12)
    return own


def centroids(v: np.ndarray, leaf: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of clusters of at most about ``leaf`` of the unit rows of ``v``."""
    rng = np.random.default_rng(seed)
    out, todo = [], [v]
    while todo:
        x = todo.pop()
        own = _split(x, min(8, -(-len(x) // leaf)), rng) if len(x) > leaf else np.zeros(len(x), np.int64)
        parts = np.unique(own)
        if len(parts) < 2:  # small enough, or all alike
            out.append(x.mean(axis=0))
        else:
            todo += [x[own == c] for c in parts]
    c = np.asarray(out, np.float32)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Graph:
    """A neighbour graph over the centroids, searched best first for a batch of vectors at once."""

    def __init__(self, at: np.ndarray, degree: int = 16, seed: int = 7):
        self.at, n = at, len(at)
        rng = np.random.default_rng(seed)
        near = []
        for lo in range(0, n, 1024):
            sim = at[lo : lo + 1024] @ at.T
            sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = -2
            k = min(degree, n - 1)
            near.append(np.argpartition(-sim, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(sim), 1), np.int64))
        far = rng.integers(0, n, (n, 4))  # long links keep the graph connected
        self.links = np.concatenate([np.concatenate(near), far], axis=1)
        self.entry = rng.permutation(n)[: max(8, int(np.sqrt(n)))]

    def search(self, q: np.ndarray, want: int, beam: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, similarities) of about the ``want`` best for each row of q, best first; -1 where there are fewer."""
        n, rows = len(self.at), np.arange(len(q))[:, None]
        beam = min(beam, n)
        seen = np.zeros((len(q), n), bool)
        first = np.broadcast_to(self.entry, (len(q), len(self.entry)))
        ids, sims = first, q @ self.at[self.entry].T
        seen[rows, first] = True
        open_ = np.ones(ids.shape, bool)
        while True:
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, open_ = ids[rows, order], sims[rows, order], open_[rows, order]
            todo = np.where(open_, sims, -3)
            pick = np.argsort(-todo, axis=1, kind="stable")[:, :2]
            live = todo[rows, pick] > -3
            if not live.any():
                break
            open_[rows, pick] = False
            new = self.links[ids[rows, pick]].reshape(len(q), -1)
            fresh = ~seen[rows, new] & np.repeat(live, self.links.shape[1], axis=1)
            # a node that two links lead to counts once
            order = np.argsort(new, axis=1, kind="stable")
            ranked = np.take_along_axis(new, order, axis=1)
            again = np.zeros(new.shape, bool)
            np.put_along_axis(again, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
            fresh &= ~again
            r, c = np.nonzero(fresh)
            seen[r, new[r, c]] = True
            got = np.full(new.shape, -3, np.float32)
            got[r, c] = np.einsum("ij,ij->i", q[r], self.at[new[r, c]])
            ids, sims = np.concatenate([ids, new], axis=1), np.concatenate([sims, got], axis=1)
            open_ = np.concatenate([open_, fresh], axis=1)
        ids = np.where(sims > -3, ids, -1)
        return ids[:, :want], sims[:, :want]


def refined(own: DataFrame, graph: Graph, n: int, want: int) -> np.ndarray:
    """About ``want`` centroids for the ``n`` unit vectors (id, v): those of the graph's cells, each clustered by itself.

    2 * LEAF sampled vectors are taken for each centroid wanted, a fixed share of the hash space; of a cell at most SAMPLE of them,
    the ones of smallest hash.
    """
    sent = own.sparkSession.sparkContext.broadcast(graph)
    share = min(1.0, 2 * LEAF * want / n)

    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo : lo + 1024]
                q = np.frombuffer(b"".join(part["v"]), np.float32).reshape(len(part), -1)
                yield pd.DataFrame({"cell": sent.value.search(q, 1)[0][:, 0], "id": part["id"].to_numpy(), "v": part["v"].to_numpy()})

    picked = own.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20))))).mapInPandas(cell, "cell long, id long, v binary")
    mixed = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(2)), "id")
    sized = picked.join(picked.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell").withColumn("r", F.row_number().over(mixed)).where(F.col("r") <= SAMPLE)

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        v = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), -1)
        got = centroids(v, max(LEAF, int(LIST * len(v) * share / pdf["m"].iat[0])))
        return pd.DataFrame({"c": [x.tobytes() for x in got]})

    rows = sized.groupBy("cell").applyInPandas(split, "c binary").collect()  # about ``want`` centroids
    return np.stack(sorted((np.frombuffer(r["c"], np.float32) for r in rows), key=lambda x: x.tobytes()))


def lists(graph: Graph, q: np.ndarray, most: int = LISTS, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of the lists of each row of q: pruned by the ratio of distances to the nearest centroid."""
    ids, sims = graph.search(q, most)
    far = np.sqrt(np.maximum(2 - 2 * sims, 0))
    keep = (ids >= 0) & (far <= ratio * far[:, :1] + 1e-6)
    r, c = np.nonzero(keep)
    return r, ids[r, c]


def _best(va: np.ndarray, ia: np.ndarray, vb: np.ndarray, ib: np.ndarray, same: bool, k: int, least: float) -> Iterator[pd.DataFrame]:
    """The ``k`` best rows of b for each row of a with cosine >= least, a thousand rows of a at a time; ties go to the smaller id."""
    for lo in range(0, len(va), 1024):
        sim = va[lo : lo + 1024] @ vb.T
        if same:
            sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = -2
        floor = np.full(len(sim), max(least, -1.5), np.float32)
        if sim.shape[1] > k:
            floor = np.maximum(floor, np.partition(sim, -k, axis=1)[:, -k])
        r, c = np.nonzero(sim >= floor[:, None])
        if not len(r):
            continue
        order = np.lexsort((ib[c], -sim[r, c], r))
        r, c = r[order], c[order]
        start = np.r_[0, np.nonzero(np.diff(r))[0] + 1]
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        r, c = r[place < k], c[place < k]
        yield pd.DataFrame({"id": ia[lo + r], "other": ib[c], "cosine": sim[r, c].astype(np.float64)})


def _pairs(a: pd.DataFrame, b: pd.DataFrame | None, k: int, least: float) -> pd.DataFrame:
    """The ``k`` best of the rows of b (or the others of a) for each row of a, and the other way round, with cosine >= least."""
    va = np.frombuffer(b"".join(a["v"]), np.float32).reshape(len(a), -1)
    ia = a["id"].to_numpy(np.int64)
    if b is None:
        out = list(_best(va, ia, va, ia, True, k, least))
    else:
        vb, ib = np.frombuffer(b"".join(b["v"]), np.float32).reshape(len(b), -1), b["id"].to_numpy(np.int64)
        out = [*_best(va, ia, vb, ib, False, k, least), *_best(vb, ib, va, ia, False, k, least)]
    return pd.concat(out) if out else NONE


def nearest(rows: DataFrame, key: str, vector: str, k: int = 10, least: float = -1.0) -> DataFrame:
    """(id, other, cosine, place): for every vector its ``k`` most similar other vectors, cosine >= ``least``, place from 1.

    Null and all-zero vectors, vectors with a null, NaN or infinite element, and rows with a null ``key`` have no neighbours
    and are nobody's; so are vectors of another length than the most common one.  Ties go to the smaller id.  ``key`` names a
    row (bigint); repeated rows of a key count once; other columns are dropped.  An empty table gives an empty result.

    The answer is approximate where a pair shares no list; README states the measured recall.
    """
    spark = rows.sparkSession
    schema = "id long, other long, cosine double, place int"
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    stats = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not stats:
        return spark.createDataFrame([], schema)
    d, n = stats[0]
    own = own.where(F.size("v") == d)

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            size = np.linalg.norm(v, axis=1)
            ok = np.isfinite(size) & (size > 0)
            v = (v[ok] / size[ok, None]).astype(np.float32)
            yield pd.DataFrame({"id": pdf["id"][ok], "v": [x.tobytes() for x in v]})

    # a fixed share of the hash space, so that the sample is the same in every run and after a loss
    share = min(1.0, SAMPLE / n)
    picked = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).mapInPandas(unit, "id long, v binary").limit(2 * SAMPLE).toPandas()
    if not len(picked):
        picked = own.limit(1024).mapInPandas(unit, "id long, v binary").toPandas()
    if not len(picked):
        return spark.createDataFrame([], schema)
    sample = np.frombuffer(b"".join(picked.sort_values("id")["v"]), np.float32).reshape(len(picked), d)
    at = centroids(sample, max(LEAF, int(LIST * len(sample) / n)))
    want = min(CENTROIDS, -(-n // LIST))
    if want > SAMPLE // LEAF:
        at = refined(own.mapInPandas(unit, "id long, v binary"), Graph(at), n, want)
    graph = Graph(at)
    # how long lists will be: the sample's, scaled; of long ones each pair of blocks is compared by itself
    expected = np.bincount(np.concatenate([lists(graph, sample[lo : lo + 1024])[1] for lo in range(0, len(sample), 1024)]), minlength=len(at)) * (n / len(sample))
    blocks = np.where(expected > 2 * BLOCK, -(-expected // BLOCK), 1).astype(np.int64)
    sent = spark.sparkContext.broadcast((graph, blocks))  # CENTROIDS vectors at most

    # large groups of exact copies: only the k + 1 smallest ids can be anyone's nearest
    copies = own.select("id", F.xxhash64("v").alias("h"), F.hash("v").alias("g"))
    crowds = copies.groupBy("h", "g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > COPIES).select("h", "g")
    crowded = bool(crowds.take(1))
    spare = None
    if crowded:
        salted = Window.partitionBy("h", "g", "salt").orderBy("id")
        fine = F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        among = own.select("id", "v", F.xxhash64("v").alias("h"), F.hash("v").alias("g")).join(crowds, ["h", "g"], "left_semi").where(fine).drop("v").dropDuplicates(["id"])
        among = among.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(256)))
        low = among.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1).withColumn("r", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).where(F.col("r") <= k + 1)
        spare = among.join(low.select("id"), "id", "left_anti").select("id", "h", "g")
        alike = spare.join(low.where(F.col("r") <= k).select("h", "g", F.col("id").alias("other"), "r"), ["h", "g"])
        alike = alike.select("id", "other", F.lit(1.0).alias("cosine"), F.col("r").cast("int").alias("place"))
        own = own.join(spare.select("id"), "id", "left_anti")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, blocks = sent.value
        for pdf in unit(batches):
            ids, vs = pdf["id"].to_numpy(np.int64), pdf["v"].to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for lo in range(0, len(ids), 1024):
                part = vs[lo : lo + 1024]
                q = np.frombuffer(b"".join(part), np.float32).reshape(len(part), -1)
                r, c = lists(graph, q)
                m = blocks[c]  # a vector goes to each pair of blocks that its own is in
                other = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                r, c = np.repeat(r, m), np.repeat(c, m)
                mine = (mixed[lo + r] % blocks[c].astype(np.uint64)).astype(np.int64)
                yield pd.DataFrame({"list": c, "i": np.minimum(mine, other), "j": np.maximum(mine, other), "side": (mine > other).astype(np.int32), "id": ids[lo + r], "v": part[r]})

    faces = own.mapInPandas(assign, "list long, i long, j long, side int, id long, v binary")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates(["id", "side"])
        if pdf["i"].iat[0] == pdf["j"].iat[0]:
            return _pairs(pdf, None, k, least)
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        return _pairs(a, b, k, least) if len(a) and len(b) else NONE

    found = faces.groupBy("list", "i", "j").applyInPandas(compare, "id long, other long, cosine double")
    found = found.where("id <> other").groupBy("id", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return found.unionByName(alike.where(F.col("cosine") >= least)) if crowded else found


def near_pairs(rows: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.82) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: one of the two is among the ``k`` nearest of the other and their cosine is >= ``least``."""
    near = nearest(rows, key, vector, k, least)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"), "cosine").groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))
