"""Core operators: hand-worked values, small tables, edges."""

import json
import math
import random
import shutil
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell import catalog, schema
from driftwell.config import Filters, SearchConfig, check_limit, check_query
from driftwell.functions import scoring, trigram
from driftwell.functions import text as tx
from driftwell.functions import vectors as V
from driftwell.operators import communities as cm
from driftwell.operators import evaluate, fulltext, fusion, gather, ingest, projection, retrieve, safety
from driftwell.plans import indexing, queries_search, search, stats, store
from driftwell.sources import feed, files
from driftwell.sources.feed import FeedSource
from driftwell.sources.store import BucketTable
from driftwell.streaming import ingest as streams

def as_of():
    return F.lit("2025-07-01").cast("timestamp")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ formulas


def test_rerank_values(spark):
    r = one(spark, scoring.engagement(F.lit(127), 0.1), scoring.engagement(F.lit(None).cast("long"), 0.1), scoring.recency(F.lit("2025-04-02").cast("timestamp"), as_of(), 90.0), scoring.recency(F.lit(None).cast("timestamp"), as_of(), 90.0), scoring.recency(F.lit("2030-01-01").cast("timestamp"), as_of(), 90.0))
    assert r[0] == pytest.approx(1.7) and r[1] == 1.0 and r[2] == pytest.approx(0.5) and r[3] == 0.5 and r[4] == 1.0


def test_scores_of_names_tags_and_communities(spark):
    r = one(spark, scoring.account_name_score(F.lit(1), F.lit(1), F.lit(0.5), F.lit(None).cast("long")), scoring.tag_score(F.lit(1.0), F.lit(0.5), F.lit(3), F.lit(4.0)), scoring.community_score(F.lit(0.6), F.lit(15)), scoring.community_score(F.lit(-0.5), F.lit(1)))
    assert r[0] == pytest.approx(15.5) and r[1] == pytest.approx(1 + 0.3 + 0.15) and r[2] == pytest.approx(0.84) and r[3] < 0


def test_cursors_and_links(spark):
    c = scoring.encode_cursor(0.98765, 42)
    assert scoring.decode_cursor(c) == (0.98765, 42)
    with pytest.raises(ValueError):
        scoring.decode_cursor("not-a-valid-cursor!!!")
    own = one(spark, scoring.cursor(F.lit(0.5), F.lit(7)), scoring.drill_down(F.array(F.lit("photography"), F.lit("landscape"), F.lit("nature"), F.lit("x")), ""), scoring.drill_down(F.array().cast("array<string>"), "a b"))
    assert scoring.decode_cursor(own[0]) == (0.5, 7) and own[1] == "/api/v1/search/general?q=photography+landscape+nature" and own[2].endswith("q=a+b")


def test_cache_keys_depend_on_every_part_but_not_on_order():
    k = scoring.cache_key("general", "q", filters={"a": 1, "b": None}, limit=3)
    assert k == scoring.cache_key("general", "q", limit=3, filters={"b": None, "a": 1})
    assert len({k, scoring.cache_key("tags", "q", filters={"a": 1, "b": None}, limit=3), scoring.cache_key("general", "p", filters={"a": 1, "b": None}, limit=3), scoring.cache_key("general", "q", filters={"a": 2, "b": None}, limit=3), scoring.cache_key("general", "q", filters={"a": 1, "b": None}, limit=4)}) == 5


def test_result_cache_ages_and_evicts():
    now = [0.0]
    c = search.Cache(ttl=10, most=2, clock=lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None and c.hit_rate() == pytest.approx(0.5) and c.clear() >= 1 and c.get("c") is None


def test_trigrams(spark):
    s = lambda a, b: trigram.similarity(F.lit(a), F.lit(b))
    r = one(spark, s("photography", "photgraphy"), s("photography", "photography-art"), s("photography", "zzzzzzqqqqqxxx999"), s("", ""), s("a", "a"))
    assert r[0] == pytest.approx(0.643, abs=1e-3) and r[1] == pytest.approx(0.75) and r[2] == 0 and r[3] == 0 and r[4] == 1


def test_limits_are_checked():
    assert check_query("  x ") == "x"
    for bad in ("", "   ", "x" * 501):
        with pytest.raises(ValueError):
            check_query(bad)
    with pytest.raises(ValueError):
        check_limit(0, 1, 100, "limit")
    assert check_limit(0, 0, 50, "limit") == 0


# ------------------------------------------------------------------ vectors


@pytest.mark.parametrize("mask", range(8))
def test_fusion_of_any_parts_is_a_unit_vector_or_zero(spark, mask):
    rng = np.random.default_rng(mask)
    parts = [F.array(*[F.lit(float(x)) for x in rng.normal(size=6)]) if mask >> i & 1 else F.lit(None).cast("array<double>") for i in range(3)]
    v = np.asarray(one(spark, V.fuse(list(zip(parts, (0.5, 0.35, 0.15), strict=True)), 6))[0])
    assert np.linalg.norm(v) == pytest.approx(1.0 if mask else 0.0)


def test_vector_functions(spark):
    a, b = V.literal([3, 4]), V.literal([4, 3])
    r = one(spark, V.dot(a, b), V.norm(a), V.cosine(a, b), V.cosine(a, V.literal([0, 0])), V.normalise(V.literal([0, 0])), V.nonzero(V.literal([0, 0])), V.softmax_unsafe(V.literal([1.0] * 8), 4), V.softmax_unsafe(V.literal([1000.0, 0, 0, 0, 0, 0, 0, 0]), 4))
    assert r[0] == 24 and r[1] == 5 and r[2] == pytest.approx(0.96) and r[3] is None and list(r[4]) == [0, 0] and r[5] is None and r[6] == pytest.approx(0.5) and r[7] == pytest.approx(1.0)


def test_mean_pools_agree(spark):
    rng = np.random.default_rng(0)
    data = [(int(rng.integers(5)), rng.normal(size=4).tolist()) for _ in range(300)] + [(9, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(data, "k long, v array<double>").repartition(3)
    fast = {r.k: (r.vector, r.n) for r in V.mean_pool_fast(df, "k", "v").collect()}
    slow = {r.k: r.vector for r in V.mean_pool(df.where("k is not null"), ["k"], "v").collect()}
    for k in range(5):
        want = np.mean([v for j, v in data if j == k and v], axis=0)
        assert np.allclose(fast[k][0], want) and np.allclose(slow[k], want)
    assert 9 not in fast and None not in fast and fast[0][1] == sum(j == 0 for j, _ in data)


def test_post_vectors_by_matrix_and_by_join(spark):
    tags = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "id long, embedding array<float>")
    pt = spark.createDataFrame([(10, 1), (10, 2), (10, 2), (11, 3), (12, 1), (12, 99), (None, 1)], "post_id long, tag_id long")
    want = [(10, [0.5, 0.5]), (12, [1.0, 0.0])]
    assert rows(search.post_vectors(pt, tags)) == want and rows(search.post_vectors(pt, tags, most=0)) == want


def test_tag_vectors_never_come_to_the_driver(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def refuse(*_):
        raise AssertionError("the tag vectors came to the driver")

    monkeypatch.setattr(Classic, "toPandas", refuse)
    monkeypatch.setattr(SparkContext, "broadcast", refuse)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 4)).astype(np.float32)
    tags = spark.createDataFrame([(3 * i, [float(x) for x in m[i]]) for i in range(300)] + [(0, [1.0, 1.0, 1.0, 1.0])], "id long, embedding array<float>")
    pt = spark.createDataFrame([(int(p), int(t)) for p, t in zip(rng.integers(0, 90, 900), rng.integers(0, 900, 900), strict=True)] + [(7, t) for t in range(900)], "post_id long, tag_id long").cache()
    want = {}
    for p, t in {(r.post_id, r.tag_id) for r in pt.collect()}:
        want.setdefault(p, []).extend(([m[t // 3]] if t % 3 == 0 else []) + ([np.ones(4, np.float32)] if t == 0 else []))  # a number that two tags have counts twice
    want = {p: np.mean(np.asarray(v, np.float64), axis=0) for p, v in want.items() if v}
    for most in (0, 160, 1 << 20):
        got = {r.id: r.vector for r in search.post_vectors(pt, tags, most=most).collect()}
        assert set(got) == set(want) and all(np.allclose(got[p], want[p], rtol=0, atol=1e-12) for p in want)


@pytest.fixture(scope="module")
def small(tmp_path_factory, spark):
    """A data folder of a few posts, tags and accounts."""
    d, rng = str(tmp_path_factory.mktemp("small")), np.random.default_rng(9)
    words = "kiln shelf trellis harbor glaze".split()
    vec = lambda: [float(x) for x in rng.normal(size=384).astype(np.float32)]
    made = lambda name, got, kind: spark.createDataFrame(got, kind).write.parquet(f"{d}/{name}.parquet")
    made("tags", [(i, f"t{i}", i, None if i == 7 else [0.0] * 384 if i == 8 else vec()) for i in range(1, 31)], "id long, name string, usage_count long, embedding array<float>")
    made("post_tags", [(int(p), int(t)) for p, t in zip(rng.integers(0, 130, 400), rng.integers(1, 34, 400), strict=True)] + [(3, 7), (None, 1), (5, None)], "post_id long, tag_id long")
    made("accounts", [(i, f"blog{i}", None, None, None, i, None, vec(), None) for i in range(6)], schema.ACCOUNTS)
    post = lambda i: (i, i, int(rng.integers(0, 6)) if i % 9 else None, "text", None, " ".join(rng.choice(words, 5)) if i % 10 else None, ["u"] * (i % 3), int(rng.integers(0, 300)), None, None, None, i % 11 == 0, None, "en", datetime(2024, 1 + i % 12, 3), datetime(2025, 1, 1))
    made("posts", [post(i) for i in range(120)] + [post(5)[:15] + (datetime(2025, 2, 1),)], schema.POSTS)
    return d


def same_as_sql(spark, d, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("tags", "post_tags", "accounts", "posts"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    df = catalog.queries()[name](spark, d)
    want = con.sql(catalog.oracle_sql()[name])
    return sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in df.columns)).fetchall()))


def test_filtered_posts_are_filtered_before_their_vectors_are_gathered(spark, small, monkeypatch):
    monkeypatch.setattr(search, "post_vectors", None)
    assert same_as_sql(spark, small, "filtered_vector_topk")


@pytest.mark.parametrize("name", ["build_collection", "general_search_posts", "general_search_accounts", "general_search_filtered", "general_search_page2", "post_metadata", "engine_general"])
def test_a_collection_holds_numbers_of_tags(spark, small, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    monkeypatch.setattr(Classic, "toPandas", None)  # as lists of numbers, vectors don't fit the driver
    assert same_as_sql(spark, small, name)
    held = queries_search.collection(spark, small)
    assert "vector" not in held.vectors.columns and held.vectors.count() > 50
    q = queries_search.query_vector(spark, small)
    exact = held.nearest(q, 10, Filters()).collect()
    assert len(exact) == 10 and {r.id for r in held.nearest(q, 60, Filters(), probes=15).collect()} >= {r.id for r in exact[:3]}


def test_indexed_posts_are_made_in_one_pass(spark, small, monkeypatch):
    monkeypatch.setattr(V, "mean_pool_fast", None)  # no post's vector is shuffled
    assert same_as_sql(spark, small, "index_posts")
    p, pt, tags = (queries_search.read(spark, small, n) for n in ("posts", "post_tags", "tags"))
    own = p.where("id in (1, 2, 3, 4)").withColumn("body_clean", F.when(F.col("id") == 2, "kiln " * 1000).otherwise(F.col("body_clean")))
    got = {r.id: np.asarray(r.vector) for r in indexing.index_posts(own, pt, tags, tx.hash_encode, 384).collect()}
    of = {r.id: np.asarray(r.embedding) for r in tags.collect() if r.id not in (7, 8)}
    for r in own.collect():
        words = (r.body_clean or "").split()
        texts = tx.hash_encode([" ".join(words[i : i + 512]) for i in range(0, max(1, len(words)), 448)]).astype(np.float64)
        t = [of[x.tag_id] for x in pt.where(f"post_id = {r.id}").distinct().collect() if x.tag_id in of]
        v = 0.5 * texts.mean(axis=0) + 0.15 * (np.mean(t, axis=0) if t else 0)
        assert np.abs(got[r.id] - v / np.linalg.norm(v)).max() < (0.02 if len(words) > 512 else 1e-6), r.id


def test_accounts_are_made_of_texts_and_tag_numbers(spark, small):
    points = indexing.post_points(*(queries_search.read(spark, small, n) for n in ("posts", "post_tags", "tags")), tx.hash_encode, 384)
    index, c = points[1](points[0]), SearchConfig(account_window=5)
    there, here = ({r.id: r for r in indexing.index_accounts(index, c, **more).collect()} for more in ({}, {"points": points}))
    assert set(there) == set(here) and len(here) == 6
    assert all(here[k].posts == there[k].posts == 5 and np.allclose(here[k].vector, there[k].vector, rtol=0, atol=1e-6) for k in here)


def test_a_collection_without_vectors(spark, small, tmp_path):
    posts, tags = spark.read.parquet(f"{small}/posts.parquet").where("id = 1"), spark.read.parquet(f"{small}/tags.parquet")
    held = store.SearchStore.build(spark, posts, spark.createDataFrame([(1, [7])], "id long, parts array<long>"), "simple", str(tmp_path / "none"), parts=search.tag_vectors(tags))
    assert held.posts.count() == 1 and held.vectors.count() == 0 and held.nearest([1.0] * 384, 5, Filters()).count() == 0


def test_gathered_rows_keep_their_other_columns(spark):
    tags = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    own = spark.createDataFrame([(1, 2**62 + 1, datetime(2025, 1, 1), [1, 2]), (2, None, None, None), (3, 5, None, []), (4, 6, None, [9])], "id long, n long, at timestamp, parts array<long>").coalesce(1)
    blocks = search.tag_blocks(tags)
    want = [(1, 2**62 + 1, datetime(2025, 1, 1), [1, 2], [0.5, 0.5]), (2, None, None, None, None), (3, 5, None, [], None), (4, 6, None, [9], None)]
    assert [tuple(r) for r in gather.means(own, "parts", blocks, keep=True).orderBy("id").collect()] == want
    assert [tuple(r) for r in gather.means(own, "parts", blocks).collect()] == want[:1]
    none = search.tag_blocks(tags.where("id > 5"))
    assert gather.means(own, "parts", none).count() == 0 and [r.vector for r in gather.means(own, "parts", none, keep=True).collect()] == [None] * 4


def test_projection(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(3, 5))
    x = rng.normal(size=(200, 5))
    y = x @ w.T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, a.tolist(), (a @ w.T).tolist()) for i, a in enumerate(x)] + [(999, None, None)], "id long, x array<double>, y array<double>")
    got = projection.project(df, "x", projection.fit_linear(df, "x", "y", 1e-9)).orderBy("id").collect()
    assert got[-1].projected is None and np.allclose([r.projected for r in got[:200]], y, atol=1e-5)
    weights, cos = projection.fit_layers(x, y, hidden=32, epochs=60, batch=32, rate=1e-2, validate=40)
    assert cos >= 0.9 and len(weights) == 2


# ------------------------------------------------------------------ text


def test_cleaning(spark):
    raw = "<style>p{}</style><p>A &amp; B</p><script>var x;</script> <b>c</b>\n\n&lt;d&gt; ﬁn"
    r = one(spark, tx.clean_html(F.lit(raw)), tx.full_clean(F.lit(raw)), tx.display_text(F.lit("<p>a</p><ul><li>b</li></ul>c")), tx.clean_html(F.lit(None).cast("string")), tx.full_clean(F.lit("a<br>b"), True))
    assert r[0] == "A & B c <d> ﬁn" and r[1] == "A & B c <d> fin" and "* b" in r[2] and r[2].startswith("a\n\n") and r[3] is None and r[4] == "a b"


@pytest.mark.parametrize(("n", "want"), [(0, [0]), (10, [10]), (512, [512]), (513, [512, 65]), (600, [512, 152]), (1200, [512, 512, 304])])
def test_windows_cover_every_word(spark, n, want):
    got = one(spark, tx.windows(F.lit(" ".join(f"w{i}" for i in range(n)))))[0]
    assert [len(w) for w in got] == want
    assert len({x for w in got for x in w}) == n
    if n == 1200:
        assert got[1][0] == "w448"


def test_stemming():
    pairs = {"running": "run", "caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "hoping": "hope", "relational": "relat", "conditional": "condit", "happy": "happi", "generalization": "general", "skies": "sky", "dying": "die", "news": "news", "kilns": "kiln", "trellises": "trellis", "consistency": "consist", "adjustment": "adjust", "controlling": "control", "cries": "cri", "by": "by", "rolling": "roll", "probate": "probat"}
    assert {w: tx._stem(w) for w in pairs} == pairs


def test_bodies_by_type(spark):
    def body(kind, **kw):
        d = kw.pop("dialogue", None)
        c = {n: F.lit(kw.get(n)).cast("string") for n in ("body", "title", "caption", "text", "description", "question", "answer")}
        c["dialogue"] = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("phrase")) for a, b in d]) if d else F.lit(None).cast("array<struct<label:string,phrase:string>>")
        return one(spark, tx.body(F.lit(kind), c))[0]

    assert body("text", body="", title="t") == "t" and body("photo", caption="c") == "c" and body("quote", text="q") == "q" and body("link", title="t") == "t"
    assert body("answer", question="q", answer="a") == "q\na" and body("chat", dialogue=[("a:", "x"), ("b:", "y")]) == "a: x\nb: y" and body("video", body="x") is None and body("chat") is None


def test_quick_language_and_encoder(spark):
    df = spark.createDataFrame([("the cat and the dog is in that house",), ("der hund und die katze ist nicht auf dem tisch",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.guess_language(F.col("t"))).collect()] == ["en", "de", "und", "und"]
    v = tx.hash_encode(["a b c", "a b c", "", None], 32)
    assert np.allclose(v[0], v[1]) and np.linalg.norm(v[0]) == pytest.approx(1) and not v[2].any() and not v[3].any()


# ------------------------------------------------------------------ full text

TEXTS = [(1, "The quick brown fox jumps over the lazy dog"), (2, "A lazy brown dog sleeps; the dog snores"), (3, "Foxes and dogs, quick or not"), (4, None), (5, "")]


@pytest.mark.parametrize(
    ("query", "want"),
    [("brown dog", {1, 2}), ('"lazy dog"', {1}), ('"brown dog"', {2}), ("fox OR sleeps", {1, 2}), ("dog -fox", {2}), ("-fox", {2, 3, 4, 5}), ("", set()), ("  ! ", set()), ('fox "lazy dog" OR snores', {1, 2}), ('"unclosed lazy', set()), ("OR", set())],
)
def test_queries(spark, query, want):
    df = spark.createDataFrame(TEXTS, "id long, t string")
    assert {r.id for r in fulltext.keyword_scores(df, "id", "t", query).collect()} == want


def test_english_queries(spark):
    df = spark.createDataFrame(TEXTS, "id long, t string")
    got = {r.id: r.kw_score for r in fulltext.keyword_scores(df, "id", "t", "foxes quickly dogs", "english").collect()}
    assert set(got) == set() or set(got) <= {1, 3}
    assert {r.id for r in fulltext.keyword_scores(df, "id", "t", "the foxes", "english").collect()} == {1, 3}
    assert fulltext.parse("the of and", "english") is None


def test_cover_density():
    at = lambda t: {w: [i for i, x in enumerate(t.split(), 1) if x == w] for w in t.split()}
    p = fulltext.parse
    assert fulltext.cover_density(p("a"), at("a b a a")) == pytest.approx(0.3)
    assert fulltext.cover_density(p("a b"), at("a b x x a")) == pytest.approx(0.1 + 0.1 / 3)
    assert fulltext.cover_density(p("a b"), at("a x x b")) == pytest.approx(0.1 / 3)
    assert fulltext.cover_density(p("a OR b"), at("a x b")) == pytest.approx(0.2)


# ------------------------------------------------------------------ retrieval and fusion


def posts(spark):
    return spark.createDataFrame(
        [(1, 7, "red fox", 342, "2023-11-14", False, "en"), (2, 7, "red red fox", 87, "2023-11-15", False, "de"), (3, 8, "blue fox", None, None, False, None), (4, 8, "red", 10**6, "2024-01-01", True, "en"), (5, 9, None, 5, "2025-06-01", None, "en")],
        "id long, account_id long, body_clean string, note_count long, published_at string, nsfw boolean, lang string",
    ).withColumn("published_at", F.to_timestamp("published_at"))


def test_filters_never_let_unsafe_posts_through(spark):
    p = posts(spark)
    tags = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    pt = spark.createDataFrame([(1, 1), (4, 1), (5, 2), (2, 2)], "post_id long, tag_id long")
    ids = lambda f: {r.id for r in retrieve.allowed(p, f, pt, tags).collect()}
    assert ids(Filters()) == {1, 2, 3, 5} and ids(Filters(lang="en")) == {1, 5} and ids(Filters(min_notes=100)) == {1} and ids(Filters(date_from="2024-01-01")) == {5} and ids(Filters(tags=("x",))) == {1} and ids(Filters(tags=("x", "y"), lang="en")) == {1, 5} and ids(Filters(tags=("none",))) == set()
    with pytest.raises(ValueError):
        retrieve.allowed(p, Filters(tags=("x",)))


def test_keyword_and_vector_lists(spark):
    assert [tuple(r) for r in retrieve.keyword_topk(posts(spark), "red", 2).collect()] == [(4, 0.1), (1, 0.1)] or [r.id for r in retrieve.keyword_topk(posts(spark), "red", 2).collect()] == [2, 1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, 0.0])], "id long, v array<float>")
    want = [(1, 1.0), (6, 1.0), (2, 0.6)]
    assert [tuple(r) for r in retrieve.vector_topk(v, "id", "v", [2.0, 0.0], 3).collect()] == want
    assert [tuple(r) for r in retrieve.vector_topk_native(v, "id", "v", [2.0, 0.0], 3).collect()] == want
    assert retrieve.vector_topk(v, "id", "v", [0.0, 0.0], 3).count() == 0


def test_rrf_values(spark):
    kw = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    vec = spark.createDataFrame([(2, 1), (1, 2), (3, 3)], "id long, rank int")
    got = {r.id: r.rrf for r in fusion.rrf([kw, vec], "id").collect()}
    assert got[1] == pytest.approx(1 / 61 + 1 / 62) and got[2] == got[1] and got[3] == pytest.approx(1 / 63)


def test_pages_are_disjoint_and_end(spark):
    r = spark.createDataFrame([(i, 1.0 / i, i) for i in range(1, 8)], "id long, score double, place int")
    a = fusion.page(r, 3).orderBy("place").collect()
    b = fusion.page(r, 3, a[-1].next_cursor).orderBy("place").collect()
    c = fusion.page(r, 3, b[-1].next_cursor).orderBy("place").collect()
    assert [x.id for x in a + b + c] == list(range(1, 8)) and c[-1].next_cursor is None and a[0].next_cursor is None
    gone = fusion.page(r.where("id <> 3"), 3, a[-1].next_cursor).orderBy("place").collect()
    assert [x.id for x in gone] == [4, 5, 6]
    assert fusion.page(r, 3, scoring.encode_cursor(0.0, 99)).count() == 0


def test_account_rollup(spark):
    r = spark.createDataFrame([(1, 7, 4.0, 1), (2, 7, 4.0, 2), (3, 8, 2.0, 3)], "id long, account_id long, score double, place int")
    v = spark.createDataFrame([(8, 0.9), (9, -0.1)], "account_id long, cosine double")
    got = {x.account_id: x.score for x in fusion.account_rollup(r, v).collect()}
    a = {7: 8 / math.sqrt(2), 8: 2.0, 9: 0.0}
    top = max(a.values())
    want = {k: 0.6 * a[k] / top + 0.4 * ({7: 0.0, 8: 0.9, 9: -0.1}[k] + 0.1) for k in a}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in a)
    flat = {x.account_id: x.score for x in fusion.account_rollup(r.where("id = 3"), v.where("account_id = 8")).collect()}
    assert flat == {8: 1.0}


def test_account_search_order(spark):
    names = ["photography", "photography-art", "photgraphy-typo", "testblog123", "photo"]
    a = spark.createDataFrame([(i, n, i, None, "d" * 300 if i == 0 else ("" if i == 1 else None)) for i, n in enumerate(names)], "id long, blog_name string, total_posts long, avatar_url string, description string")
    got = search.search_accounts(a, " Photography ", 10).collect()
    assert [r.match_type for r in got][:2] == ["exact", "prefix"] and got[0].blog_name == "photography" and len(got[0].description_snippet) == 120 and got[1].description_snippet is None
    assert [r.blog_name for r in search.search_accounts(a, "photgraphy", 10).collect()][0] in ("photgraphy-typo", "photography")
    assert search.search_accounts(a, "zzzzzzqqqqqxxx999").count() == 0 and search.search_accounts(a, "  ").count() == 0


def test_tag_search_merges_kinds(spark):
    t = spark.createDataFrame([(1, "sunset", 500, [0.5, 0.1]), (2, "sunsets", 100, None), (3, "golden hour", 80, [1.0, 0.0]), (4, "noise", None, [-1.0, 0.0])], "id long, name string, usage_count long, embedding array<float>")
    got = {r.name: r for r in search.search_tags(t, "Sunset", [1.0, 0.0]).collect()}
    assert got["sunset"].match_type == "exact" and got["sunsets"].match_type == "prefix" and got["golden hour"].match_type == "semantic"
    assert got["sunset"].score == pytest.approx(1 + 0.6 * 0.980581 + 0.3, abs=1e-5) and got["sunsets"].cosine == 0
    assert search.search_tags(t, " ", [1.0, 0.0]).count() == 0


def test_engine(spark):
    p = posts(spark).withColumn("image_urls", F.lit(None).cast("array<string>"))
    t = {
        "posts": p,
        "post_vectors": spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])], "id long, vector array<double>"),
        "accounts": spark.createDataFrame([(7, "a", 1, None, None, [1.0, 0.0]), (8, "b", 2, None, None, None), (9, "c", 0, None, None, None)], "id long, blog_name string, total_posts long, avatar_url string, description string, embedding array<float>"),
        "tags": spark.createDataFrame([(1, "x", 3, [1.0, 0.0])], "id long, name string, usage_count long, embedding array<float>"),
        "post_tags": spark.createDataFrame([(1, 1)], "post_id long, tag_id long"),
        "communities": spark.createDataFrame([(1, "one", "tag_cluster", [1], [1.0, 0.0]), (2, "two", "account_cluster", [7, 8], [0.0, 1.0]), (3, "three", "tag_cluster", None, [0.0, 0.0])], "id long, name string, type string, member_ids array<long>, centroid array<float>"),
    }
    e = search.Engine(t, lambda texts: np.asarray([[1.0, 0.0]] * len(texts)), as_of())
    got = e.general("red", limit_posts=1)
    assert got["total"] == 3 and got["next_cursor"] and len(got["posts"]) == 1 and 4 not in [x["id"] for x in got["posts"]]
    rest = e.general("red", limit_posts=5, cursor=got["next_cursor"])
    assert not {x["id"] for x in rest["posts"]} & {got["posts"][0]["id"]} and rest["next_cursor"] is None and {a["account_id"] for a in got["accounts"]} == {7, 8}
    assert e.general("red", limit_posts=1) is got and e.cache.hits == 1
    assert e.accounts("a")[0]["match_type"] == "exact" and e.tags("x")[0]["match_type"] == "exact"
    c = e.communities("q")
    assert c[0]["community_id"] == 1 and c[0]["top_tags"] == ["x"] and c[1]["top_accounts"] == ["a", "b"] and len(c) == 2
    assert e.dispatch("nothing", "red")["total"] == 3
    for bad in (lambda: e.general(""), lambda: e.general("x", limit_posts=101), lambda: e.general("x", cursor="?"), lambda: e.accounts("x", 51)):
        with pytest.raises(ValueError):
            bad()


# ------------------------------------------------------------------ safety


def test_safety_gate(spark):
    prompts = [[1.0, 0.0]] * 4 + [[0.0, 1.0]] * 4
    img = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (3, [0.0, 0.0])], "id long, v array<float>")
    s = safety.image_scores(img, "id", "v", prompts, 4, 0.7, 2.0)
    p = spark.createDataFrame([(1, "nice"), (2, "Some BadWord here"), (3, "Some BadWord here"), (4, None)], "id long, body_clean string")
    got = {r.id: (r.nsfw_score, r.nsfw) for r in safety.gate(p, s, ["badword"]).collect()}
    assert got[1][1] and got[1][0] > 0.7 and got[2] == (0.5, False) and got[3] == (1.0, True) and got[4] == (0.0, False)


# ------------------------------------------------------------------ ingestion


def test_normalise_posts(spark):
    feed = spark.createDataFrame([(1, "text", "<p>Hi &amp; bye</p>", "12", 1700000000, ["a"]), (2, "video", "x", "1", 1, None), (3, "text", None, "many", None, None), (None, "text", "x", "1", 1, None)], "id long, type string, body string, note_count string, timestamp long, tags array<string>").withColumn("blog_name", F.lit("b"))
    got = {r.tumblr_id: r for r in ingest.normalise(feed).collect()}
    assert set(got) == {1, 3} and got[1].body_clean == "Hi & bye" and got[1].note_count == 12 and got[1].published_at.isoformat() == "2023-11-14T22:13:20" and got[3].note_count == 0 and got[3].tags == [] and got[3].body_raw is None


def test_upserts_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, body string, notes long")
    n = spark.createDataFrame([(2, "edited", 9, 1), (2, "edited", 10, 2), (3, "c", 1, 1), (1, "z", None, 1)], "k long, body string, notes long, at int")
    once = ingest.upsert(t, n, "k", ["notes"], F.col("at"))
    assert rows(once) == [(1, "a", 5), (2, "b", 10), (3, "c", 1)] and rows(ingest.upsert(once, n, "k", ["notes"], F.col("at"))) == rows(once)
    with pytest.raises(ValueError):
        ingest.last_write(t, n.drop("notes"), "k", ["notes"])


def test_new_ids_follow_the_highest(spark):
    t = spark.createDataFrame([(4, "a"), (9, "b")], "id long, name string")
    n = spark.createDataFrame([("b",), ("c",), ("d",), ("c",), (None,)], "name string")
    got = {r.name: r.id for r in ingest.with_ids(t, n, "name").collect()}
    assert got["a"] == 4 and got["b"] == 9 and {got["c"], got["d"]} == {10, 11} and len(got) == 4


def test_crawl_state_machine(spark):
    s = spark.createDataFrame([("a", 10, "active", 2), ("b", 10, "active", 1), ("c", 10, "pending", 2), ("d", 10, "active", 0), ("e", 10, "paused", 1)], "blog_name string, last_timestamp long, status string, fail_count long").withColumn("last_crawled_at", F.lit(None).cast("timestamp"))
    o = spark.createDataFrame([("a", False, 0, None), ("b", False, 0, None), ("c", True, 5, 7), ("d", True, 0, None)], "blog_name string, ok boolean, posts long, last_timestamp long")
    got = {r.blog_name: (r.status, r.fail_count, r.last_timestamp) for r in ingest.crawl_step(s, o, 0, 10).collect()}
    assert got == {"a": ("dead", 3, 10), "b": ("active", 2, 10), "c": ("active", 0, 7), "d": ("done", 0, 10), "e": ("paused", 1, 10)}
    full = {r.blog_name: r.status for r in ingest.crawl_step(s, o, 10, 10).collect()}
    assert full == {"a": "paused", "b": "paused", "c": "paused", "d": "paused", "e": "paused"}
    assert [r.blog_name for r in ingest.crawl_queue(s).collect()] == ["c", "e", "a", "b", "d"]


# ------------------------------------------------------------------ communities


def clusters(n=3, per=15, size=16):
    rng = np.random.default_rng(0)
    return [(i, (np.eye(size)[i % n] + rng.normal(scale=0.05, size=size)).tolist(), i % n) for i in range(n * per)]


def test_tight_clusters_are_found(spark):
    df = spark.createDataFrame(clusters(), "id long, v array<double>, label long")
    k, score, got = cm.choose_k(df, "id", "v", (2, 3, 5), seeds=2)
    assert k == 3 and score > 0.5
    pairs = {(r.label, r.id % 3) for r in got.collect()}
    assert len(pairs) == 3
    d = cm.density_clusters(df, "id", "v", 5).collect()
    assert len({(r.label, r.id % 3) for r in d if r.label >= 0}) == 3 and sum(r.label < 0 for r in d) <= 5
    assert all(r.label == -1 for r in cm.density_clusters(df.limit(6), "id", "v", 5).collect())
    assert rows(cm.density_clusters(df, "id", "v", 5, most=10)) == rows(cm.density_clusters(df, "id", "v", 5))


def test_density_clusters_of_many_blocks_are_those_of_one_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 4, 9)] + [rng.uniform(-20, 20, (20, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    one = {r.id: r.label for r in cm.density_clusters(df, "id", "v").collect()}
    monkeypatch.setattr(cm._density_spread, "__defaults__", (30,))
    many = {r.id: r.label for r in cm.density_clusters(df, "id", "v", most=50).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert set(one.values()) >= {0, 1, 2} and groups(one) == groups(many) and {k for k in one if one[k] < 0} == {k for k in many if many[k] < 0}
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)], "id long, v array<double>")
    assert cm.density_clusters(same, "id", "v", most=20).count() == 60


def test_cluster_queries_try_all_candidates_and_seeds(spark, monkeypatch):
    from driftwell.plans import queries_content as qc

    df = spark.createDataFrame(clusters(3, 70), "vec_id long, embedding array<double>, label long")
    tried = []

    def one(rows, key, vector, k, seeds=10, seed=42):
        tried.append((k, seeds))
        return rows.select(key, vector, (F.col(key) % k).alias("label"))

    monkeypatch.setattr(cm, "kmeans", one)
    monkeypatch.setattr(qc, "read", lambda *_: df)
    for q in (qc.choose_clusters, qc.kmeans_communities):
        tried.clear()
        assert q(spark, "").count() >= 1 and tried == [(k, 10) for k in (30, 50, 100, 150, 200)]


def test_silhouette_covers_all_points(spark):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(5200, 4)), rng.integers(0, 3, 5200)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))], "id long, v array<double>, label long")
    got = {r.id: r.silhouette for r in cm.silhouette(df, "id", "v", "label").collect()}
    assert len(got) == 5200
    for i in range(0, 5200, 400):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        a = d[label == label[i]].sum() / ((label == label[i]).sum() - 1)
        b = min(d[label == c].mean() for c in range(3) if c != label[i])
        assert got[i] == pytest.approx((b - a) / max(a, b))


def test_silhouette_of_lone_points_is_zero(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [0.1], 0), (3, [5.0], 1)], "id long, v array<double>, label long")
    got = {r.id: r.silhouette for r in cm.silhouette(df, "id", "v", "label").collect()}
    assert got[3] == 0 and got[1] == pytest.approx((5 - 0.1) / 5) and cm.silhouette(df.limit(0), "id", "v", "label").count() == 0


def test_cluster_names(spark):
    df = spark.createDataFrame(clusters(), "id long, v array<double>, label long")
    near = cm.nearest_members(df, "id", "label", "v", 5)
    assert near.groupBy("label").count().where("count = 5").count() == 3
    named = near.withColumn("name", F.when(F.col("label") < 2, F.concat(F.lit("t"), "place")))
    assert {r.label: r.name for r in cm.names(named, "label", "name").collect()} == {0: "t1 · t2 · t3", 1: "t1 · t2 · t3", 2: "cluster_2"}


# ------------------------------------------------------------------ evaluation


@pytest.mark.parametrize(("grades", "k", "ndcg"), [([2, 1, 0, 0, 0], 10, 1.0), ([0, 0, 0, 0, 2], 3, 0.0), ([2, 0, 1], 3, 0.9502), ([0, 0], 10, 0.0)])
def test_ndcg(spark, grades, k, ndcg):
    run = spark.createDataFrame([("q", i, g) for i, g in enumerate(grades, 1)], "query_id string, place int, grade int")
    got = evaluate.metrics(run, k=k).first()
    assert got.ndcg == pytest.approx(ndcg, abs=1e-4) or (k == 3 and grades[-1] == 2 and got.ndcg == 0)


def test_other_metrics_and_the_grid(spark):
    run = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 2), ("b", 1, 1), ("b", 2, 0), ("b", 3, 1), ("b", 4, None)], "query_id string, place int, grade int")
    rel = spark.createDataFrame([("a", 1), ("b", 4)], "query_id string, n int")
    got = {r.query_id: r for r in evaluate.metrics(run, recall_k=2, relevant=rel).collect()}
    assert got["a"].rr == pytest.approx(1 / 3) and got["b"].ap == pytest.approx(0.8333, abs=1e-4) and got["b"].recall == 0.25 and got["a"].recall == 0
    assert evaluate.summary(evaluate.metrics(run)).first().queries == 2
    train, test = evaluate.split([f"q{i}" for i in range(10)])
    assert len(train) == 8 and len(test) == 2 and evaluate.split([f"q{i}" for i in range(10)]) == (train, test)
    assert len(evaluate.grid()) == 54 and all(x[3] > 0 for x in evaluate.grid())
    s = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "config int, ndcg double")
    assert evaluate.best(s).first().config == 1


# ------------------------------------------------------------------ statistics and SQL


def test_browsing_and_sql(spark):
    t = {"api_keys": spark.createDataFrame([(1, "secret", "x")], "id long, key_hash string, label string"), "tags": spark.range(9)}
    assert "key_hash" not in stats.browse(t, "api_keys").columns and stats.browse(t, "tags", 5).count() == 5
    for name, n in (("nothing", 5), ("tags", 0), ("tags", 501)):
        with pytest.raises(ValueError):
            stats.browse(t, name, n)
    spark.range(4).createOrReplaceTempView("four")
    assert stats.run_sql(spark, "select count(*) as n from four")["rows"] == [{"n": 4}]
    every, some = stats.run_sql(spark, "select id from range(700)"), stats.run_sql(spark, "select id from range(700)", 500)
    assert len(every["rows"]) == 700 and not every["truncated"] and len(some["rows"]) == 500 and some["truncated"]
    assert stats.run_sql(spark, "SELECT 'DropTable' AS x")["rows"] == [{"x": "DropTable"}]
    assert "error" in stats.run_sql(spark, "with a as (select 1 as x) insert into four select x from a")
    assert all("error" in stats.run_sql(spark, q) for q in ("drop view four", "insert into four values (1)", "select * from nothing", "", "set a=b"))
    assert stats.missing_tables(["tags"]) == sorted(set(stats.BROWSABLE) - {"tags"})


def test_query_lexemes_cover_all_texts(spark, monkeypatch):
    from driftwell.plans import queries_content as qc

    items = spark.createDataFrame([(1, "one two three four five six Seven"), (6, "eight-nine -ten OR"), (7, None)], "item_id long, text string")
    posts = spark.createDataFrame([(1, "seven seven eight"), (2, "Nine or ten, seven"), (3, "eleven"), (4, None)], "id long, body_clean string")
    monkeypatch.setattr(qc, "read", lambda *_: items)
    monkeypatch.setattr(qc, "current_posts", lambda *_: posts)
    assert {r.term: r.posts for r in qc.query_lexemes(spark, "").collect()} == {"seven": 2, "eight": 1, "nine": 1, "or": 1, "ten": 1}


def test_latencies(spark):
    r = stats.latencies(spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double"), "ms").first()
    assert (r.mean, r.p50, r.p95) == (50.5, 50.5, 96.0)


# ------------------------------------------------------------------ sources and streams


def test_text_sources(spark, tmp_path):
    (tmp_path / "qrels.tsv").write_text("# c\n\nq1\t5\t2\nq1\tx\t1\nq2\t6\nq2\t7\t0\n")
    (tmp_path / "queries.tsv").write_text("q1\tsunset\nq2\tcats\ttag\n#x\ty\nbad\n")
    (tmp_path / "block.txt").write_text("# words\n\n Foo \nBAR\nfoo\n")
    assert rows(files.read_qrels(spark, str(tmp_path / "qrels.tsv"))) == [("q1", 5, 2), ("q2", 7, 0)]
    assert rows(files.read_queries(spark, str(tmp_path / "queries.tsv"))) == [("q1", "sunset", "general"), ("q2", "cats", "tag")]
    assert rows(files.read_blocklist(spark, str(tmp_path / "block.txt"))) == [("bar",), ("foo",)]


def png(path, img):
    import struct
    import zlib

    h, w, _ = img.shape
    raw = b"".join(b"\0" + img[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = np.kron(rng.integers(0, 255, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    for post, name, img in (("p1", "a.jpg", a), ("p1", "b.jpg", np.clip(a.astype(int) + 2, 0, 255).astype(np.uint8)), ("p2", "c.jpg", a[:, ::-1].copy())):
        (tmp_path / post).mkdir(exist_ok=True)
        png(tmp_path / post / name, img)
    (tmp_path / "p2" / "broken.jpg").write_bytes(b"not an image")
    img = files.read_images(spark, str(tmp_path))
    assert img.count() == 3
    hashed = files.hash_images(img)
    one_each = files.dedupe_images(hashed)
    assert {r.post_id for r in one_each.collect()} == {"p1", "p2"} and one_each.count() == 2
    full = img.join(hashed.select("origin", "phash"), "origin")
    vec, cache = files.encode_images(full, lambda own: [np.frombuffer(d, np.uint8)[:4] / 255 for _, _, _, d in own])
    assert vec.count() == 3 and cache.count() == 2
    again, grown = files.encode_images(full, lambda *_: (_ for _ in ()).throw(AssertionError), cache)
    assert grown.count() == 2 and again.count() == 3
    assert files.storage_bytes(spark, str(tmp_path)).first()["files"] == 4


def test_versions_swap_at_once(spark, tmp_path):
    d = str(tmp_path / "t")
    files.write_version(spark.range(3), d, "1")
    files.write_version(spark.range(5), d, "2")
    assert files.read_version(spark, d).count() == 5


def feed_files(path):
    path.mkdir()
    for k in range(3):
        (path / f"f{k}.json").write_text("\n".join(json.dumps({"id": 10 * k + i, "type": "text" if i else "video", "blog_name": "ab"[i % 2], "timestamp": 100 * k + i, "body": f"<p>n{i}</p>", "tags": ["x"] if i == 2 else [], "note_count": i}) for i in range(4)) + "\nnot json\n")
    return str(path)


def test_feed_source(spark, tmp_path):
    p = feed_files(tmp_path / "feed")
    spark.dataSource.register(FeedSource)
    load = lambda **o: spark.read.format("feed").options(path=p, **o).load()
    assert load().where("not bad").count() == 12 and load().where("bad").count() == 3 and {r.blog_name for r in load(blog="a").collect()} == {"a"} and load(tag="x").count() == 3
    assert {r.timestamp for r in load(before=100).collect()} == {0, 1, 2, 3}
    assert [r.id for r in feed.page(spark, p, limit=5).collect()] == [23, 22, 21, 20, 13] and [r.id for r in feed.page(spark, p, blog="a", before=200, limit=3).collect()] == [12, 10, 2]
    assert feed.page(spark, p, blog="none").count() == 0
    assert {tuple(r) for r in feed.blog_info(spark, p).collect()} == {("a", 6, 0, 202, 6), ("b", 6, 1, 203, 12)} and feed.blog_info(spark, p, "b").first()["posts"] == 6


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 20])
def test_paging_back_takes_every_post_once(spark, tmp_path, limit):
    p = feed_files(tmp_path / "feed")
    (tmp_path / "feed" / "g.json").write_text("\n".join(json.dumps({"id": 100 + i, "blog_name": "a", "timestamp": 102}) for i in range(4)))  # five posts of one second
    seen, pages = [], iter(range(3))
    at = feed.page_back(spark, p, lambda rows: seen.extend(r.id for r in rows.collect()), blog="a", limit=limit, go_on=lambda: next(pages, None) is not None)
    feed.page_back(spark, p, lambda rows: seen.extend(r.id for r in rows.collect()), blog="a", before=at, limit=limit)  # resumed
    assert sorted(seen) == [0, 2, 10, 12, 20, 22, 100, 101, 102, 103]


def test_feed_stream_has_a_task_for_each_file_and_dead_letters(spark, tmp_path):
    p = feed_files(tmp_path / "feed")
    spark.dataSource.register(FeedSource)
    sink = streams.PostSink(spark, str(tmp_path / "posts"), buckets=4)
    run = lambda: streams.run_once(spark.readStream.format("feed").option("path", p).load(), sink, str(tmp_path / "cp"))
    run()
    assert sink.table().count() == 9 and sink.dead().count() == 3 and {r.reason for r in sink.dead().collect()} == {"no id, no blog_name"}
    (tmp_path / "feed" / "h.json").write_text(json.dumps({"id": 77, "type": "text", "blog_name": "c", "timestamp": 9, "body": "x"}))
    run()
    assert sink.table().count() == 10 and sink.posts.writes() == [0, 1]


def test_feed_stream_into_the_posts_table(spark, tmp_path):
    p = feed_files(tmp_path / "feed")
    schema = "id long, type string, blog_name string, timestamp long, body string, tags array<string>, note_count string"
    sink = streams.PostSink(spark, str(tmp_path / "posts"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(p)
    streams.run_once(stream(), sink, str(tmp_path / "cp"))
    assert sink.table().count() == 9 and sink.table().where("post_type = 'video'").count() == 0
    streams.run_once(stream(), sink, str(tmp_path / "cp"))
    assert sink.table().count() == 9
    gate = streams.PostSink(spark, str(tmp_path / "gated"), target=3)
    streams.run_once(stream(), gate, str(tmp_path / "cp2"))
    assert gate.table().count() == 3


def test_bucket_tables_touch_only_what_a_batch_names(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "id", buckets=8)
    made = lambda *r: spark.createDataFrame(list(r), "id long, v string, at int")
    fold = lambda old, new: ingest.last_write(old, new, "id", order=F.col("at"))
    assert t.table() is None and t.write(made(*[(i, "a", 0) for i in range(40)]), 0, fold) == 8
    assert t.write(made((3, "late", 2), (3, "early", 1), (99, "b", 0)), 1, fold) <= 2
    assert t.write(made((3, "again", 9)), 1, fold) == 0  # the same write once more
    got = {r.id: r.v for r in BucketTable(spark, str(tmp_path / "t"), "id").table().collect()}
    assert len(got) == 41 and got[3] == "late" and got[99] == "b" and got[4] == "a"
    told = t.compact()
    assert told["rows"] == 41 and told["error"] is None and t.table().count() == 41 and BucketTable(spark, str(tmp_path / "none"), "id").compact()["error"]
    empty = BucketTable(spark, str(tmp_path / "e"), "id", made((1, "", 1)).schema)
    assert empty.table().count() == 0 and empty.write(made((1, "x", 1)).limit(0), 0, fold) == 0 and empty.table().columns == ["id", "v", "at"]


def test_account_vectors_follow_new_posts(spark, tmp_path):
    sink = streams.AccountVectorSink(spark, str(tmp_path / "v"), window=2, buckets=4)
    made = lambda *r: spark.createDataFrame(list(r), "id long, account_id long, vector array<double>, published_at timestamp")
    day = lambda k: datetime(2025, 1, k)
    sink(made((1, 10, [1.0, 0.0], day(1)), (2, 10, [0.0, 1.0], day(2)), (3, 11, [1.0, 1.0], day(1)), (4, None, [1.0, 1.0], day(1))), 0)
    sink(made((5, 10, [0.0, 1.0], day(3)), (3, 11, [3.0, 0.0], day(4))), 1)
    got = {r.id: (r.posts, [round(x, 6) for x in r.vector]) for r in sink.vectors.table().collect()}
    assert got == {10: (2, [0.0, 1.0]), 11: (1, [1.0, 0.0])}


def test_account_points_are_numbers_of_tags(spark, tmp_path):
    tags = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "id long, embedding array<float>")
    made = lambda *r: spark.createDataFrame(list(r), "id long, account_id long, parts array<long>, published_at timestamp")
    sink = streams.AccountVectorSink(spark, str(tmp_path / "v"), window=2, buckets=4, blocks=search.tag_blocks(tags))
    day = lambda k: datetime(2025, 1, k)
    sink(made((1, 10, [1], day(1)), (2, 10, [2], day(2)), (3, 11, [1, 2], day(1)), (4, None, [1], day(1)), (6, 10, [3, 99], day(9)), (7, 10, None, day(9)), (8, 12, [], day(9))), 0)
    sink(made((5, 10, [2, 3], day(3)), (3, 11, [1], day(4))), 1)
    got = {r.id: (r.posts, [round(x, 6) for x in r.vector]) for r in sink.vectors.table().collect()}
    assert got == {10: (2, [0.0, 1.0]), 11: (1, [1.0, 0.0])} and set(sink.points.table().columns) == {"id", "account_id", "parts", "published_at"}


def test_last_writes_have_an_order(spark):
    table = spark.createDataFrame([(1, 5, "o")], "id long, at int, urls string")
    new = spark.createDataFrame([(1, 7, "x"), (1, 9, None), (2, 1, "z"), (2, 3, "y"), (None, 1, "n")], "id long, at int, urls string")
    assert rows(ingest.last_write(table, new, "id", order=F.col("at"))) == [(1, 9, None), (2, 3, "y")]
    assert rows(ingest.upsert(table, new, "id", ["at", "urls"], F.col("at"), ("urls",))) == [(1, 9, None), (2, 3, "y")]
    assert rows(ingest.upsert(table, new, "id", ["at", "urls"], F.col("at"))) == [(1, 9, "o"), (2, 3, "y")]
    assert sorted(map(tuple, ingest.chunks(spark.createDataFrame([(i * 3,) for i in range(7)] + [(0,), (None,)], "id long"), size=3).collect())) == [(3 * i, i // 3) for i in range(7)]


def test_words_of_all_scripts(spark):
    texts = ["Сегодня утром", "今日は、晴れ", "Straße", "cœur à cœur", "naïve_file-7", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body_clean string")
    got = [r.w for r in df.orderBy("id").select(tx.simple_terms(F.col("body_clean")).alias("w")).collect()]
    assert got == [["сегодня", "утром"], ["今日は", "晴れ"], ["straße"], ["cœur", "à", "cœur"], ["naïve", "file", "7"], [], []] == [tx.simple_words(t) for t in texts]
    for q, i in (("утром", 0), ("晴れ", 1), ("straße", 2), ('"à cœur"', 3)):
        assert [r.id for r in retrieve.keyword_topk(df, q, 5, "simple").collect()] == [i], q
    from driftwell.functions import trigram

    assert spark.range(1).select(trigram.similarity(F.lit("утро"), F.lit("утром"))).first()[0] > 0.4


def test_the_english_prefilter_loses_nothing(spark):
    words = "relational conflated hoping hopping happily happiness ties cries skies dying generously sensibility vietnamization conditional nationally dependency activity cats ponies agreed feeding proceeds early ugly communism".split()
    df = spark.createDataFrame([(i, f"The {w} here") for i, w in enumerate(words)], "id int, body_clean string")
    for i, w in enumerate(words):
        assert i in {r.id for r in fulltext.keyword_scores(df, "id", "body_clean", w, "english").collect()}, w
    every = df.where(F.lit(True))
    for w in words:
        [(stem, _)] = [x for x in tx.english_positions(w)] or [(None, 0)]
        want = {i for i, x in enumerate(words) if [y for y, _ in tx.english_positions(x)] == [stem]}
        assert want <= {r.id for r in every.where(tx.may_hold(stem, F.col("body_clean"))).collect()}


def test_long_texts_rank_in_proportion():
    import time

    at = {"a": list(range(1, 80_001, 2)), "b": list(range(2, 80_001, 2))}
    began = time.time()
    assert math.isclose(fulltext.cover_density(fulltext.parse("a b"), at), 0.1 * 79_999) and time.time() - began < 3


def test_a_store_answers_like_a_scan(spark, tmp_path):
    rng = random.Random(3)
    posts = spark.createDataFrame([(i, i % 5, " ".join(rng.choices("kiln shelf glaze barn утром".split(), k=9)), rng.random() < 0.1, rng.randrange(200), "en", None) for i in range(200)], "id long, account_id long, body_clean string, nsfw boolean, note_count long, lang string, published_at timestamp")
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "id long, vector array<double>")
    held = store.SearchStore.build(spark, posts, vectors, "english", str(tmp_path / "s"))
    held = store.SearchStore(spark, str(tmp_path / "s"))
    q, now = [rng.gauss(0, 1) for _ in range(8)], F.lit("2025-07-01").cast("timestamp")
    for text, f in (("kilns shelf", Filters()), ("утром OR barn", Filters(min_notes=50)), ("-kiln", Filters()), ("", Filters())):
        scan = search.ranked_posts(posts, vectors, text, q, now, f)
        assert rows(search.ranked_posts(held.posts, None, text, q, now, f, store=held)) == rows(scan), text
    make = lambda: store.SearchStore.build(spark, posts, vectors, "english", str(tmp_path / "t"))
    kept = store.stored(spark, ("k", str(tmp_path)), make)
    assert store.stored(spark, ("k", str(tmp_path)), make) is kept
    shutil.rmtree(tmp_path / "t")
    again = store.stored(spark, ("k", str(tmp_path)), make)
    assert again is not kept and again.posts.count() == 200
    exact = {r.id for r in held.nearest(q, 10, Filters()).collect()}
    assert len(exact & {r.id for r in held.nearest(q, 10, Filters(), probes=8).collect()}) >= 7


def test_grid_winner_and_test_run(spark):
    lists = spark.createDataFrame([("q1", [(1, 1, 2, 0, 0.0), (2, 2, 1, 9, 2.0)]), ("q2", [(3, 1, 1, 0, 0.0)])], "query_id string, r array<struct<post_id:long,p1:int,p2:int,notes:long,g:double>>")
    n = {(r.config, r.query_id): r.ndcg for r in evaluate.grid_metrics(lists, evaluate.grid()).collect()}
    assert len(n) == 2 * len(evaluate.grid()) and n[0, "q2"] == 0.0 and max(v for (c, q), v in n.items() if q == "q1") == 1.0
    keys = spark.createDataFrame([(f"q{i}", 1) for i in range(10)] * 2, "query_id string, x int")
    train, test = evaluate.split_rows(keys, "query_id")
    a, b = ({r.query_id for r in x.collect()} for x in (train, test))
    assert len(a) == 8 and len(b) == 2 and not a & b and train.count() == 16


def test_training_over_partitions_is_full_batch_training(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 6)), rng.normal(size=(60, 5))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pairs = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)] + [(None, [0.0] * 5)], "x array<double>, y array<double>").repartition(5)
    got, cosine = projection.fit_layers_spread(pairs, "x", "y", hidden=7, epochs=3)
    p = projection._start(6, 5, 7, 42)
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(3):
        grads, total = projection._gradient(p, x, y, 60)
        for i, g in enumerate(grads):
            projection._adam(p, m, v, i, g, t + 1, 3e-3 * 0.5 * (1 + math.cos(math.pi * t / 3)), 1e-4)
    assert np.allclose(got[0][0], p[0]) and np.allclose(got[1][1], p[3]) and math.isclose(cosine, total / 60)
    # the gradient is that of the loss
    loss = lambda w: ((projection.layer(x, [(w, q[1]), (q[2], q[3])]) - y) ** 2).mean() + 0.5 * (1 - (projection.layer(x, [(w, q[1]), (q[2], q[3])]) * y).sum(axis=1)).mean()
    q = projection._start(6, 5, 7, 1)
    grads, _ = projection._gradient(q, x, y, 60)
    step = np.zeros_like(q[0])
    step[2, 3] = 1e-6
    assert math.isclose((loss(q[0] + step) - loss(q[0] - step)) / 2e-6, grads[0][2, 3], rel_tol=1e-3, abs_tol=1e-7)
    with pytest.raises(ValueError):
        projection.fit_layers_spread(pairs.limit(0), "x", "y")


def test_image_jobs_end_with_a_status_and_a_norm(spark):
    posts = spark.createDataFrame([(i,) for i in (1, 2, 3)], "id long")
    images = spark.createDataFrame([(1, False, [3.0, 0.0]), (1, False, [3.0, 8.0]), (2, True, [1.0, 0.0]), (2, False, [1.0, 0.0])], "id long, nsfw boolean, vector array<double>")
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 4)], "id long")
    assert rows(indexing.image_status(posts, asked, images)) == [(1, "ok", 2, 5.0), (2, "nsfw", 2, None), (3, "no_images", 0, None), (4, "not_found", 0, None)]
    assert indexing.image_status(posts, asked, images.drop("vector")).columns == ["id", "status", "n_images"]


def test_old_results_are_purged():
    now = [0.0]
    c = search.Cache(10, clock=lambda: now[0])
    c.put("a", 1)
    now[0] = 8
    c.put("b", 2)
    now[0] = 12
    assert c.purge() == 1 and list(c.held) == ["b"] and c.purge() == 0


def test_images_are_encoded_in_batches(spark):
    images = spark.createDataFrame([(f"p{i}", f"h{i}", 1, 1, 1, bytearray([i])) for i in range(70)], "post_id string, phash string, height int, width int, channels int, data binary").coalesce(1)

    def encoder(own):
        if len(own) > 32 or any(d[0] == 40 for *_, d in own):
            raise ValueError
        return [[float(d[0])] for *_, d in own]

    vec, cache = files.encode_images(images, encoder)
    assert {r.phash for r in cache.collect()} == {f"h{i}" for i in range(70) if i != 40} and vec.count() == 69


def test_accounts_without_posts_keep_their_vector_and_pairs_have_a_mode(spark):
    posts = spark.createDataFrame([(1, [3.0, 4.0], (7, None))], "id long, vector array<float>, payload struct<account_id:long,published_at:timestamp>")
    accounts = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.5, 0.5]), (9, None)], "id long, embedding array<float>")
    got = {r.id: (r.posts, r.vector) for r in indexing.index_accounts(posts, accounts=accounts).collect()}
    assert got == {7: (1, [0.6, 0.8]), 8: (0, [0.5, 0.5]), 9: (0, None)}
    s = spark.createDataFrame([("one two",)], "sentence string")
    img = spark.createDataFrame([("p", "h", [1.0])], "post_id string, phash string, vector array<float>")
    cap = spark.createDataFrame([("h", "a cat")], "phash string, caption string")
    assert indexing.training_pairs(s, None, None, tx.hash_encode, tx.hash_encode, (8, 8))[0] == indexing.training_pairs(s, img.limit(0), cap, tx.hash_encode, tx.hash_encode, (8, 8))[0] == "bootstrap"
    mode, pairs = indexing.training_pairs(s, img, cap, tx.hash_encode, tx.hash_encode, (8, 8))
    assert mode == "image" and pairs.count() == 1


def test_token_bucket_over_batches(spark, tmp_path):
    src = tmp_path / "calls"
    for k in range(2):
        spark.createDataFrame([("u", f"2025-01-01 0{k}:00:0{i}") for i in range(4)], "key string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(str(src))
    s = spark.readStream.schema("key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(src))
    streams.run_once(streams.token_bucket(s, "key", "at", 3, 3600), lambda b, n: b.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}"), str(tmp_path / "cp"))
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("at").collect()
    assert [r.granted for r in got] == [True, True, True, False, True, True, True, False]


# ------------------------------------------------------------------ the catalogue


def test_every_query_has_its_columns_in_the_sql(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 80
    assert SearchConfig().rrf_k == 60


# ------------------------------------------------------------------ indexes


@pytest.mark.parametrize("analyser", ["simple", "english"])
@pytest.mark.parametrize("query", ["brown dog", '"lazy dog"', "fox OR sleeps", "dog -fox", "", "dogs"])
def test_postings_answer_like_a_scan(spark, tmp_path, query, analyser):
    from driftwell.operators import postings

    df = spark.createDataFrame(TEXTS, "id long, t string")
    postings.write(postings.build(df, "id", "t", analyser), str(tmp_path / "p"))
    own = spark.read.parquet(str(tmp_path / "p"))
    want = {r.id: round(r.kw_score, 9) for r in fulltext.keyword_scores(df, "id", "t", query, analyser).collect()}
    assert {r.id: round(r.kw_score, 9) for r in postings.search(own, query, "id", analyser).collect()} == want
    with pytest.raises(ValueError):
        postings.search(own, "-fox")


def test_cells_reach_the_recall(spark):
    from driftwell.operators import ivf

    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 12))
    v = [(i, (base[i % 20] + rng.normal(size=12) * 0.3).tolist()) for i in range(1500)] + [(9000, None), (9001, [0.0] * 12)]
    df = spark.createDataFrame(v, "id long, v array<float>")
    at = ivf.fit_cells(df, "id", "v", 24)
    own = ivf.assign(df, "id", "v", at).persist()
    assert own.count() == 1500
    hit = 0
    for q in range(0, 200, 20):
        exact = [r.id for r in retrieve.vector_topk(df, "id", "v", v[q][1], 10).collect()]
        hit += len(set(exact) & {r.id for r in ivf.topk(own, "id", "v", at, v[q][1], 10, 6).collect()})
        assert [r.id for r in ivf.topk(own, "id", "v", at, v[q][1], 10, 24).collect()] == exact
    assert hit >= 90


# ------------------------------------------------------------------ index jobs


def test_index_jobs(spark, tmp_path):
    from driftwell.plans import indexing

    p = posts(spark)
    tags = spark.createDataFrame([(1, "x", 1, [1.0] + [0.0] * 7), (2, "y", 2, None)], "id long, name string, usage_count long, embedding array<float>")
    pt = spark.createDataFrame([(1, 1), (3, 2), (5, 1)], "post_id long, tag_id long")
    img = spark.createDataFrame([(3, [0.0] * 8), (1, [0.0, 1.0] + [0.0] * 6)], "id long, vector array<float>")
    got = {r.id: r for r in indexing.index_posts(p, pt, tags, tx.hash_encode, 8, img).collect()}
    assert set(got) == {1, 2, 3, 5} and all(np.linalg.norm(r.vector) == pytest.approx(1, abs=1e-5) for r in got.values())
    assert list(got[5].vector) == [1.0] + [0.0] * 7 and got[1].payload.account_id == 7
    acc = {r.id: r.posts for r in indexing.index_accounts(indexing.index_posts(p, pt, tags, tx.hash_encode, 8, img)).collect()}
    assert acc == {7: 2, 8: 1, 9: 1}
    st = indexing.image_status(p, spark.createDataFrame([(1,), (2,), (4,), (99,)], "id long"), spark.createDataFrame([(1, False), (1, False), (4, True)], "id long, nsfw boolean"))
    assert rows(st) == [(1, "ok", 2), (2, "no_images", 0), (4, "nsfw", 1), (99, "not_found", 0)]
    sent = spark.createDataFrame([("cat",), ("dog",), (None,)], "sentence string")
    assert indexing.expand_corpus(sent, ["a", "my"], ["now"]).count() == 8 and indexing.expand_corpus(sent, ["a"], [], 3).count() == 3
    pair = indexing.bootstrap_pairs(sent.where("sentence is not null"), tx.hash_encode, tx.hash_encode, (8, 4)).first()
    assert len(pair.x) == 8 and np.linalg.norm(pair.y) == pytest.approx(1)
    ip = indexing.image_pairs(spark.createDataFrame([("p1", "h1", [1.0]), ("p2", "h2", [0.5])], "post_id string, phash string, vector array<float>"), spark.createDataFrame([("h1", "a cat")], "phash string, caption string"), tx.hash_encode, 16)
    assert ip.count() == 2


def test_communities_are_rebuilt(spark, tmp_path):
    from driftwell.plans import indexing

    tags = spark.createDataFrame([(i, f"t{i}", i, v) for i, v, _ in clusters()], "id long, name string, usage_count long, embedding array<float>")
    acc = spark.createDataFrame([(i, v) for i, v, _ in clusters()], "id long, embedding array<float>")
    p = spark.createDataFrame([(i, i % 45) for i in range(90)], "id long, account_id long")
    pt = spark.createDataFrame([(i, i % 45) for i in range(90)], "post_id long, tag_id long")
    got = indexing.rebuild_communities(tags, acc, p, pt, str(tmp_path / "c"), "1", (2, 3), 1)
    kinds = {r.type: r.n for r in got.groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"tag_cluster": 3, "account_cluster": 3} and got.where("name like '% · %'").count() == 6
    assert indexing.rebuild_communities(tags.limit(0), acc.limit(0), p, pt, str(tmp_path / "d"), "1").count() == 0
