"""Queries of the search operators over the tables of a data folder, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.config import Filters, SearchConfig
from driftwell.functions import scoring, trigram
from driftwell.functions import text as tx
from driftwell.functions import vectors as V
from driftwell.operators import fulltext, fusion, ivf, postings, retrieve
from driftwell.plans import search, store
from driftwell.schema import read
from driftwell.sources.store import cut, new_folder

#: "Now" of the data.
AS_OF = "2025-07-01 00:00:00"
#: The tag whose vector stands for a query's embedding, the query text, and the names searched for.
QUERY, QUERY_TAG, NAME, TAG = "trellis", 1, "static_harbor", "slow"
C = SearchConfig()


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def current_posts(spark: SparkSession, d: str) -> DataFrame:
    """The last version of every post.

    A window in place of an aggregate over whole rows: columns that a query doesn't use are never read or shuffled, and all but
    the first row of an id are dropped before the shuffle.
    """
    last = Window.partitionBy("id").orderBy(F.desc_nulls_last("created_at"), F.desc(F.coalesce("note_count", F.lit(-1))))
    return read(spark, d, "posts").where("id is not null").withColumn("_v", F.row_number().over(last)).where("_v = 1").drop("_v")


def safe_posts(spark: SparkSession, d: str) -> DataFrame:
    return current_posts(spark, d).where(~F.coalesce("nsfw", F.lit(False)))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first tag that has one: one row to the driver."""
    t = read(spark, d, "tags").where(f"id >= {QUERY_TAG} and embedding is not null").where(F.exists("embedding", lambda x: x != 0))
    return [float(x) for x in t.orderBy("id").select("embedding").first()[0]]


def vectors_of_posts(spark: SparkSession, d: str) -> DataFrame:
    return search.post_vectors(read(spark, d, "post_tags"), read(spark, d, "tags"))


CUR = "cur AS (SELECT * FROM posts WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, coalesce(note_count, -1) DESC) = 1), safe AS (SELECT * FROM cur WHERE NOT coalesce(nsfw, false))"
#: Words of a text, as the simple analyser has them.
WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: length(w) > 0)"
QV = f"qv AS (SELECT embedding::DOUBLE[] AS q FROM tags WHERE id >= {QUERY_TAG} AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 1)"
PV = """cells AS (SELECT p.post_id AS id, g.i, avg(g.x::DOUBLE) AS m FROM (SELECT DISTINCT post_id, tag_id FROM post_tags) p JOIN (SELECT id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM tags
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0) g ON g.id = p.tag_id GROUP BY 1, 2), pv AS (SELECT id, list(m ORDER BY i) AS v FROM cells GROUP BY id)"""
COS = "round(list_inner_product({0}, q) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product(q, q))), 6)"
ENG = "(1 + 0.1 * log2(1 + greatest(coalesce(note_count, 0), 0)))"
REC = f"pow(0.5, CASE WHEN published_at IS NULL THEN 90 ELSE greatest((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(published_at)) / 86400000000.0, 0) END / 90)"
KW = f"kw AS (SELECT *, row_number() OVER (ORDER BY kw_score DESC, id) AS rank FROM (SELECT id, round(0.1::DOUBLE * len(list_filter(w, lambda x: x = '{QUERY}')), 9) AS kw_score FROM (SELECT id, {WORDS.format('body_clean')} AS w FROM safe) WHERE list_contains(w, '{QUERY}') ORDER BY kw_score DESC, id LIMIT 100))"
VEC = f"vec AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, id) AS rank FROM (SELECT id, {COS.format('v')} AS cosine FROM pv, qv WHERE id IN (SELECT id FROM safe) AND list_inner_product(v, v) > 1e-20 ORDER BY cosine DESC, id LIMIT 100))"
RRF = "rrf AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT id, rank FROM kw UNION ALL SELECT id, rank FROM vec) GROUP BY id)"
RER = f"rer AS (SELECT *, row_number() OVER (ORDER BY score DESC, id DESC) AS place FROM (SELECT id, account_id, round(rrf * {ENG} * {REC}, 9) AS score FROM safe JOIN rrf USING (id)))"
BASE = f"{CUR}, {QV}, {PV}, {KW}, {VEC}, {RRF}, {RER}"
ACC = f"acc AS (SELECT id AS account_id, {COS.format('embedding::DOUBLE[]')} AS cosine FROM accounts, qv WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 1e-20 ORDER BY cosine DESC, account_id LIMIT 50)"
ROLL = """roll AS (SELECT account_id, coalesce(a, 0) AS a, coalesce(cosine, 0) AS b FROM (SELECT account_id, sum(score) / sqrt(count(*)) AS a FROM rer WHERE place <= 200 GROUP BY account_id) FULL JOIN acc USING (account_id)),
  final AS (SELECT account_id, round(0.6 * CASE WHEN max(a) OVER () = min(a) OVER () THEN 1.0 ELSE (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) END + 0.4 * CASE WHEN max(b) OVER () = min(b) OVER () THEN 1.0 ELSE (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) END, 6) AS score FROM roll)"""


def collection(spark: SparkSession, d: str) -> store.SearchStore:
    """The stored collection of all posts: built once in an application, and again when the tables change."""
    state = store.state_of(spark, [f"{d}/{t}.parquet" for t in ("posts", "post_tags", "tags")])
    return store.stored(spark, ("simple", *state), lambda: _built(spark, d))


def _built(spark: SparkSession, d: str) -> store.SearchStore:
    return store.SearchStore.build(spark, current_posts(spark, d), search.tag_lists(read(spark, d, "post_tags")), "simple", parts=search.tag_vectors(read(spark, d, "tags")))


def build_collection(spark, d):
    """What building the collection yields: posts, postings and vectors."""
    held = _built(spark, d)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return one(held.posts, "posts").unionByName(one(held.postings, "postings")).unionByName(one(held.vectors, "vectors"))


def _ranked(spark: SparkSession, d: str, filters: Filters | None = None) -> DataFrame:
    held = collection(spark, d)
    return search.ranked_posts(held.posts, None, QUERY, query_vector(spark, d), as_of(), filters, C, read(spark, d, "post_tags"), read(spark, d, "tags"), store=held)


def general_search_posts(spark, d):
    return _ranked(spark, d).where("place <= 20").select("id", "account_id", "score", "place")


def general_search_accounts(spark, d):
    return search.account_scores(_ranked(spark, d), read(spark, d, "accounts"), query_vector(spark, d), C).withColumn("score", F.round("score", 6))


def general_search_page2(spark, d):
    """The page after the fifth result, and the page after a result that is gone."""
    ranked = cut(_ranked(spark, d))  # the candidates: read three times
    fifth = ranked.where("place = 5").select("id", "score").first()
    if fifth is None:
        return ranked.select("id", "score", "place", F.lit("").alias("page"))
    found = fusion.page(ranked, 10, scoring.encode_cursor(fifth["score"], fifth["id"])).withColumn("page", F.lit("found"))
    gone = fusion.page(ranked.where(F.col("id") != fifth["id"]), 10, scoring.encode_cursor(fifth["score"], fifth["id"])).withColumn("page", F.lit("gone"))
    return found.unionByName(gone).select("id", "score", "place", "page")


def general_search_filtered(spark, d):
    names = [r.name for r in read(spark, d, "tags").where("id <= 6").select("name").collect()]
    f = Filters(date_from="2023-01-01", date_to="2025-06-01", min_notes=10, tags=tuple(names))
    return _ranked(spark, d, f).select("id", "score", "place")


_F = f"safe2 AS (SELECT * FROM safe WHERE published_at >= TIMESTAMPTZ '2023-01-01 00:00:00+00' AND published_at <= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND note_count >= 10 AND id IN (SELECT post_id FROM post_tags WHERE tag_id IN (SELECT id FROM tags WHERE name IN (SELECT name FROM tags WHERE id <= 6))))"
_BASE_F = f"{CUR}, {_F}, {QV}, {PV}, {KW.replace('FROM safe', 'FROM safe2')}, {VEC.replace('FROM safe', 'FROM safe2')}, {RRF}, {RER.replace('FROM safe', 'FROM safe2')}"


def keyword_topk(spark, d):
    return retrieve.keyword_topk(safe_posts(spark, d), QUERY, 100, "simple")


def _other_script(word: str):
    def run(spark, d):
        return retrieve.keyword_topk(safe_posts(spark, d), word, 100, "simple")

    return run


def fulltext_match(spark, d):
    """Matches of a query with AND, a phrase, OR and an exclusion."""
    node = fulltext.parse('"harbor wall" trellis OR kiln -glaze')
    return current_posts(spark, d).where(fulltext.contains(node, tx.simple_terms(F.col("body_clean")))).select("id")


def fulltext_english(spark, d):
    """Cover-density rank of stemmed words."""
    return fulltext.keyword_scores(current_posts(spark, d), "id", "body_clean", 'trellises "cold frame" OR kilns', "english").withColumn("kw_score", F.round("kw_score", 6))


def cover_density_two_terms(spark, d):
    return fulltext.keyword_scores(current_posts(spark, d), "id", "body_clean", "kiln shelf").withColumn("kw_score", F.round("kw_score", 6))


def vector_topk_accounts(spark, d):
    return retrieve.vector_topk(read(spark, d, "accounts"), "id", "embedding", query_vector(spark, d), 50)


def vector_topk_native(spark, d):
    return retrieve.vector_topk_native(read(spark, d, "tags"), "id", "embedding", query_vector(spark, d), 30)


def filtered_vector_topk(spark, d):
    """Vectors of posts under payload filters."""
    posts = current_posts(spark, d)
    ok = retrieve.allowed(posts, Filters(min_notes=50, date_from="2024-01-01")).select("id")
    own = search.tag_lists(read(spark, d, "post_tags")).join(ok, "id", "left_semi")
    return retrieve.gathered_topk(own, "id", "parts", search.tag_blocks(read(spark, d, "tags")), query_vector(spark, d), 100)


def rrf_fusion(spark, d):
    p = safe_posts(spark, d)
    kw = retrieve.ranked(retrieve.keyword_topk(p, QUERY, 100, "simple"), "kw_score", "id")
    hot = retrieve.ranked(retrieve.top(p.where("note_count is not null"), "note_count", "id", 100), "note_count", "id")
    return fusion.rrf([kw, hot], "id").select("id", F.round("rrf", 9).alias("rrf"))


def rerank_scores(spark, d):
    """Engagement and recency of every post."""
    p = current_posts(spark, d)
    return p.select("id", F.round(scoring.engagement(F.col("note_count"), 0.1), 6).alias("engagement"), F.round(scoring.recency(F.col("published_at"), as_of(), 90.0), 6).alias("recency"))


def tag_filter_semijoin(spark, d):
    names = [r.name for r in read(spark, d, "tags").where("id <= 3").select("name").collect()]
    return retrieve.allowed(current_posts(spark, d), Filters(tags=tuple(names)), read(spark, d, "post_tags"), read(spark, d, "tags")).select("id")


def post_metadata(spark, d):
    """The display columns of the first forty ranked posts."""
    ids = _ranked(spark, d).where("place <= 40").select("id")
    own = search.post_metadata(ids, collection(spark, d).posts, read(spark, d, "accounts"), read(spark, d, "post_tags"), read(spark, d, "tags"))
    return own.select("id", "account_id", "blog_name", F.coalesce("note_count", F.lit(0)).alias("note_count"), "lang", F.array_join("tags", "|").alias("tags"), F.size("image_urls").cast("long").alias("images"))


def account_name_search(spark, d):
    return search.search_accounts(read(spark, d, "accounts"), NAME, 20, C)


def trigram_similarity(spark, d):
    return read(spark, d, "accounts").select("id", F.round(trigram.similarity(F.col("blog_name"), F.lit(NAME)), 6).alias("sim"))


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = f"CASE WHEN len(list_distinct(list_concat(ta, tq))) = 0 THEN 0.0 ELSE round(len(list_intersect(ta, tq))::DOUBLE / len(list_distinct(list_concat(ta, tq))), 6) END"
_TRIS = f"tri AS (SELECT *, {_TRI.format('blog_name')} AS ta, {_TRI.format(repr(NAME))} AS tq FROM accounts), sims AS (SELECT *, {_SIM} AS sim, (blog_name = '{NAME}')::INT AS is_exact, starts_with(blog_name, '{NAME}')::INT AS is_prefix FROM tri)"


def tag_search(spark, d):
    return search.search_tags(read(spark, d, "tags"), TAG, query_vector(spark, d), 20, C)


_TAGS = f"""near AS (SELECT id, {COS.format('embedding::DOUBLE[]')} AS cosine FROM tags, qv WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 1e-20 ORDER BY cosine DESC, id LIMIT 30),
base AS (SELECT id, name, coalesce(usage_count, 0) AS usage_count FROM tags),
entries AS (SELECT *, 0 AS kind FROM base WHERE name = '{TAG}' UNION ALL (SELECT *, 1 FROM base WHERE starts_with(name, '{TAG}') ORDER BY usage_count DESC, id LIMIT 20) UNION ALL SELECT *, 2 FROM base WHERE id IN (SELECT id FROM near)),
merged AS (SELECT name, arg_min(id, (kind, id)) AS tag_id, min(kind) AS kind, arg_min(usage_count, (kind, id)) AS usage_count, max(coalesce(cosine, 0)) AS cosine FROM entries LEFT JOIN near USING (id) GROUP BY name),
scored AS (SELECT *, round((kind = 0)::INT + 0.6 * cosine + 0.3 * log2(1 + usage_count) / (SELECT CASE WHEN max(log2(1 + usage_count)) = 0 THEN 1 ELSE max(log2(1 + usage_count)) END FROM merged), 6) AS score FROM merged)"""


def mean_pool(spark, d):
    """Mean vector of each label of the embeddings, element by element."""
    got = V.mean_pool(read(spark, d, "embeddings"), ["label"], "embedding", "v")
    return got.select("label", F.posexplode("v").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def post_vector_norms(spark, d):
    own = vectors_of_posts(spark, d)
    return own.select("id", F.round(V.norm(F.col("vector")), 6).alias("norm"), F.size("vector").cast("long").alias("size"))


def fuse_modalities(spark, d):
    """Three vectors of neighbouring ids as text, image and tag vector, with every eighth pattern of missing parts."""
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("t"))
    b = e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("i"))
    c = e.select((F.col("vec_id") - 2).alias("id"), F.col("embedding").alias("g"))
    own = a.join(b, "id").join(c, "id")
    keep = lambda n, bit: F.when(F.shiftright(F.pmod("id", F.lit(8)).cast("int"), bit) % 2 == 0, F.col(n))
    v = V.fuse([(keep("t", 0), 0.5), (keep("i", 1), 0.35), (keep("g", 2), 0.15)], 64)
    own = own.select("id", v.alias("v"))
    return own.select("id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.col("v")[0], 6).alias("x0"), F.round(F.col("v")[63], 6).alias("x63"))


_FUSE = """a AS (SELECT vec_id AS id, embedding::DOUBLE[] AS t FROM embeddings), own AS (SELECT a.id, CASE WHEN a.id % 2 = 0 THEN a.t END AS t, CASE WHEN (a.id // 2) % 2 = 0 THEN b.t END AS i, CASE WHEN (a.id // 4) % 2 = 0 THEN c.t END AS g FROM a JOIN a b ON b.id = a.id + 1 JOIN a c ON c.id = a.id + 2),
s AS (SELECT id, list_transform(range(1, 65), lambda k: 0.5 * coalesce(t[k], 0) + 0.35 * coalesce(i[k], 0) + 0.15 * coalesce(g[k], 0)) AS v FROM own), n AS (SELECT id, v, sqrt(list_inner_product(v, v)) AS n FROM s)"""


def account_window_embedding(spark, d):
    """The unit mean of the vectors of each account's last hundred posts."""
    # one account may hold a large share of all posts: each part of it is cut to a hundred before the account is; then their tags are pooled
    tagged = read(spark, d, "post_tags").join(read(spark, d, "tags").where(F.exists("embedding", lambda x: x != 0)).select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select(F.col("post_id").alias("id"))
    p = safe_posts(spark, d).select("id", "account_id", "published_at").join(tagged, "id", "left_semi")
    order = [F.desc_nulls_last("published_at"), F.desc("id")]
    part = Window.partitionBy("account_id", "_s").orderBy(*order)
    p = p.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= C.account_window)
    p = cut(p.withColumn("_r", F.row_number().over(Window.partitionBy("account_id").orderBy(*order))).where(F.col("_r") <= C.account_window).select("id", "account_id"))
    chosen = read(spark, d, "post_tags").join(p.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    p = p.join(search.post_vectors(chosen, read(spark, d, "tags")), "id")
    m = V.mean_pool_fast(p, "account_id", "vector", "m").select("account_id", F.col("n").alias("posts"), V.normalise(F.col("m")).alias("v"))
    return m.select("account_id", "posts", F.round(F.col("v")[0], 5).alias("x0"), F.round(F.col("v")[383], 5).alias("x383"))


_WIN = f"""{CUR}, {PV}, w AS (SELECT account_id, v FROM (SELECT s.account_id, pv.v, row_number() OVER (PARTITION BY s.account_id ORDER BY published_at DESC NULLS LAST, s.id DESC) AS r FROM safe s JOIN pv ON pv.id = s.id) WHERE r <= 100),
c AS (SELECT account_id, i, avg(x) AS m FROM (SELECT account_id, unnest(v) AS x, unnest(range(1, 385)) AS i FROM w) GROUP BY 1, 2), n AS (SELECT account_id, list(m ORDER BY i) AS m FROM c GROUP BY 1)"""


def softmax_safety(spark, d):
    """Every embedding against the first eight as prompts, four of them unsafe."""
    from driftwell.operators import safety

    e = read(spark, d, "embeddings")
    prompts = [[float(x) for x in r.embedding] for r in e.where("vec_id < 8").orderBy("vec_id").select("embedding").collect()]
    return safety.image_scores(e.select(F.col("vec_id").alias("id"), "embedding"), "id", "embedding", prompts, 4, 0.5)


_SOFT = """p AS (SELECT vec_id AS k, embedding::DOUBLE[] AS p FROM embeddings WHERE vec_id < 8), s AS (SELECT e.vec_id AS id, k, exp(list_inner_product(e.embedding::DOUBLE[], p) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))) AS x FROM embeddings e, p)
SELECT id, nsfw_score, nsfw_score > 0.5 AS nsfw FROM (SELECT id, round(sum(CASE WHEN k < 4 THEN x ELSE 0 END) / sum(x), 6) AS nsfw_score FROM s GROUP BY id)"""

def _covers(words: str, lexemes: dict[str, str], latest: str, leaves: str) -> str:
    """SQL of the cover-density rank: ``words`` is the list of a text's words, ``lexemes`` which words count as which,
    ``leaves`` running places of the query's parts, and ``latest`` the place from which on the text up to a mark satisfies the query."""
    case = " ".join(f"WHEN w IN ({own}) THEN '{name}'" for name, own in lexemes.items())
    return f"""WITH {CUR}, w AS (SELECT id, unnest({words}) AS w, unnest(range(1, len({words}) + 1)) AS p FROM cur), x AS (SELECT id, p, CASE {case} END AS x FROM w),
m AS (SELECT id, p, x, row_number() OVER (PARTITION BY id ORDER BY p) AS i, lag(x) OVER (PARTITION BY id ORDER BY p) AS px, lag(p) OVER (PARTITION BY id ORDER BY p) AS pp FROM x WHERE x IS NOT NULL),
l AS (SELECT *, {leaves} FROM m), s AS (SELECT *, {latest} AS s FROM l), c AS (SELECT *, lag(s) OVER (PARTITION BY id ORDER BY p) AS ps FROM s WHERE s > 0),
d AS (SELECT c.id, 0.1::DOUBLE / (1 + greatest(0, (c.p - c.s) - (c.i - m.i))) AS v FROM c JOIN m ON m.id = c.id AND m.p = c.s WHERE ps IS NULL OR c.s > ps)
SELECT id, round(sum(v), 6) AS kw_score FROM d GROUP BY id"""


def _last(cond: str, value: str = "p") -> str:
    return f"coalesce(max(CASE WHEN {cond} THEN {value} END) OVER (PARTITION BY id ORDER BY p), 0)"


#: English words as the analyser counts them: apostrophes inside a word stay.  The stems below are worked by hand: the stem of trellises is
#: trellis, that of trellis is trelli.
_EN_WORDS = "list_filter(list_transform(string_split_regex(lower(coalesce(body_clean, '')), '[^\\p{L}\\p{N}\\p{M}'']+'), lambda w: trim(w, chr(39))), lambda w: length(w) > 0)"
_ENGLISH = _covers(
    _EN_WORDS,
    {"trellis": "'trellises', 'trellised', 'trellising'", "cold": "'cold', 'colds', 'cold''s'", "frame": "'frame', 'frames', 'framed', 'framing', 'frame''s'", "kiln": "'kiln', 'kilns', 'kiln''s'"},
    "greatest(k, least(t, f))",
    f"{_last(chr(120) + ' = ' + repr('kiln'))} AS k, {_last(chr(120) + ' = ' + repr('trellis'))} AS t, {_last('x = ' + repr('frame') + ' AND px = ' + repr('cold') + ' AND pp = p - 1', 'pp')} AS f",
)
_TWO = _covers(WORDS.format("body_clean"), {"kiln": "'kiln'", "shelf": "'shelf'"}, "least(k, h)", f"{_last('x = ' + repr('kiln'))} AS k, {_last('x = ' + repr('shelf'))} AS h")


QUERIES = {
    "general_search_posts": (general_search_posts, f"WITH {BASE} SELECT id, account_id, score, place FROM rer WHERE place <= 20"),
    "general_search_accounts": (general_search_accounts, f"WITH {BASE}, {ACC}, {ROLL} SELECT account_id, score FROM final"),
    "general_search_page2": (general_search_page2, f"WITH {BASE} SELECT id, score, place, unnest(['found', 'gone']) AS page FROM rer WHERE place > 5 AND place <= 15"),
    "general_search_filtered": (general_search_filtered, f"WITH {_BASE_F} SELECT id, score, place FROM rer"),
    "keyword_topk": (keyword_topk, f"WITH {CUR}, {KW} SELECT id, kw_score FROM kw"),
    **{f"keyword_topk_{k}": (_other_script(w), f"WITH {CUR}, {KW.replace(repr(QUERY), repr(w))} SELECT id, kw_score FROM kw") for k, w in {"ru": "сегодня", "ja": "日曜日に", "de": "größer", "fr": "été"}.items()},
    "build_collection": (build_collection, f"WITH {CUR}, {PV} SELECT 'posts' AS part, count(*) AS n FROM cur UNION ALL SELECT 'postings', sum(len(list_distinct({WORDS.format('body_clean')})))::BIGINT FROM cur UNION ALL SELECT 'vectors', count(*) FROM pv WHERE id IN (SELECT id FROM cur) AND list_inner_product(v, v) > 0"),
    "fulltext_match": (
        fulltext_match,
        f"WITH {CUR}, t AS (SELECT id, ' ' || array_to_string({WORDS.format('body_clean')}, ' ') || ' ' AS w FROM cur) SELECT id FROM t WHERE (contains(w, ' harbor wall ') AND contains(w, ' trellis ')) OR (contains(w, ' kiln ') AND NOT contains(w, ' glaze '))",
    ),
    "fulltext_english": (fulltext_english, _ENGLISH),
    "cover_density_two_terms": (cover_density_two_terms, _TWO),
    "vector_topk_accounts": (vector_topk_accounts, f"WITH {QV}, {ACC} SELECT account_id AS id, cosine FROM acc"),
    "vector_topk_native": (vector_topk_native, f"WITH {QV} SELECT id, {COS.format('embedding::DOUBLE[]')} AS cosine FROM tags, qv WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 ORDER BY cosine DESC, id LIMIT 30"),
    "filtered_vector_topk": (filtered_vector_topk, f"WITH {CUR}, {QV}, {PV} SELECT id, {COS.format('v')} AS cosine FROM pv, qv WHERE id IN (SELECT id FROM safe WHERE note_count >= 50 AND published_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00') AND list_inner_product(v, v) > 1e-20 ORDER BY cosine DESC, id LIMIT 100"),
    "rrf_fusion": (rrf_fusion, f"WITH {CUR}, {KW}, hot AS (SELECT id, row_number() OVER (ORDER BY note_count DESC, id) AS rank FROM safe WHERE note_count IS NOT NULL ORDER BY note_count DESC, id LIMIT 100) SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (SELECT id, rank FROM kw UNION ALL SELECT id, rank FROM hot) GROUP BY id"),
    "rerank_scores": (rerank_scores, f"WITH {CUR} SELECT id, round({ENG}, 6) AS engagement, round({REC}, 6) AS recency FROM cur"),
    "tag_filter_semijoin": (tag_filter_semijoin, f"WITH {CUR} SELECT id FROM safe WHERE id IN (SELECT post_id FROM post_tags WHERE tag_id IN (SELECT id FROM tags WHERE name IN (SELECT name FROM tags WHERE id <= 3)))"),
    "post_metadata": (
        post_metadata,
        f"WITH {BASE} SELECT s.id, s.account_id, a.blog_name, coalesce(s.note_count, 0) AS note_count, s.lang, coalesce((SELECT string_agg(DISTINCT t.name, '|' ORDER BY t.name) FROM post_tags p JOIN tags t ON t.id = p.tag_id WHERE p.post_id = s.id), '') AS tags, coalesce(len(s.image_urls), 0) AS images FROM safe s LEFT JOIN accounts a ON a.id = s.account_id WHERE s.id IN (SELECT id FROM rer WHERE place <= 40)",
    ),
    "account_name_search": (
        account_name_search,
        f"WITH {_TRIS} SELECT blog_name, CASE WHEN is_exact = 1 THEN 'exact' WHEN is_prefix = 1 THEN 'prefix' ELSE 'fuzzy' END AS match_type, round((10 * is_exact + 5 * is_prefix + sim) * (1 + 0.05 * log2(1 + coalesce(total_posts, 0))), 6) AS score, avatar_url, nullif(substr(description, 1, 120), '') AS description_snippet FROM (SELECT * FROM sims WHERE sim > 0.3 OR is_prefix = 1 ORDER BY is_exact DESC, is_prefix DESC, sim DESC, blog_name LIMIT 20)",
    ),
    "trigram_similarity": (trigram_similarity, f"WITH {_TRIS} SELECT id, sim FROM sims"),
    "tag_search": (tag_search, f"WITH {QV}, {_TAGS} SELECT tag_id, name, ['exact', 'prefix', 'semantic'][kind + 1] AS match_type, usage_count, cosine, score FROM scored ORDER BY score DESC, kind, tag_id LIMIT 20"),
    "mean_pool": (mean_pool, "SELECT label, i, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i"),
    "post_vector_norms": (post_vector_norms, f"WITH {PV} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, len(v) AS size FROM pv"),
    "fuse_modalities": (fuse_modalities, f"WITH {_FUSE} SELECT id, CASE WHEN n < 1e-10 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm, round(CASE WHEN n < 1e-10 THEN v[1] ELSE v[1] / n END, 6) AS x0, round(CASE WHEN n < 1e-10 THEN v[64] ELSE v[64] / n END, 6) AS x63 FROM n"),
    "account_window_embedding": (account_window_embedding, f"WITH {_WIN} SELECT account_id, (SELECT count(*) FROM w WHERE w.account_id = n.account_id) AS posts, round(m[1] / sqrt(list_inner_product(m, m)), 5) AS x0, round(m[384] / sqrt(list_inner_product(m, m)), 5) AS x383 FROM n"),
    "softmax_safety": (softmax_safety, f"WITH {_SOFT}"),
}


def _written(spark, rows, name, write):
    """A table written to a new folder that all executors share, and read again."""
    path = new_folder(spark, name)
    write(rows, path)
    return spark.read.parquet(path)


def postings_search(spark, d):
    """The same matches and ranks as a scan, from the postings of the query's words."""
    own = _written(spark, postings.build(safe_posts(spark, d)), "postings", postings.write)
    return postings.search(own, '"harbor wall" trellis OR kiln -glaze').withColumn("kw_score", F.round("kw_score", 6)).select("id")


def postings_term(spark, d):
    own = _written(spark, postings.build(safe_posts(spark, d)), "postings", postings.write)
    return postings.search(own, QUERY).withColumn("kw_score", F.round("kw_score", 9))


def ivf_topk(spark, d):
    """Approximate search in a few cells of the tags' vectors."""
    t = read(spark, d, "tags").where("embedding is not null")
    at = ivf.fit_cells(t, "id", "embedding", 16)
    own = _written(spark, ivf.assign(t, "id", "embedding", at), "ivf", lambda x, p: x.write.partitionBy("cell").parquet(p))
    return ivf.topk(own, "id", "embedding", at, query_vector(spark, d), 10, 4)


def ivf_recall(spark, d):
    """Whether the cells nearest to a query hold nine tenths or more of its ten nearest vectors, over fifty queries."""
    t = read(spark, d, "tags").where("embedding is not null").where(F.exists("embedding", lambda x: x != 0))
    at = ivf.fit_cells(t, "id", "embedding", 16)
    own = _written(spark, ivf.assign(t, "id", "embedding", at), "ivf", lambda x, p: x.write.partitionBy("cell").parquet(p))
    hit = n = 0
    for r in t.orderBy("id").limit(50).select("embedding").collect():
        q = [float(x) for x in r[0]]
        exact = {x.id for x in retrieve.vector_topk(own, "id", "embedding", q, 10).collect()}
        hit += len(exact & {x.id for x in ivf.topk(own, "id", "embedding", at, q, 10, 8).collect()})
        n += len(exact)
    return spark.createDataFrame([(hit >= 0.9 * n,)], "reached boolean")


def ivf_all_cells(spark, d):
    """All cells: the exact answer."""
    t = read(spark, d, "tags").where("embedding is not null")
    at = ivf.fit_cells(t, "id", "embedding", 16)
    own = _written(spark, ivf.assign(t, "id", "embedding", at), "ivf", lambda x, p: x.write.partitionBy("cell").parquet(p))
    return ivf.topk(own, "id", "embedding", at, query_vector(spark, d), 30, 16)


QUERIES |= {
    "postings_search": (postings_search, QUERIES["fulltext_match"][1].replace("FROM cur)", "FROM safe)")),
    "postings_term": (postings_term, f"WITH {CUR} SELECT id, round(0.1::DOUBLE * len(list_filter(w, lambda x: x = '{QUERY}')), 9) AS kw_score FROM (SELECT id, {WORDS.format('body_clean')} AS w FROM safe) WHERE list_contains(w, '{QUERY}')"),
    "ivf_topk": (ivf_topk, None),
    "ivf_recall": (ivf_recall, "SELECT true AS reached"),
    "ivf_all_cells": (ivf_all_cells, QUERIES["vector_topk_native"][1]),
}
