"""Queries of the text, safety, community and evaluation operators, each beside the SQL that checks it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions import scoring
from driftwell.functions import text as tx
from driftwell.operators import communities as cm
from driftwell.operators import evaluate, projection, safety
from driftwell.plans import search
from driftwell.plans.queries_search import CUR, QV, WORDS, current_posts, query_vector
from driftwell.schema import read

#: Words of the stand-in blocklist.
BLOCKED = ["vermin", "naked", "idiot", "porn"]


def clean_html(spark: SparkSession, d: str) -> DataFrame:
    return current_posts(spark, d).select("id", F.md5(tx.clean_html(F.col("body_raw"))).alias("digest"), F.coalesce(F.length(tx.clean_html(F.col("body_raw"))), F.lit(0)).cast("long").alias("size"))


_G = "regexp_replace({0}, {1}, {2}, 'g')"


def _chain(x: str) -> str:
    for p, r in ((r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>", ""), (r"(?s)<!--.*?-->", ""), (r"<[^>]*>", "")):
        x = _G.format(x, f"'{p}'", f"'{r}'")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return _G.format(_G.format(x, r"'[ \t\n\r]+'", "' '"), "'^ | $'", "''")


def full_clean(spark, d):
    """The complete cleaner with every entity and compatibility form, and the display text."""
    p = current_posts(spark, d)
    return p.select("id", F.md5(tx.full_clean(F.col("body_raw"))).alias("digest"), F.md5(tx.display_text(F.col("body_raw"))).alias("shown"))


def _feed(spark, d):
    """Posts in the feed's form: the fields that their type has."""
    p = current_posts(spark, d).select("id", "post_type", "body_raw", "body_clean", "image_urls")
    is_ = lambda t: F.when(F.col("post_type") == t, F.col("body_raw"))
    lines = F.transform(F.split("body_clean", "\n"), lambda x: F.struct(F.lit("a:").alias("label"), x.alias("phrase")))
    photos = F.transform("image_urls", lambda u: F.struct(F.struct(u.alias("url")).alias("original_size")))
    return p.select("id", F.col("post_type").alias("type"), is_("text").alias("body"), F.col("body_clean").alias("title"), is_("photo").alias("caption"), is_("quote").alias("text"), is_("link").alias("description"), F.lit("q?").alias("question"), F.col("body_clean").alias("answer"), F.when(F.col("post_type") == "chat", lines).alias("dialogue"), photos.alias("photos"))


def body_extract(spark, d):
    f = _feed(spark, d)
    raw = tx.body(F.col("type"), {c: F.col(c) for c in ("body", "title", "caption", "text", "description", "question", "answer", "dialogue")})
    return f.select("id", F.md5(raw).alias("digest"), F.size(tx.image_urls(F.col("photos"))).cast("long").alias("images"))


_BODY = f"""WITH {CUR} SELECT id, md5(CASE post_type WHEN 'text' THEN coalesce(nullif(body_raw, ''), nullif(body_clean, '')) WHEN 'photo' THEN nullif(body_raw, '') WHEN 'quote' THEN nullif(body_raw, '') WHEN 'link' THEN coalesce(nullif(body_raw, ''), nullif(body_clean, ''))
  WHEN 'answer' THEN 'q?' || chr(10) || coalesce(body_clean, '') WHEN 'chat' THEN CASE WHEN body_clean IS NULL THEN NULL ELSE array_to_string(list_transform(string_split(body_clean, chr(10)), lambda x: 'a: ' || x), chr(10)) END END) AS digest,
  len(list_filter(coalesce(image_urls, []), lambda u: u IS NOT NULL AND u <> '')) AS images FROM cur"""


def chunk_windows(spark, d):
    w = read(spark, d, "documents").select("doc_id", F.posexplode(tx.windows(F.col("text"), 64, 16)).alias("chunk", "words"))
    return w.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


def chunk_windows_full(spark, d):
    """Windows of the production size: 512 words, 64 of them shared with the next."""
    w = read(spark, d, "documents").select("doc_id", F.posexplode(tx.windows(F.col("text"))).alias("chunk", "words"))
    return w.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


_CHUNK = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda x: length(x) > 0) AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 64 THEN 1 ELSE ceil((len(w) - 64) / 48.0)::INT + 1 END)) AS chunk FROM w)
SELECT doc_id, chunk, len(w[chunk * 48 + 1 : chunk * 48 + 64]) AS n, md5(array_to_string(w[chunk * 48 + 1 : chunk * 48 + 64], ' ')) AS digest FROM s"""


def term_frequency(spark, d):
    """How often each word occurs in all posts, by the simple analyser."""
    return current_posts(spark, d).select(F.explode(tx.simple_terms(F.col("body_clean"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def blocklist_scan(spark, d):
    return current_posts(spark, d).where(tx.blocked(F.col("body_clean"), BLOCKED)).select("id")


def safety_gate(spark, d):
    """The worst image of a photo post (its tags' vectors stand for its images) and the blocklist for posts without one."""
    prompts = [[float(x) for x in r.embedding] for r in read(spark, d, "tags").where(F.exists("embedding", lambda x: x != 0)).orderBy("id").limit(8).select("embedding").collect()]
    photos = current_posts(spark, d).where("post_type = 'photo'").select(F.col("id").alias("post_id"))
    img = read(spark, d, "post_tags").join(photos, "post_id", "left_semi").join(read(spark, d, "tags").select(F.col("id").alias("tag_id"), "embedding"), "tag_id").select(F.col("post_id").alias("id"), "embedding")
    return safety.gate(current_posts(spark, d), safety.image_scores(img, "id", "embedding", prompts, 4, 0.5), BLOCKED)


_GATE = f"""WITH {CUR}, p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS k, embedding::DOUBLE[] AS p FROM (SELECT * FROM tags WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 ORDER BY id LIMIT 8)),
v AS (SELECT id, embedding::DOUBLE[] AS e FROM tags WHERE embedding IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
x AS (SELECT v.id, k, exp(list_inner_product(e, p) / (sqrt(list_inner_product(p, p)) * sqrt(list_inner_product(e, e)))) AS x FROM v, p), s AS (SELECT id, round(sum(CASE WHEN k < 4 THEN x ELSE 0 END) / sum(x), 6) AS s FROM x GROUP BY id),
w AS (SELECT post_id AS id, max(s) AS s FROM post_tags JOIN s ON s.id = tag_id WHERE post_id IN (SELECT id FROM cur WHERE post_type = 'photo') GROUP BY 1),
b AS (SELECT id, {' OR '.join(f"contains(lower(coalesce(body_clean, '')), '{t}')" for t in BLOCKED)} AS b FROM cur)
SELECT b.id, coalesce(s, b::INT::DOUBLE) AS nsfw_score, coalesce(s > 0.5, b) AS nsfw FROM b LEFT JOIN w USING (id)"""


def quick_language(spark, d):
    return current_posts(spark, d).select("id", tx.guess_language(F.col("body_clean")).alias("lang"))


def _guess() -> str:
    votes = ", ".join(f"(len(list_filter(w, lambda x: list_contains(['" + "', '".join(v.split()) + f"'], x))), {-k}, '{a}')" for k, (a, v) in enumerate(tx.GUESS.items()))
    return f"WITH {CUR}, t AS (SELECT id, {WORDS.format('body_clean')} AS w FROM cur), v AS (SELECT id, unnest([{votes}]) AS v FROM t), m AS (SELECT id, max(v) AS m FROM v GROUP BY id) SELECT id, CASE WHEN m[1] > 0 THEN m[3] ELSE 'und' END AS lang FROM m"


def encode_hash(spark, d):
    e = tx.encode(current_posts(spark, d).select("id", "body_clean"), "body_clean", "v", size=64)
    return e.select("id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 3).alias("square"), F.md5(F.array_join(F.transform("v", lambda x: F.round(x, 4).cast("string")), ",")).alias("digest"))


def nfkc(spark, d):
    return current_posts(spark, d).select("id", F.md5(tx.normalise_text(F.col("body_raw"))).alias("digest"))


def snippets(spark, d):
    return read(spark, d, "accounts").select("id", scoring.snippet(F.col("description"), 40).alias("snippet"), F.left(F.col("title"), F.lit(8)).alias("head"))


def cursors(spark, d):
    """Every cursor and what it decodes to."""
    p = current_posts(spark, d).select("id", F.coalesce("note_count", F.lit(0)).cast("double").alias("score"))
    c = p.withColumn("cursor", scoring.cursor(F.col("score"), F.col("id")))
    back = F.from_json(F.unbase64(F.translate("cursor", "-_", "+/")).cast("string"), "s double, id long")
    return c.select("id", back["id"].alias("back"), back["s"].alias("score"))


def drill_downs(spark, d):
    """The search link of every post's first three tags."""
    t = read(spark, d, "post_tags").distinct().join(read(spark, d, "tags").select(F.col("id").alias("tag_id"), "name"), "tag_id")
    # the first three names are cut before the shuffle, so a post with any number of tags is no large group
    first = t.select("post_id", "name").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("post_id").orderBy("name"))).where("_r <= 3")
    names = first.groupBy("post_id").agg(F.array_sort(F.collect_set("name")).alias("n"))
    return names.select("post_id", scoring.drill_down(F.col("n"), "none").alias("link"))


_DRILL = """SELECT post_id, '/api/v1/search/general?q=' || replace(replace(url_encode(array_to_string(list_sort(list_distinct(list(name)))[1:3], ' ')), '%20', '+'), '~', '%7E') AS link FROM (SELECT DISTINCT post_id, tag_id FROM post_tags) p JOIN tags t ON t.id = p.tag_id GROUP BY post_id"""


def community_centroids(spark, d):
    """The five members nearest to each label's centroid."""
    return cm.nearest_members(read(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("similarity", F.round("similarity", 5))


_CEN = """cells AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2), cen AS (SELECT label, list(m ORDER BY i) AS c FROM cells GROUP BY label),
sims AS (SELECT e.label, vec_id, list_inner_product(embedding::DOUBLE[], c) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(c, c)) + 1e-10) AS s FROM embeddings e JOIN cen ON cen.label = e.label),
near AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 6) DESC, vec_id) AS place FROM sims)"""


def community_names(spark, d):
    near = cm.nearest_members(read(spark, d, "embeddings"), "vec_id", "label", "embedding")
    named = near.join(read(spark, d, "tags").select(F.col("id").alias("vec_id"), "name"), "vec_id", "left")
    return cm.names(named, "label", "name")


def _labelled_tags(spark, d):
    """Tags under a stand-in clustering: the last three bits of their id."""
    return read(spark, d, "tags").where(F.exists("embedding", lambda x: x != 0)).withColumn("label", F.pmod("id", F.lit(8)))


def community_search(spark, d):
    """Clusters of tags searched by the query's vector."""
    t = _labelled_tags(spark, d)
    members = t.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("member_ids"))  # a table of clusters is built that way; a cluster is its members
    c = cm.centroids(t, "label", "embedding").join(members, "label").select(F.col("label").alias("id"), F.concat(F.lit("c"), "label").alias("name"), F.lit("tag_cluster").alias("type"), "member_ids", "centroid")
    got = search.search_communities(c, "trellis", query_vector(spark, d), read(spark, d, "tags"), read(spark, d, "accounts"), 5)
    return got.select("community_id", "member_count", F.array_join("top_tags", "|").alias("top_tags"), F.round("score", 5).alias("score"))


_COM = f"""WITH {QV}, t AS (SELECT id, name, coalesce(usage_count, 0) AS u, id % 8 AS label, embedding::DOUBLE[] AS e FROM tags WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
cells AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, unnest(range(384)) AS i FROM t) GROUP BY 1, 2), cen AS (SELECT label, list(m ORDER BY i) AS c FROM cells GROUP BY 1), n AS (SELECT label, count(*) AS n FROM t GROUP BY 1)
SELECT cen.label AS community_id, n AS member_count, (SELECT string_agg(name, '|' ORDER BY u DESC, id) FROM (SELECT * FROM t WHERE t.label = cen.label ORDER BY u DESC, id LIMIT 5)) AS top_tags,
round(list_inner_product(c, q) / (sqrt(list_inner_product(c, c)) * sqrt(list_inner_product(q, q))) * (1 + 0.1 * log2(1 + n)), 5) AS score FROM cen JOIN n USING (label), qv ORDER BY score DESC, community_id LIMIT 5"""


def silhouette_given_labels(spark, d):
    return cm.silhouette(read(spark, d, "embeddings"), "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 5))


_SIL = """WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS other, b.vec_id AS bid, sqrt(greatest(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) - 2 * list_inner_product(a.e, b.e), 0)) AS x FROM s a, s b),
g AS (SELECT vec_id, label, other, sum(CASE WHEN vec_id <> bid THEN x ELSE 0 END) AS total, count(*) AS n FROM p GROUP BY 1, 2, 3), m AS (SELECT vec_id, max(CASE WHEN label = other THEN total / greatest(n - 1, 1) END) AS a, max(CASE WHEN label = other THEN n END) AS own, min(CASE WHEN label <> other THEN total / n END) AS b FROM g GROUP BY 1)
SELECT vec_id, round(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END, 5) AS silhouette FROM m"""


def kmeans_communities(spark, d):
    """The cluster of every vector, with the number of clusters of best silhouette."""
    _, _, got = cm.choose_k(read(spark, d, "embeddings"), "vec_id", "embedding")
    return got.select("vec_id", "label")


def choose_clusters(spark, d):
    """The number of clusters of best silhouette."""
    k, score, _ = cm.choose_k(read(spark, d, "embeddings"), "vec_id", "embedding")
    return spark.createDataFrame([(k, float(score))], "k long, silhouette double")


def density_communities(spark, d):
    """The density cluster of every vector, -1 for noise."""
    return cm.density_clusters(read(spark, d, "embeddings"), "vec_id", "embedding")


def top_tags_per_account_group(spark, d):
    """The three most used tags of each group of accounts."""
    p = current_posts(spark, d)
    members = read(spark, d, "accounts").select(F.col("id").alias("account_id"), F.pmod("id", F.lit(5)).alias("label"))
    return cm.top_tags(members, "label", p, read(spark, d, "post_tags").distinct(), read(spark, d, "tags"))


_TOP3 = f"""WITH {CUR}, u AS (SELECT account_id % 5 AS label, t.name, t.id, count(*) AS posts FROM cur JOIN (SELECT DISTINCT post_id, tag_id FROM post_tags) p ON p.post_id = cur.id JOIN tags t ON t.id = p.tag_id WHERE account_id IN (SELECT id FROM accounts) GROUP BY 1, 2, 3)
SELECT label, name, posts, row_number() OVER (PARTITION BY label ORDER BY posts DESC, name) AS place FROM u QUALIFY place <= 3"""


def _run(spark, d):
    """Result lists as a run: place by score, grade by the post's notes."""
    r = read(spark, d, "post_results").groupBy("query_id", "post_id").agg(F.max("score").alias("score"))
    p = current_posts(spark, d).select(F.col("id").alias("post_id"), F.when(F.col("note_count") >= 100, 2).when(F.col("note_count") >= 20, 1).otherwise(0).alias("grade"))
    own = r.join(p, "post_id", "left").na.fill(0, ["grade"])
    return own.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "post_id")))


_RUN = f"""{CUR}, r AS (SELECT query_id, post_id, max(score) AS score FROM post_results GROUP BY 1, 2), run AS (SELECT query_id, coalesce(CASE WHEN note_count >= 100 THEN 2 WHEN note_count >= 20 THEN 1 ELSE 0 END, 0) AS g, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, post_id) AS p FROM r LEFT JOIN cur ON cur.id = post_id),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, p) AS ip, sum((g >= 1)::INT) OVER (PARTITION BY query_id ORDER BY p) AS c FROM run),
m AS (SELECT query_id, coalesce(sum(CASE WHEN p <= 10 THEN g / log2(p + 1) END), 0) AS dcg, coalesce(sum(CASE WHEN ip <= 10 THEN g / log2(ip + 1) END), 0) AS idcg, coalesce(1.0 / min(CASE WHEN g >= 1 THEN p END), 0) AS rr, sum(CASE WHEN p <= 30 AND g >= 1 THEN 1 ELSE 0 END) AS found, sum((g >= 1)::INT) AS hits, sum(CASE WHEN g >= 1 THEN c / p ELSE 0 END) AS prec FROM i GROUP BY 1),
q AS (SELECT query_id, dcg, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, rr, CASE WHEN hits > 0 THEN found / hits ELSE 0 END AS recall, CASE WHEN hits > 0 THEN prec / hits ELSE 0 END AS ap FROM m)"""


def eval_metrics(spark, d):
    m = evaluate.metrics(_run(spark, d), recall_k=30)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("dcg", "ndcg", "rr", "recall", "ap")])


def eval_summary(spark, d):
    return evaluate.summary(evaluate.metrics(_run(spark, d), recall_k=30))


#: Types of queries: the test tables have none, so a query's last digit stands for it.
_TYPE = "right(query_id, 1)"


def eval_by_type(spark, d):
    """The means of the metrics for each type of query."""
    m = evaluate.metrics(_run(spark, d), recall_k=30).withColumn("type", F.expr(_TYPE))
    return evaluate.summary(m, ["type"])


def _configured(spark, d):
    """(config, query_id, ndcg) of every configuration: its constants act on the two ranks and the notes of each result."""
    r = _run(spark, d).withColumnRenamed("place", "p1")
    notes = current_posts(spark, d).select(F.col("id").alias("post_id"), F.coalesce("note_count", F.lit(0)).alias("notes"))
    r = r.join(notes, "post_id").withColumn("p2", F.row_number().over(Window.partitionBy("query_id").orderBy("post_id")))
    # one row for each query, which makes its lists of all configurations: neither rows nor keys are multiplied before the shuffle
    cells = r.groupBy("query_id").agg(F.collect_list(F.struct("post_id", "p1", "p2", "notes", F.col("grade").cast("double").alias("g"))).alias("r"))  # a query's result list
    return evaluate.grid_metrics(cells, evaluate.grid())


def tune_weights(spark, d):
    """The configuration of best mean nDCG@10 over four fifths of the queries, and its mean over the others, looked at once."""
    n = _configured(spark, d)
    train, test = evaluate.split_rows(n, "query_id")
    best = evaluate.best(train)
    held = test.join(F.broadcast(best), "config").groupBy("config").agg(F.round(F.first("mean"), 5).alias("train_ndcg"), F.round(F.avg("ndcg"), 5).alias("test_ndcg"), F.count(F.lit(1)).alias("test_queries"))
    return held


def grid_search(spark, d):
    """Mean nDCG@10 of every configuration, all in one job."""
    return _configured(spark, d).groupBy("config").agg(F.round(F.avg("ndcg"), 5).alias("ndcg"))


_GRID = f"""WITH {CUR}, r AS (SELECT query_id, post_id, max(score) AS score FROM post_results GROUP BY 1, 2), a AS (SELECT query_id, post_id, coalesce(note_count, 0) AS notes, CASE WHEN note_count >= 100 THEN 2 WHEN note_count >= 20 THEN 1 ELSE 0 END AS g,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, post_id) AS p1, row_number() OVER (PARTITION BY query_id ORDER BY post_id) AS p2 FROM r JOIN cur ON cur.id = post_id),
c AS (SELECT * FROM (VALUES {', '.join(str(x) for x in evaluate.grid())}) AS t(config, w_t, w_i, w_g, k, b)), s AS (SELECT *, round((w_t / (k + p1) + w_i / (k + p2)) * (1 + b * log2(1 + notes)), 9) AS s FROM a, c),
o AS (SELECT config, query_id, g, row_number() OVER (PARTITION BY config, query_id ORDER BY s DESC, post_id) AS p FROM s), i AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY g DESC, p) AS ip FROM o),
m AS (SELECT config, query_id, coalesce(sum(CASE WHEN p <= 10 THEN g / log2(p + 1) END), 0) AS dcg, coalesce(sum(CASE WHEN ip <= 10 THEN g / log2(ip + 1) END), 0) AS idcg FROM i GROUP BY 1, 2),
n AS (SELECT config, query_id, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg FROM m)"""
_TUNE = """, q AS (SELECT query_id, row_number() OVER (ORDER BY md5('42/' || query_id), query_id) <= floor(0.8 * count(*) OVER ()) AS train FROM (SELECT DISTINCT query_id FROM n)),
t AS (SELECT config, avg(ndcg) FILTER (WHERE train) AS a, avg(ndcg) FILTER (WHERE NOT train) AS b, count(*) FILTER (WHERE NOT train) AS c FROM n JOIN q USING (query_id) GROUP BY config)
SELECT config, round(a, 5) AS train_ndcg, round(b, 5) AS test_ndcg, c AS test_queries FROM t ORDER BY round(a, 9) DESC, config LIMIT 1"""


def projection_fit(spark, d):
    """A linear projection of every vector on itself, fitted and applied: the solution is the identity, its cosines are one."""
    e = read(spark, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")).join(e.select("vec_id", F.col("embedding").alias("y")), F.col("id") == F.col("vec_id"))
    w = projection.fit_linear(pairs, "x", "y")
    return projection.project(pairs, "x", w).select("id", F.round(F.aggregate(F.zip_with("projected", "y", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 3).alias("cosine"))


def projection_training(spark, d):
    """The two-layer network trained on every vector and its reverse, a gradient job for each epoch: how near it comes."""
    e = read(spark, d, "embeddings").where("embedding is not null").select(F.col("embedding").alias("x"), F.reverse("embedding").alias("y"))
    _, cosine = projection.fit_layers_spread(e, "x", "y", 64, 20)
    return spark.createDataFrame([(cosine > 0.2,)], "learned boolean")


def projection_layers(spark, d):
    """The two-layer projection with weights made by rule: the size of its unit vectors and two of their elements."""
    made = lambda n, m, a, b, k: (((np.arange(n)[:, None] * a + np.arange(m) * b) % k - k // 2) / 20.0, np.zeros(n))
    got = projection.project(read(spark, d, "embeddings"), "embedding", [made(96, 64, 7, 3, 11), made(32, 96, 5, 7, 13)])
    return got.select("vec_id", F.size("projected").alias("size"), F.round(F.col("projected")[0], 6).alias("x0"), F.round(F.col("projected")[31], 6).alias("x31"))


_LAYERS = """WITH h AS (SELECT vec_id, list_transform(range(96), lambda i: list_inner_product(embedding::DOUBLE[], list_transform(range(64), lambda j: ((i * 7 + j * 3) % 11 - 5) / 20.0::DOUBLE))) AS h FROM embeddings),
g AS (SELECT vec_id, list_transform(h, lambda x: 0.5 * x * (1 + 2 / sqrt(pi()) * list_sum(list_transform(range(30), lambda n: pow(-1, n) * pow(x / sqrt(2.0), 2 * n + 1) / (factorial(n::INT)::DOUBLE * (2 * n + 1)))))) AS g FROM h),
o AS (SELECT vec_id, list_transform(range(32), lambda k: list_inner_product(g, list_transform(range(96), lambda i: ((k * 5 + i * 7) % 13 - 6) / 20.0::DOUBLE))) AS o FROM g)
SELECT vec_id, 32 AS size, round(o[1] / sqrt(list_inner_product(o, o)), 6) AS x0, round(o[32] / sqrt(list_inner_product(o, o)), 6) AS x31 FROM o"""


def query_lexemes(spark, d):
    """How many posts hold each lexeme of the evaluation texts."""
    words = read(spark, d, "eval_items").select(F.explode(tx.simple_terms(F.col("text"))).alias("term")).distinct()
    own = current_posts(spark, d).select("id", F.explode(F.array_distinct(tx.simple_terms(F.col("body_clean")))).alias("term"))
    # counted before the join, so that a frequent word is one row of it
    return own.groupBy("term").agg(F.count(F.lit(1)).alias("posts")).join(words, "term").select("term", "posts")


QUERIES = {
    "clean_html": (clean_html, f"WITH {CUR}, c AS (SELECT id, {_chain('body_raw')} AS t FROM cur) SELECT id, md5(t) AS digest, coalesce(length(t), 0) AS size FROM c"),
    "full_clean": (full_clean, None),
    "body_extract": (body_extract, _BODY),
    "chunk_windows": (chunk_windows, _CHUNK),
    "chunk_windows_full": (chunk_windows_full, _CHUNK.replace("48 + 64", "448 + 512").replace("* 48", "* 448").replace("48.0", "448.0").replace("64", "512")),
    "term_frequency": (term_frequency, f"WITH {CUR} SELECT term, count(*) AS n FROM (SELECT unnest({WORDS.format('body_clean')}) AS term FROM cur) GROUP BY term"),
    "blocklist_scan": (blocklist_scan, f"WITH {CUR} SELECT id FROM cur WHERE " + " OR ".join(f"contains(lower(coalesce(body_clean, '')), '{t}')" for t in BLOCKED)),
    "safety_gate": (safety_gate, _GATE),
    "quick_language": (quick_language, _guess()),
    "encode_hash": (encode_hash, None),
    "nfkc": (nfkc, None),
    "snippets": (snippets, "SELECT id, nullif(substr(description, 1, 40), '') AS snippet, left(title, 8) AS head FROM accounts"),
    "cursors": (cursors, f"WITH {CUR} SELECT id, id AS back, coalesce(note_count, 0)::DOUBLE AS score FROM cur"),
    "drill_downs": (drill_downs, _DRILL),
    "community_centroids": (community_centroids, f"WITH {_CEN} SELECT label::BIGINT AS label, vec_id, round(round(s, 6), 5) AS similarity, place FROM near WHERE place <= 5"),
    "community_names": (community_names, f"WITH {_CEN} SELECT n.label::BIGINT AS label, coalesce(string_agg(t.name, ' · ' ORDER BY place), 'cluster_' || n.label) AS name FROM near n LEFT JOIN tags t ON t.id = vec_id WHERE place <= 3 GROUP BY n.label"),
    "community_search": (community_search, _COM),
    "silhouette_given_labels": (silhouette_given_labels, _SIL),
    "kmeans_communities": (kmeans_communities, None),
    "choose_clusters": (choose_clusters, None),
    "density_communities": (density_communities, None),
    "top_tags_per_account_group": (top_tags_per_account_group, _TOP3),
    "eval_metrics": (eval_metrics, f"WITH {_RUN} SELECT query_id, round(dcg, 6) AS dcg, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr, round(recall, 6) AS recall, round(ap, 6) AS ap FROM q"),
    "eval_summary": (eval_summary, f"WITH {_RUN} SELECT count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(rr), 4) AS rr, round(avg(recall), 4) AS recall, round(avg(ap), 4) AS ap FROM q"),
    "eval_by_type": (eval_by_type, f"WITH {_RUN} SELECT {_TYPE} AS type, count(*) AS queries, round(avg(ndcg), 4) AS ndcg, round(avg(rr), 4) AS rr, round(avg(recall), 4) AS recall, round(avg(ap), 4) AS ap FROM q GROUP BY 1"),
    "grid_search": (grid_search, f"{_GRID} SELECT config, round(avg(ndcg), 5) AS ndcg FROM n GROUP BY config"),
    "tune_weights": (tune_weights, _GRID + _TUNE),
    "projection_fit": (projection_fit, "SELECT vec_id AS id, 1.0::DOUBLE AS cosine FROM embeddings"),
    "projection_training": (projection_training, "SELECT true AS learned"),
    "projection_layers": (projection_layers, _LAYERS),
    "query_lexemes": (query_lexemes, f"WITH {CUR}, q AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM eval_items), p AS (SELECT DISTINCT id, unnest({WORDS.format('body_clean')}) AS term FROM cur) SELECT term, count(*) AS posts FROM p JOIN q USING (term) GROUP BY term"),
}


def index_posts(spark, d):
    """The vector collection of all safe posts by the stand-in encoder: unit vectors and their payload."""
    from driftwell.plans import indexing

    got = indexing.index_posts(current_posts(spark, d), read(spark, d, "post_tags"), read(spark, d, "tags"), tx.hash_encode, 384)
    return got.select("id", "payload.account_id", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("square"))


def index_accounts(spark, d):
    """Account vectors over the last posts of the collection: how many posts each is made of."""
    from driftwell.plans import indexing

    points = indexing.post_points(current_posts(spark, d), read(spark, d, "post_tags"), read(spark, d, "tags"), tx.hash_encode, 384)
    return indexing.index_accounts(points[1](points[0]), points=points).select(F.col("id").alias("account_id"), "posts")


def image_status(spark, d):
    """How an image job of every result's post ends; flags of the posts stand for those of their images."""
    from driftwell.plans import indexing

    p = current_posts(spark, d)
    img = p.select("id", "nsfw", F.explode("image_urls").alias("u")).select("id", F.coalesce("nsfw", F.lit(False)).alias("nsfw"))
    return indexing.image_status(p, read(spark, d, "post_results").select(F.col("post_id").alias("id")), img)


def expand_corpus(spark, d):
    """Blog titles with every prefix and suffix."""
    from driftwell.plans import indexing

    return indexing.expand_corpus(read(spark, d, "accounts").select(F.col("title").alias("sentence")), ["a photo of", "my"], ["at night"])


#: Posts that the stand-in encoder or their tags give a vector.
_INDEXED = f"""{CUR}, tagged AS (SELECT DISTINCT post_id FROM post_tags p JOIN tags t ON t.id = p.tag_id WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
ix AS (SELECT id, account_id FROM safe WHERE regexp_matches(coalesce(body_clean, ''), '[\\p{{L}}\\p{{N}}_]') OR id IN (SELECT post_id FROM tagged))"""

QUERIES |= {
    "index_posts": (index_posts, f"WITH {_INDEXED} SELECT id, account_id, 384 AS size, 1.0::DOUBLE AS square FROM ix"),
    "index_accounts": (index_accounts, f"WITH {_INDEXED} SELECT account_id, least(count(*), 100) AS posts FROM ix GROUP BY account_id"),
    "image_status": (image_status, f"WITH {CUR}, i AS (SELECT id, len(coalesce(image_urls, [])) AS n, coalesce(nsfw, false) AS bad FROM cur) SELECT a.id, CASE WHEN i.id IS NULL THEN 'not_found' WHEN n = 0 THEN 'no_images' WHEN bad THEN 'nsfw' ELSE 'ok' END AS status, coalesce(n, 0) AS n_images FROM (SELECT DISTINCT post_id AS id FROM post_results) a LEFT JOIN i ON i.id = a.id"),
    "expand_corpus": (expand_corpus, "WITH s AS (SELECT title AS s FROM accounts WHERE title IS NOT NULL) SELECT s AS sentence FROM s UNION SELECT 'a photo of ' || s FROM s UNION SELECT 'my ' || s FROM s UNION SELECT s || ' at night' FROM s"),
}
