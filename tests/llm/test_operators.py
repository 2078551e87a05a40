"""Operators for training data against brute force, exact round trips and made cases."""

import itertools
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.llm import abuse, frequency, language, leaks, markup, neighbours, pairs, quality, ranking, tokenizer
from driftwell.llm.common import current
from driftwell.llm.crf import LinearChainCRF

LONG = "word " * 20_000


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ common


def test_current_takes_the_last_version(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (None, 9, "d"), (1, 2, "b")], "id long, t int, v string")
    assert rows(current(df, "id", ["t"], "v")) == [(1, "b"), (2, "c")]


# ------------------------------------------------------------------ 7 frequency


def test_term_counts_against_brute_force(spark):
    rng = random.Random(1)
    tags = [(i, rng.choice(["Cat", "#cat", "dog ", "# Dog", "owl", "emu", "", None, "#"])) for i in range(60)]
    posts = [(rng.choice([None, *range(30)]), rng.choice([None, *range(70)])) for _ in range(800)]
    got = {r.term: (r.occurrences, r.records) for r in frequency.term_counts(
        spark.createDataFrame(posts, "post_id long, tag_id long").withColumn("term", F.lit("x")), spark.createDataFrame(tags, "id long, name string").withColumn("n", F.lit(1)),
        "post_id", "tag_id", "id", frequency.tag_term(F.col("name"))).collect()}
    term = {i: n.strip().removeprefix("#").strip().lower() for i, n in tags if n is not None}
    term = {i: t for i, t in term.items() if t}
    own = [(p, term[t]) for p, t in posts if p is not None and t in term]
    occurrences = Counter(t for _, t in own)
    records = Counter(t for _, t in set(own))
    assert got == {t: (occurrences[t], records[t]) for t in set(term.values())}


@pytest.mark.parametrize("sent", [0, 10**6])
def test_hot_keys_meet_long_tables_by_salt(spark, monkeypatch, sent):
    monkeypatch.setattr("driftwell.llm.common.SENT", sent)
    tags = spark.range(20).select("id", F.concat(F.lit("t"), "id").alias("name"))
    posts = spark.range(400).select((F.col("id") % 50).alias("post_id"), F.when(F.col("id") % 3 > 0, F.lit(0)).otherwise(F.col("id") % 20).alias("tag_id"))
    got = frequency.term_counts(posts, tags, "post_id", "tag_id", "id", frequency.tag_term(F.col("name"))).where("term = 't0'").first()
    assert got.occurrences == posts.where("tag_id = 0").count() and got.records == posts.where("tag_id = 0").distinct().count()
    assert pairs.together(posts, "post_id", "tag_id", 1, 0.0).count() > 0


def test_term_counts_over_several_blocks(spark):
    n = frequency.BLOCK * 2 + 5
    tags = spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("name"))
    posts = spark.range(n * 2).select((F.col("id") % 7).alias("post_id"), (F.col("id") % n).alias("tag_id"))
    got = frequency.term_counts(posts, tags, "post_id", "tag_id", "id", frequency.tag_term(F.col("name")))
    assert got.agg(F.count("*"), F.sum("occurrences"), F.sum("records")).first()[:2] == (n, 2 * n)


def test_term_marks_and_empty_tables(spark):
    c = spark.createDataFrame([("a", 5, 2), ("b", 9, 3), ("c", 9, 50), ("d", 0, 0)], "term string, occurrences long, records long")
    got = {r.term: r.mark for r in frequency.mark(c, spark.createDataFrame([(1000,)], "n long")).collect()}
    assert got == {"a": "rare", "b": None, "c": "common", "d": "rare"}
    none = spark.createDataFrame([], "post_id long, tag_id long")
    tags = spark.createDataFrame([(1, "x")], "id long, name string")
    assert rows(frequency.term_counts(none, tags, "post_id", "tag_id", "id", frequency.tag_term(F.col("name")))) == [("x", 0, 0)]
    assert rows(frequency.term_counts(none, tags.limit(0), "post_id", "tag_id", "id", frequency.tag_term(F.col("name")))) == []


# ------------------------------------------------------------------ 5 pairs


@pytest.mark.parametrize(("width", "head"), [(4096, 2048), (7, 2048), (4096, 5), (7, 5), (9, 0)])
def test_pairs_against_brute_force(spark, width, head):
    rng = random.Random(2)
    data = [(rng.choice([None, *range(60)]), min(rng.randrange(30), rng.randrange(30))) for _ in range(1500)]
    data += [(999, i) for i in range(30)] + [(998, None)]  # one record with everything
    df = spark.createDataFrame(data, "post_id long, tag_id long").withColumn("a", F.lit(1)).withColumn("n", F.lit(2))
    got = {(r.tag_a, r.tag_b): (r.n, r.n_a, r.n_b, r.total) for r in pairs.together(df, "post_id", "tag_id", 5, 1.0, width, head).collect()}
    baskets = defaultdict(set)
    for p, t in data:
        if p is not None and t is not None:
            baskets[p].add(t)
    single, both = Counter(), Counter()
    for b in baskets.values():
        single.update(b)
        both.update(combinations(sorted(b), 2))
    n = len(baskets)
    want = {k: (c, single[k[0]], single[k[1]], n) for k, c in both.items() if c >= 5 and c * n >= single[k[0]] * single[k[1]]}
    assert got == want


def test_pairs_of_wide_baskets_and_nothing(spark):
    wide = spark.range(300).select(F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("post_id"), F.col("id").alias("tag_id"))
    assert pairs.together(wide, "post_id", "tag_id", 6, 0.0).count() == 300 * 299 // 2
    assert pairs.together(wide.limit(0), "post_id", "tag_id").count() == 0


# ------------------------------------------------------------------ 2 ranking


def brute_rank(data):
    out = {}
    groups = defaultdict(list)
    for q, i, *s in data:
        if q is not None and i is not None:
            groups[q].append((i, s))
    for q, own in groups.items():
        ranks = {i: [1 + sum((y is not None and (s[k] is None or y > s[k])) for _, t in own for y in [t[k]]) for k in range(3)] for i, s in own}
        order = sorted(ranks, key=lambda i: (sorted(ranks[i])[1], sum(ranks[i]), i))
        for place, i in enumerate(order, 1):
            out[q, i] = (sorted(ranks[i])[1], place)
    return out


@pytest.mark.parametrize("hot", [200_000, 10])
def test_median_rank_against_brute_force(spark, hot):
    rng = random.Random(3)
    data = [(f"q{k}", i, rng.choice([None, 1.0, 2.0, rng.random() * 1e6]), rng.choice([None, 1, 2, 3, 10**6]), rng.choice([None, 5, 6, 7])) for k in range(4) for i in range(8 + 15 * k)]
    data += [(None, 1, 1.0, 1, 1), ("q1", None, 1.0, 1, 1)]
    df = spark.createDataFrame(data, "q string, i long, a double, b long, c long").withColumn("place", F.lit("x"))
    got = {(r.q, r.i): (r.median_rank, r.place) for r in ranking.median_rank(df, "q", "i", {"a": 1.0, "b": 1.0, "c": 1.0}, hot).collect()}
    assert got == brute_rank(data)


def test_weights_move_the_median(spark):
    df = spark.createDataFrame([("q", 1, 9.0, 1.0), ("q", 2, 5.0, 2.0), ("q", 3, 1.0, 3.0)], "q string, i long, a double, b double")
    assert [r.i for r in ranking.median_rank(df, "q", "i", {"a": 3.0, "b": 1.0}).orderBy("place").collect()] == [1, 2, 3]
    assert [r.i for r in ranking.median_rank(df, "q", "i", {"a": 1.0, "b": 3.0}).orderBy("place").collect()] == [3, 2, 1]
    assert ranking.median_rank(df.limit(0), "q", "i", {"a": 1.0, "b": 3.0}).count() == 0
    nan = spark.createDataFrame([("q", 1, float("nan"), 1.0), ("q", 2, -5.0, 1.0)], "q string, i long, a double, b double")
    assert ranking.median_rank(nan, "q", "i", {"a": 1.0, "b": 1.0}).orderBy("place").first().i == 2


# ------------------------------------------------------------------ 6 neighbours


def brute_near(v, k, least):
    ids = [i for i, x in v if x is not None and np.isfinite(np.asarray(x, float)).all() and np.linalg.norm(x) > 0]
    m = np.stack([np.asarray(x, float) / np.linalg.norm(x) for i, x in v if i in set(ids)])
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for r, i in enumerate(ids):
        for c in sorted(range(len(ids)), key=lambda c: (-s[r, c], ids[c]))[:k]:
            if s[r, c] >= least:
                out.add((min(i, ids[c]), max(i, ids[c])))
    return out


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    v = [(i, (base[i % 40] + rng.normal(size=16) * (0.2 if i % 3 else 1.5)).tolist()) for i in range(400)]
    v += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, 2.0])]
    df = spark.createDataFrame(v, "id long, embedding array<float>").withColumn("list", F.lit(1))
    got = {(r.id_a, r.id_b) for r in neighbours.near_pairs(df, "id", "embedding", 10, 0.9).collect()}
    want = brute_near(v[:400], 10, 0.9)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("sample", [16_384, 160])
def test_neighbours_in_many_lists_and_blocks(spark, monkeypatch, sample):
    # a sample of 160 tells ten cells apart, too few for the thirty lists wanted: each cell is clustered again
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    monkeypatch.setattr(neighbours, "LIST", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    v = [(i, (base[i % 60] + rng.normal(size=24) * 0.25).tolist()) for i in range(1200)]
    df = spark.createDataFrame(v, "id long, embedding array<float>")
    near = defaultdict(set)
    for r in neighbours.nearest(df, "id", "embedding", 10).collect():
        near[r.id].add(r.other)
    m = np.stack([np.asarray(x) / np.linalg.norm(x) for _, x in v])
    s = m @ m.T
    np.fill_diagonal(s, -2)
    hit = sum(len(near[i] & set(np.argsort(-s[i])[:10].tolist())) for i in range(1200))
    assert hit >= 0.9 * 12_000


def test_crowds_of_copies(spark):
    v = [(i, [1.0, 0.0, 0.0]) for i in range(300)] + [(500 + i, [0.0, 1.0, 0.01 * i]) for i in range(5)] + [(900 + i, [0.0, 0.0, 0.0]) for i in range(100)]
    df = spark.createDataFrame(v, "id long, embedding array<float>")
    near = defaultdict(list)
    for r in neighbours.nearest(df, "id", "embedding", 10, 0.5).orderBy("place").collect():
        near[r.id].append(r.other)
    assert near[250] == list(range(10)) and near[3] == [0, 1, 2, *range(4, 11)]
    assert len(near[500]) == 4 and 900 not in near
    assert neighbours.nearest(df.limit(0), "id", "embedding").count() == 0
    assert neighbours.nearest(df.where("id >= 900"), "id", "embedding").count() == 0


def test_graph_finds_the_nearest_centroids():
    at = np.random.default_rng(6).normal(size=(700, 20)).astype(np.float32)
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    q = np.random.default_rng(7).normal(size=(200, 20)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, sims = neighbours.Graph(at).search(q, 4)
    want = (q @ at.T).argmax(axis=1)
    assert (ids[:, 0] == want).mean() > 0.9 and (np.diff(sims, axis=1) <= 1e-6).all()


# ------------------------------------------------------------------ 8 tokenizer

PATH = f"{tokenizer.FOLDER}/byte_bpe_50k.json"
HARD = ["", " ", "a", "  \n\t x", "aaaaaaaaaaaaaaaaaaaaaaaa", "ααα 日本語 🙂👩‍🌾", "don't I'LL we've", "<|endoftext|>", "1234567890" * 9, "\u0000\u200b", "=" * 300, "Übergröße naïve", "x" * 5000]


def library():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_tokens_are_the_library_s():
    own, lib, rng = tokenizer.tokenizer(PATH), library(), random.Random(8)
    toks = sorted(own.automaton.label.values())
    texts = HARD + [b"".join(rng.choice(toks) for _ in range(rng.randint(1, 6))).decode("utf-8", "replace") for _ in range(3000)]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids, t
        assert own.decode(ids) == t


def test_automaton_of_a_small_list_against_merging():
    merges = [(b"a", b"a"), (b"aa", b"a"), (b"b", b"a"), (b"aa", b"aa"), (b"ba", b"aa"), (b"b", b"b")]
    ids = {bytes([c]): c for c in b"abc"} | {a + b: 1000 + i for i, (a, b) in enumerate(merges)}
    own = tokenizer.Automaton(ids, merges)

    def merge(word):
        parts = [bytes([c]) for c in word]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        return [ids[p] for p in parts]

    from itertools import product

    for n in range(1, 8):
        for w in product(b"abc", repeat=n):
            assert own.encode(bytes(w)) == merge(bytes(w)), bytes(w)


def test_corpus_encoding_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hello"), (3, "hello"), (None, "x"), (4, LONG)], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = tokenizer.encode_corpus(df, "doc_id", "text").collect()
    own = {r.doc_id: list(r.ids) for r in got}
    assert len(got) == 6 and own[1] == [] and own[2] == [] and own[3] == [31373] and own[None] == [87] and len(own[4]) == 20_001
    assert tokenizer.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


# ------------------------------------------------------------------ 9 leaks

ITEM = "When the old keeper of Marlstone counted forty silver lanterns in the narrow hall, only seven of the ninety guests noticed that the tall green door had quietly closed behind their careful hosts before midnight."
OTHER = "Which river did the younger surveyor of Bramford measure first, the cold northern branch beside three mills or the wide southern one that every ferryman between two villages seemed to fear in spring?"


def found(text, least=20):
    return {k: w for k, w, _, _ in leaks.Scanner([(1, ITEM), (2, OTHER)]).scan(text, least)}


def test_leaks_in_every_disguise():
    w = ITEM.split()
    assert found("x y " + ITEM + " z") == {1: len(w)}
    assert 1 in found("Intro. " + " ".join(w[5:27]).upper().replace(" ", "  \n"))
    assert 1 in found(" ".join(w[4:28]).replace("lanterns", "lamps").replace("guests", "").replace("tall", "very tall"))
    assert 1 in found("".join(c + "\u00ad" if i % 9 == 0 else c for i, c in enumerate(" ".join(w[:24]))))
    assert 1 in found("<b>" + " ".join(w[:12]) + "</b><br>" + " *" + "* *".join(w[12:24]) + "*")
    assert set(found(" ".join(OTHER.split()[3:27]) + " ... " + ITEM)) == {1, 2}


def test_what_is_no_leak():
    w = ITEM.split()
    assert found(" ".join(w[:12])) == {} and found(" ".join(w[:12]) + " something else entirely " + " ".join(w[20:31])) == {}
    mixed = w[:24]
    random.Random(9).shuffle(mixed)
    assert found(" ".join(mixed)) == {} and found("") == {} and found("lantern " * 500) == {}


def test_leak_offsets_are_the_original_s():
    text = "Vorher – «" + ITEM.replace(" ", "\u00a0 ") + "» nachher"
    [(_, n, a, b)] = leaks.Scanner([(1, ITEM)]).scan(text, 20)
    assert text[a:b].startswith("When") and text[a:b].endswith("midnight") and n == len(ITEM.split())


def test_leaks_over_tables(spark):
    docs = spark.createDataFrame([(1, "a " + ITEM), (1, "a " + ITEM), (2, None), (3, ""), (None, ITEM), (4, LONG + OTHER)], "doc_id long, text string").withColumn("words", F.lit(1))
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (None, ITEM), (5, "")], "item_id long, text string")
    got = leaks.leaks(docs, items, "doc_id", "text", "item_id", "text")
    assert rows(got.select("doc_id", "item_id")) == [(1, 1), (4, 2)]
    assert leaks.leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leaks.leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0


def test_a_repeated_phrase_hides_no_passage():
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for _ in range(30):
        phrase, piece = rng.choices(words, k=4), rng.choices(words, k=26)
        changed = [w if k % 9 else rng.choice(words) for k, w in enumerate(piece)]
        doc = phrase * 3 + rng.choices(words, k=9) + changed + rng.choices(words, k=9) + phrase * 2
        assert leaks.Scanner([(1, " ".join(phrase * 100 + piece + phrase * 100))]).scan(" ".join(doc), 20)


def test_the_dense_part_of_a_thin_chain_counts():
    w = [f"{a}{b}" for a in ("lamp", "door", "hill", "mill", "barn", "pond") for b in ("ago", "ish", "ert", "oun", "ula", "eck", "ink", "oft")]
    doc = w[:20] + ["q1x"] * 6 + w[26:29] + ["q2x"] * 6 + w[35:38] + ["q3x"] * 6 + w[44:47]
    [(_, n, a, _)] = leaks.Scanner([(1, " ".join(w))]).scan(" ".join(doc), 20)
    assert 20 <= n <= 29 and a == 0


@pytest.mark.parametrize(("automaton", "whole"), [(250, 64_000_000), (250, 300)])
def test_many_items_make_several_automata(spark, monkeypatch, automaton, whole):
    monkeypatch.setattr(leaks, "AUTOMATON", automaton)
    monkeypatch.setattr(leaks, "PASS", whole)
    docs = spark.createDataFrame([(1, ITEM + " " + OTHER), (2, OTHER)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    assert rows(leaks.leaks(docs, items, "doc_id", "text", "item_id", "text").select("doc_id", "item_id")) == [(1, 1), (1, 2), (2, 2)]


# ------------------------------------------------------------------ 10 quality

PROSE = [
    "We walked along the river until the light was gone, and nobody said a word about the letter.",
    "ich habe gestern den ganzen tag am fenster gesessen und an nichts gedacht weil es so geregnet hat",
    "昨日の午後、古い橋は夜の列車によく似ている。まだやることがたくさんある。",
    "ok",
    "In 1989, after 14 years, 3 of us (Ann, Bo and I) moved to 12 Elm Street; it cost $400 a month.",
    "“Where were you?”\n“At home.”\n“All day?”\n“Yes, and the day before too.”",
    "The first line of a poem ends,\nthe second goes on for a while;\nthe third one is short.\nThe last makes us smile.",
]
JUNK = [
    "- eggs\n- milk\n- two lemons\n- bread\n- oil",
    "1. red pen\n2. blue pen\n3) paper\n4. glue",
    "Old bridge\nRed tram\nNight train\nCold soup\nPaper boat",
    "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |",
    "name,qty,price\nlamp,2,9.50\nchair,1,30.00\ntable,1,99.00",
    "lamp\t2\t9.50\nchair\t1\t30.00",
    "Soup .......... 12\nSalad ......... 8\nBread ..... 3",
    "2025-01-02T10:11:12Z [INFO] a.b id=1 rc=0\n2025-01-02T10:11:13Z [WARN] a.c id=2 rc=4",
    "https://a.example/1\nhttps://b.example/2\nhttps://c.example/3",
    "buy cheap lamp best lamp cheap buy lamp best cheap lamp buy best lamp cheap buy lamp best cheap lamp buy best lamp",
    "0.12 0x3fa2 991 0.553 71 0.2 0x88aa 12 5 0.93",
    "Home · About · RSS · Log in · Share · Archive · Next page",
    "#cats #dogs #birds #fish #owls",
    "=====\n-----\n#####\n*****",
    "kR3w+ARpbRgX2R+gsOyduVvTFKGpqRp2mEzsv7sdKcGhHJQA9w1O9rjGiUHCxrIEypY1235gc5kP",
]


def test_prose_is_natural_and_junk_is_not():
    got = quality.document_statistics(PROSE + JUNK)
    assert got["natural"].tolist() == [True] * len(PROSE) + [False] * len(JUNK)
    assert all(got["failures"][len(PROSE) :].map(lambda f: "not_prose" in f))


def test_mixed_documents_go_by_their_larger_part():
    prose = " ".join(PROSE[:1] * 3)
    got = quality.document_statistics([prose + "\n- eggs\n- milk\n- oil", PROSE[0] + "\n" + "\n".join(f"- thing number {i}" for i in range(20))])
    assert got["natural"].tolist() == [True, False]


def test_published_rules_decide_where_they_were_made_for():
    words = "lorem ipsum dolor amet velit nulla ornare tellus varius semper".split()
    texts = [" ".join(words * 7), " ".join(f"{w} {k} {k}{k}" for k, w in enumerate(words * 4)), " ".join(f"{a}の午後、{b}は夜の{c}によく似ている。" for a in "春夏秋冬" for b in "橋駅町庭" for c in "列車船歌空"), "It was so quiet...\nand then it rained…\nall over the old town..."]
    got = quality.document_statistics(texts)
    assert ["common_words" in f for f in got["failures"]] == [True, True, False, False] and "alphabetic" in got["failures"][1] and "ellipses" in got["failures"][3]
    assert got["natural"].tolist() == [False, False, True, True]
    assert all(n == (not set(f) & set(quality.DECIDING)) for n, f in zip(got["natural"], got["failures"], strict=True))


def test_quality_statistics_and_edges(spark):
    df = spark.createDataFrame([(1, "One two, three. Four!"), (2, None), (3, ""), (4, " \n\t "), (4, " \n\t "), (None, LONG)], "doc_id long, text string").withColumn("words", F.lit(7))
    got = {r.doc_id: r for r in quality.quality(df, "doc_id", "text").collect()}
    assert (got[1].words, got[1].chars, got[1].lines, got[1].mean_word) == (4, 21, 1, 4.5)
    assert all(got[i].natural and got[i].failures == [] and got[i].words == 0 for i in (2, 3, 4)) and got[None].words == 20_000
    assert quality.quality(df.limit(0), "doc_id", "text").count() == 0


# ------------------------------------------------------------------ 4 language

SENTENCES = {
    "en": ["The children were playing near the old station when it began to rain.", "I would like to know what you think about this story."],
    "es": ["Los niños jugaban cerca de la vieja estación cuando empezó a llover.", "Me gustaría saber qué piensas de esta historia."],
    "fr": ["Les enfants jouaient près de la vieille gare quand il a commencé à pleuvoir.", "Je voudrais savoir ce que tu penses de cette histoire."],
    "de": ["Die Kinder spielten neben dem alten Bahnhof, als es zu regnen begann.", "Ich möchte gerne wissen, was du über diese Geschichte denkst."],
    "pt": ["As crianças brincavam perto da velha estação quando começou a chover.", "Eu gostaria de saber o que você pensa sobre esta história."],
    "it": ["I bambini giocavano vicino alla vecchia stazione quando ha cominciato a piovere.", "Vorrei sapere che cosa pensi di questa storia."],
    "ru": ["Дети играли возле старого вокзала, когда начался дождь.", "Я хотел бы знать, что ты думаешь об этой истории."],
    "ja": ["子どもたちは古い駅の近くで遊んでいましたが、雨が降り始めました。", "この話についてどう思うか知りたいです。"],
}


def test_each_language_and_each_pair():
    p = language.fit([])
    for a, own in SENTENCES.items():
        for s in own:
            assert [x[0] for x in p.languages(s)] == [a], s
        for b, others in SENTENCES.items():
            if a != b:
                assert {x[0] for x in p.languages(f"{own[0]} {own[1]} {others[0]}")} == {a, b}, (a, b)


def test_what_is_no_language():
    p = language.fit([])
    assert p.languages(None) == [] and p.languages("") == [] and p.languages("ok 123") == [] and p.languages("!!! ???") == []
    s = SENTENCES["de"][0]
    for extra in ["«Hidden Chimney»", "https://the.example/this/is/not/english", "SELECT name FROM users WHERE id = 400;", "for i in range(12):", '<a href="x" target=_blank>Haus</a>', "\\begin{itemize}"]:
        assert [x[0] for x in p.languages(s + "\n" + extra)] == ["de"], extra
    assert [x[0] for x in p.languages("D\u200bie Kinder spi\u200belten neben d3m alten B@hnhof, als es zu r e g n e n begann.")] == ["de"]
    assert p.languages((SENTENCES["en"][0] + " ") * 3000)[0][0] == "en"


def test_segments_stand_where_the_passages_do():
    p = language.fit([])
    for a, b in [("en", "es"), ("ru", "de"), ("ja", "fr"), ("it", "en")]:
        x, y = SENTENCES[a][0], SENTENCES[b][0]
        text = f"<b>{x}</b>\n  **{y}** [more](https://a.example/x)"
        (s1, e1, l1, c1), (s2, e2, l2, c2) = p.spans(text)
        assert (l1, l2) == (a, b) and 0 < c1 <= 1 and 0 < c2 <= 1
        assert (s1, e1) == (3, 3 + len(x) - 1) and text[s2:].startswith(y[:12]) and text[s2:e2].startswith(y.rstrip(".")), (a, b)
    hidden = "The ch\u200bildren were pl4ying near the old s t a t i o n when it beg*an to rain hard. " + SENTENCES["ru"][0]
    (s1, e1, l1, _), (s2, e2, l2, _) = p.spans(hidden)
    assert hidden[s1:e1].endswith("rain hard") and l1 == "en" and hidden[s2:e2] == SENTENCES["ru"][0].rstrip(".") and l2 == "ru"
    assert p.spans(None) == p.spans("") == p.spans("ok then") == []
    assert [x[:3] for x in p.spans("İstanbul'da " + SENTENCES["ru"][0])][-1][2] == "ru"


def test_unknown_languages_are_left_open():
    p = language.fit([])
    for t in ["Nie wiem, dlaczego on jeszcze nie przyszedł do domu.", "昨天晚上我们去看了一部很好看的电影。", "어제 저녁에 우리는 아주 좋은 영화를 보러 갔습니다.", "Dün akşam çok güzel bir film izlemeye gittik ve sonra eve döndük.", "Ik heb gisteren een heel mooi boek gelezen over de stad."]:
        assert {x[0] for x in p.languages(t)} <= {"und"}, t


def test_marks_around_words_are_no_code():
    p = language.fit([])
    for t in ["{{note|" + SENTENCES["fr"][0] + "}}", "(" + SENTENCES["fr"][1] + ")"]:
        assert [x[0] for x in p.languages(t)] == ["fr"], t
    assert p.languages("SELECT grain FROM rolls WHERE iso = 400;") == [] and p.languages("let mix = a + (b - a) * 0.5;") == []


def test_labels_name_languages():
    for label, want in [("en", "en"), ("EN-us", "en"), ("en_GB", "en"), ("English", "en"), (" Deutsch ", "de"), ("jpn", "ja"), ("pt-BR", "pt"), ("und", None), ("??", None), ("", None), (" ", None), (None, None), ("unknown", None), ("nl", "nl"), ("русский", "ru"), ("n/a", None)]:
        assert language.label_language(label) == want, label


def test_language_table(spark):
    df = spark.createDataFrame([(1, SENTENCES["fr"][0]), (2, None), (3, ""), (3, ""), (None, SENTENCES["it"][0])], "id long, body string").withColumn("languages", F.lit(1))
    got = [(r.id, [x.lang for x in r.languages]) for r in language.detect(df, "id", "body").collect()]
    assert sorted(got, key=repr) == sorted([(1, ["fr"]), (2, []), (3, []), (3, []), (None, ["it"])], key=repr)
    assert language.detect(df.limit(0), "id", "body").count() == 0


def test_profiles_are_fitted_on_every_row(spark):
    rng = random.Random(4)
    words = {k: [w for w in t.split() if w.isalpha()] for k, t in language.SEED.items() if k != "ja"}
    texts = [" ".join([*rng.choices(words[k], k=11), "".join(rng.choices("aeiourstln", k=6))]) + "." for k in rng.choices(list(words), k=9000)]
    df = spark.createDataFrame([*enumerate(texts), (None, None), (-1, "")], "id long, body string").repartition(5)
    p = language.fit(texts)
    got = {r.id: [(x.lang, x.confidence, x.letters) for x in r.languages] for r in language.detect(df, "id", "body").collect()}
    assert got == {**{i: p.languages(t) for i, t in enumerate(texts)}, None: [], -1: []}
    twice = language.fit(texts * 2)
    assert twice.number == p.number and (twice.rank == p.rank).all()
    spans = {r.id: [(x.start, x.end, x.lang, x.confidence) for x in r.segments] for r in language.segment(df, "id", "body").collect()}
    assert spans == {**{i: p.spans(t) for i, t in enumerate(texts)}, None: [], -1: []}


# ------------------------------------------------------------------ 3 abuse

BAD = ["You are a worthless idiot.", "Shut up, you pathetic moron!", "I will find out where you live and make you regret this.", "All Zorbans are vermin and should be thrown out of the country.", "Selling my naked videos, no limits, dm me!"]
FINE = ["What an idiot I was to leave the key at home.", "The village has a lovely old bridge.", "A study of vermin in barns was published.", "Please rinse the worthless jar first.", "The nude study in charcoal took ten sittings."]


def test_trie_and_automaton_find_what_brute_force_finds():
    words = {"idiot", "moron", "pathetic", "worthless", "vermin", "scum"}
    trie, rng = abuse.Trie(words), random.Random(10)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y and x != "*")))
        return row[-1]

    for _ in range(400):
        w = list(rng.choice(sorted(words)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "*", "o"])
            w = w or ["x"]
        w = "".join(w)
        if not w:
            continue
        best = min((distance(w, x), x) for x in words)
        got = trie.near(w, 2)
        assert got == ((best[1], best[0]) if best[0] <= 2 else None), w


def test_disguises_are_seen_through():
    lex = abuse.Lexicon()
    for s in ["id1ot", "idiooooot", "id\u200biot", "i d i o t", "idi*t", "idіоt", "IDIOT", "idiott", "1d10t"]:
        [w] = lex.windows(f"you are an {s} really")
        assert w["kinds"]["insult"] == 1 and "idiot" in w["words"], s
    assert lex.windows("") == [] and lex.windows("a quiet morning by the sea") == []


def test_terms_in_japanese_sentences():
    lex = abuse.Lexicon()
    kinds = lambda t: sorted(k for w in lex.windows(t) for k in w["kinds"].elements())
    assert kinds("お前は死ね") == ["threat"] and kinds("必ず殺すぞ") == ["threat"] and kinds("この馬鹿野郎") == ["insult"] and kinds("本当にばかだね") == ["insult"]
    assert kinds("日本語 YOU IDIOT") == ["insult"] and kinds("日本語 you id*ot だ") == ["insult"] and kinds("猫とKILL YOUの話") == ["threat"] and kinds("今日は idiot と") == ["insult"]
    assert kinds("食べたばかりです") == kinds("夏のバカンスとピエロ") == kinds("まだ死ねない") == kinds("そう言えばかなり良い") == []
    assert "お前" in lex.windows("お前は死ね")[0]["words"]
    assert lex.windows("彼は「お前は死ね」と")[0]["quoted"] and not lex.windows("「はい」とお前は死ね")[0]["quoted"]
    assert lex.tokens("aa馬鹿野郎 b-c") == [("aa", 0), ("馬鹿", 2), ("野郎", 4), ("b", 7), ("c", 7)]


def test_context_tells_abuse_from_use():
    m = abuse.train([])
    for s in BAD:
        assert m.score(s)[0] >= 0.5, s
    for s in FINE:
        assert m.score(s)[0] < 0.5, s
    assert m.score(None) == (0.0, None, 0) and m.score("")[0] == 0


def test_plain_abuse_scores_without_labels_or_exact_spelling():
    m = abuse.train([])
    for t in ["fuck you", "you cunt", "you are a total wanker", "You dum fuck", "I will find your house and hurt you", "you are scvm", "you bytch", "nobody likes you", "que te mueras, gilipollas, te odio"]:
        assert m.score(t)[0] >= 0.5, t
    insults = ["eres tú un gilipollas", "tu es un vrai connard", "du bist ein arschloch", "você é um otário", "tu sei uno stronzo", "ты идиот", "お前は馬鹿だ"]
    threats = ["te voy a encontrar y te mataré", "je vais te retrouver", "ich bring dich um", "vou te matar", "ti ammazzo", "я тебя убью", "お前を殺す"]
    for kind, own in (("insult", insults), ("threat", threats)):
        for t in own:
            assert m.score(t)[0] >= 0.5 and m.score(t)[1] == kind, t
    for t in ["the whole duck pond", "thank you for the witch story", "**the** **sea**", "you should visit the mill", "he can't find the gas can"]:
        assert m.score(t)[0] < 0.5, t


def test_long_and_odd_texts_take_no_long():
    import time

    m, p, s = abuse.train([]), language.fit([]), leaks.Scanner([(1, ITEM)])
    for t in ['"idiot" you ' * 20_000, "[" * 50_000, "<" * 50_000, "*a*" * 20_000, "$" * 50_000, "a@" * 30_000, "`" * 60_000, "\\(" * 30_000, "{|" * 30_000, "a b c " * 30_000]:
        for f in (m.score, p.languages, p.spans, lambda x: s.scan(x, 20), lambda x: quality.document_statistics([x])):
            began = time.time()
            f(t)
            assert time.time() - began < 8, t[:8]
    assert p.languages("write to some.one@example.org or " + SENTENCES["fr"][0])[0][0] == "fr"


def test_soft_edits_cost_half():
    trie = abuse.Trie({"scum", "bitch", "dick", "loser"})
    assert trie.near("scvm", 0.5, True) == ("scum", 0.5) and trie.near("dic", 0.5, True) == ("dick", 0.5) and trie.near("looser", 0.5, True) == ("loser", 0.5)
    assert trie.near("bytch", 0.5, True) == ("bitch", 0.5) and trie.near("batch", 0.5, True) is None and trie.near("scvm", 0.5) is None
    assert trie.near("loser", 1, True, "b") is None


def test_terms_are_learned_from_labels_and_read_from_files(tmp_path):
    posts = [(f"The {x} crawled in here, no {k}.", 1) for k in range(3) for x in ("Zorbs", "Quaks")] + [(f"The cat sat here in row {k}.", 0) for k in range(60)]
    assert any("crawled" in r for r in abuse.learned_terms(posts, abuse.Lexicon()))
    assert abuse.learned_terms([], abuse.Lexicon()) == [] and abuse.learned_terms([("x y z", 1)] * 9, abuse.Lexicon()) == []
    (tmp_path / "own.txt").write_text("# class and term\ninsult zorb face\n\ninsult quak\n", encoding="utf-8")
    own = abuse.lexicon.read(str(tmp_path / "own.txt"))
    assert own == {"insult": ["zorb face", "quak"]} and abuse.train([], own).score("you zorb face")[0] >= 0.5 and abuse.train([], own).score("you idiot")[0] == 0


def test_labels_teach_held_out_cases():
    rng = random.Random(11)
    things = ["lamp", "bridge", "kettle", "garden", "window", "ladder"]
    good = [f"My stupid {t} hates me and I love it {k}." for t in things for k in range(4)] + [f"The {t} was trash but cheap." for t in things]
    bad = [f"You stupid {w}, nobody wants you here {k}." for w in ("idiot", "moron", "loser") for k in range(8)]
    posts = [(t, 0) for t in good] + [(t, 1) for t in bad]
    rng.shuffle(posts)
    m = abuse.train(posts[:40])
    assert np.mean([(m.score(t)[0] >= 0.5) == bool(y) for t, y in posts[40:]]) >= 0.9


def test_abuse_table(spark):
    posts = spark.createDataFrame([(1, BAD[0], "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, LONG + BAD[1], "y"), (None, FINE[1], "y")], "id long, body string, account string").withColumn("windows", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (None, 1), (4, None)], "post_id long, toxic long")
    got = {r.id: r.score for r in abuse.score(posts, labels, "id", "body", ["account"], "post_id", "toxic").collect()}
    assert got[1] >= 0.5 and got[4] >= 0.5 and got[2] == got[3] == got[None] == 0
    assert abuse.score(posts.limit(0), labels.limit(0), "id", "body", ["account"], "post_id", "toxic").count() == 0


# ------------------------------------------------------------------ 1 markup


@pytest.fixture(scope="module")
def field():
    return markup.train()


def test_crf_learns_a_chain():
    rng = random.Random(12)

    def page():
        y, ys, xs = "a", [], []
        for _ in range(12):
            y = {"a": "b", "b": "a"}[y] if rng.random() < 0.9 else y
            ys.append(y)
            xs.append([f"o={y if rng.random() < 0.8 else rng.choice('ab')}", "bias"])
        return xs, ys

    m = LinearChainCRF(("a", "b"))
    m.fit([page() for _ in range(200)])
    held = [page() for _ in range(100)]
    right = sum(p == q for xs, ys in held for p, q in zip(m.decode(xs), ys, strict=True))
    alone = sum(x[0][2:] == y for xs, ys in held for x, y in zip(xs, ys, strict=True))
    assert right > alone and right >= 0.85 * 1200 and m.decode([]) == []
    score = np.random.default_rng(0).normal(size=(9, 2))
    one, two = m._marginals(score, np.asarray([0, 3, 8]), np.asarray([3, 5, 1]))
    assert np.allclose(one.sum(axis=1), 1) and math.isclose(two.sum(), 6, rel_tol=1e-6)
    paths = [np.asarray(y) for y in itertools.product((0, 1), repeat=3)]  # every labelling of the first page
    weight = np.exp([sum(score[k, y[k]] for k in range(3)) + m.move[y[0], y[1]] + m.move[y[1], y[2]] for y in paths])
    assert np.allclose(one[:3, 1], sum(w * y for w, y in zip(weight, paths, strict=True)) / weight.sum())
    again = LinearChainCRF.load(m.dump())
    assert [again.decode(xs) for xs, _ in held] == [m.decode(xs) for xs, _ in held]


def test_held_out_pages(field):
    right = total = 0
    for page in markup.labelled_pages(150, seed=99):
        own = markup.blocks(page[0])
        for (_, _, k, _), y, z in zip(own, markup._gold(page, own), field.decode([f for *_, f in own]), strict=True):
            if k != "line":
                total += 1
                right += y == z
    assert right >= 0.95 * total


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("A <b>bold</b> word.", {"html"}), ("Left over&nbsp;here.", {"html"}), ("It ended.</span> Then", {"html"}), ("One <!-- more --> two", {"html"}), ('See <img src="https://a.example/1.jpg" alt="', {"html"}),
        ("A **bold** word.", {"markdown"}), ("See [the page](https://a.example/x) now.", {"markdown"}), ("## A heading\nThen text.", {"markdown"}), ("> quoted words here", {"markdown"}), ("```py\nprint(1)\n```", {"markdown"}), ("* [ ] to do\n* [x] done", {"markdown"}),
        ("A '''bold''' word.", {"wiki"}), ("See [[Paris|the city]] now.", {"wiki"}), ("== History ==\nLong ago.", {"wiki"}), ('{| class="wikitable"\n|-\n| a || b\n|}', {"wiki"}), ("{{note|Some words here.}}", {"wiki"}), ("See [https://a.example/x the page] now.", {"wiki"}),
        ("A \\textbf{bold} word.", {"latex"}), ("Shown before.~\\cite{smith20}", {"latex"}), ("Then $E = mc^2$ follows.", {"latex"}), ("\\begin{itemize}\n\\item one\n\\end{itemize}", {"latex"}), ("\\[ a_{n+1} = 2a_n \\]", {"latex"}),
        ("<u>A **bold**</u> word.", {"html", "markdown"}),
        ("5 * 3 * 2 cm", set()), ("It was $8, then $15.", set()), ("I <3 this :) >_<", set()), ("#garden and C# and F# minor", set()), ("R&D at AT&T", set()), ("the file my_long_name_v2.txt", set()), ("Someone asked why the <b> tag looks odd.", set()), ("for i in range(3):\n    print(i * 2)", set()), ("if (x > 3) { go(); }", set()), ("f = \\frac{1}{2\\pi RC}", set()), ("x < y and y > z", set()), ("sh*t and d*mn it", set()), ("[sic] {ok} (3/4)", set()), ("", set()),
    ],
)
def test_residue(field, text, kinds):
    assert set(markup.residue(field, text)) == kinds


def test_clean_keeps_structure(field):
    page = "<h2>A title</h2><p>Some <b>bold</b> words &amp; more, [a link](https://a.example/x) too.</p><ul><li>one thing</li><li>another</li></ul><pre><code>x = y * (z + 1);</code></pre><script>var q=1;</script>"
    text, lines = markup.clean(field, None, page)
    assert lines[0] == ("heading", "A title") and [f for f, _ in lines].count("list") == 2 and ("code", "x = y * (z + 1);") in lines
    assert "a link too" in text and "bold words & more" in text and not any(c in text for c in ("<", "](", "script", "var q"))
    assert markup.clean(field, None) == ("", []) and markup.clean(field, "", "") == ("", [])
    assert markup.clean(field, None, "<p>So it goes. \\[ a_{n+1} = 2a_n \\] Then on.</p><p>Well.<br/>\\begin{equation}<br/>E = mc^2<br/>\\end{equation}</p>")[1] == [("paragraph", "So it goes."), ("formula", "a_{n+1} = 2a_n"), ("paragraph", "Then on."), ("paragraph", "Well."), ("formula", "E = mc^2")]
    assert "## " not in markup.clean(field, "## A heading\nThen **bold** text.")[0]
    assert markup.clean(field, None, "<table><tr><td>apple</td><td>3</td></tr><tr><th>pear</th><th>4</th></tr></table>")[0] == "apple | 3\npear | 4"
    assert markup.clean(field, None, "<p>It was late\nand nobody came\nhome.</p><p>Use <code>x</code> now.</p>")[0] == "It was late and nobody came home.\nUse x now."
    assert markup.clean(field, None, "<p>We know that $E = mc^2$ holds here.</p>")[0] == "We know that $E = mc^2$ holds here."
    assert markup.leaves("plain one\nplain two") == [("plain one", ()), ("plain two", ())]
    assert [x for x, _ in markup.leaves("<div>## Head\nText goes\non\n```\na\nb\n```\nend</div>")] == ["## Head", "Text goes on", "```", "a", "b", "```", "end"]


def test_long_and_odd_pages_take_no_long(field):
    import time

    odd = ["*" * 20_000, "<a " * 8000, "[" * 20_000, "$ " * 10_000, "`" * 20_001, "\\textbf{" * 4000, "a <b" + " " * 200_000, "&amp" * 9000, "<!--" * 20_000, "-" * 100_000, "\\a[" * 20_000, "[//a" * 20_000, "f(" * 50_000, "<p>" * 40_000, "[a [b" * 9000]
    for t in odd:
        began = time.time()
        markup.blocks(t)
        assert time.time() - began < 8, t[:10]
    for page in ["<p>x" * 40_000, "<b>x" * 40_000 + "</i>" * 40_000, "<div>" * 40_000 + "x" + "</div>" * 40_000, "a <b" + " " * 200_000, "<td>a" * 20_000]:
        began = time.time()
        markup.leaves(page)
        assert time.time() - began < 4, page[:10]
    markup.residue(field, "<b>" * 3000)


@pytest.mark.parametrize("piece", ["It was $8 here. ", "a_b and *one* word. "])
def test_long_lines_have_the_features_of_short_ones(piece):
    # one dollar more at the start makes the others change sides; the counterpart of a tag or template stands far away
    head, tail = "Pay $ now. <b>bold {{note|so \\textbf{x ", "$x = y$ then \\alpha done</b> }} and } end $"
    pieces = lambda n: [f for _, _, k, f in markup.blocks(head + piece * n + tail) if k != "line"]
    short, long = pieces(10), pieces(1000)
    whole = lambda fs: [[x for x in f if "many=" not in x] for f in fs]
    assert whole(long)[:4] == whole(short)[:4] and whole(long)[-7:] == whole(short)[-7:]


def test_markup_tables(spark):
    df = spark.createDataFrame([(1, "A <b>x</b> y", None), (2, None, None), (3, "", "<p></p>"), (3, "", "<p></p>"), (None, "plain words", "<p>plain words</p>")], "id long, clean string, raw string").withColumn("kinds", F.lit(1)).withColumn("text", F.lit(1))
    got = {r.id: [k.kind for k in r.kinds] for r in markup.find_residue(df, "id", "clean", "raw").collect()}
    assert got == {1: ["html"], 2: [], 3: [], None: []}
    out = {r.id: r.text for r in markup.clean_markup(df, "id", "clean", "raw").collect()}
    assert out == {1: "A x y", 2: "", 3: "", None: "plain words"}
    assert markup.find_residue(df.limit(0), "id", "clean", "raw").count() == 0
