"""Every query of the folder over empty tables, tables of nulls, and the smallest given tables with extra columns and repeated rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftwell.llm import queries as q

DATA = Path("/root/testdata/sf0.001")
TABLES = ("accounts", "posts", "tags", "post_tags", "post_results", "post_labels", "eval_items", "documents")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no given tables")
#: Columns of each found query, as the tables' description has them.
COLUMNS = {"p1_found": "post_id kind", "p2_found": "query_id post_id", "p3_found": "post_id", "p4_found": "post_id lang", "p5_found": "tag_a tag_b", "p6_found": "kind id_a id_b", "p7_found": "term mark", "p8_ids": "doc_id ids", "p9_found": "doc_id item_id", "p10_found": "doc_id"}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name in ("empty", "nulls", "doubled"):
        d = tmp_path_factory.mktemp(name)
        for t in TABLES:
            df = spark.read.parquet(str(DATA / f"{t}.parquet"))
            if name == "empty":
                df = df.limit(0)
            elif name == "nulls":
                df = spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
            else:
                df = df.unionByName(df).withColumns({c: F.lit(1) for c in ("score_", "_text", "kinds", "ids", "words", "term", "place", "n", "list", "block", "languages") if c not in df.columns})
            df.coalesce(1).write.parquet(f"{d}/{t}.parquet")
        out[name] = str(d)
    return out


@pytest.mark.parametrize("name", list(q.queries()))
def test_empty_and_null_tables(spark, folders, name):
    assert q.queries()[name](spark, folders["empty"]).count() == 0
    got = q.queries()[name](spark, folders["nulls"]).count()
    assert got == (3 if name in ("p8_ids", "p10_statistics") else 0), got


@pytest.mark.parametrize("name", list(COLUMNS))
def test_repeated_rows_and_clashing_columns_change_nothing(spark, folders, name):
    one = q.queries()[name](spark, str(DATA))
    assert one.columns == COLUMNS[name].split()
    want = {tuple(str(x) for x in r) for r in one.collect()}
    assert {tuple(str(x) for x in r) for r in q.queries()[name](spark, folders["doubled"]).collect()} == want and (want or name == "p6_found")


def test_rates_are_those_of_the_scores(spark):
    from driftwell.llm import abuse

    scores = q.p3_scores(spark, str(DATA)).collect()
    for r in q.p3_rates(spark, str(DATA)).collect():
        own = [x for x in scores if x.account_id == r.account_id]
        bad = [x for x in own if x.score >= abuse.LIMIT]
        assert (r.posts, r.abusive, r.missed) == (len(own), len(bad), sum(not x.nsfw for x in bad)) and abs(r.rate - len(bad) / len(own)) < 1e-6


def test_segments_hold_the_languages(spark):
    langs = {(r.post_id, r.lang) for r in q.p4_languages(spark, str(DATA)).collect()}
    spans = q.p4_segments(spark, str(DATA)).collect()
    assert {(r.post_id, r.lang) for r in spans} == langs and all(0 <= r.start < r.end for r in spans)
