from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import pages as G

WORDS = ["alpha", "beta-2", "Gamma", "x9", "of", "the", "rare", "HAK-180", "电池", "容量", "a/b"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    leaves = [(i, " ".join(rng.choice(WORDS) for _ in range(3)), " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 2, 30])))) for i in range(300)]
    asked = [("one", "alpha"), ("part", "amma"), ("two", "the rare"), ("long", "alpha of the Gamma x9"), ("cjk", "电池 容量"), ("mixed", "the 电池 HAK-180"), ("none", "?!"), ("gone", "nowhere to be found"), ("cut", "lpha of the Gam")]
    return spark.createDataFrame(leaves, "node_id long, title string, text string"), spark.createDataFrame(asked, "query_id string, question string"), leaves, dict(asked)


def test_phrases_are_those_of_a_scan(spark, corpus):
    leaves, asked, rows, questions = corpus
    q = G.questions_of(asked)
    got = {(r["query_id"], r["node_id"]) for r in G._phrases(q, G.postings(leaves), leaves).collect()}
    want = {(k, i) for k, x in questions.items() if k != "none" for i, title, text in rows if text and (x.lower() in text.lower() or x.lower() in title.lower())}
    assert got == want and len({k for k, _ in want}) > 4


def test_a_stored_index_gives_the_same_rows_from_some_buckets(spark, corpus, tmp_path):
    leaves, asked, *_ = corpus
    path = str(tmp_path / "index")
    G.store(leaves, path, buckets=64)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(G.search_stored(asked, path)) == key(G.search(asked, leaves))
    few = asked.filter("query_id = 'one'")
    plan = G.stored_postings(G.questions_of(few), path, 64, "long")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    read = {r[0] for r in spark.read.parquet(f"{path}/postings").select("bucket").distinct().collect()}
    wanted = {r[0] for r in G.questions_of(few).select(F.explode("asked").alias("x")).select(G._bucket(64, "x.kind", "x.w")).distinct().collect()}
    assert len(wanted) <= 2 < len(read)
    files = spark.createDataFrame([(f"{path}/manifest/_SUCCESS",), (f"{path}/leaves/_SUCCESS",), ("/x/manifest/part-0",)], "path string")
    assert [r["path"] for r in G.indexes(files).collect()] == [path]


def test_an_index_without_a_manifest_is_refused(spark, corpus, tmp_path):
    leaves, asked, *_ = corpus
    (tmp_path / "manifest").mkdir()
    with pytest.raises(ValueError, match="whole index"):
        G.search_stored(asked, str(tmp_path))
    assert G.search(asked.limit(0), leaves).count() == 0 and G.search(asked, leaves.limit(0)).count() == 0
