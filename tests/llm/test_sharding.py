from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import sharding


def check(rows, n):
    assert len(rows) == n
    for _, g in rows.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (rows.groupby("text_crc32")["shard"].nunique() == 1).all()


def test_differencing_keeps_each_column_apart_and_balances():
    rng = np.random.default_rng(1)
    loads = np.zeros((300, 4), np.int64)
    loads[:, 0] = rng.integers(1, 1000, 300)
    to = sharding.difference(loads)
    assert all(sorted(row) == [0, 1, 2, 3] for row in to.tolist())
    sums = np.bincount(to[:, 0], loads[:, 0], 4)
    assert sums.max() - sums.min() <= 3


def test_differencing_is_close_to_the_best_split_of_a_few():
    loads = np.zeros((8, 2), np.int64)
    loads[:, 0] = [90, 71, 60, 52, 33, 21, 20, 9]
    to = sharding.difference(loads)[:, 0]
    got = abs(int(loads[to == 0, 0].sum()) - int(loads[to == 1, 0].sum()))
    best = min(abs(sum(x * s for x, s in zip(loads[:, 0].tolist(), signs, strict=True))) for signs in itertools.product((1, -1), repeat=8))
    assert got <= best + 8


def test_levels_and_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 4)
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 700).cast("int")).alias("text"))
    rows = sharding.shard_documents(docs, 16).toPandas()
    check(rows, 1500)
    sums = rows.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() <= 0.01 * sums.mean()


def test_edges(edge_docs, no_docs):
    check(sharding.shard_documents(edge_docs, 16).toPandas(), edge_docs.count())
    assert sharding.shard_documents(no_docs, 16).count() == 0
