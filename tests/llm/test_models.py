from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import language_id, quality_bayes, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_learns_words_and_misspellings():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeioutnshr"), rng.integers(2, 7)))
    texts, y = [], []
    for i in range(900):
        t = [word() for _ in range(rng.integers(20, 200))]
        y.append(int(i % 6 == 0))
        if y[-1]:
            for _ in range(3):
                t[rng.integers(len(t))] = rng.choice(["blockhead", "blockheaded", "dimwit", "dimwitted"])
        texts.append(" ".join(t))
    fitted = toxicity.train(pa.array(texts), np.array(y))
    clean = [" ".join(word() for _ in range(80)) for _ in range(60)]
    bad = [c + " you blockheads and dimwitty " + c for c in clean]
    p = toxicity.scores(pa.array(clean + bad), *fitted)
    assert (p[:60] < 0.5).mean() > 0.9 and (p[60:] > 0.5).mean() > 0.9


def test_toxicity_edges(spark, edge_docs, no_docs, no_labels):
    for labels in (no_labels, spark.createDataFrame([(4, 1, 1), (7, 1, 0), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")):
        got = toxicity.classify(edge_docs, labels).collect()
        assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.classify(no_docs, no_labels).count() == 0


def test_toxicity_scores_do_not_depend_on_batches():
    rng = np.random.default_rng(1)
    texts = [" ".join("".join(rng.choice(list("abcdé "), 6)) for _ in range(n)) for n in (0, 1, 5, 300, 2)]
    numbers = rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32)
    curve = np.array([1.0, 0.1, -0.2, 0.0])
    together = toxicity.scores(pa.array(texts), numbers, 0.3, curve)
    assert np.allclose(together, [toxicity.scores(pa.array([t]), numbers, 0.3, curve)[0] for t in texts])


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred != 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_language_edges(edge_docs, no_docs):
    got = {r["doc_id"]: r for r in language_id.identify(edge_docs).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9))
    assert got[6]["lang_pred"] in ("en", "fr") and language_id.identify(no_docs).count() == 0
    nothing = language_id.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_network_application_equals_its_training_form():
    network = language_id.Network(3)
    texts = ["", "a", "abc é", "x" * 255, "hello world " * 60]
    applied = language_id.Applied(network, ["a", "b", "c"])
    got = applied.probabilities(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        x, first, many, _ = language_id.windows(raw, np.array([0, len(raw)]))
        total, length = np.zeros(3), 0
        for a, b in zip(first, first + many, strict=True):
            features = []
            for w, f in zip(language_id.WIDTHS, network.filters, strict=True):
                features.append(np.max([sum(network.embedding[x[p + j]] @ f[j] for j in range(w)) for p in range(a, b)], axis=0))
            total += (b - a) * (np.maximum(np.concatenate(features), 0) @ network.weights + network.bias)
            length += b - a
        p = np.exp(total / length - (total / length).max())
        assert np.allclose(row, p / p.sum(), atol=1e-4)


def test_gradients_of_the_network():
    rng = np.random.default_rng(3)
    n = language_id.Network(3)
    x = rng.integers(0, 256, (4, language_id.WINDOW + language_id.PAD)).astype(np.uint8)
    length, y = np.array([256, 5, 100, 1]), np.array([0, 1, 2, 0])
    _, grads = n.step(x, length, y)
    for p, g in ((n.filters[1], grads[2]), (n.weights, grads[-2])):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        eps = 1e-2
        p[at] += eps
        up = n.step(x, length, y)[0]
        p[at] -= 2 * eps
        down = n.step(x, length, y)[0]
        p[at] += eps
        assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_bayes.classify(docs, labels, F.col("source"), F.col("lang")).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95


def test_sparse_sites_are_shrunk_and_large_ones_speak_for_themselves(spark):
    rows = [("big", "a", 5000, 4000.0), ("big", "b", 3000, 2700.0), ("bad", "a", 4000, 800.0), ("tiny", "a", 1, 0.0)]
    groups = spark.createDataFrame([(h, p, n, s, s * 0.98) for h, p, n, s in rows], "host string, path string, n long, s double, q double")
    weight = quality_bayes.prior_weight(groups.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), F.lit(0.625))
    assert 1 <= weight < 100
    assert (0.0 + weight * 0.625) / (1 + weight) > 0.3


def test_quality_edges(edge_docs, no_docs, no_labels):
    got = quality_bayes.classify(edge_docs, no_labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_bayes.classify(no_docs, no_labels, F.col("source"), F.col("lang")).count() == 0
