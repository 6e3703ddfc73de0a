from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import max_sketch

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return Counter(TERM.findall((text or "").translate(LOWER)))


def brute(docs, items, k=10):
    """Every document scored for every item, in plain Python."""
    counted = [(i, c, c.total()) for i, c in ((i, terms(t)) for i, t in docs) if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    vocabulary = [f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(6000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 400])))) for i in range(1500)]
    docs += [(5000 + i, docs[7][1]) for i in range(400)] + [(3, "Über-Größe X_Y z'9"), (None, docs[8][1]), (3, docs[9][1])]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 4, 30])))) for j in range(60)]
    items += [(7, docs[7][1]), (7, docs[7][1]), (70, "no-such-term-at-all"), (71, ""), (72, None), (None, "über größe x")]
    return docs, items


def test_equals_scoring_everything(spark, corpus):
    docs, items = corpus
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert rows(max_sketch.search(*frames)) == brute(docs, items)
    assert rows(max_sketch.search(*frames, k=3)) == brute(docs, items, 3)


def test_parts_and_small_blocks_give_the_same_rows(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(max_sketch, "BROADCAST_BYTES", 4000)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert rows(max_sketch.search(*frames)) == brute(docs, items)


def test_bounds_hold_and_spare_most_documents(corpus):
    docs, items = corpus
    counted = [terms(t) for _, t in docs]
    n_docs, n_terms = len(docs), sum(c.total() for c in counted)
    own = max_sketch.Items.of(sorted(set((i, t) for i, t in items if i is not None and t)))
    df = Counter(t for c in counted for t in c)
    own = own.weighted(n_docs, {k: df[t.decode()] for t, k in own.terms.items() if df[t.decode()]})
    block = max_sketch.Block(own, n_docs, n_terms)
    for key, text in docs:
        block.add(key, text)
    block.close()
    bounds = block.bounds(0, len(own.ids))
    for q in range(len(own.ids)):
        exact = block.exact(np.arange(len(docs)), q)
        assert (bounds[:, q] >= exact).all()
    best = max_sketch.Best(len(own.ids), 10)
    best.search(block)
    assert best.scored < 0.5 * (bounds > 0).sum()


def test_long_texts_are_counted_in_runs():
    text = "Ab cd--ef é" * 1000 + "x" * 500
    assert max_sketch.count_terms(text, limit=100) == max_sketch.count_terms(text) == {k.encode(): n for k, n in terms(text).items()}


def test_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([("a", "one 1234 ÉÉ"), ("b", "é" * 5000)], "item_id string, text string")
    want = brute([(r["doc_id"], r["text"]) for r in edge_docs.collect()], [tuple(r) for r in items.collect()])
    assert rows(max_sketch.search(edge_docs, items)) == want and want
    assert max_sketch.search(no_docs, items).count() == 0 and max_sketch.search(edge_docs, items.limit(0)).count() == 0
