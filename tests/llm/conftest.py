from __future__ import annotations

import random

import pytest

#: Column names that the operators use inside, as extra columns of an input.
CLASHING = "node string, score double, shard int, slot long, block int, h long, _rep long, _bad long, _text string, label string, y int, rank int, n long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    long_text = " ".join(rng.choice(words) for _ in range(60_000))
    copy = " ".join(rng.choice(words) for _ in range(80))
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "  \n\t ", "en", "s"), (4, "one", "en", "s"), (5, "one", "fr", "s"), (6, long_text, "en", "s"), (7, copy, "en", "s"), (8, copy, "en", "s"), (8, copy, "en", "s"), (None, copy + " tail", "en", None), (9, "1234 5678 --", "en", "s"), (10, "é" * 5000, "fr", "s")]
    n = len(CLASHING.split(", "))
    full = [(i, t, lang, src, len(t or ""), *[None] * n) for i, t, lang, src in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
