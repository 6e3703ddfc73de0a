from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing
from lodestar.llm.queries import tokenizer_path


@pytest.mark.parametrize("text", ["", " ", "a b", "a  b   c", "x\n\ny \t z ", "naïve 漢字 don't we'll 123 4567 !!", "<|endoftext|> tail", "a" * 9000, " " * 9000 + "b", "ab   c"])
def test_ids_are_those_of_the_tokenizer(text):
    t = Tokenizer.from_file(tokenizer_path())
    want = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.Encoder(tokenizer_path()).one(text) == want


def test_assignment_fills_sequences_and_evens_out_costs():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1025, 3000)
    parts = packing.assign(lengths)
    done = np.zeros(len(lengths), int)
    fill: dict[int, int] = {}
    for i, start, n, s in parts:
        assert start == done[i]
        done[i] += n
        fill[s] = fill.get(s, 0) + n
    assert (done == lengths).all() and max(fill.values()) <= 1024
    assert len(fill) * 1024 - lengths.sum() < 1024 and len(parts) < 2 * len(lengths)


def test_costs_are_nearer_than_in_the_order_of_the_pieces():
    rng = np.random.default_rng(4)
    lengths = np.r_[rng.integers(1, 40, 4000), rng.integers(200, 500, 300)]
    rng.shuffle(lengths)
    cost: dict[int, float] = {}
    for _, _, n, s in packing.assign(lengths):
        cost[s] = cost.get(s, 0.0) + n + n * n / 1024
    ends, naive = np.cumsum(lengths), []
    for k in range(int(ends[-1]) // 1024):
        cuts = np.r_[k * 1024, ends[(ends > k * 1024) & (ends < (k + 1) * 1024)], (k + 1) * 1024]
        naive.append((np.diff(cuts) + np.diff(cuts) ** 2 / 1024).sum())
    full = [c for c in cost.values() if c >= 1000]
    assert np.std(full) < 0.6 * np.std(naive)


def test_every_id_lies_in_one_piece(edge_docs, no_docs):
    rows = packing.pack_documents(edge_docs, tokenizer_path()).toPandas()
    t = Tokenizer.from_file(tokenizer_path())
    texts = {(r["doc_id"] or -1): r["text"] or "" for r in edge_docs.collect()}
    copies = {}
    for r in edge_docs.collect():
        copies[r["doc_id"] or -1] = copies.get(r["doc_id"] or -1, 0) + 1
    for key, g in rows.groupby(rows["doc_id"].fillna(-1)):
        ids = np.array([*t.encode(texts[int(key)], add_special_tokens=False).ids, 0], "<u4")
        assert g["length"].sum() == len(ids) * copies[int(key)]
        for p in g.itertuples():
            assert p.doc_tokens == len(ids) and zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all() and g["length"].sum() <= 1024
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_copies_of_a_row_spread_over_blocks_and_other_keys_work(spark):
    docs = spark.range(3000).selectExpr("'k' AS doc_id", "repeat('same words again ', 300) AS text")
    rows = packing.pack_documents(docs, tokenizer_path(), capacity=64).toPandas()
    assert len(set(rows["sequence_id"] // (1 << 24))) > 1 and set(rows["doc_id"]) == {"k"}
