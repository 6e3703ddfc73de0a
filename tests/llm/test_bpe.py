from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lodestar.llm import bpe, queries
from lodestar.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary(PATH, public_tokenizers.PATTERN)


ALPHABETS = ("ab", "abcdefghij ", "àéîõü çñ a", "漢字テスト日本語の", "\n \t\r\x1c\x85　a", "0123456789'sdtll ve", "abc😀😁 !?#", "a")


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_ids_are_those_of_the_library(library, words, alphabet):
    rng = random.Random(alphabet)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 9, 30, 127, 128, 129, 130, 700, 5000) for _ in range(4)]
    flat, counts = words.encode(texts)
    want = [library.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_a_long_run_without_a_break(library, words):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert words.encode([text])[0].tolist() == library.encode_ordinary(text)
    assert bpe.merge_wide(words.bytes[list(b"x" * 5000)], words.pairs).tolist() == library.encode_ordinary("x" * 5000)


def test_a_merge_that_opens_a_lower_rank_stops_the_round(tmp_path):
    """"ab" ranks above "abc" and "xab": one merge at a time takes the lower pair before the next "ab"."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xab": 257, b"ab": 258, b"abab": 259, b"aba": 260}
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in ranks.items()))
    words = bpe.Vocabulary(str(path), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for n in (3, 6, 20, 100, 200, 400):
        for _ in range(20):
            text = "".join(rng.choice(["a", "b", "c", "x", "ab", "abc", "xab"]) for _ in range(n))
            assert words.encode([text])[0].tolist() == other.encode_ordinary(text), text


def test_forgetting_changes_nothing(library, words, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "PIECES", 4)
    monkeypatch.setattr(bpe, "RUN_BYTES", 20)
    texts = ["one two three four five six seven eight nine ten", "", "one two", "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"]
    flat, counts = words.encode(texts)
    want = [library.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_query_is_what_the_library_gives(spark, library):
    got = {r["doc_id"]: r for r in queries.op11_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_edges_and_the_way_back(spark, edge_docs, no_docs):
    ids = bpe.encode(edge_docs, PATH, public_tokenizers.PATTERN)
    assert ids.columns == ["doc_id", "ids"] and ids.count() == edge_docs.count()
    back = bpe.decode(ids, PATH, public_tokenizers.PATTERN)
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()), key=key) == sorted(((r["doc_id"], r["text"] or "") for r in edge_docs.collect()), key=key)
    assert bpe.encode_and_decode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH, public_tokenizers.PATTERN).first()["decoded"] is None


def test_ids_out_of_range_raise(words):
    with pytest.raises(ValueError, match="between"):
        words.decode(pa.array([[0, 1 << 20]], pa.list_(pa.int32())))
