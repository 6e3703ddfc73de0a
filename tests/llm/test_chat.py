from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import chat
from lodestar.llm.queries import tokenizer_path

texts = st.text(st.sampled_from("[INST]/</s>\\ aé\n漢"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_escape_is_reversible_and_hides_control_strings(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in (chat.OPEN, chat.MIDDLE, chat.CLOSE))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]), texts), min_size=1, max_size=6))
def test_mask_covers_each_assistant_text_once(turns):
    text, _, offsets, mask = chat.encode(tokenizer_path(), turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in chat.masked_spans(offsets, mask)) == "".join(t for r, t in turns if r == "assistant")


def test_edges(spark, monkeypatch):
    rows = [(1, 0, "user", None, 9), (1, 1, "assistant", "  a ", 9), (1, 1, "assistant", "a", 9), (1, None, None, "x", 9), (None, 0, "assistant", "n", 9), (2, 0, "assistant", "y" * 700_000, 9), (2, 1, "assistant", "z", 9)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, run int")
    got = {r["conv_id"]: r for r in chat.format_digests(c, tokenizer_path()).collect()}
    whole = "".join(f"{r}\n{t}\n" for r, t in (("", "x"), ("user", ""), ("assistant", "  a "), ("assistant", "a")))
    assert got[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and got[1]["loss_chars"] == 5 and got[1]["n_turns"] == 4
    assert got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 700_001
    assert got[2]["loss_sha256"] == hashlib.sha256(b"y" * 700_000 + b"z").hexdigest()
    assert chat.format_digests(c.limit(0), tokenizer_path()).count() == 0
    runs = chat.format_conversations(c, tokenizer_path()).filter("conv_id = 2").collect()
    assert len(runs) == 2 and all(len(r["ids"]) == len(r["mask"]) == len(r["starts"]) for r in runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(max_size=60)), min_size=1, max_size=4))
def test_both_encoders_give_the_same_ids_and_offsets(turns):
    e = chat.encoder(tokenizer_path())
    assert e.fast is not None
    text, _ = chat.render(turns)
    ids, offsets = e.encode(text)
    slow = e.slow.encode(text, add_special_tokens=False)
    assert ids.tolist() == slow.ids and [tuple(x) for x in offsets.tolist()] == slow.offsets


def test_string_ids(spark):
    c = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "assistant", "<|endoftext|> 漢 é")], "conv_id string, turn long, role string, text string")
    got = {r["conv_id"]: r["loss_chars"] for r in chat.format_digests(c, tokenizer_path()).collect()}
    assert got == {"a": 0, "b": 17}
