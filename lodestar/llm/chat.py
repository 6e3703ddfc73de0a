"""Chat formatting with a loss mask.

Each conversation is rendered as one text, `[INST]role[/INST]text</s>` per
turn. The three control strings are tokens of their own, so no other token
crosses a turn's border, and occurrences inside roles or texts are escaped by
one backslash after their first character (a run of backslashes there grows
by one, so unescaping gives back every text). The rendered text is encoded
once with offsets; the sorted spans of trained turns are intersected with the
token spans by binary search.

Turns arrive sorted in the partition of their conversation and stream through
the task. A conversation is encoded in runs of whole turns of about RUN_CHARS
characters (control tokens make the result the same as for one call), so a
conversation of any length needs bounded memory. A digest over ordered turns
is inherently one task's work per conversation.

Defined cases: a null text or role counts as empty; turns with the same
number are ordered by role and text; a null turn comes first; rows with a null
conv_id form one conversation; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .packing import LONG_RUN

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
RUN_CHARS = 1 << 18
_ESCAPE = re.compile(r"(\[|<)(\\*)(/?INST\]|/s>)")
_UNESCAPE = re.compile(r"(\[|<)\\(\\*)(/?INST\]|/s>)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the (start, end) span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at = spans[-1][1] + len(CLOSE)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Read (role, text) back from a formatted text."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, middle, text = part.removeprefix(OPEN).partition(MIDDLE)
        if not part.startswith(OPEN) or not middle:
            raise ValueError("not a formatted conversation")
        out.append((unescape(role), unescape(text)))
    return out


def mask_of(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that lie in one of the sorted, disjoint `spans`, found by binary search."""
    if not len(offsets) or not len(spans):
        return np.zeros(len(offsets), bool)
    i = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    return (i >= 0) & (offsets[:, 1] <= spans[np.maximum(i, 0), 1]) & (offsets[:, 1] > offsets[:, 0])


class Encoder:
    """Ids and character offsets of a rendered text, with the control strings as tokens of their own; strings of other special tokens are ordinary text.

    With a rank file of the same vocabulary (.tiktoken) beside the tokenizer
    file, a text is encoded with that in one call, and a token's offsets follow
    from its number of bytes: a running sum gives its place among the text's
    bytes, a table of their characters its place in the text. Texts with very
    long runs go to the tokenizer itself, whose time stays near linear there.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer, processors

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.slow.post_processor = processors.ByteLevel(trim_offsets=False)
        self.slow.add_tokens([AddedToken(x, normalized=False) for x in (OPEN, MIDDLE, CLOSE)])
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            special = {x: self.slow.token_to_id(x) for x in (OPEN, MIDDLE, CLOSE)}
            self.fast = tiktoken.Encoding(f"{ranks.stem}-chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)
            self.bytes = np.zeros(max(*table.values(), *special.values()) + 1, np.int64)
            for token, i in (*table.items(), *((x.encode(), i) for x, i in special.items())):
                self.bytes[i] = len(token)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if self.fast is None or len(text) >= 4096 and LONG_RUN.search(text):
            e = self.slow.encode(text, add_special_tokens=False)
            return np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)
        ids = np.array(self.fast.encode(text, allowed_special="all"), np.int32)
        ends = np.cumsum(self.bytes[ids])
        starts = ends - self.bytes[ids]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > len(text):
            # The character that a byte belongs to; a token that ends within a character covers it.
            of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
            starts, ends = of_byte[starts], of_byte[ends - 1] + 1
        return ids, np.stack([starts, ends], 1).reshape(-1, 2)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(path: str, turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """(formatted text, ids, token offsets, loss mask) of some whole turns."""
    text, spans = render(turns)
    ids, offsets = encoder(path).encode(text)
    own = np.array([role == trained for role, _ in turns], bool)
    return text, ids, offsets, mask_of(offsets, spans[own])


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """The text spans under the mask, those that touch or overlap merged."""
    some = offsets[mask]
    if not len(some):
        return []
    reach = np.maximum.accumulate(some[:, 1])
    first = np.r_[True, some[1:, 0] > reach[:-1]]
    last = np.r_[np.flatnonzero(first)[1:] - 1, len(some) - 1]
    return list(zip(some[first, 0].tolist(), reach[last].tolist(), strict=True))


FORMATTED = pa.schema([("run", pa.int64()), ("formatted", pa.large_string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("mask", pa.list_(pa.bool_()))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list[tuple[str, str]], bool]]:
    """(conversation, number of the run, turns, whether it ends the conversation), as sorted turns stream by."""
    conv, number, turns, size, begun = None, 0, [], 0, False
    for batch in batches:
        for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and c != conv:
                yield conv, number, turns, True
                number, turns, size = 0, [], 0
            elif size >= RUN_CHARS:
                yield conv, number, turns, False
                number, turns, size = number + 1, [], 0
            conv, begun = c, True
            turns.append((role, text))
            size += len(role) + len(text)
    if begun:
        yield conv, number, turns, True


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, tokenizer_path: str, trained: str = "assistant") -> DataFrame:
    """Formatted text, ids, offsets and mask, a row per run of turns (one run for all but very long conversations)."""

    key = conversations.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(key)), *FORMATTED])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, number, turns, _ in _runs(batches):
            text, ids, offsets, mask = encode(tokenizer_path, turns, trained)
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((conv, number, text, ids, offsets[:, 0], offsets[:, 1], mask), schema, strict=True)], schema=schema)

    return _sorted_turns(conversations).mapInArrow(build, f"conv_id {key.simpleString()}, run long, formatted string, ids array<int>, starts array<bigint>, ends array<bigint>, mask array<boolean>")


def format_digests(conversations: DataFrame, tokenizer_path: str, trained: str = "assistant") -> DataFrame:
    """One row per conversation: digests of what is read back from its formatted text and its mask."""
    key = conversations.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(key)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = loss = chars = 0
        whole, under, rows = hashlib.sha256(), hashlib.sha256(), []
        for conv, _, turns, last in _runs(batches):
            text, _, offsets, mask = encode(tokenizer_path, turns, trained)
            for role, said in parse(text):
                n += 1
                whole.update(f"{role}\n{said}\n".encode())
            for a, b in masked_spans(offsets, mask):
                said = unescape(text[a:b])
                loss += len(said)
                under.update(said.encode())
            chars += len(text)
            if last:
                rows.append((conv, n, whole.hexdigest(), loss, under.hexdigest(), chars))
                n = loss = chars = 0
                whole, under = hashlib.sha256(), hashlib.sha256()
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _sorted_turns(conversations).mapInArrow(build, f"conv_id {key.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
