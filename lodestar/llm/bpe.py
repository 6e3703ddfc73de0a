"""Byte-level BPE in padded numpy matrices, encoding and decoding.

A text is cut by the vocabulary's pattern. The distinct pieces of a run of
texts that are no token as they stand are sorted into buckets by length, each
a matrix of ids padded to the bucket's width. In every round each row merges
its leftmost pair of least rank and is compacted by one place; ranks of
pairs come from an open-addressed hash table over (left id, right id). Rows
without a pair that can be merged leave the matrix. Pieces over `WIDE` bytes
(runs without a break) go one by one through the same rounds, but a round
merges all places of the pair of least rank up to the first whose
merge makes a pair of lower rank, which is what merging them one at a time
gives; so a round costs one pass, however often the pair stands there.

Defined cases: a null text counts as empty and gives no ids; repeated rows
are encoded one by one; a null key is an ordinary value; other columns are
not read, whatever their names; an empty table gives an empty result. A very
long text is cut and encoded in runs of pieces. Of equal ranks the leftmost
is merged first. Null ids decode to null, ids outside the vocabulary raise
ValueError. Letters and digits are those of the Unicode version of the module
`regex`, which may know code points that another library's does not yet.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import vec
from .common import text_or_empty

#: Texts of about so many bytes are encoded together; a longer text is cut into runs of PIECES pieces.
RUN_BYTES = 1 << 20
PIECES = 1 << 17
#: So many pieces a worker remembers before it starts anew.
REMEMBERED = 1 << 18
#: The widest matrix, in bytes of a piece.
WIDE = 128
NONE = np.int32(np.iinfo(np.int32).max)
#: White space as the vocabulary's own library has it: the control characters U+001C to U+001F are none.
SPACE = r"\t-\r \x85\xa0  -     　"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) to the id of the token that they make together, hashed with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(4 * len(left)).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slots(keys)
        while len(keys):
            _, first = np.unique(slots, return_index=True)
            first = first[self.keys[slots[first]] < 0]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], merged[first]
            rest = self.keys[slots] != keys
            keys, merged, slots = keys[rest], merged[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, NONE where there is none or a side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[open_].astype(np.int64) << 32) | right.ravel()[open_]
        slots, flat = self._slots(keys), out.reshape(-1)
        while len(open_):
            have = self.keys[slots]
            hit = have == keys
            flat[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (have >= 0)
            open_, keys, slots = open_[more], keys[more], (slots[more] + 1) & self.mask
        return out


class Vocabulary:
    """Tokens of a rank file: one `base64 rank` a line, all 256 single bytes among them."""

    def __init__(self, path: str, pattern: str):
        rows = [line.split() for line in Path(path).read_bytes().splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.size = max(self.ranks.values()) + 1
        tokens: list[bytes | None] = [None] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        rank = self.ranks.get
        found = [(a, b, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (a := rank(t[:i])) is not None and (b := rank(t[i:])) is not None]
        left, right, merged = (np.array(x, np.int32) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32),) * 3
        self.pairs = PairTable(left, right, merged)
        spaced = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.pattern = regex.compile(spaced)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Runs of the pattern's matches in `text`."""
        if len(text) <= RUN_BYTES:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(found, PIECES)):
            yield run

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces not met before and number them."""
        new = list(pieces)
        flat, starts = encode_pieces([p.encode() for p in new], self)
        at = len(self.starts) - 1
        self.numbers.update(zip(new, range(at, at + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
        self.flat = np.concatenate([self.flat, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if len(self.numbers) > REMEMBERED:
                self.forget()
            if missing := set(waiting).difference(self.numbers):
                self.learn(missing)
            of = np.fromiter(map(self.numbers.__getitem__, waiting), np.int64, len(waiting))
            first, n = self.starts[of], self.starts[of + 1] - self.starts[of]
            parts.append(self.flat[_places(first, n)])
            sums = np.zeros(len(of) + 1, np.int64)
            np.cumsum(n, out=sums[1:])
            at = 0
            for i, k in owners:
                counts[i] += sums[at + k] - sums[at]
                at += k
            waiting.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for run in self.pieces(text):
                waiting += run
                owners.append((i, len(run)))
                if len(waiting) >= 2 * PIECES:
                    flush()
        flush()
        return np.concatenate(parts), counts

    def decode(self, ids: pa.Array) -> pa.Array:
        """Bytes of each list of ids; null for a null list."""
        ids = ids.cast(pa.large_list(pa.int64()))
        flat = ids.flatten()
        if len(flat) and (flat.null_count or pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= self.size):
            raise ValueError(f"ids must lie between 0 and {self.size - 1}")
        tokens = self.tokens.take(flat)
        if tokens.null_count:
            raise ValueError("an id has no token in this vocabulary")
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), tokens), pa.scalar(b"", pa.large_binary()))
        return pc.if_else(pc.is_null(ids), pa.scalar(None, pa.large_binary()), joined)


def encode_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in order, where each one's begin and the last one's end)."""
    whole = list(map(vocabulary.ranks.get, pieces))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = np.ones(len(pieces), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of pieces, their ids one after another
    known = np.array([w is not None for w in whole], bool)
    found.append((np.flatnonzero(known), np.array([w for w in whole if w is not None], np.int32)))
    for i in np.flatnonzero(~known & (lengths > WIDE)).tolist():
        ids = merge_wide(vocabulary.bytes[np.frombuffer(pieces[i], np.uint8)], vocabulary.pairs)
        counts[i] = len(ids)
        found.append((np.array([i]), ids))
    low = 0
    for width in [1 << k for k in range(1, WIDE.bit_length())]:
        members = np.flatnonzero(~known & (lengths > low) & (lengths <= width))
        low = width
        for some in np.array_split(members, 1 + len(members) * width // (1 << 22)) if len(members) else ():
            ids = np.full((len(some), width), -1, np.int32)
            raw = np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)
            ids[np.arange(width) < lengths[some][:, None]] = vocabulary.bytes[raw]
            merged = merge_rows(ids, vocabulary.pairs)
            counts[some] = (merged >= 0).sum(axis=1)
            found.append((some, merged[merged >= 0]))
    starts = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    flat = np.zeros(starts[-1], np.int32)
    for some, ids in found:
        flat[_places(starts[some], counts[some])] = ids
    return flat, starts


def _places(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of the next."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def merge_rows(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """The padded matrix when nothing is left to merge in any row."""
    out = np.full_like(ids, -1)
    rows = np.arange(len(ids))
    ranks = pairs.get(ids[:, :-1], ids[:, 1:])
    while len(rows):
        each = np.arange(len(rows))
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        best = ranks[each, at] if ranks.shape[1] else np.full(len(rows), NONE)
        more = best != NONE
        if not more.all():
            out[rows[~more], : ids.shape[1]] = ids[~more]
            rows, ids, ranks, at, best = rows[more], ids[more], ranks[more], at[more], best[more]
            each = np.arange(len(rows))
        if not len(rows):
            break
        place = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, place + (place > at[:, None]), axis=1)
        ids[each, at] = best
        place = place[:-1]
        ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), axis=1)
        for shift in (-1, 0):  # the pairs on both sides of the new id
            ok = (at + shift >= 0) & (at + shift < ranks.shape[1])
            r, c = each[ok], at[ok] + shift
            ranks[r, c] = pairs.get(ids[r, c], ids[r, c + 1])
    return out


def merge_wide(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Ids of one long piece."""
    ranks = pairs.get(ids[:-1], ids[1:])
    while len(ranks) and (best := ranks.min()) != NONE:
        at = np.flatnonzero(ranks == best)
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]  # of places that overlap, every second
        before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
        before[1:][np.diff(at) == 2] = best
        after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
        new = np.full(len(at), best, np.int32)
        lower = np.minimum(pairs.get(before, new), pairs.get(new, after)) < best
        if lower.any():
            at = at[: int(lower.argmax()) + 1]
        stays = np.ones(len(ids), bool)
        stays[at + 1] = False
        ids[at] = best
        moved = np.cumsum(stays) - 1
        ranks = np.append(ranks, NONE)[stays][:-1]
        ids, at = ids[stays], moved[at]
        for c in (at[at > 0] - 1, at[at < len(ids) - 1]):
            ranks[c] = pairs.get(ids[c], ids[c + 1])
    return ids


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process, file and pattern."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def _runs(sizes: list[int], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _encoded(path: str, pattern: str, back: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for a, b in _runs(pc.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(a, b - a)
                flat, counts = words.encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat))
                decoded = [words.decode(ids).cast(pa.binary())] if back else []
                yield pa.RecordBatch.from_arrays([part.column(0), ids, *decoded], schema=schema)
        vec.tidy()

    return run


def _apply(docs: DataFrame, path: str, pattern: str, key: str, text: str, back: bool) -> DataFrame:
    thin = docs.select(F.col(key), text_or_empty(text).alias("text"))
    kind = docs.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("ids", pa.list_(pa.int32())), *[("decoded", pa.binary())] * back])
    return thin.mapInArrow(_encoded(path, pattern, back, schema), f"{key} {kind.simpleString()}, ids array<int>" + ", decoded binary" * back)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and ids (array of int) of every text."""
    return _apply(docs, path, pattern, key, text, False)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `encode`, with `decoded`: the bytes that the ids stand for, from the same pass over the texts."""
    return _apply(docs, path, pattern, key, text, True)


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key` and `decoded` (binary) of every list of ids."""
    kind = rows.schema[key].dataType
    schema = pa.schema([(key, to_arrow_type(kind)), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            for a, b in _runs([4 * (n or 0) for n in pc.list_value_length(batch.column(1)).to_pylist()]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), words.decode(part.column(1)).cast(pa.binary())], schema=schema)
        vec.tidy()

    return rows.select(F.col(key), F.col(ids).alias("ids")).mapInArrow(run, f"{key} {kind.simpleString()}, decoded binary")


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of `encode_and_decode`'s rows: how many ids, the sha256 of their decimals joined by commas, and that of the decoded bytes."""
    return rows.select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
