"""Cost-balanced packing of token sequences.

A document is encoded once and cut into pieces of at most `capacity` ids.
Pieces go to blocks by a hash that includes the row's place in its task, so
that copies of a row spread over the blocks; inside a block, the estimated cost of a piece is
`linear * n + quadratic * n * n`, and pieces in descending order go to the
sequence with the lowest cost so far that still has room. A block opens just
as many sequences as its tokens need; a piece that fits nowhere is cut, so a
block pads less than one sequence in all.

Defined cases: a null text counts as empty and gives the end id alone;
repeated rows are packed one by one; a null doc_id is an ordinary value; an
empty table gives an empty result; other columns are not read. A very long
text becomes many full pieces, spread over all blocks.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import vec
from .common import bucket, pieces, text_or_empty

CAPACITY = 1024
END_ID = 0
BLOCK_PIECES = 4096
#: A run of this many characters with no white space, or of nothing else, goes to the slower encoder, whose time stays near linear there.
LONG_RUN = re.compile(r"\S{4096}|\s{4096}")


class Encoder:
    """Ids of a public byte-level BPE, each text's as the bytes of little-endian unsigned 32-bit numbers.

    `path` is a tokenizer file (.json); if a rank file of the same vocabulary
    (.tiktoken) lies beside it, texts are encoded with that, which gives the
    same ids about four times as fast. Texts that hold the string of an added
    token (which the tokenizer takes as that token, wherever it stands) go to
    the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = Path(path).with_suffix(".tiktoken")
        self.fast = None
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self.fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def one(self, text: str) -> bytes:
        if self.fast is None or any(x in text for x in self.added) or len(text) >= 4096 and LONG_RUN.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(x) for x in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _runs(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _cut(path: str, capacity: int, key_type: pa.DataType, schema: pa.Schema):
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in _runs(sizes):
                rows: list[tuple] = []
                keys, texts = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                for key, ids in zip(keys, encoder(path).encode(texts), strict=True):
                    ids += end
                    n, row = len(ids) // 4, row + 1
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        full = len(part) == 4 * capacity
                        rows.append((key, start, len(part) // 4, zlib.crc32(part), n, None if full else part, row))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        vec.tidy()

    return cut


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int]]:
    """Pack pieces: (piece, ids of it before this part, length of the part, sequence), parts of a sequence in the order in which they stand."""
    out: list[tuple[int, int, int, int]] = []
    n_full = int((lengths == capacity).sum())
    order = np.argsort(-lengths, kind="stable")
    for s, i in enumerate(order[:n_full].tolist()):
        out.append((i, 0, capacity, s))
    rest = order[n_full:]
    n = -(-int(lengths[rest].sum()) // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    for i in rest.tolist():
        done, left = 0, int(lengths[i])
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room == room.max())
            s = int(fits[np.argmin(cost[fits])])
            take = min(left, int(room[s]))
            out.append((i, done, take, n_full + s))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            done += take
            left -= take
    return out


def _pack(capacity: int, key: str):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        parts = assign(rows["length"].to_numpy(), capacity)
        at, done, take, seq = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        out = pd.DataFrame({key: rows[key].to_numpy()[at], "start": rows["start"].to_numpy()[at] + done, "length": take, "ids_crc32": rows["ids_crc32"].to_numpy()[at], "doc_tokens": rows["doc_tokens"].to_numpy()[at], "sequence_id": seq + (int(rows["block"].iloc[0]) << 24)})
        split = np.flatnonzero(take != rows["length"].to_numpy()[at])
        ids = rows["ids"]
        for j in split.tolist():
            out.loc[j, "ids_crc32"] = zlib.crc32(ids[at[j]][4 * done[j] : 4 * (done[j] + take[j])])
        out["offset"] = out.groupby("sequence_id")["length"].cumsum() - out["length"]
        return out

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where its ids lie in its document, and where in which sequence."""
    thin = docs.select(F.col(key), text_or_empty(text).alias("text"))
    total = thin.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = pieces(total["n"] + total["bytes"] // (2 * capacity), BLOCK_PIECES)
    key_type = docs.schema[key].dataType.simpleString()
    arrow_key = to_arrow_type(docs.schema[key].dataType)
    schema = pa.schema([(key, arrow_key), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("row", pa.int64())])
    cut = thin.mapInArrow(_cut(tokenizer_path, capacity, arrow_key, schema), f"{key} {key_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, row long")
    columns = f"{key} {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.withColumn("block", bucket(blocks, key, "start", "ids_crc32", "row")).groupBy("block").applyInPandas(_pack(capacity, key), columns)
