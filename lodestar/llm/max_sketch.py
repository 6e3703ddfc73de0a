"""Ranked lexical search with hashed max-sketches.

A first pass counts documents, terms and the document frequencies of the
queries' terms. The second reads the corpus in blocks: a document's impacts
(what each term adds to a score, before the query's weight) fold into a sketch
of one byte a coordinate, a term's coordinate being its hash; a coordinate holds the
largest impact folded into it, rounded up. Looking up the terms of all queries
in the sketches of a block and summing weight times level gives an upper bound
for every query and document. Per query, documents are then scored exactly in
falling order of their bounds, until the next bound is below the score of the
k-th best document that the task has found so far. A task returns at most k
documents a query; two rounds of ranking, first within groups of tasks, leave the k best of all.

A sketch has at least four coordinates for each distinct term of its document,
so bounds stay close at any length. Nothing is approximate: a document is left
out only if its bound proves that k others stand above it.

Defined cases: a null or empty text, or one without a term, is no document of
the statistics and is never returned; an item without a term that some
document holds gives no rows; rows of equal item id and text are one item; of
equal scores the smaller key comes first, a null key before all, and repeated
documents are ranked one by one. Very long texts are counted in runs; an empty
table on either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import vec
from .common import BROADCAST_BYTES, text_or_empty

BLOCK_BYTES = 1 << 22
#: Impacts lie below 10**6; a level stands for this much, so that 255 levels hold them all.
STEP = 3922
COORDINATES_A_TERM = 4
LEAST_WIDTH = 64
#: So many products are held at once while bounds are summed, and so many queries are bounded together.
PRODUCTS, QUERIES = 1 << 20, 2048
RESCORED = 64
#: Tasks whose results are ranked together in the first round.
TASKS = 1024

#: Terms are runs of ASCII letters and digits and of everything above U+007F, whose UTF-8 bytes all lie above 127; only A-Z are lowered.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def count_terms(text: str, limit: int = BLOCK_BYTES) -> Counter[bytes]:
    """How often each term stands in `text`."""
    raw = text.encode().translate(_TERM_BYTES)
    if len(raw) <= limit:
        return Counter(raw.split())
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + limit)
        end = len(raw) if end < 0 else end
        found.update(raw[at:end].split())
        at = end
    return found


@dataclass
class Items:
    """The queries of one pass: numbers of their distinct terms, one query after another."""

    ids: list
    terms: dict[bytes, int]
    members: np.ndarray
    starts: np.ndarray
    weights: np.ndarray | None = None
    hashes: np.ndarray | None = None

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        terms: dict[bytes, int] = {}
        members = [sorted({terms.setdefault(t, len(terms)) for t in count_terms(text)}) for _, text in rows]
        return cls([i for i, _ in rows], terms, *_chained(members))

    def weighted(self, n_docs: int, df: dict[int, int]) -> Items:
        """Only queries and terms that can score, with the terms' weights."""
        weight = np.zeros(len(self.terms), np.int64)
        for t, n in df.items():
            weight[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        members = [m for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True) for m in [self.members[a:b][weight[self.members[a:b]] > 0].tolist()]]
        some = [i for i, m in enumerate(members) if m]
        hashes = np.zeros(len(self.terms), np.int64)
        for t, k in self.terms.items():
            hashes[k] = zlib.crc32(t)
        return Items([self.ids[i] for i in some], self.terms, *_chained([members[i] for i in some]), weight, hashes)


def _chained(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x for m in lists for x in m], np.int64), np.cumsum([0, *map(len, lists)])


def _statistics(terms: dict[bytes, int]):
    """(-1, documents), (-2, terms) and (number of a query's term, documents that hold it) of a task's rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(terms), np.int64)
        n_docs = n_terms = 0
        known = terms.keys()
        for batch in batches:
            for text in batch.column(0):
                c = count_terms(text.as_py())
                n_docs += bool(c)
                n_terms += c.total()
                for t in c.keys() & known:
                    df[terms[t]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[[-1, -2], held]), pa.array(np.r_[[n_docs, n_terms], df[held]])], names=["term", "n"])
        vec.tidy()

    return count


class Block:
    """Sketches of some documents, and the impacts of the queries' terms in them."""

    def __init__(self, items: Items, n_docs: int, n_terms: int):
        self.items, self.n_docs, self.n_terms = items, n_docs, n_terms
        self.keys: list = []
        self.bytes = 0
        self.folded: list[tuple[np.ndarray, np.ndarray]] = []
        self.hit_keys: list[np.ndarray] = []
        self.hit_impacts: list[np.ndarray] = []

    def add(self, key, text: str) -> None:
        self.bytes += len(text)
        c = count_terms(text)
        if not c:
            return
        length = 10 + (90 * c.total() * self.n_docs) // self.n_terms
        impact = lambda tf: (1_000_000_000 * tf) // (1000 * tf + 8 * length)
        tf = np.fromiter(c.values(), np.int64, len(c))
        hashes = np.fromiter(map(zlib.crc32, c), np.int64, len(c))
        self.folded.append((hashes, -(-impact(tf) // STEP)))
        known = sorted((self.items.terms[t], c[t]) for t in c.keys() & self.items.terms.keys())
        terms, tf = (np.array(x, np.int64) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.int64),) * 2
        self.hit_keys.append(len(self.keys) * len(self.items.terms) + terms)
        self.hit_impacts.append(impact(tf))
        self.keys.append(key)

    def close(self) -> None:
        self.widths = np.array([max(LEAST_WIDTH, 1 << (COORDINATES_A_TERM * len(h) - 1).bit_length()) for h, _ in self.folded])
        self.sketches: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.widths).tolist():
            docs = np.flatnonzero(self.widths == width)
            sketch = np.zeros((len(docs), width), np.uint8)
            for row, d in enumerate(docs.tolist()):
                hashes, levels = self.folded[d]
                np.maximum.at(sketch[row], hashes & (width - 1), levels.astype(np.uint8))
            self.sketches[width] = docs, sketch
        self.folded.clear()
        self.hits, self.impacts = np.concatenate(self.hit_keys), np.concatenate(self.hit_impacts)

    def bounds(self, first: int, end: int) -> np.ndarray:
        """Upper bounds of the scores, documents by queries first to end."""
        own = self.items
        lo, hi = own.starts[first], own.starts[end]
        members, starts = own.members[lo:hi], own.starts[first:end] - lo
        out = np.zeros((len(self.keys), end - first), np.int64)
        for width, (docs, sketch) in self.sketches.items():
            at, weight = own.hashes[members] & (width - 1), own.weights[members]
            step = max(1, PRODUCTS // max(1, len(members)))
            for a in range(0, len(docs), step):
                out[docs[a : a + step]] = np.add.reduceat(sketch[a : a + step].take(at, axis=1) * weight, starts, axis=1) * STEP
        return out

    def exact(self, docs: np.ndarray, query: int) -> np.ndarray:
        own = self.items
        terms = own.members[own.starts[query] : own.starts[query + 1]]
        want = docs[:, None] * len(own.terms) + terms
        at = np.minimum(np.searchsorted(self.hits, want), max(0, len(self.hits) - 1))
        impact = np.where(self.hits[at] == want, self.impacts[at], 0) if len(self.hits) else np.zeros(want.shape, np.int64)
        return (impact * own.weights[terms]).sum(axis=1)


def _order(found: tuple) -> tuple:
    score, key = found
    return (-score, key is not None, key)


class Best:
    """The k best documents of each query so far, and the least score that can still enter."""

    def __init__(self, n: int, k: int):
        self.k, self.found, self.least = k, [[] for _ in range(n)], np.ones(n, np.int64)
        self.scored = 0

    def search(self, block: Block) -> None:
        for first in range(0, len(self.found), QUERIES):
            end = min(first + QUERIES, len(self.found))
            bounds = block.bounds(first, end)
            reached = bounds >= self.least[first:end]
            for q in np.flatnonzero(reached.any(axis=0)).tolist():
                docs = np.flatnonzero(reached[:, q])
                docs = docs[np.argsort(-bounds[docs, q], kind="stable")]
                self._rescore(block, first + q, docs, bounds[docs, q])

    def _rescore(self, block: Block, query: int, docs: np.ndarray, bounds: np.ndarray) -> None:
        for a in range(0, len(docs), RESCORED):
            if bounds[a] < self.least[query]:
                return
            some = docs[a : a + RESCORED]
            scores = block.exact(some, query)
            self.scored += len(some)
            enters = scores >= self.least[query]
            if enters.any():
                have = self.found[query] + [(s, block.keys[d]) for s, d in zip(scores[enters].tolist(), some[enters].tolist(), strict=True)]
                self.found[query] = have = sorted(have, key=_order)[: self.k]
                if len(have) == self.k:
                    self.least[query] = have[-1][0]


def _search(shared, n_docs: int, n_terms: int, k: int, kind: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        best, block = Best(len(items.ids), k), Block(items, n_docs, n_terms)

        def close(block: Block) -> Block:
            if block.keys:
                block.close()
                best.search(block)
            return Block(items, n_docs, n_terms)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                block.add(key.as_py(), text.as_py())
                if block.bytes >= BLOCK_BYTES:
                    block = close(block)
        close(block)
        rows = [(q, key, score) for q, found in enumerate(best.found) for score, key in found]
        if rows:
            q, keys, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(keys, kind), pa.array(scores, pa.int64())], names=["query", "key", "score"])
        vec.tidy()

    return search


def _top(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("key"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The `k` highest-scoring documents of each item: (item_key, rank, key, score).

    The size of the items is checked: those of more than BROADCAST_BYTES are
    taken in several parts, each with its own two passes over the corpus.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    thin = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    asked = items.select(F.col(item_key).alias("id"), text_or_empty(item_text).alias("text")).distinct()
    weight = asked.agg(F.coalesce(F.sum(F.octet_length("text") * 2 + 64), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-weight // BROADCAST_BYTES))
    out = spark.createDataFrame([], f"{item_key} {item_kind.simpleString()}, rank int, {key} {kind.simpleString()}, score long")
    for part in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).collect()
        own = Items.of([(x["id"], x["text"]) for x in rows])
        counts = {x["term"]: x["n"] for x in thin.select("text").mapInArrow(_statistics(own.terms), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, n_terms = counts.pop(-1, 0), counts.pop(-2, 0)
        own = own.weighted(n_docs, counts)
        if not own.ids:
            continue
        found = thin.mapInArrow(_search(spark.sparkContext.broadcast(own), n_docs, n_terms, k, to_arrow_type(kind)), f"query long, key {kind.simpleString()}, score long")
        found = _top(found.withColumn("_tasks", F.floor(F.spark_partition_id() / TASKS)), k, "query", "_tasks")
        best = _top(found.select("query", "key", "score"), k, "query")
        names = F.broadcast(spark.createDataFrame(list(enumerate(own.ids)), f"query long, id {item_kind.simpleString()}"))
        out = out.unionAll(best.join(names, "query").select(F.col("id").alias(item_key), "rank", F.col("key").alias(key), "score"))
    return out
