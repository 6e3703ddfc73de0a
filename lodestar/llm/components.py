"""Connected components of an edge table: forests within tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep

#: Edges that a task holds before it hands their forest on.
HELD_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of some edges but the smallest ones."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def flush() -> pa.RecordBatch:
        node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
        n += batch.num_rows
        if n >= HELD_EDGES:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that some edge (u, v) joins to a smaller one; label is the smallest node of its component.

    Each task first replaces its edges by a forest of depth one. Each round
    then is two aggregations and two joins over the edges, written to the
    shared folder; the number of rounds grows with the logarithm of the number
    of nodes. A node without a row is its own label.
    """
    local = edges.select("u", "v").mapInArrow(_forests, "u long, v long")
    current = keep(local.distinct(), "edges")
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x"))
    before = current.select(mark.alias("m")).first()["m"]
    while before["n"]:
        both = current.select(F.col("u").alias("x"), F.col("v").alias("y")).union(current.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(lowest.select("u", F.col("m").alias("v")))
        last, current = current, keep(small.distinct(), "edges")
        discard(last)
        now = current.select(mark.alias("m")).first()["m"]
        if now == before:
            break
        before = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("label"))
