"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows that must stay together (here: equal texts) form groups. Groups are dealt
into blocks of bounded size; each block is solved by differencing into a
partial partition of k sums, and the blocks' partial partitions are combined
the same way, level by level, until one is left. A level's input is k numbers
a block, so nothing but block summaries ever meets in one place.

Defined cases: a null text counts as empty (size 1) and is equal to an empty
one; repeated rows each get a slot of their own; a null doc_id is an ordinary
value; an empty table gives an empty result; other columns are not read. A
group larger than a shard's fair share stays whole, as groups are indivisible.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, if_small, keep, pieces, text_or_empty

BLOCK_GROUPS = 8192
FAN_IN = 512
SLOT_ROWS = 8192


def difference(loads: np.ndarray) -> np.ndarray:
    """Combine n partial partitions (rows of k sums) into one: returns for each row and column the column of the result it joins.

    The two partial partitions with the largest spread are merged again and
    again, the larger sums of one with the smaller sums of the other.
    """
    n, k = loads.shape
    order = np.argsort(-loads, axis=1, kind="stable")
    sums = [tuple(row) for row in np.take_along_axis(loads, order, axis=1).tolist()]
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joint = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        by = sorted(range(k), key=joint.__getitem__, reverse=True)
        sums[a] = sums[b] = ()
        sums.append(tuple(joint[j] for j in by))
        to = [0] * k
        for new, old in enumerate(by):
            to[old] = new
        merged.append((a, b, to))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    # place[node][j]: the final column of the node's j-th largest sum, from the last merge back to the leaves.
    place = np.zeros((len(sums), k), np.int16)
    place[-1] = np.arange(k)
    for at in range(len(merged) - 1, -1, -1):
        a, b, to = merged[at]
        whole = place[n + at][to]
        place[a], place[b] = whole, whole[::-1]
    out = np.empty((n, k), np.int16)
    np.put_along_axis(out, order, place[:n], axis=1)
    return out


def _solve_groups(k: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "group_key"], ascending=[False, True], kind="stable")
        loads = np.zeros((len(rows), k), np.int64)
        loads[:, 0] = rows["bytes"]
        return pd.DataFrame({"group_key": rows["group_key"], "block": rows["block"], "slot": difference(loads)[:, 0].astype(np.int32), "bytes": rows["bytes"]})

    return solve


def _solve_blocks(k: int):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        blocks, at = np.unique(rows["block"].to_numpy(), return_inverse=True)
        loads = np.zeros((len(blocks), k), np.int64)
        loads[at, rows["slot"]] = rows["bytes"]
        to = difference(loads)
        return pd.DataFrame({"block": np.repeat(blocks, k), "slot": np.tile(np.arange(k, dtype=np.int32), len(blocks)), "parent": int(rows["parent"].iloc[0]), "to": to.ravel().astype(np.int32), "bytes": loads.ravel()})

    return solve


def shard_of_groups(groups: DataFrame, shards: int = 16) -> DataFrame:
    """(group_key, shard) for distinct `groups` (group_key long, bytes long), sums of bytes near equal."""
    blocks = pieces(groups.count(), BLOCK_GROUPS)
    placed = keep(
        groups.withColumn("block", bucket(blocks, "group_key"))
        .groupBy("block").applyInPandas(_solve_groups(shards), "group_key long, block int, slot int, bytes long"), "blocks",
    )
    labels = placed.select("group_key", "block", "slot")
    sums = placed.groupBy("block", "slot").agg(F.sum("bytes").alias("bytes"))
    while blocks > 1:
        parents = pieces(blocks, FAN_IN)
        step = keep(
            sums.withColumn("parent", (F.col("block") % parents).cast("int"))
            .groupBy("parent").applyInPandas(_solve_blocks(shards), "block int, slot int, parent int, to int, bytes long"), "levels",
        )
        hop = if_small(step.select("block", "slot", "parent", "to"), 64, blocks * shards)
        labels = labels.join(hop, ["block", "slot"]).select("group_key", F.col("parent").alias("block"), F.col("to").alias("slot"))
        sums = step.groupBy(F.col("parent").alias("block"), F.col("to").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        blocks = parents
    return labels.select("group_key", F.col("slot").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of `docs` with its shard and its slot there, under the law `bytes`."""
    body = text_or_empty(text).cast("binary")
    thin = keep(
        docs.select(
            F.col(key), (F.octet_length(text_or_empty(text)) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
            F.xxhash64(text_or_empty(text)).alias("group_key"),
        ), "sizes",
    )
    n = thin.count()
    groups = thin.groupBy("group_key").agg(F.sum("size").alias("bytes"))
    placed = thin.join(shard_of_groups(keep(groups, "groups"), shards), "group_key")
    parts = pieces(n, shards * SLOT_ROWS)
    placed = keep(placed.withColumn("part", bucket(parts, F.col(key), F.col("text_crc32"), F.col("size"))), "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.col(key), "text_crc32")) - 1
    return (
        placed.withColumn("inside", inside)
        .join(if_small(starts, 48, shards * parts), ["shard", "part"])
        .select(
            F.col(key), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("start") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
