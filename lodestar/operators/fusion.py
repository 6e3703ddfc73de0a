"""Ranked channels and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each channel, the smoothing term and the length of the fused list.
WEIGHTS = {"direct": 1.0, "hyde": 0.9, "kg": 0.7}
SMOOTHING, TOP = 60, 20


def ranked(candidates: DataFrame, by: list[str], order: list[Column], top: int | None = None) -> DataFrame:
    """Number candidates within `by` from 1; with `top`, Spark keeps only so many per group before the shuffle."""
    out = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if top is None else out.filter(F.col("rank") <= top)


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row of each key."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_first", at).filter(F.col("_first") == 1).drop("_first")


def channel(candidates: DataFrame, name: str) -> DataFrame:
    return candidates.withColumn("channel", F.lit(name))


def weight_of(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        out = F.when(name == k, F.lit(float(w))).otherwise(out)
    return out


def reciprocal_rank_fusion(channels: DataFrame, group: str = "query_id", item: str = "item_id", weights: dict[str, float] = WEIGHTS, k: int = SMOOTHING, top: int = TOP) -> DataFrame:
    """Fuse (group, item, channel, rank) rows: the best rank of an item in each channel counts, weighted by 1 / (k + rank).

    Order: score, then best rank, then item. One aggregation with map-side
    combination; the window's group limit is pushed below its shuffle.
    """
    best = channels.groupBy(group, item, "channel").agg(F.min("rank").alias("rank"))
    fused = best.groupBy(group, item).agg(
        F.sum(weight_of(F.col("channel"), weights) / (F.lit(k) + F.col("rank"))).alias("rrf_score"),
        F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("channel")).alias("sources"),
    )
    out = ranked(fused, [group], [F.round("rrf_score", 12).desc(), F.col("best_rank"), F.col(item)], top)
    return out.select(group, item, F.round("rrf_score", 9).alias("rrf_score"), F.col("best_rank").cast("long").alias("best_rank"), F.array_join("sources", ",").alias("sources"), F.col("rank").cast("long").alias("fused_rank"))
