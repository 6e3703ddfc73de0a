"""Retrieval and answer metrics, attempts, baselines."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5, case: str = "case_id", item: str = "item_id") -> DataFrame:
    """(case, n_gold, recall, precision, mrr, ndcg) at k for gold units that name their items.

    `ranked` (case, item, rank) may repeat an item; the first occurrence counts
    for recall and gain, every one for precision. Precision divides by what was
    retrieved, not by k. One join on (case, item) and one aggregation.
    """
    unit = gold.select(case, item).distinct()
    want = unit.groupBy(case).agg(F.count("*").alias("n_gold"))
    head = ranked.filter(F.col("rank") <= k)
    met = head.join(unit.withColumn("hit", F.lit(True)), [case, item], "left")
    fresh = F.row_number().over(Window.partitionBy(case, item).orderBy("rank")) == 1
    met = met.withColumn("gain", F.when(F.col("hit") & fresh, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).withColumn("new", F.col("hit") & fresh)
    per = met.groupBy(case).agg(F.count("*").alias("n"), F.count_if("hit").alias("relevant"), F.count_if("new").alias("found"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum("gain").alias("dcg"))
    out = want.join(per, case, "left").fillna(0, ["n", "relevant", "found", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return out.select(
        case, "n_gold", F.round(F.col("found") / F.col("n_gold"), 6).alias("recall"), F.round(F.when(F.col("n") > 0, F.col("relevant") / F.col("n")).otherwise(0.0), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def matched(pairs: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, rank, unit): a largest matching of candidates to overlapping gold selectors, earliest ranks first.

    `pairs` (case, rank, unit) says which candidate satisfies which selector. A
    case is a small group by its nature (k candidates by a few selectors): its
    pairs are one row's arrays, and a batch of many cases goes to Python at once.
    """

    def one(ranks: list, units: list) -> list[int]:
        options: dict = {}
        for i, rank in enumerate(ranks):
            options.setdefault(rank, []).append(i)
        holder: dict = {}

        def place(rank, tried: set) -> bool:
            for i in options[rank]:
                unit = units[i]
                if unit not in tried:
                    tried.add(unit)
                    if unit not in holder or place(ranks[holder[unit]], tried):
                        holder[unit] = i
                        return True
            return False

        for rank in options:
            place(rank, set())
        return sorted(holder.values())

    @F.pandas_udf("array<int>")
    def chosen(ranks: pd.Series, units: pd.Series) -> pd.Series:
        return pd.Series([one(list(r), list(u)) for r, u in zip(ranks, units, strict=True)])

    cases = pairs.filter("rank IS NOT NULL AND unit IS NOT NULL").groupBy(case).agg(F.sort_array(F.collect_set(F.struct("rank", "unit"))).alias("_p"))
    met = cases.select(case, "_p", F.explode(chosen(F.col("_p.rank"), F.col("_p.unit"))).alias("_i"))
    return met.select(case, F.get("_p", F.col("_i"))["rank"].alias("rank"), F.get("_p", F.col("_i"))["unit"].alias("unit"))


def long_form(results: DataFrame, case: str, metrics: list[str]) -> DataFrame:
    """(case, metric, value) of the metrics that apply."""
    return results.unpivot(case, metrics, "metric", "value").filter(F.col("value").isNotNull())


def metric_means(values: DataFrame) -> DataFrame:
    return values.groupBy("metric").agg(F.round(F.avg("value") + 1e-9, 5).alias("mean"), F.count("*").alias("cases"))


def median_attempt(attempts: DataFrame, case: str, score: str, attempt: str) -> DataFrame:
    """The attempt in the middle by score (the upper one of an even number), and whether the scores differ too much."""
    w = Window.partitionBy(case)
    placed = attempts.withColumn("_at", F.row_number().over(w.orderBy(score, attempt))).withColumn("_n", F.count("*").over(w))
    placed = placed.withColumn("unstable", F.round(F.max(score).over(w) - F.min(score).over(w), 9) >= 0.2)
    return placed.filter(F.col("_at") == F.floor(F.col("_n") / 2) + 1).drop("_at", "_n")


def against_baseline(candidate: DataFrame, baseline: DataFrame, case: str) -> DataFrame:
    """(case, state): cases that one side lacks."""
    missing = baseline.select(case).join(candidate.select(case), case, "left_anti").withColumn("state", F.lit("missing"))
    return missing.union(candidate.select(case).join(baseline.select(case), case, "left_anti").withColumn("state", F.lit("added")))


def gate(candidate: Column, baseline: Column, relative: float) -> Column:
    """True unless the candidate exceeds the baseline by more than the share allowed."""
    return candidate <= baseline * (1 + relative)


Metric = Callable[[DataFrame], DataFrame]
