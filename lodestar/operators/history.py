"""Conversation state: item confirmation, history backfill, answer checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import ranked

#: Scores of a sure and of a possible item, how many options are offered.
HIGH, MID, OPTIONS = 0.63, 0.60, 3


def confirm(candidates: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, outcome, items) from (group, name, score, exact): one sure exact name, one sure name, options among sure ones, options among possible ones, none."""
    kind = F.when((F.col("score") >= HIGH) & F.col("exact"), "e").when(F.col("score") >= HIGH, "h").when(F.col("score") >= MID, "m")
    known = candidates.select(group, "name", "score", kind.alias("_kind"))
    # Three of each kind are enough for every list; how many sure ones there are is counted apart.
    head = ranked(known.filter("_kind IS NOT NULL"), [group, "_kind"], [F.desc("score"), F.col("name")], OPTIONS)
    names = lambda cond: F.slice(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct((-F.col("score")).alias("s"), F.col("name"))))), lambda x: x["name"]), 1, OPTIONS)
    k = F.col("_kind")
    lists = head.groupBy(group).agg(names(k == "e").alias("e"), names(k != "m").alias("h"), names(k == "m").alias("m"))
    counts = known.groupBy(group).agg(F.count_if(k.isin("e", "h")).alias("n_high"))
    none = F.array().cast("array<string>")
    per = counts.join(lists, group, "left").select(group, "n_high", *(F.coalesce(c, none).alias(c) for c in ("e", "h", "m")))
    outcome = F.when(F.size("e") > 0, "confirmed").when(F.col("n_high") == 1, "confirmed").when(F.col("n_high") > 1, "options").when(F.size("m") > 0, "options").otherwise("none")
    items = F.when(F.size("e") > 0, F.slice("e", 1, 1)).when(F.size("h") > 0, F.col("h")).otherwise(F.col("m"))
    return per.select(group, outcome.alias("outcome"), F.array_join(items, ",").alias("items"))


def backfill(messages: DataFrame, group: str = "conv_id", steps: int = 3) -> DataFrame:
    """Messages without an item take that of the latest one with an item, at most `steps` messages back."""
    w = Window.partitionBy(group).orderBy("turn")
    near = w.rowsBetween(-steps, 0)
    return messages.withColumn("filled", F.last("item", ignorenulls=True).over(near))


def answer_checks(answer: Column, expected: Column, forbidden: Column, cited: Column, requires_citation: Column) -> Column:
    """Behaviour, safety and citation of an answer, each 0 or 1."""
    safe = ~F.exists(forbidden, lambda x: F.contains(F.lower(answer), F.lower(x)))
    return F.struct((T.behavior(answer) == expected).cast("double").alias("behavior"), safe.cast("double").alias("safety"), F.when(requires_citation, (F.size(cited) > 0).cast("double")).otherwise(F.lit(1.0)).alias("citation"))


def case_result(metrics: Column, thresholds: dict[str, float]) -> Column:
    """Names of the metrics that stay below their threshold, or are missing."""
    low = [F.when(F.coalesce(metrics[name] < value, F.lit(True)), F.lit(name)) for name, value in thresholds.items()]
    return F.array_compact(F.array(*low))
