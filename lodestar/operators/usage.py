"""Token usage, latency and tiered cost of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sized import if_small

# Price tiers per million tokens (largest input, input price, output price).
TIERS = ((128_000, 0.15, 1.5), (256_000, 0.6, 6.0), (1_000_000, 1.2, 12.0))
CURRENCY = "CNY"


def estimated_tokens(text_chars: Column, least: int = 0) -> Column:
    """A quarter of the characters, rounded up."""
    return F.greatest(F.lit(least), F.ceil(text_chars / 4)).cast("long")


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with the first tier of its model that holds its input; none: unavailable, at no cost.

    `prices` (model, max_input, input_rate, output_rate) is a price list, a
    handful of rows per model. It is folded to one array per model, so a call
    meets one row instead of a range of tiers.
    """
    book = prices.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("max_input", "input_rate", "output_rate"))).alias("tiers"))
    met = calls.join(if_small(book, 512), "model", "left")
    met = met.withColumn("tier", F.get(F.filter("tiers", lambda t: t["max_input"] >= F.col("input_tokens")), F.lit(0))).drop("tiers")
    cost = (F.col("input_tokens") * F.col("tier.input_rate") + F.col("output_tokens") * F.col("tier.output_rate")) / 1_000_000
    return met.withColumn("cost", F.when(F.col("tier").isNull(), F.lit(0.0)).otherwise(F.round(cost, 10))).withColumn("cost_status", F.when(F.col("tier").isNull(), "unavailable").otherwise("available"))


def summed(calls: DataFrame, by: list[str]) -> DataFrame:
    """Usage per group: counts, tokens, cost, latency, and the states that hold only if they hold for all calls."""
    return calls.groupBy(*by).agg(
        F.count("*").alias("call_count"), F.count_if(F.col("error").isNotNull()).alias("failed_call_count"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count_if("estimated").alias("estimated_token_count"), F.round(F.sum("cost"), 9).alias("cost"),
        F.round(F.sum("latency_ms"), 3).alias("latency_ms"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.when(F.min(F.col("cost_status") == "available"), "available").otherwise("unavailable").alias("cost_status"),
    )


def complete(total: Column, inp: Column, out: Column, others: list[Column]) -> Column:
    """True if the record can be trusted: whole numbers that are not negative, add up, and nothing missing or infinite."""
    whole = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (c >= 0) & (F.floor(c) == c)
    ok = whole(total) & whole(inp) & whole(out) & (total == inp + out)
    for c in others:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (c >= 0)
    return F.coalesce(ok, F.lit(False))
