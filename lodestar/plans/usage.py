"""Accounting queries over model calls, which are derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from .registry import query, table

_CALLS_SQL = """
calls AS (SELECT event_id, user_id AS trace_id, event_type AS operation, CASE WHEN event_id % 11 = 0 THEN 'other' ELSE 'flash' END AS model,
  CAST(floor(value * 3000) AS BIGINT) AS input_tokens, CAST(floor(value * 7) AS BIGINT) AS output_tokens, event_id % 5 = 0 AS estimated, CASE WHEN event_type = 'error' THEN 'failed' END AS error, round(value, 2) AS latency_ms FROM events),
tier(model, max_input, i, o) AS (VALUES ('flash', 128000, 0.15, 1.5), ('flash', 256000, 0.6, 6.0), ('flash', 1000000, 1.2, 12.0)),
priced AS (SELECT c.*, (SELECT min(max_input) FROM tier t WHERE t.model = c.model AND t.max_input >= c.input_tokens) AS m FROM calls c),
full_price AS (SELECT p.* EXCLUDE (m), CAST(CASE WHEN t.model IS NULL THEN 0 ELSE round((input_tokens * t.i + output_tokens * t.o) / 1000000.0, 10) END AS DOUBLE) AS cost,
  CASE WHEN t.model IS NULL THEN 'unavailable' ELSE 'available' END AS cost_status FROM priced p LEFT JOIN tier t ON t.model = p.model AND t.max_input = p.m)
"""


def model_calls(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("user_id").alias("trace_id"), F.col("event_type").alias("operation"), F.when(F.col("event_id") % 11 == 0, "other").otherwise("flash").alias("model"),
        F.floor(F.col("value") * 3000).cast("long").alias("input_tokens"), F.floor(F.col("value") * 7).cast("long").alias("output_tokens"), (F.col("event_id") % 5 == 0).alias("estimated"),
        F.when(F.col("event_type") == "error", "failed").alias("error"), F.round("value", 2).alias("latency_ms"),
    )


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame([("flash", *t) for t in usage.TIERS], "model string, max_input long, input_rate double, output_rate double")
    return usage.priced(model_calls(spark, sf), prices)


@query("j14_tiered_price", f"WITH {_CALLS_SQL} SELECT event_id, model, input_tokens, output_tokens, round(cost, 9) AS cost, cost_status FROM full_price")
def tiered_price(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).select("event_id", "model", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"), "cost_status")


_SUM = """count(*) AS call_count, count(error) AS failed_call_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens,
  count(*) FILTER (WHERE estimated) AS estimated_token_count, round(sum(cost), 9) AS cost, round(sum(latency_ms), 3) AS latency_ms, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
  CASE WHEN bool_and(cost_status = 'available') THEN 'available' ELSE 'unavailable' END AS cost_status"""


@query("a9_usage_by_operation", f"WITH {_CALLS_SQL} SELECT trace_id, operation, {_SUM} FROM full_price GROUP BY trace_id, operation")
def usage_by_operation(spark: SparkSession, sf: str) -> DataFrame:
    return usage.summed(_priced(spark, sf), ["trace_id", "operation"])


@query("a9_usage_by_trace", f"WITH {_CALLS_SQL} SELECT trace_id, {_SUM} FROM full_price GROUP BY trace_id")
def usage_by_trace(spark: SparkSession, sf: str) -> DataFrame:
    return usage.summed(_priced(spark, sf), ["trace_id"])


@query("a10_complete_usage", f"""WITH {_CALLS_SQL}, v AS (SELECT trace_id, input_tokens, output_tokens, input_tokens + output_tokens + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS total_tokens, latency_ms FROM calls)
SELECT trace_id, count(*) AS n, count(*) FILTER (WHERE total_tokens = input_tokens + output_tokens) AS valid, bool_and(total_tokens = input_tokens + output_tokens) AS complete,
 CAST(coalesce(sum(total_tokens) FILTER (WHERE total_tokens = input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens FROM v GROUP BY trace_id""")
def complete_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over the records that can be trusted; a trace is complete if all of its records can."""
    v = model_calls(spark, sf).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0))
    ok = usage.complete(*(F.col(c).cast("double") for c in ("total_tokens", "input_tokens", "output_tokens")), [F.col("latency_ms")])
    v = v.withColumn("ok", ok)
    return v.groupBy("trace_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"), F.min("ok").alias("complete"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("total_tokens"))), F.lit(0)).cast("long").alias("total_tokens"))


@query("a13_latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("g14_token_estimate", "SELECT doc_id, greatest(1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT)) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", usage.estimated_tokens(F.length(F.coalesce("text", F.lit(""))), 1).alias("tokens"))


@query("s_windowed_usage", "SELECT date_trunc('hour', ts) AS start, event_type AS operation, count(*) AS calls, CAST(sum(CAST(floor(value * 3000) AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def windowed_usage(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming.usage_stream import windowed

    e = table(spark, sf, "events")
    return windowed(e.select("ts", F.col("event_type").alias("operation"), F.floor(F.col("value") * 3000).cast("long").alias("tokens")))
