"""Budgets of model calls, checked before each call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import budgets as B
from .registry import query, table


@query("r5_budgets", """WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(event_id // 2 AS VARCHAR) AS call_id, ts, CAST(floor(value * 100) AS BIGINT) AS tokens, CAST(event_id % 50 AS BIGINT) AS cost FROM events),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY trace_id, call_id ORDER BY ts, tokens, cost) = 1), n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, call_id) AS rn FROM o),
r(trace_id, rn, call_id, ts, calls, tokens, cost, refused, a, b, d) AS (SELECT DISTINCT trace_id, CAST(0 AS BIGINT), '', CAST(NULL AS TIMESTAMP), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM n
  UNION ALL SELECT n.trace_id, n.rn, n.call_id, n.ts, r.a, r.b, r.d, CASE WHEN r.a >= 5 THEN 'calls' WHEN r.b >= 20000 THEN 'tokens' WHEN r.d >= 60 THEN 'cost' END,
   CASE WHEN r.a >= 5 OR r.b >= 20000 OR r.d >= 60 THEN r.a ELSE r.a + 1 END, CASE WHEN r.a >= 5 OR r.b >= 20000 OR r.d >= 60 THEN r.b ELSE r.b + n.tokens END, CASE WHEN r.a >= 5 OR r.b >= 20000 OR r.d >= 60 THEN r.d ELSE r.d + n.cost END
  FROM r JOIN n ON n.trace_id = r.trace_id AND n.rn = r.rn + 1)
SELECT trace_id, call_id, calls AS used_calls, tokens AS used_tokens, CAST(cost AS DOUBLE) AS used_cost, refused FROM r WHERE rn > 0""")
def budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model calls of their user, some ids twice; the SQL takes one call after another."""
    e = table(spark, sf, "events")
    calls = e.select(F.col("user_id").cast("string").alias("trace_id"), F.floor(F.col("event_id") / 2).cast("string").alias("call_id"), "ts", F.floor(F.col("value") * 100).alias("tokens"), (F.col("event_id") % 50).cast("double").alias("cost"))
    return B.checked(calls, B.Budget(5, 20_000, 60.0)).drop("ts")
