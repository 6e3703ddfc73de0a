"""Conversation and integrity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from .registry import query, table


@query("x14_item_confirmation", """WITH c AS (SELECT o_custkey AS query_id, 'item' || o_orderkey AS name, round(o_totalprice / 500000, 4) AS score, o_orderkey % 5 = 0 AS exact FROM orders),
p AS (SELECT query_id, list(name ORDER BY score DESC, name) FILTER (WHERE score >= 0.63 AND exact) AS e, list(name ORDER BY score DESC, name) FILTER (WHERE score >= 0.63) AS h, list(name ORDER BY score DESC, name) FILTER (WHERE score >= 0.60 AND score < 0.63) AS m, count(*) FILTER (WHERE score >= 0.63) AS n FROM c GROUP BY query_id)
SELECT query_id, CASE WHEN e IS NOT NULL OR n = 1 THEN 'confirmed' WHEN n > 1 OR m IS NOT NULL THEN 'options' ELSE 'none' END AS outcome,
 CASE WHEN e IS NOT NULL THEN e[1] WHEN n > 0 THEN array_to_string(h[1:3], ',') WHEN m IS NOT NULL THEN array_to_string(m[1:3], ',') ELSE '' END AS items FROM p""")
def item_confirmation(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return H.confirm(o.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("item"), F.col("o_orderkey")).alias("name"), F.round(F.col("o_totalprice") / 500000, 4).alias("score"), (F.col("o_orderkey") % 5 == 0).alias("exact")))


@query("w15_history_backfill", "WITH m AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'item' || turn END AS item FROM conversations) SELECT conv_id, turn, last_value(item IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled FROM m")
def history_backfill(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "conversations").select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.lit("item"), F.col("turn"))).alias("item"))
    return H.backfill(m).select("conv_id", "turn", "filled")


@query("a17_answer_metrics", """SELECT conv_id, turn, CAST(1.0 AS DOUBLE) AS behavior, CASE WHEN contains(lower(text), 'then') OR contains(lower(text), 'ouch') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety, CASE WHEN turn % 2 = 1 AND NOT regexp_matches(text, '\\[\\d+\\]') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS citation FROM conversations WHERE role = 'assistant'""")
def answer_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.text import citations

    c = table(spark, sf, "conversations").filter("role = 'assistant'")
    checks = H.answer_checks(F.col("text"), F.lit("answer"), F.array(F.lit("THEN"), F.lit("ouch")), citations(F.col("text")), F.col("turn") % 2 == 1)
    return c.select("conv_id", "turn", checks.alias("m")).select("conv_id", "turn", "m.behavior", "m.safety", "m.citation")


@query("j3_integrity", """SELECT 'lineitem.order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.unique', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'orders.customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'labels.document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def integrity(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.integrity import orphans, repeated, report

    t = lambda name: table(spark, sf, name)
    return report([
        ("lineitem.order", orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")), ("orders.unique", repeated(t("orders"), ["o_orderkey"])),
        ("orders.customer", orphans(t("orders"), "o_custkey", t("customer"), "c_custkey")), ("labels.document", orphans(t("labels"), "doc_id", t("documents"), "doc_id")),
    ])
