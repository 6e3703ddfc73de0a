"""Evaluation queries: orders' parts as candidates, returned parts as gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, fusion
from .registry import query, table

_E = """
li AS (SELECT o_custkey AS case_id, l_partkey AS item_id, l_extendedprice AS price, l_returnflag AS flag, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ranked AS (SELECT case_id, item_id, row_number() OVER (PARTITION BY case_id ORDER BY price DESC, l_orderkey, l_linenumber) AS rank FROM li QUALIFY rank <= 10),
gold AS (SELECT DISTINCT case_id, item_id FROM li WHERE flag = 'R'), want AS (SELECT case_id, count(*) AS n_gold FROM gold GROUP BY case_id),
met AS (SELECT r.case_id, rank, g.item_id IS NOT NULL AS hit, row_number() OVER (PARTITION BY r.case_id, r.item_id ORDER BY rank) = 1 AS fresh FROM ranked r LEFT JOIN gold g ON r.case_id = g.case_id AND r.item_id = g.item_id WHERE rank <= 5),
per AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE hit) AS relevant, count(*) FILTER (WHERE hit AND fresh) AS found, min(rank) FILTER (WHERE hit) AS first, sum(CASE WHEN hit AND fresh THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM met GROUP BY case_id),
m AS (SELECT want.case_id, n_gold, round(coalesce(found, 0) / n_gold, 6) AS recall, round(coalesce(relevant / n, 0.0), 6) AS "precision", round(coalesce(1 / first, 0.0), 6) AS mrr,
 round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_gold, 5) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM want LEFT JOIN per USING (case_id))
"""


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("case_id"), F.col("l_partkey").alias("item_id"), "l_extendedprice", "l_returnflag", "l_orderkey", "l_linenumber")
    ranked = fusion.ranked(rows, ["case_id"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10).select("case_id", "item_id", "rank")
    return ranked, rows.filter("l_returnflag = 'R'").select("case_id", "item_id").distinct()


@query("a15_retrieval_metrics", f"WITH {_E} SELECT * FROM m")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.retrieval_metrics(*_candidates(spark, sf))


@query("a11_metric_means", f"""WITH {_E} SELECT metric, round(avg(value) + 1e-9, 5) AS mean, count(*) AS cases FROM (UNPIVOT (SELECT case_id, recall, "precision", mrr, ndcg FROM m) ON recall, "precision", mrr, ndcg INTO NAME metric VALUE value) GROUP BY metric""")
def metric_means(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluation.retrieval_metrics(*_candidates(spark, sf))
    return evaluation.metric_means(evaluation.long_form(m, "case_id", ["recall", "precision", "mrr", "ndcg"]))


@query("a12_pass_rate", f"""WITH {_E} SELECT n_gold, count(*) AS cases, count(*) FILTER (WHERE recall >= 0.2 AND mrr >= 0.25) AS passed, round(count(*) FILTER (WHERE recall >= 0.2 AND mrr >= 0.25) / count(*), 6) AS pass_rate FROM m GROUP BY n_gold""")
def pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    ok = (F.col("recall") >= 0.2) & (F.col("mrr") >= 0.25)
    m = evaluation.retrieval_metrics(*_candidates(spark, sf))
    return m.groupBy("n_gold").agg(F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.round(F.count_if(ok) / F.count("*"), 6).alias("pass_rate"))


@query("j16_gold_matching", f"""WITH {_E} SELECT case_id, count(*) AS matched FROM (SELECT DISTINCT r.case_id, r.item_id FROM ranked r JOIN gold g ON r.case_id = g.case_id AND r.item_id = g.item_id) GROUP BY case_id""")
def gold_matching(spark: SparkSession, sf: str) -> DataFrame:
    """The size of a largest matching; with selectors that name one item each it is the number of items found."""
    ranked, gold = _candidates(spark, sf)
    pairs = ranked.join(gold, ["case_id", "item_id"]).select("case_id", "rank", F.col("item_id").alias("unit"))
    return evaluation.matched(pairs).groupBy("case_id").agg(F.count("*").alias("matched"))


@query("a14_median_attempt", """WITH a AS (SELECT user_id AS case_id, event_id AS attempt, round(value / 100, 4) AS score FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score, attempt) AS pos, count(*) OVER (PARTITION BY case_id) AS n, max(score) OVER (PARTITION BY case_id) - min(score) OVER (PARTITION BY case_id) AS spread FROM a)
SELECT case_id, attempt, score, round(spread, 9) >= 0.2 AS unstable FROM p WHERE pos = n // 2 + 1""")
def median_attempt(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("attempt"), F.round(F.col("value") / 100, 4).alias("score"))
    return evaluation.median_attempt(a, "case_id", "score", "attempt")


@query("j17_baseline_cases", """WITH c AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'), b AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01')
SELECT case_id, 'missing' AS state FROM b WHERE case_id NOT IN (SELECT case_id FROM c) UNION ALL SELECT case_id, 'added' FROM c WHERE case_id NOT IN (SELECT case_id FROM b)""")
def baseline_cases(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderdate")
    late = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")
    return evaluation.against_baseline(o.filter(late).select("case_id").distinct(), o.filter(~late).select("case_id").distinct(), "case_id")


@query("a16_grouped_metrics", f"""WITH {_E}, r2 AS (SELECT case_id, item_id // 10 AS item_id, min(rank) AS rank FROM ranked GROUP BY ALL), r3 AS (SELECT case_id, item_id, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS rank FROM r2),
g2 AS (SELECT DISTINCT case_id, item_id // 10 AS item_id FROM gold), w2 AS (SELECT case_id, count(*) AS n_gold FROM g2 GROUP BY case_id),
h AS (SELECT r3.case_id, count(*) AS n, count(g2.item_id) AS found, min(rank) FILTER (WHERE g2.item_id IS NOT NULL) AS first FROM r3 LEFT JOIN g2 ON r3.case_id = g2.case_id AND r3.item_id = g2.item_id WHERE rank <= 5 GROUP BY r3.case_id)
SELECT case_id, n_gold, round(coalesce(found, 0) / n_gold, 6) AS recall, round(coalesce(found / n, 0.0), 6) AS "precision", round(coalesce(1 / first, 0.0), 6) AS mrr FROM w2 LEFT JOIN h USING (case_id)""")
def grouped_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics at group level: candidates take their group's first rank, groups are numbered anew."""
    ranked, gold = _candidates(spark, sf)
    group = F.floor(F.col("item_id") / 10).cast("long")
    r = ranked.groupBy("case_id", group.alias("item_id")).agg(F.min("rank").alias("first"))
    r = fusion.ranked(r, ["case_id"], [F.col("first")]).select("case_id", "item_id", "rank")
    return evaluation.retrieval_metrics(r, gold.select("case_id", group.alias("item_id"))).drop("ndcg")
