"""Queries of the evaluation gate, and of request limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gate as G
from ..operators import history as H
from ..streaming import limits
from .registry import query, table


@query("p17_selector_match", """WITH a AS (SELECT o_orderkey, o_custkey % 7 AS doc, o_orderkey % 5 AS s, o_custkey % 4 AS c FROM orders)
SELECT o_orderkey, CASE WHEN c = 3 THEN false ELSE (c = 1 OR doc = 2) AND (c <> 1 OR s IN (0, 1)) AND (c <> 2 OR s = 3) END AS fits FROM a""")
def selector_match(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sources: a document, a title under any heading marks, pages that contain the wanted ones; every fourth selector is empty."""
    fields = ["document_id", "title", "page_numbers"]
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("doc"), (F.col("o_orderkey") % 5).alias("s"), (F.col("o_custkey") % 4).alias("c"))
    actual = F.struct(F.concat(F.lit(" d"), F.col("doc").cast("string")).alias("document_id"), F.concat(F.lit("## t"), F.col("s").cast("string")).alias("title"), F.array(F.col("s"), F.col("s") + 1).alias("page_numbers"))
    wanted = F.struct(F.when(F.col("c").isin(0, 2), "d2").alias("document_id"), F.when(F.col("c") == 2, "# t3").alias("title"), F.when(F.col("c") == 1, F.array(F.lit(1).cast("long"))).alias("page_numbers"))
    return o.withColumn("actual", actual).withColumn("wanted", wanted).select("o_orderkey", G.selector_matches(F.col("actual"), F.col("wanted"), fields).alias("fits"))


@query("p18_aliases", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 2 = 0 ELSE o_orderkey % 2 = 0 END AS fits FROM orders")
def aliases(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", G.with_aliases(k % 2 == 0, k % 3 == 0, c % 2 == 0).alias("fits"))


@query("p19_core_suite", "SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id % 3 = 0")
def core_suite(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").filter("turn = 0")
    return G.suite(c.withColumn("ci_core", F.when(F.col("conv_id") % 3 == 0, True).when(F.col("conv_id") % 3 == 1, False)), "core").select("conv_id")


@query("f32_group_keys", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'web:http://h/' || doc_id ELSE 'document:' || coalesce(source, 'unknown') END AS document, CASE WHEN doc_id % 5 = 0 THEN 'web:http://h/' || doc_id ELSE 'section:' || coalesce(source, 'unknown') || ':' || coalesce(lang, 'unknown') END AS section,
 CASE WHEN doc_id % 5 = 0 THEN 'web:http://h/' || doc_id WHEN doc_id % 3 = 0 THEN 'g' || doc_id WHEN doc_id % 2 = 0 THEN 'evidence:' || coalesce(source, 'unknown') || ':' || coalesce('# ' || lang, 'unknown') || ':a|b' ELSE 'evidence:' || coalesce(source, 'unknown') || ':' || coalesce(lang, 'unknown') END AS evidence FROM documents""")
def group_keys(spark: SparkSession, sf: str) -> DataFrame:
    n, null = F.col("doc_id"), F.lit(None).cast("string")
    url = F.when(n % 5 == 0, F.concat(F.lit("http://h/"), n.cast("string")))
    blocks = F.when(n % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    key = lambda level: G.group_key(level, F.lit("local"), url, null, null, F.col("source"), F.concat(F.lit("# "), "lang"), F.when(n % 3 == 0, F.concat(F.lit("g"), n.cast("string"))), blocks).alias(level)
    return table(spark, sf, "documents").select("doc_id", key("document"), key("section"), key("evidence"))


@query("a23_pipeline_complete", """SELECT event_id, CAST(CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 0 WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN 0 WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS DOUBLE) AS complete FROM events""")
def pipeline_complete(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that need no retrieval, lack the rerank step, lack a channel that their plan needs, hold an error elsewhere, or failed calls."""
    n = F.col("event_id")
    ok = lambda name, lacks: F.struct(F.lit(name).alias("k"), F.when(~lacks, "ok").otherwise("skipped").alias("v"))
    no = F.lit(False)
    steps = F.array(ok("rrf", no), ok("rerank_node", n % 7 == 0), ok("search_embedding", no), ok("query_kg", n % 5 == 0), F.struct(F.lit("other").alias("k"), F.when(n % 13 == 0, "error").otherwise("ok").alias("v")))
    channels = F.create_map(F.lit("direct"), F.lit(True), F.lit("kg"), n % 2 == 0)
    done = G.pipeline_complete(n % 11 != 0, channels, F.lit("fallback"), F.map_from_entries(steps), F.when(n % 17 == 0, 1))
    return table(spark, sf, "events").select("event_id", done.alias("complete"))


@query("e3_eligibility", """SELECT user_id, CAST(CASE WHEN user_id % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 AND min(value) < 1 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 AND user_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 AND user_id % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN count(*) > 60 THEN 1 ELSE 0 END AS BIGINT) AS reasons FROM events GROUP BY user_id""")
def eligibility(spark: SparkSession, sf: str) -> DataFrame:
    """Users as runs; the number of reasons against each."""
    per = table(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    u = F.col("user_id")
    why = G.ineligible(
        F.when(u % 2 == 0, "full_pipeline").otherwise("recorded"), F.when(u % 3 != 0, "v1").otherwise("unversioned"), F.when(u % 5 != 0, 0.9), F.when(F.col("low") < 1, 0.5).otherwise(1.0), F.col("errors"),
        F.when(u % 7 != 0, "available"), F.lit("available"), u % 11 != 0, F.when(F.col("n") > 60, 1), F.lit(0),
    )
    return per.select("user_id", F.size(why).cast("long").alias("reasons"))


@query("e5_alias_faults", """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k AS case_id, CASE WHEN k % 7 = 0 THEN 'unknown case' WHEN k % 5 = 0 THEN 'alias pins no document and place' ELSE 'expected label is not in the case' END AS fault FROM a WHERE k % 7 = 0 OR k % 5 = 0 OR k % 3 = 0""")
def alias_faults(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    cases = o.filter(k % 7 != 0).select(k.alias("case_id"), F.array(F.lit("a"), F.lit("b")).alias("labels"))
    rows = o.select(k.alias("case_id"), F.when(k % 3 == 0, "c").otherwise("b").alias("expected"), F.lit("d").alias("document"), F.when(k % 5 != 0, "s").alias("place"))
    return G.alias_faults(rows, cases)


@query("a18_case_score", """SELECT c_custkey, CAST(round((CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END + 0.5 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 0.25 END) / CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END, 6) AS DOUBLE) AS score,
 concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'behavior' END, CASE WHEN c_custkey % 3 = 0 THEN 'recall' END) AS failed FROM customer""")
def case_score(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of the metrics that apply, and those that stay below their threshold or are missing."""
    k = F.col("c_custkey")
    m = F.struct(F.when(k % 4 == 0, 0.0).otherwise(1.0).alias("behavior"), F.lit(0.5).alias("facts"), F.when(k % 3 != 0, 0.25).alias("recall"))
    c = table(spark, sf, "customer").select("c_custkey", m.alias("m"))
    return c.select("c_custkey", G.case_score(F.col("m"), ["behavior", "facts", "recall"]).alias("score"), F.array_join(H.case_result(F.col("m"), {"behavior": 1.0, "facts": 0.5, "recall": 0.2}), ",").alias("failed"))


@query("e9_baseline_audit", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' ELSE 'changed' END AS which FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0")
def baseline_audit(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    now = o.filter("o_orderkey % 10 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_custkey")))
    return G.same_sequence(o, now, "o_orderkey", ["o_custkey", "o_orderpriority"])


@query("r4_rate_limit", """SELECT event_id, recent, recent <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 35999999999 PRECEDING AND CURRENT ROW) AS recent FROM events)""")
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """No more than three requests of a user within ten hours."""
    return limits.within_rate(table(spark, sf, "events"), "user_id", 3, 36000).select("event_id", "recent", "allowed")


@query("r6_traces", """WITH e AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'begin' WHEN 1 THEN 'finish' ELSE 'call' END AS kind, CAST(floor(value) AS BIGINT) AS tokens FROM events WHERE NOT (user_id % 3 = 0 AND event_id % 5 = 1) AND NOT (user_id % 7 = 0 AND event_id % 5 = 0))
SELECT user_id, count(*) FILTER (WHERE kind = 'call') AS calls, CAST(coalesce(sum(tokens) FILTER (WHERE kind = 'call'), 0) AS BIGINT) AS tokens, count(*) FILTER (WHERE kind = 'finish') > 0 AS complete FROM e GROUP BY user_id HAVING count(*) FILTER (WHERE kind = 'begin') > 0""")
def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Events as begin, call and finish of traces; some are never finished, some never begun."""
    n = F.col("event_id") % 5
    e = table(spark, sf, "events").filter(~((F.col("user_id") % 3 == 0) & (n == 1)) & ~((F.col("user_id") % 7 == 0) & (n == 0)))
    e = e.select("user_id", F.when(n == 0, "begin").when(n == 1, "finish").otherwise("call").alias("kind"), F.floor("value").alias("tokens"))
    return limits.traces(e, "user_id")
