"""Answer queries: evidence, claims, budgets, inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import evidence as E
from ..operators import fusion
from .registry import query, table

_T = r"list_distinct(regexp_extract_all(lower(regexp_replace({0}, '\[[^\]]+\]', ' ', 'g')), '[A-Za-z][A-Za-z0-9_/-]+'))"


@query("a22_evidence_coverage", f"""WITH q AS (SELECT conv_id, turn, {_T.format('text')} AS t FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, {_T.format('text')} AS t FROM conversations WHERE role = 'assistant')
SELECT q.conv_id, q.turn, CAST(CASE WHEN len(q.t) = 0 THEN 0 ELSE round(len(list_intersect(q.t, a.t)) / len(q.t), 6) END AS DOUBLE) AS coverage FROM q JOIN a ON q.conv_id = a.conv_id AND q.turn = a.turn""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a question's terms the answer to it repeats."""
    c = table(spark, sf, "conversations")
    q = c.filter("role = 'user'").select("conv_id", "turn", T.terms(F.col("text")).alias("q"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), T.terms(F.col("text")).alias("a"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", T.coverage(F.col("q"), F.col("a")).alias("coverage"))


@query("f17_behavior", "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '没有足够依据|没有检索到足够|证据不足|不足以支持|无法回答|无法提供|不能提供|不具备|未找到|不确定') THEN 'refuse' WHEN regexp_matches(text, '请提供|请补充|您指的是|具体产品|具体型号') THEN 'clarify' ELSE 'answer' END AS behavior FROM conversations WHERE role = 'assistant'")
def behavior(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", T.behavior(F.col("text")).alias("behavior"))


@query("w9_context_budget", """WITH r AS (SELECT source, doc_id, CAST(sum(least(n_chars, 800)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM documents) SELECT source, doc_id, used FROM r WHERE used <= 12000""")
def budget(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "doc_id", F.least("n_chars", F.lit(800)).alias("chars"))
    return D.running_budget(d, "source", [F.col("doc_id")], "chars", 12000).select("source", "doc_id", "used")


_CLAIMS = rf"""c AS (SELECT conv_id AS query_id, turn AS position, text AS claim, [CAST(1 + turn % 2 AS INTEGER)] AS cited, {_T.format("regexp_replace(text, '\\[\\d+\\]', '', 'g')")} AS ct FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, text AS content, {_T.format('text')} AS et FROM conversations WHERE role = 'user' QUALIFY rank <= 6),
m AS (SELECT c.query_id, position, cited, rank, trim(content) <> '' AND len(ct) > 0 AND len(list_intersect(ct, et)) / len(ct) >= 0.08 AS ok FROM c LEFT JOIN e USING (query_id)),
b AS (SELECT query_id, position, any_value(cited) AS cited, min(rank) FILTER (WHERE ok) AS first, coalesce(list_sort(list(DISTINCT CAST(rank AS INTEGER)) FILTER (WHERE ok)), []) AS good FROM m GROUP BY query_id, position),
a AS (SELECT query_id, position, CASE WHEN len(list_intersect(cited, good)) = len(cited) THEN 'keep' WHEN len(list_intersect(cited, good)) > 0 THEN 'prune' WHEN first IS NOT NULL THEN 'rebind' ELSE 'remove' END AS action,
 CASE WHEN len(list_intersect(cited, good)) > 0 THEN list_intersect(cited, good)[1] ELSE CAST(first AS INTEGER) END AS bound FROM b)"""


def _bound(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as claims on their conversation's questions; texts without digits, so that terms alone decide."""
    c = table(spark, sf, "conversations")
    claims = c.filter("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("text").alias("claim"), F.array((1 + F.col("turn") % 2).cast("int")).alias("cited"))
    evidence = fusion.ranked(c.filter("role = 'user'").select(F.col("conv_id").alias("query_id"), "turn", F.col("text").alias("content")), ["query_id"], [F.col("turn")], 6)
    return E.bind_claims(claims, evidence.select("query_id", "rank", "content"))


@query("x10_claim_binding", f"WITH {_CLAIMS} SELECT query_id, position, action, bound FROM a")
def claim_binding(spark: SparkSession, sf: str) -> DataFrame:
    return _bound(spark, sf).select("query_id", "position", "action", F.get("bound", F.lit(0)).alias("bound"))


@query("p11_renumbered_citations", f"WITH {_CLAIMS}, f AS (SELECT query_id, bound, min(position) AS p FROM a WHERE bound IS NOT NULL GROUP BY ALL) SELECT query_id, bound AS cited, row_number() OVER (PARTITION BY query_id ORDER BY p, bound) AS number FROM f")
def renumbered(spark: SparkSession, sf: str) -> DataFrame:
    return E.renumbered(_bound(spark, sf))


@query("f13_citations", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\[(\d+)\]', 1)) AS BIGINT) AS n, CAST(length(regexp_replace(text, '\[\d+\]', '', 'g')) AS BIGINT) AS chars FROM documents")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.size(T.citations(t)).cast("long").alias("n"), F.length(T.without_citations(t)).cast("long").alias("chars"))


@query("g10_confidence", """WITH s AS (SELECT o_custkey AS query_id, list_sort(list(o_totalprice / 500000), 'DESC') AS p, count(*) AS n, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey),
v AS (SELECT query_id, n, kinds, round(greatest(0.0, least(1.0, (least(1.0, p[1] - coalesce(p[2], 0)) * 0.35 + least(1.0, n / 20) * 0.15 + kinds / 5 * 0.15 + 0.5 * 0.15 + least(1.0, p[1]) * 0.20) / 1.0)) + 1e-9, 6) AS confidence FROM s)
SELECT query_id, confidence, CASE WHEN n = 0 THEN 'empty_context' WHEN confidence < 0.46 THEN 'low_confidence' WHEN kinds / 5 < 0.5 THEN 'capability_not_covered' END AS refusal FROM v""")
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    n = o.groupBy(F.col("o_custkey").alias("query_id")).agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("kinds"))
    # The two best of each are found before they meet.
    top = fusion.ranked(o.select(F.col("o_custkey").alias("query_id"), (F.col("o_totalprice") / 500000).alias("x")), ["query_id"], [F.desc("x")], 2)
    p = top.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "x"))), lambda r: r["x"]).alias("p"))
    s = n.join(p, "query_id")
    first, second = F.get("p", F.lit(0)), F.coalesce(F.get("p", F.lit(1)), F.lit(0.0))
    c = E.confidence([first - second, F.col("n") / 20, F.col("kinds") / 5, F.lit(0.5), first])
    s = s.withColumn("confidence", c)
    return s.select("query_id", "confidence", E.refusal(F.col("n"), F.lit("decided"), F.col("confidence"), F.col("kinds") / 5).alias("refusal"))


@query("x15_retrieval_plan", """WITH q AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'business_qa' WHEN 1 THEN 'freshness' ELSE 'prompt_injection' END AS intent FROM conversations)
SELECT intent, intent <> 'freshness' AS hyde, false AS kg, CASE intent WHEN 'freshness' THEN 'required' WHEN 'prompt_injection' THEN 'disabled' ELSE 'fallback' END AS web, count(*) AS n FROM q GROUP BY ALL""")
def plans(spark: SparkSession, sf: str) -> DataFrame:
    intent = F.when(F.col("turn") % 3 == 0, "business_qa").when(F.col("turn") % 3 == 1, "freshness").otherwise("prompt_injection")
    p = table(spark, sf, "conversations").withColumn("intent", intent)
    p = p.select("intent", E.plan(F.coalesce("text", F.lit("")), F.col("intent"), F.lit(True)).alias("plan"))
    return p.groupBy("intent", "plan.channels.hyde", "plan.channels.kg", "plan.channels.web").agg(F.count("*").alias("n"))


@query("w14_rank_reconciliation", """WITH b AS (SELECT o_custkey AS query_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS input_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS raw_rank FROM orders)
SELECT query_id, item_id, input_rank, raw_rank, CASE WHEN raw_rank > 6 THEN 'cut' WHEN raw_rank < input_rank THEN 'promoted' WHEN raw_rank > input_rank THEN 'demoted' ELSE 'unchanged' END AS decision FROM b""")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), "o_totalprice")
    r = fusion.ranked(o, ["query_id"], [F.col("item_id")]).withColumnRenamed("rank", "input_rank")
    r = fusion.ranked(r, ["query_id"], [F.desc("o_totalprice"), F.col("item_id")]).withColumnRenamed("rank", "raw_rank")
    a, b = F.col("input_rank"), F.col("raw_rank")
    decision = F.when(b > 6, "cut").when(b < a, "promoted").when(b > a, "demoted").otherwise("unchanged")
    return r.select("query_id", "item_id", a.cast("long").alias("input_rank"), b.cast("long").alias("raw_rank"), decision.alias("decision"))


@query("p8_web_gate", f"""WITH t AS (SELECT conv_id, turn, role, {_T.format('text')} AS t FROM conversations), q AS (SELECT conv_id, t FROM t WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
a AS (SELECT conv_id, t FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3), e AS (SELECT conv_id, list_distinct(flatten(list(t))) AS t, count(*) AS n FROM a GROUP BY conv_id)
SELECT q.conv_id, coalesce(e.n, 0) AS local, NOT (coalesce(e.n, 0) >= 2 AND coalesce(CASE WHEN len(q.t) = 0 THEN 0 ELSE round(len(list_intersect(q.t, e.t)) / len(q.t), 6) END, 0) >= 0.25) AS search_web FROM q LEFT JOIN e USING (conv_id)""")
def web_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Search the web unless there are two local results or more that cover a quarter of the question."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", T.terms(F.col("text")).alias("t"))
    q = fusion.first_of(c.filter("role = 'user'"), ["conv_id"], [F.desc("turn")]).select("conv_id", F.col("t").alias("q"))
    e = fusion.ranked(c.filter("role = 'assistant'"), ["conv_id"], [F.asc("turn")], 3).groupBy("conv_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("e"), F.count("*").alias("n"))
    met = q.join(e, "conv_id", "left")
    enough = (F.coalesce("n", F.lit(0)) >= 2) & (F.coalesce(T.coverage(F.col("q"), F.col("e")), F.lit(0.0)) >= 0.25)
    return met.select("conv_id", F.coalesce("n", F.lit(0)).alias("local"), (~enough).alias("search_web"))
