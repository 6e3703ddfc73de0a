"""Small functions at work on whole tables: filters of items, structure that evidence has, fingerprints of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access as A
from ..operators import evidence as E
from ..operators import rows as R
from .registry import query, table


@query("p4_combined_filters", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars > 500 AND source IS NOT NULL UNION ALL SELECT -doc_id - 1 FROM documents WHERE n_chars > 5000")
def combined_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Filters that are there, all of them; names that are blank restrict nothing."""
    d = table(spark, sf, "documents")
    some = d.filter(R.combined(A.one_of("lang", [" en", "de ", ""]), None, F.col("n_chars") > 500, F.col("source").isNotNull())).select("doc_id")
    return some.unionAll(d.filter(R.combined(A.one_of("lang", ["", "  "]), F.col("n_chars") > 5000)).select(-F.col("doc_id") - 1))


@query("g9_structure_match", """WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS wt, doc_id % 4 < 2 AND doc_id % 5 > 0 AS wi, contains(coalesce(text, ''), '!') AS ht, length(coalesce(text, '')) % 2 = 0 AS hi, n_chars % 7 / 6.0 AS c FROM documents)
SELECT doc_id, round(CAST(CASE WHEN wt AND ht OR wi AND hi THEN 1.0 WHEN wt OR wi THEN 0.0 ELSE least(1.0, c * 1.5) END AS DOUBLE), 6) AS score FROM d""")
def structure_match(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    made = E.structure_match(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 4 < 2) & (F.col("doc_id") % 5 > 0), F.contains(text, F.lit("!")), F.length(text) % 2 == 0, F.col("n_chars") % 7 / 6.0)
    return d.select("doc_id", F.round(made.cast("double"), 6).alias("score"))


@query("g26_plan_fingerprints", """WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '"intent":"' || lang || '",' END || '"web":' || CASE WHEN n_chars > 900 THEN 'true' ELSE 'false' END || ',"top":' || (n_chars % 5) AS j FROM documents) SELECT doc_id, sha256('{' || j || '}') AS fingerprint FROM d""")
def plan_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    plan = F.struct(F.col("lang").alias("intent"), (F.col("n_chars") > 900).alias("web"), (F.col("n_chars") % 5).alias("top"))
    return d.select("doc_id", E.with_fingerprint(plan).alias("fingerprint"))
