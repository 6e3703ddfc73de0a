"""Replay queries: calibrations over recorded scores, fingerprints of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import replay as R
from .registry import query, table

SETTINGS = [R.Calibration("usual"), R.Calibration("steep", -3.0, 0.05), R.Calibration("trusting", -1.8, 0.9, (0.1, 0.7, 0.1, 0.1)), R.Calibration("flat", -1.8, -40.0, (1.0, 0.0, 0.0, 0.0))]


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as candidates of their customer; those of one year and clerk group are one piece of evidence, some have no raw score."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 17 > 0, F.col("o_totalprice") / 50000.0 - 6.0).alias("raw"),
        F.when(F.col("o_orderpriority").startswith("1"), 1.0).when(F.col("o_orderpriority").startswith("2"), 0.45).alias("authority"), F.when(F.col("o_orderkey") % 3 == 0, 1.0).alias("structure"),
        F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.4).alias("freshness"), (F.col("o_orderkey") % 4).alias("group_id"), F.col("o_orderstatus").alias("source"), (F.col("o_orderkey") % 5 == 0).alias("relevant"),
    )


def _score(x: R.Calibration) -> str:
    a, b, c, d = x.weights
    cal = f"CASE WHEN raw IS NULL THEN 0.5 ELSE round(1 / (1 + exp(greatest(-60.0, least(60.0, -(raw - ({x.center})) / {max(abs(x.scale), 1e-6)})))), 6) END"
    return f"SELECT '{x.name}' AS name, *, {cal} AS cal, CAST(round(CAST({cal} AS DOUBLE) * {a}::DOUBLE + coalesce(authority, 1.0)::DOUBLE * {b}::DOUBLE + coalesce(structure, 0.0)::DOUBLE * {c}::DOUBLE + freshness::DOUBLE * {d}::DOUBLE + 1e-9, 6) AS DOUBLE) AS score FROM c"


_AUDIT = f"""WITH c AS (SELECT o_custkey AS case_id, o_orderkey AS candidate_id, CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice / 50000.0 - 6.0 END AS raw, CASE WHEN o_orderpriority LIKE '1%' THEN 1.0 WHEN o_orderpriority LIKE '2%' THEN 0.45 END AS authority,
 CASE WHEN o_orderkey % 3 = 0 THEN 1.0 END AS structure, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.4 END AS freshness, o_orderkey % 4 AS group_id, o_orderstatus AS source, o_orderkey % 5 = 0 AS relevant FROM orders),
s AS ({" UNION ALL ".join(map(_score, SETTINGS))}), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name, case_id, group_id ORDER BY score DESC, cal DESC, candidate_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY name, case_id ORDER BY score DESC, cal DESC, group_id) AS rank, count(*) OVER (PARTITION BY name, case_id) AS groups, lead(score) OVER (PARTITION BY name, case_id ORDER BY score DESC, cal DESC, group_id) AS next FROM b),
f AS (SELECT case_id, group_id AS first_group, source AS first_source FROM c QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY raw DESC NULLS LAST, candidate_id) = 1),
n AS (SELECT case_id, count(raw) AS scores, round(avg(raw), 6) AS mean FROM c GROUP BY case_id),
a AS (SELECT name, r.case_id, scores, mean, first_source, source AS top_source, group_id AS top_group, groups, round(score - coalesce(next, 0), 6) AS margin, relevant, group_id <> first_group AS moved FROM r JOIN f USING (case_id) JOIN n USING (case_id) WHERE rank = 1)"""


@query("e7_calibration_audit", f"{_AUDIT} SELECT * FROM a")
def calibration_audit(spark: SparkSession, sf: str) -> DataFrame:
    return R.audited(candidates(spark, sf), SETTINGS).drop("least", "most")


@query("e7_calibration_sweep", f"{_AUDIT} SELECT name, count(*) AS cases, CAST(sum(CAST(moved AS BIGINT)) AS BIGINT) AS moved, round(avg(CAST(relevant AS DOUBLE)), 6) AS relevant_rate, round(avg(margin), 6) AS mean_margin FROM a GROUP BY name")
def calibration_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Four settings side by side over all candidates, which are read once."""
    return R.sweep(candidates(spark, sf), SETTINGS)


def _printed(columns: list[str]) -> str:
    said = lambda c: f"'{c}=' || coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return " || ',' || ".join(map(said, columns))


_DIGEST = f"WITH h AS (SELECT source, sha256({_printed(['doc_id', 'lang', 'n_chars', 'text'])}) AS h FROM documents), s AS (SELECT source, count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS low, CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS high FROM h GROUP BY source)"


@query("e6_fingerprints", f"{_DIGEST} SELECT *, sha256('doc_id,lang,n_chars,text|' || rows || '|' || low || '|' || high) AS fingerprint FROM s")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """A fingerprint of each source's documents, that no order of rows or files changes."""
    return R.fingerprint(table(spark, sf, "documents"), ["source"])


_RESULTS = "SELECT o_custkey AS k, o_orderkey AS case_id, o_orderstatus = 'F' AS passed, o_totalprice / 1000000.0 AS score, o_totalprice / 100.0 AS ms, o_orderkey % 7 = 0 AS look FROM orders WHERE o_orderkey IS NOT NULL"


def _decimal(v: str, digits: int) -> str:
    """SQL for a double as its digits are written, rounded half away from zero; round() of the double itself goes by its binary form, which may lie below a half."""
    return f"printf('%.{digits}f', CAST(round(CAST(CAST(CAST({v} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE))"


@query("k10_report_lines", f"""WITH r AS ({_RESULTS}), a AS (SELECT count(*) FILTER (WHERE passed) AS n, count(*) AS m, quantile_cont(CAST(ms AS DOUBLE), 0.5) AS p, quantile_cont(CAST(ms AS DOUBLE), 0.95) AS q FROM r)
SELECT 0 AS part, '0:0000' AS at, '# Evaluation' AS line UNION ALL SELECT 0, '0:0001', 'Passed: ' || n || ' of ' || m FROM a UNION ALL SELECT 0, '0:0002', 'Latency: ' || {_decimal('p', 1)} || ' ms at the median, ' || {_decimal('q', 1)} || ' ms at 95 %' FROM a
UNION ALL SELECT i, '0:0000', '## ' || ['Eligibility', 'Metrics', 'Review', 'Cases'][i] FROM (SELECT unnest([1, 2, 3, 4]) AS i) UNION ALL SELECT 1, '1:' || s, '- ' || s FROM (SELECT DISTINCT 'status ' || o_orderstatus AS s FROM orders)
UNION ALL SELECT 2, '1:' || s, '- ' || s || ': ' || {_decimal('v', 4)} FROM (SELECT o_orderpriority AS s, CAST(count(*) AS DOUBLE) / 1024 AS v FROM orders GROUP BY ALL)
UNION ALL SELECT 3, '1:' || case_id, '- ' || case_id || ': a; b' FROM r WHERE look UNION ALL SELECT 4, '1:' || case_id, '- ' || case_id || ': ' || CASE WHEN passed THEN 'pass' ELSE 'FAIL' END || ', score ' || {_decimal('score', 4)} || ', ' || {_decimal('ms', 1)} || ' ms' FROM r""")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A report over all orders as cases."""
    from ..operators import report

    o = table(spark, sf, "orders")
    results = o.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderstatus") == "F").alias("passed"), (F.col("o_totalprice") / 1000000.0).alias("score"), (F.col("o_totalprice") / 100.0).alias("latency_ms"), F.when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("a"), F.lit("b"))).alias("review"))
    metrics = o.groupBy(F.col("o_orderpriority").alias("name")).agg((F.count("*").cast("double") / 1024).alias("value"))
    return report.lines(results, metrics, o.select(F.concat(F.lit("status "), "o_orderstatus").alias("reason")).distinct())


@query("d18_item_names", """SELECT doc_id, source, CASE WHEN n IS NULL THEN 'file ' || source ELSE n END AS item_name FROM documents LEFT JOIN (SELECT source AS s, min(trim(lang)) AS n FROM documents WHERE doc_id % 50 = 3 AND source <> 'src7' AND trim(lang) <> '' GROUP BY source) ON s = source WHERE source IS NOT NULL""")
def item_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a chunk of its source; some sources have several names, one only blank ones, others none."""
    from ..operators import report

    d = table(spark, sf, "documents").filter("source IS NOT NULL")
    name = F.when(F.col("source") == "src7", " ").otherwise(F.concat(F.lit(" "), "lang"))
    out = report.with_item_names(d.select("source", "doc_id"), d.filter("doc_id % 50 = 3").select("source", name.alias("name")), d.select("source", F.concat(F.lit("file "), "source").alias("file_title")).distinct(), "source")
    return out.select("doc_id", "source", "item_name")
