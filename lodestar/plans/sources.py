"""Source queries: artifacts beside documents, evidence frozen from labels, pointers to current documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import composed as S
from .registry import query, table

_FILES = """SELECT CAST(doc_id AS VARCHAR) AS d, '/in/' || (doc_id // 3) || '/' AS folder, doc_id % 3 AS k, doc_id FROM documents"""
_CONTENT, _MIDDLE = S.ARTIFACTS.values()


@query("s4_discovered_artifacts", f"""WITH f AS ({_FILES}), c AS (SELECT folder, d || '{_CONTENT}' AS name FROM f WHERE doc_id % 2 = 0 UNION ALL SELECT folder, 'z' || '{_CONTENT}' FROM f WHERE doc_id % 5 = 0), m AS (SELECT folder, d || '{_MIDDLE}' AS name FROM f WHERE doc_id % 7 = 0),
x AS (SELECT f.folder || f.d || CASE WHEN k = 0 THEN '_new.md' WHEN k = 1 THEN '.MARKDOWN' ELSE '.md' END AS path, f.folder, f.d FROM f)
SELECT path, coalesce((SELECT min(x.folder || c.name) FROM c WHERE c.folder = x.folder AND c.name = x.d || '{_CONTENT}'), (SELECT min(c.folder || c.name) FROM c WHERE c.folder = x.folder)) AS content_path,
 coalesce((SELECT min(m.folder || m.name) FROM m WHERE m.folder = x.folder AND m.name = x.d || '{_MIDDLE}'), (SELECT min(m.folder || m.name) FROM m WHERE m.folder = x.folder)) AS middle_path FROM x""")
def discovered(spark: SparkSession, sf: str) -> DataFrame:
    """Three documents share a folder; some have artifacts of their own, some only a neighbour's."""
    d = table(spark, sf, "documents")
    folder, stem = F.concat(F.lit("/in/"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("/")), F.col("doc_id").cast("string")
    ending = F.when(F.col("doc_id") % 3 == 0, "_new.md").when(F.col("doc_id") % 3 == 1, ".MARKDOWN").otherwise(".md")
    has = lambda n, name: F.when(F.col("doc_id") % n == 0, F.concat(folder, *name))
    files = F.array_compact(F.array(F.concat(folder, stem, ending), has(2, (stem, F.lit(_CONTENT))), has(5, (F.lit("z" + _CONTENT),)), has(7, (stem, F.lit(_MIDDLE)))))
    return S.discovered(d.select(F.explode(files).alias("path")).distinct())


_CASES = "SELECT doc_id AS case_id, doc_id % 4 AS k, coalesce(source, '') AS source, coalesce(lang, '') AS lang, doc_id % 3 = 0 AS img, doc_id % 2 = 0 AS cite FROM documents"


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    k, s, l = F.col("doc_id") % 4, F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    fact = lambda *any_: F.struct(F.array(*any_).cast("array<string>").alias("any"))
    none = F.array().cast("array<struct<any:array<string>>>")
    facts = F.when(k == 0, F.array(fact(F.concat(F.lit(" "), s), F.lit("other")), fact(), fact(l))).when(k == 1, F.array(fact(F.lit("")))).when(k == 2, F.array(fact(l))).otherwise(none)
    source = F.array(F.struct(s.alias("title"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("source")), F.struct(l.alias("title"), F.lit("own").alias("chunk_id"), F.lit("web").alias("source")))
    behavior = F.when(F.col("doc_id") % 5 == 0, "refuse").otherwise("answer")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), facts.alias("facts"), F.slice(source, 1, (F.col("doc_id") % 3).cast("int")).alias("sources"), (F.col("doc_id") % 3 == 0).alias("requires_image"), (F.col("doc_id") % 2 == 0).alias("requires_citation"), behavior.alias("behavior"))


@query("s12_frozen_evidence", f"""WITH c AS ({_CASES}), f AS (SELECT *, CASE k WHEN 0 THEN ' ' || source || '；' || lang WHEN 2 THEN lang ELSE '' END AS said FROM c), r AS (SELECT *, unnest(range(1, 1 + case_id % 3)) AS rank FROM f)
SELECT case_id, rank, CASE WHEN rank = 1 THEN 'contract-1' ELSE 'own' END AS chunk_id, CASE WHEN rank = 1 THEN 'local' ELSE 'web' END AS source, CASE WHEN rank = 1 THEN source ELSE lang END AS title,
 CASE WHEN said = '' THEN '{S.NO_FACT}' ELSE said END || CASE WHEN img THEN chr(10) || '![control panel]({S.IMAGE})' ELSE '' END AS content, CASE WHEN img THEN 1 ELSE 0 END AS images FROM r""")
def frozen_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return S.frozen_evidence(_cases(spark, sf)).withColumn("images", F.size("image_urls")).drop("image_urls")


@query("s12_frozen_answers", f"""WITH c AS ({_CASES}), f AS (SELECT *, list_filter(CASE k WHEN 0 THEN [' ' || source, lang] WHEN 2 THEN [lang] ELSE [] END, lambda x: x <> '') AS xs FROM c),
a AS (SELECT *, array_to_string(list_transform(xs, lambda x: trim(x) || CASE WHEN cite THEN '。[1]' ELSE '' END), '；') AS said FROM f)
SELECT case_id, CASE WHEN said <> '' THEN said WHEN case_id % 5 > 0 THEN '{S.NO_ANSWER}' ELSE '' END || CASE WHEN img THEN chr(10) || '【图片】' || chr(10) || '{S.IMAGE}' ELSE '' END AS answer FROM a""")
def frozen_answers(spark: SparkSession, sf: str) -> DataFrame:
    return S.frozen_answers(_cases(spark, sf))


@query("k12_current_pointers", """WITH w AS (SELECT user_id AS document_key, event_type || '/' || event_id AS path, ts AS written_at FROM events)
SELECT document_key, path, written_at FROM w QUALIFY row_number() OVER (PARTITION BY document_key ORDER BY written_at DESC, path DESC) = 1""")
def current_pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Each key's current path after all writes, half of which come in a second batch."""
    w = table(spark, sf, "events").select(F.col("user_id").alias("document_key"), F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("written_at"))
    even = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    nothing = w.limit(0)
    return S.switched(S.switched(nothing, w.filter(even)), w.filter(~even))
