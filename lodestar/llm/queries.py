"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, jaccard_join, language_id, max_sketch, packing, quality_bayes, quality_rules, sharding, toxicity, warc, whitening


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), 16)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host is the document's source, the path below it the part of the source in one language."""
    return quality_bayes.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


#: The contract's extra conversation, both of whose turns are full of control strings.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_digests(rows.unionByName(spark.createDataFrame(EXTRA, rows.schema)), tokenizer_path())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode_and_decode(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op12_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_warc, op3_toxicity, op4_decontamination, op5_quality_bayes, op6_chat_format, op7_jaccard_join, op8_packing, op9_quality_rules, op10_language_id, op11_bpe, op12_max_sketch, op13_whitening)
    return {f.__name__: f for f in found}


_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
k AS (SELECT hex, max(page_id) AS keeper FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || rpad(substr(hex, CAST(1 + (5 * i) // 4 AS INTEGER), 2), 2, '0') AS INTEGER) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN k USING (hex)
"""

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '(\[|<)(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g') AS er, regexp_replace(text, '(\[|<)(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + length('[INST]') + length('[/INST]') + length('</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op9() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    tests = []
    for r in quality_rules.RULES:
        unit = r.per or "1"
        tests += [f"{r.scale} * {r.signal} >= {r.low} * {unit}"] * (r.low is not None) + [f"{r.scale} * {r.signal} <= {r.high} * {unit}"] * (r.high is not None)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT row_number() OVER () AS rid, * FROM d),
p AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM k),
g AS (SELECT rid, i, w || chr(1) || lead(w) OVER r || chr(1) || lead(w, 2) OVER r AS g FROM p WINDOW r AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM t, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
s AS (SELECT k.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_intersect(list_distinct(list_transform(ws, lambda x: lower(x))), [{stop}])) AS BIGINT) AS n_stop_kinds
  FROM k LEFT JOIN rep USING (rid)),
f AS (SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '\.\.\.[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines,
  CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•] '))) AS BIGINT) AS n_bullet_lines,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept,
  n_lines, n_stop_kinds, n_ellipsis_lines, n_bullet_lines FROM f
"""


_OP7 = r"""
WITH RECURSIVE k AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM k WHERE len(ws) >= 5),
g AS (SELECT rid, w || chr(1) || lead(w) OVER r || chr(1) || lead(w, 2) OVER r || chr(1) || lead(w, 3) OVER r || chr(1) || lead(w, 4) OVER r AS g FROM p WINDOW r AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT DISTINCT rid, g FROM g WHERE g IS NOT NULL UNION ALL SELECT rid, array_to_string(ws, chr(1)) FROM k WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * both_n >= 75 * (na.n + nb.n - both_n)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, least(k.doc_id, (SELECT min(o.doc_id) FROM reach r JOIN k o ON o.rid = r.b WHERE r.a = k.rid)) AS component_id
FROM k LEFT JOIN n USING (rid)
"""


_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM d WHERE len(ws) > 0),
tf AS (SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
q AS (SELECT row_number() OVER () AS qid, * FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
qt AS (SELECT DISTINCT qid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM q),
df AS (SELECT w, count(*) AS df FROM tf SEMI JOIN qt USING (w) GROUP BY w),
sc AS (SELECT qid, rid, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * CAST(len(ws) AS BIGINT) * docs) // terms)))) AS BIGINT) AS score
  FROM qt JOIN df USING (w) JOIN tf USING (w) JOIN d USING (rid), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM sc JOIN d USING (rid) WHERE score > 0) JOIN q USING (qid)
WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_jaccard_join": _OP7, "op2_warc": _OP2, "op6_chat_format": _OP6, "op9_quality_rules": _op9(), "op12_max_sketch": _OP12}
