"""Corpus queries: text functions, blocks, chunks, revisions, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import fusion
from .registry import query, table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "n_chars")


@query("f1_normalized_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(T.normalized(F.col("text"))).alias("digest"))


@query("f5_terms", r"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(regexp_replace(text, '\[[^\]]+\]', ' ', 'g')), '[A-Za-z][A-Za-z0-9_/-]+')) AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, CAST(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) AS BIGINT) AS chars FROM t""")
def terms(spark: SparkSession, sf: str) -> DataFrame:
    t = _docs(spark, sf).select("doc_id", T.terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.aggregate("t", F.lit(0), lambda s, x: s + F.length(x)).cast("long").alias("chars"))


@query("f8_numbers", r"""WITH n AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^A-Za-z0-9.]|[^A-Za-z0-9]\.)(\d+)', 1), lambda x: regexp_replace(x, '^0+(\d)', '\1'))) AS n FROM (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9.]*[A-Za-z.][A-Za-z0-9.]*', ' ', 'g') AS text FROM documents))
SELECT doc_id, CAST(len(n) AS BIGINT) AS n_numbers FROM n""")
def numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of words that hold digits alone."""
    alone = F.regexp_replace("text", r"[A-Za-z0-9.]*[A-Za-z.][A-Za-z0-9.]*", " ")
    return _docs(spark, sf).select("doc_id", F.size(T.numbers(alone)).cast("long").alias("n_numbers"))


@query("f11_sentence_split", r"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+$'), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM documents""")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.size(T.pieces(F.col("text"))).cast("long").alias("n"))


@query("f28_url_key", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$', ['s', 'h', 'p', 'q']) AS u FROM pages)
SELECT page_id, lower(u.s) || '://' || lower(u.h) || regexp_replace(u.p, '/+$', '') || u.q AS url_key, lower(u.h) AS host, lower(u.h) = 'example.com' OR lower(u.h) LIKE '%.example.com' AS official FROM p""")
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", T.url_key(F.col("url")).alias("url_key"), T.host(F.col("url")).alias("host"), T.official(T.host(F.col("url")), ["example.com"]).alias("official"))


@query("p9_url_policy", r"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM pages WHERE regexp_matches(url, '^(?i)https?://[^/?#@\s]+([/?#]\S*)?$')),
a AS (SELECT *, host = 'example.org' OR host LIKE '%.example.org' AS official FROM p)
SELECT page_id, host, official, CAST(CASE WHEN official THEN 0.9 ELSE 0.45 END AS DOUBLE) AS authority FROM a WHERE official OR NOT (SELECT bool_or(official) FROM a)""")
def url_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Safe addresses; if any is official, the others are left out."""
    p = table(spark, sf, "pages").filter(T.safe_url(F.col("url"))).select("page_id", T.host(F.col("url")).alias("host"))
    p = p.withColumn("official", T.official(F.col("host"), ["example.org"]))
    some = p.agg(F.coalesce(F.max("official"), F.lit(False)).alias("_any"))
    kept = p.join(F.broadcast(some), F.col("official") | ~F.col("_any"))
    return kept.select("page_id", "host", "official", F.when(F.col("official"), 0.9).otherwise(0.45).alias("authority"))


@query("f30_fingerprint", r"SELECT doc_id, substr(sha256(substr(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 1000)), 1, 20) AS fingerprint FROM documents")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"))


@query("g1_stable_id", """SELECT doc_id, 'doc_' || substr(sha256('["' || source || '","' || doc_id || '"]'), 1, 24) AS document_id, sha256(source || chr(31) || lang || chr(31) || doc_id) AS session_key FROM documents""")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", T.stable_id("doc", F.col("source"), F.col("doc_id")).alias("document_id"), F.sha2(F.concat_ws(chr(31), "source", "lang", F.col("doc_id").cast("string")), 256).alias("session_key"))


@query("s1_route_by_suffix", r"""WITH p AS (SELECT doc_id, source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.markdown' ELSE '.txt' END AS path FROM documents)
SELECT doc_id, CASE lower(regexp_extract(path, '\.[^.]+$')) WHEN '.pdf' THEN 'pdf' WHEN '.md' THEN 'markdown' WHEN '.markdown' THEN 'markdown' ELSE 'error' END AS route, regexp_extract(path, '([^/]+)\.[^.]+$', 1) AS title FROM p""")
def route(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import route as by_suffix

    k = F.col("doc_id") % 4
    suffix = F.when(k == 0, ".pdf").when(k == 1, ".MD").when(k == 2, ".markdown").otherwise(".txt")
    d = _docs(spark, sf).select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return by_suffix(d).select("doc_id", "route", "title")


@query("s20_upload_check", "SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, strlen(text) BETWEEN 1 AND 20000 AS accepted FROM documents")
def upload_check(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return _docs(spark, sf).select("doc_id", size.alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), size.between(1, 20000).alias("accepted"))


@query("p20_preview", "SELECT doc_id, CASE WHEN length(text) > 280 THEN substr(text, 1, 280) || '…' ELSE text END AS preview FROM documents")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.preview(F.col("text")).alias("preview"))


_LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query("w8_running_offset", f"WITH {_LINES} SELECT doc_id, CAST(position AS INTEGER) AS position, CAST(length(line) AS BIGINT) AS chars, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l")
def offsets(spark: SparkSession, sf: str) -> DataFrame:
    return D.lines(_docs(spark, sf)).select("doc_id", "position", F.length("line").cast("long").alias("chars"), "start")


@query("w7_heading_propagation", f"WITH {_LINES} SELECT doc_id, CAST(position AS INTEGER) AS position, last_value(CASE WHEN length(line) BETWEEN 1 AND 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    return D.with_heading(D.lines(_docs(spark, sf)), F.length("line").between(1, 40)).select("doc_id", "position", "heading")


@query("w6_title_occurrence", f"WITH {_LINES} SELECT doc_id, CAST(position AS INTEGER) AS position, row_number() OVER (PARTITION BY doc_id, line ORDER BY position) - 1 AS occurrence FROM l WHERE length(line) BETWEEN 1 AND 40")
def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.lines(_docs(spark, sf)).filter(F.length("line").between(1, 40))
    return D.occurrence(rows, ["doc_id", "line"], ["position"]).select("doc_id", "position", "occurrence")


@query("a6_section_ranges", f"""WITH {_LINES}, o AS (SELECT doc_id, position, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT doc_id, CAST(position // 5 AS BIGINT) AS section, CAST(min(start) AS BIGINT) AS first, CAST(max(start + length(line)) AS BIGINT) AS last, count(*) AS blocks FROM o GROUP BY ALL""")
def section_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.lines(_docs(spark, sf)).withColumn("section", F.floor(F.col("position") / 5).cast("long"))
    return rows.groupBy("doc_id", "section").agg(F.min("start").alias("first"), F.max(F.col("start") + F.length("line")).alias("last"), F.count("*").alias("blocks"))


@query("d13_fixed_windows", """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), s AS (SELECT doc_id, text, n, unnest(range(0, n, 400)) AS start FROM d)
SELECT doc_id, CAST(start // 400 AS BIGINT) AS part, md5(substr(text, start + 1, 500)) AS digest FROM s""")
def windows(spark: SparkSession, sf: str) -> DataFrame:
    w = D.fixed_windows(_docs(spark, sf), 500, 100)
    return w.select("doc_id", F.col("part").cast("long").alias("part"), F.md5("chunk").alias("digest"))


@query("w12_greedy_chunks")
def greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Lines packed in order up to 1200 characters; a fold, tested against a plain loop."""
    pieces = D.lines(_docs(spark, sf)).filter(F.trim("line") != "").select("doc_id", "position", F.length("line").cast("long").alias("chars"))
    return D.greedy_chunks(pieces, 1200)


_REV = """l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS raw FROM documents),
a AS (SELECT doc_id, position, raw AS line FROM l WHERE trim(raw) <> ''), b AS (SELECT doc_id, position, CASE WHEN position % 4 = 1 THEN raw || ' revised' ELSE raw END AS line FROM l WHERE trim(raw) <> '' AND position % 5 <> 3),
sa AS (SELECT *, substr(sha256(trim(regexp_replace(line, '\\s+', ' ', 'g'))), 1, 24) AS signature FROM a), sb AS (SELECT *, substr(sha256(trim(regexp_replace(line, '\\s+', ' ', 'g'))), 1, 24) AS signature FROM b)"""


def _revisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = D.lines(_docs(spark, sf)).filter(F.trim("line") != "")
    new = rows.filter("position % 5 != 3").withColumn("line", F.when(F.col("position") % 4 == 1, F.concat("line", F.lit(" revised"))).otherwise(F.col("line")))
    return D.lineage(rows), D.lineage(new)


@query("d6_seed_lineage", f"""WITH {_REV} SELECT doc_id, CAST(position AS INTEGER) AS position, 'lin_' || substr(sha256(CASE WHEN count(*) OVER (PARTITION BY doc_id, signature) = 1 THEN '["' || doc_id || '","' || signature || '"]' ELSE '["' || doc_id || '","order","' || position || '"]' END), 1, 24) AS lineage_id FROM sa""")
def seed_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return _revisions(spark, sf)[0].select("doc_id", "position", "lineage_id")


@query("j12_unique_signatures", f"""WITH {_REV}, ua AS (SELECT doc_id, signature, min(position) AS p FROM sa GROUP BY ALL HAVING count(*) = 1), ub AS (SELECT doc_id, signature, min(position) AS p FROM sb GROUP BY ALL HAVING count(*) = 1)
SELECT doc_id, signature, CAST(ua.p AS INTEGER) AS old, CAST(ub.p AS INTEGER) AS new FROM ua JOIN ub USING (doc_id, signature)""")
def unique_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return D.unique_matches(*_revisions(spark, sf))


@query("d8_revision_diff", f"""WITH {_REV}, la AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY doc_id, signature) = 1 THEN signature ELSE 'o' || position END AS lin, signature FROM sa), lb AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY doc_id, signature) = 1 THEN signature ELSE 'o' || position END AS lin, signature FROM sb),
j AS (SELECT coalesce(la.doc_id, lb.doc_id) AS doc_id, CASE WHEN lb.lin IS NULL THEN 'removed' WHEN la.lin IS NULL THEN 'added' WHEN la.signature = lb.signature THEN 'unchanged' ELSE 'modified' END AS state FROM la FULL JOIN lb ON la.doc_id = lb.doc_id AND la.lin = lb.lin)
SELECT doc_id, state, count(*) AS n FROM j GROUP BY ALL""")
def revision_diff(spark: SparkSession, sf: str) -> DataFrame:
    return D.block_difference(*_revisions(spark, sf)).groupBy("doc_id", "state").agg(F.count("*").alias("n"))


@query("a8_multiset_dice", """WITH a AS (SELECT page_id AS doc_id, url AS t FROM pages), b AS (SELECT page_id AS doc_id, replace(url, 'http://', 'https://www.') AS t FROM pages),
ga AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, substr(t, unnest(range(1, length(t) - 3)), 5) AS g FROM a) GROUP BY ALL), gb AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, substr(t, unnest(range(1, length(t) - 3)), 5) AS g FROM b) GROUP BY ALL)
SELECT doc_id, round(2 * sum(least(coalesce(ga.n, 0), coalesce(gb.n, 0))) / sum(coalesce(ga.n, 0) + coalesce(gb.n, 0)), 6) AS similarity FROM ga FULL JOIN gb USING (doc_id, g) GROUP BY doc_id""")
def multiset_dice(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    old = p.select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    return D.dice(old, old.withColumn("text", F.replace(F.col("text"), F.lit("http://"), F.lit("https://www."))))


@query("k2_replace_by_key", """SELECT o_custkey AS document_id, count(*) AS n, CAST(sum(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS replaced FROM orders GROUP BY o_custkey""")
def replace_by_key(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), "o_orderkey", F.lit(0).alias("revision"))
    incoming = o.filter("document_id % 3 = 0").withColumn("revision", F.lit(1))
    return D.replaced(o, incoming).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("revision").cast("long").alias("replaced"))


@query("d19_page_index", """WITH s AS (SELECT source AS title, count(*) AS children FROM documents GROUP BY source)
SELECT substr(sha1('leaf|' || source || '|' || doc_id), 1, 16) AS node_id, substr(sha1('section|' || source), 1, 16) AS parent_id, 'leaf' AS kind, CAST(doc_id AS VARCHAR) AS title, CAST(0 AS BIGINT) AS children FROM documents
UNION ALL SELECT substr(sha1('section|' || title), 1, 16), substr(sha1('root'), 1, 16), 'section', title, children FROM s UNION ALL SELECT substr(sha1('root'), 1, 16), NULL, 'root', 'root', count(*) FROM s""")
def page_index(spark: SparkSession, sf: str) -> DataFrame:
    return D.page_index(_docs(spark, sf).select("source", "doc_id"), "source", "doc_id")


@query("s15_latest_history", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn, role, least(n, 3) - r + 1 AS position FROM r WHERE r <= 3""")
def latest_history(spark: SparkSession, sf: str) -> DataFrame:
    """The latest three messages of each conversation, oldest first."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    latest = fusion.ranked(c, ["conv_id"], [F.desc("turn")], 3).drop("rank")
    return fusion.ranked(latest, ["conv_id"], [F.asc("turn")]).select("conv_id", "turn", "role", F.col("rank").cast("long").alias("position"))


@query("w16_final_turn", "SELECT conv_id, arg_max(role, turn) AS last_role, CAST(max(turn) AS BIGINT) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS turns FROM conversations GROUP BY conv_id")
def final_turn(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").cast("long").alias("last_turn"), F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("turns"))
