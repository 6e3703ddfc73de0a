"""Outline queries: title paths, sections, composed documents, index rows, the older splitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outline as O
from ..operators.sized import dealt
from .registry import query, table

# Sentences of all documents as blocks: one in three is a heading of level 1 to 4, its first word the title; others are body, some of them page furniture.
_P = r"""p AS (SELECT doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 AS position, unnest(string_split(text, '. ')) AS s FROM documents),
b AS (SELECT doc_id, position, s, CASE WHEN (position + length(s)) % 3 = 0 THEN 1 + (length(s) // 3 + position) % 4 END AS level, position // 5 AS page, sum(length(s) + 2) OVER (PARTITION BY doc_id ORDER BY position) - length(s) - 2 AS start FROM p),
h AS (SELECT doc_id, position, level, trim(string_split(trim(regexp_replace(s, '[\s ]+', ' ', 'g')), ' ')[1]) AS title FROM b WHERE level IS NOT NULL),
o AS (SELECT b.doc_id, b.position, h.position AS at, h.level, h.title FROM b JOIN h ON h.doc_id = b.doc_id AND h.position <= b.position
  AND NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND g.position > h.position AND g.position <= b.position AND g.level <= h.level)),
t AS (SELECT b.doc_id, b.position, b.s, b.level, b.page, b.start, coalesce(list(o.title ORDER BY o.level) FILTER (WHERE o.at IS NOT NULL), []) AS path, max(o.at) AS section_at, list_sort(list(o.at) FILTER (WHERE o.at IS NOT NULL), 'DESC')[2] AS parent_at
  FROM b LEFT JOIN o USING (doc_id, position) GROUP BY ALL)"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    p = dealt(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("position", "text"))
    n = F.length("text")
    level = F.when((F.col("position") + n) % 3 == 0, 1 + (F.floor(n / 3) + F.col("position")) % 4)
    start = F.sum(n + 2).over(Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)) - n - 2
    kind = F.when(level.isNotNull(), "heading").when(n % 11 == 0, "table").when(n % 11 == 1, "image").otherwise("paragraph")
    layer = F.when(level.isNull() & (n % 7 == 0), "furniture").otherwise("body")
    b = p.select("doc_id", F.col("position").cast("long").alias("position"), "text", level.cast("long").alias("level"), F.floor(F.col("position") / 5).alias("page"), start.cast("long").alias("start"), kind.alias("kind"), layer.alias("layer"))
    return b.withColumn("end", F.col("start") + F.length("text"))


def _first() -> Column:
    """A block's first word."""
    return F.get(F.split(F.trim(F.regexp_replace("text", "[\\s ]+", " ")), " "), F.lit(0))


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    return O.with_titles(_blocks(spark, sf), title=_first())


@query("d2_title_paths", rf"""WITH {_P} SELECT doc_id, CAST(position AS BIGINT) AS position, array_to_string(path, ' > ') AS title_path, CAST(section_at AS BIGINT) AS section_at, CAST(parent_at AS BIGINT) AS parent_at FROM t""")
def title_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The headings open at every block, levels 1 to 4; the SQL looks for headings that no later one has closed."""
    return _titled(spark, sf).select("doc_id", "position", F.array_join("title_path", " > ").alias("title_path"), "section_at", "parent_at")


_S = rf"""{_P}, g AS (SELECT doc_id, section_at, any_value(path) AS path, any_value(parent_at) AS parent_at, list_sort(list_distinct(list(page))) AS pages, min(start) AS lo, max(start + length(s)) AS hi, count(*) AS blocks FROM t GROUP BY doc_id, section_at
  UNION ALL SELECT doc_id, NULL, [], NULL, [], NULL, NULL, 0 FROM (SELECT DISTINCT doc_id FROM t ANTI JOIN (SELECT doc_id FROM t WHERE section_at IS NULL) USING (doc_id))),
j AS (SELECT *, '[' || array_to_string(list_transform(path, lambda x: to_json(x)), ',') || ']' AS js FROM g),
i AS (SELECT *, 'sec_' || substr(sha256('["' || doc_id || '",' || js || ',' || (row_number() OVER (PARTITION BY doc_id, js ORDER BY section_at NULLS FIRST) - 1) || ']'), 1, 24) AS section_id FROM j)"""


@query("d4_sections", rf"""WITH {_S} SELECT i.doc_id, i.section_id, u.section_id AS parent_id, row_number() OVER (PARTITION BY i.doc_id ORDER BY i.section_at NULLS FIRST) - 1 AS ordinal, coalesce(i.path[-1], '') AS title,
 array_to_string(i.pages, ',') AS pages, CAST(i.lo AS BIGINT) AS start, CAST(i.hi AS BIGINT) AS "end", i.blocks FROM i LEFT JOIN i u ON u.doc_id = i.doc_id AND u.section_at IS NOT DISTINCT FROM i.parent_at AND i.section_at IS NOT NULL""")
def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all documents with ids, parents, pages and ranges, roots included."""
    return O.sections(_titled(spark, sf)).select("doc_id", "section_id", "parent_id", "ordinal", "title", F.array_join("pages", ",").alias("pages"), "start", "end", "blocks")


# Texts with NUL, mixed line ends, decomposed letters and blanks at line ends; documents without text have no body.
_RAW = r"""'  ' || coalesce(source, '') || ' ' || chr(9) || chr(13) || chr(10) || 'e' || chr(769) || coalesce(text, '') || chr(160) || chr(13) || 'x' || ' ' || chr(10) || chr(10)"""


@query("f2_clean_text", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({_RAW}), '\r\n?', chr(10), 'g'), '[ \t\x0B\f   -     　\x85]+(\n|$)', '\1', 'g'), '^[\s ]+|[\s ]+$', '', 'g')) AS digest FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    s = lambda c: F.coalesce(c, F.lit(""))
    raw = F.concat(F.lit("  "), s("source"), F.lit(" \t\r\né"), s("text"), F.lit(" \rx\0 \n\n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(O.clean(raw)).alias("digest"))


@query("d4_documents", rf"""WITH {_S}, k AS (SELECT t.doc_id, t.position, trim(t.s) AS s, t.level, i.section_id, length(t.s) AS n FROM t JOIN i ON i.doc_id = t.doc_id AND i.section_at IS NOT DISTINCT FROM t.section_at),
l AS (SELECT doc_id, s, position, CASE WHEN s = '' THEN 'blank' WHEN level IS NULL AND n % 7 = 0 THEN 'furniture' ELSE 'body' END AS layer, CASE WHEN level IS NOT NULL THEN 'heading' WHEN n % 11 = 0 THEN 'table' WHEN n % 11 = 1 THEN 'image' ELSE 'paragraph' END AS kind, section_id FROM k),
a AS (SELECT doc_id, string_agg('["' || kind || '",' || to_json(md5(s)) || ',"' || section_id || '","' || layer || '"]', chr(10) ORDER BY position) AS ls, count(*) FILTER (WHERE layer = 'body' AND s <> '') AS body FROM l GROUP BY doc_id),
d AS (SELECT doc_id, ['success', 'partial', 'failed', 'quarantined'][1 + doc_id % 4] AS status, CASE WHEN doc_id % 3 = 0 THEN ['no_body_content'] ELSE ['invalid_page'] END AS errors, sha256(coalesce(source, '')) AS h FROM documents)
SELECT d.doc_id, CASE WHEN coalesce(body, 0) = 0 AND status NOT IN ('failed', 'quarantined') THEN 'review_required' ELSE status END AS status,
 array_to_string(CASE WHEN coalesce(body, 0) = 0 AND status NOT IN ('failed', 'quarantined') AND NOT list_contains(errors, 'no_body_content') THEN list_append(errors, 'no_body_content') ELSE errors END, ',') AS errors,
 'rev_' || substr(sha256(h || chr(10) || 'plain' || chr(10) || '1' || chr(10) || coalesce(ls, '')), 1, 32) AS revision_id, coalesce(body, 0) AS body_blocks FROM d LEFT JOIN a USING (doc_id)""")
def composed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of their blocks (texts as digests): status, errors and revision; those without a text have no body."""
    titled = O.with_titles(_blocks(spark, sf).withColumn("_first", _first()).withColumn("text", F.md5(F.trim("text"))), title="_first")
    blocks = O.with_section_ids(titled).withColumn("layer", F.when(F.col("text") == F.md5(F.lit("")), "blank").otherwise(F.col("layer")))
    status = F.get(F.array(*map(F.lit, ("success", "partial", "failed", "quarantined"))), (F.col("doc_id") % 4).cast("int"))
    errors = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("no_body_content"))).otherwise(F.array(F.lit("invalid_page")))
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("source", F.lit("")), 256).alias("source_hash"), F.lit("plain").alias("parser"), F.lit("1").alias("parser_version"), status.alias("status"), errors.alias("errors"))
    return O.documents(blocks, docs).select("doc_id", "status", F.array_join("errors", ",").alias("errors"), "revision_id", "body_blocks")


# One chunk per section with text: its body blocks in order, every fourth also names a block that is not there.
_X = rf"""{_S}, c AS (SELECT t.doc_id, i.section_id, i.path, i.js, i.ordinal, list(t.position ORDER BY t.position) AS ps, string_agg(t.s, chr(10) ORDER BY t.position) AS text, bool_or(length(t.s) % 11 = 0 AND t.level IS NULL) AS has_table, bool_or(length(t.s) % 11 = 1 AND t.level IS NULL) AS has_image, list_sort(list_distinct(list(t.page))) AS pages
  FROM t JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_at NULLS FIRST) - 1 AS ordinal FROM i) i ON i.doc_id = t.doc_id AND i.section_at IS NOT DISTINCT FROM t.section_at GROUP BY ALL)"""
_PATH = "'[' || array_to_string(list_transform(list_transform(ps, lambda x: doc_id || ':' || x) || CASE WHEN ordinal % 4 = 1 THEN ['gone'] ELSE [] END, lambda x: '\"' || x || '\"'), ',') || ']'"


@query("d16_index_rows", rf"""WITH {_X} SELECT 'c' || doc_id || '.' || ordinal AS chunk_id, doc_id AS document_id, md5(trim(array_to_string(path || [text], chr(10)), ' ' || chr(9) || chr(13) || chr(10))) AS content, coalesce(path[-1], '') AS title,
 CASE WHEN len(path) > 1 THEN path[-2] ELSE 'file.' || doc_id END AS parent_title, js AS title_path, CASE WHEN doc_id % 2 = 0 THEN 'item' || doc_id ELSE '' END AS item_name, CASE WHEN doc_id % 5 = 0 THEN 'private' ELSE 'public' END AS visibility,
 CASE WHEN doc_id % 5 = 0 THEN 'subject:a,role:b' ELSE '' END AS acl_readers, {_PATH} AS block_ids, '[' || array_to_string(pages, ',') || ']' AS page_numbers,
 '[' || array_to_string(list_sort(list_transform(pages, lambda x: '"p' || x || '"')), ',') || ']' AS page_uids, '[' || array_to_string(list_transform(list_filter(ps, lambda x: x % 6 <> 5), lambda x: '"L' || x || '"'), ',') || ']' AS block_lineage_ids, has_table, has_image FROM c""")
def index_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all documents as rows of the search index; ids without a block and blocks without a lineage are passed over."""
    from pyspark.sql.window import Window

    b = _titled(spark, sf).withColumn("block_id", F.concat_ws(":", "doc_id", "position")).withColumn("lineage_id", F.when(F.col("position") % 6 != 5, F.concat(F.lit("L"), F.col("position").cast("string")))).withColumn("page_uid", F.concat(F.lit("p"), F.col("page").cast("string")))
    # Sections with blocks of their own, numbered behind a root that has none; all of it within the partitions that the outline has made.
    # Ids and texts are gathered apart, so that what needs no texts deals none.
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("position", c))), lambda x: x[c])
    c = b.groupBy("doc_id", "section_at").agg(listed("block_id").alias("_ids"), listed("text").alias("_texts"), F.first("title_path").alias("title_path")).withColumn("_path", F.to_json("title_path"))
    by = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("section_at"))
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordinal = F.row_number().over(by) - F.max(F.col("section_at").isNull().cast("int")).over(whole)
    same = F.row_number().over(Window.partitionBy("doc_id", "_path").orderBy(F.asc_nulls_first("section_at"))) - 1
    c = c.withColumn("ordinal", ordinal.cast("long")).withColumn("section_id", O.section_id(F.col("doc_id"), F.col("title_path"), same))
    ids = F.col("_ids")
    c = c.select("doc_id", "section_id", "title_path", F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("."), F.col("ordinal").cast("string")).alias("chunk_id"), F.col("ordinal").alias("part"), F.when(F.col("ordinal") % 4 == 1, F.array_append(ids, F.lit("gone"))).otherwise(ids).alias("block_ids"), F.array_join("_texts", "\n").alias("text"))
    no = F.lit(None).cast("string")
    name = F.concat(F.lit("file."), F.col("doc_id").cast("string"))
    docs = table(spark, sf, "documents").select("doc_id", no.alias("revision_id"), F.concat(name, F.lit(".md")).alias("filename"), no.alias("uri"), no.alias("source_hash"), no.alias("parser"), no.alias("parser_version"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("item"), F.col("doc_id").cast("string"))).alias("item_name"))
    rows = O.index_rows(c, b, docs, visibility=F.when(F.col("doc_id") % 5 == 0, "private").otherwise("public"), readers=F.array(F.lit("subject:a"), F.lit("role:b")))
    shown = "chunk_id", "document_id", "title", "parent_title", "title_path", "item_name", "visibility", "block_ids", "page_numbers", "page_uids", "block_lineage_ids", "has_table", "has_image"
    return rows.select(*shown, F.md5("content").alias("content"), F.array_join("acl_readers", ",").alias("acl_readers"))


@query("d17_contextual_text", rf"""WITH {_X} SELECT doc_id, section_id, md5(trim(array_to_string(path || [text], chr(10)), ' ' || chr(9) || chr(13) || chr(10))) AS digest FROM c""")
def contextual_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each section's text below the titles that lead to it."""
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n")
    path = F.coalesce(F.first("title_path"), F.array().cast("array<string>"))
    # Texts end as digests where they are gathered; no later sort carries them.
    rows = O.sections(_titled(spark, sf), also={"digest": F.md5(O.contextual(path, own))})
    return rows.filter("blocks > 0").select("doc_id", "section_id", "digest")


@query("d14_legacy_sections")
def legacy_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of all documents by the older splitter's rules, the short ones of a parent title taken together; a fold, tested against a plain loop."""
    b = _blocks(spark, sf).withColumn("text", F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.substring(F.trim("text"), 1, 3))).otherwise(F.col("text")))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("file "), F.col("doc_id").cast("string")).alias("file_title"))
    out = O.legacy_sections(O.with_titles(b, plain=False), docs, 120)
    return out.select("doc_id", "part", "title", "parent_title", "file_title", F.md5("content").alias("digest"))


# Items of a parser whose titles and table captions are numbered by their place, so that siblings follow each other, also across pages; some have no number, two captions, or a second level.
_I = r"""p AS (SELECT doc_id, generate_subscripts(string_split(text, '. '), 1) - 1 AS position, unnest(string_split(text, '. ')) AS s FROM documents),
i AS (SELECT doc_id, position AS item, position // 4 + position % 11 // 10 AS page, length(s) AS n, CASE (position + length(s)) % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'table' ELSE 'paragraph' END AS type,
  CASE WHEN doc_id % 4 = 1 THEN 1 + position % 2 ELSE 1 END AS level, CASE WHEN length(s) % 5 > 0 THEN [1 + position // 6, 1 + position % 6] END AS num FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, item) AS rn FROM i WHERE num IS NOT NULL AND (type = 'title' OR (type = 'table' AND n % 7 > 0)) AND doc_id IN (SELECT doc_id FROM i WHERE type = 'title' GROUP BY doc_id HAVING max(level) = 1)),
r(doc_id, rn, num, page, item, hit, apage, aitem) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT doc_id FROM k)
  UNION ALL SELECT r.doc_id, k.rn, CASE WHEN ok OR k.type = 'title' THEN k.num ELSE r.num END, CASE WHEN ok OR k.type = 'title' THEN k.page ELSE r.page END, CASE WHEN ok OR k.type = 'title' THEN k.item ELSE r.item END, ok AND k.type = 'table', r.page, r.item
  FROM r JOIN k ON k.doc_id = r.doc_id AND k.rn = r.rn + 1, LATERAL (SELECT coalesce(k.num[1] = r.num[1] AND k.num[2] = r.num[2] + 1 AND k.page - r.page BETWEEN 0 AND 1, false) AS ok))"""


@query("w10_recovered_headings", f"""WITH RECURSIVE {_I} SELECT k.doc_id, CAST(k.page AS BIGINT) AS page, CAST(k.item AS BIGINT) AS item, k.num[1] || '.' || k.num[2] || ' T' || k.n AS title, r.apage AS anchor_page, r.aitem AS anchor_item FROM r JOIN k USING (doc_id, rn) WHERE hit""")
def recovered_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Captions that open sections, each the anchor of the next; the SQL takes one mark after another."""
    p = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("item", "s")).withColumn("n", F.length("s")).withColumn("item", F.col("item").cast("long"))
    kind = F.when((F.col("item") + F.col("n")) % 3 == 0, "title").when((F.col("item") + F.col("n")) % 3 == 1, "table").otherwise("paragraph")
    number = F.concat_ws(".", (1 + F.floor(F.col("item") / 6)).cast("string"), (1 + F.col("item") % 6).cast("string"))
    said = F.concat(F.when(F.col("n") % 5 > 0, F.concat(number, F.lit(" "))).otherwise(""), F.lit("T"), F.col("n").cast("string"))
    level = F.when(kind == "title", F.when(F.col("doc_id") % 4 == 1, 1 + F.col("item") % 2).otherwise(1)).cast("int")
    captions = F.when(kind == "table", F.when(F.col("n") % 7 == 0, F.array(said, said)).otherwise(F.array(said)))
    items = p.select("doc_id", (F.floor(F.col("item") / 4) + F.floor(F.col("item") % 11 / 10)).alias("page"), "item", kind.alias("type"), level.alias("level"), said.alias("text"), captions.alias("captions"))
    return O.recovered_headings(items).select("doc_id", "page", "item", "title", "anchor_page", "anchor_item")
