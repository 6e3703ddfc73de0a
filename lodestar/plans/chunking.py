"""Chunking, table and revision queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as H
from ..functions import text as T
from ..operators import blocks as B
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import revision as R
from .blocks import _B, _blocks
from .registry import query, table

_SECTIONED = f"{_B}, sb AS (SELECT *, CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block) AS BIGINT) AS section FROM bl)"


def _sectioned(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with their section, and a page of forty lines each."""
    b = B.sections(_blocks(spark, sf)).withColumn("page", F.floor(F.col("first") / 40))
    rows = F.when(F.col("kind") == "table", F.transform(H.pipe_rows(F.col("text")), lambda r: F.array_join(r, " | ")))
    none = F.array().cast("array<string>")
    return b.select("doc_id", "section", "block", "page", "kind", "text", rows.alias("rows"), none.alias("captions"), none.alias("notes"))


@query("d10_chunks")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents; a fold over a section's pieces, which SQL cannot express: tested against a plain loop over the same tables."""
    c = C.identified(C.chunks(_sectioned(spark, sf)), C.Config(), F.concat(F.lit("rev"), F.col("doc_id").cast("string")))
    return c.select("doc_id", "section", "chunk", "chunk_id", "part", F.array_join("blocks", ",").alias("blocks"), F.array_join("pages", ",").alias("pages"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


# Cut positions found step by step: the units of a text (or the rows of a table) that still fit, counted from where the piece begins.
# White space is that of any script; a table of nothing but its first row is one piece, where that row fits.
_SPACE = r"[\s\x0B\x1C-\x1F\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"
_STRIP = rf"regexp_replace({{0}}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
_UNITS = r"'[^。！？；.!?;\n]*[。！？；.!?;\n]|[^。！？；.!?;\n]+'"
_PIECES = rf"""WITH RECURSIVE {_SECTIONED.replace('WITH ', '')},
e AS (SELECT row_number() OVER () AS rid, doc_id, block, kind, text, length(text) AS n FROM sb WHERE kind <> 'heading' AND (kind = 'image' OR trim(text, ' ') <> '')),
tl AS (SELECT rid, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM e WHERE kind = 'table' AND n > 1200),
tr AS (SELECT rid, i, array_to_string(list_transform(string_split(trim(trim(line, ' '), '|'), '|'), lambda x: trim(x, ' ')), ' | ') AS row FROM tl WHERE NOT (i = 2 AND regexp_matches(line, '^\s*\|?\s*:?-{{3,}}:?\s*(?:\|\s*:?-{{3,}}:?\s*)+\|?\s*$'))),
tc AS (SELECT rid, i, row, CASE WHEN row = '' THEN 0 ELSE length(row) + 1 END AS cost, row_number() OVER (PARTITION BY rid ORDER BY i) AS k FROM tr),
th AS (SELECT rid, row AS head, cost AS hc FROM tc WHERE k = 1),
tt AS (SELECT rid, any_value(head) AS head, any_value(hc) AS hc, list(row ORDER BY k) FILTER (WHERE k > 1) AS rows, list(CAST(c AS BIGINT) ORDER BY k) FILTER (WHERE k > 1) AS sums, max(cost) FILTER (WHERE k > 1) AS most, count(*) - 1 AS n
  FROM (SELECT *, sum(CASE WHEN k > 1 THEN cost ELSE 0 END) OVER (PARTITION BY rid ORDER BY k) AS c FROM tc) JOIN th USING (rid) GROUP BY rid),
tf AS (SELECT * FROM tt WHERE hc + coalesce(most, 0) <= 1201),
tp(rid, a, b) AS (SELECT rid, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM tf UNION ALL SELECT t.rid, p.b, CAST(len(list_filter(t.sums, lambda x: x <= CASE WHEN p.b = 0 THEN 0 ELSE t.sums[p.b] END + 1201 - t.hc)) AS BIGINT) FROM tp p JOIN tf t ON t.rid = p.rid WHERE p.b < t.n),
lu AS (SELECT rid, regexp_extract_all(text, {_UNITS}) AS us FROM e ANTI JOIN tf USING (rid) WHERE kind NOT IN ('image', 'code') AND n > 1200),
lx AS (SELECT rid, generate_subscripts(us, 1) AS i, length(unnest(us)) AS l FROM lu),
z AS (SELECT rid, list(l ORDER BY i) AS ls, list(CAST(e AS BIGINT) ORDER BY i) AS es, count(*) AS n, list(i ORDER BY i) FILTER (WHERE l > 1200) AS bigs FROM (SELECT *, sum(l) OVER (PARTITION BY rid ORDER BY i) AS e FROM lx) GROUP BY rid),
r(rid, k, a, b, win, i, s) AS (SELECT rid, 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM z
  UNION ALL SELECT rid, k + 1, CASE WHEN big THEN es[i] - ls[i] ELSE s END, es[j], big, j + 1, CASE WHEN big OR j = n THEN es[j] ELSE greatest(s, es[j] - greatest(0, least(120, 1200 - ls[j + 1]))) END FROM (
    SELECT rid, k, i, s, z.es, z.ls, z.n, z.ls[i] > 1200 AS big, CAST(CASE WHEN z.ls[i] > 1200 THEN i ELSE least(len(list_filter(z.es, lambda x: x <= s + 1200)), coalesce(list_min(list_filter(z.bigs, lambda x: x >= i)), z.n + 1) - 1) END AS BIGINT) AS j FROM r JOIN z USING (rid) WHERE i <= z.n)),
sp AS (SELECT rid, k, a, b, win, k = max(k) OVER (PARTITION BY rid) AS last FROM r WHERE k > 0),
p AS (SELECT rid, 0 AS k, 0 AS pos, text AS piece FROM e WHERE kind = 'image' OR n <= 1200
  UNION ALL SELECT rid, 0, x, substr(text, CAST(x + 1 AS BIGINT), 1200) FROM (SELECT rid, text, unnest(range(0, n, 1200)) AS x FROM e WHERE kind = 'code' AND n > 1200)
  UNION ALL SELECT rid, 0, a, array_to_string(list_filter([head] || rows[a + 1:b], lambda x: x <> ''), chr(10)) FROM tp JOIN tf USING (rid) WHERE b > 0
  UNION ALL SELECT rid, 0, 0, head FROM tf WHERE n = 0
  UNION ALL SELECT rid, k, x, substr(text, CAST(x + 1 AS BIGINT), CAST(least(x + 1200, b) - x AS BIGINT)) FROM (SELECT rid, k, b, unnest(range(a, b, 1080)) AS x FROM sp WHERE win) JOIN e USING (rid)
  UNION ALL SELECT * FROM (SELECT rid, k, a, {_STRIP.format('substr(text, a + 1, b - a)')} AS piece FROM sp JOIN e USING (rid) WHERE NOT win AND NOT (last AND {_STRIP.format('substr(text, a + 1, b - a)')} = '')))"""


@query("d11_pieces", f"{_PIECES} SELECT doc_id, block, kind, row_number() OVER (PARTITION BY rid ORDER BY k, pos) - 1 AS part, count(*) OVER (PARTITION BY rid) AS n_parts, md5(piece) AS digest FROM p JOIN e USING (rid)")
def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every block: whole ones, texts cut at sentences or by windows, code by windows, tables by rows below their first."""
    return C.pieces(_sectioned(spark, sf)).select("doc_id", "block", "kind", F.col("part").cast("long").alias("part"), F.col("n_parts").cast("long").alias("n_parts"), F.md5("piece").alias("digest"))


@query("j2_chunk_lineage", f"""WITH {_SECTIONED}, k AS (SELECT *, kind || ':' || md5(text) AS lineage FROM sb WHERE kind <> 'heading')
SELECT doc_id, section, string_agg(lineage, ',' ORDER BY block) AS lineage_ids, count(*) FILTER (WHERE kind = 'image') AS images FROM k GROUP BY doc_id, section""")
def chunk_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Each section as one chunk, with the lineage ids of its blocks in order and its images."""
    b = _sectioned(spark, sf).filter("kind != 'heading'").withColumn("lineage_id", F.concat_ws(":", "kind", F.md5("text")))
    whole = b.groupBy("doc_id", "section").agg(F.sort_array(F.collect_list("block")).alias("blocks")).withColumn("chunk", F.lit(0))
    c = C.citations(whole, b)
    return c.select("doc_id", "section", F.array_join("lineage_ids", ",").alias("lineage_ids"), F.size("images").cast("long").alias("images"))


_HTML = """'<table><tr><th rowspan="2">' || coalesce(source, '') || '<th colspan=' || (1 + doc_id % 3) || '>a &amp; b</th></tr><tr><td>' || doc_id || ' <b>x</b></td></tr><tr><td>' || coalesce(lang, '') || '</td></tr></table>'"""


def _html() -> Column:
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit('<table><tr><th rowspan="2">'), s("source"), F.lit("<th colspan="), (1 + F.col("doc_id") % 3).cast("string"), F.lit(">a &amp; b</th></tr><tr><td>"), s("doc_id"), F.lit(" <b>x</b></td></tr><tr><td>"), s("lang"), F.lit("</td></tr></table>"))


@query("g18_table_rows", """WITH t AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, repeat(' | ', CAST(doc_id % 3 AS INTEGER)) AS pad FROM documents)
SELECT doc_id, s || ' | a & b' || pad || chr(10) || s || ' | ' || doc_id || ' x' || pad || chr(10) || l || ' | ' || pad AS rows FROM t""")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Spans down repeat a cell's text, spans across leave blanks."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(H.html_table(_html())["rows"], "\n").alias("rows"))


@query("g17_table_cells", """SELECT doc_id, 4 AS n, CAST(2 + 1 + doc_id % 3 + 1 + 1 AS BIGINT) AS area, '0.0 0.1 1.1 2.0' AS places, CAST(2 AS BIGINT) AS headers FROM documents""")
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select("doc_id", H.html_table(_html())["cells"].alias("c"))
    place = F.transform("c", lambda x: F.concat_ws(".", x["row"], x["col"]))
    area = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + (x["row_span"] * x["col_span"]).cast("long"))
    return c.select("doc_id", F.size("c").alias("n"), area.alias("area"), F.array_join(place, " ").alias("places"), F.size(F.filter("c", lambda x: x["header"])).cast("long").alias("headers"))


@query("g19_pipe_rows", f"WITH {_B} SELECT doc_id, block, CAST(len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[|: -]*---[|: -]*$'))) AS BIGINT) AS n, trim(string_split(trim(string_split(text, chr(10))[1], '| '), '|')[1]) AS first FROM bl WHERE kind = 'table' AND regexp_matches(text, '^\\| ')")
def pipe_rows(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf).filter((F.col("kind") == "table") & F.col("text").rlike(r"^\| ")).select("doc_id", "block", H.pipe_rows(F.col("text")).alias("r"))
    return b.select("doc_id", "block", F.size("r").cast("long").alias("n"), F.get(F.get("r", F.lit(0)), F.lit(0)).alias("first"))


# Two revisions of each document's lines: one line in five is another, one in seven is gone, later ones move up.
_L = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT doc_id, position, line AS text, position // 3 AS page, doc_id || ':' || (position // 3) AS uid FROM l),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS position, CASE WHEN position % 5 = 1 THEN line || ' new' ELSE line END AS text, position AS was FROM l WHERE position % 7 <> 2)"""


def _revisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = D.lines(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.col("position").cast("long").alias("position"), F.col("line").alias("text"))
    edited = F.when(F.col("position") % 5 == 1, F.concat("text", F.lit(" new"))).otherwise(F.col("text"))
    kept = lines.filter("position % 7 <> 2")
    place = (F.col("position") - F.floor((F.col("position") + 4) / 7)).cast("long")  # less the lines that went before
    return lines.withColumn("was", F.col("position")), kept.select("doc_id", place.alias("position"), edited.alias("text"), F.col("position").alias("was"))


@query("j10_page_moves", f"""WITH {_L}, b AS (SELECT doc_id, uid, min(page) AS number FROM o GROUP BY ALL), a AS (SELECT doc_id, doc_id || ':' || (was // 3) AS uid, min(position // 3) AS number FROM n GROUP BY ALL)
SELECT doc_id, uid AS page_uid, CAST(b.number AS BIGINT) AS before_number, CAST(a.number AS BIGINT) AS after_number FROM b JOIN a USING (doc_id, uid) WHERE b.number <> a.number""")
def page_moves(spark: SparkSession, sf: str) -> DataFrame:
    pages = []
    for rows in _revisions(spark, sf):
        uid = F.concat_ws(":", "doc_id", F.floor(F.col("was") / 3))
        pages.append(rows.groupBy("doc_id", uid.alias("page_uid")).agg(F.min(F.floor(F.col("position") / 3)).alias("number")))
    return R.page_moves(*pages)


# Blocks of both revisions: digests as texts, so that only what was edited is alike; the section is given by the first letter of the line, every ninth line is furniture.
_A = _L + r""",
ob AS (SELECT doc_id, position, md5(text) AS text, md5(text) AS base, left(text, 1) AS path, CASE WHEN position % 9 = 4 THEN 'furniture' ELSE 'body' END AS layer, CASE WHEN doc_id % 4 > 0 THEN page END AS page, md5(text) || (position % 3) || page AS id FROM o),
nb AS (SELECT doc_id, position, CASE WHEN was % 5 = 1 THEN md5(left(text, -4)) || ' new' ELSE md5(text) END AS text, CASE WHEN was % 5 = 1 THEN md5(left(text, -4)) ELSE md5(text) END AS base, left(text, 1) AS path, CASE WHEN was % 9 = 4 THEN 'furniture' ELSE 'body' END AS layer,
  CASE WHEN doc_id % 4 > 0 THEN position // 3 END AS page, (CASE WHEN was % 5 = 1 THEN md5(left(text, -4)) || ' new' ELSE md5(text) END) || (position % 3) || (position // 3) AS id FROM n),
pg AS (SELECT doc_id, position // 3 AS after, min(was) // 3 AS before FROM n WHERE doc_id % 4 > 0 AND (position // 3) % 4 <> 3 GROUP BY doc_id, position // 3),
pm AS (SELECT * FROM pg QUALIFY count(*) OVER (PARTITION BY doc_id, before) = 1),
s AS (SELECT a.doc_id, a.position AS old, b.position AS new FROM ob a JOIN nb b USING (doc_id, id) LEFT JOIN pm ON pm.doc_id = a.doc_id AND pm.before = a.page AND pm.after = b.page WHERE a.layer = b.layer AND a.text = b.text AND (a.doc_id % 3 = 0 OR pm.doc_id IS NOT NULL)),
sa AS (SELECT *, count(*) OVER (PARTITION BY doc_id, path, text) AS times FROM ob WHERE layer = 'body'), sb AS (SELECT *, count(*) OVER (PARTITION BY doc_id, path, text) AS times FROM nb WHERE layer = 'body'),
u AS (SELECT a.doc_id, a.position AS old, b.position AS new FROM sa a JOIN sb b USING (doc_id, path, text) WHERE a.times = 1 AND b.times = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = a.doc_id AND (s.old = a.position OR s.new = b.position))),
f AS (SELECT a.doc_id, a.position AS old, b.position AS new FROM sa a JOIN sb b USING (doc_id, path, base) LEFT JOIN pm ON pm.doc_id = b.doc_id AND pm.after = b.page
  WHERE NOT (a.text = b.text AND greatest(a.times, b.times) > 1) AND coalesce(a.page = coalesce(pm.before, -1), true) AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM s UNION ALL SELECT * FROM u) m WHERE m.doc_id = a.doc_id AND (m.old = a.position OR m.new = b.position))),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, old) AS x, count(*) OVER (PARTITION BY doc_id, new) AS y FROM f),
al AS (SELECT doc_id, old, new, 'same_place' AS rule FROM s UNION ALL SELECT doc_id, old, new, 'unique_signature' FROM u UNION ALL SELECT doc_id, old, new, 'fuzzy' FROM c WHERE x = 1 AND y = 1)"""


def _block_revisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Old blocks, new blocks, pages that correspond."""
    sides = []
    for edited, rows in zip((False, True), _revisions(spark, sf), strict=True):
        page = F.floor(F.col("position") / 3)
        text = F.when(F.lit(edited) & (F.col("was") % 5 == 1), F.concat(F.md5(F.regexp_replace("text", r" new\z", "")), F.lit(" new"))).otherwise(F.md5("text"))
        none = F.lit(None).cast("string")
        source = F.when(F.col("doc_id") % 3 == 0, F.lit("same")).otherwise(F.lit(str(edited)))
        layer = F.when(F.col("was") % 9 == 4, "furniture").otherwise("body")
        sides.append(rows.select("doc_id", "position", "was", F.concat(text, (F.col("position") % 3).cast("string"), page.cast("string")).alias("block_id"), source.alias("source_hash"), F.lit("paragraph").alias("kind"), layer.alias("layer"), F.array(F.left("text", F.lit(1))).alias("title_path"), text.alias("text"), none.alias("image_hash"), none.alias("table_html"), F.when(F.col("doc_id") % 4 > 0, page).alias("page")))
    from pyspark.sql.window import Window

    p = sides[1].filter("page IS NOT NULL").groupBy("doc_id", F.col("page").alias("after_number")).agg(F.floor(F.min("was") / 3).alias("before_number")).filter("after_number % 4 != 3")
    pages = p.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id", "before_number"))).filter("_n = 1").drop("_n")
    return (*sides, pages)


@query("d7_alignment", f"WITH {_A} SELECT doc_id, CAST(old AS BIGINT) AS old, CAST(new AS BIGINT) AS new, rule FROM al")
def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of two revisions by all three rules, with and without pages, from equal and from other source bytes."""
    return R.aligned(*_block_revisions(spark, sf))


_SEEDED = f"""{_A}, oi AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id, text) = 1 THEN 'u' || text ELSE 'p' || position END AS lid FROM ob), ni AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY doc_id, text) = 1 AND position % 4 > 0 THEN 'u' || text ELSE 'p' || position END AS lid FROM nb),
m AS (SELECT ni.*, oi.lid AS was FROM ni LEFT JOIN al ON al.doc_id = ni.doc_id AND al.new = ni.position LEFT JOIN oi ON oi.doc_id = al.doc_id AND oi.position = al.old),
k AS (SELECT *, coalesce(was, lid) AS l, row_number() OVER (PARTITION BY doc_id, coalesce(was, lid) ORDER BY was IS NULL, position) AS n FROM m)"""


@query("d7_inherited_ids", f"""WITH {_SEEDED} SELECT doc_id, CAST(position AS BIGINT) AS position, CASE WHEN was IS NOT NULL OR n = 1 THEN l ELSE 'lin_' || substr(sha256('["' || doc_id || '","unmatched","r2","' || id || '","0"]'), 1, 24) END AS lineage_id FROM k""")
def inherited_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Lineage ids after an alignment: inherited ones, free ones, and new ones where a block's own is taken (positions as seeds make that frequent)."""
    from pyspark.sql.window import Window

    old, new, pages = _block_revisions(spark, sf)
    alone = F.count("*").over(Window.partitionBy("doc_id", "text")) == 1
    by_place = F.concat(F.lit("p"), F.col("position").cast("string"))
    old = old.withColumn("lineage_id", F.when(alone, F.concat(F.lit("u"), "text")).otherwise(by_place))
    new = new.withColumn("lineage_id", F.when(alone & (F.col("position") % 4 > 0), F.concat(F.lit("u"), "text")).otherwise(by_place))
    return R.inherited(new, old, R.aligned(old, new, pages), F.lit("r2")).select("doc_id", "position", "lineage_id")


@query("t10_revision_sets", f"""WITH {_L}, a AS (SELECT doc_id, position AS lineage, text, position // 3 AS section FROM o), b AS (SELECT doc_id, was AS lineage, text, position // 3 AS section FROM n),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.lineage, b.lineage) AS lineage, a.text AS x, b.text AS y, a.section AS s, b.section AS t FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.lineage = b.lineage)
SELECT doc_id, coalesce(string_agg(CAST(lineage AS VARCHAR), ',' ORDER BY lineage) FILTER (WHERE x = y), '') AS unchanged, coalesce(string_agg(CAST(lineage AS VARCHAR), ',' ORDER BY lineage) FILTER (WHERE x <> y), '') AS modified,
 coalesce(string_agg(CAST(lineage AS VARCHAR), ',' ORDER BY lineage) FILTER (WHERE y IS NULL), '') AS removed, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL AND s <> t) AS moved FROM j GROUP BY doc_id""")
def revision_sets(spark: SparkSession, sf: str) -> DataFrame:
    old, new = (r.select("doc_id", F.col("was").alias("lineage_id"), F.col("text").alias("signature"), F.floor(F.col("position") / 3).alias("section")) for r in _revisions(spark, sf))
    d = R.difference(old, new)
    return d.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("unchanged", "modified", "removed")), F.size("moved").cast("long").alias("moved"))


@query("g2_document_id", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doc_' || substr(sha256('["k' || doc_id || '"]'), 1, 24) ELSE 'doc_' || substr(sha256(coalesce(text, '')), 1, 24) END AS document_id FROM documents""")
def document_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" k"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, "  ")
    return table(spark, sf, "documents").select("doc_id", R.document_id(key, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("document_id"))


@query("d5_parse_action", """WITH s AS (SELECT event_id, ['success', 'partial', 'review_required', 'pending', 'failed', 'failed', 'quarantined', 'odd'][1 + event_id % 8] AS status, 1 + user_id % 3 AS attempt FROM events)
SELECT CASE status WHEN 'success' THEN 'continue' WHEN 'partial' THEN 'continue_with_warnings' WHEN 'review_required' THEN 'manual_review' WHEN 'failed' THEN CASE WHEN attempt < 2 THEN 'retry' ELSE 'quarantine' END WHEN 'quarantined' THEN 'quarantine' ELSE 'stop' END AS action, count(*) AS n FROM s GROUP BY ALL""")
def parse_actions(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("success", "partial", "review_required", "pending", "failed", "failed", "quarantined", "odd")))
    e = table(spark, sf, "events").select(F.get(names, (F.col("event_id") % 8).cast("int")).alias("status"), (1 + F.col("user_id") % 3).alias("attempt"))
    return e.groupBy(R.parse_action(F.col("status"), F.col("attempt"), F.lit(2)).alias("action")).agg(F.count("*").alias("n"))


@query("g3_revision_id", r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM documents), o AS (SELECT doc_id, '[' || string_agg('"' || md5(line) || '"', ',' ORDER BY p) || ']' AS sig FROM l GROUP BY doc_id)
SELECT doc_id, 'rev_' || substr(sha256('["' || doc_id || '","plain","1","' || replace(sig, '"', '\"') || '"]'), 1, 32) AS revision_id FROM o""")
def revision_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.lines(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "position", F.md5("line").alias("signature"))
    return R.revision_id(rows, F.col("doc_id").cast("string"), "plain", "1")


@query("s3_artifact_items", """WITH d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l FROM documents WHERE doc_id % 9 <> 4)
SELECT doc_id, 1 AS page, 0 AS item, 'title' AS type, 'body' AS layer, 'T ' || s AS text FROM d UNION ALL SELECT doc_id, 1, 1, 'page_header', 'furniture', 'head' FROM d UNION ALL SELECT doc_id, 2, 0, 'list', 'body', 'a' || l || chr(10) || 'b' FROM d
UNION ALL SELECT doc_id, 2, 1, 'table', 'body', 'cap' || chr(10) || 'h | ' || s || chr(10) || 'note' FROM d UNION ALL SELECT doc_id, 2, 2, 'image', 'body', 'seen' FROM d WHERE doc_id % 2 = 0""")
def artifact_items(spark: SparkSession, sf: str) -> DataFrame:
    """A parser's artifact per document, as a list or inside an object; every ninth can't be read, blank paragraphs and empty images are dropped."""
    from ..sources import artifacts

    q = lambda c: F.to_json(F.struct(c.alias("content")))
    s, l = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    item = lambda kind, body: F.concat(F.lit(f'{{"type":"{kind}","bbox":[0,0,1,1],"content":'), body, F.lit("}"))
    title = item("title", F.concat(F.lit('{"level":1,"title_content":['), q(F.concat(F.lit("T "), s)), F.lit("]}")))
    head = item("page_header", F.lit('{"page_header_content":[{"content":"head"}]}'))
    blank = item("paragraph", F.lit('{"paragraph_content":[{"content":" "}]}'))
    many = item("list", F.concat(F.lit('{"list_items":[{"item_content":['), q(F.lit("a")), F.lit(","), q(l), F.lit(']},{"item_content":[{"content":"b"}]}]}')))
    cells = item("table", F.concat(F.lit('{"html":"<table><tr><th>h</th><td>'), s, F.lit('</td></tr></table>","table_caption":[{"content":"cap"}],"table_footnote":[{"content":"note"}]}')))
    image = item("image", F.when(F.col("doc_id") % 2 == 0, '{"content":"seen"}').otherwise('{"image_caption":[]}'))
    listed = F.concat(F.lit("[["), title, F.lit(","), head, F.lit(","), blank, F.lit("],["), many, F.lit(","), cells, F.lit(","), image, F.lit("]]"))
    json = F.when(F.col("doc_id") % 9 == 4, F.lit("[[")).when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"pages":'), listed, F.lit("}"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"content":'), listed, F.lit("}"))).otherwise(listed)
    return artifacts.items(table(spark, sf, "documents").select("doc_id", json.alias("json"))).select("doc_id", "page", "item", "type", "layer", "text")
