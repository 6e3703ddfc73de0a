"""Block queries: Markdown structure, alignment, page-index search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import documents as D
from ..operators import fusion
from .registry import query, table

_STRUCTURED = r"""coalesce('## ' || lang, 'intro') || chr(10) || coalesce(text, '') || chr(10) || '| c | d |' || chr(10) || '|---|---|' || chr(10) || '| ' || coalesce(source, '') || ' | 1 |' || chr(10) || chr(10)
 || CASE WHEN doc_id % 3 = 0 THEN '| x | y |' ELSE '| c | d |' END || chr(10) || '| e | f |' || chr(10) || '![i](http://h/' || doc_id || '.png)' || chr(10) || '```' || chr(10) || 'a | b | c' || chr(10) || '```' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || '# end' || chr(10) || substr(coalesce(text, ''), 1, 60)"""

_B = rf"""
dd AS (SELECT doc_id, {_STRUCTURED} AS text FROM documents),
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, unnest(string_split(text, chr(10))) AS line FROM dd),
f AS (SELECT *, regexp_matches(line, '^ *(?:```|~~~)') AS fence, coalesce(sum(CAST(regexp_matches(line, '^ *(?:```|~~~)') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
t AS (SELECT *, CASE WHEN fence OR before % 2 = 1 THEN 'code' WHEN trim(line, ' ') = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}} +\S') THEN 'heading' WHEN regexp_matches(line, '^ *!\[[^\]]*\]\([^)]*\) *$') THEN 'image'
 WHEN regexp_matches(line, '^[^|]*\|.*\|') THEN 'table' WHEN regexp_matches(line, '^ *(?:[-*+]|\d+[.)]) +\S') THEN 'list' ELSE 'paragraph' END AS kind FROM f),
s AS (SELECT *, kind IN ('heading', 'image', 'blank') OR (fence AND before % 2 = 0) OR lag(kind) OVER (PARTITION BY doc_id ORDER BY position) IS NULL OR lag(kind) OVER (PARTITION BY doc_id ORDER BY position) <> kind AS starts FROM t),
n AS (SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM s),
g AS (SELECT doc_id, b, kind, CAST(min(position) AS BIGINT) AS first, CAST(max(position) AS BIGINT) AS last, string_agg(line, chr(10) ORDER BY position) AS text FROM n WHERE kind <> 'blank' GROUP BY doc_id, b, kind),
bl AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS block, kind, first, last, text FROM g)
"""


def structured(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown: the text between headings, tables, an image, code and a list."""
    t = F.coalesce("text", F.lit(""))
    head = F.coalesce(F.concat(F.lit("## "), "lang"), F.lit("intro"))
    again = F.when(F.col("doc_id") % 3 == 0, "| x | y |").otherwise("| c | d |")
    row = F.concat(F.lit("| "), F.coalesce("source", F.lit("")), F.lit(" | 1 |"))
    image = F.concat(F.lit("![i](http://h/"), F.col("doc_id").cast("string"), F.lit(".png)"))
    parts = [head, t, F.lit("| c | d |"), F.lit("|---|---|"), row, F.lit(""), again, F.lit("| e | f |"), image, F.lit("```"), F.lit("a | b | c"), F.lit("```"), F.lit("- one"), F.lit("- two"), F.lit("# end"), F.substring(t, 1, 60)]
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("\n", *parts).alias("text"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.markdown_blocks(D.lines(structured(spark, sf)))


@query("d1_markdown_blocks", f"WITH {_B} SELECT doc_id, block, kind, first, last, md5(text) AS digest FROM bl")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf).select("doc_id", "block", "kind", "first", "last", F.md5("text").alias("digest"))


@query("j1_section_blocks", f"WITH {_B}, c AS (SELECT doc_id, kind, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block) AS section FROM bl) SELECT doc_id, CAST(section AS BIGINT) AS section, kind, count(*) AS n FROM c GROUP BY ALL")
def section_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return B.sections(_blocks(spark, sf)).groupBy("doc_id", "section", "kind").agg(F.count("*").alias("n"))


@query("j20_continued_tables", f"WITH {_B}, h AS (SELECT *, regexp_extract(text, '^[^\\n]*') AS head FROM bl) SELECT doc_id, block, kind, CASE WHEN kind = 'table' AND lag(kind) OVER w = 'table' AND lag(head) OVER w = head AND trim(head) <> '' THEN block - 1 END AS continues_from FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY block)")
def continued_tables(spark: SparkSession, sf: str) -> DataFrame:
    return B.continued_tables(_blocks(spark, sf)).select("doc_id", "block", "kind", "continues_from")


@query("p6_chunk_eligibility", f"WITH {_B} SELECT doc_id, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM bl WHERE kind <> 'heading' AND (kind = 'image' OR trim(text) <> '') GROUP BY doc_id, kind")
def chunk_eligibility(spark: SparkSession, sf: str) -> DataFrame:
    b = _blocks(spark, sf).filter((F.col("kind") != "heading") & ((F.col("kind") == "image") | (F.trim("text") != "")))
    return b.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("j13_fuzzy_alignment")
def fuzzy_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual best matches among the lines that an edit has changed (one in eight), of any length; a similarity SQL has no function for, tested against a plain loop."""
    rows = D.lines(table(spark, sf, "documents").select("doc_id", "text")).filter("line != ''")
    changed = F.when(F.pmod(F.xxhash64("doc_id", "position"), F.lit(8)) == 0, F.concat("line", F.lit(" revised"))).otherwise(F.col("line"))
    old = rows.select("doc_id", F.col("position").cast("long").alias("position"), F.col("line").alias("text"))
    new = rows.select("doc_id", F.col("position").cast("long").alias("position"), changed.alias("text"))
    # What equals a line of the other revision is matched by exact rules; the rest comes here.
    left = lambda a, b: a.join(b.select("doc_id", "text"), ["doc_id", "text"], "left_anti")
    sides = [left(a, b).select("doc_id", F.lit(n).alias("side"), "position", "text") for a, b, n in ((old, new, "old"), (new, old, "new"))]
    return B.mutual_best(sides[0].union(sides[1]), 0.78)


@query("f2_nfc_normalise", "SELECT doc_id, md5(nfc_normalize(replace(text, chr(13), chr(10)))) AS digest FROM documents")
def nfc(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.unicode import nfc as composed

    return table(spark, sf, "documents").select("doc_id", F.md5(composed(F.replace(F.col("text"), F.lit("\r"), F.lit("\n")))).alias("digest"))


_WORDS = r"regexp_extract_all(lower({0}), '[a-z][a-z0-9_/-]+')"


@query("d20_page_index_search", f"""WITH q AS (SELECT item_id AS query_id, {_WORDS.format('text')} AS qt FROM benchmark WHERE item_id % 20 = 0),
d AS (SELECT doc_id, {_WORDS.format('text')} AS dt FROM documents), dd AS (SELECT doc_id, unnest(list_distinct(dt)) AS w, len(dt) AS n FROM d), qq AS (SELECT query_id, unnest(qt) AS w, len(qt) AS m FROM q),
o AS (SELECT query_id, doc_id, count(*) AS hits, any_value(m) AS m, any_value(n) AS n FROM qq JOIN dd USING (w) GROUP BY query_id, doc_id),
s AS (SELECT query_id, doc_id, round(least(1.0, 0.35 * (hits / greatest(1, m)) * (0.75 + 0.25 * least(1.0, 180.0 / greatest(1, n)))) + 1e-9, 6) AS score FROM o)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 8""")
def page_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves by their share of the question's words, damped for long ones; the question's words are the small side of the join."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z][a-z0-9_/-]+)"), 1)
    q = table(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), words(F.col("text")).alias("t"))
    q = q.select("query_id", F.explode("t").alias("w"), F.size("t").alias("m"))
    d = table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("t")).select("doc_id", F.explode(F.array_distinct("t")).alias("w"), F.size("t").alias("n"))
    met = d.join(q, "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"), F.first("m").alias("m"), F.first("n").alias("n"))
    score = F.least(F.lit(1.0), 0.35 * (F.col("hits") / F.greatest(F.lit(1), F.col("m"))) * (0.75 + 0.25 * F.least(F.lit(1.0), F.lit(180.0) / F.greatest(F.lit(1), F.col("n")))))
    out = fusion.ranked(met.withColumn("score", F.round(score + 1e-9, 6)), ["query_id"], [F.desc("score"), F.col("doc_id")], 8)
    return out.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("f31_evidence_id", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'web:https://host/' || doc_id WHEN lang <> 'en' THEN 'local:' || source || ':section:' || lang
 ELSE 'local:' || source || ':content:' || substr(sha256(substr(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), 1, 1000)), 1, 20) END AS evidence_id FROM documents""")
def evidence_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    url = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("HTTPS://HOST/"), F.col("doc_id").cast("string"), F.lit("/#x")))
    section = F.when(F.col("lang") != "en", F.col("lang"))
    made = F.when(url.isNotNull(), F.concat(F.lit("web:"), T.url_key(url))).when(section.isNotNull(), F.concat(F.lit("local:"), "source", F.lit(":section:"), section)).otherwise(F.concat(F.lit("local:"), "source", F.lit(":content:"), T.fingerprint(F.coalesce("text", F.lit("")))))
    return d.select("doc_id", made.alias("evidence_id"))


@query("g27_lenient_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def lenient_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("p12_image_urls", r"""SELECT page_id, CAST(len(list_distinct(list_filter(regexp_extract_all(html, '(?:src|href)="([^"]*)"', 1), lambda u: regexp_matches(u, '^(?i)https?://[^/?#@\s]+([/?#]\S*)?$')))) AS BIGINT) AS n, CAST(len(regexp_extract_all(html, '(?:src|href)="([^"]*)"', 1)) AS BIGINT) AS total FROM pages""")
def image_urls(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'(?:src|href)="([^"]*)"'), 1)
    return table(spark, sf, "pages").select("page_id", F.size(F.array_distinct(F.filter(found, T.safe_url))).cast("long").alias("n"), F.size(found).cast("long").alias("total"))
