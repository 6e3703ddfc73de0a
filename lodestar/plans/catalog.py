"""Queries on what an import and a query leave behind: entity rows, rewrites, statistics, traces, images, leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import documents as D
from ..operators import images as I
from ..operators import pages
from .registry import query, table

_NAME = "[A-Z][a-z]+"


@query("k8_entity_rows", f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '{_NAME}') AS names FROM documents),
e AS (SELECT doc_id, unnest(names) AS entity_name, generate_subscripts(names, 1) - 1 AS position FROM d)
SELECT doc_id AS chunk_id, entity_name, min(position) AS position, md5(substring(any_value(text), 1, 200)) AS context FROM e JOIN documents USING (doc_id) GROUP BY doc_id, entity_name""")
def entity_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words of each document as its entities."""
    d = table(spark, sf, "documents")
    names = d.select(F.col("doc_id").alias("chunk_id"), F.posexplode(F.regexp_extract_all("text", F.lit(f"({_NAME})"), 1)).alias("position", "name"))
    rows = C.entity_rows(names, d.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    return rows.select("chunk_id", "entity_name", F.col("position").cast("long").alias("position"), F.md5("context").alias("context"))


@query("n1_item_pairs", """SELECT DISTINCT trim(p_brand) AS item_name, trim(CASE WHEN p_size < 5 THEN ' ' ELSE p_name END) AS entity_name FROM part WHERE trim(p_brand) <> '' AND p_size >= 5 AND trim(p_name) <> ''""")
def item_pairs(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_size") < 5, " ").otherwise(F.concat(F.lit(" "), "p_name"))
    return C.pairs(table(spark, sf, "part").select(F.col("p_brand").alias("item_name"), name.alias("aligned")))


_TRIPLES = "SELECT {0} AS item, l_returnflag AS tenant, nullif(l_linestatus, 'O') AS version, l_partkey AS head, l_orderkey AS tail, {1} AS fresh FROM lineitem WHERE l_linenumber {2} 5"


@query("k6_scope_rewrite", f"""WITH cur AS ({_TRIPLES.format('l_suppkey', 'false', '<')}), inc AS ({_TRIPLES.format('l_suppkey', 'true', '>=')})
SELECT * FROM cur WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.item = cur.item AND inc.tenant = cur.tenant AND inc.version IS NOT DISTINCT FROM cur.version) UNION ALL SELECT * FROM inc""")
def scope_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of an item, tenant and version are cleared before new ones of that scope are written."""
    line = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("item"), F.col("l_returnflag").alias("tenant"), F.nullif("l_linestatus", F.lit("O")).alias("version"), F.col("l_partkey").alias("head"), F.col("l_orderkey").alias("tail"))
    part = lambda fresh: line.filter("l_linenumber >= 5" if fresh else "l_linenumber < 5").drop("l_linenumber").withColumn("fresh", F.lit(fresh))
    return C.rewritten(part(False), part(True), ["item", "tenant", "version"])


@query("k5_item_upsert", """WITH cur AS (SELECT 'C' || c_custkey AS document_id, c_name AS item_name, false AS fresh FROM customer),
inc AS (SELECT CASE WHEN c_acctbal >= 0 THEN 'C' || c_custkey WHEN c_acctbal < -500 THEN ' ' END AS document_id, c_name AS item_name, true AS fresh FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT * FROM cur WHERE document_id NOT IN (SELECT document_id FROM inc WHERE trim(document_id) <> '') UNION ALL SELECT * FROM inc""")
def item_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Item names are replaced by document, never by title; those without a document are added."""
    c = table(spark, sf, "customer")
    key = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    current = c.select(key.alias("document_id"), F.col("c_name").alias("item_name"), F.lit(False).alias("fresh"))
    lost = F.when(F.col("c_acctbal") >= 0, key).when(F.col("c_acctbal") < -500, " ")
    return C.upserted(current, c.filter("c_mktsegment = 'BUILDING'").select(lost.alias("document_id"), F.col("c_name").alias("item_name"), F.lit(True).alias("fresh")))


@query("a21_import_stats", """WITH r AS (SELECT o_orderkey, any_value(o_orderstatus) = 'P' AS failed, count(l_partkey) FILTER (l_returnflag <> 'N') AS entities, count(l_partkey) AS relations FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT count(*) FILTER (NOT failed) AS processed_chunks, count(*) FILTER (failed) AS failed_chunks, count(*) FILTER (NOT failed AND entities = 0) AS empty_chunks,
CAST(coalesce(sum(entities) FILTER (NOT failed), 0) AS BIGINT) AS total_entities, CAST(coalesce(sum(relations) FILTER (NOT failed), 0) AS BIGINT) AS total_relations FROM r""")
def import_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as chunks, their lines as relations, returned or accepted ones as entities."""
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("entities"), F.count("l_partkey").alias("relations"))
    rows = table(spark, sf, "orders").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, ["entities", "relations"])
    return C.import_stats(rows.select((F.col("o_orderstatus") == "P").alias("failed"), "entities", "relations"))


@query("p23_state_counts", """SELECT lang, count(*) AS rows, count(*) FILTER (coalesce(text, '') = '') AS blank, count(*) FILTER (contains(text, '|')) AS tables, count(*) FILTER (source IS NULL) AS nameless FROM documents GROUP BY lang""")
def state_counts(spark: SparkSession, sf: str) -> DataFrame:
    conditions = {"blank": F.coalesce("text", F.lit("")) == "", "tables": F.contains("text", F.lit("|")), "nameless": F.col("source").isNull()}
    return C.state_counts(table(spark, sf, "documents"), conditions, ["lang"])


@query("p22_without_payload", "SELECT * EXCLUDE (embedding) FROM embeddings")
def without_payload(spark: SparkSession, sf: str) -> DataFrame:
    return C.without_payload(table(spark, sf, "embeddings"))


@query("p21_trace_rows", """SELECT l_orderkey AS query_id, stage, row_number() OVER (PARTITION BY l_orderkey, stage ORDER BY l_extendedprice DESC, l_linenumber) AS rank, CASE WHEN stage = 'web' THEN 'web' ELSE 'local' END AS source,
CASE WHEN l_linestatus = 'O' THEN 'S' || l_suppkey ELSE 'P' || l_partkey END AS chunk_id, 'P' || l_partkey AS document_id, '' AS title, round(coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, l_discount), 6) AS score, l_quantity AS authority
FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'web' WHEN 'A' THEN 'rerank' ELSE 'direct' END AS stage FROM lineitem)""")
def trace_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as candidates of their order, return flags as stages."""
    flag = F.col("l_returnflag")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.when(flag == "R", "web").when(flag == "A", "rerank").otherwise("direct").alias("stage"), "l_extendedprice", "l_linenumber",
        F.when(F.col("l_linestatus") == "O", text("S", "l_suppkey")).alias("stable_id"), text("P", "l_partkey").alias("chunk_id"), text("P", "l_partkey").alias("document_id"),
        F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("distance"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("authority"),
    )
    out = C.trace_rows(rows, ["query_id"], "stage", [F.desc("l_extendedprice"), F.col("l_linenumber")])
    return out.select("query_id", "stage", "rank", "source", "chunk_id", "document_id", "title", "score", "authority")


@query("t11_tree_summary", """SELECT source AS tree, doc_id AS node_id, lang AS title, CAST(len(string_split(text, chr(10))) AS BIGINT) AS child_count, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 80""")
def tree_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as trees, documents as nodes, lines as children; the first 80 nodes are the feature."""
    nodes = table(spark, sf, "documents").select(F.col("source").alias("tree"), F.col("doc_id").alias("node_id"), F.col("lang").alias("title"), "text")
    rows = C.tree_summary(nodes.select("tree", "node_id", "title", F.size(F.split("text", "\n")).cast("long").alias("child_count")), "tree", [F.col("node_id")])
    return rows.withColumn("rank", F.col("rank").cast("long"))


_CHECKS = ("runtime_preflight_passed", "provider_error_empty", "kg_stage_status_ok", "kg_retrieval_count_positive", "kg_trace_nonempty", "kg_trace_has_document_lineage", "kg_trace_has_graph_source_type", "versioned_graph_selected", "versioned_entity_collection_selected")


@query("e10_probe_assertions", f"""WITH g AS (SELECT l_orderkey, bool_and(l_tax > 0) AS lineage, bool_and(l_linestatus = 'F') AS typed FROM lineitem WHERE l_discount > 0.03 GROUP BY l_orderkey),
c AS (SELECT o_orderkey AS probe_id, o_orderstatus <> 'P' AS runtime_preflight_passed, o_totalprice < 400000 AS provider_error_empty, o_orderpriority <> '5-LOW' AS kg_stage_status_ok, o_custkey > 10 AS kg_retrieval_count_positive,
g.lineage IS NOT NULL AS kg_trace_nonempty, coalesce(lineage, false) AS kg_trace_has_document_lineage, coalesce(typed, false) AS kg_trace_has_graph_source_type, o_orderpriority <> '3-MEDIUM' AS versioned_graph_selected, o_orderstatus <> 'O' AS versioned_entity_collection_selected
FROM orders LEFT JOIN g ON l_orderkey = o_orderkey) SELECT *, {' AND '.join(_CHECKS)} AS passed FROM c""")
def probe_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as probes, their discounted lines as graph rows."""
    probes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("probe_id"), (F.col("o_orderstatus") != "P").alias("preflight"), F.when(F.col("o_totalprice") >= 400000, "timeout").alias("error"),
        F.when(F.col("o_orderpriority") != "5-LOW", "ok").alias("status"), F.when(F.col("o_custkey") > 10, F.col("o_custkey")).alias("hits"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "legacy").otherwise("v2").alias("graph_version"), F.when(F.col("o_orderstatus") != "O", "entities").alias("entity_collection"),
    )
    rows = table(spark, sf, "lineitem").filter("l_discount > 0.03").select(
        F.col("l_orderkey").alias("probe_id"), F.col("l_partkey").alias("document_id"), F.when(F.col("l_tax") > 0, F.col("l_suppkey")).alias("section_id"), F.when(F.col("l_linestatus") == "F", "knowledge_graph").alias("source_type"))
    return C.probe_assertions(probes, rows)


@query("k16_promotion_faults", """SELECT o_orderkey AS report_id, array_to_string(list_filter([CASE WHEN o_orderpriority = '5-LOW' THEN 'scope' END, CASE WHEN o_orderstatus = 'P' THEN 'rag_quality' END,
CASE WHEN o_totalprice > 200000 AND o_custkey % 2 = 0 THEN 'snapshot' END, CASE WHEN n = 0 THEN 'no_results' END], lambda x: x IS NOT NULL), ',') AS faults
FROM (SELECT o.*, coalesce(n, 0) AS n FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) ON l_orderkey = o_orderkey)""")
def promotion_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as reports, their returned or accepted lines as results."""
    per = table(spark, sf, "lineitem").filter("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.count("*").alias("n_results"))
    rows = table(spark, sf, "orders").join(per, F.col("l_orderkey") == F.col("o_orderkey"), "left").fillna(0, ["n_results"]).select(
        F.col("o_orderkey").alias("report_id"), F.when(F.col("o_orderpriority") == "5-LOW", "retrieval").otherwise("full_pipeline").alias("evaluation_scope"), (F.col("o_orderstatus") != "P").alias("rag_quality"),
        (F.col("o_totalprice") > 200000).alias("snapshot_requested"), (F.col("o_custkey") % 2 == 1).alias("snapshot_written"), "n_results")
    return rows.select("report_id", F.array_join(C.promotion_faults(), ",").alias("faults"))


@query("k1_canonical_json", """SELECT doc_id, json_merge_patch('{}', json_object('doc_id', doc_id, 'lang', nullif(lang, 'fr'), 'n_chars', n_chars, 'source', source))::VARCHAR AS json FROM documents""")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("lang", F.nullif("lang", F.lit("fr")))
    return d.select("doc_id", C.canonical_json("source", "n_chars", "lang", "doc_id").alias("json"))


@query("u8_struct_dedupe", """WITH f AS (SELECT l_orderkey, l_returnflag, l_linestatus, min(l_linenumber) AS place FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ',' ORDER BY place, l_returnflag, l_linestatus) AS kinds, count(*) AS n FROM f GROUP BY l_orderkey""")
def struct_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct kinds of an order's lines, in the order in which they first occur."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.struct("l_returnflag", "l_linestatus").alias("kind")))).getField("kind").alias("kinds"))
    once = lists.select("l_orderkey", F.array_distinct("kinds").alias("kinds"))
    return once.select("l_orderkey", F.array_join(F.transform("kinds", lambda k: F.concat(k["l_returnflag"], k["l_linestatus"])), ",").alias("kinds"), F.size("kinds").cast("long").alias("n"))


@query("u7_block_union", """WITH l AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber, l_suppkey) AS place FROM lineitem),
f AS (SELECT l_orderkey, l_suppkey, min(place) AS place FROM l GROUP BY ALL) SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY place) AS blocks FROM f GROUP BY l_orderkey""")
def block_union(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of two merged parts, the returned lines' before the others', each once where it first occurs."""
    ids = lambda mine: F.sort_array(F.collect_list(F.when(mine, F.struct("l_linenumber", "l_suppkey")))).getField("l_suppkey")
    sides = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(ids(F.col("l_returnflag") == "R").alias("a"), ids(F.col("l_returnflag") != "R").alias("b"))
    return sides.select("l_orderkey", F.array_join(F.array_distinct(F.concat("a", "b")).cast("array<string>"), ",").alias("blocks"))


@query("v6_embedding_texts", "SELECT doc_id, md5(coalesce(source, '') || chr(10) || coalesce(text, '')) AS digest FROM documents")
def embedding_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What an embedding model is given of a chunk: its item, a line break, its text."""
    return table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("digest"))


@query("g28_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("stamp"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


_LINKED = "'![old](images/pic' || doc_id || '.png)' || chr(10) || coalesce(text, '') || ' ![x [y]](../IMAGES/PIC' || doc_id || '.PNG \"t\") ![z](images/other.png)'"


@query("f24_image_links", f"""SELECT doc_id, md5(CASE WHEN source IS NULL THEN v ELSE regexp_replace(v, '!\\[.*?\\]\\([^)]*pic' || doc_id || '\\.png[^)]*\\)', '![about   ' || lang || '   $1](https://img.example/' || doc_id || '.png)', 'gi') END) AS digest
FROM (SELECT doc_id, coalesce(lang, '') AS lang, source, {_LINKED} AS v FROM documents)""")
def image_links(spark: SparkSession, sf: str) -> DataFrame:
    """Two links of one image and one of another around each document's text; a document without a source has no new link."""
    name = F.concat(F.lit("pic"), F.col("doc_id").cast("string"), F.lit(".png"))
    url = F.when(F.col("source").isNotNull(), F.concat(F.lit("https://img.example/"), F.col("doc_id").cast("string"), F.lit(".png")))
    summary = F.concat(F.lit(" about [("), F.coalesce("lang", F.lit("")), F.lit(")] $1\n"))
    d = table(spark, sf, "documents").withColumn("v", F.expr(_LINKED.replace("chr(10)", "'\\n'")))
    return d.select("doc_id", F.md5(I.relinked(F.col("v"), name, url, summary)).alias("digest"))


_ILLUSTRATED = "'# About ' || doc_id || chr(10) || chr(10) || coalesce(text, '') || chr(10) || '![fig](images/fig.png)' || chr(10) || coalesce(text, '')"


@query("f25_image_context", f"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS position FROM (SELECT doc_id, string_split({_ILLUSTRATED}, chr(10)) AS s FROM documents)),
m AS (SELECT *, contains(line, '(images/fig.png)') AS im, regexp_matches(line, '^#{{1,6}}\\s+') AS hd, regexp_replace(line, '\\s+', '', 'g') = '' AS blank FROM l),
b AS (SELECT *, blank OR im OR hd OR regexp_matches(trim(line), '^!\\[.*?\\]\\(.*?\\)') AS br FROM m),
p AS (SELECT *, sum(br::INT) OVER w AS par, sum(hd::INT) OVER w AS sec, last_value(CASE WHEN hd THEN trim(line) END IGNORE NULLS) OVER w AS heading FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING)),
t AS (SELECT doc_id, sec, min(position) AS place, trim(string_agg(line, chr(10) ORDER BY position)) AS t FROM p WHERE NOT br GROUP BY doc_id, sec, par),
j AS (SELECT p.doc_id, p.position, p.heading, place, t, place < position AS above, row_number() OVER v AS nth, sum(length(t)) OVER v AS used FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND t.sec = p.sec WHERE im WINDOW v AS (PARTITION BY p.doc_id, p.position, place < position ORDER BY abs(place - position)))
SELECT doc_id, position, any_value(heading) AS heading, md5(coalesce(string_agg(t, chr(10) ORDER BY place) FILTER (above), '')) AS before, md5(coalesce(string_agg(t, chr(10) ORDER BY place) FILTER (NOT above), '')) AS after
FROM j WHERE nth = 1 OR used <= 200 GROUP BY doc_id, position""")
def image_context(spark: SparkSession, sf: str) -> DataFrame:
    """An image between two copies of each document's text, under a heading."""
    d = table(spark, sf, "documents").select("doc_id", F.expr(_ILLUSTRATED.replace("chr(10)", "'\\n'")).alias("text"))
    out = I.surroundings(D.lines(d), F.contains("line", F.lit("(images/fig.png)")))
    return out.select("doc_id", F.col("position").cast("long").alias("position"), "heading", F.md5("before").alias("before"), F.md5("after").alias("after"))


_TOK, _IDENT = "regexp_extract_all(lower(trim(coalesce({0}, ''))), '[a-z0-9][a-z0-9_./:-]*')", "list_distinct(list_transform(regexp_extract_all({0}, '(?i)[a-z]{{1,12}}[-_ ]?\\d+[a-z0-9_-]*|\\b\\d{{2,}}[a-z]?\\b'), lambda x: lower(x)))"


@query("d20_leaf_search", f"""WITH qs AS (SELECT 'item ' || item_id AS query_id, trim(text) AS question FROM benchmark WHERE item_id % 20 = 0 UNION ALL SELECT DISTINCT source, 'notes of ' || source FROM documents WHERE source IS NOT NULL),
q AS (SELECT *, {_TOK.format('question')} AS t, {_IDENT.format('question')} AS i FROM qs), d AS (SELECT doc_id, text, source || ' ' || lang AS title, {_TOK.format('text')} AS t, {_IDENT.format("concat_ws(' ', text, source || ' ' || lang)")} AS i FROM documents WHERE text <> ''),
qb AS (SELECT query_id, unnest(t) AS w FROM q), qi AS (SELECT query_id, unnest(i) AS w FROM q), db AS (SELECT doc_id, unnest(list_distinct(t)) AS w FROM d), dt AS (SELECT doc_id, unnest(list_distinct({_TOK.format('title')})) AS w FROM d), di AS (SELECT doc_id, unnest(i) AS w FROM d),
h AS (SELECT query_id, doc_id, 'b' AS kind FROM qb JOIN db USING (w) UNION ALL SELECT query_id, doc_id, 't' FROM qb JOIN dt USING (w) UNION ALL SELECT query_id, doc_id, 'i' FROM qi JOIN di USING (w)
UNION ALL SELECT query_id, doc_id, 'p' FROM q JOIN d ON contains(lower(text), lower(question)) OR contains(lower(title), lower(question))),
s AS (SELECT query_id, doc_id, count(*) FILTER (kind = 'b') AS b, count(*) FILTER (kind = 't') AS t, count(*) FILTER (kind = 'i') AS i, count(*) FILTER (kind = 'p') AS p FROM h GROUP BY ALL),
z AS (SELECT query_id, doc_id AS node_id, round(least(1.0, 0.35 * (s.b / len(q.t)) * (0.75 + 0.25 * least(1.0, 180.0::DOUBLE / greatest(1, len(d.t)))) + 0.12::DOUBLE * least(1.0::DOUBLE, s.t / len(q.t)) + 0.3::DOUBLE * least(1.0::DOUBLE, s.i / greatest(1, len(q.i))) + CASE WHEN p > 0 THEN 0.2::DOUBLE ELSE 0 END) + 1e-9, 6) AS score
FROM s JOIN q USING (query_id) JOIN d USING (doc_id)) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM z QUALIFY rank <= 8""")
def leaf_search(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items and sources' names, asked of documents under the titles of their source and language."""
    d = table(spark, sf, "documents")
    items = table(spark, sf, "benchmark").filter("item_id % 20 = 0").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("question"))
    sources = d.filter("source IS NOT NULL").select("source").distinct().select(F.col("source").alias("query_id"), F.concat(F.lit("notes of "), "source").alias("question"))
    leaves = d.select(F.col("doc_id").alias("node_id"), F.concat("source", F.lit(" "), "lang").alias("title"), "text")
    return pages.search(items.union(sources), leaves).withColumn("rank", F.col("rank").cast("long"))
