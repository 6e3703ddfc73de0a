"""Entity rows, rewrites, statistics, traces, images and leaf search on small tables."""

from pyspark.sql import functions as F

from lodestar.operators import catalog as C
from lodestar.operators import images as I
from lodestar.operators import pages


def test_entity_rows_keep_the_first_name_and_the_head_of_the_chunk(spark):
    entities = spark.createDataFrame([("c", 0, " a "), ("c", 1, "b"), ("c", 2, "a"), ("c", 3, "  "), ("c", 4, None)], "chunk_id string, position int, name string")
    chunks = spark.createDataFrame([("c", "x" * 300)], "chunk_id string, content string")
    rows = C.entity_rows(entities, chunks).orderBy("position").collect()
    assert [(r.entity_name, r.position, len(r.context)) for r in rows] == [("a", 0, 200), ("b", 1, 200)]


def test_rewrite_clears_scopes_with_nulls(spark):
    now = spark.createDataFrame([("a", None, 1), ("a", "v", 2), ("b", None, 3)], "item string, version string, x int")
    new = spark.createDataFrame([("a", None, 9)], "item string, version string, x int")
    assert sorted(r.x for r in C.rewritten(now, new, ["item", "version"]).collect()) == [2, 3, 9]
    assert C.rewritten(now, new.limit(0), ["item", "version"]).count() == 3


def test_upsert_without_identity_deletes_nothing(spark):
    now = spark.createDataFrame([("a", 1), (None, 2), ("", 3)], "document_id string, x int")
    new = spark.createDataFrame([("a", 4), (None, 5), ("", 6)], "document_id string, x int")
    assert sorted(r.x for r in C.upserted(now, new).collect()) == [2, 3, 4, 5, 6]


def test_import_stats_of_nothing_and_of_failures(spark):
    rows = spark.createDataFrame([(False, 2, 1), (True, 5, 5), (False, 0, 3)], "failed boolean, entities long, relations long")
    assert tuple(C.import_stats(rows).first()) == (2, 1, 1, 2, 4)
    assert tuple(C.import_stats(rows.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_trace_rows_fill_what_is_missing(spark):
    rows = spark.createDataFrame([("q", "web", 2, None, "0.25"), ("q", "web", 1, "c1", "nan"), ("q", "kg", 1, "c2", "x")], "query_id string, stage string, at int, chunk_id string, score string")
    got = {(r.stage, r.rank): r for r in C.trace_rows(rows, ["query_id"], "stage", [F.col("at")]).collect()}
    assert len(got["kg", 1]) == 30
    assert (got["web", 2].chunk_id, got["web", 2].score, got["web", 2].source, got["web", 2].block_ids) == ("", 0.25, "web", [])
    assert got["web", 1].score is None and got["kg", 1].score is None and got["kg", 1].source == "local"


def test_payload_goes_and_the_rest_stays(spark):
    rows = spark.createDataFrame([(1, [1.0], {1: 2.0}, ["a"])], "id int, dense array<float>, sparse map<int,double>, tags array<string>")
    assert C.without_payload(rows).columns == ["id", "tags"]


def test_probe_without_rows_fails_on_rows_only(spark):
    probes = spark.createDataFrame([(1, True, None, "ok", 2, "v2", "e"), (2, True, "", "ok", 2, "v2", "e")], "probe_id int, preflight boolean, error string, status string, hits int, graph_version string, entity_collection string")
    rows = spark.createDataFrame([(2, "d", "s", "knowledge_graph")], "probe_id int, document_id string, section_id string, source_type string")
    got = {r.probe_id: r for r in C.probe_assertions(probes, rows).collect()}
    assert got[2].passed and not got[1].passed
    assert [n for n in got[1].asDict() if got[1][n] is False] == ["kg_trace_nonempty", "kg_trace_has_document_lineage", "kg_trace_has_graph_source_type", "passed"]


def test_canonical_json(spark):
    rows = spark.createDataFrame([(1, None, "x")], "b int, c string, a string")
    assert rows.select(C.canonical_json("b", "c", "a").alias("j")).first().j == '{"a":"x","b":1}'


def test_links_are_rewritten_literally(spark):
    rows = spark.createDataFrame([("![a](x/P+1.png) ![b](x/pp1.png)", "p+1.png", "http://h/$0\\1", "s [1]\n(2)")], "t string, n string, u string, s string")
    got = rows.select(I.relinked(F.col("t"), F.col("n"), F.col("u"), F.col("s")).alias("r")).first().r
    assert got == "![s  1   2 ](http://h/$0\\1) ![b](x/pp1.png)"


def test_context_takes_the_nearest_paragraphs_of_its_section(spark):
    text = ["# A", "far " * 40, "", "near", "more", "![x](i.png)", "", "next", "", "y" * 300, "", "z", "# B", "other"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id int, position int, line string")
    row = I.surroundings(lines, F.contains("line", F.lit("i.png"))).first()
    assert (row.heading, row.before, row.after) == ("# A", ("far " * 40).strip() + "\nnear\nmore", "next")
    alone = lines.filter("position = 5")
    row = I.surroundings(alone, F.lit(True)).first()
    assert (row.heading, row.before, row.after) == ("", "", "")


def test_leaf_search_scores_each_part(spark):
    q = spark.createDataFrame([("a", "open HAK-180 lid"), ("b", "锁定"), ("none", " ?")], "query_id string, question string")
    leaves = spark.createDataFrame([(1, "Lid", "how to open hak-180 lid now"), (2, "x", "lid"), (3, "y", "机器锁定了"), (4, "z", "nothing"), (5, "lid", None)], "node_id int, title string, text string")
    got = {(r.query_id, r.node_id): r.score for r in pages.search(q, leaves).collect()}
    assert got[("a", 1)] == round(0.35 + 0.12 / 3 + 0.30 + 0.20, 6)
    assert got[("a", 2)] == round(0.35 / 3, 6)
    assert got[("b", 3)] == round(0.35 + 0.20, 6)
    assert set(got) == {("a", 1), ("a", 2), ("b", 3)}
    assert pages.search(q.limit(0), leaves).count() == 0
