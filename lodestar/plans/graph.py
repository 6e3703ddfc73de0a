"""Graph queries over suppliers, parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion, graph
from ..operators.sized import dealt
from .registry import query, table

_G = """
edges AS (SELECT DISTINCT 'S' || l_suppkey AS head, 'SUPPLIES_' || l_returnflag AS rel, 'P' || l_partkey AS tail FROM lineitem),
readable AS (SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_suppkey % 7 <> 3 UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_partkey % 5 <> 2),
seed AS (SELECT s_suppkey AS query_id, 'S' || s_suppkey AS seed FROM supplier WHERE s_suppkey % 20 = 0),
oe AS (SELECT * FROM edges WHERE head IN (SELECT node FROM readable) AND tail IN (SELECT node FROM readable)),
both_ways AS (SELECT head AS seed, tail AS neighbour, head, rel, tail FROM oe UNION SELECT tail, head, head, rel, tail FROM oe),
hop AS (SELECT query_id, seed, head, rel, tail, neighbour, row_number() OVER (PARTITION BY query_id, seed ORDER BY rel, head, tail) AS rank FROM seed JOIN both_ways USING (seed) QUALIFY rank <= 50),
nw AS (SELECT query_id, node, max(weight) AS weight FROM (SELECT query_id, seed AS node, 2.0 AS weight FROM seed UNION ALL SELECT query_id, neighbour, 1.0 FROM hop) GROUP BY ALL),
mentions AS (SELECT DISTINCT 'P' || l_partkey AS node, l_orderkey AS chunk_id FROM lineitem),
ck AS (SELECT query_id, chunk_id, sum(weight) AS score, count(*) AS n FROM nw JOIN mentions USING (node) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, chunk_id) AS rank FROM ck QUALIFY rank <= 200)
"""


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    line = table(spark, sf, "lineitem")
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    edges = line.select(name("S", "l_suppkey").alias("head"), F.concat(F.lit("SUPPLIES_"), "l_returnflag").alias("rel"), name("P", "l_partkey").alias("tail"))
    edges = dealt(edges, "head").distinct()  # within partitions of bounded size
    readable = table(spark, sf, "supplier").filter("s_suppkey % 7 != 3").select(name("S", "s_suppkey").alias("node")).union(table(spark, sf, "part").filter("p_partkey % 5 != 2").select(name("P", "p_partkey").alias("node")))
    seed = table(spark, sf, "supplier").filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"), name("S", "s_suppkey").alias("seed"))
    mentions = line.select(name("P", "l_partkey").alias("node"), F.col("l_orderkey").alias("chunk_id")).distinct()
    return edges, readable, seed, mentions


@query("n3_one_hop", f"WITH {_G} SELECT query_id, seed, head, rel, tail, neighbour, rank FROM hop")
def one_hop(spark: SparkSession, sf: str) -> DataFrame:
    edges, readable, seed, _ = _parts(spark, sf)
    return graph.one_hop(seed, edges, readable).withColumn("rank", F.col("rank").cast("long"))


@query("j6_graph_chunks", f"WITH {_G} SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, n, rank FROM top")
def graph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    edges, readable, seed, mentions = _parts(spark, sf)
    weights = graph.node_weights(seed, graph.one_hop(seed, edges, readable))
    return graph.chunks(weights, mentions).withColumn("rank", F.col("rank").cast("long"))


@query("j4_hydration", f"WITH {_G} SELECT query_id, chunk_id, rank, o_orderstatus AS status, 'knowledge_graph' AS source_type FROM top JOIN orders ON o_orderkey = chunk_id WHERE o_orderstatus <> 'P'")
def hydration(spark: SparkSession, sf: str) -> DataFrame:
    edges, readable, seed, mentions = _parts(spark, sf)
    hits = graph.chunks(graph.node_weights(seed, graph.one_hop(seed, edges, readable)), mentions)
    rows = table(spark, sf, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderstatus").alias("status"))
    return graph.hydrate(hits, rows).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "status", F.lit("knowledge_graph").alias("source_type"))


@query("j7_seed_lookup", """WITH ent AS (SELECT DISTINCT p_name || ' ' || p_brand AS entity FROM part),
names AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 2 = 0 THEN p_name || ' ' || p_brand ELSE upper(p_brand) END AS name FROM supplier JOIN part ON p_partkey = s_suppkey),
exact AS (SELECT query_id, name, entity, 'exact' AS match FROM names JOIN ent ON name = entity),
near AS (SELECT query_id, name, entity, 'fuzzy' AS match FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY length(entity), entity) AS r FROM names JOIN ent ON contains(lower(entity), lower(name))
 WHERE (query_id, name) NOT IN (SELECT (query_id, name) FROM exact)) WHERE r <= 3)
SELECT * FROM exact UNION ALL SELECT * FROM near""")
def seed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    entities = part.select(F.concat_ws(" ", "p_name", "p_brand").alias("entity")).distinct()
    names = table(spark, sf, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey"))
    names = names.select(F.col("s_suppkey").alias("query_id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_brand")).otherwise(F.upper("p_brand")).alias("name"))
    return graph.seeds(names, entities)


@query("j8_endpoint_check", """WITH ent AS (SELECT l_orderkey AS chunk_id, 'P' || l_partkey AS name FROM lineitem WHERE l_quantity >= 10),
rel AS (SELECT a.l_orderkey AS chunk_id, 'P' || a.l_partkey AS head, 'NEXT_TO' AS rel, 'P' || b.l_partkey AS tail FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
SELECT chunk_id, head, rel, tail FROM rel WHERE (chunk_id, head) IN (SELECT (chunk_id, name) FROM ent) AND (chunk_id, tail) IN (SELECT (chunk_id, name) FROM ent)""")
def endpoint_check(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_linenumber", "l_quantity", F.concat(F.lit("P"), "l_partkey").alias("name"))
    after = line.select("chunk_id", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("name").alias("tail"))
    rel = line.join(after, ["chunk_id", "l_linenumber"]).select("chunk_id", F.col("name").alias("head"), F.lit("NEXT_TO").alias("rel"), "tail")
    return graph.with_endpoints(rel, line.filter("l_quantity >= 10").select("chunk_id", "name").distinct()).select("chunk_id", "head", "rel", "tail")


@query("u9_entity_clean", """WITH e AS (SELECT l_orderkey AS chunk_id, l_linenumber AS position, substr(trim(p_type || ' ' || p_name), 1, 20) AS name, p_brand AS label FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT chunk_id, name, label, CAST(min(position) AS BIGINT) AS position FROM e WHERE name <> '' AND label IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY chunk_id, name, label""")
def entity_clean(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("position"), F.concat_ws(" ", "p_type", "p_name").alias("name"), F.col("p_brand").alias("label"))
    return graph.cleaned(rows, ["Brand#1", "Brand#2", "Brand#3"]).select("chunk_id", "name", "label", F.col("position").cast("long").alias("position"))


@query("k7_merge_entities", """WITH w AS (SELECT l_partkey AS name, l_orderkey * 10 + l_linenumber AS part, CASE WHEN l_quantity < 5 THEN '' ELSE l_returnflag || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS description FROM lineitem)
SELECT name, arg_max(description, part) FILTER (WHERE description <> '') AS description, count(*) AS writes FROM w GROUP BY name""")
def merge_entities(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("l_quantity") < 5, "").otherwise(F.concat("l_returnflag", F.col("l_quantity").cast("long").cast("string")))
    w = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("part"), text.alias("description"))
    return graph.merged(w, ["name"], "description", F.col("part"))


@query("a19_graph_verification", f"""WITH {_G} SELECT rel, count(*) AS edges, count(DISTINCT head) AS heads, count(DISTINCT tail) AS tails, count(*) FILTER (WHERE head NOT IN (SELECT node FROM readable)) AS closed_heads FROM edges GROUP BY rel""")
def verification(spark: SparkSession, sf: str) -> DataFrame:
    edges, readable, _, _ = _parts(spark, sf)
    return graph.verified(edges, readable)


@query("j21_best_per_item", "SELECT l_partkey AS item, l_orderkey AS best, l_extendedprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_per_item(spark: SparkSession, sf: str) -> DataFrame:
    best = fusion.first_of(table(spark, sf, "lineitem"), ["l_partkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])
    return best.select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("best"), F.col("l_extendedprice").alias("price"))
