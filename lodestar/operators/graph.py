"""Knowledge-graph operators over edge and node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import first_of, ranked
from .sized import by_blocks

#: Caps that are part of the operators: fuzzy seeds per name, triples per seed, chunks per query.
FUZZY, TRIPLES, CHUNKS = 3, 50, 200
SEED_WEIGHT, NEIGHBOUR_WEIGHT = 2.0, 1.0


def seeds(names: DataFrame, entities: DataFrame, fuzzy: int = FUZZY) -> DataFrame:
    """(query_id, name, entity, match): exact matches of the names, and for names without one up to `fuzzy` entities that contain it.

    Names without an exact match are compared with all entities in blocks of counted size.
    """
    exact = names.join(entities, F.col("name") == F.col("entity")).select("query_id", "name", "entity", F.lit("exact").alias("match"))
    open_names = names.join(exact.select("query_id", "name").distinct(), ["query_id", "name"], "left_anti")

    def containing(block: DataFrame) -> DataFrame:
        near = entities.join(block, F.contains(F.lower("entity"), F.lower("name")))
        return ranked(near.select("query_id", "name", "entity"), ["query_id", "name"], [F.length("entity"), F.col("entity")], fuzzy).drop("rank")

    near = by_blocks(open_names, 128, ["query_id", "name"], containing)
    return exact.unionByName(near.withColumn("match", F.lit("fuzzy")))


def one_hop(seed: DataFrame, edges: DataFrame, readable: DataFrame, top: int = TRIPLES) -> DataFrame:
    """(query_id, seed, head, rel, tail, neighbour, rank): edges at a seed in either direction, stored direction kept, both ends readable."""
    open_edges = edges.join(readable.select(F.col("node").alias("head")), "head", "left_semi").join(readable.select(F.col("node").alias("tail")), "tail", "left_semi")
    out = open_edges.select(F.col("head").alias("seed"), F.col("tail").alias("neighbour"), "head", "rel", "tail")
    back = open_edges.select(F.col("tail").alias("seed"), F.col("head").alias("neighbour"), "head", "rel", "tail")
    met = seed.select("query_id", "seed").distinct().join(out.union(back).distinct(), "seed")
    return ranked(met, ["query_id", "seed"], [F.col("rel"), F.col("head"), F.col("tail")], top)


def node_weights(seed: DataFrame, hops: DataFrame) -> DataFrame:
    """(query_id, node, weight): a seed counts more than a neighbour, and a node that is both counts as a seed."""
    rows = seed.select("query_id", F.col("seed").alias("node"), F.lit(SEED_WEIGHT).alias("weight")).union(hops.select("query_id", F.col("neighbour").alias("node"), F.lit(NEIGHBOUR_WEIGHT).alias("weight")))
    return rows.groupBy("query_id", "node").agg(F.max("weight").alias("weight"))


def chunks(weights: DataFrame, mentions: DataFrame, top: int = CHUNKS) -> DataFrame:
    """(query_id, chunk_id, score, n, rank): chunks that mention the nodes, by summed weight, then number, then id."""
    met = weights.join(mentions, "node").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"), F.count("*").alias("n"))
    return ranked(met, ["query_id"], [F.desc("score"), F.desc("n"), F.col("chunk_id")], top)


def hydrate(hits: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the hits in hit order: the first hit of an id wins, ids without a row are dropped."""
    return first_of(hits, ["query_id", key], [F.col("rank")]).join(rows, key)


def verified(edges: DataFrame, readable: DataFrame) -> DataFrame:
    """(rel, edges, heads, tails, closed_heads) of distinct edges (head, rel, tail): how many edges and ends each relation has, and how many edges a head that is not readable.

    Heads and tails are counted as rows, one a relation and end, so that no task holds all combinations of both.
    """
    heads = edges.groupBy("rel", "head").agg(F.count("*").alias("n"))
    marked = heads.join(readable.select(F.col("node").alias("head"), F.lit(True).alias("open")).distinct(), "head", "left")
    by_head = marked.groupBy("rel").agg(F.sum("n").alias("edges"), F.count("head").alias("heads"), F.coalesce(F.sum(F.when(F.col("open").isNull(), F.col("n"))), F.lit(0)).alias("closed_heads"))
    by_tail = edges.groupBy("rel", "tail").count().groupBy("rel").agg(F.count("tail").alias("tails"))
    return by_head.join(by_tail.withColumnRenamed("rel", "_rel"), F.col("rel").eqNullSafe(F.col("_rel"))).select("rel", "edges", "heads", "tails", "closed_heads")


def with_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (chunk_id, head, rel, tail) whose two ends are entities (chunk_id, name) of the same chunk."""
    for end in ("head", "tail"):
        relations = relations.join(entities.select("chunk_id", F.col("name").alias(end)), ["chunk_id", end], "left_semi")
    return relations


def cleaned(entities: DataFrame, labels: list[str], name_length: int = 20) -> DataFrame:
    """Entities (chunk_id, position, name, label) with short names and known labels, the first of each (name, label)."""
    e = entities.withColumn("name", F.substring(F.trim("name"), 1, name_length)).filter((F.col("name") != "") & F.col("label").isin(labels))
    return first_of(e, ["chunk_id", "name", "label"], [F.col("position")])


def merged(rows: DataFrame, key: list[str], value: str, order: Column) -> DataFrame:
    """One row per key; the last value that is not blank replaces earlier ones."""
    filled = F.when(F.trim(F.coalesce(value, F.lit(""))) != "", order)
    return rows.groupBy(*key).agg(F.max_by(value, filled).alias(value), F.count("*").alias("writes"))
