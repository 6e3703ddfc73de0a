"""What an import and a query leave behind: entity rows, scoped rewrites, statistics, traces, probes, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fusion import ranked

#: Characters of a chunk that an entity's row keeps, and nodes of a tree's summary.
CONTEXT, SUMMARY = 200, 80
#: Fields of a trace row by type; what a row lacks becomes an empty text, null or an empty list.
TRACE_TEXTS = (
    "document_id", "revision_id", "section_id", "file_title", "title", "parent_title", "url", "source_type",
    "domain", "retrieved_at", "retrieved_date", "publication_date", "evidence_group_id",
)
TRACE_NUMBERS = ("rerank_raw_score", "calibrated_relevance", "ranking_score", "authority", "freshness", "structure_match", "evidence_coverage")
TRACE_LISTS = ("page_numbers", "block_ids", "image_urls", "rrf_sources")
TRACE_IDS, TRACE_SCORES = ("stable_id", "chunk_id", "id"), ("distance", "score", "rrf_score", "retrieval_score")


def entity_rows(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, entity_name, position, context) from entities (chunk_id, position, name) and chunks (chunk_id, content).

    Names lose blanks around them, blank ones go, of equal ones in a chunk the first stays.
    """
    named = entities.select("chunk_id", "position", F.trim("name").alias("entity_name")).filter("entity_name != ''")
    first = named.groupBy("chunk_id", "entity_name").agg(F.min("position").alias("position"))
    return first.join(chunks.select("chunk_id", F.substring("content", 1, CONTEXT).alias("context")), "chunk_id")


def pairs(alignments: DataFrame) -> DataFrame:
    """(item_name, entity_name): each pair once, none with a blank side, from rows (item_name, aligned)."""
    named = alignments.select(F.trim("item_name").alias("item_name"), F.trim("aligned").alias("entity_name"))
    return named.filter("item_name != '' AND entity_name != ''").distinct()


def rewritten(current: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """A table after all rows in the scopes of the incoming ones are cleared and these are written; a null is a scope value like another."""
    scopes = incoming.select(*(F.col(c).alias(f"_{c}") for c in scope)).distinct()
    same = F.lit(True)
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return current.join(scopes, same, "left_anti").unionByName(incoming)


def upserted(current: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """A table after delete-by-key and insert; incoming rows without a key are inserted and delete nothing."""
    keyed = incoming.filter(F.trim(key) != "").select(key).distinct()
    return current.join(keyed, key, "left_anti").unionByName(incoming)


def import_stats(results: DataFrame) -> DataFrame:
    """One row of counts over chunks (failed, entities, relations): a failed chunk adds nothing but itself, one without entities is empty."""
    done = ~F.col("failed")
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long")
    return results.agg(
        F.count_if(done).alias("processed_chunks"), F.count_if("failed").alias("failed_chunks"), F.count_if(done & (F.col("entities") == 0)).alias("empty_chunks"),
        total("entities").alias("total_entities"), total("relations").alias("total_relations"),
    )


def state_counts(rows: DataFrame, conditions: dict[str, Column], group: list[str] = ()) -> DataFrame:
    """How many rows meet each named condition, and how many there are."""
    return rows.groupBy(*group).agg(F.count("*").alias("rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def without_payload(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows without vectors: columns of number lists, of sparse maps and of bytes."""
    heavy = ("array<float>", "array<double>", "binary")
    return rows.drop(*(n for n, t in rows.dtypes if n not in keep and (t in heavy or t.startswith("map<int"))))


def trace_rows(rows: DataFrame, group: list[str], stage: str, order: list[Column]) -> DataFrame:
    """The candidates of each stage as they are put down for evaluation: rank, ids, titles and scores, never texts or vectors."""
    have = set(rows.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    number = lambda c: F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")
    filled = lambda c: F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
    score = F.coalesce(*(number(c) for c in TRACE_SCORES))
    source = F.when(F.col(stage) == "web", "web").otherwise("local")
    return ranked(rows, [*group, stage], order).select(
        *group, F.col(stage).alias("stage"), F.col("rank").cast("long").alias("rank"),
        (F.coalesce(filled("source"), source) if "source" in have else source).alias("source"),
        F.coalesce(*(filled(c) for c in TRACE_IDS if c in have), F.lit("")).alias("chunk_id"),
        F.when(~F.isnan(score), F.round(score, 6)).alias("score"), *(text(c).alias(c) for c in TRACE_TEXTS), *(number(c).alias(c) for c in TRACE_NUMBERS),
        *((F.coalesce(F.col(c), F.array()) if c in have else F.array().cast("array<string>")).alias(c) for c in TRACE_LISTS),
    )


def tree_summary(nodes: DataFrame, tree: str, order: list[Column], top: int = SUMMARY) -> DataFrame:
    """The first nodes of each tree, in order, for a step of navigation; Spark keeps so many per tree before the shuffle."""
    return ranked(nodes, [tree], order, top)


def probe_assertions(probes: DataFrame, rows: DataFrame) -> DataFrame:
    """Probes (probe_id, preflight, error, status, hits, graph_version, entity_collection) with what must hold of each and of its graph rows.

    `rows` (probe_id, document_id, section_id, source_type). All must hold for `passed`; a probe without rows fails those on rows.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    seen = rows.groupBy("probe_id").agg(
        F.bool_and(filled("document_id") & filled("section_id")).alias("_lineage"), F.bool_and(F.coalesce(F.col("source_type") == "knowledge_graph", F.lit(False))).alias("_typed"))
    no = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "runtime_preflight_passed": no(F.col("preflight")), "provider_error_empty": ~filled("error"), "kg_stage_status_ok": no(F.col("status") == "ok"),
        "kg_retrieval_count_positive": no(F.col("hits") > 0), "kg_trace_nonempty": F.col("_lineage").isNotNull(), "kg_trace_has_document_lineage": no(F.col("_lineage")),
        "kg_trace_has_graph_source_type": no(F.col("_typed")), "versioned_graph_selected": filled("graph_version") & no(F.col("graph_version") != "legacy"),
        "versioned_entity_collection_selected": filled("entity_collection"),
    }
    judged = probes.join(seen, "probe_id", "left").select("probe_id", *(c.alias(n) for n, c in checks.items()))
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return judged.withColumn("passed", passed)


def promotion_faults() -> Column:
    """Why a report may not become the baseline, empty if it may: columns evaluation_scope, rag_quality, snapshot_requested, snapshot_written, n_results."""
    fault = lambda c, said: F.when(F.coalesce(c, F.lit(True)), F.lit(said))
    return F.array_compact(F.array(
        fault(F.col("evaluation_scope") != "full_pipeline", "scope"), fault(~F.col("rag_quality"), "rag_quality"),
        F.when(F.coalesce("snapshot_requested", F.lit(False)) & ~F.coalesce("snapshot_written", F.lit(False)), "snapshot"), fault(F.col("n_results") == 0, "no_results"),
    ))


def canonical_json(*names: str) -> Column:
    """Columns as a JSON object: keys in order of name, nulls left out."""
    return F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "true"})
