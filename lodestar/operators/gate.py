"""What an evaluation run must show: source selectors, complete pipelines, eligibility, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fields of a source selector: text that must be equal, and lists whose values must all occur.
SCALARS = ("source", "chunk_id", "file_title", "title", "parent_title", "url", "document_id", "revision_id", "section_id", "source_uri")
LISTS = ("block_ids", "block_lineage_ids", "page_numbers", "page_uids")
#: The steps that every run needs, and those that a channel of its plan needs.
STEPS, CHANNEL_STEPS, WEB_STEP = ("rrf", "rerank_node"), {"direct": "search_embedding", "hyde": "search_embedding_hyde", "kg": "query_kg"}, "web_search_mcp"


def selector_matches(actual: Column, wanted: Column, fields: list[str]) -> Column:
    """Whether a source fits a selector, both structs with the given fields; null fields of the selector say nothing, one without any never fits."""
    unknown = set(fields) - {*SCALARS, *LISTS, "title_path"}
    if unknown:
        raise ValueError(f"unknown selector fields {sorted(unknown)}")
    fits, asked = F.lit(True), F.lit(False)
    for f in fields:
        a, w = actual[f], wanted[f]
        if f in SCALARS:
            a, w = F.trim(F.coalesce(a, F.lit(""))), F.trim(w)
            same = (T.heading(a) == T.heading(w)) if f in ("title", "parent_title") else (a == w)
            ok = (w != "") & same
        elif f == "title_path":
            ok = (F.size(w) > 0) & (F.transform(a, lambda x: T.heading(x)) == F.transform(w, lambda x: T.heading(x)))
        else:
            ok = (F.size(w) > 0) & (F.size(F.array_except(w, a)) == 0)
        fits = fits & (w.isNull() | F.coalesce(ok, F.lit(False)))
        asked = asked | w.isNotNull()
    return fits & asked


def with_aliases(label: Column, has_alias: Column, alias: Column) -> Column:
    """A reviewed alias takes the label's place."""
    return F.when(has_alias, alias).otherwise(label)


def suite(cases: DataFrame, name: str) -> DataFrame:
    """The core cases, or all."""
    if name not in ("core", "full"):
        raise ValueError(f"unknown suite {name}")
    return cases.filter(F.coalesce("ci_core", F.lit(False))) if name == "core" else cases


def group_key(level: str, source: Column, url: Column, domain: Column, title: Column, document: Column, section: Column, group: Column, blocks: Column) -> Column:
    """What counts as one source at a level: document, section, or evidence group."""
    given = lambda *c: F.coalesce(*(F.when(F.trim(x) != "", x) for x in c), F.lit("unknown"))
    web = F.concat(F.lit("web:"), given(url, domain, title))
    d, s = given(document), given(section, title)
    if level == "document":
        local = F.concat(F.lit("document:"), d)
    elif level == "section":
        local = F.concat(F.lit("section:"), d, F.lit(":"), T.heading(s))
    else:
        by_blocks = F.concat(F.lit("evidence:"), d, F.lit(":"), s, F.lit(":"), F.array_join(F.array_sort(blocks), "|"))
        named = F.when(F.trim(F.coalesce(group, F.lit(""))) != "", group)
        local = F.coalesce(named, F.when(F.size(blocks) > 0, by_blocks), F.concat(F.lit("evidence:"), d, F.lit(":"), T.heading(s)))
    return F.when((F.coalesce(source, F.lit("")) == "web") | (F.coalesce(url, F.lit("")) != ""), web).otherwise(local)


def pipeline_complete(needs_retrieval: Column, channels: Column, web: Column, status: Column, failed_calls: Column) -> Column:
    """1 if no step that the plan needs is missing or failed: `channels` maps names to whether they run, `status` steps to what became of them."""
    needed = [F.when(F.coalesce(channels[c], F.lit(False)), F.lit(step)) for c, step in CHANNEL_STEPS.items()]
    needed = F.array_compact(F.array(*map(F.lit, STEPS), *needed, F.when(web == "required", F.lit(WEB_STEP))))
    fine = F.forall(needed, lambda s: F.coalesce(status[s] == "ok", F.lit(False))) & ~F.exists(F.map_values(status), lambda v: F.coalesce(v == "error", F.lit(False)))
    return F.when(~needs_retrieval, 1.0).when(status.isNull() | ~F.coalesce(fine, F.lit(False)) | (F.coalesce(failed_calls, F.lit(0)) > 0), 0.0).otherwise(1.0)


def ineligible(scope: Column, index_version: Column, recall: Column, complete: Column, errors: Column, cost_status: Column, budget_status: Column, budget_passed: Column, failed_calls: Column, open_turns: Column) -> Column:
    """Why a run may not serve as a baseline; empty if it may."""
    full = scope == "full_pipeline"
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.array_compact(F.array(
        F.when(~F.coalesce(full, F.lit(False)), "provider did not execute the full retrieval-to-answer pipeline"),
        F.when(F.coalesce(index_version, F.lit("")).isin("", "unversioned"), "INDEX_VERSION is not pinned"),
        F.when(recall.isNull(), "retrieval recall is unavailable"),
        F.when(full & (F.coalesce(complete, F.lit(0.0)) < 1), "one or more pipeline runs failed or silently degraded"),
        F.when(zero(errors) > 0, "one or more provider calls failed"),
        F.when(full & (F.coalesce(cost_status, F.lit("")) != "available"), "versioned monetary cost is unavailable"),
        F.when(full & (budget_status == "available") & ~F.coalesce(budget_passed, F.lit(False)), "evaluation batch monetary budget exceeded"),
        F.when(zero(failed_calls) > 0, "one or more executed model calls failed"),
        F.when(zero(open_turns) > 0, "one or more conversation turns had an incomplete pipeline"),
    ))


def alias_faults(aliases: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, fault) of reviewed aliases (key, expected, document, place) that name no case, no expected label of it, or no document and place in it."""
    known = cases.select(key, F.lit(True).alias("_case")).distinct()
    labels = cases.select(key, F.explode("labels").alias("expected"), F.lit(True).alias("_label")).distinct()
    met = aliases.join(known, key, "left").join(labels, [key, "expected"], "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    fault = F.when(F.col("_case").isNull(), "unknown case").when(blank("document") | blank("place"), "alias pins no document and place").when(F.col("_label").isNull(), "expected label is not in the case")
    return met.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def case_score(metrics: Column, names: list[str]) -> Column:
    """The mean of those of a case's metrics that apply, null if none does."""
    values = F.array_compact(F.array(*(metrics[n] for n in names)))
    return F.when(F.size(values) > 0, F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values), 6))


def same_sequence(a: DataFrame, b: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(position, which) of the places where two ordered tables differ: audit of a recorded baseline."""
    x = a.select(order, F.xxhash64(*columns).alias("_a"))
    y = b.select(order, F.xxhash64(*columns).alias("_b"))
    met = x.join(y, order, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return met.select(order, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "missing").otherwise("changed").alias("which"))
