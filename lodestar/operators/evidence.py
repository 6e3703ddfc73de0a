"""Evidence decisions, claims and their citations, prompts within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import safe_unit

#: Weights of the confidence: margin, coverage, authority, agreement, relevance; least confidence of an answer.
CONFIDENCE = (0.35, 0.15, 0.15, 0.15, 0.20)
REFUSE_BELOW, CAPABILITY_BELOW, MIN_OVERLAP = 0.46, 0.5, 0.08
# Words of a price.
PRICE = "售价|价格|金额|面议|报价|人民币"


def structure_match(wants_table: Column, wants_image: Column, has_table: Column, has_image: Column, coverage: Column) -> Column:
    """The best of the asked features that the evidence has; none asked for: its coverage, half as much again."""
    asked = F.greatest(F.when(wants_table, F.when(has_table, 1.0).otherwise(0.0)), F.when(wants_image, F.when(has_image, 1.0).otherwise(0.0)))
    return F.coalesce(asked, F.least(F.lit(1.0), coverage * 1.5))


def confidence(signals: list[Column]) -> Column:
    total = sum(max(0.0, w) for w in CONFIDENCE)
    score = sum((safe_unit(s, 0.0) * w for s, w in zip(signals, CONFIDENCE, strict=True)), F.lit(0.0)) / total
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) + 1e-9, 6)


def refusal(n_evidence: Column, decision: Column, confidence: Column, capability: Column) -> Column:
    """Why there is no answer, or null."""
    return (
        F.when(n_evidence == 0, "empty_context").when(decision.isNull(), "missing_evidence_decision")
        .when(confidence < REFUSE_BELOW, "low_confidence").when(capability < CAPABILITY_BELOW, "capability_not_covered")
    )


def supports(claim: Column, claim_terms: Column, claim_numbers: Column, evidence: Column, evidence_terms: Column, evidence_numbers: Column, overlap: float = MIN_OVERLAP) -> Column:
    """A claim is supported if its numbers all occur, enough of its terms do, and a price is backed by one."""
    priced = ~claim.rlike(PRICE) | evidence.rlike(PRICE)
    numbers = F.size(F.array_except(claim_numbers, evidence_numbers)) == 0
    shared = F.when(F.size(claim_terms) == 0, F.size(claim_numbers) > 0).otherwise(F.size(F.array_intersect(claim_terms, evidence_terms)) / F.size(claim_terms) >= overlap)
    return (F.trim(evidence) != "") & priced & numbers & shared


def bind_claims(claims: DataFrame, evidence: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, position, claim, cited, action): each claim with the first evidence of its group, by rank, that supports it.

    `claims` (group, position, claim, cited array<int>), `evidence` (group,
    rank, content). Evidence of an answer is a short list, so the join stays
    within small groups. A claim whose citations are all supported is kept,
    some of them: pruned, none but other evidence: rebound, none: removed.
    """
    c = claims.withColumn("_ct", T.terms(T.without_citations(F.col("claim")))).withColumn("_cn", T.numbers(T.without_citations(F.col("claim"))))
    e = evidence.withColumn("_et", T.terms(F.col("content"))).withColumn("_en", T.numbers(F.col("content")))
    met = c.join(e, group, "left").withColumn("_ok", F.coalesce(supports(F.col("claim"), F.col("_ct"), F.col("_cn"), F.col("content"), F.col("_et"), F.col("_en")), F.lit(False)))
    per = met.groupBy(group, "position", "claim", "cited").agg(F.min(F.when(F.col("_ok"), F.col("rank"))).alias("first"), F.sort_array(F.collect_set(F.when(F.col("_ok"), F.col("rank").cast("int")))).alias("good"))
    kept = F.array_intersect("cited", "good")
    action = F.when((F.size("cited") > 0) & (F.size(kept) == F.size("cited")), "keep").when(F.size(kept) > 0, "prune").when(F.col("first").isNotNull(), "rebind").otherwise("remove")
    return per.withColumn("action", action).withColumn("bound", F.when(F.size(kept) > 0, kept).when(F.col("first").isNotNull(), F.array(F.col("first").cast("int"))).otherwise(F.array().cast("array<int>")))


def renumbered(bound: DataFrame, group: str = "query_id") -> DataFrame:
    """(group, cited, number): the evidence that is cited at all, numbered from 1 in the order of its first citation."""
    rows = bound.select(group, "position", F.posexplode("bound").alias("at", "cited"))
    first = rows.groupBy(group, "cited").agg(F.min(F.struct("position", "at")).alias("first"))
    return first.select(group, "cited", F.row_number().over(Window.partitionBy(group).orderBy("first", "cited")).cast("long").alias("number"))


def plan(query: Column, intent: Column, has_item: Column) -> Column:
    """Which channels run, as a struct; the graph only for questions about relations, the web only where the intent lets it."""
    f = T.features(query)
    web = F.when(intent == "freshness", "required").when(intent == "prompt_injection", "disabled").otherwise("fallback")
    channels = F.struct(F.lit(True).alias("direct"), (intent != "freshness").alias("hyde"), (f["kg"] & ~intent.isin("freshness", "prompt_injection")).alias("kg"), web.alias("web"))
    return F.struct(channels.alias("channels"), F.struct(has_item.alias("has_item"), f["safety"].alias("safety"), f["table"].alias("table"), f["image"].alias("image"), (intent == "freshness").alias("freshness")).alias("features"))


def with_fingerprint(plan_column: Column) -> Column:
    return F.sha2(F.to_json(plan_column), 256)
