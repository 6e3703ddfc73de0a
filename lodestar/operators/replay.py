"""Replays over recorded results: calibrations compared on one reading of the scores; fingerprints that no order of rows changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranking
from .fusion import ranked


@dataclass(frozen=True)
class Calibration:
    """A named setting of the calibrating curve and of the weights of the ranking score."""

    name: str
    center: float = ranking.CENTER
    scale: float = ranking.SCALE
    weights: tuple[float, float, float, float] = ranking.RANKING


def _scored(x: Calibration) -> Column:
    relevance = ranking.calibrated(F.col("raw"), x.center, x.scale)
    signals = (relevance, ranking.safe_unit(F.col("authority"), 1.0), F.coalesce("structure", F.lit(0.0)), F.coalesce("freshness", F.lit(0.0)))
    score = F.round(sum((s * w for s, w in zip(signals, x.weights, strict=True)), F.lit(0.0)) + 1e-9, 6)
    return F.struct(F.lit(x.name).alias("name"), score.alias("score"), relevance.alias("relevance"))


def audited(candidates: DataFrame, settings: list[Calibration], key: str = "case_id") -> DataFrame:
    """(name, key, scores, least, most, mean, first_source, top_source, top_group, groups, margin, relevant, moved): what each setting makes of each case.

    Candidates (key, candidate_id, raw, authority, structure, freshness,
    group_id, source, relevant), read once: each row is scored under all
    settings, a short list that stands in the plan, and only the best of each
    evidence group goes on. `first_source` is that of the best raw score;
    `moved` says whether another group leads now. Ties go to the higher
    calibrated relevance, then to the smaller group. A case without a raw score
    has candidates all the same; their relevance is the middle of the curve.
    """
    seen = candidates.groupBy(key).agg(F.count("raw").alias("scores"), F.min("raw").alias("least"), F.max("raw").alias("most"), F.round(F.avg("raw"), 6).alias("mean"), F.min(F.struct(F.col("raw").isNull().alias("no"), (-F.col("raw")).alias("by"), "candidate_id", "group_id", "source")).alias("_first"))
    each = candidates.select(key, "group_id", "candidate_id", "source", "relevant", F.inline(F.array(*map(_scored, settings))))
    best = each.groupBy("name", key, "group_id").agg(F.min(F.struct((-F.col("score")).alias("by"), (-F.col("relevance")).alias("then"), "candidate_id", "source", "relevant")).alias("_b"))
    counted = best.groupBy("name", key).agg(F.count("*").alias("groups"))
    two = ranked(best.select("name", key, "group_id", "_b"), ["name", key], [F.col("_b.by"), F.col("_b.then"), F.asc_nulls_last("group_id")], 2)
    top = two.groupBy("name", key).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("group_id", "_b.source", "_b.relevant"))).alias("_t"),
        F.round(F.sum(F.when(F.col("rank") == 1, -F.col("_b.by")).otherwise(F.col("_b.by"))), 6).alias("margin"),
    )
    return top.join(counted, ["name", key]).join(seen, key).select(
        "name", key, "scores", "least", "most", "mean", F.col("_first.source").alias("first_source"), F.col("_t.source").alias("top_source"), F.col("_t.group_id").alias("top_group"), "groups", "margin", F.col("_t.relevant").alias("relevant"),
        (~F.col("_t.group_id").eqNullSafe(F.col("_first.group_id"))).alias("moved"),
    )


def sweep(candidates: DataFrame, settings: list[Calibration], key: str = "case_id") -> DataFrame:
    """(name, cases, moved, relevant_rate, mean_margin): the settings side by side, over all cases."""
    rows = audited(candidates, settings, key)
    return rows.groupBy("name").agg(F.count("*").alias("cases"), F.sum(F.col("moved").cast("long")).alias("moved"), F.round(F.avg(F.coalesce("relevant", F.lit(False)).cast("double")), 6).alias("relevant_rate"), F.round(F.avg("margin"), 6).alias("mean_margin"))


#: Digits of a row's digest that each of the two sums takes; sums of 15 hexadecimal digits stay within a decimal of 38 for 10**20 rows.
DIGITS = 15


def _said(name: str, kind: str) -> Column:
    """A column's value with its length before it, so that no two rows of values read alike; null as a sign of its own."""
    value = F.col(f"`{name}`")
    text = F.to_json(value) if kind.startswith(("array", "map", "struct")) else F.base64(value) if kind == "binary" else value.cast("string")
    return F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))


def fingerprint(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, rows, low, high, fingerprint): of a table, or of each group of it, whatever its order and partitions.

    Every row's digest adds to two sums and a count, which combine like any
    sum: a row that changes, goes or comes twice shows, a permutation does not.
    Columns count by name, in the order of their names. An empty table has one too.
    """
    named = sorted((c, k) for c, k in rows.dtypes if c not in by)
    digest = F.sha2(F.concat_ws(",", *(_said(c, k) for c, k in named)), 256)
    part = lambda at: F.conv(F.substring(digest, at, DIGITS), 16, 10).cast("decimal(20,0)")
    sums = rows.select(*by, part(1).alias("_a"), part(1 + DIGITS).alias("_b")).groupBy(*by).agg(F.count("*").alias("rows"), F.coalesce(F.sum("_a"), F.lit(0)).cast("string").alias("low"), F.coalesce(F.sum("_b"), F.lit(0)).cast("string").alias("high"))
    columns = ",".join(c for c, _ in named)
    return sums.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.lit(columns), F.col("rows").cast("string"), "low", "high"), 256))
