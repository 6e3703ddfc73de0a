"""Calibration, ranking scores, cut-offs and de-duplication of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Centre and scale of the calibrating curve; weights of the ranking score.
CENTER, SCALE = -1.8, 0.9
RANKING = (0.55, 0.20, 0.15, 0.10)
#: Cliff cut: least and most results, absolute and relative gap.
CLIFF = (6, 15, 0.5, 0.25)


def safe_unit(value: Column, default: float) -> Column:
    """A number in 0..1; what is no finite number becomes the default first."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(finite, number).otherwise(F.lit(default))))


def calibrated(score: Column, center: float = CENTER, scale: float = SCALE) -> Column:
    """A raw score through a logistic curve, 0.5 for none; the exponent is held within 60."""
    exponent = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), -(score - center) / max(abs(scale), 1e-6)))
    return F.when(score.isNull(), F.lit(0.5)).otherwise(F.round(1 / (1 + F.exp(exponent)), 6))


def ranking_score(relevance: Column, authority: Column, structure: Column, freshness: Column) -> Column:
    """Weighted sum to six digits; the small term lets decimal ties round up whatever their binary form."""
    a, b, c, d = RANKING
    return F.round(relevance * a + authority * b + structure * c + freshness * d + 1e-9, 6)


def cliff_cut(rows: DataFrame, group: str, score: str, order: list[Column], bounds: tuple[int, int, float, float] = CLIFF) -> DataFrame:
    """Keep each group's head up to the first large gap between neighbours, at least and at most so many rows."""
    low, high, gap_abs, gap_rel = bounds
    w = Window.partitionBy(group).orderBy(*order)
    gap = F.col(score) - F.lead(score).over(w)
    steep = (gap >= gap_abs) | (gap / (F.abs(F.col(score)) + 1e-6) >= gap_rel)
    placed = rows.withColumn("position", F.row_number().over(w)).withColumn("_steep", steep)
    placed = placed.filter(F.col("position") <= high + 1)
    at = F.min(F.when(F.col("_steep") & (F.col("position") >= low) & (F.col("position") < high), F.col("position"))).over(Window.partitionBy(group))
    return placed.withColumn("_cut", F.coalesce(at, F.lit(high))).filter(F.col("position") <= F.col("_cut")).drop("_steep", "_cut")


def top_margin(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Best score and its distance to the second best (to 0 if there is one only)."""
    top = rows.groupBy(group).agg(F.slice(F.sort_array(F.collect_list(score), asc=False), 1, 2).alias("s"))
    return top.select(group, F.round(F.get("s", F.lit(0)), 6).alias("top_score"), F.round(F.get("s", F.lit(0)) - F.coalesce(F.get("s", F.lit(1)), F.lit(0.0)), 6).alias("margin"))


def within_gap(rows: DataFrame, group: str, score: str, gap: float = 0.15) -> DataFrame:
    """Rows no further than `gap` below their group's best: the maximum is aggregated first and joined."""
    best = rows.groupBy(group).agg(F.max(score).alias("_best"))
    return rows.join(best, group).filter(F.round(F.col("_best") - F.col(score), 9) <= gap).drop("_best")


def dedupe_key(*candidates: Column) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in candidates))


def content_prefix(text: Column, length: int = 240) -> Column:
    return F.substring(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 1, length)
