"""Quality rules: a table of thresholds compiled into one projection.

No user function takes part: every signal is a built-in expression over the
row, so the whole operator is a map without a shuffle, and a row's verdict
depends on that row alone.

Defined cases: a null text counts as empty and fails the base rules; an empty
table gives an empty result; repeated rows are judged one by one; further
columns of the input are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# White space that separates words, symbols that are counted.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Very frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "as",
    "le", "la", "les", "de", "des", "et", "un", "une", "que", "pour",
    "der", "die", "das", "und", "den", "von", "mit", "zu", "ist", "auf",
    "el", "los", "las", "en", "y", "por", "con", "para", "una", "del",
)


@dataclass(frozen=True)
class Rule:
    """`scale * signal` must lie between `low * per` and `high * per`, all whole numbers; None: no limit on that side."""

    name: str
    signal: str
    per: str | None = None
    scale: int = 1
    low: int | None = None
    high: int | None = None


#: Percentages are written with whole numbers (scale 100), so that no verdict hangs on rounding.
RULES = (
    Rule("length", "n_words", high=1_000_000),
    Rule("short_words", "word_chars", per="n_words", scale=1, low=2),
    Rule("long_words", "word_chars", per="n_words", scale=1, high=15),
    Rule("symbols", "n_symbols", per="n_words", scale=100, high=30),
    Rule("stop_words", "n_stop_kinds", low=2),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", scale=100, high=30),
    Rule("ellipsis_lines", "n_ellipsis_lines", per="n_lines", scale=100, high=30),
    Rule("bullet_lines", "n_bullet_lines", per="n_lines", scale=100, high=90),
)


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One boolean column: true where every rule holds."""
    verdict = F.lit(True)
    for rule in rules:
        value = F.col(rule.signal) * rule.scale
        unit = F.col(rule.per) if rule.per else F.lit(1)
        if rule.low is not None:
            verdict = verdict & (value >= unit * rule.low)
        if rule.high is not None:
            verdict = verdict & (value <= unit * rule.high)
    return verdict


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns that rules can name."""
    first = docs.withColumn("_text", text_or_empty(text)).withColumn("_words", F.array_remove(F.split("_text", SPACE_CLASS), ""))
    first = first.withColumn("n_words", F.size("_words").cast("long"))
    long_enough = F.col("n_words") >= 4
    hashes = F.transform(
        F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    second = first.withColumn("_windows", F.when(long_enough, hashes).otherwise(F.array().cast("array<bigint>")))
    sorted_windows = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    some = F.size("_windows") > F.size(F.array_distinct("_windows"))
    third = second.withColumn("_sorted", F.when(some, sorted_windows).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    at = F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)))
    fourth = third.withColumn("_at", F.sort_array(F.transform(at, lambda x: x["p"])))
    fourth = fourth.withColumn(
        "n_repeat_words",
        F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x).cast("long"),
    )
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    fifth = fourth.withColumn("_lines", lines)
    return fifth.select(
        *docs.columns,
        "n_words",
        F.length(F.translate("_text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size(F.array_intersect(F.array_distinct(F.split(F.lower("_text"), SPACE_CLASS)), F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop_kinds"),
        F.size(F.filter("_lines", lambda line: line.rlike(r"\.\.\.[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_lines", lambda line: line.rlike(r"^[\x20\x09-\x0D]*[-*•] "))).cast("long").alias("n_bullet_lines"),
    )


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its signals, `base_failed`, and `kept` (base rules and every rule of the table hold)."""
    found = signals(docs.select(key, text), text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & compile_rules(rules)).alias("kept"), "n_lines", "n_stop_kinds", "n_ellipsis_lines", "n_bullet_lines",
    )
