"""Reports of evaluations as ordered lines, and item names that every chunk of a document bears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a report, in order; each begins with its heading.
PARTS = ("summary", "eligibility", "metrics", "review", "cases")


def _heading(results: DataFrame, part: str, lines: list[Column]) -> DataFrame:
    return results.agg(*(c.alias(f"_{i}") for i, c in enumerate(lines))).select(F.lit(PARTS.index(part)).alias("part"), F.posexplode(F.array(*(f"_{i}" for i in range(len(lines))))).alias("at", "line")).select("part", F.concat(F.lit("0:"), F.format_string("%04d", "at")).alias("at"), "line")


def _number(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value.cast("double"), digits))


def _list(rows: DataFrame, part: str, order: Column, line: Column) -> DataFrame:
    return rows.select(F.lit(PARTS.index(part)).alias("part"), F.concat(F.lit("1:"), order.cast("string")).alias("at"), line.alias("line"))


def lines(results: DataFrame, metrics: DataFrame, reasons: DataFrame) -> DataFrame:
    """(part, at, line): a report in Markdown, in the order of part and at.

    Results (case_id, passed, score, latency_ms, review array<string>), metrics
    (name, value), reasons (reason) against a baseline. One line a case, made
    where the case lies; only counts and percentiles are gathered. Case ids of equal order of characters come once each.
    """
    done = F.count_if(F.coalesce("passed", F.lit(False)))
    p = lambda share: _number(F.coalesce(F.percentile("latency_ms", F.lit(share)), F.lit(0.0)), 1)
    summary = _heading(results, "summary", [F.lit("# Evaluation"), F.concat(F.lit("Passed: "), done.cast("string"), F.lit(" of "), F.count("*").cast("string")), F.concat(F.lit("Latency: "), p(0.5), F.lit(" ms at the median, "), p(0.95), F.lit(" ms at 95 %"))])
    titles = [_heading(results, part, [F.lit(f"## {part.capitalize()}")]) for part in PARTS[1:]]
    against = _list(reasons, "eligibility", F.col("reason"), F.concat(F.lit("- "), "reason"))
    fine = reasons.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(PARTS.index("eligibility")).alias("part"), F.lit("1:").alias("at"), F.lit("- fit to be a baseline").alias("line"))
    measured = _list(metrics, "metrics", F.col("name"), F.concat(F.lit("- "), "name", F.lit(": "), _number(F.col("value"), 4)))
    looked = results.filter(F.size(F.coalesce("review", F.array().cast("array<string>"))) > 0)
    review = _list(looked, "review", F.col("case_id"), F.concat(F.lit("- "), F.col("case_id").cast("string"), F.lit(": "), F.array_join("review", "; ")))
    state = F.when(F.coalesce("passed", F.lit(False)), "pass").otherwise("FAIL")
    cases = _list(results, "cases", F.col("case_id"), F.concat(F.lit("- "), F.col("case_id").cast("string"), F.lit(": "), state, F.lit(", score "), _number(F.coalesce("score", F.lit(0.0)), 4), F.lit(", "), _number(F.coalesce("latency_ms", F.lit(0.0)), 1), F.lit(" ms")))
    out = summary
    for more in (*titles, against, fine, measured, review, cases):
        out = out.unionByName(more)
    return out


def write(report: DataFrame, path: str) -> None:
    """The lines as text files whose names are in the report's order; a report that exists is not replaced."""
    report.repartitionByRange("part", "at").sortWithinPartitions("part", "at").select("line").write.mode("errorifexists").text(path)


def with_item_names(chunks: DataFrame, recognised: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with `item_name`: what was recognised for their document (key, name), or where that is blank or missing the title of its file (key, file_title).

    Of several names of a document the smallest that is not blank counts, so that all its chunks bear one.
    """
    named = recognised.filter(F.trim("name") != "").groupBy(key).agg(F.min(F.trim("name")).alias("_name"))
    each = docs.select(key, "file_title").join(named, key, "left").select(key, F.coalesce("_name", "file_title").alias("item_name"))
    return chunks.drop("item_name").join(each, key, "left")
