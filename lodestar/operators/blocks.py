"""Markdown text to typed blocks and sections, with windows over lines; fuzzy alignment of blocks."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING, FENCE, IMAGE, TABLE, LIST = r"^#{1,6} +\S", r"^ *(?:```|~~~)", r"^ *!\[[^\]]*\]\([^)]*\) *$", r"^[^|]*\|.*\|", r"^ *(?:[-*+]|\d+[.)]) +\S"


def markdown_blocks(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, kind, first, last, text) from lines (key, position, line).

    A fence runs to its closing line; a heading and an image are blocks of one
    line; table rows, list items and other lines join their like until a blank
    line or another kind.
    """
    by = Window.partitionBy(key).orderBy("position")
    line = F.col("line")
    fence = line.rlike(FENCE)
    before = F.coalesce(F.sum(fence.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kind = (
        F.when(fence | (before % 2 == 1), "code").when(F.trim(line) == "", "blank").when(line.rlike(HEADING), "heading").when(line.rlike(IMAGE), "image")
        .when(line.rlike(TABLE), "table").when(line.rlike(LIST), "list").otherwise("paragraph")
    )
    typed = rows.withColumn("kind", kind).withColumn("_open", fence & (before % 2 == 0))
    starts = F.col("kind").isin("heading", "image", "blank") | F.col("_open") | (F.lag("kind").over(by).isNull()) | (F.lag("kind").over(by) != F.col("kind"))
    numbered = typed.withColumn("_block", F.sum(starts.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("kind != 'blank'")
    blocks = numbered.groupBy(key, "_block", "kind").agg(F.min("position").alias("first"), F.max("position").alias("last"), F.sort_array(F.collect_list(F.struct("position", "line"))).alias("_lines"))
    order = F.row_number().over(Window.partitionBy(key).orderBy("first")).cast("long")
    return blocks.select(key, order.alias("block"), "kind", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.array_join("_lines.line", "\n").alias("text"))


def sections(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with the number of their section (headings so far) and its title."""
    w = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("kind") == "heading"
    title = F.last(F.when(heading, F.regexp_replace("text", r"^#{1,6} +", "")), ignorenulls=True).over(w)
    return blocks.withColumn("section", F.sum(heading.cast("int")).over(w).cast("long")).withColumn("section_title", title)


def continued_tables(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tables that go on from the table before: its next block of content, with the same first row."""
    first_row = F.regexp_extract("text", r"^[^\n]*", 0)
    t = blocks.withColumn("_head", first_row)
    w = Window.partitionBy(key).orderBy("block")
    same = (F.col("kind") == "table") & (F.lag("kind").over(w) == "table") & (F.lag("_head").over(w) == F.col("_head")) & (F.trim("_head") != "")
    return t.withColumn("continues_from", F.when(same, F.col("block") - 1)).drop("_head")

#: From this length on, SequenceMatcher takes frequent characters for junk.
WITHOUT_JUNK = 200


def subsequence_masks(text: str) -> dict[str, int]:
    """Where each character stands in a text, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def subsequence_length(masks: dict[str, int], size: int, text: str) -> int:
    """Length of the longest common subsequence of a text and the one of `size` characters that the masks stand for, a row of the usual table at once."""
    full = (1 << size) - 1
    row = full
    for c in text:
        met = row & masks.get(c, 0)
        if met:
            row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def similar_pairs(old: DataFrame, new: DataFrame, by: list[str], least: float, where: Column | None = None, floor: Column | None = None) -> DataFrame:
    """(by, old, new, score): texts of two sides (by, position, text) whose longest-matching-block ratio is at least `least`.

    Pairs are made only where a length lies within what the ratio allows of
    the other (bands of lengths are joined, not whole groups), and are scored
    in Arrow batches, wherever they lie. Matching blocks are a common subsequence, so the longest
    one bounds the ratio and spares most pairs the whole comparison. `where` compares further columns, which both sides carry with
    the prefixes `old_` and `new_`, `floor` is a higher least that depends on them. Blank texts are like nothing.
    """
    near = least / (2 - least)  # a ratio of 2 m / (a + b) with m <= min(a, b) needs min / max of at least this
    band = F.floor(F.log(F.length("text").cast("double")) / -math.log(near))
    side = lambda d, name: d.filter(F.length("text") > 0).select(*(F.col(c) if c in by else F.col(c).alias(f"{name}_{c}") for c in d.columns), band.alias("_band"))
    a, b = side(old, "old"), side(new, "new").withColumn("_band", F.explode(F.array(*(F.col("_band") + i for i in (-1, 0, 1)))))
    la, lb = F.length("old_text"), F.length("new_text")
    pairs = a.join(b, [*by, "_band"]).filter(2 * F.least(la, lb) >= F.lit(least) * (la + lb))
    pairs = pairs if where is None else pairs.filter(where)

    @F.pandas_udf("double")
    def ratio(new_text: pd.Series, old_text: pd.Series) -> pd.Series:
        out, last, masks = [], None, {}
        for n, o in zip(new_text, old_text, strict=True):
            if len(o) < WITHOUT_JUNK and (o in n or n in o):
                out.append(2.0 * min(len(o), len(n)) / (len(n) + len(o)))  # the whole of the shorter is the one block
                continue
            if o != last:
                last, masks, known = o, subsequence_masks(o), None
            if 2.0 * subsequence_length(masks, len(o), n) / (len(n) + len(o)) < least:
                out.append(0.0)
                continue
            if known is None:
                known = SequenceMatcher(None, "", o)
            known.set_seq1(n)
            out.append(known.ratio())
        return pd.Series(out)

    scored = pairs.withColumn("score", ratio("new_text", "old_text")).filter(F.col("score") >= least)
    scored = scored if floor is None else scored.filter(F.col("score") >= floor)
    return scored.select(*by, F.col("old_position").alias("old"), F.col("new_position").alias("new"), "score")


def clear_best(pairs: DataFrame, threshold: float, margin: float = 0.08, key: str = "doc_id") -> DataFrame:
    """Of scored pairs (key, old, new, score), those that are the best of both sides, by `margin` over the next best of either."""
    best = pairs
    for side, other in (("new", "old"), ("old", "new")):
        w = Window.partitionBy(key, side).orderBy(F.desc("score"), F.desc(other))
        best = best.withColumn(f"_{side}", F.row_number().over(w)).withColumn(f"_{side}_next", F.lead("score").over(w))
    clear = lambda side: (F.col(f"_{side}") == 1) & (F.col(f"_{side}_next").isNull() | (F.col("score") - F.col(f"_{side}_next") >= margin))
    return best.filter((F.col("score") >= threshold) & clear("new") & clear("old")).select(key, "old", "new", "score")


def mutual_best(pairs_of: DataFrame, threshold: float, margin: float = 0.08, key: str = "doc_id") -> DataFrame:
    """(key, old, new, score): texts of two sides, rows (key, side, position, text), that are each other's clear best match.

    A runner-up matters down to the threshold less the margin; what lies below is never compared whole.
    """
    one = lambda name: pairs_of.filter(F.col("side") == name).select(key, "position", "text")
    found = clear_best(similar_pairs(one("old"), one("new"), [key], threshold - margin), threshold, margin, key)
    return found.withColumn("score", F.round("score", 6))
