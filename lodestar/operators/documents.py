"""Documents as lines, blocks, sections and chunks; revisions and their differences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, position, line, start): lines from 0, each with its offset in characters."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("position", "line"))
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long"))


def with_heading(rows: DataFrame, is_heading, key: str = "doc_id") -> DataFrame:
    """Each line with the last heading at or before it."""
    w = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(w))


def occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """How many equal keys came before, from 0."""
    return rows.withColumn("occurrence", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def fixed_windows(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, chunk): windows of `size` characters, each `overlap` of them shared with the one before (a quarter at most)."""
    step = size - min(overlap, size // 4)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = docs.select(key, F.col(text).alias("_t"), F.posexplode(starts).alias("part", "start"))
    return rows.select(key, "part", F.substring("_t", F.col("start") + 1, F.lit(size)).alias("chunk"), "start")


def greedy_chunks(pieces: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """(key, chunk, first, last, chars): pieces (key, position, chars) packed in order up to `limit` characters.

    A fold over one document's pieces, whose number a document's length bounds:
    they are one row's arrays, and a batch of many documents goes to Python at once.
    """

    def fold(positions: list[int], chars: list[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for position, n in zip(positions, chars, strict=True):
            if out and out[-1][2] + n + 1 <= limit:
                out[-1][1], out[-1][2] = position, out[-1][2] + n + 1
            else:
                out.append([position, position, n])
        return out

    @F.pandas_udf("array<array<long>>")
    def packed(positions: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([fold(p.tolist(), c.tolist()) for p, c in zip(positions, chars, strict=True)])

    whole = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), F.col("chars").cast("long").alias("chars")))).alias("_p"))
    out = whole.select(key, F.posexplode(packed(F.col("_p.position"), F.col("_p.chars"))).alias("chunk", "_c"))
    return out.select(key, F.col("chunk").cast("long").alias("chunk"), *(F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(("first", "last", "chars"))))


def lineage(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with a signature and a lineage id: from the content if it is unique in its document, else from document and order."""
    signed = blocks.withColumn("signature", F.substring(F.sha2(T.normalized(F.col("line")), 256), 1, 24))
    alone = F.count("*").over(Window.partitionBy(key, "signature")) == 1
    return signed.withColumn("lineage_id", F.when(alone, T.stable_id("lin", F.col(key), F.col("signature"))).otherwise(T.stable_id("lin", F.col(key), F.lit("order"), F.col("position"))))


def block_difference(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lineage_id, state): unchanged, modified, removed or added blocks of two revisions."""
    a = old.select(key, "lineage_id", F.col("signature").alias("_a"))
    b = new.select(key, "lineage_id", F.col("signature").alias("_b"))
    both = a.join(b, [key, "lineage_id"], "full_outer")
    state = F.when(F.col("_b").isNull(), "removed").when(F.col("_a").isNull(), "added").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("modified")
    return both.select(key, "lineage_id", state.alias("state"))


def unique_matches(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, signature, old, new): blocks whose signature occurs once on either side."""
    once = lambda rows, name: rows.groupBy(key, "signature").agg(F.count("*").alias("n"), F.min("position").alias(name)).filter("n = 1").drop("n")
    return once(old, "old").join(once(new, "new"), [key, "signature"])


def dice(old: DataFrame, new: DataFrame, size: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, similarity): multiset Dice coefficient of character n-grams of two revisions."""

    def grams(rows: DataFrame, name: str) -> DataFrame:
        starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
        out = rows.select(key, F.explode(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(size)))).alias("g"))
        return out.groupBy(key, "g").agg(F.count("*").alias(name))

    both = grams(old, "a").join(grams(new, "b"), [key, "g"], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(key).agg(F.sum(F.least("a", "b")).alias("common"), F.sum(F.col("a") + F.col("b")).alias("all"))
    return sums.select(key, F.round(2 * F.col("common") / F.col("all"), 6).alias("similarity"))


def running_budget(rows: DataFrame, group: str, order: list, chars: str, limit: int) -> DataFrame:
    """The head of each group whose running number of characters stays within the limit."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(chars).over(w)).filter(F.col("used") <= limit)


def replaced(current: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """A table after delete-by-key and insert: rows of the incoming keys go, the incoming rows come."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def page_index(sections: DataFrame, parent: str, leaf: str) -> DataFrame:
    """(node_id, parent_id, kind, title, children): a root, a node per section, a leaf per row of it."""
    node = lambda *c: F.substring(F.sha1(F.concat_ws("|", *c)), 1, 16)
    leaves = sections.select(node(F.lit("leaf"), F.col(parent), F.col(leaf).cast("string")).alias("node_id"), node(F.lit("section"), F.col(parent)).alias("parent_id"), F.lit("leaf").alias("kind"), F.col(leaf).cast("string").alias("title"), F.lit(0).cast("long").alias("children"))
    inner = sections.groupBy(parent).agg(F.count("*").alias("children")).select(node(F.lit("section"), F.col(parent)).alias("node_id"), node(F.lit("root")).alias("parent_id"), F.lit("section").alias("kind"), F.col(parent).alias("title"), "children")
    root = inner.agg(F.count("*").alias("children")).select(node(F.lit("root")).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("kind"), F.lit("root").alias("title"), "children")
    return leaves.unionByName(inner).unionByName(root)
