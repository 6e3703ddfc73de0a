"""Images in Markdown: links rewritten to where the image now lies, and the text around each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of context on either side of an image.
AROUND = 200
HEADING = r"^#{1,6}\s+"
# Images that end a paragraph: a line that starts with one.
STARTS_IMAGE = r"^(?:!\[.*?\]\(.*?\)|<img[^>]*src=['\"].*?['\"][^>]*>)"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def safe_alt(summary: Column) -> Column:
    """A summary as alternative text: one line, no brackets."""
    line = _stripped(F.replace(F.coalesce(summary, F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.translate(line, "[]()", "    ")


def relinked(text: Column, name: Column, url: Column, summary: Column) -> Column:
    """Markdown in which every image whose link holds `name` points to `url`, with its summary as alternative text; without a URL it stays."""
    literal = F.concat(F.lit("\\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(r"(?i)!\[.*?\]\([^)]*"), literal, F.lit(r"[^)]*\)"))
    image = F.concat(F.lit("!["), safe_alt(summary), F.lit("]("), url, F.lit(")"))
    return F.when(F.coalesce(url, F.lit("")) == "", text).otherwise(F.regexp_replace(text, pattern, F.regexp_replace(image, r"([\\$])", r"\\$1")))


def surroundings(lines: DataFrame, is_image: Column, key: str = "doc_id", limit: int = AROUND) -> DataFrame:
    """(key, position, heading, before, after): for each image line the nearest heading and the paragraphs around it, within its section.

    Lines (key, position, line). A paragraph ends at a blank line, at a line
    that starts with an image and at the image itself. On either side, the
    nearest paragraph is taken whole and further ones while all of them stay
    within `limit` characters. An image joins only paragraphs of its own
    section.
    """
    by = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("line").rlike(HEADING)
    marked = lines.select(key, "position", "line", F.coalesce(is_image, F.lit(False)).alias("_image"), is_heading.alias("_heading"))
    blank = F.regexp_replace("line", r"(?U)\s+", "") == ""
    breaks = blank | _stripped(F.col("line")).rlike(STARTS_IMAGE) | F.col("_image") | F.col("_heading")
    placed = marked.select(
        "*", breaks.alias("_break"), F.sum(breaks.cast("int")).over(by).alias("_paragraph"),
        F.sum(F.col("_heading").cast("int")).over(by).alias("_section"), F.last(F.when(F.col("_heading"), _stripped(F.col("line"))), ignorenulls=True).over(by).alias("heading"),
    )
    body = placed.filter("NOT _break").groupBy(key, "_section", "_paragraph").agg(F.min("position").alias("_at"), F.array_join(F.sort_array(F.collect_list(F.struct("position", "line"))).getField("line"), "\n").alias("_text"))
    body = body.select(key, "_section", "_at", _stripped(F.col("_text")).alias("_text"))
    images = placed.filter("_image").select(key, "position", "_section", F.coalesce("heading", F.lit("")).alias("heading"))
    met = images.join(body, [key, "_section"], "left").withColumn("_above", F.col("_at") < F.col("position"))
    distance = F.abs(F.col("_at") - F.col("position"))
    near = Window.partitionBy(key, "position", "_above").orderBy(distance)
    taken = met.withColumn("_sum", F.sum(F.length("_text")).over(near.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(near))
    taken = taken.withColumn("_use", (F.col("_nth") == 1) | (F.col("_sum") <= limit))
    side = lambda above: F.array_join(F.sort_array(F.collect_list(F.when(F.col("_use") & (F.col("_above") == above), F.struct("_at", "_text")))).getField("_text"), "\n")
    return taken.groupBy(key, "position").agg(F.first("heading").alias("heading"), side(True).alias("before"), side(False).alias("after"))
