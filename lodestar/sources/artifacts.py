"""Files beside documents: parser artifacts (pages of typed items), JSON objects, price books, release manifests, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as H

#: Pages and items stay JSON until they are looked at, so that one that is odd doesn't spoil the others.
PAGES = "array<string>"
ITEM = "type string, sub_type string, bbox array<double>, content string"
FURNITURE = ("page_header", "page_footer", "page_number", "page_aside_text")
_RUN = "array<struct<content: string>>"
CONTENT = ", ".join(f"{t}_content {_RUN}" for t in ("title", "paragraph", *FURNITURE)) + (
    f", level int, list_items array<struct<item_content: {_RUN}>>, html string, table_caption {_RUN}, table_footnote {_RUN}, image_source struct<path: string>, content string, image_caption {_RUN}, image_footnote {_RUN}"
)


def pages(json: Column) -> Column:
    """An artifact's pages: a list, or an object that holds it as `pages` or `content`; null if it can't be read."""
    wrapped = F.from_json(json, f"pages {PAGES}, content {PAGES}")
    listed = F.when(F.ltrim(json).startswith("["), F.from_json(json, PAGES))
    return F.coalesce(listed, wrapped["pages"], wrapped["content"])


def items(artifacts: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """(key, page, item, type, layer, level, text, rows, fault, captions, notes, image, bbox) of all items with content; pages count from 1.

    Running heads, feet and page numbers are furniture. A table whose spans are
    refused stays, without rows, and `fault` says so: a caller decides whether the document goes on. An artifact that can't
    be read gives no rows: `unreadable` names those.
    """
    page = artifacts.select(key, F.posexplode(pages(F.col(json))).alias("_p", "_items"))
    item = page.select(key, (F.col("_p") + 1).alias("page"), F.posexplode(F.from_json("_items", "array<string>")).alias("item", "_i"))
    item = item.filter(F.ltrim("_i").startswith("{")).withColumn("_i", F.from_json("_i", ITEM))
    c = item.select(key, "page", "item", F.col("_i.type").alias("type"), F.col("_i.bbox").alias("bbox"), F.from_json("_i.content", CONTENT).alias("c"))
    said = lambda run: F.trim(F.array_join(F.transform(run, lambda x: x["content"]), ""))
    listed = F.array_join(F.transform("c.list_items", lambda x: said(x["item_content"])), "\n")
    runs = F.coalesce(*(F.when(F.col("type") == t, said(F.col(f"c.{t}_content"))) for t in ("title", "paragraph", *FURNITURE)), F.when(F.col("type") == "list", listed))
    grid = H.html_table(F.when(F.col("type") == "table", F.col("c.html")))
    texts = lambda a, b: F.filter(F.transform(F.coalesce(F.when(F.col("type") == "table", F.col(a)), F.when(F.col("type") == "image", F.col(b))), lambda x: F.trim(x["content"])), lambda x: x != "")
    captions, notes = texts("c.table_caption", "c.image_caption"), texts("c.table_footnote", "c.image_footnote")
    image = F.when(F.col("type").isin("table", "image"), F.col("c.image_source.path"))
    made = c.withColumn("_grid", grid).select(key, "page", "item", "type", F.when(F.col("type").isin(*FURNITURE), "furniture").otherwise("body").alias("layer"), F.col("c.level").alias("level"), runs.alias("_runs"), F.when(F.col("type") == "table", F.col("_grid.rows")).alias("rows"), F.col("_grid.fault").alias("fault"), captions.alias("captions"), notes.alias("notes"), image.alias("image"), "bbox", F.col("c.content").alias("_said"))
    whole = F.when(F.col("type") == "table", F.array_join(F.concat(F.coalesce("captions", F.array()), F.coalesce("rows", F.array()), F.coalesce("notes", F.array())), "\n"))
    seen = F.when(F.col("type") == "image", F.array_join(F.concat(F.coalesce("captions", F.array()), F.array_compact(F.array("_said")), F.coalesce("notes", F.array())), "\n"))
    made = made.withColumn("text", F.coalesce("_runs", whole, seen, F.lit("")))
    return made.filter((F.col("text") != "") | F.col("image").isNotNull() | F.col("fault").isNotNull()).drop("_runs", "_said")


def unreadable(artifacts: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """(key) of artifacts whose pages can't be read."""
    return artifacts.filter(pages(F.col(json)).isNull()).select(key)


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines of objects; blank lines are skipped, anything else that is no object is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    read = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    ok = F.when(F.trim("value").startswith("{") & read.isNotNull(), read).otherwise(F.raise_error(F.lit("a line is no JSON object")).cast(schema if schema.startswith("struct") else f"struct<{schema}>"))
    return lines.select(ok.alias("o")).select("o.*")


def price_book(spark: SparkSession, path: str) -> DataFrame:
    """(fingerprint, schema_version, model, max_input, input_rate, output_rate) of a price file; another version than 1 is an error."""
    book = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("fingerprint"), F.from_json(F.col("content").cast("string"), "schema_version string, models map<string, array<struct<max_input: long, input_rate: double, output_rate: double>>>").alias("b"))
    fine = F.when(F.col("b.schema_version").startswith("1"), F.col("b.schema_version")).otherwise(F.raise_error(F.lit("unknown version of the price book")))
    rows = book.select("fingerprint", fine.alias("schema_version"), F.explode("b.models").alias("model", "tiers"))
    return rows.select("fingerprint", "schema_version", "model", F.explode("tiers").alias("t")).select("fingerprint", "schema_version", "model", "t.*")


def release(manifest: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """(release_id, side, key, value) of manifests: both sides must name every key, with values of safe characters."""
    m = manifest.select(F.from_json(json, "release_id string, candidate map<string,string>, rollback map<string,string>").alias("m")).select("m.*")
    need = F.array(*map(F.lit, keys))
    lacks = lambda c: (F.size(F.array_except(need, F.map_keys(c))) > 0) | (F.size(F.array_except(F.map_keys(c), need)) > 0) | F.exists(F.map_values(c), lambda v: ~v.rlike(r"^[A-Za-z0-9_.-]+$"))
    bad = F.coalesce(lacks(F.col("candidate")) | lacks(F.col("rollback")), F.lit(True))
    checked = m.filter(F.when(bad, F.raise_error(F.lit("a release lacks keys or holds unsafe values")).cast("boolean")).otherwise(True))
    sides = F.map_from_arrays(F.array(F.lit("candidate"), F.lit("rollback")), F.array("candidate", "rollback"))
    return checked.select("release_id", F.explode(sides).alias("side", "_v")).select("release_id", "side", F.explode("_v").alias("key", "value"))


def write_once(rows: DataFrame, path: str) -> None:
    """A snapshot as JSON Lines; one that exists is not replaced."""
    rows.write.mode("errorifexists").json(path)
