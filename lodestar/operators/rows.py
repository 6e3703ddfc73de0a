"""Rows on their way into an index and out of it: coercion, validation, projection, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import text as T
from .ranking import safe_unit

LONGEST, READERS, READER = 65535, 128, 256
LOCAL_AUTHORITY, WEB_AUTHORITY, OFFICIAL_AUTHORITY = 1.0, 0.45, 0.9


def coerced(rows: DataFrame, texts: list[str] = (), numbers: list[str] = (), flags: list[str] = (), readers: str | None = None, sparse: str | None = None) -> DataFrame:
    """Index rows in their stored shape: texts cut and never null, numbers and flags with defaults, reader lists bounded, sparse vectors with keys and weights that can be read."""
    made = {c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, LONGEST) for c in texts}
    made |= {c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in numbers}
    made |= {c: F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)) for c in flags}
    if readers:
        made[readers] = F.transform(F.slice(F.coalesce(F.col(readers), F.array().cast("array<string>")), 1, READERS), lambda x: F.substring(F.coalesce(x, F.lit("")), 1, READER))
    if sparse:
        read = F.transform(F.map_entries(sparse), lambda e: F.struct(e["key"].try_cast("int").alias("key"), e["value"].try_cast("double").alias("value")))
        kept = F.filter(read, lambda e: e["key"].isNotNull() & e["value"].isNotNull())
        # Of keys that become one, the last counts.
        last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda o: o["key"] == e["key"]))
        made[sparse] = F.map_from_entries(last)
    return rows.withColumns(made)


def vector_fault(dense: Column, sparse: Column, dimension: Column) -> Column:
    """Why a row's vectors can't be stored, or null."""
    return F.when(dense.isNull() | sparse.isNull(), "no vector").when(F.size(dense) == 0, "empty dense vector").when(F.size(sparse) == 0, "empty sparse vector").when(F.size(dense) != dimension, "other dimension")


def valid_vectors(rows: DataFrame, dimension: int, dense: str = "dense_vector", sparse: str = "sparse_vector", document: str = "document_id") -> DataFrame:
    """Rows whose vectors can be stored. A fault in a row that belongs to a document fails the load; other rows are skipped."""
    fault = vector_fault(F.col(dense), F.col(sparse), F.lit(dimension))
    owned = F.trim(F.coalesce(F.col(document), F.lit(""))) != ""
    ok = F.when(fault.isNull(), True).when(owned, F.raise_error(F.concat(F.lit("row of document "), F.col(document), F.lit(": "), fault)).cast("boolean")).otherwise(False)
    return rows.filter(ok)


def graph_chunks(rows: DataFrame, item: str = "item_name", content: str = "content") -> DataFrame:
    """Chunks with content and an item; more than one item in an import is an error."""
    good = rows.filter((F.trim(F.coalesce(F.col(content), F.lit(""))) != "") & (F.trim(F.coalesce(F.col(item), F.lit(""))) != ""))
    ends = good.agg(F.min(F.trim(item)).alias("low"), F.max(F.trim(item)).alias("high")).first()
    if ends["low"] != ends["high"]:
        raise ValueError("an import holds chunks of one item")
    return good


def combined(*conditions: Column | None) -> Column:
    """All of the conditions that there are; none: no restriction."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def candidates(local: DataFrame, web: DataFrame, content: str = "content") -> DataFrame:
    """Local and web candidates in one table; rows without content go."""
    return local.unionByName(web, allowMissingColumns=True).filter(F.trim(F.coalesce(F.col(content), F.lit(""))) != "")


def web_results(rows: DataFrame, domains: list[str], json: str = "json") -> DataFrame:
    """Rows of a search service's answers (pages in JSON): only safe addresses, official sites marked; what can't be read gives none."""
    read = F.from_json(json, "pages array<struct<title: string, snippet: string, url: string>>").getField("pages")
    p = rows.select(*[c for c in rows.columns if c != json], F.posexplode(read).alias("position", "p"))
    p = p.select(*[c for c in p.columns if c != "p"], *(F.trim(F.coalesce(f"p.{c}", F.lit(""))).alias(c) for c in ("title", "snippet", "url")))
    p = p.filter(T.safe_url(F.col("url"))).withColumn("domain", T.host(F.col("url")))
    official = T.official(F.col("domain"), [d.strip().lower() for d in domains if d.strip()])
    return p.withColumns({
        "source": F.lit("web"), "content": F.col("snippet"), "source_type": F.when(official, "official_web").otherwise("web"),
        "authority": F.when(official, OFFICIAL_AUTHORITY).otherwise(WEB_AUTHORITY), "freshness": F.when(official, 0.7).otherwise(0.3),
    })


def annotated(rows: DataFrame, fresh_question: Column) -> DataFrame:
    """Evidence with defaults for what is missing: its type, authority and freshness, by where it comes from."""
    local = F.coalesce(F.col("source"), F.lit("local")) == "local"
    kind = P.source_type(F.col("source"), F.concat(F.coalesce("title", F.lit("")), F.coalesce("parent_title", F.lit(""))), F.col("file_title"), F.col("has_table"), F.col("has_image"))
    freshness = F.when(local, 0.4).when(fresh_question, 1.0).otherwise(0.5)
    return rows.withColumns({
        "source": F.coalesce("source", F.lit("local")), "source_type": F.when(F.coalesce("source_type", F.lit("")) != "", F.col("source_type")).otherwise(kind),
        "authority": safe_unit(F.col("authority"), F.when(local, LOCAL_AUTHORITY).otherwise(WEB_AUTHORITY)), "freshness": safe_unit(F.col("freshness"), freshness),
    })


def capability_coverage(questions: DataFrame, evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, coverage): the share of the asked capability's terms in evidence that is local or official; 1 if none is asked for."""
    good = evidence.filter(~((F.col("source") == "web") & (F.coalesce("source_type", F.lit("")) != "official_web")))
    has = good.select(key, F.explode(T.terms(F.col("content"))).alias("term")).distinct()
    asked = questions.select(key, F.explode_outer("terms").alias("term"))
    per = asked.join(has.withColumn("_hit", F.lit(1)), [key, "term"], "left").groupBy(key).agg(F.count("term").alias("n"), F.count("_hit").alias("hits"))
    return per.select(key, F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.col("hits") / F.col("n"), 6)).alias("coverage"))


def item_context(chunk_rows: DataFrame, key: str = "doc_id", first: int = 3, longest: int = 800, limit: int = 2500) -> DataFrame:
    """(key, context) from the first chunks (key, chunk, title, text) of each document, each cut, and all of them."""
    w = Window.partitionBy(key).orderBy("chunk")
    head = chunk_rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= first)
    body = F.trim(F.coalesce("text", F.lit("")))
    cut = F.when(F.length(body) > longest, F.concat(F.substring(body, 1, longest), F.lit("..."))).otherwise(body)
    piece = F.concat(F.lit("【切片"), F.col("_at").cast("string"), F.lit("】\n标题："), F.trim(F.coalesce("title", F.lit(""))), F.lit("\n内容："), cut)
    pieces = head.filter((body != "") | (F.trim(F.coalesce("title", F.lit(""))) != "")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", piece.alias("p")))).alias("_p"))
    return pieces.select(key, F.substring(F.array_join("_p.p", "\n\n"), 1, limit).alias("context"))


def contextual(title_path: Column, text: Column, images: Column) -> Column:
    """A chunk's text under its headings, with its images that have an address as Markdown; made from the parts each time, so that repeating it changes nothing."""
    base = F.trim(F.array_join(F.concat(title_path, F.array(text)), "\n"))
    shown = F.transform(F.filter(images, lambda i: i["uri"].rlike("^https?://")), lambda i: F.concat(F.lit("!["), F.coalesce(i["caption"], F.lit("")), F.lit("]("), i["uri"], F.lit(")")))
    return F.when(F.size(shown) > 0, F.concat(base, F.lit("\n\n"), F.array_join(shown, "\n"))).otherwise(base)


def replayed(cases: DataFrame, snapshot: DataFrame, key: str = "case_id") -> DataFrame:
    """Recorded results for all cases; a case that was not recorded gives an error row, a case recorded twice is an error."""
    twice = snapshot.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"recorded twice: {twice[0][key]}")
    met = cases.select(key).join(snapshot.withColumn("_had", F.lit(True)), key, "left")
    error = F.when(F.col("_had").isNull(), F.concat(F.lit("case missing from snapshot: "), F.col(key).cast("string"))).otherwise(F.col("error"))
    return met.withColumn("error", error).drop("_had")


def updated(current: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose key is among the changes take their values; changes without a row add none."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_changed"))
    met = current.join(new, key, "left")
    return met.select(*(F.when(F.col("_changed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))
