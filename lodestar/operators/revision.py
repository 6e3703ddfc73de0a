"""Two revisions of a document: pages, identity and structure of their blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import blocks as B
from .sized import written


def page_moves(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_uid, before_number, after_number) of pages (key, page_uid, number) that both have, at another number."""
    a, b = old.select(key, "page_uid", F.col("number").alias("before_number")), new.select(key, "page_uid", F.col("number").alias("after_number"))
    return a.join(b, [key, "page_uid"]).filter("before_number != after_number")


def page_matches(old: DataFrame, new: DataFrame, threshold: float = 0.70, margin: float = 0.08, key: str = "doc_id") -> DataFrame:
    """(key, before_number, after_number) of pages (key, number, text) that are clearly each other's best match; pages that repeat match nothing."""
    side = lambda d: d.select(key, F.col("number").alias("position"), "text")
    pairs = B.similar_pairs(side(old), side(new), [key], threshold - margin)
    return B.clear_best(pairs, threshold, margin, key).select(key, F.col("old").alias("before_number"), F.col("new").alias("after_number"))


#: What a block must have in common with another of its id to be that block.
PAYLOAD = ("kind", "layer", "text", "image_hash", "table_html")
#: Least similarity of changed blocks on pages, and of those without.
PAGED, UNPAGED = 0.78, 0.85


def _matched(old: DataFrame, new: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The blocks of both sides with `_is` (the position of the block that they are, by the exact rules) and `_rule`.

    Both sides and the pages' correspondence lie in one frame, dealt once by
    document; each rule is a window over it, by page, by id, by signature.
    """
    digest = lambda said: F.unhex(F.substring(F.sha2(said, 256), 1, 32))  # noqa: E731  16 bytes travel instead of texts and ids
    payload = digest(F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in PAYLOAD))))
    path = F.to_json("title_path")
    signature = F.when(F.col("layer") == "body", digest(F.to_json(F.array(F.col("kind"), path, F.col("text")))))
    side = lambda d, name: d.select(F.col(key), F.lit(name).alias("_side"), F.col("position").cast("long").alias("position"), digest(F.col("block_id")).alias("block_id"), "source_hash", "kind", "layer", path.alias("_path"), "text", F.col("page").cast("long").alias("page"), payload.alias("_payload"), signature.alias("_sig"), F.lit(None).cast("long").alias("_was"))
    a, b = side(old, "old"), side(new, "new")
    blank = {"_side": F.lit("page"), key: F.col(key), "page": F.col("after_number").cast("long"), "_was": F.col("before_number").cast("long")}
    kinds = dict(a.dtypes)
    turned = pages.select(*(blank.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in a.columns))
    rows = a.unionByName(b).unionByName(turned).repartition(key)
    by = lambda *c: Window.partitionBy(key, *c)
    is_ = lambda name: F.col("_side") == name
    rows = rows.withColumn("_was", F.when(is_("new") & F.col("page").isNotNull(), F.max("_was").over(by("page")))).filter(~is_("page"))
    place = F.struct("position", "source_hash", "_payload", "page", "_was")
    other = lambda w, what: F.when(is_("new"), F.max(F.when(is_("old"), what)).over(w)).otherwise(F.max(F.when(is_("new"), what)).over(w))
    rows = rows.withColumn("_o", F.when(F.col("block_id").isNotNull(), other(by("block_id"), place)))
    met = F.coalesce(F.when(is_("new"), F.col("_was") == F.col("_o.page")).otherwise(F.col("_o._was") == F.col("page")), F.lit(False))
    same = (F.col("_o._payload") == F.col("_payload")) & (F.coalesce(F.col("_o.source_hash") == F.col("source_hash"), F.lit(False)) | met)
    rows = rows.withColumn("_is", F.when(same, F.col("_o.position"))).withColumn("_rule", F.when(F.col("_is").isNotNull(), "same_place")).drop("_o")
    w = by("_sig")
    times = lambda name: F.count(F.when(is_(name), 1)).over(w)
    rows = rows.withColumn("_times", F.greatest(times("old"), times("new"))).withColumn("_o", other(w, F.struct("position", F.col("_is").isNull().alias("free"))))
    unique = F.col("_sig").isNotNull() & (F.col("_times") == 1) & F.col("_is").isNull() & F.coalesce(F.col("_o.free"), F.lit(False))
    return rows.withColumn("_rule", F.when(unique, "unique_signature").otherwise(F.col("_rule"))).withColumn("_is", F.when(unique, F.col("_o.position")).otherwise(F.col("_is"))).drop("_o")


def aligned(old: DataFrame, new: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, old, new, rule): which blocks of two revisions are one.

    Blocks are rows (key, position, block_id, source_hash, kind, layer,
    title_path, text, image_hash, table_html, page), `text` with white space
    normalised, `page` null where there is none, ids unique within a revision;
    `pages` (key, before_number, after_number) says which pages correspond.

    By id and payload (furniture too), from the same source bytes or on pages
    that correspond: with other bytes, a repeated block can stand at the same
    place by chance. Then by a signature of kind, title path and text that
    stands once in either whole revision, whatever was matched before. Then
    body blocks of one kind and title path, on pages that do not contradict,
    whose texts are each other's clear best match: 0.78 with a page, 0.85
    without. Equal texts that stand more than once are never told apart by that.
    """
    rows = _matched(old, new, pages, key)
    found = rows.filter("_side = 'new' AND _is IS NOT NULL").select(key, F.col("_is").alias("old"), F.col("position").alias("new"), F.col("_rule").alias("rule"))
    left = rows.filter("_is IS NULL AND layer = 'body'").select(key, "_side", "kind", "_path", "position", "text", "_sig", "_times", F.when(F.col("_side") == "old", F.col("page")).otherwise(F.coalesce("_was", F.when(F.col("page").isNotNull(), F.lit(-1)))).alias("uid"))
    one = lambda name: left.filter(F.col("_side") == name).drop("_side")
    repeated = (F.col("old__sig") == F.col("new__sig")) & (F.greatest("old__times", "new__times") > 1)
    apart = F.coalesce(F.col("old_uid") != F.col("new_uid"), F.lit(False))
    floor = F.when(F.col("new_uid").isNotNull(), PAGED).otherwise(UNPAGED)
    pairs = B.similar_pairs(one("old"), one("new"), [key, "kind", "_path"], PAGED, ~repeated & ~apart, floor)
    return found.unionByName(B.clear_best(pairs, PAGED, key=key).select(key, "old", "new", F.lit("fuzzy").alias("rule")))


def inherited(new: DataFrame, old: DataFrame, found: DataFrame, revision: Column | str = "revision_id", key: str = "doc_id", length: int = 24) -> DataFrame:
    """The new blocks with the lineage ids of the blocks that they are; no two blocks of a document end with one id.

    A block that is none of the old ones keeps its id unless a block has
    inherited it or an earlier one bears it. Then it gets one made of document, revision,
    block id and a number, the first number whose id is free. Only places and
    ids are looked at, in a table that is written once; rounds end when
    no id is taken twice, after the first unless digests collide.
    """
    said = F.col(revision) if isinstance(revision, str) else revision
    was = old.select(key, F.col("position").alias("old"), F.col("lineage_id").alias("_was"))
    mine = found.join(was, [key, "old"]).select(key, F.col("new").alias("position"), "_was")
    thin = new.select(key, "position", "block_id", F.col("lineage_id").alias("_own"), said.alias("_said"))
    both = thin.join(mine, [key, "position"], "left").withColumn("lineage_id", F.coalesce("_was", "_own"))
    order = Window.partitionBy(key, "lineage_id").orderBy(F.col("_was").isNull(), "position")
    ranked = written(both.withColumn("_n", F.row_number().over(order)), "lineage")
    keeps = F.col("_was").isNotNull() | (F.col("_n") == 1)
    done = ranked.filter(keeps).select(key, "position", "lineage_id")
    clash = ranked.filter(~keeps).select(key, "position", "block_id", "_said")
    nonce = 0
    while not clash.isEmpty():
        made = clash.withColumn("lineage_id", T.stable_id("lin", F.col(key), F.lit("unmatched"), F.col("_said"), F.col("block_id"), F.lit(nonce), length=length))
        first = F.row_number().over(Window.partitionBy(key, "lineage_id").orderBy("position"))
        taken = done.select(key, "lineage_id", F.lit(True).alias("_taken")).distinct()
        tried = written(made.withColumn("_n", first).join(taken, [key, "lineage_id"], "left"), "lineage")
        free = (F.col("_n") == 1) & F.col("_taken").isNull()
        done = done.unionByName(tried.filter(free).select(*done.columns))
        clash = tried.filter(~free).select(*clash.columns)
        nonce += 1
    return new.drop("lineage_id").join(done, [key, "position"]).select(*new.columns)


def difference(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, unchanged, modified, added, removed, moved): sorted lineage ids by what became of them; `moved`: those whose section is another.

    Rows (key, lineage_id, signature, section).
    """
    a = old.select(key, "lineage_id", F.col("signature").alias("_a"), F.col("section").alias("_s"))
    b = new.select(key, "lineage_id", F.col("signature").alias("_b"), F.col("section").alias("_t"))
    both = a.join(b, [key, "lineage_id"], "full_outer")
    had, has = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    pick = lambda name, c: F.sort_array(F.collect_set(F.when(c, F.col("lineage_id")))).alias(name)
    same = F.col("_a") == F.col("_b")
    return both.groupBy(key).agg(pick("unchanged", had & has & same), pick("modified", had & has & ~same), pick("added", ~had & has), pick("removed", had & ~has), pick("moved", had & has & ~F.col("_s").eqNullSafe(F.col("_t"))))


def revision_id(rows: DataFrame, source_hash: Column, parser: str, version: str, key: str = "doc_id") -> DataFrame:
    """(key, revision_id) from the source's hash, the parser and the ordered signatures of the blocks (key, position, signature)."""
    ordered = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("position", "signature"))), lambda x: x["signature"]))
    made = rows.groupBy(key, source_hash.alias("_source")).agg(ordered.alias("_o"))
    return made.select(key, F.concat(F.lit("rev_"), F.substring(F.sha2(F.to_json(F.array("_source", F.lit(parser), F.lit(version), "_o")), 256), 1, 32)).alias("revision_id"))


def document_id(explicit: Column, content_hash: Column) -> Column:
    """From an explicit key if there is one that is not blank, else from the content; never from a file's name."""
    return F.when(F.trim(F.coalesce(explicit, F.lit(""))) != "", T.stable_id("doc", F.trim(explicit))).otherwise(F.concat(F.lit("doc_"), F.substring(content_hash, 1, 24)))


def parse_action(status: Column, attempt: Column, attempts: Column) -> Column:
    """What follows from the outcome of a parse."""
    return (
        F.when(status == "success", "continue").when(status == "partial", "continue_with_warnings").when(status == "review_required", "manual_review").when(status == "pending", "stop")
        .when((status == "failed") & (attempt < attempts), "retry").when(status.isin("failed", "quarantined"), "quarantine").otherwise("stop")
    )
