"""Composed documents and what lies beside them: artifacts by stem, a data source of document files, evidence frozen from labels."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

# Endings of artifact files, kinds and states of the document format, what frozen evidence says where labels say nothing.
ARTIFACTS = {"content": "_content_list_v2.json", "middle": "_middle.json"}
KINDS = ("title", "heading", "paragraph", "list", "table", "image", "code", "formula", "footnote", "page_header", "page_footer", "page_number", "other")
STATES = ("pending", "success", "partial", "failed", "quarantined", "review_required")
VERSIONS = ("1.0.0", "1.1.0")
NO_FACT, NO_ANSWER, IMAGE = "评测契约证据", "请以当前可核验的公开来源为准", "https://example.invalid/evaluation/control-panel.png"


def discovered(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, content_path, middle_path): each Markdown file with the artifacts beside it.

    In the file's own folder, that of its stem (without `_new`) comes first,
    then the first of any stem by name; null where there is none. Folders
    are joined, so a folder's files meet in one group by stem, not as all pairs.
    """
    folder, name = F.regexp_extract(path, r"^(.*?)[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    f = files.select(F.col(path).alias("path"), folder.alias("_folder"), name.alias("_name"))
    out = f.filter(F.lower("_name").rlike(r"\.(?:md|markdown)$")).withColumn("_stem", F.regexp_replace(F.regexp_replace("_name", r"\.[^.]*$", ""), "_new$", ""))
    for kind, ending in ARTIFACTS.items():
        have = f.filter(F.endswith("_name", F.lit(ending)))
        own = have.select("_folder", F.expr(f"left(_name, length(_name) - {len(ending)})").alias("_stem"), F.col("path").alias("_own"))
        first = have.groupBy("_folder").agg(F.min(F.struct("_name", "path")).alias("_f")).select("_folder", F.col("_f.path").alias("_first"))
        out = out.join(own, ["_folder", "_stem"], "left").join(first, "_folder", "left").withColumn(f"{kind}_path", F.coalesce("_own", "_first")).drop("_own", "_first")
    return out.select("path", "content_path", "middle_path")


DOCUMENT = (
    "path string, document_id string, revision_id string, status string, parser string, fault string, "
    "sections array<struct<section_id: string, parent_id: string, title: string, level: int, title_path: array<string>>>, "
    "blocks array<struct<position: bigint, block_id: string, lineage_id: string, kind: string, layer: string, level: int, section_id: string, title_path: array<string>, text: string, pages: array<int>>>"
)


def faults(d: object) -> Iterator[str]:
    """What speaks against a document: fields that lack or hold another type, unknown states and kinds, ids that repeat, references that lead nowhere."""
    if not isinstance(d, dict):
        yield "no object"
        return
    for name, kind in (("document_id", str), ("revision_id", str), ("status", str), ("source", dict), ("parser", dict), ("sections", list), ("blocks", list)):
        if not isinstance(d.get(name, [] if kind is list else None), kind):
            yield f"{name} is no {kind.__name__}"
            return
    if d.get("schema_version", VERSIONS[-1]) not in VERSIONS:
        yield "unknown version"
    if d["status"] not in STATES:
        yield f"unknown status {d['status']}"
    sections, blocks = d.get("sections", []), d.get("blocks", [])
    for what, rows, needed in (("section", sections, (("id", str), ("title", str), ("level", int))), ("block", blocks, (("id", str), ("type", str), ("text", str), ("order", int), ("section_id", str)))):
        if any(not isinstance(r, dict) or any(not isinstance(r.get(n), k) for n, k in needed) for r in rows):
            yield f"a {what} is incomplete"
            return
        ids = [r["id"] for r in rows]
        if len(ids) != len(set(ids)):
            yield f"a {what} id repeats"
    lineages = [b["lineage_id"] for b in blocks if b.get("lineage_id")]
    if len(lineages) != len(set(lineages)):
        yield "a lineage id repeats"
    if any(b["type"] not in KINDS or b.get("content_layer", "body") not in ("body", "furniture") for b in blocks):
        yield "unknown kind or layer"
    if any(s["level"] not in range(7) for s in sections) or any(b.get("heading_level") not in (None, *range(1, 7)) or b["order"] < 0 for b in blocks):
        yield "a number is out of range"
    known, named = {s["id"] for s in sections}, {b["id"] for b in blocks}
    if any(b["section_id"] not in known for b in blocks) or any(s.get("parent_id") and s["parent_id"] not in known for s in sections):
        yield "unknown section"
    if any(set(s.get("block_ids", [])) - named for s in sections):
        yield "unknown block"


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    paths: tuple[str, ...]


class DocumentReader(DataSourceReader):
    """Lists files when the read is planned, deals them by size, and opens them in tasks only."""

    def __init__(self, options: dict[str, str]):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.strict = options["path"], options.get("mode", "failfast").lower() == "failfast"
        self.ending, self.bytes = options.get("ending", ".ir.json"), int(options.get("partitionbytes", str(32 << 20)))

    def partitions(self) -> Sequence[InputPartition]:
        where, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else where.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(self.ending))
        parts: list[list[str]] = []
        room = 0
        for path, size in files:
            if not parts or room < size:
                parts.append([])
                room = self.bytes
            parts[-1].append(path)
            room -= size
        return [Files(tuple(p)) for p in parts] or [Files(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.paths:
            with where.open_input_stream(path) as f:
                raw = f.readall()
            try:
                d = json.loads(raw)
                wrong = "; ".join(faults(d))
            except ValueError:
                d, wrong = None, "no JSON"
            if wrong:
                if self.strict:
                    raise ValueError(f"{path}: {wrong}")
                yield (path, None, None, None, None, wrong, None, None)
            else:
                yield (path, d["document_id"], d["revision_id"], d["status"], str(d["parser"].get("name", "")), None, [self.section(s) for s in d.get("sections", [])], [self.block(b) for b in sorted(d.get("blocks", []), key=lambda b: b["order"])])

    @staticmethod
    def section(s: dict) -> tuple:
        return (s["id"], s.get("parent_id"), s["title"], s["level"], list(s.get("title_path", [])))

    @staticmethod
    def block(b: dict) -> tuple:
        pages = sorted({p["page_number"] for p in b.get("provenance", []) if p.get("page_number") is not None})
        return (b["order"], b["id"], b.get("lineage_id"), b["type"], b.get("content_layer", "body"), b.get("heading_level"), b["section_id"], list(b.get("title_path", [])), b["text"], pages)


class DocumentSource(DataSource):
    """`spark.read.format("lodestar_documents").load(folder)`: composed documents from JSON files, one row each (DOCUMENT).

    Options: `mode` is failfast (a document with a fault ends the job) or
    permissive (it is a row whose `fault` says what is wrong); `ending` of the
    files' names; `partitionBytes` a task reads.
    """

    @classmethod
    def name(cls) -> str:
        return "lodestar_documents"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(dict(self.options))


def documents(spark: SparkSession, path: str, mode: str = "failfast", **options: str) -> DataFrame:
    """Composed documents of a folder or file."""
    spark.dataSource.register(DocumentSource)
    return spark.read.format(DocumentSource.name()).options(mode=mode, **options).load(path)


def blocks(docs: DataFrame) -> DataFrame:
    """(document_id, revision_id, position, block_id, ...): the blocks of sound documents."""
    return docs.filter("fault IS NULL").select("document_id", "revision_id", F.inline("blocks"))


def _first_facts(facts: Column) -> Column:
    """The first wording of each fact that has one."""
    return F.filter(F.transform(facts, lambda f: F.get(f["any"], F.lit(0))), lambda x: x.isNotNull())


def frozen_evidence(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, rank, chunk_id, source, title, content, image_urls): evidence that a case's labels imply, one row per source they name.

    Cases (key, facts array<struct<any>>, sources array<struct<title, chunk_id, source>>, requires_image).
    """
    said = F.array_join(_first_facts(F.col("facts")), "；")
    content = F.when(said != "", said).otherwise(NO_FACT)
    image = F.coalesce("requires_image", F.lit(False))
    rows = cases.select(key, content.alias("_c"), image.alias("_i"), F.posexplode("sources").alias("_at", "s"))
    rank = (F.col("_at") + 1).cast("long")
    return rows.select(
        key, rank.alias("rank"), F.coalesce("s.chunk_id", F.concat(F.lit("contract-"), rank.cast("string"))).alias("chunk_id"), F.coalesce("s.source", F.lit("local")).alias("source"), "s.title",
        F.when(F.col("_i"), F.concat("_c", F.lit(f"\n![control panel]({IMAGE})"))).otherwise(F.col("_c")).alias("content"), F.when(F.col("_i"), F.array(F.lit(IMAGE))).otherwise(F.array().cast("array<string>")).alias("image_urls"),
    )


def frozen_answers(cases: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, answer): what a case's labels would have answered, cited and with an image where they ask for it."""
    cited = F.coalesce("requires_citation", F.lit(False))
    said = F.filter(_first_facts(F.col("facts")), lambda x: x != "")
    facts = F.array_join(F.transform(said, lambda x: F.when(cited, F.concat(F.trim(x), F.lit("。[1]"))).otherwise(F.trim(x))), "；")
    body = F.when(facts != "", facts).when(F.col("behavior") == "answer", NO_ANSWER).otherwise("")
    return cases.select(key, F.when(F.coalesce("requires_image", F.lit(False)), F.concat(body, F.lit(f"\n【图片】\n{IMAGE}"))).otherwise(body).alias("answer"))


def switched(pointers: DataFrame, incoming: DataFrame, key: str = "document_key", at: str = "written_at") -> DataFrame:
    """Current pointers (key, path, at) after some writes: the latest of each key, of equal times the larger path; older writes change nothing."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("path"))
    both = pointers.unionByName(incoming.select(*pointers.columns))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
