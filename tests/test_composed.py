from __future__ import annotations

import json

import pytest

from lodestar.sources import composed as S


def document(i, **changes):
    d = {
        "schema_version": "1.1.0", "document_id": f"doc_{i}", "revision_id": "rev_1", "source": {}, "parser": {"name": "plain"}, "status": "success",
        "sections": [{"id": "s0", "title": "", "level": 0, "block_ids": ["b1", "b0"]}, {"id": "s1", "parent_id": "s0", "title": "T", "level": 1, "title_path": ["T"]}],
        "blocks": [{"id": "b1", "type": "paragraph", "text": "second é", "order": 1, "section_id": "s1", "title_path": ["T"], "provenance": [{"page_number": 2}, {"page_number": 1}, {}]}, {"id": "b0", "type": "heading", "text": "T", "order": 0, "section_id": "s1", "heading_level": 1, "lineage_id": "l"}],
    }
    return d | changes


def save(folder, name, value):
    path = folder / f"{name}.ir.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))


def test_documents_are_read_in_planned_parts(spark, tmp_path):
    for i in range(7):
        save(tmp_path / f"f{i % 2}", f"d{i}", document(i))
    (tmp_path / "other.json").write_text("{}")
    docs = S.documents(spark, str(tmp_path), partitionBytes="1500")
    assert docs.rdd.getNumPartitions() > 2
    assert sorted(r["document_id"] for r in docs.collect()) == [f"doc_{i}" for i in range(7)]
    b = S.blocks(docs).filter("document_id = 'doc_3'").orderBy("position").collect()
    assert [(r["block_id"], r["kind"], r["level"], list(r["pages"]), r["lineage_id"]) for r in b] == [("b0", "heading", 1, [], "l"), ("b1", "paragraph", None, [1, 2], None)]
    assert S.documents(spark, f"file://{tmp_path}/f0/d0.ir.json").first()["sections"][1]["title_path"] == ["T"]


BLOCK = {"id": "b", "type": "paragraph", "text": "", "order": 0, "section_id": "s0"}
FAULTS = [
    ("{", "no JSON"), ("[]", "no object"), (document(0, document_id=None), "document_id is no str"), (document(0, status="odd"), "unknown status odd"), (document(0, schema_version="9"), "unknown version"), (document(0, blocks=[BLOCK | {"text": None}]), "a block is incomplete"),
    (document(0, blocks=[BLOCK, BLOCK, BLOCK | {"id": "b1"}, BLOCK | {"id": "b0"}]), "a block id repeats"), (document(0, blocks=[BLOCK | {"id": x, "lineage_id": "l"} for x in ("b0", "b1")]), "a lineage id repeats"), (document(0, blocks=[BLOCK | {"id": x, "type": "poem"} for x in ("b0", "b1")]), "unknown kind or layer"),
    (document(0, blocks=[BLOCK | {"id": x, "heading_level": 7} for x in ("b0", "b1")]), "a number is out of range"), (document(0, blocks=[BLOCK | {"id": x, "section_id": "s9"} for x in ("b0", "b1")]), "unknown section"), (document(0, blocks=[]), "unknown block"),
]


def test_faults_are_rows_or_end_the_read(spark, tmp_path):
    for i, (value, _) in enumerate(FAULTS):
        save(tmp_path, f"d{i:02}", value)
    save(tmp_path, "fine", document(1))
    got = {r["path"].rsplit("/", 1)[1]: r["fault"] for r in S.documents(spark, str(tmp_path), mode="permissive").collect()}
    assert got == {f"d{i:02}.ir.json": fault for i, (_, fault) in enumerate(FAULTS)} | {"fine.ir.json": None}
    with pytest.raises(Exception, match="no JSON"):
        S.documents(spark, str(tmp_path)).collect()
    assert S.documents(spark, str(tmp_path), ending=".none").count() == 0


def test_artifacts_of_the_own_stem_come_first(spark):
    paths = ["/a/x_new.md", "/a/x_content_list_v2.json", "/a/a_content_list_v2.json", "/a/b_middle.json", "/a/a_middle.json", "/b/y.md", "/c/z.markdown", "/c/q_content_list_v2.json", "/c/n.txt"]
    got = {r["path"]: (r["content_path"], r["middle_path"]) for r in S.discovered(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {"/a/x_new.md": ("/a/x_content_list_v2.json", "/a/a_middle.json"), "/b/y.md": (None, None), "/c/z.markdown": ("/c/q_content_list_v2.json", None)}


def test_pointers_only_go_forward(spark):
    schema = "document_key string, path string, written_at long"
    have = spark.createDataFrame([("a", "p2", 2), ("b", "q", 1)], schema)
    new = spark.createDataFrame([("a", "p1", 1), ("b", "r", 1), ("c", "s", 5), ("c", "t", 4)], schema)
    assert sorted(tuple(r) for r in S.switched(have, new).collect()) == [("a", "p2", 2), ("b", "r", 1), ("c", "s", 5)]
