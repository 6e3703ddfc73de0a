from __future__ import annotations

import json

import pytest

from lodestar.sources import artifacts as A


def test_artifacts(spark):
    rows = [(1, json.dumps([[{"type": "title", "content": {"title_content": [{"content": "A"}, {"content": "B"}], "level": 2}}, 7], [{"type": "image", "content": {"image_source": {"path": "i.png"}}}]])), (2, "{broken"), (3, "[]"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, json string")
    got = {(r["doc_id"], r["page"], r["type"]): (r["text"], r["level"], r["image"]) for r in A.items(d).collect()}
    assert got == {(1, 1, "title"): ("AB", 2, None), (1, 2, "image"): ("", None, "i.png")}
    assert {r["doc_id"] for r in A.unreadable(d).collect()} == {2, 4}


def test_objects_prices_and_releases(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in A.objects(spark, str(tmp_path / "o.jsonl"), "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('[1]\n')
    with pytest.raises(Exception, match="no JSON object"):
        A.objects(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": "1.0", "models": {"m": [{"max_input": 10, "input_rate": 1.0, "output_rate": 2.0}]}}))
    (price,) = A.price_book(spark, str(tmp_path / "p.json")).collect()
    assert price["model"] == "m" and price["max_input"] == 10 and len(price["fingerprint"]) == 64
    good = {"release_id": "r", "candidate": {"k": "v1"}, "rollback": {"k": "v0"}}
    rows = lambda x: spark.createDataFrame([(json.dumps(x),)], "json string")
    assert {(r["side"], r["value"]) for r in A.release(rows(good), ["k"]).collect()} == {("candidate", "v1"), ("rollback", "v0")}
    for bad in ({**good, "candidate": {}}, {**good, "rollback": {"k": "a b"}}):
        with pytest.raises(Exception, match="unsafe"):
            A.release(rows(bad), ["k"]).collect()


def test_a_snapshot_is_written_once(spark, tmp_path):
    A.write_once(spark.range(2), str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exists"):
        A.write_once(spark.range(2), str(tmp_path / "s"))
