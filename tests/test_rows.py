from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import phrases as P
from lodestar.operators import gate as G
from lodestar.operators import rows as R
from lodestar.streaming import limits


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_vectors_of_a_document_fail_the_load(spark):
    rows = spark.createDataFrame([("", [1.0], {1: 0.5}), ("", [1.0, 2.0], {1: 0.5}), ("", None, None)], "document_id string, dense_vector array<double>, sparse_vector map<int,double>")
    assert R.valid_vectors(rows, 2).count() == 1
    bad = spark.createDataFrame([("d", [1.0], {1: 0.5})], rows.schema)
    with pytest.raises(Exception, match="other dimension"):
        R.valid_vectors(bad, 2).collect()


def test_an_import_holds_one_item(spark):
    rows = spark.createDataFrame([("a", "x"), (" a ", "y"), ("", "z"), ("a", None)], "item_name string, content string")
    assert R.graph_chunks(rows).count() == 2
    with pytest.raises(ValueError, match="one item"):
        R.graph_chunks(rows.union(spark.createDataFrame([("b", "x")], rows.schema)))


def test_replay_refuses_repeated_cases(spark):
    rows = spark.createDataFrame([(1, None), (1, None)], "case_id long, error string")
    with pytest.raises(ValueError, match="recorded twice"):
        R.replayed(rows.distinct(), rows)


def test_last_of_equal_sparse_keys_counts(spark):
    rows = spark.range(1).select(F.create_map(*map(F.lit, ("1", "0.5", "01", "2", "x", "1"))).alias("s"))
    assert R.coerced(rows, sparse="s").first()["s"] == {1: 2.0}


def test_numbered_headings(spark):
    r = one(spark, a=P.heading_number(F.lit("1.2.3 Title")), b=P.heading_number(F.lit("Title")), c=P.next_sibling(F.array(F.lit(1), F.lit(3)), F.array(F.lit(1), F.lit(2)), F.lit(1)), d=P.next_sibling(F.array(F.lit(1), F.lit(4)), F.array(F.lit(1), F.lit(2)), F.lit(0)), e=P.overlaps(F.lit(0), F.lit(3), F.lit(3), F.lit(5)))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ([1, 2, 3], None, True, False, False)


@pytest.mark.parametrize(("path", "ok"), [("a/b.png", True), ("a\\..\\b.JPG", True), ("../b.png", False), ("a/../../b.png", False), ("/b.png", False), ("c:\\b.png", False), ("data:x.png", False), ("b.exe", False), ("", False), (None, False), (".png", False)])
def test_image_paths(spark, path, ok):
    assert one(spark, r=P.safe_image_path(F.lit(path).cast("string")))["r"] is ok


def test_unknown_selector_fields_are_refused():
    with pytest.raises(ValueError, match="unknown selector"):
        G.selector_matches(F.lit(1), F.lit(1), ["colour"])


def test_stream_of_requests(spark, tmp_path):
    rows = [("a", f"2026-01-01 00:00:{s:02d}") for s in (0, 1, 2, 30)] + [("b", "2026-01-01 00:00:05"), ("a", "2026-01-01 00:01:01")]
    d = spark.createDataFrame(rows, "key string, ts string").select("key", F.col("ts").cast("timestamp").alias("ts"))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = limits.admitted(s, 2).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    # The idle timeout makes batches go on without data, so wait for the rows, not for the stream.
    for _ in range(120):
        if spark.table("admitted").count() >= len(rows):
            break
        time.sleep(0.5)
    q.stop()
    got = {(r["key"], r["ts"].strftime("%M:%S")): r["allowed"] for r in spark.table("admitted").collect()}
    assert got == {("a", "00:00"): True, ("a", "00:01"): True, ("a", "00:02"): False, ("a", "00:30"): False, ("b", "00:05"): True, ("a", "01:01"): True}
