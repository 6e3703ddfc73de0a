from __future__ import annotations

import hashlib

import random

from lodestar.llm import warc


def archive(n: int, gz: bool = True) -> list[bytes]:
    out = []
    for i in range(n):
        body = f"<p>page {i}</p>".encode() * (i + 1)
        plain = warc.record("response", f"<urn:page:{i}>", f"http://x/{i}", body, warc.digest(body), len(body))
        out.append(warc.member(plain) if gz else plain)
    return out


def test_whole_archives_read_without_gaps():
    for gz in (True, False):
        found = list(warc.salvage(b"".join(archive(20, gz))))
        assert [f.headers["warc-record-id"] for f in found] == [f"<urn:page:{i}>" for i in range(20)]


def test_damage_costs_only_the_records_it_touches():
    rng = random.Random(3)
    for gz in (True, False):
        for _ in range(40):
            parts = archive(12, gz)
            hurt = rng.sample(range(12), 3)
            for i in hurt:
                kind, p = rng.randrange(3), bytearray(parts[i])
                at = rng.randrange(len(p) // 4, len(p))
                parts[i] = bytes(p[:at]) if kind == 0 else bytes(p[:at] + bytes([p[at] ^ 0x55]) + p[at + 1 :]) if kind == 1 else b"noise \x1f\x8b\x08 WARC/1.1\r\n" + bytes(p)
            data = b"".join(parts)
            found = list(warc.salvage(data))
            ids = {f.headers["warc-record-id"] for f in found if f.kind == "response"}
            # A record cut short takes the start of its neighbour with it only if that neighbour's own start is gone.
            assert {f"<urn:page:{i}>" for i in range(12) if i not in hurt} <= ids
            spans = sorted((f.offset, f.offset + f.length) for f in found)
            assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
            assert all(f.reason for f in found if f.kind == "gap")


def test_round_trip_with_edges(spark):
    rows = [(1, "http://a", "same", 0), (3, "http://b", "same", 0), (2, None, None, 0), (4, "http://d", "", 0), (5, "http://e\r\nX: y", "é漢\r\n\r\nWARC/1.1", 0), (6, "http://f", "z" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, keeper int")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert got[3]["record_type"] == "response" and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 3
    assert got[2]["refers_to"] == 4 and got[2]["payload_bytes"] == 0 and got[1]["payload_digest"] == warc.digest(b"same")
    assert got[5]["payload_bytes"] == len("é漢\r\n\r\nWARC/1.1".encode()) and got[6]["payload_bytes"] == 300_000
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert warc.round_trip(pages.filter("page_id = 1").union(pages.filter("page_id = 1"))).count() == 2


def test_foreign_archives(spark, tmp_path):
    """Hex and lower-case digests, several records in a member, plain files, version strings inside payloads."""
    body = b"HTTP/1.1 200 OK\r\n\r\nsee WARC/1.0 for more"
    def rec(i, said, text=body):  # noqa: E306
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nWARC-Block-Digest: {said}\r\nContent-Type: application/http\r\nContent-Length: {len(text)}"
        return head.encode() + warc.END + text + warc.END
    hexed, small, wrong = f"sha1:{hashlib.sha1(body).hexdigest()}", f"SHA1:{warc.digest(body).lower()}", "sha256:" + "0" * 64
    pair = warc.member(rec(1, hexed) + rec(2, small))
    half = warc.member(rec(3, wrong) + rec(4, hexed))
    kinds = [(f.kind, f.headers.get("warc-record-id")) for f in warc.salvage(pair + b"junk" + half + rec(5, wrong) + rec(6, "crc32:1"))]
    assert kinds == [("response", "<r1>"), ("response", "<r2>"), ("gap", None), ("gap", None), ("response", "<r4>"), ("gap", None), ("response", "<r6>")]
    (tmp_path / "a.warc").write_bytes(rec(7, hexed))
    (tmp_path / "b.warc.gz").write_bytes(pair)
    got = {r["record_id"]: r["payload_bytes"] for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {f"<r{i}>": len(body) - 19 for i in (1, 2, 7)}


def test_search_for_the_next_record_is_linear():
    import time

    bad = b"WARC/1.0\r\nContent-Length: 9999999\r\n\r\nx\n"
    began = time.time()
    found = list(warc.salvage(bad * 60_000))
    assert [f.kind for f in found] == ["gap"] and time.time() - began < 20


def test_string_ids(spark):
    pages = spark.createDataFrame([("a b", "u", "x"), ("c>%", "u", "x"), (None, "u", "y")], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert got == {"a b": ("revisit", "c>%"), "c>%": ("response", None), None: ("response", None)}
