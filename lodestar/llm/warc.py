"""WARC archives: a deduplicating writer and a salvage reader.

The writer makes one gzip member per record. Records with equal payloads keep
one response; the others become revisit records that refer to it. Files are
written by the tasks straight to a shared folder: under a name of the attempt
first, then moved to their final name, so a task that runs again replaces its
own file and a lost executor leaves nothing behind that is read.

The salvage reader walks an archive member by member (or, for plain archives,
from version line to version line). A record that fails a check (broken
member, bad header, wrong length or digest) opens a gap; the reader searches
for the next member or version line where a record passes all checks (in the
middle of a line it must have a digest), goes on there, and logs the bytes
between as a quarantined gap. Each mark is searched for once, however many
records fail. A member may hold several records: those that pass are kept, the
others logged. Digests may be base32 or hex in any case.

Defined cases: a null payload counts as empty; repeated rows give a record
each, and rows that equal the kept one in id and payload are all responses; a
null page id is below every other; a record is held in memory whole, so a
payload must fit there several times; the records of one very common payload
are written by the tasks that Spark's join deals them to, one if it does not
split them; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, scratch, text_or_empty

#: An archive file is closed once it holds so many bytes, so that one fits a reader's row.
FILE_BYTES = 32 << 20
VERSION = b"WARC/1."
GZIP = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: A record's header ends within so many bytes.
HEAD_BYTES = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, payload_digest: str, payload_bytes: int, refers_to: str | None = None) -> bytes:
    """One record; a revisit has the HTTP head without the payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % payload_bytes + END
    body += payload if kind == "response" else b""
    uri = uri.replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(body)}", f"X-Payload-Length: {payload_bytes}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + END + body + END


def record_id(key: object) -> str:
    """A key of any type as a record id; a lone percent sign stands for null."""
    return f"<urn:page:{'%' if key is None else urllib.parse.quote(str(key), safe='-')}>"


def member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Found:
    """A record that passed its checks, or (`kind` "gap") bytes that were given up, with the reason."""

    kind: str
    offset: int
    length: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    reason: str = ""


class Bad(Exception):
    pass


def agrees(said: str, data: bytes) -> bool:
    """Whether a digest header fits the data: base32 or hex, in any case; an algorithm that is not known here proves nothing."""
    name, _, value = said.partition(":")
    if name.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    raw, value = hashlib.new(name.lower().replace("-", ""), data).digest(), value.strip().rstrip("=").lower()
    return value in (raw.hex(), base64.b32encode(raw).decode().rstrip("=").lower())


def _parse(data: bytes, at: int = 0) -> tuple[Found, int]:
    """The record of an uncompressed buffer at `at`, and where it ends; Bad if a check fails."""
    if data[at : at + len(VERSION)] != VERSION:
        raise Bad("no version line")
    split = data.find(END, at, at + HEAD_BYTES)
    if split < 0:
        raise Bad("header without end")
    headers = {}
    for line in data[at:split].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Bad("bad header line")
        headers[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        raise Bad("no content length") from None
    start, stop = split + len(END), split + len(END) + length
    if length < 0 or data[stop : stop + len(END)] != END:
        raise Bad("wrong length")
    body = data[start:stop]
    if (said := headers.get("warc-block-digest")) and not agrees(said, body):
        raise Bad("wrong block digest")
    payload = body
    if headers.get("content-type", "").startswith("application/http"):
        cut = body.find(END)
        if cut < 0:
            raise Bad("HTTP head without end")
        payload = body[cut + len(END) :]
    if headers.get("warc-type") == "response" and (said := headers.get("warc-payload-digest")) and not agrees(said, payload):
        raise Bad("wrong payload digest")
    return Found(headers.get("warc-type", ""), at, stop + len(END) - at, headers, payload), stop + len(END)


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at `at`, and where it ends; the member is inflated in steps, so that what follows it is not copied."""
    unpacker, parts, pos, view = zlib.decompressobj(31), [], at, memoryview(data)
    try:
        while not unpacker.eof and pos < len(data):
            step = view[pos : pos + 16384]
            parts.append(unpacker.decompress(step))
            pos += len(step)
    except zlib.error as e:
        raise Bad(f"broken member: {e}") from None
    if not unpacker.eof:
        raise Bad("member without end")
    return b"".join(parts), pos - len(unpacker.unused_data)


class _Places:
    """The next place from a position on where a member or a version line can start; each mark is searched for once over the whole archive."""

    def __init__(self, data: bytes, packed: bool):
        self.data, self.next = data, {VERSION: -1, **({GZIP: -1} if packed else {})}

    def after(self, at: int) -> int:
        for mark, known in self.next.items():
            if known < at:
                found = self.data.find(mark, at)
                self.next[mark] = found if found >= 0 else len(self.data)
        return min(self.next.values())


def _walk(data: bytes, packed: bool) -> Iterator[Found]:
    """Records and gaps of a buffer; `packed`: it may hold gzip members."""
    at, gap, reason, places = 0, None, "", _Places(data, packed)
    while at < len(data):
        try:
            if packed and data[at : at + len(GZIP)] == GZIP:
                plain, end = _inflate(data, at)
                inner = list(_walk(plain, False))
                if not any(f.kind != "gap" for f in inner):
                    raise Bad(inner[0].reason if inner else "empty member")
                for f in inner:
                    # Inside a member there are no places of the file: say which bytes of its content they were.
                    if f.kind == "gap":
                        f.reason += f" (bytes {f.offset} to {f.offset + f.length} of the member's content)"
                    f.offset, f.length = at, end - at
            else:
                found, end = _parse(data, at)
                if gap is not None and data[at - 1] != 0x0A and "warc-block-digest" not in found.headers:
                    # In the middle of a line only a digest tells a record from the text of a payload.
                    raise Bad("no digest")
                inner = [found]
        except Bad as e:
            if gap is None:
                gap, reason = at, str(e)
            at = places.after(at + 1)
            continue
        if gap is not None:
            yield Found("gap", gap, at - gap, reason=reason)
            gap = None
        yield from inner
        at = end
    if gap is not None:
        yield Found("gap", gap, len(data) - gap, reason=reason)


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive in order, and the gaps between them as records of kind `gap`."""
    return _walk(data, True)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        target, root = _filesystem(folder)
        target.create_dir(root, recursive=True)
        files: list[tuple[str, int, int]] = []
        out, name, temp, size, n = None, "", "", 0, 0

        def close() -> None:
            out.close()
            target.move(temp, f"{root}/{name}")
            files.append((name, n, size))

        for batch in batches:
            for page, uri, html, keeper, sha in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                payload = html.encode()
                revisit = keeper != page
                said = base64.b32encode(bytes.fromhex(sha)).decode()
                data = member(record("revisit" if revisit else "response", record_id(page), uri or "", payload, said, len(payload), record_id(keeper) if revisit else None))
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(files):04d}.warc.gz"
                    temp, size, n = f"{root}/_{name}.{task.taskAttemptId()}.{os.getpid()}", 0, 0
                    out = target.open_output_stream(temp)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())], names=["file", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages below `folder`; returns the kept list of files (file, records, bytes)."""
    body = pages.select(F.col(key).alias("page"), F.col(url).alias("uri"), text_or_empty(html).alias("html"))
    body = body.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    keepers = body.groupBy("sha").agg(F.max("page").alias("keeper"))
    rows = body.join(keepers, "sha").select("page", "uri", "html", "keeper", "sha")
    return keep(rows.mapInArrow(_writer(folder, file_bytes), "file string, records long, bytes long"), "files")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records and gaps of all archives below `folder`, one row each."""
    schema = "file string, kind string, offset long, length long, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, reason string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for f in salvage(data):
                    h = f.headers
                    full = f.kind == "response"
                    said = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    length = len(f.payload) if full or f.kind not in ("gap", "revisit") else int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None
                    rows.append((path, f.kind, f.offset, f.length, h.get("warc-record-id"), h.get("warc-target-uri"), digest(f.payload) if full else said, length, h.get("warc-refers-to"), f.payload if full else None, f.reason or None))
                    held += len(f.payload)
                    if held > 8 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder).select("path", "content")
    return files.mapInArrow(read, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write `pages` as archives in the shared folder and return what the salvage reader finds there, one row per record.

    What was just written has no gaps; should the reader find one, the query fails instead of returning fewer rows.
    """
    spark = pages.sparkSession
    folder, kind = scratch(spark, "warc"), pages.schema[key].dataType.simpleString()
    files = write_archives(pages, folder, key, url, html)
    if not files.count():
        return spark.createDataFrame([], f"{key} {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}")
    name = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    back = lambda c: F.when(name(c) != "%", F.try_url_decode(name(c))).cast(kind)
    found = read_archives(spark, folder)
    lost = F.raise_error(F.concat(F.lit("gap in "), "file", F.lit(": "), "reason")).cast("string")
    record_type = F.when(F.col("kind") == "gap", lost).otherwise(F.col("kind"))
    return found.select(back("record_id").alias(key), "payload_bytes", "payload_digest", record_type.alias("record_type"), back("refers_to").alias("refers_to"))
