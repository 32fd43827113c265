"""WARC archives: one gzip member per record, written in tasks and read back sequentially."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import hot_lookup, pages, persist_table

#: Payloads shorter than this are never deduplicated; archives are closed at about this size.
LEAST_REVISIT, ARCHIVE_BYTES = 100, 8 << 20
CHUNK = 1 << 14
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class BrokenArchive(ValueError):
    """An archive that is cut short, ill framed or does not match its digests."""


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_uri(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    deflate = zlib.compressobj(4, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    return deflate.compress(raw) + deflate.flush()


def _members(content: bytes) -> Iterator[bytes]:
    """The archive's members, inflated chunk by chunk; each must end before the next begins."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(view):
                raise BrokenArchive("the last member is cut short")
            chunk = view[at : at + CHUNK]
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error as e:
                raise BrokenArchive(str(e)) from None
            at += len(chunk)
        at -= len(inflate.unused_data)
        yield b"".join(parts)


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.decode("utf-8", "surrogatepass").partition(": ") for x in lines)}


def read_archive(content: bytes) -> Iterator[dict]:
    """Records in order, framed by Content-Length, with block and payload digests verified."""

    def page(uri: str) -> int | None:
        return int(x) if (x := uri[len("<urn:x-page:") : -1]) else None

    for raw in _members(content):
        top, sep, rest = raw.partition(b"\r\n\r\n")
        lines = top.split(b"\r\n")
        head = _fields(lines[1:])
        size = int(head.get("content-length", -1))
        if not sep or lines[0] != b"WARC/1.1" or size < 0 or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise BrokenArchive("a record is ill framed")
        block = rest[:size]
        if "sha256:" + hashlib.sha256(block).hexdigest() != head["warc-block-digest"]:
            raise BrokenArchive("a block does not match its digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        length, digest = int(_fields(http.split(b"\r\n")[1:])["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
        kind, url = head["warc-type"], head.get("warc-target-uri")
        if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
            raise BrokenArchive("a payload does not match its digest")
        yield {
            "page_id": page(head["warc-record-id"]),
            "url": None if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
            "payload_bytes": length,
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": page(head["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None,
        }


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, count, parts, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def archive():
        return pa.RecordBatch.from_pydict({"archive": [base + count], "content": pa.array([b"".join(parts)], pa.binary())})

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
            parts.append(record(page_id, url, html, digest, refers_to))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                count, parts, size = count + 1, [], 0
    if parts:
        yield archive()


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives ``archive, content``, a record for every row; kept as a table in the shared folder.

    The payload is the html in UTF-8 (null: empty). Among equal payloads of LEAST_REVISIT bytes or
    more, rows with the smallest id are responses and the others revisit it; a null id is never
    the smallest (without any other id: response). Extra columns are ignored.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    groups = persist_table(
        rows.where(F.octet_length("html") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null"),
        "payloads",
    )
    total = groups.agg(F.sum("n")).first()[0] or 0
    known = hot_lookup(rows, groups, "digest", "n", "first", total)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    dealt = known.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return persist_table(dealt.mapInArrow(_write, "archive long, content binary"), "warc")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of all archives; a broken archive raises. ``payloads=False`` leaves them null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held = []
                for r in read_archive(content):
                    held.append(r if payloads else r | {"payload": None})
                    if len(held) >= 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("content").mapInArrow(run, _RECORDS)


def round_trip(spark, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(pages(spark, sf_dir)), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has the same verdicts without the archives.
ROUND_TRIP_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
