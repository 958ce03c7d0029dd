"""WARC archives: writer, normaliser of monolithic gzip files, and reader by offset index.

An archive is a row (archive, body[, sidecar]): a table of archives can be
written and read through any store that Spark knows and survives lost tasks.
``load_archives`` and ``export_archives`` exchange them with files.

Many crawls arrive as one gzip stream per file, which allows no access to a
record without inflating all before it. The normaliser inflates each such
stream once, piece by piece, rewrites every record as a gzip member of its own
and writes a sidecar index, one line a record: offset, length, type, id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinmill.runtime import arrow_batch_rows, settle, table

_GZIP = 31
_STEP = 1 << 20
_ID = "urn:x-page:"


def _header_value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record(page_id: int | None, url: str | None, html: bytes, sha1_hex: str, response_id: int | None, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http if is_revisit else http + html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if is_revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{response_id}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(archive_bytes: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size, stream, body = TaskContext.get().partitionId(), 0, 0, None, []

        def done() -> pa.RecordBatch:
            body.append(stream.flush())
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{seq:05d}"]), pa.array([b"".join(body)], pa.binary())], names=["archive", "body"])

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6)), strict=True):
                page_id, url, html, sha1_hex, response_id, revisit = (x.as_py() for x in row)
                stream = stream or zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                record = _record(page_id, url, html.encode(), sha1_hex, response_id, revisit)
                body.append(stream.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield done()
                    seq, size, stream, body = seq + 1, 0, None, []
        if stream:
            yield done()

    return write


def write_monolithic(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = 16 << 20, level: int = 1) -> DataFrame:
    """Archives (archive, body), each one gzip stream, with a record per row of ``pages``.

    Of the records with equal payloads of at least ``min_bytes`` bytes the one
    with the largest id is the response and the others are revisits of it;
    smaller payloads are all responses. Null html is an empty payload. Rows that
    repeat the largest id are responses too; a null id is never the largest
    unless all are null, and then all are responses. A page larger than
    ``archive_bytes`` has an archive to itself. An empty table gives none.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    own = own.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    keys = own.select("page_id", "sha1", F.octet_length("html").alias("size"))
    last = keys.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("response_id"))
    roles = (
        keys.select("page_id", "sha1").distinct().join(last, "sha1", "left")
        .select(F.col("page_id").alias("role_id"), F.col("sha1").alias("role_sha1"), "response_id")
    )
    with_role = own.join(roles, F.col("page_id").eqNullSafe(F.col("role_id")) & (F.col("sha1") == F.col("role_sha1")))
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return with_role.select("page_id", "url", "html", "sha1", "response_id", revisit.alias("revisit")).mapInArrow(_writer(archive_bytes, level), "archive string, body binary")


def _inflated(body: bytes) -> Iterator[bytes]:
    """The bytes of one or more gzip members, inflated once and in bounded pieces."""
    view = memoryview(body)
    while len(view):
        z, used = zlib.decompressobj(_GZIP), 0
        while not z.eof:
            data = z.unconsumed_tail or view[used : used + _STEP]
            if not z.unconsumed_tail:
                used += len(data)
            if not len(data):
                raise ValueError("the gzip stream ends early")
            yield z.decompress(data, 4 * _STEP)
        view = view[used - len(z.unused_data) :]


def _header(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of each record of a WARC stream that comes in pieces."""
    buffer = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while buffer or more():
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if not buffer.strip():
                    return
                raise ValueError("the archive ends in a record's header")
        if not buffer.startswith(b"WARC/"):
            raise ValueError("no WARC record where one is due")
        header = _header(bytes(buffer[:end]))
        size = end + 4 + int(header["content-length"]) + 4
        while len(buffer) < size:
            if not more():
                raise ValueError("the archive ends in a record's block")
        yield header, bytes(buffer[:size])
        del buffer[:size]


def _normaliser(level: int):
    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, lines, offset = [], [], 0
                for header, record in _records(_inflated(batch.column(1)[i].as_py())):
                    z = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                    member = z.compress(record) + z.flush()
                    lines.append(f"{offset} {len(member)} {header['warc-type']} {header['warc-record-id']}\n")
                    out.append(member)
                    offset += len(member)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([b"".join(out)], pa.binary()), pa.array(["".join(lines)])], names=["archive", "body", "sidecar"])

    return normalise


def normalise_archives(archives: DataFrame, level: int = 1) -> DataFrame:
    """(archive, body, sidecar) of archives (archive, body) that are gzip streams of any number of members.

    A null or empty body has no records. A stream or record that ends early is
    an error naming what is missing, never a silent loss.
    """
    own = archives.select("archive", F.coalesce("body", F.lit(b"")).alias("body"))
    return own.mapInArrow(_normaliser(level), "archive string, body binary, sidecar string")


def offset_index(normalised: DataFrame) -> DataFrame:
    """The sidecars as a table: archive, offset, length, type, record_id."""
    line = normalised.select("archive", F.explode(F.split(F.regexp_replace("sidecar", r"\n$", ""), r"\n")).alias("line")).where("line <> ''")
    part = F.split("line", " ")
    return line.select("archive", part[0].cast("long").alias("offset"), part[1].cast("long").alias("length"), part[2].alias("type"), part[3].alias("record_id"))


def _number(text: str | None) -> int | None:
    digits = (text or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for body, sidecar in zip(batch.column(0), batch.column(1), strict=True):
            body, rows = body.as_py(), []
            for line in sidecar.as_py().splitlines():
                offset, length = map(int, line.split(" ")[:2])
                header, record = next(_records(iter([zlib.decompress(body[offset : offset + length], _GZIP)])))
                block = record[record.find(b"\r\n\r\n") + 4 : -4]
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = header["warc-type"]
                size = int(_header(head).get("content-length", len(payload)))
                digest = header["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"the payload of {header['warc-record-id']} is not the one its header names")
                rows.append((_number(header["warc-record-id"]), header.get("warc-target-uri"), size, digest, kind, _number(header.get("warc-refers-to")), None if kind == "revisit" else payload))
                if len(rows) >= 256:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def read_archives(normalised: DataFrame) -> DataFrame:
    """One row per record, each inflated by itself from its place in the sidecar; a revisit's payload is null.

    Length and SHA-1 of every response's payload are worked out from what was inflated and must be those of its header.
    """
    return normalised.select("body", "sidecar").mapInArrow(
        _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )


def load_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives from .gz files under ``path`` (each below Spark's limit for binary files)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.warc)?\.gz$", 1).alias("archive"), F.col("content").alias("body"))


def export_archives(normalised: DataFrame, folder: str) -> None:
    """Write ``<archive>.warc.gz`` and ``<archive>.warc.gz.idx`` files into a folder that all executors mount. Each
    file is renamed into place when complete, so a repeated task leaves whole files."""

    def save(rows) -> None:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for row in rows:
            for name, data in ((f"{row.archive}.warc.gz", row.body), (f"{row.archive}.warc.gz.idx", row.sidecar.encode())):
                part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, name))

    normalised.foreachPartition(save)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with arrow_batch_rows(spark, 64):
        monolithic = settle(write_monolithic(table(spark, sf_dir, "pages")), "warc-monolithic")
    with arrow_batch_rows(spark, 1):
        normalised = settle(normalise_archives(monolithic), "warc-normalised")
        records = settle(read_archives(normalised).drop("payload"), "warc-records")
    return records.drop("url")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
hexed AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', h[i + 1]) - 1) AS x FROM d),
bits AS (SELECT *, list_transform(range(0, 32), lambda i:
  ((x[i * 5 // 4 + 1] * 16 + coalesce(x[i * 5 // 4 + 2], 0)) // (2 ** (3 - (i * 5) % 4))::BIGINT) % 32) AS five FROM hexed)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(five, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v::BIGINT + 1]), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM bits
"""
