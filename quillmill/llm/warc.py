"""WARC archives under Zstandard: a reader, and the writer that tests it.

An archive is a skippable frame (magic 0x184D2A5D) that holds the compression
dictionary, plain or itself a Zstandard frame, and then one Zstandard frame for
every record. The dictionary frame may be missing; other skippable frames are
passed over. The reader finds the end of a frame by its block headers, so that each
record's byte range is known without decoding, decodes it alone, and checks

* the version line and the headers that every record must have,
* ``Content-Length`` against the block, and the two line ends after it,
* the digest of the payload, if it is given,
* for HTTP responses, their status line and ``Content-Length``.

A record that fails has ``valid`` false and the reason in ``error``; the next
one is read all the same. A frame whose end can't be found ends its archive with one
such row.

Defined cases: a null or empty archive gives no rows; in writing, a null page becomes
an empty payload and is read back as ``''``, a null or empty URL is left out of the headers
and read back as null; line ends and other control characters in a URL, and blanks at its
ends, are percent-encoded, as a header can't hold them, and are read back so; a null id
is read back as null; repeated rows are repeated records; an empty table gives an
empty table; a page's other columns aren't part of an archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.llm.sample import least
from quillmill.runtime import materialize, read_table

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORD = "record_no long, record_offset long, record_length long, record_type string, record_id string, url string, warc_date string, content_length long, status int, payload string, valid boolean, error string"


def frame_end(data: memoryview, at: int) -> int:
    """The offset after the frame that begins at ``at``; ValueError if it is cut off."""
    if len(data) < at + 8:
        raise ValueError("truncated frame")
    magic, size = struct.unpack_from("<II", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + size
    elif magic == FRAME_MAGIC:
        end = at + zstd.frame_header_size(data[at : at + 18])
        last = False
        while not last:
            if len(data) < end + 3:
                raise ValueError("truncated frame")
            block = int.from_bytes(data[end : end + 3], "little")
            last = block & 1
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 if data[at + 4] & 4 else 0
    else:
        raise ValueError("no frame begins here")
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def dictionary(data: memoryview) -> zstd.ZstdCompressionDict | None:
    """The dictionary in the leading skippable frame."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != DICTIONARY_MAGIC:
        return None
    raw = bytes(data[8 : frame_end(data, 0)])
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
    return zstd.ZstdCompressionDict(raw)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("malformed header line")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> tuple:
    """Type, id, URL, date, length, status, payload, valid, error."""
    fields: dict[str, str] = {}
    status = payload = None
    try:
        head, gap, rest = raw.partition(b"\r\n\r\n")
        version, _, lines = head.partition(b"\r\n")
        if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
            raise ValueError("no WARC version line")
        fields = _fields(lines)
        for name in MANDATORY:
            if not fields.get(name):
                raise ValueError(f"no {name}")
        if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
            raise ValueError("content-length differs from the block")
        block = rest[:-4]
        if rest[-4:] != b"\r\n\r\n":
            raise ValueError("no line ends after the block")
        if fields.get("content-type", "").startswith("application/http") and fields["warc-type"] == "response":
            http, gap, body = block.partition(b"\r\n\r\n")
            line, _, lines = http.partition(b"\r\n")
            if not gap or not line.startswith(b"HTTP/") or len(line.split()) < 2 or not line.split()[1].isdigit():
                raise ValueError("no HTTP status line")
            status = int(line.split()[1])
            inner = _fields(lines) if lines else {}
            if inner.get("content-length", str(len(body))) != str(len(body)):
                raise ValueError("HTTP content-length differs from the body")
        else:
            body = block
        payload = body.decode("utf-8", "replace")
        digest = fields.get("warc-payload-digest", "")
        if digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(body).digest()).decode():
            raise ValueError("payload digest differs")
        error = None
    except ValueError as e:
        error = str(e)
    length = fields.get("content-length", "")
    return fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), int(length) if length.isdigit() else None, status, payload, error is None, error


def read_archive(data: bytes | memoryview):
    """Rows of RECORD, one for each record of an archive."""
    data = memoryview(data)
    if not len(data):
        return
    at = number = 0
    try:
        decoder = zstd.ZstdDecompressor(dict_data=dictionary(data))
    except (ValueError, zstd.ZstdError):
        yield 0, 0, len(data), *[None] * 7, False, "unreadable dictionary"
        return
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (ValueError, zstd.ZstdError) as e:
            yield number, at, len(data) - at, *[None] * 7, False, str(e)
            return
        if struct.unpack_from("<I", data, at)[0] == FRAME_MAGIC:
            try:
                raw = decoder.decompressobj().decompress(data[at:end])
                found = parse_record(raw)
            except zstd.ZstdError:
                found = *[None] * 7, False, "undecodable frame"
            yield number, at, end - at, *found
            number += 1
        at = end


def records(archives: DataFrame) -> DataFrame:
    """The records of ``archives(archive, content)``: ``archive`` and the columns of RECORD."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in RECORD.split(", ")))

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for row in read_archive(content.as_buffer() if content.is_valid else b""):
                    rows.append((name, *row))
                    size += len(row[9] or "")
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), *(kinds[t] for t in types)])], names=["archive", *names])

    return archives.select(F.col("archive").cast("string"), "content").mapInArrow(run, "archive string, " + RECORD)


def read_warc_zst(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``. A file is one task's work and at most 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return records(files.select(F.col("path").alias("archive"), "content"))


def _uri(url: str) -> str:
    """The URL as it can stand in a header line."""
    bare = url.strip()
    ends = url[: len(url) - len(url.lstrip())], url[len(url.rstrip()) :] if bare else ""
    middle = re.sub(r"[\x00-\x1f\x7f-\x9f\u2028\u2029]", lambda m: quote(m[0]), bare)
    return quote(ends[0]) + middle + quote(ends[1])


def write_record(url: str | None, body: bytes, record_id: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    lines = [
        "WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", *([f"WARC-Target-URI: {_uri(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def write_archive(rows: list[bytes], trained: bytes | None) -> bytes:
    """An archive of records with the dictionary, compressed, before them."""
    out = []
    if trained:
        packed = zstd.ZstdCompressor().compress(trained)
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    coder = zstd.ZstdCompressor(level=3, write_checksum=True, dict_data=zstd.ZstdCompressionDict(trained) if trained else None)
    return b"".join([*out, *(coder.compress(r) for r in rows)])


def train_dictionary(pages: DataFrame, samples: int = 300, sample_bytes: int = 65_536, size: int = 65_536) -> bytes | None:
    """A dictionary from at most ``samples`` pages, ``sample_bytes`` characters of each.

    A setting of the encoder: it bounds what the driver holds and changes how small archives get, never what is read back.
    """
    some = least(pages.where("html is not null and length(html) > 0"), F.xxhash64("page_id", "url"), F.substring("html", 1, sample_bytes), samples)
    texts = [r[0].encode() for r in some.collect()]
    try:
        return zstd.train_dictionary(size, texts).as_bytes() if len(texts) >= 8 else None
    except zstd.ZstdError:
        return None  # too little to train on: archives without a dictionary are valid


def archive_pages(pages: DataFrame, trained: bytes | None, records_per_archive: int = 256) -> DataFrame:
    """``archive, content``: the pages as archives, in the order in which partitions hold them."""

    def run(batches):
        for batch in batches:
            ids, urls, html = (c.to_pylist() for c in batch.columns)
            for at in range(0, len(ids), records_per_archive):
                rows = [write_record(u, (h or "").encode(), f"<urn:page:{i}>") for i, u, h in zip(ids[at : at + records_per_archive], urls[at:], html[at:])]
                content = write_archive(rows, trained)
                name = str(uuid.UUID(bytes=hashlib.md5(content).digest()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "archive string, content binary")


def query(spark, sf_dir: str) -> DataFrame:
    """All pages, through written archives and back."""
    pages = read_table(spark, sf_dir, "pages")
    found = records(materialize(archive_pages(pages, train_dictionary(pages))))
    return found.select(
        F.expr(r"try_cast(regexp_extract(record_id, r'^<urn:page:(-?\d+)>$', 1) AS BIGINT)").alias("page_id"), "url", "record_type", "status", "content_length", F.col("payload").alias("html"), "valid", "error"
    )


SQL = """
SELECT page_id, url, 'response' AS record_type, CAST(200 AS INTEGER) AS status,
       CAST(strlen(html) + 77 + length(CAST(strlen(html) AS VARCHAR)) AS BIGINT) AS content_length, html, TRUE AS valid, CAST(NULL AS VARCHAR) AS error
FROM pages
"""
