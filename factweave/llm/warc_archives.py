"""WARC archives: pages written as crawl records, archives normalised to one gzip member a record, and read back by index.

Three stages, each over files that the shared folder holds:

1. write_archives() puts the records of each task into archives that are one gzip stream each. A page whose payload an
   earlier one (the smallest page_id) has is a revisit record without payload that refers to it.
2. normalised() inflates each archive once, from start to end with bounded memory, writes every record as a gzip member of
   its own and beside it an index of offsets, one JSON line a record.
3. read_records() goes through the index, inflates each member by itself and checks payloads against their digests.

A file is written under a name that no other attempt of its task uses, and counts only if the attempt's row names it, so
tasks can run again at any time. Archives that streams of several members make, that plain text makes or that end too early
are normalised as well: the last only up to the last whole record, and `whole` is false.

Null payloads are empty. Rows with the smallest page_id of their payload are all responses, repeated ones too; rows without
page_id come after those with one, and are responses if no row of their payload has a page_id. URLs are written with
control characters, spaces and angle brackets percent-encoded; null ones are left out. Empty tables give no rows; further
columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, remember, shared_dir, small_batches, table, written

ARCHIVE_BYTES, CHUNK = 256 << 20, 1 << 20
FEW_COPIES = 500_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20<>\x7f]")
MOST_HEADER = 1 << 20


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_key() -> list[Column]:
    """What equal payloads share: digest, length and a hash of another kind."""
    data = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return [F.unhex(F.sha1(data)).alias("digest"), F.octet_length(data).cast("long").alias("bytes"), F.xxhash64(data).alias("check")]


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, digest and first, the smallest page_id that has the same payload; null where no other row has it.

    Only keys are shuffled to find the payloads that occur again. They are broadcast if they are few; otherwise those with a
    large share of the rows are, and the others meet the pages in a shuffle.
    """
    key = ["digest", "bytes", "check"]
    keyed = pages.select("page_id", "url", "html", *payload_key())
    again = keyed.where(F.col("bytes") >= least).groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = written(again, "payloads")
    if again.count() <= FEW_COPIES:
        out = keyed.join(F.broadcast(again.drop("n")), key, "left")
    else:
        hot = again.where(F.col("n") > again.agg(F.sum("n")).first()[0] // HOT_SHARE)
        rest = keyed.join(F.broadcast(hot.select(*key)), key, "left_anti")
        out = keyed.join(F.broadcast(hot.drop("n")), key).unionByName(rest.join(again.drop("n"), key, "left"))
    return out.select("page_id", "url", "html", "digest", "first")


def head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record_id(page_id: int | None) -> str:
    return "<urn:x-page:none>" if page_id is None else f"<urn:x-page:{page_id}>"


def page_of(record: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?\d+)>", record or "")
    return int(m[1]) if m else None


def info_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, digest: bytes, first: int | None) -> Iterator[bytes]:
    """A response, or a revisit of the first page with that payload, which has the response's HTTP header and no payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    again = first is not None and page_id != first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    yield head([
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", url and UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", record_id(first) if again else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(http) + (0 if again else len(payload))),
    ])
    yield http
    if not again:
        yield payload
    yield b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of with_first() and gives (archive, records), a row for each file. Files hold about `most` bytes before compression."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        size = records = 0

        def end() -> Iterator[pa.RecordBatch]:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, at = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(at, recursive=True)
                    name = f"crawl-{uuid.uuid4().hex}.warc.gz"
                    out, path, deflate, size, records = fs.open_output_stream(f"{at}/{name}", compression=None), f"{folder}/{name}", zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                    out.write(deflate.compress(info_record()))
                for piece in page_record(*row):
                    out.write(deflate.compress(piece))
                    size += len(piece)
                records += 1
                if size >= most:
                    yield from end()
                    out = None
        if out is not None:
            yield from end()

    return rows.select("page_id", "url", "html", "digest", "first").mapInArrow(run, "archive string, records long")


def inflated(source) -> Iterator[bytes]:
    """The whole stream in pieces of bounded size: gzip of one member or several, or plain bytes; ends early where it is cut off or damaged."""
    data = source.read(CHUNK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = source.read(CHUNK)
        return
    member = zlib.decompressobj(31)
    while data:
        try:
            piece = member.decompress(data, CHUNK)
        except zlib.error:
            return
        if piece:
            yield piece
        data = member.unconsumed_tail
        if member.eof:
            data = member.unused_data
            member = zlib.decompressobj(31)
        data = data or source.read(CHUNK)


class Records:
    """Splits a stream into records: (headers, iterator over the record's bytes). Each record must be read to its end before the next."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.whole = pieces, bytearray(), True

    def fill(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.fill():
                self.whole = False
                return
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            yield part

    def __iter__(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        while self.whole:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if len(self.held) > MOST_HEADER or not self.fill():
                    self.whole = not self.held
                    return
            top = bytes(self.held[: end + 4])
            fields = headers(top)
            if not top.startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
                self.whole = False
                return
            yield fields, self.take(len(top) + int(fields["content-length"]) + 4)


def headers(top: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in top.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


def normalised(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, index, records, whole) of the archives rewritten into the folder; each is inflated once, in a task of its own.

    A record that the stream doesn't hold whole is not written: its member is built up aside until its last byte is there.
    """
    n = archives.count()

    def rewrite(path: str) -> tuple[str, str, int, bool]:
        fs, at = pafs.FileSystem.from_uri(path)
        to, out_at = pafs.FileSystem.from_uri(folder)
        to.create_dir(out_at, recursive=True)
        name = f"{path.rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex}"
        offset = count = 0
        with fs.open_input_stream(at, compression=None) as source, to.open_output_stream(f"{out_at}/{name}.warc.gz", compression=None) as out, to.open_output_stream(f"{out_at}/{name}.idx", compression=None) as index:
            records = Records(inflated(source))
            for fields, body in records:
                deflate, member = zlib.compressobj(6, zlib.DEFLATED, 31), []
                for piece in body:
                    member.append(deflate.compress(piece))
                if not records.whole:
                    break
                member = b"".join([*member, deflate.flush()])
                out.write(member)
                line = {"id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"), "offset": offset, "length": len(member)}
                index.write(json.dumps(line).encode() + b"\n")
                offset, count = offset + len(member), count + 1
        return f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", count, records.whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(("archive", "index", "records", "whole"), rewrite(path)))])

    return archives.select("archive").repartition(max(n, 1)).mapInArrow(run, "archive string, index string, records long, whole boolean")


def read_member(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record of a normalised archive."""
    source.seek(offset)
    data = zlib.decompress(source.read(length), 31)
    top, _, rest = data.partition(b"\r\n\r\n")
    fields = headers(top)
    return fields, rest[: int(fields["content-length"])]


def described(fields: dict[str, str], block: bytes) -> dict[str, object]:
    """What a page's record says; a payload that doesn't have the digest its header names is an error."""
    top, _, payload = block.partition(b"\r\n\r\n")
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(headers(top)["content-length"])
    if fields["warc-type"] == "response" and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": page_of(fields.get("warc-refers-to"))}


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archives: DataFrame) -> DataFrame:
    """A row for each page's record of normalised archives, through their indexes; an archive is a task."""
    n = archives.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path)
                ifs, index_at = pafs.FileSystem.from_uri(index)
                rows = []
                with fs.open_input_file(at) as source, ifs.open_input_stream(index_at, compression=None) as lines:
                    for line in map(json.loads, io.BufferedReader(lines)):
                        if line["type"] in ("response", "revisit"):
                            rows.append(described(*read_member(source, line["offset"], line["length"])))
                        if len(rows) == 2048:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return archives.select("archive", "index").repartition(max(n, 1)).mapInArrow(run, READ)


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archived(spark: SparkSession, pages: DataFrame, least: int = 0, most: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, index, records, whole) of the pages as normalised archives in the shared folder. The archives they were made from go."""
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = written(write_archives(with_first(pages, least), f"{base}/streams", most), "archives")
    out = written(normalised(made, f"{base}/members"), "members")
    if not out.where("not whole").isEmpty():
        raise ValueError("an archive just written doesn't inflate to its end")
    remember(spark, f"{base}/streams", gone=True)
    remember(spark, f"{base}/members")
    return out


def op11(spark, sf_dir) -> DataFrame:
    return read_records(archived(spark, table(spark, sf_dir, "pages")))


SQL11 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hexed AS (SELECT *, strlen(html) AS payload_bytes, sha1(html) AS h FROM p),
firsts AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT x.page_id, CAST(x.payload_bytes AS BIGINT) AS payload_bytes,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x.h, 5 * (j // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (j % 4))) & 31 AS BIGINT) + 1, 1), '' ORDER BY j) FROM range(32) t(j)) AS payload_digest,
    CASE WHEN x.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN x.page_id <> f.first THEN f.first END AS refers_to
FROM hexed x JOIN firsts f ON x.html = f.html"""
