"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record with an offset index, and read back.

write_archives() writes records into archives of bounded size, each a single
gzip stream. normalise() inflates such a stream once, from start to end, and
rewrites every record as a member of its own; the sidecar index has each
record's offset and length, so that a reader can take one record out.

Pages: a null html counts as empty, a null url is left out of the record. Of
records with equal payloads of at least `least` bytes, those with the largest
page_id are responses and the others revisit it; a page without page_id never
is the one that others revisit, unless none has an id (all are responses then).
Repeated rows are recorded each by itself. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetta.llm.common import materialize

LEAST = 1000
ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 16
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def record_id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record. A revisit has the response's HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + END + body + END


def headers(block: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in block.decode("utf-8").split("\r\n")[1:])}


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, which is held only from the record's start on."""
    held = bytearray()
    for piece in stream:
        held += piece
        while (at := held.find(END)) >= 0:
            size = int(re.search(rb"(?mi)^Content-Length: *(\d+)", held[:at])[1])
            end = at + len(END) + size + len(END)
            if len(held) < end:
                break
            yield bytes(held[:end])
            del held[:end]
    if held:
        raise ValueError("the archive ends within a record")


def inflate(archive: bytes) -> Iterator[bytes]:
    """The stream in pieces of at most CHUNK bytes."""
    unzip = zlib.decompressobj(31)
    for at in range(0, len(archive), CHUNK):
        data = archive[at : at + CHUNK]
        while data:
            yield unzip.decompress(data, CHUNK)
            data = unzip.unconsumed_tail
    yield unzip.flush()
    if not unzip.eof:
        raise ValueError("the archive ends within its gzip stream")


def deflate(data: bytes) -> bytes:
    zipper = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return zipper.compress(data) + zipper.flush()


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page whose payload is the same, null for a response."""
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = full.where(F.octet_length("html") >= least).select("page_id", F.sha1("html").alias("sha1"))
    groups = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    again = keys.join(groups, "sha1").where("page_id is null or page_id < refers_to").select(F.col("page_id").alias("id"), F.col("sha1").alias("of"), "refers_to").distinct()
    large = F.when(F.octet_length("html") >= least, F.sha1("html"))
    return full.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (large == F.col("of")), "left").select("page_id", "url", "html", "refers_to")


def write_archives(rows: DataFrame, size: int = ARCHIVE_BYTES) -> DataFrame:
    """rows of revisits() as archives (archive, content), each a single gzip stream of about `size` bytes of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, zipper, out = TaskContext.get().partitionId(), 0, 0, None, []

        def close():
            name = f"part-{part:05d}-{k:05d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out) + zipper.flush()], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page, url, html, refers_to in zip(*(batch.column(c) for c in range(4))):
                if zipper is None:
                    zipper, out, held = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0
                r = record(page.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py())
                out.append(zipper.compress(r))
                held += len(r)
                if held >= size:
                    yield close()
                    k, zipper = k + 1, None
        if zipper is not None:
            yield close()

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, content binary")


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, content, index): a member for each record; index has each one's offset and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                members, index, at = [], [], 0
                for r in records(inflate(memoryview(content.as_buffer()))):
                    members.append(deflate(r))
                    index.append({"offset": at, "length": len(members[-1])})
                    at += len(members[-1])
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)], ["archive", "content", "index"])

    return archives.mapInArrow(run, "archive string, content binary, index array<struct<offset: long, length: long>>")


def sidecar(normal: DataFrame) -> DataFrame:
    """The offset index as a table: archive, record (from 0), offset, length."""
    return normal.select("archive", F.posexplode("index").alias("record", "at")).select("archive", "record", "at.offset", "at.length")


READ = "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(normal: DataFrame, payload: bool = False) -> DataFrame:
    """Every record of normalised archives, taken out at its indexed offset; its digest is checked against its payload.

    payload: also return the payload, null for revisits.
    """

    def page(text: str):
        number = text.removeprefix("<urn:x-page:").removesuffix(">")
        return int(number) if number else None

    def one(member: bytes) -> tuple:
        raw = zlib.decompress(member, 31)
        at = raw.index(END)
        head, body = headers(raw[:at]), raw[at + len(END) : -len(END)]
        http, _, data = body.partition(END)
        size = int(headers(http)["content-length"])
        sha1 = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        revisit = head["warc-type"] == "revisit"
        if not revisit and (len(data) != size or hashlib.sha1(data).hexdigest() != sha1):
            raise ValueError(f"{head['warc-record-id']}: the payload doesn't match its digest")
        return page(head["warc-record-id"]), head.get("warc-target-uri"), size, sha1, head["warc-type"], page(head["warc-refers-to"]) if revisit else None, None if revisit or not payload else data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.strip().split()[0] for x in READ.split(",")]
        for batch in batches:
            for name, content, index in zip(*(batch.column(c) for c in range(3))):
                data = memoryview(content.as_buffer())
                spans = [(x["offset"], x["length"]) for x in index.as_py()]
                for k in range(0, len(spans), 1000):
                    rows = [(name.as_py(), a, *one(data[a : a + n])) for a, n in spans[k : k + 1000]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return normal.select("archive", "content", "index").mapInArrow(run, READ)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    archives = materialize(write_archives(revisits(pages, least)), "archives")
    return read_records(materialize(normalise(archives), "warc"))


def digest(read: DataFrame) -> DataFrame:
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
