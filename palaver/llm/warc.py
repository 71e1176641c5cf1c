"""Legacy archives to WARC: ARC files are written, converted, and the WARC files read back.

An ARC file begins with a version block whose second line names the fields of each record's header
line; version 1 has five, version 2 ten. A record is that line and as many bytes as it declares.
Each is converted to a WARC record with a synthesised identifier, timestamp, type and digests.
Records of equal long payloads become one response and revisits of it.

A file is closed once it has so many bytes, so one compressed file is one row of a task; its records
are read from it one by one. Which records of a file are revisits is decided from digests alone; the
list of a file's revisits is looked up by the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm.common import delete, dropped, scratch_path, small_batches, stored, table

#: Bytes of records after which an archive file is closed.
FILE_BYTES = 2**25
#: Bytes of records that a task holds before it passes them on.
HELD_BYTES = 2**24
#: Revisits up to which their lists are broadcast, at some 40 bytes each 20 MB; more are shuffled.
BROADCAST_REVISITS = 500_000
#: Bytes from which equal payloads are written once.
LEAST_REVISIT = 1_000
#: The fields of a record's header line by version.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: pages has no capture times.
DATE = "20240101000000"

_PAGE = re.compile(rb"^X-Page-Id: (-?\d+)\r$", re.M)
_HTTP_LENGTH = re.compile(rb"^Content-Length: (\d+)\r$", re.M)


def arc_version_block(version: int, name: str) -> bytes:
    block = f"{version} 0 palaver\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {DATE} text/plain{extra} {len(block)}\n".encode() + block


def arc_record(version: int, name: str, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """A header line and an HTTP response; white space in the url is percent-encoded."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    document = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{url} 0.0.0.0 {DATE} text/html{extra} {len(document)}\n".encode() + document


def _stream(data: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(data) if isinstance(data, bytes) else data


def _unzipped(content: bytes) -> BinaryIO:
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))


def parse_arc(data: bytes | BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(record number, header fields, content) of each record after the version block."""
    source = _stream(data)

    def header() -> str | None:
        while line := source.readline():
            if line.strip(b"\r\n"):
                if not line.endswith(b"\n"):
                    raise ValueError(f"a header line without an end: {line[:80]!r}")
                return line.decode("utf-8", "replace").rstrip("\r\n")
        return None

    head = header()
    if head is None:
        return
    if not head.startswith("filedesc://"):
        raise ValueError(f"no version block: {head[:80]!r}")
    block = source.read(int(head.rsplit(" ", 1)[1])).decode("utf-8", "replace").split("\n")
    version = int(block[0].split()[0])
    fields = (block[1].strip() if len(block) > 1 and block[1].strip() else FIELDS[version]).split()
    number = 0
    while (head := header()) is not None:
        values = head.rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"record {number} of version {version} has the header {head[:200]!r}")
        size = int(values[-1])
        content = source.read(size)
        if len(content) != size:
            raise ValueError(f"record {number} declares {size} bytes, {len(content)} are left")
        yield number, dict(zip(fields, values, strict=True)), content
        number += 1


def http_parts(document: bytes) -> tuple[bytes, bytes]:
    """Headers with the blank line, and payload; a document that is no HTTP response is all payload."""
    if document.startswith(b"HTTP/") and (end := document.find(b"\r\n\r\n")) >= 0:
        return document[: end + 4], document[end + 4 :]
    return b"", document


def page_of(headers: bytes) -> int | None:
    m = _PAGE.search(headers)
    return int(m[1]) if m else None


def record_id(page_id: int | None, source: str) -> str:
    """That of the page where it is known, else one made from the record's place."""
    return f"urn:x-page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, source)}"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: dict[str, str], document: bytes, own_id: str, refers_to: str | None) -> bytes:
    """A response, or a revisit of the response refers_to with the HTTP headers alone.

    The blank lines that end a record are the separator of the file's writer.
    """
    headers, payload = http_parts(document)
    block = document if refers_to is None else headers
    d = fields["Archive-date"].ljust(14, "0")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{own_id}>",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        "Content-Type: application/http; msgtype=response" if headers else f"Content-Type: {fields['Content-type']}",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    source = _stream(data)
    while version := source.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record but {version[:80]!r}")
        fields = {}
        while line := source.readline().rstrip(b"\r\n"):
            name, _, value = line.decode("utf-8").partition(": ")
            fields[name] = value
        size = int(fields["Content-Length"])
        block = source.read(size)
        if len(block) != size or _digest(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"the block of {fields['WARC-Record-ID']} differs from its digest")
        yield fields, block
        source.read(4)


def _batched(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about HELD_BYTES at most, and of a few thousand rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= HELD_BYTES or len(held) >= 4_096:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_RECORD = pa.schema([("file", pa.string()), ("number", pa.int32()), ("value", pa.binary())])
_SLIM = pa.schema([("path", pa.string()), ("number", pa.int32()), ("page_id", pa.int64()), ("id", pa.string()), ("digest", pa.binary()), ("bytes", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("date", pa.string())])


def _to_arc(file_bytes: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part = TaskContext.get().partitionId()
        version, files, number, size = part % 2 + 1, 0, 0, file_bytes
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html = (batch.column(c)[row].as_py() for c in ("page_id", "url", "html"))
                if size >= file_bytes:
                    name, number, size = f"part-{part}-{files}", 0, 0
                    files += 1
                    yield name, number, arc_version_block(version, f"{name}.arc")
                record = arc_record(version, f"{name}.arc", page_id, url, (html or "").encode("utf-8"))
                number, size = number + 1, size + len(record)
                yield name, number, record

    return lambda batches: _batched(rows(batches), _RECORD, lambda r: len(r[2]))


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in range(batch.num_rows):
                path = batch.column("path")[row].as_py()
                for number, _, document in parse_arc(_unzipped(batch.column("content")[row].as_py())):
                    headers, payload = http_parts(document)
                    page = page_of(headers)
                    yield path, number, page, record_id(page, f"{path}#{number}"), hashlib.sha1(payload).digest(), len(payload)

    return _batched(rows(), _SLIM, lambda r: 100)


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        part, files = TaskContext.get().partitionId(), 0
        for batch in batches:
            for row in range(batch.num_rows):
                path = batch.column("path")[row].as_py()
                revisits = {r["number"]: r["to_id"] for r in batch.column("revisits")[row].as_py() or ()}
                name, files = f"part-{part}-{files}", files + 1
                for number, fields, document in parse_arc(_unzipped(batch.column("content")[row].as_py())):
                    yield name, number, warc_record(fields, document, record_id(page_of(http_parts(document)[0]), f"{path}#{number}"), revisits.get(number))

    return _batched(rows(), _RECORD, lambda r: len(r[2]))


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number_of = lambda uri: int(uri.rsplit(":", 1)[1].rstrip(">")) if uri and uri.startswith("<urn:x-page:") else None

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for row in range(batch.num_rows):
                for fields, block in parse_warc(_unzipped(batch.column("content")[row].as_py())):
                    headers, payload = http_parts(block)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"]
                    size = len(payload)
                    if kind == "revisit":
                        size = int(_HTTP_LENGTH.search(headers)[1])
                    elif _digest(payload) != digest:
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} differs from its digest")
                    yield number_of(fields["WARC-Record-ID"]), size, base64.b32decode(digest[5:]).hex(), kind, number_of(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"], fields["WARC-Date"]

    return _batched(rows(), _READ, lambda r: 200)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _written(records: DataFrame, path: str, separator: str) -> None:
    """Records (file, number, value), each file's in order and with the separator after each."""
    ordered = records.sortWithinPartitions("file", "number").select("file", F.col("value").cast("string"))
    ordered.write.partitionBy("file").option("lineSep", separator).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Compressed ARC files of the pages, of version 1 and 2 by turns of the tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_to_arc(file_bytes), "file string, number int, value binary")
    _written(rows, path, "\n")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_REVISIT, broadcast_revisits: int = BROADCAST_REVISITS) -> None:
    """A WARC file for each ARC file. Of equal payloads of at least ``least`` bytes the record of the
    largest page_id is a response (of equal ones the last in its file), the others revisit it."""
    slim = _files(spark, arc_path).mapInArrow(_slim, "path string, number int, page_id long, id string, digest binary, bytes long")
    slim = stored(slim.where(F.col("bytes") >= least), "archive-digests")
    top = slim.groupBy("digest").agg(F.max(F.struct("page_id", "path", "number", "id")).alias("to"), F.count("*").alias("c")).where("c > 1").select(F.col("digest").alias("to_digest"), "to")
    again = slim.join(top, F.col("digest") == F.col("to_digest")).where((F.col("path") != F.col("to.path")) | (F.col("number") != F.col("to.number")))
    per_file = stored(again.groupBy(F.col("path").alias("of")).agg(F.collect_list(F.struct("number", F.col("to.id").alias("to_id"))).alias("revisits")), "archive-revisits")
    few = (per_file.agg(F.sum(F.size("revisits"))).first()[0] or 0) <= broadcast_revisits
    files = _files(spark, arc_path)
    records = files.join(F.broadcast(per_file) if few else per_file, F.col("path") == F.col("of"), "left").select("path", "content", "revisits")
    _written(records.mapInArrow(_to_warc, "file string, number int, value binary"), warc_path, "\r\n\r\n")
    dropped(slim, per_file)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex), record_type, refers_to, target_uri, date of each
    record; size and digest of a revisit are those of the payload that it stands for. Lengths and
    digests that don't hold raise."""
    return _files(spark, path).mapInArrow(_from_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, date string")


def through_archives(pages: DataFrame, file_bytes: int = FILE_BYTES, broadcast_revisits: int = BROADCAST_REVISITS) -> DataFrame:
    """Pages to ARC files, those to WARC files, and the records read back.

    A null html is an empty payload, a null url is written as -, a page without an id gets an
    identifier from its place and a null page_id. Of repeated rows one is the response. A page of
    more than file_bytes is a file of its own. No pages, no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    small_batches(spark)
    base = scratch_path(spark, "archives")
    write_arc(pages, f"{base}/arc", file_bytes)
    convert(spark, f"{base}/arc", f"{base}/warc", broadcast_revisits=broadcast_revisits)
    delete(spark, f"{base}/arc")
    return read_warc(spark, f"{base}/warc")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of pages, by way of its archive record."""
    return through_archives(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
t as (select *, max(page_id) over (partition by payload_digest) as top from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {LEAST_REVISIT} and page_id <> top then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= {LEAST_REVISIT} and page_id <> top then top end as refers_to
from t
"""
