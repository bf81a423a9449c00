"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extraction.

An archive is a ZIP file whose members are stored, not compressed: the WARC file and an index of its
records. The reader parses the end records, the ZIP64 directory and the local headers, reads the
index, and then each record by its own range of bytes.

Edge cases: a null html is empty; a null url is empty; repeated rows are all written, those of one
``page_id`` and payload alike; rows of one ``page_id`` and several payloads are each judged by their own payload; a page without ``page_id`` is a response with a null id; an empty table
gives no archive; other columns are ignored.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 4 << 20
SALTS = 16
DATA, INDEX = "archive/data.warc", "indexes/index.cdx"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FAR = 0xFFFFFFFF


def revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, digest, refers_to)`` of pages whose payload a smaller ``page_id`` has already.

    Only digests are shuffled; the smallest id of each is pre-aggregated before. A digest that very many pages
    share is dealt to ``SALTS`` tasks on the way back.
    """
    sized = pages.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt")).where(F.col("page_id").isNotNull() & F.col("digest").isNotNull())
    first = sized.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last")
    first = first.select("digest", "refers_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return sized.join(first, ["digest", "salt"]).where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def _record(page: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    digest = hashlib.sha256(payload).hexdigest().encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    lines += [b"WARC-Record-ID: <urn:page:%s>" % (b"" if page is None else b"%d" % page), b"WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [b"WARC-Target-URI: " + " ".join(url.split()).encode(), b"WARC-Payload-Digest: sha256:" + digest]
    if refers_to is not None:
        lines += [b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: " + _PROFILE]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_zip(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members, with ZIP64 sizes and directory throughout."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, crc, raw = len(out), binascii.crc32(data), name.encode()
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 0x21, crc, _FAR, _FAR, len(raw), 20)
        out += raw + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 0x21, crc, _FAR, _FAR, len(raw), 28, 0, 0, 0, 0, _FAR)
        central += raw + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
    at, n = len(out), len(members)
    out += central
    end = len(out)
    out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), at)
    out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, _FAR, _FAR, 0)
    return bytes(out)


Read = Callable[[int, int], bytes]


def zip_members(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """Name to the range of bytes of each stored member, from the directories alone."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a ZIP directory")
    n, length, at = struct.unpack_from("<HII", tail, end + 10)
    if (n == 0xFFFF or length == _FAR or at == _FAR) and end >= 20:
        mark, _, far, _ = struct.unpack_from("<IIQI", tail, end - 20)
        if mark != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        record = read(far, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory")
        n, length, at = struct.unpack_from("<QQQ", record, 32)
    central, here, found = read(at, length), 0, {}
    for _ in range(n):
        mark, _, _, _, method, _, _, _, packed, real, names, extras, notes, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", central, here)
        if mark != 0x02014B50:
            raise ValueError("a broken ZIP directory")
        name = central[here + 46 : here + 46 + names].decode()
        extra, k = central[here + 46 + names : here + 46 + names + extras], 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, k + 4))
                real = next(values) if real == _FAR else real
                packed = next(values) if packed == _FAR else packed
                local = next(values) if local == _FAR else local
            k += 4 + width
        if method == 0:
            name_length, extra_length = struct.unpack_from("<HH", read(local + 26, 4))
            found[name] = (local + 30 + name_length + extra_length, packed)
        here += 46 + names + extras + notes
    return found


def read_records(read: Read, size: int) -> Iterator[dict]:
    """The records of an archive, each read by its own range from the index."""
    members = zip_members(read, size)
    (data, _), (index, index_size) = members[DATA], members[INDEX]
    for line in read(index, index_size).splitlines():
        offset, length = map(int, line.split()[-2:])
        record = read(data + offset, length)
        head, _, block = record.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        block = block[: int(fields[b"Content-Length"])]
        http, _, body = block.partition(b"\r\n\r\n")
        stated = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
        kind = fields[b"WARC-Type"].decode()
        name = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:N>
        yield {
            "page_id": name(fields[b"WARC-Record-ID"]),
            "url": fields[b"WARC-Target-URI"].decode(),
            "record_type": kind,
            "refers_to": name(fields[b"WARC-Refers-To"]) if kind == "revisit" else None,
            "payload": body if kind == "response" else None,
            "payload_bytes": len(body) if kind == "response" else int(stated[b"Content-Length"]),
            "payload_digest": hashlib.sha256(body).hexdigest() if kind == "response" else fields[b"WARC-Payload-Digest"][7:].decode(),
        }


def write_archives(pages: DataFrame) -> DataFrame:
    """``(archive)``: ZIP packages of about ``ARCHIVE_BYTES``, which hold one record per page."""
    ready = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # A page without a digest is never a revisit: its payload is short, or it has no id.
    long = (F.octet_length("html") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()
    ready = ready.withColumn("digest", F.when(long, F.sha2(F.encode("html", "UTF-8"), 256)))
    rows = ready.join(revisits(ready), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), bytearray()

        def closed() -> pa.RecordBatch:
            archive = write_zip([(DATA, bytes(data)), (INDEX, bytes(index))])
            data.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

        for batch in batches:
            for page, url, html, refers_to in zip(*batch.columns):
                record = _record(page.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers_to.as_py())
                index += b"%s %d %d\n" % (str(page.as_py()).encode(), len(data), len(record))
                data += record
                if len(data) >= ARCHIVE_BYTES:
                    yield closed()
        if data:
            yield closed()

    return rows.mapInArrow(run, "archive binary")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_COLUMNS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"


def _batches(records: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Records in batches of about a megabyte of payload, so that no archive is held twice."""
    rows, size = [], 0
    for record in records:
        rows.append(record)
        size += 500 + len(record["payload"] or b"")
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of all archives: page, url, type, what it refers to, payload, its size and digest.

    ``archives`` has the bytes in its first column, as here or as ``content`` of Spark's binary files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    data = memoryview(value.as_buffer())
                    yield from _batches(read_records(lambda at, n: bytes(data[at : at + n]), len(data)))

    return archives.mapInArrow(run, _COLUMNS)


def read_files(uris: DataFrame) -> DataFrame:
    """The records of archives in files, by ranges: ``uris`` has their places (``file:``, ``hdfs:``, ``s3:``) in its first column.

    Of a file only directories, index and records are read, each by its own range; a null place has no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in filter(None, batch.column(0).to_pylist()):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as file:
                    yield from _batches(read_records(lambda at, n: file.read_at(n, at), file.size()))

    return uris.mapInArrow(run, _COLUMNS)
