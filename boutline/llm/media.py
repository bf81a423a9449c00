"""ISO media containers: text bytes stored as 8-bit samples, and a reader of boxes and sample tables.

The reader walks nested boxes and decodes the sample tables; it learns codec, duration and the byte
range of each sample and key frame, of all tracks and of movie fragments, without decoding a payload. Equal texts give equal containers, as
these hold no times or ids. A null text is empty, an empty text is one sample of zero bytes; repeated rows are kept;
an empty table gives none; other columns are ignored. Bytes that are no such container give a null payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import slices, text_of

SAMPLE = 64
RATE = 8000
CHUNK_SAMPLES = 256
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """A container with one track of unsigned 8-bit mono sound; ``payload`` is a multiple of 64 bytes.

    A sample is 64 bytes; each chunk of samples begins with a key frame.
    """
    samples = len(payload) // SAMPLE
    ticks = len(payload)
    chunks = -(-samples // CHUNK_SAMPLES)
    last = samples - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES)] if last == CHUNK_SAMPLES else [(1, CHUNK_SAMPLES), (chunks, last)] if chunks > 1 else [(1, last)]
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    large = len(payload) + (1 << 20) >= 1 << 32

    def movie(first: int) -> bytes:
        offsets = [first + i * CHUNK_SAMPLES * SAMPLE for i in range(chunks)]
        entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, samples, SAMPLE)),
            _full(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, samples + 1, CHUNK_SAMPLES))),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, samples)),
            _full(b"co64" if large else b"stco", struct.pack(f">I{chunks}{'Q' if large else 'I'}", chunks, *offsets)),
        )
        sound = _full(b"smhd", bytes(4))
        where = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, ticks, 0x55C4, 0), version=1),
            _full(b"hdlr", bytes(4), b"soun", bytes(13)),
            _box(b"minf", sound, where, table),
        )
        track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        movie_head = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, ticks), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", movie_head, _box(b"trak", track, media))

    data = 16 if large else 8
    size = len(head) + len(movie(0)) + data
    return head + movie(size) + _box(b"mdat", payload)


class Track(NamedTuple):
    codec: str
    seconds: float
    samples: list[tuple[int, int]]
    keyframes: list[tuple[int, int]]


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int, int]]:
    """Paths of all boxes, their starts and those and the ends of their bodies, parents before children."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box is cut short")
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError("a box is larger than what holds it")
        yield (*path, kind), start, body, stop
        if kind in _NESTED:
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


def read_tracks(data: memoryview) -> list[Track]:
    """The tracks of a container, from its boxes, sample tables and fragments alone."""
    found: list[dict[bytes, tuple[int, int]]] = []
    defaults: dict[int, tuple[int, int, int]] = {}
    fragments: list[tuple[int, tuple[int, int], list[tuple[int, int]]]] = []  # start of the movie fragment, its header, its runs
    moof = 0
    for path, start, body, stop in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif b"trak" in path:
            found[-1].setdefault(kind, (body, stop))
        elif kind == b"trex":
            track, _, *rest = struct.unpack_from(">5I", data, body + 4)
            defaults[track] = tuple(rest)
        elif kind == b"moof":
            moof = start
        elif kind == b"tfhd":
            fragments.append((moof, (body, stop), []))
        elif kind == b"trun" and fragments:
            fragments[-1][2].append((body, stop))
    runs: dict[int, list[tuple[int, int, int, bool]]] = {}
    for moof, header, parts in fragments:
        _fragment(data, moof, header, parts, defaults, runs)
    return [_track(data, tables, runs.get(_number(data, tables), [])) for tables in found]


def _number(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> int:
    start, _ = tables[b"tkhd"]
    return struct.unpack_from(">I", data, start + (20 if data[start] == 1 else 12))[0]


def _fragment(data: memoryview, moof: int, header: tuple[int, int], parts: list[tuple[int, int]], defaults: dict, runs: dict) -> None:
    """Adds ``(offset, size, duration, key frame)`` of each sample of a track's fragment to the track's ``runs``."""
    at = header[0]
    flags, track = struct.unpack_from(">II", data, at)
    flags, at = flags & 0xFFFFFF, at + 8
    base, (duration, size, marks) = moof, defaults.get(track, (0, 0, 0))
    if flags & 1:
        base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    at += 4 * bool(flags & 2)
    given = [duration, size, marks]
    for i, bit in enumerate((0x8, 0x10, 0x20)):
        if flags & bit:
            given[i], at = struct.unpack_from(">I", data, at)[0], at + 4
    here = base
    for body, stop in parts:
        flags, count = struct.unpack_from(">II", data, body)
        flags, at, first = flags & 0xFFFFFF, body + 8, None
        if flags & 1:
            here, at = base + struct.unpack_from(">i", data, at)[0], at + 4
        if flags & 4:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        for k in range(count):
            values = list(given)
            if k == 0 and first is not None:
                values[2] = first
            for i, bit in enumerate((0x100, 0x200, 0x400, 0x800)):
                if flags & bit:
                    if at + 4 > stop:
                        raise ValueError("a run is cut short")
                    if i < 3:
                        values[i] = struct.unpack_from(">I", data, at)[0]
                    at += 4
            runs.setdefault(track, []).append((here, values[1], values[0], not values[2] & 0x10000))
            here += values[1]


def _sizes(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> list[int]:
    """The size of each sample, from either kind of table."""
    if b"stsz" in tables:
        start, stop = tables[b"stsz"]
        fixed, count = struct.unpack_from(">II", data, start + 4)
        if fixed == 0 and start + 12 + 4 * count > stop:
            raise ValueError("a table is cut short")
        return [fixed] * count if fixed else list(struct.unpack_from(f">{count}I", data, start + 12))
    start, _ = tables[b"stz2"]
    bits, count = struct.unpack_from(">xxxBI", data, start + 4)
    if bits == 4:
        pairs = bytes(data[start + 12 : start + 12 + (count + 1) // 2])
        return [x for b in pairs for x in (b >> 4, b & 15)][:count]
    return list(struct.unpack_from(f">{count}{ {8: 'B', 16: 'H'}[bits] }", data, start + 12))


def _longs(data: memoryview, tables: dict, kind: bytes, width: int) -> list[tuple[int, ...]]:
    if kind not in tables:
        return []
    start, stop = tables[kind]
    (n,) = struct.unpack_from(">I", data, start + 4)
    if start + 8 + 4 * n * width > stop:
        raise ValueError("a table is cut short")
    return list(zip(*[iter(struct.unpack_from(f">{n * width}I", data, start + 8))] * width))


def _track(data: memoryview, tables: dict[bytes, tuple[int, int]], fragments: list[tuple[int, int, int, bool]]) -> Track:
    start, _ = tables[b"mdhd"]
    scale, _ = struct.unpack_from(">IQ", data, start + 20) if data[start] == 1 else struct.unpack_from(">II", data, start + 12)
    codec = bytes(data[tables[b"stsd"][0] + 12 : tables[b"stsd"][0] + 16]).decode("latin-1")
    sizes = _sizes(data, tables)
    if b"co64" in tables:
        start, _ = tables[b"co64"]
        offsets = list(struct.unpack_from(f">{struct.unpack_from('>I', data, start + 4)[0]}Q", data, start + 8))
    else:
        offsets = [x for (x,) in _longs(data, tables, b"stco", 1)]
    runs = _longs(data, tables, b"stsc", 3)
    ends = [first for first, _, _ in runs[1:]] + [len(offsets) + 1]
    samples: list[tuple[int, int]] = []
    for (first, per_chunk, _), end in zip(runs, ends):
        for chunk in range(first - 1, end - 1):
            at = offsets[chunk]
            for size in sizes[len(samples) : len(samples) + per_chunk]:
                samples.append((at, size))
                at += size
    ticks = sum(n * delta for n, delta in _longs(data, tables, b"stts", 2)) + sum(d for _, _, d, _ in fragments)
    keys = [samples[i - 1] for (i,) in _longs(data, tables, b"stss", 1)] if b"stss" in tables else list(samples)
    samples += [(at, size) for at, size, _, _ in fragments]
    keys += [(at, size) for at, size, _, key in fragments if key]
    if any(at + size > len(data) for at, size in samples):
        raise ValueError("a sample lies outside the file")
    return Track(codec, ticks / scale, samples, keys)


def to_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: the bytes of each text, padded to a positive multiple of 64, as samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            media = [write_container(t + bytes(-len(t) % SAMPLE if t else SAMPLE)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return text_of(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_RANGES = "array<struct<offset:long,size:long>>"
_SEEN = f"doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload binary, codec string, seconds double, samples long, keyframes {_RANGES}, tracks array<struct<codec:string,seconds:double,samples:long,keyframes:{_RANGES}>>"


def read_media(media: DataFrame) -> DataFrame:
    """What the stored containers hold: payload, codec, duration, samples and key frame ranges of the first track, and what all ``tracks`` say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, n, size, digest, value in zip(*batch.columns):
                row = {"doc_id": doc.as_py(), "n_bytes": n.as_py(), "media_bytes": size.as_py(), "media_sha256": digest.as_py()}
                try:
                    data = memoryview(value.as_buffer())
                    tracks = read_tracks(data)
                    told = [{"codec": t.codec, "seconds": t.seconds, "samples": len(t.samples), "keyframes": [{"offset": a, "size": s} for a, s in t.keyframes]} for t in tracks]
                    row |= told[0] | {"payload": b"".join([data[a : a + s] for a, s in _joined(tracks[0].samples)]), "tracks": told}
                except (AttributeError, KeyError, IndexError, TypeError, ValueError, ZeroDivisionError, struct.error):
                    row |= dict.fromkeys(("payload", "codec", "seconds", "samples", "keyframes", "tracks"))
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_SEEN_ARROW)

    ready = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long"), F.sha2("media", 256), "media")
    return ready.mapInArrow(run, _SEEN)


_PAIRS = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
_SEEN_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload", pa.binary()),
     ("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()),
     ("keyframes", _PAIRS), ("tracks", pa.list_(pa.struct([("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", _PAIRS)])))]
)


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same bytes in the same order with touching ranges joined."""
    out: list[tuple[int, int]] = []
    for at, size in ranges:
        if out and sum(out[-1]) == at:
            out[-1] = (out[-1][0], out[-1][1] + size)
        else:
            out.append((at, size))
    return out
