"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

A text is first cut where white space separates it, then by the vocabulary's own pattern; no match of
the pattern crosses the first cuts, so both caches below hold whole matches only. Under another pattern than
``ONE_BLANK`` the first cuts are not made. The caches are bounded in bytes.

Edge cases: a null text is empty; an empty text has no ids; repeated rows are each encoded; a row without ``doc_id``
keeps its null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from boutline.llm.common import slices, text_of

#: Fixed value: the pattern of byte-level pre-tokenizers, whose matches take one leading blank at most.
ONE_BLANK = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: No match of that pattern can cross these cuts.
CHUNKS = regex.compile(r" ?\S+|\s+(?!\S)|\s+").findall
_BLANK_AND_MORE = re.compile(r" (?:\s|\Z)").search
#: Bytes that the memories of chunks and of matches take before they set about forgetting; each holds twice as many at most.
CHUNK_BYTES, PIECE_BYTES = 24 << 20, 128 << 20
#: What an entry costs besides its letters and ids.
_ENTRY = 200
_NONE = 1 << 62
FANOUT = 16


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match of the pattern.

    Leaf ``i`` of the segment tree holds ``rank << 32 | i`` of the pair that starts at byte ``i``, and a
    node the least of its ``FANOUT`` children, so the least of the top is the leftmost pair of the
    least rank. A merge changes three leaves at most: the pair that starts at the merged symbol, the
    one that ends in it, and the one that is gone.
    """
    get = ranks.get
    whole = get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        leaves.append(_NONE if rank is None else rank << 32 | i)
    top, upper = leaves, []
    while len(top) > FANOUT:
        row, top = top, [min(top[k : k + FANOUT]) for k in range(0, len(top), FANOUT)]
        upper.append((row, top))
    end = list(range(1, n + 1))  # of the symbol that starts at a byte
    before = list(range(-1, n))  # start of the symbol left of a byte that starts one

    if not upper:  # one node holds all leaves
        put = leaves.__setitem__
    else:

        def put(at: int, value: int) -> None:
            leaves[at] = value
            for row, parents in upper:
                at //= FANOUT
                least = min(row[at * FANOUT : at * FANOUT + FANOUT])
                if parents[at] == least:
                    break
                parents[at] = least

    while top and (least := min(top)) != _NONE:
        i = least & 0xFFFFFFFF
        j = end[i]
        stop = end[i] = end[j]
        rank = None
        if stop < n:
            before[stop] = i
            put(j, _NONE)
            rank = get(piece[i : end[stop]])
        elif j < n - 1:
            put(j, _NONE)
        put(i, _NONE if rank is None else rank << 32 | i)
        if i:
            p = before[i]
            rank = get(piece[p:stop])
            put(p, _NONE if rank is None else rank << 32 | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Memory:
    """A bounded map that forgets what was not used for longest, half of it at a time."""

    def __init__(self, room: int) -> None:
        self.room, self.used = room, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def recall(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The values of ``keys``; ``make`` gives those of keys not known."""
        young = self.young
        try:
            return [young[k] for k in keys]
        except KeyError:
            pass
        if self.used > self.room:
            self.old, self.young, self.used = young, {}, 0
            young = self.young
        old, new = self.old, []
        for key in {k for k in keys if k not in young}:
            if key in old:
                young[key] = old[key]
                self.used += _ENTRY + len(key) + len(old[key])
            else:
                new.append(key)
        made = make(new)
        young.update(zip(new, made))
        self.used += _ENTRY * len(new) + sum(map(len, new)) + sum(map(len, made))
        return [young[k] for k in keys]


class Cached:
    """Encodes texts chunk by chunk; ``encode_chunks`` gives the packed ids of chunks not met lately."""

    def __init__(self, encode_chunks: Callable[[list[str]], list[bytes]], room: int = CHUNK_BYTES):
        self.plain, self.after_blank = Memory(room // 8), Memory(room)
        self.encode_chunks = encode_chunks

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if _BLANK_AND_MORE(text):
            return b"".join(self.plain.recall(CHUNKS(text), self.encode_chunks))
        # Each blank is followed by something else than white space, so it belongs to what follows.
        head, *rest = text.split(" ")
        ids = self.plain.recall([head], self.encode_chunks) if head else []
        return b"".join(ids + self.after_blank.recall(rest, lambda new: self.encode_chunks([" " + c for c in new])))


def packed(ids: list[int]) -> bytes:
    return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else np.array(ids, dtype="<u4").tobytes()


_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


class Whole:
    """Encodes whole texts, for vocabularies whose matches may cross white space."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.ids = encode


def tree_encoder(ranks: dict[bytes, int], pattern: str) -> Cached | Whole:
    """Encodes by ``merge_piece``; pieces are remembered besides chunks."""
    pieces_of, pieces = regex.compile(pattern).findall, Memory(PIECE_BYTES)
    merged = lambda new: [packed(merge_piece(piece.encode(), ranks)) for piece in new]
    encode = lambda text: b"".join(pieces.recall(pieces_of(text), merged))
    return Cached(lambda chunks: [encode(chunk) for chunk in chunks]) if pattern == ONE_BLANK else Whole(encode)


_RANKS: dict[str, dict[bytes, int]] = {}
_ENCODERS: dict[tuple[str, str], Cached | Whole] = {}
_TOKENS: dict[str, list[bytes]] = {}


def worker_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file, kept by this Python worker from one task to the next."""
    if path not in _RANKS:
        for kept in (_RANKS, _ENCODERS, _TOKENS):
            kept.clear()
        _RANKS[path] = read_ranks(path)
    return _RANKS[path]


def worker_encoder(path: str, pattern: str) -> Cached | Whole:
    ranks, key = worker_ranks(path), (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = tree_encoder(ranks, pattern)
    return _ENCODERS[key]


def worker_tokens(path: str) -> list[bytes]:
    """The token of each id."""
    ranks = worker_ranks(path)
    if path not in _TOKENS:
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        _TOKENS[path] = tokens
    return _TOKENS[path]


def vocabulary_file(spark, path: str) -> str:
    """Ships a vocabulary file to the executors; returns the name to look it up by."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)``: ids as little-endian unsigned 32-bit integers."""
    name = vocabulary_file(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(SparkFiles.get(name), pattern)
        for batch in slices(batches):
            ids = pa.array([encoder.ids(t.as_py()) for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids, bytes)``: the bytes that the ids stand for. An id outside the vocabulary raises."""
    name = vocabulary_file(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokens(SparkFiles.get(name))
        for batch in slices(batches):
            texts = [
                b"".join([tokens[i] for i in np.frombuffer(ids.as_buffer(), dtype="<u4").tolist()]) if ids.is_valid else None
                for ids in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
