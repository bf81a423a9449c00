"""Packing by concatenating and cutting: prefix sums over partition totals, then fixed windows.

The first pass tokenizes each partition once, numbers its tokens and writes them to the shared folder.
The totals of the partitions, one number each, give every partition its place in the one long
sequence of all tokens; the second pass cuts that at multiples of the window. A document that a cut
divides leaves one record on each side.

Edge cases: a null or empty text is the end token alone; repeated rows are packed once each; a row
without ``doc_id`` is packed with a null id; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.common import slices, stored, text_of
from boutline.llm.tokens import ONE_BLANK, packed, vocabulary_file

END = 0
_TOKENIZERS: dict[str, Callable[[str], bytes]] = {}


def worker_tokenizer(path: str) -> Callable[[str], bytes]:
    """Text to ids, as the library gives them without the special tokens that it would add; kept from one task to the next.

    The string of a special token in a text is that token's id, as in the library.
    """
    if path not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = _by_ranks(path) or _by_library(path)
    return _TOKENIZERS[path]


def _by_library(path: str) -> Callable[[str], bytes]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: packed(tokenizer.encode(text, add_special_tokens=False).ids)


def _by_ranks(path: str) -> Callable[[str], bytes] | None:
    """The same ids faster, if the file is a plain byte-level BPE whose merges are in the order of their ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before, added = file["model"], file["pre_tokenizer"] or {}, file["added_tokens"]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file["normalizer"]
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    results = [model["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(results, results[1:])):
        return None
    byte_of = _byte_characters()
    special = {t["content"]: packed([t["id"]]) for t in added}
    vocabulary = {token: i for token, i in model["vocab"].items() if token not in special}
    if not set().union(*vocabulary) <= set(byte_of):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items()}
    ordinary = tiktoken.Encoding("file", pat_str=ONE_BLANK, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ids = lambda text: packed(ordinary(text))
    if not special:
        return ids
    parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def encode(text: str) -> bytes:
        if not parts.search(text):
            return ids(text)
        return b"".join(special[x] if i % 2 else ids(x) for i, x in enumerate(parts.split(text)))

    return encode


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def tokenized(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(part, first, doc_id, ids)``: ids with the end token, ``first`` tokens before them in ``part``."""
    name = vocabulary_file(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(SparkFiles.get(name))
        part, end, first = TaskContext.get().partitionId(), np.array([END], "<u4").tobytes(), 0
        for batch in slices(batches):
            ids = [encode(t.as_py()) + end for t in batch.column(1)]
            starts = first + np.cumsum([0] + [len(x) // 4 for x in ids])
            first = int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts[:-1], pa.int64()), batch.column(0), pa.array(ids, pa.binary())],
                names=["part", "first", "doc_id", "ids"],
            )

    return text_of(docs).mapInArrow(run, "part int, first long, doc_id long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    Every sequence but the last is full, so the padding is under one window in all. The second pass is one of
    DataFrame functions: the windows that a document touches, and its ids in each of them.
    """
    table = stored(tokenized(docs, tokenizer_path), "tokens")
    n = (F.octet_length("ids") / 4).cast("long")
    totals = table.groupBy("part").agg(F.sum(n).alias("n"))  # one row per partition of the input
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    rows = table.join(F.broadcast(base), "part").select("doc_id", "ids", n.alias("n"), (F.col("base") + F.col("first")).alias("at"))
    pieces = F.expr(f"""transform(sequence(at div {window}, (at + n - 1) div {window}), q -> named_struct(
        'sequence_id', q, 'start', greatest(q * {window} - at, 0L), 'length', least((q + 1) * {window} - at, n) - greatest(q * {window} - at, 0L)))""")
    rows = rows.withColumn("pieces", pieces)
    cut = F.expr(f"""transform(pieces, p -> named_struct(
        'start', p.start, 'length', p.length, 'doc_tokens', n, 'sequence_id', p.sequence_id, 'offset', at + p.start - p.sequence_id * {window},
        'ids', substring(ids, cast(4 * p.start + 1 as int), cast(4 * p.length as int))))""")
    return rows.select("doc_id", F.inline(cut))


def sequences(pieces: DataFrame, window: int = 1024) -> DataFrame:
    """``(sequence_id, ids, n_tokens)``: the sequences themselves; at most ``window`` tokens meet in a group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    ids = F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["ids"])))
    return pieces.groupBy("sequence_id").agg(ids.alias("ids"), F.sum("length").alias("n_tokens"))
