"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

Both tokenizers end a token wherever white space follows a letter, so a text falls into units (a word with the white space before it)
whose tokens and cuts do not depend on what is around them. The alignment is relational and runs over the distinct units of
the corpus, far fewer than its tokens: tokens are exploded with their positions, windowed sums of their lengths give ends, an equi-join on unit
and end gives cuts, the running number of cuts the groups, and a join within groups the links.

Texts are numbers of units meanwhile. Each partition numbers the units that it meets in a dictionary of bounded size, a part;
parts meet the aligned units by a shuffle, a unit at most once each, so no word is a hot key however frequent. How many documents hold
a pair is counted within parts and then added up; the counts go back to the parts that hold the pair. Nothing is broadcast.

If a vocabulary has a piece across such a border, as told from its pieces, whole texts are the units, by the same steps.

Edge cases: a text that is null or empty, or that the tokens of a side do not spell, has no tokens: zeros and an empty string. Repeated rows are
documents of their own, in counts too; a row without ``doc_id`` keeps its null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.common import discard, release, setting, slices, stored, text_of
from boutline.llm.packing import _byte_characters
from boutline.llm.tokens import ONE_BLANK, vocabulary_file
from boutline.sources.scratch import remove, scratch_folder

#: A dictionary ends with the document that reaches so many units, different or in all.
UNITS, OCCURRENCES = 1 << 20, 1 << 23
#: Seconds for which the cleaner of shuffle files is left alone before a large step.
PAUSE = 1.5
#: Links that are sorted at a time.
LINKS = 1 << 20
_ODD = r"\s\x1c-\x1f\x85᠎​▁﻿"
_AFTER_ODD = re.compile(f"[{_ODD}][ \n]").search
_UNITS = re.compile(f"(?<=[^{_ODD}])(?=[ \n])").split
BLANK = "▁"


def unit_keys(text: str) -> list[str]:
    """The units of a blank and ``text`` in order, the blank before most left out: ``unit_of`` gives it back."""
    if text[:1] in (" ", "\n") or _AFTER_ODD(text):
        return [u[1:] if u[0] == " " and u[1:2] not in (" ", "\n") else u for u in _UNITS(" " + text)]
    return text.replace("\n", " \n").split(" ")


def unit_of(key: str) -> str:
    return key if key[:1] in (" ", "\n") else " " + key


def packed(numbers: list[int]) -> bytes:
    """Small numbers in few bytes: the first bytes of all, then the second ones, and so on, compressed."""
    planes = np.array(numbers, "<i4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class Sides:
    """Encodes units by both tokenizers, to ids and bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        byte_of, vocabulary = _byte_characters(), file["model"]["vocab"]
        ids = vocabulary | {t["content"]: t["id"] for t in file["added_tokens"]}
        self.a_bytes = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.a_bytes[i] = bytes(byte_of.get(c, 0) for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.blank = self.b.piece_to_id(BLANK)
        before = file["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        #: Whether no token of either crosses from a letter to a blank or a line break.
        self.divisible = plain and not any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for i, p in enumerate(pieces) if not self.b.is_control(i))
        self.encode_a = (plain and self._by_ranks(file)) or self._by_library(a_path)

    def _by_ranks(self, file: dict) -> Callable[[str], list[int]] | None:
        """The same ids from the ranks alone, where the merges are in the order of their ids."""
        import tiktoken

        added, vocabulary = {t["content"] for t in file["added_tokens"]}, file["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        results = [vocabulary[x + y] for x, y in merges]
        if file["normalizer"] or any(x >= y for x, y in zip(results, results[1:])):
            return None
        ranks = {self.a_bytes[i]: i for token, i in vocabulary.items() if token not in added}
        return tiktoken.Encoding("file", pat_str=ONE_BLANK, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _by_library(path: str) -> Callable[[str], list[int]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """The library puts a blank before each text: the unit's own one, or one to take away again before a line break."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [([self.blank] if u == " " else ids) if u[0] == " " else ids[1:] for u, ids in zip(units, found)]


@cache
def worker_sides(a_path: str, b_path: str) -> Sides:
    return Sides(a_path, b_path)


PARTS = "part long, doc_id long, units binary, number int, unit string, kind int"


def dictionaries(docs: DataFrame, divisible: bool) -> DataFrame:
    """Rows of documents ``(part, doc_id, units)``, kind 0, and of the units of a part ``(part, number, unit)``, kind 1; ``units`` are numbers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId() << 24, ["part", "doc_id", "units", "number", "unit", "kind"]
        numbers, n = defaultdict(int), 0
        numbers.default_factory = numbers.__len__

        def entries() -> Iterator[pa.RecordBatch]:
            keys = list(numbers)
            for i in range(0, len(keys), 1 << 15):
                units = pa.array([unit_of(k) if divisible else k for k in keys[i : i + (1 << 15)]])
                own = pa.array(range(i, i + len(units)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(units), pa.int64()), pa.nulls(len(units), pa.int64()), pa.nulls(len(units), pa.binary()), own, units, pa.array([1] * len(units), pa.int32())], names=names)

        for batch in slices(batches, 100):
            ids, units, parts = batch.column(0).to_pylist(), [], []
            made = []
            for t in batch.column(1):
                text = t.as_py()
                keys = (unit_keys(text) if divisible else [" " + text]) if text else []
                units.append(packed([numbers[k] for k in keys]))
                parts.append(part)
                n += len(keys)
                if len(numbers) >= UNITS or n >= OCCURRENCES:
                    made += entries()
                    numbers.clear()
                    part, n = part + 1, 0
            rows = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(ids, pa.int64()), pa.array(units, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.string()), pa.array([0] * rows, pa.int32())], names=names)
            yield from made
        yield from entries()

    return text_of(docs).mapInArrow(run, PARTS)


def tokenized_units(units: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """``units(unit)`` to ``(uid, unit, a, b)``: a token is its id and its number of bytes; null where a side does not spell the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, uid = worker_sides(SparkFiles.get(a_name), SparkFiles.get(b_name)), TaskContext.get().partitionId() << 33
        kind = pa.struct([("id", pa.int32()), ("size", pa.int32())])

        def tokens(found: list[list[int] | None], spelled: list[bytes]) -> pa.Array:
            flat = [i for ids in found for i in ids or ()]
            sizes = [len(spelled[i]) for i in flat]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(ids or ()) for ids in found]))).astype(np.int32))
            values = pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array(sizes, pa.int32())], fields=list(kind))
            return pa.ListArray.from_arrays(offsets, values, mask=pa.array([ids is None for ids in found], pa.bool_()))

        for batch in slices(batches, 2000):
            texts = batch.column(0).to_pylist()
            a, b = [sides.encode_a(u) for u in texts], sides.encode_b(texts)
            for i, text in enumerate(texts):
                want = text.encode()
                if b"".join([sides.a_bytes[k] for k in a[i]]) != want or b"".join([sides.b_bytes[k] for k in b[i]]) != want:
                    a[i] = b[i] = None
            own = pa.array(np.arange(uid, uid + len(texts)))
            uid += len(texts)
            yield pa.RecordBatch.from_arrays([own, batch.column(0), tokens(a, sides.a_bytes), tokens(b, sides.b_bytes)], names=["uid", "unit", "a", "b"])

    token = "array<struct<id:int,size:int>>"
    return units.mapInArrow(run, f"uid long, unit string, a {token}, b {token}")


def _ends(words: DataFrame, side: str) -> DataFrame:
    """``(uid, end, side)``: the tokens of a side by the byte that they end at."""
    tokens = words.select("uid", F.posexplode(side).alias("position", "token"))
    upto = Window.partitionBy("uid").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.select("uid", F.sum("token.size").over(upto).alias("end"), F.col("token.id").alias(side))


def aligned(words: DataFrame) -> DataFrame:
    """``words(uid, a, b)`` to ``(uid, groups, links)``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids in order, groups in order. ``links`` has every pair of a group as ``a|b;...``, and is
    null where each group is one pair, so ``groups`` says the same.
    """
    words = words.repartition("uid")  # all that follows but the last window finds the rows of a unit together
    met = _ends(words, "a").join(_ends(words, "b"), ["uid", "end"], "full")
    before = Window.partitionBy("uid").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    rows = met.select("uid", "end", "a", "b", F.coalesce(F.sum(cut).over(before), F.lit(0)).alias("nth"))

    def side(name: str) -> Column:
        inside = F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("end", name))))
        return F.transform(inside, lambda t: t[name].cast("string"))

    groups = rows.groupBy("uid", "nth").agg(side("a").alias("a"), side("b").alias("b"))
    joined = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.concat(x, F.lit("|"), y))))
    one = (F.size("a") == 1) & (F.size("b") == 1)
    text = F.concat(F.array_join("a", ","), F.lit("|"), F.array_join("b", ","))
    groups = groups.select("uid", F.struct("nth", text.alias("text"), F.when(~one, F.array_join(joined, ";")).alias("links")).alias("g"), one.alias("one"))
    in_order = F.array_sort(F.collect_list("g"))
    whole = groups.groupBy("uid").agg(in_order.alias("gs"), F.min("one").alias("one"))
    listed = F.array_join(F.transform("gs", lambda g: F.coalesce(g["links"], g["text"])), ";")
    return whole.select("uid", F.array_join(F.transform("gs", lambda g: g["text"]), ";").alias("groups"), F.when(~F.col("one"), listed).alias("links"))


def _blocks(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of documents that have ``most`` or fewer together, or are one; ``upto`` is how many the documents before each have."""
    first = 0
    while first < len(upto) - 1:
        last = max(first + 1, int(np.searchsorted(upto, upto[first] + most, side="right")) - 1)
        yield first, last
        first = last


class Part:
    """The facts of the units of a part: their links as numbers of pairs, by unit; with ``texts`` their groups too."""

    def __init__(self, facts: pa.Table, texts: bool):
        order = np.argsort(facts.column("number").to_numpy())
        number, flat, starts = defaultdict(int), array("i"), array("q", [0])
        number.default_factory = number.__len__
        self.groups: list[str | None] = []
        self.sizes = np.zeros((len(order), 3), np.int32)  # tokens of either side, groups
        self.broken = np.zeros(len(order), bool)
        for first in range(0, len(order), 1 << 16):
            own = facts.select(["groups", "links"]).take(pa.array(order[first : first + (1 << 16)]))
            told = own.column("groups").to_pylist()
            for i, (text, pairs) in enumerate(zip(told, own.column("links").to_pylist()), first):
                if pairs is not None:
                    sides = [g.split("|") for g in text.split(";")]
                    self.sizes[i] = sum(a.count(",") + 1 for a, _ in sides), sum(b.count(",") + 1 for _, b in sides), len(sides)
                    flat.extend([number[p] for p in pairs.split(";")])
                elif text is not None:
                    flat.extend([number[p] for p in text.split(";")])
                    self.sizes[i] = len(flat) - starts[-1]
                else:
                    self.broken[i] = True
                starts.append(len(flat))
            if texts:
                self.groups += told
        self.pairs, self.links, self.starts = list(number), np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.array(starts, np.int64)

    def documents(self, units: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The units of all documents one after the other, where each document starts, and which have tokens."""
        rows = [unpacked(u.as_buffer()) for u in units]
        flat, ends = np.concatenate([*rows, np.zeros(0, "<i4")]), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        spoiled = np.concatenate(([0], np.cumsum(self.broken[flat], dtype=np.int32)))
        return flat, ends, (np.diff(ends) > 0) & (np.diff(spoiled[ends]) == 0)

    def held(self, flat: np.ndarray, ends: np.ndarray, good: np.ndarray) -> np.ndarray:
        """How many documents hold each pair; units are taken in pieces of at most ``LINKS`` links or one document."""
        out, width = np.zeros(len(self.pairs), np.int64), np.diff(self.starts)
        upto = np.concatenate(([0], np.cumsum(width[flat])))[ends]
        for first, last in _blocks(upto, LINKS):
            own = flat[ends[first] : ends[last]]
            n = width[own]
            at = np.repeat(self.starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            doc = np.repeat(np.arange(first, last), np.diff(upto[first : last + 1]))
            keys = np.unique((doc * len(self.pairs) + self.links[at])[good[doc]])
            out += np.bincount(keys % max(1, len(self.pairs)), minlength=len(self.pairs))
        return out


def _count_pairs(docs: pa.Table, facts: pa.Table) -> pa.Table:
    """``(part, number, a, b, n)``: how many documents of the part hold each pair."""
    part = Part(facts, False)
    n = part.held(*part.documents(docs.column("units")))
    kept = np.flatnonzero(n)
    sides = [part.pairs[i].split("|") for i in kept]
    return pa.table({
        "part": pa.array([facts.column("part")[0].as_py()] * len(kept) if len(kept) else [], pa.int64()), "number": pa.array(kept, pa.int32()),
        "a": pa.array([int(a) for a, _ in sides], pa.int32()), "b": pa.array([int(b) for _, b in sides], pa.int32()), "n": pa.array(n[kept], pa.int64()),
    })


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _summed(told: Callable[[str], str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of the documents of a part; ``told`` makes the last column out of the groups."""

    def run(docs: pa.Table, both: pa.Table) -> pa.Table:
        counted = np.asarray(both.column("count").is_valid())
        facts, counts = both.filter(pa.array(~counted)), both.filter(pa.array(counted))
        part = Part(facts, True)
        count, best = np.zeros(len(part.pairs), np.int64), np.zeros(len(part.pairs), np.int64)
        at = counts.column("number").to_numpy()
        count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
        flat, ends, good = part.documents(docs.column("units"))

        def of_units(values: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate(([0], np.cumsum(values)))[part.starts])

        def of_documents(values: np.ndarray) -> pa.Array:
            out = np.zeros(len(good), np.int64)
            for first, last in _blocks(ends, LINKS):
                upto = np.concatenate(([0], np.cumsum(values[flat[ends[first] : ends[last]]], dtype=np.int64)))
                out[first:last] = np.diff(upto[ends[first : last + 1] - ends[first]])
            return pa.array(np.where(good, out, 0))

        listed = of_units(np.ones(len(part.links), np.int64))
        columns = [part.sizes[:, 0], part.sizes[:, 1], part.sizes[:, 2], listed, of_units(best[part.links]), of_units(count[part.links])]
        groups = part.groups
        texts = [told(";".join([groups[u] for u in flat[ends[i] : ends[i + 1]].tolist()])) if g else "" for i, g in enumerate(good.tolist())]
        names = [c.split()[0] for c in OUT.split(", ")]
        return pa.Table.from_arrays([docs.column("doc_id"), *map(of_documents, columns), pa.array(texts, pa.string())], names=names)

    return run


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """A row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    ``count_sum`` adds up, over the links, how many documents of the corpus hold the link's pair of ids; ``n_best`` are the links whose pair
    is held by as many as any of its first id. With ``digest``, ``groups`` is the SHA-256 of its text.
    """
    spark = docs.sparkSession
    a_name, b_name = vocabulary_file(spark, a_path), vocabulary_file(spark, b_path)
    path = scratch_folder(spark, "parts")
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "2"):  # else the rows would be sorted by kind
        dictionaries(docs, worker_sides(a_path, b_path).divisible).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    table = spark.read.schema(PARTS).parquet(path)
    texts, listed = table.where("kind = 0").select("part", "doc_id", "units"), table.where("kind = 1").select("part", "number", "unit")
    words = stored(tokenized_units(listed.select("unit").distinct(), a_name, b_name), "words")
    release(spark, PAUSE)
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):  # else the join would shuffle tokens by unit and end
        told = stored(aligned(words.select("uid", "a", "b")), "told")
    release(spark, PAUSE)
    found = stored(told.join(words.select("uid", "unit"), "uid").select("unit", "groups", "links"), "aligned")
    discard(told, words)
    release(spark, PAUSE)
    facts = stored(listed.join(found, "unit", "left").select("part", "number", "groups", "links"), "facts")
    discard(found)
    remove(spark, f"{path}/kind=1")
    release(spark, PAUSE)

    by_part = texts.select("part", "units").groupBy("part").cogroup(facts.groupBy("part"))
    pairs = stored(by_part.applyInArrow(_count_pairs, "part long, number int, a int, b int, n long"), "pairs")
    release(spark, PAUSE)
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    top = counts.groupBy("a").agg(F.max("count").alias("most"))
    release(spark, PAUSE)
    known = counts.join(top, "a").select("a", "b", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    back = pairs.join(known, ["a", "b"]).select("part", "number", "count", "best")

    told = (lambda t: hashlib.sha256(t.encode()).hexdigest()) if digest else (lambda t: t)
    both = facts.unionByName(back, allowMissingColumns=True)
    return texts.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(_summed(told), OUT)
