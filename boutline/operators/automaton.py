"""Many names looked for in many texts at once, by Aho-Corasick automata.

Sorted names are cut into shards whose automata have at most ``STATES`` states; each is a table of next states, packed in an array.
A table so bounded is broadcast, and all texts are streamed over each shard once. Texts lie side by side in lanes of equal length, and a
step moves all lanes by one letter, so a letter costs a lookup in an array and no work of its own.

Edge cases: a null text or name is none; an empty name is nowhere; equal names are one; overlapping and nested hits are all found.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.sources.scratch import staged

#: States of a shard. With at most ``CLASSES`` kinds of letters its table takes at most 64 MB.
STATES, CLASSES = 1 << 17, 128
#: Letters of a lane, besides those that it shares with the next one, and lanes that move together.
LANE, LANES = 512, 2048


class Automaton(NamedTuple):
    """``after[state, kind]`` is the next state. ``name_at`` is the name that ends in a state or -1, ``shorter`` the state of the
    longest other name that ends there too, or 0. ``kinds`` maps letters to their kind; letters of no name are of kind 0."""

    letters: np.ndarray
    kinds: np.ndarray
    after: np.ndarray
    name_at: np.ndarray
    shorter: np.ndarray
    names: list[str]

    @property
    def longest(self) -> int:
        return max(map(len, self.names), default=1)


def letters_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def build(names: list[str]) -> Automaton:
    """The automaton of different names, level by level; each level is a few operations on arrays."""
    texts = [letters_of(n) for n in names]
    letters = np.unique(np.concatenate([*texts, np.zeros(0, "<u4")]))
    width, lengths = len(letters) + 1, np.array([len(t) for t in texts], int)
    at, own, levels, states = np.zeros(len(names), np.int64), [np.full(1, -1)], [], 1
    for depth in range(lengths.max(initial=0)):
        rows = np.flatnonzero(lengths > depth)
        kind = np.searchsorted(letters, [texts[r][depth] for r in rows]) + 1
        edges, child = np.unique(at[rows] * width + kind, return_inverse=True)
        at[rows] = states + child
        levels.append((np.arange(states, states + len(edges)), edges // width, edges % width))
        states += len(edges)
        own.append(np.full(len(edges), -1))
    name_at = np.concatenate(own)
    name_at[at] = np.where(lengths > 0, np.arange(len(names)), -1)
    after, fall, shorter = np.zeros((states, width), np.int32), np.zeros(states, np.int32), np.zeros(states, np.int32)
    for child, parent, kind in levels:
        after[parent, kind] = child
    for child, parent, kind in levels:  # what a state falls back to lies above it and is complete
        if child[0] > 1:
            fall[child] = after[fall[parent], kind]
        shorter[child] = np.where(name_at[fall[child]] >= 0, fall[child], shorter[fall[child]])
        after[child] = np.where(after[child] > 0, after[child], after[fall[child]])
    return Automaton(letters, np.arange(1, width), after, name_at.astype(np.int32), shorter, names)


def _places(automaton: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, name and start (from 0) of every hit."""
    overlap = automaton.longest - 1
    codes = [letters_of(t) for t in texts]
    lanes = [(i, s) for i, c in enumerate(codes) for s in range(0, len(c), LANE)]
    found = []
    for k in range(0, len(lanes), LANES):
        own = lanes[k : k + LANES]
        owner, start = np.array([i for i, _ in own]), np.array([s for _, s in own])
        parts = [codes[i][s : s + LANE + overlap] for i, s in own]
        sizes = np.array([len(p) for p in parts])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((sizes.max(), len(own)), np.uint16)
        for column, lane in enumerate(order):
            part = parts[lane]
            if len(automaton.letters):
                spot = np.minimum(np.searchsorted(automaton.letters, part), len(automaton.letters) - 1)
                grid[: len(part), column] = np.where(automaton.letters[spot] == part, automaton.kinds[spot], 0)
        owner, start, sizes = owner[order], start[order], sizes[order]
        state = np.zeros(len(own), np.int32)
        alive = np.searchsorted(-sizes, -np.arange(grid.shape[0]), side="left")  # lanes longer than each step
        for step in range(grid.shape[0]):
            n = alive[step]
            state = automaton.after[state[:n], grid[step, :n]]
            hit = np.flatnonzero((automaton.name_at[state] >= 0) | (automaton.shorter[state] > 0))
            lane, at = hit, state[hit]
            while len(lane):
                name = automaton.name_at[at]
                real = name >= 0
                found.append(np.stack([name[real], np.full(real.sum(), step), owner[lane[real]], start[lane[real]]]))
                at = automaton.shorter[at]
                lane, at = lane[at > 0], at[at > 0]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    name, step, owner, start = np.concatenate(found, axis=1)
    size = np.array([len(n) for n in automaton.names])[name]
    first = step + 1 - size
    mine = first < LANE  # a later one is of the next lane
    return owner[mine], name[mine], (start + first)[mine]


def _packed(automaton: Automaton) -> tuple:
    return (*[a.tobytes() for a in (automaton.letters.astype("<u4"), automaton.after, automaton.name_at, automaton.shorter)], automaton.names)


def _unpacked(row) -> Automaton:
    letters = np.frombuffer(row["letters"], "<u4")
    width = len(letters) + 1
    after = np.frombuffer(row["after"], np.int32).reshape(-1, width)
    return Automaton(letters, np.arange(1, width), after, np.frombuffer(row["name_at"], np.int32), np.frombuffer(row["shorter"], np.int32), list(row["names"]))


def shards(names: DataFrame, states: int | None = None) -> DataFrame:
    """``names(name)`` as automata, a row each: ``(shard, letters, after, name_at, shorter, names)``.

    Sorted neighbours share their beginnings, so a name adds no more states than the letters after what it shares with the one before.
    """
    most = states or STATES
    fields = ["shard", "letters", "after", "name_at", "shorter", "names"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, used, kinds, last = TaskContext.get().partitionId() << 32, [], 1, set(), ""

        def made() -> pa.RecordBatch:
            *arrays, own = _packed(build(held))
            return pa.RecordBatch.from_arrays([pa.array([part]), *[pa.array([a], pa.large_binary()) for a in arrays], pa.array([own])], names=fields)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                shared = next((i for i, (x, y) in enumerate(zip(last, name)) if x != y), min(len(last), len(name)))
                if held and (used + len(name) - shared > most or len(kinds | set(name)) >= CLASSES):
                    yield made()
                    part, held, used, kinds, shared = part + 1, [], 1, set(), 0
                held.append(name)
                used, last = used + len(name) - shared, name
                kinds |= set(name)
        if held:
            yield made()

    known = names.select(F.col("name").cast("string").alias("name")).where("name <> ''").distinct()
    schema = "shard long, letters binary, after binary, name_at binary, shorter binary, names array<string>"
    return known.repartitionByRange("name").sortWithinPartitions("name").mapInArrow(run, schema)


def occurrences(texts: DataFrame, names: DataFrame, key: str, text: str, states: int | None = None) -> DataFrame:
    """``(key, name, start)``: every place, from 1, where a name of ``names(name)`` stands in a text of ``texts``."""
    spark: SparkSession = texts.sparkSession
    told = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text <> ''")
    kind = told.schema["key"].dataType.simpleString()
    table = staged(shards(names, states), "automata")
    found = spark.createDataFrame([], f"key {kind}, name string, start long")
    for row in table.select("shard").orderBy("shard").collect():  # one row of a few megabytes at a time comes to the driver
        held = spark.sparkContext.broadcast(table.where(F.col("shard") == row["shard"]).first())
        found = found.unionByName(told.mapInArrow(_searched(held), f"key {kind}, name string, start long"))
    return found.withColumnRenamed("key", key)


def _searched(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _unpacked(held.value)
        names = pa.array(automaton.names)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                own = batch.slice(i, 512)
                row, name, start = _places(automaton, own.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([own.column(0).take(pa.array(row)), names.take(pa.array(name)), pa.array(start + 1, pa.int64())], names=["key", "name", "start"])

    return run


def outermost(hits: DataFrame, key: str) -> DataFrame:
    """The hits of a text that no longer hit of it covers.

    In this order those come before a hit that begin earlier, or there and are longer; it is covered if one of them ends as late.
    """
    rows = hits.withColumn("end", F.col("start") + F.length("name"))
    before = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("end") > F.col("reach"))).drop("end", "reach")
