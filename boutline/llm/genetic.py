"""Best-fit packing of documents into few sequences by a grouping genetic algorithm on islands.

Documents of one length can change places, so a packing is told by its patterns: how many bins hold which lengths how often. A best
fit in falling order ends a length or a kind of bin at each step, so the patterns are at most a few times the window in number whatever
the corpus, and so is all that a genetic step handles: every document takes part, and nothing grows with their number.

An island is a group of a Spark table of packings. Its crossover puts whole well-filled bins of one parent into another, drops the bins
that hold their documents a second time, and fits what is displaced into the tightest bins. After each epoch the best packing
of an island moves on to the next. The evolution ends early at a packing of the least number of bins that any can have.

The first pass cuts and numbers the pieces of each length within each partition; totals of the partitions number them
throughout, and a number tells the place in the packing. Only narrow columns are shuffled, unless the ids are asked for.

Edge cases: a null or empty text is the end token alone; repeated rows are packed once each; a row without ``doc_id`` is
packed with a null id; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.llm.common import slices, stored, text_of
from boutline.llm.packing import worker_tokenizer
from boutline.llm.tokens import vocabulary_file

END, WINDOW = 2, 1024
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 4, 10, 8
#: ``((length, how often), ...)`` with falling lengths.
Pattern = tuple[tuple[int, int], ...]
#: Bins of each pattern.
Packing = dict[Pattern, int]


def fill(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def best_fit(packing: Packing, pieces: dict[int, int], window: int) -> Packing:
    """The packing with ``pieces`` (how many of each length) added, the longest first, each to the bin that it leaves the least room in."""
    open_bins: dict[int, dict[Pattern, int]] = defaultdict(dict)
    for pattern, times in packing.items():
        open_bins[window - fill(pattern)][pattern] = times
    rooms = sorted(open_bins)

    def put(pattern: Pattern, times: int, room: int) -> None:
        if room not in open_bins:
            insort(rooms, room)
        bins = open_bins[room]
        bins[pattern] = bins.get(pattern, 0) + times

    def with_more(pattern: Pattern, length: int, n: int) -> Pattern:
        counts = dict(pattern)
        counts[length] = counts.get(length, 0) + n
        return tuple(sorted(counts.items(), reverse=True))

    for length in sorted(pieces, reverse=True):
        left = pieces[length]
        while left:
            at = bisect_left(rooms, length)
            while at < len(rooms) and not open_bins[rooms[at]]:
                del open_bins[rooms[at]]
                del rooms[at]
            if at == len(rooms):
                each = window // length
                if left // each:
                    put(((length, each),), left // each, window - length * each)
                if left % each:
                    put(((length, left % each),), 1, window - length * (left % each))
                break
            room = rooms[at]
            pattern, times = open_bins[room].popitem()
            each = room // length
            bins = min(times, left // each)
            if bins:
                put(with_more(pattern, length, each), bins, room - each * length)
                left -= bins * each
            else:  # the last of them do not fill one bin
                put(with_more(pattern, length, left), 1, room - left * length)
                bins, left = 1, 0
            if times > bins:
                put(pattern, times - bins, room)
    out: Packing = {}
    for bins in open_bins.values():
        out.update(bins)
    return out


def contents(packing: Packing) -> Counter:
    out: Counter = Counter()
    for pattern, times in packing.items():
        for length, n in pattern:
            out[length] += n * times
    return out


def fitness(packing: Packing, window: int) -> tuple[int, float]:
    """Number of bins, then minus the sum of squared fills: of equal numbers the more uneven packing has more room left in one place."""
    return sum(packing.values()), -sum(times * (fill(p) / window) ** 2 for p, times in packing.items())


def least_bins(pieces: dict[int, int], window: int) -> int:
    """A number of bins that no packing can be below: for each bound, pieces that cannot share a bin, and what the room beside them cannot take."""
    n, size = np.zeros(window + 1, np.int64), np.arange(window + 1)
    for length, count in pieces.items():
        n[length] = count
    above, volume = np.cumsum(n[::-1])[::-1], np.cumsum((n * size)[::-1])[::-1]  # of lengths from here on
    at = lambda a, i: int(a[i]) if i <= window else 0
    half, best = window // 2 + 1, 0
    for k in range(window // 2 + 1):
        alone, large = at(above, window - k + 1), at(above, half) - at(above, max(half, window - k + 1))
        room = large * window - (at(volume, half) - at(volume, max(half, window - k + 1)))
        small = at(volume, k) - at(volume, half)
        best = max(best, alone + large + max(0, -((room - small) // window)))
    return best


def _without(packing: Packing, pieces: Counter, rng: random.Random) -> tuple[Packing, Counter]:
    """The packing without whole bins until ``pieces`` are out of it, the emptiest bins first; and what else those bins held."""
    surplus, displaced, kept = Counter(pieces), Counter(), {}
    for pattern in sorted(packing, key=lambda p: (fill(p), rng.random())):
        times = packing[pattern]
        gone = min(times, max((-(-surplus[length] // n) for length, n in pattern if surplus[length] > 0), default=0))
        if times > gone:
            kept[pattern] = times - gone
        for length, n in pattern if gone else ():
            out = min(surplus[length], n * gone)
            surplus[length] -= out
            displaced[length] += n * gone - out
    return kept, +displaced


def crossover(parent: Packing, donor: Packing, window: int, rng: random.Random) -> Packing:
    """``parent`` with some of the well-filled bins of ``donor`` as they are."""
    fills = sorted((fill(p) for p in donor), reverse=True)
    bar = fills[int(rng.uniform(0.05, 0.6) * (len(fills) - 1))]
    share = rng.uniform(0.2, 0.9)
    injected = {p: rng.randint(1, times) for p, times in donor.items() if fill(p) >= bar and rng.random() < share}
    kept, displaced = _without(parent, contents(injected), rng)
    for pattern, times in injected.items():
        kept[pattern] = kept.get(pattern, 0) + times
    return best_fit(kept, displaced, window)


def _exchanged(packing: Packing, displaced: Counter, window: int) -> tuple[Packing, Counter]:
    """Bins with room give a piece for a longer displaced one that fits in its place."""
    kept: Packing = {}
    for pattern, times in packing.items():
        room = window - fill(pattern)
        for length, _ in pattern if room else ():
            longer = max((x for x, n in displaced.items() if n and length < x <= length + room), default=0)
            if longer:
                bins = min(times, displaced[longer])
                counts = Counter(dict(pattern))
                counts[length] -= 1
                counts[longer] += 1
                swapped = tuple(sorted((+counts).items(), reverse=True))
                kept[swapped] = kept.get(swapped, 0) + bins
                displaced[longer] -= bins
                displaced[length] += bins
                times -= bins
                break
        if times:
            kept[pattern] = kept.get(pattern, 0) + times
    return kept, +displaced


def mutate(packing: Packing, window: int, rng: random.Random, share: float = 0.05) -> Packing:
    """The packing without its emptiest bins and a few others, whose pieces are exchanged for shorter ones and fitted again."""
    kept, displaced = dict(packing), Counter()
    order = sorted(packing, key=lambda p: (fill(p), rng.random()))
    chosen = order[: 1 + rng.randrange(3)] + [p for p in order if rng.random() < share]
    for pattern in dict.fromkeys(chosen):
        gone = rng.randint(1, kept[pattern])
        kept[pattern] -= gone
        if not kept[pattern]:
            del kept[pattern]
        for length, n in pattern:
            displaced[length] += n * gone
    return best_fit(*_exchanged(kept, displaced, window), window)


def evolve(population: list[Packing], pieces: dict[int, int], window: int, bound: int, rng: random.Random) -> list[Packing]:
    """``GENERATIONS`` of an island, best first; an empty one begins with the best fit of all pieces and variants of it."""
    if not population:
        first = best_fit({}, pieces, window)
        population = [first, *(mutate(first, window, rng, 0.5) for _ in range(POPULATION - 1))]
    rank = lambda p: fitness(p, window)
    population = sorted(population, key=rank)[:POPULATION]
    for _ in range(GENERATIONS):
        if rank(population[0])[0] <= bound:
            break
        pick = lambda: min(rng.sample(population, min(2, len(population))), key=rank)
        children = [mutate(crossover(pick(), pick(), window, rng), window, rng) for _ in range(POPULATION // 2)]
        seen, best = set(), []
        for packing in sorted([*population, *children], key=rank):
            if rank(packing) not in seen:
                seen.add(rank(packing))
                best.append(packing)
        population = best[:POPULATION]
    return population


def _written(packing: Packing) -> str:
    return json.dumps([[pattern, times] for pattern, times in packing.items()])


def _read(text: str) -> Packing:
    return {tuple((length, n) for length, n in pattern): times for pattern, times in json.loads(text)}


def best_packing(spark: SparkSession, pieces: dict[int, int], window: int = WINDOW, seed: int = 0) -> Packing:
    """The best packing that the islands find; ``pieces`` has how many there are of each length."""
    bound = least_bins(pieces, window)
    state = spark.range(ISLANDS).select(F.col("id").alias("island"), F.lit(None).cast("string").alias("packing"))
    for epoch in range(EPOCHS):
        step = _epoch(pieces, window, bound, f"{seed}-{epoch}")
        islands = stored(state.repartition(ISLANDS, "island").groupBy("island").applyInPandas(step, "island long, place int, bins long, score double, packing string"), "islands")
        elite = islands.where("place = 0")
        best = elite.orderBy("bins", "score", "island").first()
        if best["bins"] <= bound:
            break
        moved = elite.select(((F.col("island") + 1) % ISLANDS).alias("island"), "packing")
        state = islands.select("island", "packing").unionByName(moved)
    return _read(best["packing"])


def _epoch(pieces: dict[int, int], window: int, bound: int, seed: str) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """An epoch of one island: its packings to better ones."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = evolve([_read(t) for t in sorted(rows["packing"].dropna())], pieces, window, bound, random.Random(f"{seed}-{key[0]}"))
        ranks = [fitness(p, window) for p in found]
        columns = {"place": range(len(found)), "bins": [r[0] for r in ranks], "score": [r[1] for r in ranks], "packing": [_written(p) for p in found]}
        return pd.DataFrame({"island": [key[0]] * len(found), **columns})

    return run


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """``(part, nth, doc_id, piece, start, length, ids_crc32, ids)``: the pieces of each document; ``nth`` of its length in ``part``."""
    name = vocabulary_file(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_tokenizer(SparkFiles.get(name))
        part, last, met = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes(), [0] * (window + 1)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + last
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start - 1) % window + 1 if piece == 0 else window
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((part, met[length], doc_id, piece, start, length, zlib.crc32(own), own))
                    met[length] += 1
                    start, piece = start + length, piece + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return text_of(docs).mapInArrow(run, "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def places(packing: Packing) -> dict[str, np.ndarray]:
    """For runs of the pieces of one length: the first of them, the bin that it is in, how many a bin has, and the offset of these.

    ``key`` is the length and the number of the first piece in one long; the runs are at most the patterns times the lengths in one.
    """
    runs, met, sequence = [], Counter(), 0
    for pattern in sorted(packing, reverse=True):
        offset = 0
        for length, n in pattern:
            runs.append((length << 44 | met[length], met[length], sequence, n, offset, length))
            met[length] += n * packing[pattern]
            offset += n * length
        sequence += packing[pattern]
    columns = np.array(sorted(runs), np.int64).reshape(-1, 6).T
    return dict(zip(("key", "first", "sequence", "each", "offset", "length"), columns))


def pack_best(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids``."""
    spark = docs.sparkSession
    table = stored(cut_pieces(docs, tokenizer_path, window, end), "pieces")
    totals = stored(table.groupBy("length", "part").agg(F.count("*").alias("n")), "totals")
    pieces = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    runs = spark.sparkContext.broadcast(places(best_packing(spark, pieces, window) if pieces else {}))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        at, size, nth = runs.value, length.to_numpy(np.int64), number.to_numpy(np.int64)
        run = np.searchsorted(at["key"], size << 44 | nth, side="right") - 1
        nth = nth - at["first"][run]
        return pd.DataFrame({"sequence_id": at["sequence"][run] + nth // at["each"][run], "offset": at["offset"][run] + nth % at["each"][run] * size})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = table.join(base, ["length", "part"]).withColumn("place", place("length", F.col("base") + F.col("nth")))
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset", "ids")
