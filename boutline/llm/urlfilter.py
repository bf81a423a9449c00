"""URL rules judged by a cascade of Bloom filters, with DataFrame functions alone.

The keys of a URL are the pairs of a suffix of its host and a prefix of its path that a rule could
have: as many labels and characters as some rule has. All keys of the corpus are the universe. The
first filter encodes the listed keys, the second the other keys of the universe that pass the first,
the third the listed keys that pass the second, and so on until none is left, so a key of the universe
is judged exactly by literals of the plan, with no join.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule; repeated rows
are each judged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


class Filter(NamedTuple):
    bits: bytes
    size: int
    hashes: int
    level: int


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, rules: list[Rule]) -> list[Column]:
    """The keys a url may be listed by, null where it is too short, those with the longest host and path first."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}, reverse=True)
    labels = F.length(host) - F.length(F.translate(host, ".", "")) + 1
    return [
        F.when((labels >= k) & (F.length(path) >= n), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n)))
        for k, n in shapes
    ]


def _positions(key: Column, size: int, hashes: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(i), key), F.lit(size)) for i in range(hashes)]


def passes(key: Column, bloom: Filter) -> Column:
    """Whether a filter has all bits of a key."""
    tests = []
    for at in _positions(key, bloom.size, bloom.hashes, bloom.level):
        byte = F.conv(F.hex(F.substring(F.lit(bloom.bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests.append(F.getbit(byte, (at % 8).cast("int")) == 1)
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _sized(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter of ``n`` keys that lets so many of the others through."""
    size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return size, max(1, round(size / n * math.log(2)))


def _encoded(rows: DataFrame, shapes: dict[str, tuple[int, int]], level: int) -> dict[str, Filter]:
    """A filter of the keys of each name in ``rows(name, key)``: their bits are or-ed by byte on the executors, in one aggregation."""
    at = None
    for name, (size, hashes) in shapes.items():
        own = F.array(*_positions(F.col("key"), size, hashes, level))
        at = F.when(F.col("name") == name, own) if at is None else at.when(F.col("name") == name, own)
    bit = F.get(F.array(*[F.lit(1 << k) for k in range(8)]), (F.col("at") % 8).cast("int"))
    spread = rows.where(F.col("name").isin(list(shapes))).select("name", F.explode(at).alias("at"))
    words = spread.groupBy("name", (F.col("at") / 8).cast("int").alias("byte")).agg(F.bit_or(bit).alias("bits"))
    out = {name: bytearray(-(-size // 8)) for name, (size, _) in shapes.items()}
    for row in words.collect():  # a row per byte of the filters at most
        out[row["name"]][row["byte"]] = row["bits"]
    return {name: Filter(bytes(out[name]), size, hashes, level) for name, (size, hashes) in shapes.items()}


def cascades(universe: DataFrame, lists: dict[str, list[str]]) -> dict[str, list[Filter]]:
    """For each named list of keys the filters that tell its keys from the rest of ``universe(key)``, all lists level by level at once.

    A filter has at most six bytes for a key of its list, and the lists are the driver's own, so what is a literal of the plan is bounded
    by what the driver was given.
    """
    spark = universe.sparkSession
    listed = spark.createDataFrame([(name, key) for name, keys in lists.items() for key in set(keys)], "name string, key string")
    names = F.array(*[F.lit(n) for n in lists])
    rows = universe.select("key", F.explode(names).alias("name")).join(F.broadcast(listed.withColumn("listed", F.lit(True))), ["name", "key"], "left")
    rows = stored(rows.select("name", "key", F.coalesce("listed", F.lit(False)).alias("listed")), "universe")
    sizes = {(r["name"], r["listed"]): r["count"] for r in rows.groupBy("name", "listed").count().collect()}
    out: dict[str, list[Filter]] = {name: [] for name in lists}
    level = 0
    while shapes := {n: _sized(k, _rate(k, sizes.get((n, False), 0)) if level == 0 else 0.5) for n in lists if (k := sizes.get((n, level % 2 == 0), 0))}:
        side = F.col("listed") == F.lit(level % 2 == 0)
        for name, bloom in _encoded(rows.where(side), shapes, level).items():
            out[name].append(bloom)
        let = F.lit(False)
        for name in shapes:
            let = F.when(F.col("name") == name, passes(F.col("key"), out[name][-1])).otherwise(let)
        rows = rows.where(F.col("name").isin(list(shapes)) & (side | let))
        sizes = {(r["name"], r["listed"]): r["count"] for r in rows.groupBy("name", "listed").count().collect()}
        level += 1
    return out


def _rate(n: int, others: int) -> float:
    """The share of other keys that the first filter should let through, so that the levels together are smallest."""
    return min(0.5, max(1e-9, n * math.sqrt(0.5) / max(1, others)))


def member(key: Column, filters: list[Filter]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(filters) % 2 == 1)
    for i in range(len(filters) - 1, -1, -1):
        out = F.when(~passes(key, filters[i]), F.lit(i % 2 == 1)).otherwise(out)
    return key.isNotNull() & F.coalesce(out, F.lit(False))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``; of the rules that fit, the one with the longest host, then path, holds."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    own = keys(F.col("host"), F.col("path"), rules)
    if not own:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    universe = rows.select(F.explode(F.array(*own)).alias("key")).where("key is not null").distinct()
    verdicts = sorted({r.verdict for r in rules})
    filters = cascades(universe, {v: [r.key for r in rules if r.verdict == v] for v in verdicts})
    rows = rows.select("*", *[key.alias(f"key{i}") for i, key in enumerate(own)])
    hits = [F.coalesce(*[F.when(member(F.col(f"key{i}"), filters[v]), F.lit(v)) for v in verdicts]).alias(f"v{i}") for i in range(len(own))]
    rows = rows.select("*", *hits)
    rule = F.coalesce(*[F.when(F.col(f"v{i}").isNotNull(), F.col(f"key{i}")) for i in range(len(own))])
    verdict = F.coalesce(*[F.col(f"v{i}") for i in range(len(own))], F.lit(default))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
