"""Helpers the text operators share: scratch tables, column guards and connected components."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.sources import views
from boutline.sources.scratch import remove, scratch_folder

#: The words of every operator here: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: A batch that goes to a Python worker ends with the row that reaches so many bytes, unless the session sets another bound.
BATCH_BYTES = 4 << 20
_BATCH, _USUAL = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies, and bounds the batches they get in bytes."""
    if spark.conf.get(_BATCH, _USUAL) == _USUAL:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    views.on_workers(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts lineage, survives lost executors.

    The table lives until ``discard`` or the end of the driver, as the returned frame is lazy.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing lazy reads any more."""
    for table in tables:
        remove(table.sparkSession, table._scratch)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession, pause: float = 0.0) -> None:
    """Lets Spark drop the shuffle files of finished steps now rather than at its next collection.

    Python gives its objects back a second later, by a thread of its own, and the cleaner takes a moment after that: with ``pause`` both are
    waited for, where a large step follows.
    """
    gc.collect()
    time.sleep(pause)
    spark._jvm.System.gc()
    time.sleep(pause / 2)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a batch is turned into stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_of(docs: DataFrame, keep_null: bool = False) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text is empty."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (text if keep_null else F.coalesce(text, F.lit(""))).alias("text"),
    )


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores after them as keep them apart from ``columns``, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Tasks that the rows of one key are dealt to.
SALTS = 8


def salted(rows: DataFrame, facts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` joined to ``facts``, of which a key has few; the rows of one key go to ``SALTS`` tasks by a hash of ``by``.

    Facts grow with the input, so they are shuffled and never broadcast.
    """
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    return dealt.join(facts.select("*", salts).hint("merge"), [*keys, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars.

    Returns ``(node, component)`` for every node with an edge whose component, the smallest node it
    reaches, is another node. Every round is a shuffle over the edges alone, written to the shared
    folder; the number of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    edges = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = salted(both, low, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = salted(large, least, ["a"], "b")
        step = (
            small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(least.select("a", F.col("low").alias("b")))
            .distinct()
        )
        done, edges = edges, stored(step, "edges")
        discard(done)
        release(spark)
