"""Document fingerprints: one-permutation MinHash of five-word shingles, with DataFrame functions alone.

Each shingle is hashed once; the high bits choose one of ``BINS`` bins, which keeps its least hash. An empty
bin takes over the value of a filled bin chosen by its own hash order of all bins (optimal
densification). The low ``BITS`` bits of each bin are stored; chance agreement of these is corrected in
the likeness.

Edge cases: a text of fewer than five words is one shingle; a null or empty text, or one of white space, has a
fingerprint of zeros and is like its own kind alone; rows alike in ``doc_id`` and text count as one document in the
order and are each returned; a row without ``doc_id`` comes after all others; a table of one document is
its own next; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutline.llm.common import release, stored

BINS = 128
BITS = 8
WIDTH = 5
_SHIFT = 63 - (BINS.bit_length() - 1)
_EMPTY = (1 << _SHIFT) - 1
_BLANKS = r"[\x20\x09-\x0D]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: bound to a variable, where a repeated expression is not."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column) -> Column:
    """Positive 63-bit hashes of the shingles of a text."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    top = F.lit((1 << 63) - 1)

    def of(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)]).bitwiseAND(top)
        )
        few = F.array(F.xxhash64(h).bitwiseAND(top))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) >= WIDTH, many).when(F.size(h) > 0, few).otherwise(none)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text: ``BINS`` values of ``BITS`` bits in hexadecimal digits."""
    marks = F.array(*[F.lit((b << _SHIFT) | _EMPTY) for b in range(BINS)])  # so that each bin has a value
    value = lambda x: x.bitwiseAND(F.lit(_EMPTY))
    bin_of = lambda x: F.shiftright(x, _SHIFT)

    def packed(least: Column) -> Column:
        def filled(full: Column) -> Column:
            def taken(b: Column) -> Column:
                rank = F.array_min(
                    F.transform(full, lambda y, j: F.xxhash64(b, bin_of(y)).bitwiseAND(F.lit(0x7FFFFFFFFFFF0000)).bitwiseOR(j.cast("long")))
                )
                return F.get(full, rank.bitwiseAND(F.lit(0xFFFF)).cast("int"))

            own = F.transform(least, lambda x, b: F.when(value(x) != _EMPTY, x).otherwise(taken(b)))
            low = F.transform(own, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0"))
            return F.when(F.size(full) > 0, F.lower(F.array_join(low, ""))).otherwise(F.lit("0" * (BINS * BITS // 4)))

        return _let(F.filter(least, lambda x: value(x) != _EMPTY), filled)

    def least_of(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(ordered, i - 1))))

    ordered = F.sort_array(F.concat(shingle_hashes(text), marks))
    return _let(_let(ordered, least_of), packed)


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two fingerprints, corrected for values that agree by chance."""
    w, chance = BITS // 4, 2.0**-BITS
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0),
        lambda n, i: n + F.when(F.substring(a, i * w + 1, F.lit(w)) == F.substring(b, i * w + 1, F.lit(w)), 1).otherwise(0),
    )
    blank = F.lit("0" * (BINS * w))
    return (
        F.when(a == b, F.lit(1.0)).when((a == blank) | (b == blank), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))
    )


_NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """``(id, mark, text)``: ``id`` and ``mark`` tell documents apart; ``id`` is ``_NO_ID`` without a ``doc_id``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def successors(ids: DataFrame) -> DataFrame:
    """``(id, mark, next_id, next_mark)`` in descending order, the last followed by the first.

    Range partitions are numbered in order; within one a window gives the next row, and the last row
    takes the first of the next partition, of which there is one per partition.
    """
    order = [F.col("id").desc(), F.col("mark").desc()]
    ranged = stored(ids.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    within = Window.partitionBy("part").orderBy(*order)
    heads = ranged.groupBy("part").agg(F.max(F.struct("id", "mark")).alias("head"))
    ends = Window.orderBy("part")  # a row per partition
    heads = heads.select("part", F.lead("head").over(ends).alias("after"), F.first("head").over(ends).alias("top"))
    heads = heads.select("part", F.coalesce("after", "top").alias("turn"))
    nearest = F.coalesce(F.lead(F.struct("id", "mark")).over(within), F.col("turn"))
    rows = ranged.join(heads, "part").select("id", "mark", nearest.alias("nearest"))
    return rows.select("id", "mark", F.col("nearest.id").alias("next_id"), F.col("nearest.mark").alias("next_mark"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, and the likeness to the edit and to the next document.

    The edit replaces the last half of the code points by the beginning of the next document. Both joins
    with the texts take them by the same keys and columns, so the texts are shuffled once and read twice.
    """
    spark, rows = docs.sparkSession, keyed(docs)
    own = stored(rows.select("id", "mark", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint")), "prints")
    single = own.dropDuplicates(["id", "mark"])
    after = single.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("fingerprint").alias("next_fingerprint"))
    pairs = successors(own.select("id", "mark")).join(single, ["id", "mark"]).join(after, ["next_id", "next_mark"])
    pairs = stored(pairs, "pairs")
    release(spark)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = pairs.select(F.col("next_id").alias("id"), F.col("next_mark").alias("mark"), F.col("id").alias("for_id"), F.col("mark").alias("for_mark"), half.alias("half"))
    heads = rows.join(wanted, ["id", "mark"]).select(
        F.col("for_id").alias("id"), F.col("for_mark").alias("mark"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head")
    ).dropDuplicates(["id", "mark"])
    joined = rows.join(pairs, ["id", "mark"]).join(heads, ["id", "mark"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("head"))
    told = joined.select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited"))
    told = told.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint",
    )
    return told.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
