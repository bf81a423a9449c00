"""Identity by name: ambiguous keys dropped, a cascade of keys, and fuzzy matches on blocked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.text import similarity, surname

CUTOFF = 0.88


def variants(roster: DataFrame) -> DataFrame:
    """``roster(id, key, nickname)`` to keys ``(rank, variant, id)``: exact, without blanks, first name and nickname, nickname and surname, surname.

    A variant that two ids have at one rank belongs to neither; variants of under four letters are none.
    """
    first, last, nick = F.get(F.split("key", " "), F.lit(0)), surname(F.col("key")), F.nullif(F.trim(F.lower("nickname")), F.lit(""))
    forms = [F.col("key"), F.replace("key", F.lit(" "), F.lit("")), F.when(nick.isNotNull(), F.concat_ws(" ", first, nick)), F.when(nick.isNotNull(), F.concat_ws(" ", nick, last)), last]
    rows = roster.select("id", F.posexplode(F.array(*forms)).alias("rank", "variant")).where(F.length("variant") >= 4)
    return rows.groupBy("rank", "variant").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").select("rank", "variant", "id")


def resolve(asked: DataFrame, roster: DataFrame, aliases: DataFrame | None = None, cutoff: float | None = None) -> DataFrame:
    """``asked(ask_id, key)`` to ``(ask_id, id, how)``: by the first form of the roster that the key is, ``how`` being its rank.

    ``aliases(key, other)`` are applied before. With a ``cutoff`` what is then left is matched to the most similar roster key, ``how`` 9;
    null where nothing fits.
    """
    if aliases is not None:
        known = aliases.groupBy("key").agg(F.min("other").alias("other"))
        asked = asked.join(known, "key", "left").select("ask_id", F.coalesce("other", "key").alias("key"))
    table = variants(roster)
    forms = F.array("key", F.replace("key", F.lit(" "), F.lit("")), F.coalesce(surname(F.col("key")), F.lit("")))
    told = asked.select("ask_id", F.explode(F.array_distinct(forms)).alias("variant"))
    hits = told.join(table, "variant").groupBy("ask_id").agg(F.min_by(F.struct("id", "rank"), F.struct("rank", "id")).alias("m"))
    out = asked.select("ask_id", "key").dropDuplicates(["ask_id"]).join(hits, "ask_id", "left").select("ask_id", "key", "m.id", F.col("m.rank").alias("how"))
    if cutoff is None:
        return out.drop("key")
    alone = roster.groupBy("key").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").select("id", "key")
    near = fuzzy(out.where("id is null").select("ask_id", "key"), alone, cutoff).select("ask_id", F.col("id").alias("near"))
    return out.join(near, "ask_id", "left").select("ask_id", F.coalesce("id", "near").alias("id"), F.coalesce("how", F.when(F.col("near").isNotNull(), 9)).alias("how"))


def fuzzy(asked: DataFrame, roster: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The most similar roster name of each asked one at ``cutoff`` or above, ties to the smaller id.

    No match is lost: keys of lengths a and b at ``cutoff`` differ by at most (2 / cutoff - 2) * min(a, b) in
    length and by e = (1 - cutoff) * (a + b) letters put in or left out, so of e + 1 pieces of one key one is
    whole in the other. Candidates share such a piece; equal keys are compared once.
    """
    most, slack = 2 / cutoff - 1, 1e-9

    def sizes(n: Column) -> Column:
        return F.sequence(F.ceil(n / most - slack).cast("int"), F.floor(n * most + slack).cast("int"))

    def edits(a: Column, b: Column) -> Column:
        return F.floor((a + b) * (1 - cutoff) + slack).cast("int")

    def piece(a: Column, b: Column) -> Column:
        return F.floor(a / (edits(a, b) + 1)).cast("int")

    own, theirs = F.length("k"), F.length("key")
    left = asked.select(F.col("key").alias("k")).where("k is not null").distinct().select("k", F.explode(sizes(own)).alias("size"))
    left = left.select("k", "size", piece(own, F.col("size")).alias("width"), F.sequence(F.lit(0), edits(own, F.col("size"))).alias("at"))
    left = left.select("k", "size", "width", F.explode(F.transform("at", lambda i: F.substring(F.col("k"), i * F.col("width") + 1, F.col("width")))).alias("gram")).distinct()
    known = roster.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    widths = known.select("id", "key", theirs.alias("size"), F.explode(F.array_distinct(F.transform(sizes(theirs), lambda a: piece(a, theirs)))).alias("width"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), theirs - F.col("width") + 1))
    right = widths.select("id", "key", "size", "width", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("key"), i, F.col("width"))))).alias("gram"))
    pairs = left.join(right, ["size", "width", "gram"]).select("k", "id", "key").distinct()
    scored = pairs.withColumn("score", similarity("k", "key")).where(F.col("score") >= cutoff)
    best = scored.groupBy("k").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), "id")).alias("m"))
    return asked.join(best, F.col("key") == F.col("k")).groupBy("ask_id").agg(F.min_by("m", F.struct(-F.col("m.score"), F.col("m.id"))).alias("m")).select("ask_id", "m.id", "m.score")


def displayed(rows: DataFrame, name: str, spellings: DataFrame) -> DataFrame:
    """``rows`` with ``shown``: the preferred spelling of a name in ``spellings(key, shown)``, else the name itself."""
    told = spellings.groupBy("key").agg(F.min("shown").alias("preferred"))
    return rows.withColumn("key", F.lower(name)).join(told, "key", "left").withColumn("shown", F.coalesce("preferred", name)).drop("key", "preferred")


def in_corner_order(a: Column, b: Column, first: Column) -> tuple[Column, Column]:
    """Two names in order: one that is in ``first`` comes first, unless both are or neither is."""
    swap = F.array_contains(first, b) & ~F.array_contains(first, a)
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def on_card(told: DataFrame, card: DataFrame) -> DataFrame:
    """``told(event, name)`` with ``how`` a name is found among ``card(event, key)``: as written, without blanks, with its two parts swapped, or unknown."""
    name, blankless = F.col("name"), lambda c: F.replace(c, F.lit(" "), F.lit(""))
    swapped = F.concat_ws(" ", F.element_at(F.split("name", " "), -1), F.get(F.split("name", " "), F.lit(0)))
    forms = F.array(F.struct(F.lit(0).alias("rank"), name.alias("form")), F.struct(F.lit(1).alias("rank"), blankless(name).alias("form")), F.struct(F.lit(2).alias("rank"), swapped.alias("form")))
    keys = card.select("event", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("key").alias("form")), F.struct(F.lit(1).alias("rank"), blankless(F.col("key")).alias("form")), F.struct(F.lit(2).alias("rank"), F.col("key").alias("form")))).alias("k"))
    keys = keys.select("event", F.col("k.rank").alias("rank"), F.col("k.form").alias("form")).distinct()
    hits = told.select("event", "name", F.inline(forms)).distinct().join(keys, ["event", "rank", "form"]).groupBy("event", "name").agg(F.min("rank").alias("rank"))
    how = F.when(F.col("rank") == 0, "as written").when(F.col("rank") == 1, "without blanks").when(F.col("rank") == 2, "swapped").otherwise("unknown")
    return told.join(hits, ["event", "name"], "left").withColumn("how", how).drop("rank")
