"""The capture side: what to ask for, what to keep, and what a feed holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutline.sources.scratch import staged


def gate(board: DataFrame, days: DataFrame, throttle_min: int = 60, near_hours: int = 48, baseline_hours: int = 20) -> DataFrame:
    """``(now, paid, reason)``: whether a paid call is worth it at each ``days(now, last_paid)``, from the free list alone.

    ``board(now, pair, starts, first_seen)`` has what the free list shows at each time. The reasons are tried in order: a call
    that was just paid, an empty list, a pair not seen before, a start that is near, a baseline point that is due.
    """
    hours = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 3.6e9
    near = (F.col("starts") > F.col("now")) & (hours(F.col("starts"), F.col("now")) <= near_hours)
    new = F.col("first_seen").isNull() | (F.col("first_seen") > F.col("now"))
    told = board.groupBy("now").agg(F.count("*").alias("listed"), F.count_if(new).alias("new"), F.count_if(near).alias("near"))
    since = F.coalesce(hours(F.col("now"), F.col("last_paid")), F.lit(1e9))
    reason = (
        F.when(since * 60 < throttle_min, "throttled").when(F.coalesce("listed", F.lit(0)) == 0, "nothing listed").when(F.col("new") > 0, "new")
        .when(F.col("near") > 0, "near").when(since >= baseline_hours, "baseline").otherwise("unchanged")
    )
    out = days.join(told, "now", "left").withColumn("reason", reason)
    return out.select("now", F.col("reason").isin("new", "near", "baseline").cast("int").alias("paid"), "reason")


def pruned(rows: DataFrame, key: list[str], eps: float = 0.02) -> DataFrame:
    """``rows`` with ``dropped``: why a row is not read, null where it is: no key, or a price at certainty."""
    blank = F.lit(False)
    for k in key:
        blank = blank | F.col(k).isNull()
    sure = ~F.coalesce(F.col("p1").between(eps, 1 - eps), F.lit(False))
    return rows.withColumn("dropped", F.when(blank, "no key").when(sure, "certain"))


def outside_window(rows: DataFrame, venue: str, start: str, end: str) -> DataFrame:
    """What a broken capture of one venue wrote between two times is not read; nothing is deleted."""
    return rows.where(~((F.col("source") == venue) & (F.col("snap") >= F.lit(start).cast("timestamp")) & (F.col("snap") < F.lit(end).cast("timestamp"))))


def liquid(spread: Column, depth: Column, volume: Column, most_spread: float, least_depth: float, least_volume: float) -> Column:
    """Whether a market passes all gates; what is not known does not pass."""
    return F.coalesce((spread <= most_spread) & (depth >= least_depth) & (volume >= least_volume), F.lit(False))


def sides_of(payload: Column) -> Column:
    """``(name, bid, ask, mid)`` of the sides of a market, from either of two payload shapes; an empty array where it is neither.

    One shape has sides with quotes, the other lists of names and prices that are JSON texts themselves. A mid is valid only if
    both sides of the quote are inside 0 to 1 and in order.
    """
    one = F.from_json(payload, "marketSides array<struct<description:string,quote:struct<bid:double,ask:double>,price:double>>")["marketSides"]
    two = F.from_json(payload, "outcomes string, outcomePrices string")
    names, prices = F.from_json(two["outcomes"], "array<string>"), F.from_json(two["outcomePrices"], "array<string>")

    def quoted(s: Column) -> Column:
        bid, ask = s["quote"]["bid"], s["quote"]["ask"]
        good = (bid >= 0) & (ask <= 1) & (bid <= ask)
        return F.struct(s["description"].alias("name"), bid.alias("bid"), ask.alias("ask"), F.when(good, (bid + ask) / 2).otherwise(s["price"]).alias("mid"))

    def listed(n: Column, p: Column) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(n.alias("name"), none.alias("bid"), none.alias("ask"), p.try_cast("double").alias("mid"))

    empty = F.array().cast("array<struct<name:string,bid:double,ask:double,mid:double>>")
    return F.coalesce(F.transform(one, quoted), F.when(F.size(names) == F.size(prices), F.zip_with(names, prices, listed)), empty)


def candidates(groups: list[DataFrame], done: DataFrame, budget: int) -> DataFrame:
    """The next ``budget`` ids to collect: ids of earlier groups first, each once, those done left out."""
    rows = None
    for rank, group in enumerate(groups):
        part = group.select("id", F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("id").agg(F.min("rank").alias("rank")).join(done.select("id"), "id", "left_anti")
    return first.orderBy("rank", "id").limit(budget)


def throttled(calls: DataFrame, key: str, call: str, ts: str, minutes: int) -> DataFrame:
    """Calls that come at least ``minutes`` after the last of their key that was let through; the first of a key passes.

    Each call points to the first at least that much later; those let through are reached from the key's first. Pointers are
    doubled, so there are as many rounds as the longest chain has binary digits, and each is an equi-join on the call. The later call lies in
    the next stretch of ``minutes`` or is the first of a stretch beyond, so no task needs all calls of a key. ``call`` is unique.
    """
    gap = minutes * 60_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = staged(calls.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(call).alias("call"), at.alias("at"), F.floor(at / gap).alias("stretch")), "calls")
    this = F.struct("at", "call")
    firsts = rows.groupBy("key", "stretch").agg(F.min(this).alias("first"))
    later = Window.partitionBy("key").orderBy("stretch")  # a row a stretch
    firsts = firsts.select("key", "stretch", "first", F.lead("first").over(later).alias("second"), F.lead("stretch").over(later).alias("nearest"), F.lead("first", 2).over(later).alias("third"))
    # A call looks into the next stretch from ``at + gap`` on; what it finds there comes before the first of any later one.
    seeks = rows.select("key", (F.col("stretch") + 1).alias("stretch"), (F.col("at") + gap).alias("at"), "call", F.lit(0).alias("kind"))
    there = rows.select("key", "stretch", "at", "call", F.lit(1).alias("kind"))
    ahead = Window.partitionBy("key", "stretch").orderBy(F.desc("at"), F.desc("kind"), F.desc("call")).rowsBetween(Window.unboundedPreceding, -1)
    found = seeks.unionByName(there).withColumn("found", F.min(F.when(F.col("kind") == 1, this)).over(ahead)).where("kind = 0").select("call", "found")
    beyond = F.when(F.col("nearest") == F.col("stretch") + 1, F.col("third")).otherwise(F.col("second"))
    links = rows.join(firsts, ["key", "stretch"]).join(found, "call").select("call", F.coalesce("found", beyond)["call"].alias("next"))
    jump = staged(links.where("next is not null"), "jump")
    reached = staged(firsts.groupBy("key").agg(F.min("first").alias("first")).select(F.col("first.call").alias("call")), "reached")
    while True:
        more = reached.join(jump, "call").select(F.col("next").alias("call"))
        grown = staged(reached.union(more).distinct(), "reached")
        jump = staged(jump.join(jump.select(F.col("call").alias("next"), F.col("next").alias("after")), "next").select("call", F.col("after").alias("next")), "jump")
        reached = grown
        if jump.isEmpty():  # no chain is longer than what has been reached
            return calls.join(reached.select(F.col("call").alias(call)), call, "left_semi")


def synthetic(spark, n_sides: int, n_cards: int, per_card: int, seed: int = 7) -> DataFrame:
    """A corpus with known truth: each side has a latent strength, and the stronger wins as often as a logistic curve says.

    All numbers come from hashes of seed and place, so rows are made in parallel and are the same whatever the partitions.
    """

    def uniform(*of: Column | str) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 30)) + 0.5) / (1 << 30)

    def normal(*of: Column | str) -> Column:
        return F.sqrt(-2 * F.ln(uniform(F.lit(1), *of))) * F.cos(2 * F.pi() * uniform(F.lit(2), *of))

    strength = lambda who: normal(F.lit(3), who)
    rows = spark.range(n_cards * per_card).select(F.col("id").alias("bout_id"), F.floor(F.col("id") / per_card).cast("int").alias("card"))
    a = F.floor(uniform(F.lit(4), "bout_id") * n_sides).cast("long")
    b = F.pmod(a + 1 + F.floor(uniform(F.lit(5), "bout_id") * (n_sides - 1)).cast("long"), F.lit(n_sides))
    rows = rows.select("bout_id", F.date_add(F.lit("2015-01-03").cast("date"), F.col("card") * 7).alias("dt"), a.alias("r_id"), b.alias("b_id"))
    p = 1 / (1 + F.exp(strength(F.col("b_id")) - strength(F.col("r_id"))))
    won = uniform(F.lit(6), "bout_id") < p
    u = uniform(F.lit(7), "bout_id")
    method = F.when(u < 0.33, "KO/TKO").when(u < 0.52, "SUB").otherwise("DEC")
    return rows.select(
        "bout_id", "dt", "r_id", "b_id", p.alias("p_true"), F.when(won, "r").otherwise("b").alias("winner"), method.alias("method"),
        F.when(method == "DEC", 900).otherwise(F.ceil(uniform(F.lit(8), "bout_id") * 899)).cast("long").alias("total_sec"),
    )
