"""Conditional base rates: by quantile, by fixed edges, by division and by card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutline.operators.career import before
from boutline.sources.scratch import staged

# Left-closed edges of the buckets.
EDGES = (0.0, 0.15, 0.30, 0.45, 0.60, 0.75, 1.01)
ROUND_ONE_EDGES = (0.0, 0.30, 0.45, 0.60, 0.75, 1.01)


def bucket_right(value: Column, edges: list[Column]) -> Column:
    """The number of the right-closed bucket of a value, from 1."""
    out = F.lit(len(edges) + 1)
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(value <= edges[i], i + 1).otherwise(out)
    return out


def bucket_left(value: Column, edges: tuple[float, ...]) -> Column:
    """The number of the left-closed bucket of a value, from 1; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i + 1).otherwise(out)
    return out


#: Parts of equal width into which the range of a key's values is cut to find a quantile; parts with more values than ``CROWD`` are cut again.
PARTS, CROWD, LEVELS = 65536, 100_000, 4


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``keys`` and the array ``edges`` of interpolated quantiles of each, exact, without a task that holds all values.

    Values are counted by parts of their key's range, combined where they lie; then only the parts that hold a wanted rank are looked into.
    """
    names = [f"key_{i}" for i in range(len(keys))] or ["key_0"]  # so that no key has a name used here
    given = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("key_0")]
    table = staged(rows.select(*given, F.col(value).cast("double").alias("v")).where("v is not null"), "values")
    ranks = [(F.col("all") - 1) * F.lit(q) for q in shares]
    ends = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), (x - F.floor(x)).alias("mix"), end(x).cast("long").alias("rank")) for i, x in enumerate(ranks) for k, end in enumerate((F.floor, F.ceil))]
    wanted = table.groupBy(*names).agg(F.count("*").alias("all")).select(*names, F.inline(F.array(*ends)))
    own = list(names)
    for level in range(LEVELS):
        span = table.groupBy(*names).agg(F.min("v").alias("low"), F.max("v").alias("high"))
        part = F.least(F.floor((F.col("v") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * PARTS), F.lit(PARTS - 1))
        placed = table.join(span, names).select(*names, part.alias(f"part_{level}"), "v")
        upto = Window.partitionBy(*names).orderBy(f"part_{level}").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
        counts = placed.groupBy(*names, f"part_{level}").agg(F.count("*").alias("n"))
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        wanted = wanted.drop("n").join(counts, names).where("rank >= before and rank < before + n")
        names = [*names, f"part_{level}"]
        wanted = staged(wanted.select(*names, "i", "k", "mix", (F.col("rank") - F.col("before")).alias("rank"), "n"), "wanted")
        table = placed.join(wanted.select(*names).distinct(), names)
        if (wanted.agg(F.max("n").alias("n")).first()["n"] or 0) <= CROWD:
            break
    inside = Window.partitionBy(*names).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    cells = table.groupBy(*names, "v").agg(F.count("*").alias("many")).withColumn("within", F.coalesce(F.sum("many").over(inside), F.lit(0)))
    hits = cells.join(wanted, names).where("rank >= within and rank < within + many")
    edges = hits.groupBy(*own, "i").agg(F.max(F.when(F.col("k") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("v"))).alias("b"), F.max("mix").alias("mix"))
    edge = F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("mix")).alias("e"))
    out = edges.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(edge)), lambda x: x["e"]).alias("edges"))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, own)], "edges")


def quantile_rates(rows: DataFrame, keys: list[str], value: str, y: str, parts: int = 4) -> DataFrame:
    """By key, the rate of ``y`` in right-closed quantile buckets with its lift and half width, and the spread of the rates.

    Thin cells are flagged, not dropped. Value and ``y`` are written once; the edges are a row per key, so they are broadcast.
    """
    rows = staged(rows.select(*keys, F.col(value).cast("double").alias("value"), F.col(y).cast("double").alias("y")).where("value is not null"), "rates")
    edges = quantiles(rows, keys, "value", [k / parts for k in range(1, parts)])
    facts = F.broadcast(edges.join(rows.groupBy(*keys).agg(F.avg("y").alias("base")), keys))
    bucket = bucket_right(F.col("value"), [F.get("edges", F.lit(i)) for i in range(parts - 1)])
    told = rows.join(facts, keys).select(*keys, bucket.alias("bucket"), "y", "base")
    out = told.groupBy(*keys, "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.first("base").alias("base"))
    half = 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    w = Window.partitionBy(*keys)  # a key's buckets
    spread = F.max("rate").over(w) - F.min("rate").over(w)
    return out.select(*keys, "bucket", "n", "rate", (F.col("rate") - F.col("base")).alias("lift"), half.alias("half_width"), (F.col("n") < 200).cast("int").alias("thin"), spread.alias("spread"))


def quartile_rates(rows: DataFrame, value: str, y: str, parts: int = 4) -> DataFrame:
    """``quantile_rates`` of all rows as one key."""
    return quantile_rates(rows.select(F.lit(0).alias("key"), value, y), ["key"], value, y, parts).drop("key", "spread")


# The conditions: level, what is looked at, and the outcome asked for.
CONDITIONS = {
    "C1": ("side", "adj_td15", "y_td"), "C2": ("side", "opp_td_def", "y_td"), "C3": ("side", "kd15", "y_kd"), "C4": ("bout", "kd15", "itd"), "C5": ("bout", "ctrl_share", "itd"),
    "C6": ("side", "reach_diff", "y_td"), "C7": ("bout", "adj_slpm", "itd"), "C8": ("bout", "age_gap", "itd"), "C9": ("bout", "sub15", "dec"), "C10": ("side", "position", "y_td"),
    "C11": ("side", "opp_kd_against15", "y_kd"), "C12": ("side", "opp_sapm", "y_kd"), "C13": ("bout", "decisions", "itd"),
}


def condition_rows(sides: DataFrame) -> DataFrame:
    """``(condition, value, y)`` of every condition, from sides with own and opponent's levels; a bout's value is the sum of its sides'.

    The gap of ages is the difference of the sides'; the share of decisions is the mean, where both sides have three bouts before.
    """
    facts = {"y_td": F.col("td_landed") > 0, "y_kd": F.col("kd") > 0}
    own = F.array(*[F.struct(F.lit(k).alias("condition"), F.col(c).cast("double").alias("value"), facts[y].cast("double").alias("y")) for k, (level, c, y) in CONDITIONS.items() if level == "side"])
    summed = {c: F.sum(c).alias(c) for c in ("kd15", "ctrl_share", "adj_slpm", "sub15")}
    gap = (F.max("age") - F.min("age")).alias("age_gap")
    decided = F.when(F.min("n_prior") >= 3, F.avg("decision_share")).alias("decisions")
    bouts = sides.groupBy("bout_id").agg(*summed.values(), gap, decided, F.max((F.col("method") == "DEC").cast("double")).alias("dec")).withColumn("itd", 1 - F.col("dec"))
    both = F.array(*[F.struct(F.lit(k).alias("condition"), F.col(c).cast("double").alias("value"), F.col(y).alias("y")) for k, (level, c, y) in CONDITIONS.items() if level == "bout"])
    return sides.select(F.inline(own)).unionByName(bouts.select(F.inline(both)))


def edge_rates(rows: DataFrame, value: str, y: str, edges: tuple[float, ...], least: int) -> DataFrame:
    """Rate of ``y`` by fixed left-closed buckets of at least ``least`` rows."""
    told = rows.select(bucket_left(F.col(value), edges).alias("bucket"), F.col(y).cast("double").alias("y")).where("bucket is not null")
    return told.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("y").alias("rate")).where(F.col("n") >= least)


def decision_shares(app: DataFrame, least_wins: int) -> DataFrame:
    """For each bout whose sides both have ``least_wins`` wins before: their shares of wins by decision, and whether it was finished."""
    won = (F.col("result") == "W").cast("double")
    by_decision = ((F.col("result") == "W") & (F.col("method") == "DEC")).cast("double")
    w = before("entity")
    rows = app.select("bout_id", "dt", "method", "total_sec", "result", "entity", F.sum(won).over(w).alias("wins"), F.sum(by_decision).over(w).alias("decisions"))
    rows = rows.where(F.col("wins") >= least_wins).withColumn("share", F.col("decisions") / F.col("wins"))
    both = rows.groupBy("bout_id", "dt", "method", "total_sec").agg(
        F.count("*").alias("sides"), F.avg("share").alias("mean"), F.min("share").alias("low"), F.max("share").alias("high"),
        F.max_by("result", "share").alias("result_of_high"),
    )
    return both.where("sides = 2").withColumn("finish", (F.col("method") != "DEC").cast("double"))


def decision_curve(app: DataFrame) -> DataFrame:
    """Finish rate by the mean share of decisions, and the correlation over all rows."""
    rows = decision_shares(app, 2)
    r = rows.agg(F.corr("mean", "finish").alias("r"))
    return edge_rates(rows, "mean", "finish", EDGES, 150).join(F.broadcast(r))


def style_imposition(app: DataFrame) -> DataFrame:
    """Finish rate by bucket of the mean, the lower and the higher share, where these differ."""
    rows = decision_shares(app, 3).where("low <> high")
    long = rows.select("finish", F.expr("stack(3, 'mean', mean, 'low', low, 'high', high) as (predictor, share)"))
    told = long.select("predictor", bucket_left(F.col("share"), EDGES).alias("bucket"), "finish").where("bucket is not null")
    return told.groupBy("predictor", "bucket").agg(F.count("*").alias("n"), F.avg("finish").alias("rate")).where("n >= 60")


def style_spreads(app: DataFrame, least: int = 60) -> DataFrame:
    """For each predictor how it goes with the finish: correlation, and the first bucket's rate less the last one's, of those with ``least`` bouts; null with under three."""
    rows = decision_shares(app, 3).where("low <> high")
    long = rows.select("finish", F.expr("stack(3, 'mean', mean, 'low', low, 'high', high) as (predictor, share)"))
    overall = long.groupBy("predictor").agg(F.count("*").alias("n"), F.corr("share", "finish").alias("r"))
    cells = long.withColumn("bucket", bucket_left(F.col("share"), EDGES)).where("bucket is not null").groupBy("predictor", "bucket").agg(F.count("*").alias("n"), F.avg("finish").alias("rate"))
    shown = cells.where(F.col("n") >= least).groupBy("predictor").agg(F.count("*").alias("shown"), (F.min_by("rate", "bucket") - F.max_by("rate", "bucket")).alias("spread"))
    return overall.join(shown, "predictor", "left").select("predictor", "n", "r", F.when(F.col("shown") >= 3, F.col("spread")).alias("spread"))


def style_who(app: DataFrame, wide: float = 0.2, least_wide: int = 60) -> DataFrame:
    """Who gets the finish: the share of finishes, and of all bouts, that the side with fewer decisions among its wins has won; and of finishes of sides far apart."""
    rows = decision_shares(app, 3).where("low <> high and result_of_high in ('W', 'L')")
    ours, ended, apart = (F.col("result_of_high") == "L").cast("double"), F.col("finish") == 1, F.col("high") - F.col("low") >= wide
    return rows.agg(
        F.count_if(ended).alias("finishes"), F.avg(F.when(ended, ours)).alias("to_finisher"), F.avg(ours).alias("wins_overall"), F.count_if(apart).alias("wide_n"),
        F.when(F.count_if(apart & ended) >= least_wide, F.avg(F.when(apart & ended, ours))).alias("wide_to_finisher"),
    )


def r1_curve(app: DataFrame) -> DataFrame:
    """Share of finishes in round one, by the finish share of an entity with at least 8 bouts."""
    finish = (F.col("method") != "DEC").cast("double")
    entity = app.groupBy("entity").agg(F.count("*").alias("bouts"), F.avg(finish).alias("finish_share")).where("bouts >= 8")
    first = (F.floor(F.col("total_sec") / 300) + 1 <= 1).cast("double")
    rows = app.where("method <> 'DEC'").join(entity, "entity").select("finish_share", first.alias("first"))
    return edge_rates(rows, "finish_share", "first", ROUND_ONE_EDGES, 60)


def r1_read(app: DataFrame, least_three: int = 400, least_five: int = 100) -> DataFrame:
    """The curve of bouts of three rounds with the scale of those of five; no row where it would say nothing.

    A curve is no use with fewer than three buckets or with a bucket outside of .15 to .85, or from too few finishes. The scale is
    that of all bouts of five rounds against three, or .727 where these are too few.
    """
    finish = (F.col("method") != "DEC").cast("double")
    entity = app.groupBy("entity").agg(F.count("*").alias("bouts"), F.avg(finish).alias("finish_share")).where("bouts >= 8")
    first = (F.floor(F.col("total_sec") / 300) + 1 <= 1).cast("double")
    rows = app.where("method <> 'DEC'").join(entity, "entity").select(bucket_left(F.col("finish_share"), ROUND_ONE_EDGES).alias("bucket"), first.alias("y"), (F.col("sched_sec") >= 1500).alias("five"))
    cells = rows.groupBy("bucket", "five").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))  # a dozen rows
    all_of = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    five, three = F.col("five"), ~F.col("five")
    shown = three & (F.col("n") >= 60) & F.col("bucket").isNotNull()
    rate = F.col("hits") / F.col("n")
    facts = cells.agg(
        all_of("n", three).alias("n3"), all_of("n", five).alias("n5"), all_of("hits", three).alias("h3"), all_of("hits", five).alias("h5"), F.count_if(shown).alias("shown"),
        F.count_if(shown & ~rate.between(0.15, 0.85)).alias("odd"),
    )
    scale = F.when((F.col("n5") >= least_five) & (F.col("h3") > 0), F.col("h5") / F.col("n5") / (F.col("h3") / F.col("n3"))).otherwise(0.727)
    told = cells.where(shown).select("bucket", "n", rate.alias("rate")).join(F.broadcast(facts))
    return told.where((F.col("n3") >= least_three) & (F.col("shown") >= 3) & (F.col("odd") == 0)).select("bucket", "n", "rate", scale.alias("five_round_scale"))


def division_rates(bouts: DataFrame) -> DataFrame:
    """Per division and scheduled length: size, finish rates and median length, of divisions with 50 bouts."""
    one = lambda c: F.avg(c.cast("double"))
    cells = bouts.groupBy("weight_class", "sched_sec").agg(
        F.count("*").alias("n"), one(F.col("method") != "DEC").alias("finish"), one(F.col("method") == "KO/TKO").alias("ko"),
        one(F.col("method") == "SUB").alias("sub"), F.expr("percentile(total_sec, 0.5)").alias("median_sec"),
    )
    return cells.where("n >= 50")


def market_bases(bouts: DataFrame) -> DataFrame:
    """Base rates of markets, a row each."""
    one = lambda c: F.avg(c.cast("double"))
    side = lambda k: (F.avg((F.col(f"r_{k}") >= 1).cast("double")) + F.avg((F.col(f"b_{k}") >= 1).cast("double"))) / 2
    wide = bouts.agg(
        side("td_landed").alias("td"), side("kd").alias("kd"), one(F.col("method") != "DEC").alias("itd"), one(F.col("method") == "DEC").alias("dec"),
        one(F.col("total_sec") > 450).alias("over_1_5"), one(F.col("total_sec") > 750).alias("over_2_5"),
        *[one((F.col("method") != "DEC") & (F.col("total_sec") <= 300 * k)).alias(f"by_round_{k}") for k in (1, 2, 3)],
    )
    return wide.select(F.expr("stack(9, " + ", ".join(f"'{c}', {c}" for c in wide.columns) + ") as (market, rate)"))


def cards(bouts: DataFrame) -> DataFrame:
    """Per card of at least 6 bouts: size, finishes and finishes by round."""
    finish = F.col("method") != "DEC"
    rnd = F.least(F.floor(F.col("total_sec") / 300) + 1, F.lit(5))
    return bouts.groupBy("event").agg(
        F.count("*").alias("size"), F.sum(finish.cast("long")).alias("finishes"), F.least(F.sum((finish & (rnd == 1)).cast("long")), F.lit(8)).alias("r1"),
    ).where("size >= 6")


def card_shape(card: DataFrame) -> DataFrame:
    """Distribution over cards: percentiles and over-dispersion against independent bouts."""
    p = F.broadcast(card.agg((F.sum("finishes") / F.sum("size")).alias("p")))
    rows = card.join(p)
    return rows.agg(
        F.count("*").alias("cards"), F.avg("finishes").alias("mean_finishes"), F.expr("percentile(finishes, 0.1)").alias("p10"),
        F.expr("percentile(finishes, 0.5)").alias("p50"), F.expr("percentile(finishes, 0.9)").alias("p90"),
        (F.var_samp("finishes") / F.avg(F.col("size") * F.col("p") * (1 - F.col("p")))).alias("overdispersion"),
    )


def card_size_buckets(card: DataFrame) -> DataFrame:
    """Mean finishes by size of card."""
    size = F.col("size")
    bucket = F.when(size <= 9, "6-9").when(size <= 11, "10-11").when(size <= 12, "12").otherwise("13+")
    return card.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("cards"), F.avg(F.col("finishes") / size).alias("finish_share"), F.avg("r1").alias("r1"))


def with_card_position(bouts: DataFrame) -> DataFrame:
    """Each bout's place on its card, from 0, and the size of the card."""
    w = Window.partitionBy("event")
    return bouts.select("*", (F.row_number().over(w.orderBy("dt", "bout_id")) - 1).alias("place"), F.count("*").over(w).alias("card_size"))


def pounds(division: Column, table: dict[str, int]) -> Column:
    """The pounds of a division by the first name that it contains; 155 where it contains none."""
    out = F.lit(155)
    for name, weight in reversed(table.items()):
        out = F.when(F.lower(division).contains(name), weight).otherwise(out)
    return out
