"""Quotes and the append-only ledger: devigging, consensus, open and close, dedupe, settlement, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_per_source(quotes: DataFrame) -> DataFrame:
    """The last quote of each source for a pair, ties to the larger id, each column by its last value that is known; ``max_by`` needs no sort."""
    key = F.struct("snap", "quote_id")
    return quotes.groupBy("pair", "source").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in ("p1", "o1", "o2")])


def consensus(quotes: DataFrame) -> DataFrame:
    """Across the last quotes of the sources: best odds, median, upper median and number of sources."""
    last = last_per_source(quotes)
    upper = F.get(F.sort_array(F.collect_list("p1")), F.floor(F.count("*") / 2).cast("int"))  # as many as there are sources
    return last.groupBy("pair").agg(
        F.max("o1").alias("best_o1"), F.max("o2").alias("best_o2"), F.expr("percentile(p1, 0.5)").alias("median_p1"), upper.alias("upper_p1"),
        F.countDistinct("source").alias("sources"),
    )


def line_movement(quotes: DataFrame, least: int = 3) -> DataFrame:
    """First and last probability of a pair at a source, drift and span in days."""
    key = F.struct("snap", "quote_id")
    out = quotes.groupBy("pair", "source").agg(
        F.min_by("p1", key).alias("open_p"), F.max_by("p1", key).alias("close_p"), F.countDistinct("snap").alias("snaps"),
        ((F.unix_micros(F.max("snap")) - F.unix_micros(F.min("snap"))) / 86400e6).alias("span_days"),
    )
    return out.where(F.col("snaps") >= least).withColumn("drift", F.col("close_p") - F.col("open_p"))


def ledger_rows(quotes: DataFrame) -> DataFrame:
    """Quotes as rows of a ledger: captured by the hour, so that a key may come again with a new price."""
    hour = F.date_trunc("day", "snap")
    opening = F.row_number().over(Window.partitionBy("pair", "source").orderBy("snap", "quote_id")) == 1
    return quotes.select(
        hour.alias("captured"), F.col("source").alias("venue"), "pair", "quote_id", "p1", opening.alias("opening"),
        (1 / F.col("o1") * (1 + 0.037 / 2)).alias("implied"), F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("p1") + (F.col("quote_id") % 7 - 3) / 50)).alias("p_model"),
    )


KEY = ("captured", "venue", "pair")


def dedupe(rows: DataFrame) -> DataFrame:
    """One row per key, the last written; a key once marked as opening stays so."""
    values = [c for c in rows.columns if c not in (*KEY, "opening")]
    return rows.groupBy(*KEY).agg(*[F.max_by(c, "quote_id").alias(c) for c in values if c != "quote_id"], F.max("quote_id").alias("quote_id"), F.bool_or("opening").alias("opening"))


def migrate(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows of an older schema with the columns it lacks, filled by their defaults."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def report(rows: DataFrame, won: Column) -> DataFrame:
    """Per venue, over keys whose edge makes a bet: number, closing-line value, return and its standard error."""
    edge = F.col("p_model") - F.col("implied")
    first = rows.groupBy("venue", "pair").agg(
        F.min_by(F.struct("implied", "p1", edge.alias("edge"), "quote_id"), F.struct("captured", "quote_id")).alias("open"), F.max_by("p1", F.struct("captured", "quote_id")).alias("close")
    )
    bets = first.select("venue", "pair", "open.*", "close").where("edge > 0.02 and implied >= 0.5")
    gain = F.when(won, 1 / F.col("implied") - 1).otherwise(-1.0)
    return bets.select("venue", (F.col("close") - F.col("p1")).alias("clv"), gain.alias("gain")).groupBy("venue").agg(
        F.count("*").alias("bets"), F.avg("clv").alias("clv"), F.avg("gain").alias("roi"), (F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("se")
    )


def settle(claims: DataFrame, bouts: DataFrame, days: int = 4) -> DataFrame:
    """The bout of a claim: same unordered pair within ``days``, the nearest, then the earliest in corpus order.

    An equi-join on the pair and a block of days, of which a claim reaches three at most, with the distance as residual: a
    pair that meets ever so often makes no pairs of all its claims and bouts. The best of each claim is kept without a sort.
    """
    pair = lambda a, b: F.array_sort(F.array(a, b))
    left = claims.select("claim_id", "claim_dt", "a", "b", pair(F.col("a"), F.col("b")).alias("pair"))
    right = bouts.select(pair(F.col("r_id"), F.col("b_id")).alias("pair"), "bout_id", "dt", "winner", "r_id")
    block = lambda day: F.floor(F.unix_date(day) / (2 * days))
    reach = F.sequence(block(F.date_sub("claim_dt", days)), block(F.date_add("claim_dt", days)))
    near = left.withColumn("block", F.explode(reach)).join(right.withColumn("block", block(F.col("dt"))), ["pair", "block"]).withColumn("gap", F.abs(F.datediff("claim_dt", "dt"))).where(F.col("gap") <= days)
    best = near.groupBy("claim_id").agg(F.min_by(F.struct("bout_id", "gap", "winner", "r_id"), F.struct("gap", "dt", "bout_id")).alias("m"))
    out = left.join(best, "claim_id", "left")
    hit = F.when(F.col("m.winner").isin("r", "b"), ((F.col("m.winner") == "r") == (F.col("m.r_id") == F.col("a"))).cast("int"))
    return out.select("claim_id", F.col("m.bout_id").alias("bout_id"), F.col("m.gap").cast("long").alias("gap"), hit.alias("hit"))


def settle_by_id(claims: DataFrame, bouts: DataFrame, days: int = 4) -> DataFrame:
    """``claims(event, claim, known_id, claim_dt, a, b, p)`` with ``hit`` and ``how``: by the id, and only where that is null or unknown by names.

    ``hit`` is whether ``a`` won; null for a draw or where no bout is found, and ``how`` is null where none is.
    """
    known = bouts.select(F.col("bout_id").alias("known_id"), F.col("winner").alias("w"), F.col("r_id").alias("red"))
    first = claims.join(known, "known_id", "left")
    won = F.when(F.col("w").isin("r", "b"), ((F.col("w") == "r") == (F.col("red") == F.col("a"))).cast("int"))
    by_id = first.where("w is not null").select("event", "claim", "p", won.alias("hit"), F.lit("id").alias("how"))
    rest = first.where("w is null").select("event", "p", F.col("claim").alias("claim_id"), "claim_dt", "a", "b")
    told = settle(rest, bouts, days)
    by_name = rest.select("event", "p", "claim_id").join(told, "claim_id").select("event", F.col("claim_id").alias("claim"), "p", "hit", F.when(F.col("bout_id").isNotNull(), "name").alias("how"))
    return by_id.unionByName(by_name)


def match_pairs(told: DataFrame, bouts: DataFrame) -> DataFrame:
    """``told(a, b, day, p_a)`` to ``bouts(bout_id, dt, a, b)`` on the unordered pair and the day: ``(bout_id, p_a)`` of the bout's own first side.

    A pair that either side has twice on one day cannot be told apart and is left out.
    """
    pair = F.array_sort(F.array("a", "b"))
    left = told.groupBy(pair.alias("pair"), "day").agg(F.count("*").alias("n"), F.first("a").alias("first"), F.first("p_a").alias("p")).where("n = 1")
    right = bouts.groupBy(pair.alias("pair"), F.col("dt").alias("day")).agg(F.count("*").alias("k"), F.first("a").alias("a"), F.first("bout_id").alias("bout_id")).where("k = 1")
    return right.join(left, ["pair", "day"]).select("bout_id", F.when(F.col("first") == F.col("a"), F.col("p")).otherwise(1 - F.col("p")).alias("p_a"))


def latest_prices(quotes: DataFrame, hours: int = 18, sweep_hours: int = 1) -> DataFrame:
    """The last price of each pair and source, if it is not stale against the latest sweep."""
    now = quotes.agg(F.max("snap").alias("now"))
    key = F.struct("snap", "quote_id")
    last = quotes.groupBy("pair", "source").agg(F.max("snap").alias("snap"), F.max_by("p1", key).alias("p1"))
    sweep = last.groupBy("source").agg(F.max("snap").alias("sweep"))
    fresh = F.greatest(F.col("now") - F.expr(f"interval {hours} hours"), F.col("sweep") - F.expr(f"interval {sweep_hours} hours"))
    return last.join(F.broadcast(sweep), "source").join(F.broadcast(now)).where(F.col("snap") >= fresh).select("pair", "source", "p1")


def new_keys(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose key is not in the ledger yet."""
    return rows.join(known.select(*KEY).distinct(), list(KEY), "left_anti")
