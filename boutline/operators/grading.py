"""Grading of claims: outcomes in long form, calibration bands, scores, card tallies and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutline.operators.career import before

# Edges of the claim bands.
CLAIM_BANDS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.01)
WIN_BANDS = (0.5, 0.6, 0.7, 0.8, 1.01)


def round_of_seconds(sec: Column) -> Column:
    """Round by floor: a bout that ends at 300 seconds counts to round two. Capped at five."""
    return F.least(F.floor(sec / 300) + 1, F.lit(5)).cast("long")


def round_by_ceiling(sec: Column) -> Column:
    """Round by ceiling: a bout that ends at 300 seconds counts to round one."""
    return F.greatest(F.lit(1), F.least(F.ceil(sec / 300), F.lit(5))).cast("long")


def round_of_minute(sec: Column) -> Column:
    """Round of the minute a bout ends in, from one-minute intervals."""
    minute = F.greatest(F.ceil(sec / 60), F.lit(1))
    return F.least(F.floor((minute - 1) / 5) + 1, F.lit(5)).cast("long")


def win_claims(app: DataFrame) -> DataFrame:
    """The claim that the red side wins, by the difference of as-of win rates, and what happened."""
    w = before("entity")
    wins = F.coalesce(F.sum((F.col("result") == "W").cast("double")).over(w), F.lit(0.0))
    rows = app.select("bout_id", "dt", "event", "side", "result", "method", ((wins + 2) / (F.count("*").over(w) + 4)).alias("rate"))
    both = rows.groupBy("bout_id", "dt", "event", "method").agg(
        F.max(F.when(F.col("side") == "r", F.col("rate"))).alias("ra"), F.max(F.when(F.col("side") == "b", F.col("rate"))).alias("rb"),
        F.max(F.when(F.col("side") == "r", F.col("result"))).alias("result"),
    ).where("result <> 'D'")
    p = F.greatest(F.lit(0.02), F.least(F.lit(0.98), 0.5 + F.col("ra") - F.col("rb")))
    return both.select("bout_id", "dt", "event", "method", p.alias("p"), (F.col("result") == "W").cast("int").alias("y"))


def graded(claims: DataFrame) -> DataFrame:
    """Per claim: right, Brier score and that of a coin."""
    p, y = F.col("p"), F.col("y").cast("double")
    return claims.select("*", ((p >= 0.5) == (y == 1)).cast("int").alias("right"), F.pow(p - y, 2).alias("brier"), F.lit(0.25).alias("base"))


def bands(claims: DataFrame, edges: tuple[float, ...], least: int) -> DataFrame:
    """Said against happened by left-closed bands of the probability."""
    band = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        band = F.when((F.col("p") >= edges[i]) & (F.col("p") < edges[i + 1]), i + 1).otherwise(band)
    told = claims.withColumn("band", band).where("band is not null")
    return told.groupBy("band").agg(F.count("*").alias("n"), F.avg("p").alias("said"), F.avg(F.col("y").cast("double")).alias("happened")).where(F.col("n") >= least)


def scores(claims: DataFrame) -> DataFrame:
    """Accuracy, Brier, log loss, base Brier and skill in one pass."""
    p, y = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p"))), F.col("y").cast("double")
    out = claims.agg(
        F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == (y == 1)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("p") - y, 2)).alias("brier"),
        (-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg(y).alias("base"),
    )
    base = F.col("base") * (1 - F.col("base"))
    return out.select("*", base.alias("base_brier"), (1 - F.col("brier") / base).alias("skill"))


def auc(claims: DataFrame) -> DataFrame:
    """The area under the curve by counts per distinct probability: ties count one half.

    Counts per value are pre-aggregated; running sums go over range buckets, so no window holds all rows.
    """
    cells = claims.groupBy(F.floor(F.col("p") * 1000).alias("bucket"), "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    inside = Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("within", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    totals = cells.groupBy("bucket").agg(F.sum("neg").alias("n"))
    lower = totals.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lower"))  # 1001 rows at most
    ranked = cells.join(F.broadcast(lower), "bucket")
    u = F.sum(F.col("pos") * (F.col("lower") + F.col("within") + F.col("neg") / 2))
    return ranked.agg((u / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` bouts of a card with the highest claim, ties to the smaller id."""
    w = Window.partitionBy("event").orderBy(F.col("p").desc(), "bout_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the average rank of ``value``: counts per distinct value in range buckets, so no window holds all rows."""
    cells = rows.groupBy(value).agg(F.count("*").alias("n_"))
    span = F.broadcast(cells.agg(F.min(value).alias("low_"), F.max(value).alias("high_")))
    bucket = F.least(F.floor((F.col(value) - F.col("low_")) / F.greatest(F.col("high_") - F.col("low_"), F.lit(1e-300)) * 4096), F.lit(4095))
    cells = cells.join(span).select(value, "n_", bucket.alias("bucket_"))
    inside = Window.partitionBy("bucket_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    lower = cells.groupBy("bucket_").agg(F.sum("n_").alias("all_")).select("bucket_", F.coalesce(F.sum("all_").over(upto), F.lit(0)).alias("lower_"))
    cells = cells.select(value, "n_", "bucket_", F.coalesce(F.sum("n_").over(inside), F.lit(0)).alias("within_")).join(F.broadcast(lower), "bucket_")
    return rows.join(cells.select(value, (F.col("lower_") + F.col("within_") + (F.col("n_") + 1) / 2).alias(name)), value)


def two_sided(z: Column) -> Column:
    """The two-sided normal tail beyond ``z`` of at least 0, by a rational approximation that is right to 1e-7."""
    # The coefficients of the approximation of the normal tail.
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-z * z / 2) / 2.5066282746310002 * poly)


def benjamini_hochberg(tests: DataFrame, p: str, level: float) -> DataFrame:
    """``tests`` with ``passed``: whether a test is among those up to the last whose p is within its share of the level."""
    ranked = average_ranks(tests, p, "rank_")
    ties = tests.groupBy(p).agg(F.count("*").alias("ties_"))
    size = F.broadcast(tests.agg(F.count("*").alias("m_")))
    bound = ranked.join(ties, p).join(size).where(F.col(p) <= F.lit(level) * (F.col("rank_") + (F.col("ties_") - 1) / 2) / F.col("m_")).agg(F.max(p).alias("bound_"))
    return tests.join(F.broadcast(bound)).select(*tests.columns, F.coalesce(F.col(p) <= F.col("bound_"), F.lit(False)).cast("int").alias("passed"))
