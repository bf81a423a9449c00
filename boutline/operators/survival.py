"""Competing risks by the minute: intervals, cumulative survival, and what rolls up from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_MINUTES = 25


def fought() -> Column:
    """The minutes of a bout that were fought."""
    return F.least(F.greatest(F.ceil(F.col("total_sec") / 60), F.lit(1)), F.lit(MAX_MINUTES)).cast("int")


def ending() -> Column:
    """The class of a bout's last minute: 0 goes on, 1 and 2 the first and second side by knockout, 3 and 4 by submission."""
    return F.when((F.col("method") == "DEC") | (F.col("winner") == "draw"), 0).otherwise(
        F.when(F.col("winner") == "r", 1).otherwise(2) + F.when(F.col("method") == "SUB", 2).otherwise(0)
    )


def intervals(bouts: DataFrame) -> DataFrame:
    """A row per bout and minute fought, in both orientations; the class of the last is how it ended, and of all others 0."""
    rows = bouts.select("bout_id", fought().alias("last"), ending().alias("ends"), F.explode(F.sequence(F.lit(1), fought())).alias("minute"))
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("orient"))
    mirrored = F.when(F.col("ends") == 0, 0).otherwise(F.when(F.col("ends") % 2 == 1, F.col("ends") + 1).otherwise(F.col("ends") - 1))
    cls = F.when(F.col("minute") < F.col("last"), 0).otherwise(F.when(F.col("orient") == 0, F.col("ends")).otherwise(mirrored))
    rnd = F.least(F.floor((F.col("minute") - 1) / 5) + 1, F.lit(5))
    return rows.select("bout_id", "minute", "orient", rnd.alias("round"), cls.alias("class"))


def with_hazards(bouts: DataFrame) -> DataFrame:
    """A row per bout and scheduled minute with fixed hazards of each class, for roll-ups without a fit."""
    n = (F.col("sched_sec") / 60).cast("int")
    rows = bouts.select("bout_id", "sched_sec", "r_kd", "b_kd", F.explode(F.sequence(F.lit(1), n)).alias("minute"))
    late = 1 + F.col("minute") / 50
    return rows.select(
        "bout_id", "sched_sec", "minute", ((0.010 + 0.005 * F.col("r_kd")) * late).alias("h1"), ((0.010 + 0.005 * F.col("b_kd")) * late).alias("h2"),
        (0.006 * late).alias("h3"), (0.005 * late).alias("h4"),
    )


def roll_up(hazards: DataFrame) -> DataFrame:
    """Per bout: the probability of each way to end, the decision, and the expected minutes; they sum to one.

    Survival is the running product of what is left, by one window per bout.
    """
    stay = 1 - (F.col("h1") + F.col("h2") + F.col("h3") + F.col("h4"))
    w = Window.partitionBy("bout_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    rows = hazards.select("*", F.coalesce(F.product(stay).over(w), F.lit(1.0)).alias("alive"), stay.alias("stay"))
    parts = [F.sum(F.col("alive") * F.col(f"h{k}")).alias(name) for k, name in enumerate(("a_ko", "b_ko", "a_sub", "b_sub"), 1)]
    out = rows.groupBy("bout_id").agg(*parts, F.min(F.col("alive") * F.col("stay")).alias("dec"), F.sum("alive").alias("exp_minutes"))
    return out.withColumn("total", F.col("a_ko") + F.col("b_ko") + F.col("a_sub") + F.col("b_sub") + F.col("dec"))


def rescaled(rolled: DataFrame, finish: float) -> DataFrame:
    """The joint with finishes scaled to a given mean level, decisions taking the rest; still coherent."""
    level = F.broadcast(rolled.agg(F.avg(1 - F.col("dec")).alias("level")))
    k = F.least(F.lit(finish) / F.col("level"), 1 / (1 - F.col("dec")))
    ends = [c for c in ("a_ko", "b_ko", "a_sub", "b_sub")]
    rows = rolled.join(level).select("bout_id", *[(F.col(c) * k).alias(c) for c in ends])
    rows = rows.withColumn("dec", 1 - sum((F.col(c) for c in ends), F.lit(0.0)))
    win = (F.col("a_ko") + F.col("a_sub") + F.col("dec") / 2).alias("a_wins")
    return rows.select("*", win, (F.col("a_ko") / (F.col("a_ko") + F.col("a_sub"))).alias("a_ko_given_finish"))
