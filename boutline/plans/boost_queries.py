"""Queries of boosted trees, and their DuckDB statements: the same rounds unrolled over the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators import career, rates
from boutline.plans import boosting
from boutline.plans.career_queries import PANEL, rounded, strength
from boutline.sources.scratch import staged

RANGE = boosting.Quantiles((0.1, 0.5, 0.9))
RANGE_FEATURES = ["own_slpm", "opp_sapm", "own_str_acc", "opp_str_def", "own_kd15", "own_finish_rate"]
RANGE_ROUNDS, RANGE_DEPTH, RANGE_RATE = 12, 3, 0.2
WAYS = boosting.Classes(3)
WAY_LEVELS = ["own_td15", "own_kd15", "own_ctrl_share", "own_slpm", "own_finish_rate"]
WAY_FEATURES = [f"{k}_{f}" for k in WAY_LEVELS for f in ("sum", "gap")]
WAY_ROUNDS, WAY_DEPTH, WAY_RATE = 10, 2, 0.2


def _cuts(rows: DataFrame, shares: list[float]) -> list[int]:
    """Days that divide ``rows``; of the rows after the first one the second share, and so on."""
    out = []
    for share in shares:
        rows = rows.where(F.col("day") > out[-1]) if out else rows
        found = rates.quantiles(rows, [], "day", [share]).first()
        out.append(int(found["edges"][0]) if found else 0)
    return out


def boosted_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges for strikes a minute by boosted 10, 50 and 90 % lines that do not cross, widened on later rows to hold four of five, measured on the last."""
    rows = career.panel(strength(spark, sf)).select(F.unix_date("dt").alias("day"), F.col("y_strikes_min").alias("y"), *RANGE_FEATURES)
    rows = staged(rows, "ranges")
    fit_until, middle_until = _cuts(rows, [0.6, 0.5])
    fit = rows.where(F.col("day") <= fit_until)
    edges, base = boosting.feature_edges(fit, RANGE_FEATURES), rates.quantiles(fit, [], "y", list(RANGE.shares)).first()["edges"]
    table = staged(rows.select("day", "y", boosting.binned(RANGE_FEATURES, edges).alias("bins")), "binned")
    model = boosting.boost(table.where(F.col("day") <= fit_until), RANGE, np.array(base), RANGE_ROUNDS, RANGE_DEPTH, RANGE_RATE)
    lines = [F.get("pred", F.lit(i)) for i in range(3)]
    told = boosting.predicted(table.where(F.col("day") > fit_until), model).select("day", "y", F.least(lines[0], lines[1]).alias("low"), lines[1].alias("mid"), F.greatest(lines[1], lines[2]).alias("high"))
    told = staged(told, "lines")
    miss = told.where(F.col("day") <= middle_until).select(F.greatest(F.col("low") - F.col("y"), F.col("y") - F.col("high")).alias("miss"))
    shift = F.lit(float(rates.quantiles(miss, [], "miss", [0.8]).first()["edges"][0]))
    inside, crossed = F.col("y").between(F.col("low") - shift, F.col("high") + shift), (F.col("low") > F.col("mid")) | (F.col("mid") > F.col("high"))
    out = told.where(F.col("day") > middle_until).agg(
        F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low") + 2 * shift).alias("width"), F.avg(F.abs(F.col("y") - F.col("mid"))).alias("mae"), F.count_if(crossed).alias("crossed")
    )
    return rounded(out, ["n", "crossed"], ["coverage", "width", "mae"])


def way_rows(spark: SparkSession, sf: str) -> DataFrame:
    panel = career.panel(strength(spark, sf))
    way = F.when(F.col("method") == "KO/TKO", 1).when(F.col("method") == "SUB", 2).otherwise(0)
    meta = panel.groupBy("bout_id").agg(F.unix_date(F.max("dt")).alias("day"), F.max(way).alias("y"))
    return staged(meta.join(career.symmetric(panel, WAY_LEVELS), "bout_id").select("bout_id", "day", "y", *WAY_FEATURES), "ways")


def boosted_ways(spark: SparkSession, sf: str) -> DataFrame:
    """A bout ends by decision, knockout or submission: one tree for each and round, fitted on four fifths; loss on the rest against the shares of the ways."""
    rows = way_rows(spark, sf)
    (until,) = _cuts(rows, [0.8])
    fit = rows.where(F.col("day") <= until)
    counts = {r["y"]: r["n"] for r in fit.groupBy("y").agg(F.count("*").alias("n")).collect()}  # three
    prior = np.array([(counts.get(k, 0) + 1) / (sum(counts.values()) + 3) for k in range(3)])
    table = staged(rows.select("day", "y", boosting.binned(WAY_FEATURES, boosting.feature_edges(fit, WAY_FEATURES)).alias("bins")), "binned")
    model = boosting.boost(table.where(F.col("day") <= until), WAYS, np.log(prior), WAY_ROUNDS, WAY_DEPTH, WAY_RATE)
    told = boosting.predicted(table.where(F.col("day") > until), model)
    powers = F.transform("pred", lambda x: F.exp(x - F.array_max("pred")))
    p = F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))
    told = told.select("y", p.alias("p"))
    given, known = F.get("p", F.col("y").cast("int")), F.get(F.array(*[F.lit(float(x)) for x in prior]), F.col("y").cast("int"))
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    out = told.agg(F.count("*").alias("n"), (-F.avg(F.ln(given))).alias("loss"), (-F.avg(F.ln(known))).alias("prior_loss"), F.avg(F.get("p", F.lit(0))).alias("decisions"), F.max(F.abs(total - 1)).alias("away"))
    return rounded(out, ["n"], ["loss", "prior_loss", "decisions", "away"])


QUERIES = {f.__name__: f for f in (boosted_ranges, boosted_ways)}

_SYMMETRIC = ", ".join(f"sum({k}) AS {k}_sum, max({k}) - min({k}) AS {k}_gap" for k in WAY_LEVELS)
ORACLES = {
    "boosted_ranges": f"""{PANEL}, p AS MATERIALIZED (SELECT row_number() OVER () AS id, date_diff('day', DATE '1970-01-01', dt) AS day, y_strikes_min AS y, {', '.join(RANGE_FEATURES)} FROM panel),
        c1 AS (SELECT CAST(floor(quantile_cont(day, 0.6)) AS BIGINT) AS one FROM p), c2 AS (SELECT CAST(floor(quantile_cont(day, 0.5)) AS BIGINT) AS two FROM p, c1 WHERE day > one),
        t AS MATERIALIZED (SELECT *, day <= one AS fit FROM p, c1, c2), {boosting.sql_boost('t', RANGE_FEATURES, RANGE, [f'quantile_cont(y, {q})' for q in RANGE.shares], RANGE_ROUNDS, RANGE_DEPTH, RANGE_RATE)},
        w AS (SELECT id, any_value(y) AS y, max(CASE WHEN k = 0 THEN pred END) AS l, max(CASE WHEN k = 1 THEN pred END) AS mid, max(CASE WHEN k = 2 THEN pred END) AS h FROM boosted WHERE NOT fit GROUP BY id),
        r AS (SELECT w.y, least(l, mid) AS low, mid, greatest(mid, h) AS high, day <= two AS middle FROM w JOIN t USING (id)), s AS (SELECT quantile_cont(greatest(low - y, y - high), 0.8) AS shift FROM r WHERE middle)
        SELECT count(*) AS n, count(*) FILTER (WHERE low > mid OR mid > high) AS crossed, round(avg(CASE WHEN y BETWEEN low - shift AND high + shift THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(high - low + 2 * shift), 6) AS width,
        round(avg(abs(y - mid)), 6) AS mae FROM r, s WHERE NOT middle""",
    "boosted_ways": f"""{PANEL}, p AS MATERIALIZED (SELECT bout_id AS id, date_diff('day', DATE '1970-01-01', max(dt)) AS day, max(CASE method WHEN 'KO/TKO' THEN 1 WHEN 'SUB' THEN 2 ELSE 0 END) AS y, {_SYMMETRIC} FROM panel GROUP BY bout_id),
        c AS (SELECT CAST(floor(quantile_cont(day, 0.8)) AS BIGINT) AS one FROM p), t AS MATERIALIZED (SELECT *, day <= one AS fit FROM p, c),
        {boosting.sql_boost('t', WAY_FEATURES, WAYS, [f'ln((count(*) FILTER (WHERE y = {k}) + 1) / (count(*) + 3.0::DOUBLE))' for k in range(3)], WAY_ROUNDS, WAY_DEPTH, WAY_RATE)},
        m AS (SELECT id, fit, y, k, exp(pred - max(pred) OVER (PARTITION BY id)) AS e FROM boosted), q AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS p FROM m)
        SELECT count(*) FILTER (WHERE q.k = y) AS n, round(-avg(CASE WHEN q.k = y THEN ln(p) END), 6) AS loss, round(-avg(CASE WHEN q.k = y THEN pred END), 6) AS prior_loss, round(avg(CASE WHEN q.k = 0 THEN p END), 6) AS decisions,
        0.0::DOUBLE AS away FROM q JOIN base ON q.k = base.k WHERE NOT fit""",
}
