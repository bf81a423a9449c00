"""Fits by Newton steps, and their DuckDB statements: the same steps unrolled, one after another, over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.functions.odds import sigmoid
from boutline.operators import career, grading, rates
from boutline.plans import models, newton
from boutline.plans.bout_queries import CLAIMS, app
from boutline.plans.career_queries import STRENGTH, rounded, strength
from boutline.sources.scratch import staged

#: All differences and interactions of the win model, and the arms that add some of them to what comes before.
FEATURES = [*[f"d_{k}" for k in career.DIFFERENCES], "x_grapple", "x_ko", "x_sub", "x_power", "x_position"]
ARMS = (4, 13, 19, 25, 30)
STEPS, DRAWS = 5, 600


def _one(spark: SparkSession, sf: str) -> DataFrame:
    rows = career.win_rows(strength(spark, sf)).where("orient = 0 and gate >= 2").select("bout_id", F.unix_date("dt").alias("day"), (F.col("method") == "DEC").cast("int").alias("dec"), "y", *FEATURES)
    return staged(rows, "one")


def standardized_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features over their population deviation, with and without their mean taken off; their sum and their sum of squares over all of a bout's."""
    rows = _one(spark, sf)
    scale = models.moments(rows, FEATURES)
    total = lambda f, of: sum((f(F.col(f"{of}{k}")) for k in FEATURES), F.lit(0.0))
    centred = models.standardized(rows.select("bout_id", *FEATURES, F.struct(*FEATURES).alias("raw")), scale)
    plain = models.standardized(centred.select("bout_id", *[F.col(k).alias(f"z_{k}") for k in FEATURES], "raw.*"), scale, False)
    told = lambda of: [total(lambda c: c, of).alias(f"{of}sum"), total(lambda c: c * c, of).alias(f"{of}squares")]
    return rounded(plain.select("bout_id", *told(""), *told("z_")), ["bout_id"], ["sum", "squares", "z_sum", "z_squares"])


def win_fits(spark: SparkSession, sf: str) -> DataFrame:
    """The antisymmetric fit, the same on decisions alone, and what the features add to a given log-odds: three fits in one pass a step."""
    rows = _one(spark, sf)
    scaled = models.standardized(rows, models.moments(rows, FEATURES), False)

    def weights(c: newton.Columns) -> np.ndarray:
        one = np.ones(len(c["dec"]))
        return np.stack([one, c["dec"], one], axis=1)

    def offsets(c: newton.Columns) -> np.ndarray:
        market = 4 * c["y"] % 3 / 10 + (c["bout_id"] % 5 - 2) / 10
        return np.stack([0 * market, 0 * market, market], axis=1)

    found = newton.newton_fits(scaled, FEATURES, 3, uses=["dec", "y", "bout_id"], weights=weights, offsets=offsets, ridge=np.array([2.0, 2.0, 5.0]), steps=STEPS)
    long = [(fit, k, round(float(v), 5) + 0.0) for fit, c in zip(("all", "decisions", "over the market"), found) for k, v in zip(FEATURES, c)]
    return spark.createDataFrame(long, "fit string, feature string, coefficient double")


def platt_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Intercept and slope that calibrate the record's claims, fitted on even bouts and measured on odd ones, before and after."""
    rows = staged(grading.win_claims(app(spark, sf)).select("bout_id", "p", "y"), "claims")
    by = models.platt(rows.where("bout_id % 2 = 0"))
    after = models.calibrated(rows.where("bout_id % 2 = 1").withColumn("p0", F.col("p")), by)
    loss = lambda p: -F.avg(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - F.col(p)))
    out = after.agg(F.lit(by[0]).alias("intercept"), F.lit(by[1]).alias("slope"), loss("p0").alias("before"), loss("p").alias("after"))
    return rounded(out, [], ["intercept", "slope", "before", "after"])


def _weights(bout: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Poisson weights of mean one, a column for each draw."""
    u = (bout.astype(np.int64)[:, None] * 7919 + draws * 104729) % 1000003 / 1000003
    return np.searchsorted(models.POISSON, u, side="right").astype(float)


def coefficient_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Draws of the fit with Poisson weights, all fitted at once: mean, 2.5 and 97.5 %, and the share of draws whose sign is that of the whole."""
    rows = _one(spark, sf)
    scaled = models.standardized(rows, models.moments(rows, FEATURES), False)
    whole = newton.newton_fits(scaled, FEATURES, ridge=2.0, steps=STEPS)[0]
    draws = np.arange(1, DRAWS + 1)
    drawn = newton.newton_fits(scaled, FEATURES, DRAWS, uses=["bout_id"], weights=lambda c: _weights(c["bout_id"], draws), ridge=2.0, start=whole, steps=BOOTSTRAP_STEPS)
    low, high = np.percentile(drawn, [2.5, 97.5], axis=0)
    told = zip(FEATURES, whole, drawn.mean(axis=0), low, high, (drawn * whole > 0).mean(axis=0))
    return spark.createDataFrame([(k, *[round(float(v), 5) + 0.0 for v in c]) for k, *c in told], "feature string, fit double, mean double, low double, high double, sign double")


FOLDS = (0.45, 0.55, 0.65, 0.75, 0.85, 0.95)
#: Steps of a draw, which begins at the fit of the whole.
BOOTSTRAP_STEPS = 1


def _scores(rows: DataFrame, names: list[str], betas: np.ndarray) -> list[Column]:
    return [sigmoid(sum((F.lit(float(b)) * F.col(k) for b, k in zip(beta, names) if b), F.lit(0.0))) for beta in betas]


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Five expanding folds on quantiles of the date: fitted on all before a cut, measured up to the next one. All folds are fitted at once."""
    rows = _one(spark, sf)
    cuts = np.array([int(c) for c in rates.quantiles(rows, [], "day", list(FOLDS)).first()["edges"]])
    found = newton.newton_fits(rows, FEATURES, 5, uses=["day"], weights=lambda c: (c["day"][:, None] <= cuts[:-1]).astype(float), ridge=2.0, steps=STEPS)
    fold = sum((F.when(F.col("day") > int(c), 1).otherwise(0) for c in cuts), F.lit(0))
    p = F.get(F.array(F.lit(0.5), *_scores(rows, FEATURES, found)), fold)
    test = rows.withColumn("fold", fold).where("fold between 1 and 5").select("fold", p.alias("p"), F.col("y").cast("double").alias("y"))
    out = test.groupBy("fold").agg(F.count("*").alias("n"), (-F.avg(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("log_loss"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return rounded(out, ["fold", "n"], ["log_loss", "brier"])


def ablation_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Arms that add features to what comes before, all fitted at once. Each against the one before by a paired bootstrap of the log loss; adopted if it is better in 95 % of draws."""
    rows = _one(spark, sf)
    cut = int(rates.quantiles(rows, [], "day", [0.8]).first()["edges"][0])
    train, test = rows.where(F.col("day") <= cut), rows.where(F.col("day") > cut)
    scale = models.moments(train, FEATURES)
    a, b = (models.standardized(part, scale, False) for part in (train, test))
    allowed = np.arange(len(FEATURES)) < np.array(ARMS)[:, None]
    p = [F.lit(0.5), *_scores(b, FEATURES, newton.newton_fits(a, FEATURES, len(ARMS), allowed=allowed, ridge=2.0, steps=STEPS))]
    loss = lambda q: -F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q))
    gains = staged(b.select("bout_id", *[(loss(p[i]) - loss(p[i + 1])).alias(f"g{i}") for i in range(len(ARMS))]), "gains")

    def told(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros((DRAWS, len(ARMS) + 1))
        for batch in batches:
            for start in range(0, batch.num_rows, newton.ROWS):
                part = batch.slice(start, newton.ROWS)
                w = _weights(part.column("bout_id").to_numpy(), np.arange(1, DRAWS + 1))
                values = [part.column(f"g{i}").to_numpy() for i in range(len(ARMS))]
                total += w.T @ np.stack([*values, np.ones(part.num_rows)], axis=1)
        return {0: total}

    sums = newton.tree_sum(gains, told, newton.partitions_of(gains))[0].reshape(DRAWS, -1)
    means = sums[:, :-1] / sums[:, -1:]
    long = [(i + 1, ARMS[i], round(float(g.mean()), 5), round(float((g > 0).mean()), 5), int((g > 0).mean() >= 0.95)) for i, g in enumerate(means.T)]
    return spark.createDataFrame(long, "arm int, features int, gain double, p_better double, adopted int")


QUERIES = {f.__name__: f for f in (standardized_features, win_fits, platt_fit, coefficient_bootstrap, walk_forward, ablation_arms)}


def sql_newton(name: str, source: str, ridge: tuple[float, float], steps: int = 10) -> str:
    """CTEs of Newton steps for two coefficients over ``source(k, x1, x2, y, o, w)``; the last is ``name``."""
    r1, r2 = (f"{r}::DOUBLE" for r in ridge)
    out = [f"{name}_0 AS (SELECT DISTINCT k, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {source})"]
    for i in range(1, steps + 1):
        last = f"{name}_{i - 1}"
        out.append(f"""{name if i == steps else f'{name}_{i}'} AS (SELECT k, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM (
            SELECT k, max(a) AS a, max(b) AS b, sum(w * x1 * (y - p)) - {r1} * max(a) AS g1, sum(w * x2 * (y - p)) - {r2} * max(b) AS g2, sum(w * p * (1 - p) * x1 * x1) + {r1} + 1e-12 AS h11,
            sum(w * p * (1 - p) * x1 * x2) AS h12, sum(w * p * (1 - p) * x2 * x2) + {r2} + 1e-12 AS h22
            FROM (SELECT s.*, a, b, 1 / (1 + exp(-(o + a * x1 + b * x2))) AS p FROM {source} s JOIN {last} l ON s.k = l.k) GROUP BY k))""")
    return ", ".join(out)


def _poisson(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} >= {s} THEN 1 ELSE 0 END" for s in models.POISSON) + ")"


_U = "((bout_id * 7919 + draw * 104729) % 1000003 / 1000003.0::DOUBLE)"
_N = range(1, len(FEATURES) + 1)
_POS = "({0}.clinch_share + {0}.ground_share) * (1 - {1}.td_def)"
_VALUES = [f"r.{k} - b.{k}" for k in career.DIFFERENCES] + [
    "r.adj_td15 * (1 - b.td_def) - b.adj_td15 * (1 - r.td_def)", "r.adj_slpm * b.ko_loss_rate - b.adj_slpm * r.ko_loss_rate", "r.sub15 * (1 - b.td_def) - b.sub15 * (1 - r.td_def)",
    "r.kd15 * b.kd_against15 - b.kd15 * r.kd_against15", f"{_POS.format('r', 'b')} - {_POS.format('b', 'r')}",
]
_ONE = f"""{STRENGTH.replace('WITH ', 'WITH RECURSIVE ', 1)}, one AS MATERIALIZED (SELECT r.bout_id, date_diff('day', DATE '1970-01-01', r.dt) AS day, r.method, CASE r.result WHEN 'W' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
    {', '.join(f'{v} AS d{i}' for i, v in zip(_N, _VALUES))} FROM strength r JOIN strength b ON r.bout_id = b.bout_id AND r.side = 'r' AND b.side = 'b' WHERE r.result <> 'D' AND least(r.n_prior, b.n_prior) >= 2)"""


def _sql_scaled(source: str, of: str = "one") -> str:
    """CTEs of the moments of ``of`` and of the rows of ``source`` over their deviations."""
    moments = ", ".join(f"avg(d{i}) AS m{i}, coalesce(nullif(stddev_pop(d{i}), 0), 1) AS s{i}" for i in _N)
    return f"m AS (SELECT {moments} FROM {of}), z AS MATERIALIZED (SELECT {source}.*, {', '.join(f'd{i} / s{i} AS x{i}' for i in _N)} FROM {source}, m)"


_X = ", ".join(f"x{i}" for i in _N)
_DOT = lambda beta: " + ".join(f"{beta}[{i}] * x{i}" for i in _N)
_LONG = f"unnest([{', '.join(repr(k) for k in FEATURES)}]) AS feature, unnest(beta) AS c"
_CUTS = ", ".join(f"CAST(floor(quantile_cont(day, {q})) AS BIGINT) AS c{i}" for i, q in enumerate(FOLDS))
_FOLDS = " UNION ALL ".join(f"SELECT {i + 1} AS k, {', '.join(f'd{j} AS x{j}' for j in _N)}, y, 0.0::DOUBLE AS o, 1.0::DOUBLE AS w, day, c{i} AS low, c{i + 1} AS high FROM one, c" for i in range(5))
_PLAIN = "0.0::DOUBLE AS o, 1.0::DOUBLE AS w"
_LOSS = lambda p: f"-CASE WHEN y = 1 THEN ln({p}) ELSE ln(1 - {p}) END"

ORACLES = {
    "standardized_features": f"""{_ONE}, {_sql_scaled('one')}, q AS (SELECT bout_id, {', '.join(f'x{i}, x{i} - m{i} / s{i} AS z{i}' for i in _N)} FROM z, m)
        SELECT bout_id, round({' + '.join(f'x{i}' for i in _N)}, 6) AS sum, round({' + '.join(f'x{i} * x{i}' for i in _N)}, 6) AS squares, round({' + '.join(f'z{i}' for i in _N)}, 6) AS z_sum, round({' + '.join(f'z{i} * z{i}' for i in _N)}, 6) AS z_squares FROM q""",
    "win_fits": f"""{_ONE}, {_sql_scaled('one')}, t AS MATERIALIZED (SELECT unnest(range(0, 3)) AS k, z.* FROM z),
        u AS MATERIALIZED (SELECT k, {_X}, y, CASE WHEN k = 2 THEN 4 * y % 3 / 10 + (bout_id % 5 - 2) / 10.0::DOUBLE ELSE 0 END AS o, CASE WHEN k = 1 AND method <> 'DEC' THEN 0.0::DOUBLE ELSE 1 END AS w FROM t),
        {newton.sql_newton('n', 'u', len(FEATURES), '(CASE k WHEN 2 THEN 5.0::DOUBLE ELSE 2.0::DOUBLE END)', STEPS)}, l AS (SELECT k, {_LONG} FROM n)
        SELECT ['all', 'decisions', 'over the market'][k + 1] AS fit, feature, round(c, 5) AS coefficient FROM l""",
    "platt_fit": f"""{CLAIMS}, t AS (SELECT 0 AS k, 1.0::DOUBLE AS x1, ln(p / (1 - p)) AS x2, CAST(y AS DOUBLE) AS y, {_PLAIN} FROM claims WHERE bout_id % 2 = 0), {sql_newton('n', 't', (0.0, 1.0))},
        q AS (SELECT CAST(y AS DOUBLE) AS y, p AS p0, 1 / (1 + exp(-(a + b * ln(p / (1 - p))))) AS p, a, b FROM claims, n WHERE bout_id % 2 = 1)
        SELECT round(max(a), 6) AS intercept, round(max(b), 6) AS slope, round(avg({_LOSS('p0')}), 6) AS before, round(avg({_LOSS('p')}), 6) AS after FROM q""",
    "coefficient_bootstrap": f"""{_ONE}, {_sql_scaled('one')}, s AS MATERIALIZED (SELECT 0 AS k, {_X}, y, {_PLAIN} FROM z), {newton.sql_newton('whole', 's', len(FEATURES), '2.0::DOUBLE', STEPS)},
        d AS (SELECT bout_id, y, {_X}, unnest(range(1, {DRAWS + 1})) AS draw FROM z), t AS (SELECT draw AS k, {_X}, y, 0.0::DOUBLE AS o, CAST({_poisson(_U)} AS DOUBLE) AS w FROM d),
        {newton.sql_newton('n', 't', len(FEATURES), '2.0::DOUBLE', BOOTSTRAP_STEPS, start='whole')}, l AS (SELECT k, {_LONG} FROM n), f AS (SELECT feature, c AS fit FROM (SELECT {_LONG} FROM whole))
        SELECT l.feature, round(max(fit), 5) AS fit, round(avg(c), 5) AS mean, round(quantile_cont(c, 0.025), 5) AS low, round(quantile_cont(c, 0.975), 5) AS high, round(avg(CASE WHEN c * fit > 0 THEN 1.0::DOUBLE ELSE 0 END), 5) AS sign
        FROM l JOIN f ON l.feature = f.feature GROUP BY 1""",
    "walk_forward": f"""{_ONE}, c AS (SELECT {_CUTS} FROM one), folds AS MATERIALIZED ({_FOLDS}), train AS MATERIALIZED (SELECT * FROM folds WHERE day <= low), {newton.sql_newton('n', 'train', len(FEATURES), '2.0::DOUBLE', STEPS)},
        t AS (SELECT f.k, y, 1 / (1 + exp(-({_DOT('beta')}))) AS p FROM folds f JOIN n ON f.k = n.k WHERE day > low AND day <= high)
        SELECT k AS fold, count(*) AS n, round(avg({_LOSS('p')}), 6) AS log_loss, round(avg(pow(p - y, 2)), 6) AS brier FROM t GROUP BY 1""",
    "ablation_arms": f"""{_ONE}, c AS (SELECT CAST(floor(quantile_cont(day, 0.8)) AS BIGINT) AS cut FROM one), e AS (SELECT one.*, day <= cut AS early FROM one, c), early AS (SELECT * FROM e WHERE early),
        {_sql_scaled('e', 'early')}, t AS MATERIALIZED (SELECT unnest(range(1, {len(ARMS) + 1})) AS k, {_X}, y, {_PLAIN} FROM z WHERE early),
        {newton.sql_newton('n', 't', len(FEATURES), '2.0::DOUBLE', STEPS, {i + 1: a for i, a in enumerate(ARMS)})},
        p AS (SELECT bout_id, y, k, 1 / (1 + exp(-({_DOT('beta')}))) AS p FROM z, n WHERE NOT early), q AS (SELECT bout_id, y, k, p FROM p UNION ALL SELECT bout_id, y, 0, 0.5::DOUBLE FROM z WHERE NOT early),
        g AS (SELECT b.bout_id, b.k AS arm, ({_LOSS('a.p').replace('y =', 'a.y =')}) - ({_LOSS('b.p').replace('y =', 'a.y =')}) AS gain FROM q a JOIN q b ON a.bout_id = b.bout_id AND a.k + 1 = b.k),
        d AS (SELECT *, unnest(range(1, {DRAWS + 1})) AS draw FROM g), w AS (SELECT arm, draw, sum({_poisson(_U)} * gain) / sum({_poisson(_U)}) AS gain FROM d GROUP BY 1, 2),
        o AS (SELECT arm, avg(gain) AS gain, avg(CASE WHEN gain > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_better FROM w GROUP BY 1)
        SELECT CAST(arm AS INTEGER) AS arm, CAST({list(ARMS)}[arm] AS INTEGER) AS features, round(gain, 5) AS gain, round(p_better, 5) AS p_better, CAST(p_better >= 0.95 AS INTEGER) AS adopted FROM o""",
}
