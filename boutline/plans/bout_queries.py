"""Queries over bouts: cleaning, rates, cards, grading, survival; and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutline.operators import career, grading, rates, survival
from boutline.plans.career_queries import PANEL, STRENGTH, W, rounded, sql_rounded, strength
from boutline.sources import views
from boutline.sources.views import bouts, table, with_views

B = with_views("bouts")
APP = with_views("bouts", "app")
_CORE = ["bout_id", "r_id", "b_id", "winner", "method", "weight_class", "sched_sec", "total_sec", "r_ss_landed", "r_ss_att", "b_ss_landed", "b_ss_att", "r_kd", "b_kd"]


def app(spark: SparkSession, sf: str) -> DataFrame:
    return views.appearances(bouts(spark, sf))


def clean_bouts(spark: SparkSession, sf: str) -> DataFrame:
    return bouts(spark, sf).select(F.date_format("dt", "yyyy-MM-dd").alias("dt"), F.date_format("event", "yyyy-MM-dd").alias("event"), *_CORE)


def drop_ambiguous(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose name, brand and size are theirs alone and that an order line uses."""
    parts, key = table(spark, sf, "part"), ["p_name", "p_brand", "p_size"]
    twice = parts.groupBy(*key).count().where("count > 1")
    used = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return parts.join(twice, key, "left_anti").join(used, "p_partkey", "left_semi").select("p_partkey", "p_name", "p_brand")


def stat_totals(spark: SparkSession, sf: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("lines"), *[F.round(F.sum(c), 4).alias(c) for c in names])


def phase_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of the first line and of lines from the third on, in the pass that makes the totals."""
    n = F.col("l_linenumber")
    out = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.when(n == 1, F.col("l_quantity")).otherwise(0.0)).alias("r1_quantity"), F.sum(F.when(n >= 3, F.col("l_quantity")).otherwise(0.0)).alias("late_quantity"),
        F.max(n).cast("long").alias("n_rounds"),
    )
    return out.withColumn("deep_rounds", F.greatest(F.col("n_rounds") - 2, F.lit(0)))


def imputed_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Slope and intercept of price on quantity, the median, and means with missing prices imputed by the fit."""
    rows = table(spark, sf, "lineitem").select("l_quantity", F.when(F.col("l_partkey") % 10 > 0, F.col("l_extendedprice")).alias("price"))
    fit = rows.agg(F.regr_slope("price", "l_quantity").alias("slope"), F.regr_intercept("price", "l_quantity").alias("intercept"), F.expr("percentile(l_quantity, 0.5)").alias("median_quantity"))
    filled = rows.join(F.broadcast(fit)).withColumn("filled", F.coalesce("price", F.col("intercept") + F.col("slope") * F.col("l_quantity")))
    out = filled.groupBy("slope", "intercept", "median_quantity").agg(F.avg("filled").alias("mean_filled"), F.count_if(F.col("price").isNull()).alias("imputed"))
    return out.select("imputed", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "median_quantity", "mean_filled")])


def cond_rates_quartile(spark: SparkSession, sf: str) -> DataFrame:
    rows = career.panel(strength(spark, sf)).select("own_finish_rate", (F.col("method") != "DEC").cast("double").alias("y"))
    out = rates.quartile_rates(rows, "own_finish_rate", "y")
    return rounded(out, ["bucket", "n", "thin"], ["rate", "lift", "half_width"])


def decision_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.decision_curve(app(spark, sf)), ["bucket", "n"], ["rate", "r"])


def style_imposition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.style_imposition(app(spark, sf)), ["predictor", "bucket", "n"], ["rate"])


def style_spreads(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.style_spreads(app(spark, sf)), ["predictor", "n"], ["r", "spread"])


def style_who(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.style_who(app(spark, sf)), ["finishes", "wide_n"], ["to_finisher", "wins_overall", "wide_to_finisher"])


def r1_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.r1_curve(app(spark, sf)), ["bucket", "n"], ["rate"])


def r1_read(spark: SparkSession, sf: str) -> DataFrame:
    """The curve of round one by promoter, whose shares of finishes differ, with the scale for five rounds; least sizes are those of the small tables."""
    return rounded(rates.r1_read(bouts(spark, sf).withColumnRenamed("cust", "entity"), 100, 30), ["bucket", "n"], ["rate", "five_round_scale"])


def division_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.division_rates(bouts(spark, sf)), ["weight_class", "sched_sec", "n"], ["finish", "ko", "sub", "median_sec"])


def market_bases(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.market_bases(bouts(spark, sf)), ["market"], ["rate"])


_SHAPE = ["mean_finishes", "p10", "p50", "p90", "overdispersion"]


def card_shape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.card_shape(rates.cards(bouts(spark, sf))), ["cards"], _SHAPE)


def card_size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rates.card_size_buckets(rates.cards(bouts(spark, sf))), ["bucket", "cards"], ["finish_share", "r1"])


def prop_targets(spark: SparkSession, sf: str) -> DataFrame:
    flag = lambda c: c.cast("int")
    m = F.col("method")
    return bouts(spark, sf).select(
        "bout_id", flag(m == "KO/TKO").alias("y_ko"), flag(m == "SUB").alias("y_sub"), flag(m == "DEC").alias("y_dec"),
        flag(F.col("total_sec") > 750).alias("y_over_2_5"), flag(F.col("total_sec") > 450).alias("y_over_1_5"),
    )


def grade_claims(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grading.graded(grading.win_claims(app(spark, sf))), ["bout_id", "y", "right"], ["p", "brier", "base"])


def calibration_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grading.bands(grading.win_claims(app(spark, sf)), grading.CLAIM_BANDS, 5), ["band", "n"], ["said", "happened"])


_SCORES = ["accuracy", "brier", "log_loss", "base", "base_brier", "skill"]


def scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(grading.scores(grading.win_claims(app(spark, sf))), ["n"], _SCORES)


def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    claims = grading.win_claims(app(spark, sf))
    return rounded(grading.scores(claims).join(F.broadcast(grading.auc(claims))), ["n"], ["accuracy", "brier", "log_loss", "auc"])


def win_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """A coin, the better record, and its clipped probability."""
    claims = grading.win_claims(app(spark, sf))
    coin = claims.select(F.lit("coin").alias("model"), F.lit(0.5).alias("p"), "y")
    record = claims.select(F.lit("record").alias("model"), F.col("p"), "y")
    out = coin.unionByName(record).groupBy("model").agg(
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), (-F.avg(F.ln(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))).alias("log_loss")
    )
    return rounded(out, ["model"], ["brier", "log_loss"])


def card_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Of the three claims per card that are surest, how many came true; the denominator is what was possible."""
    picks = grading.top_k(grading.win_claims(app(spark, sf)), 3)
    return rounded(picks.groupBy("event").agg(F.sum("y").alias("hits"), F.count("*").alias("picks"), F.avg("p").alias("said")).select(F.date_format("event", "yyyy-MM-dd").alias("event"), "hits", "picks", "said"), ["event", "hits", "picks"], ["said"])


def topk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Per card, the overlap of the two surest picks with the two longest bouts."""
    rows = bouts(spark, sf).select("event", "bout_id", F.col("r_ss_landed").alias("p"), "total_sec")
    w = Window.partitionBy("event").orderBy(F.col("total_sec").desc(), "bout_id")
    picks = grading.top_k(rows, 2).groupBy("event").agg(F.collect_set("bout_id").alias("picks"))
    actual = rows.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("event").agg(F.collect_set("bout_id").alias("actual"))
    return picks.join(actual, "event").select(F.date_format("event", "yyyy-MM-dd").alias("event"), F.size(F.array_intersect("picks", "actual")).alias("overlap"))


def career_split(spark: SparkSession, sf: str) -> DataFrame:
    """Per entity before the last month of the corpus: mean length and how bouts were won and lost."""
    rows = app(spark, sf)
    cut = F.broadcast(rows.agg(F.add_months(F.max("dt"), -1).alias("cut")))
    won, lost = F.col("result") == "W", F.col("result") == "L"
    ways = {"KO/TKO": "ko", "SUB": "sub", "DEC": "dec"}
    counts = [F.count_if(c & (F.col("method") == m)).alias(f"{n}_{k}") for n, c in (("won", won), ("lost", lost)) for m, k in ways.items()]
    return rows.join(cut).where("dt < cut").groupBy("entity").agg(F.round(F.avg("total_sec"), 4).alias("mean_sec"), *counts)


def card_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last eight cards: claims, hits and Brier, newest first."""
    g = grading.graded(grading.win_claims(app(spark, sf)))
    out = g.groupBy("event").agg(F.count("*").alias("claims"), F.sum("right").alias("hits"), F.round(F.avg("brier"), 6).alias("brier")).orderBy(F.col("event").desc()).limit(8)
    return out.select(F.date_format("event", "yyyy-MM-dd").alias("event"), "claims", "hits", "brier")


def survival_intervals(spark: SparkSession, sf: str) -> DataFrame:
    out = survival.intervals(bouts(spark, sf))
    return out.groupBy("minute", "orient", "round", "class").agg(F.count("*").alias("n"))


_ROLLED = ["a_ko", "b_ko", "a_sub", "b_sub", "dec", "exp_minutes", "total"]


def survival_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(survival.roll_up(survival.with_hazards(bouts(spark, sf))), ["bout_id"], _ROLLED)


_JOINT = ["a_ko", "b_ko", "a_sub", "b_sub", "dec", "a_wins", "a_ko_given_finish"]


def joint_rescale(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(survival.rescaled(survival.roll_up(survival.with_hazards(bouts(spark, sf))), 0.55), ["bout_id"], _JOINT)


def era_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts of the later era whose sides both have two bouts before; history counts from the beginning."""
    rows = career.win_rows(strength(spark, sf)).where("orient = 0 and gate >= 2 and dt >= date'1996-01-01'")
    return rows.select("bout_id", F.date_format("dt", "yyyy-MM-dd").alias("dt"), F.col("gate").cast("long").alias("gate"), "y")


def join_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts with totals of their orders, their place on the card and the ids of both corners as one set."""
    totals = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("bout_id")).agg(F.round(F.sum("l_quantity"), 4).alias("quantity"))
    placed = rates.with_card_position(bouts(spark, sf))
    return placed.join(totals, "bout_id", "left").select("bout_id", "place", "card_size", "quantity", F.least("r_id", "b_id").alias("low_id"), F.greatest("r_id", "b_id").alias("high_id"))


def tolerance_count(spark: SparkSession, sf: str) -> DataFrame:
    """Customers at least two of whose bouts another bout of theirs follows within two days."""
    w = Window.partitionBy("cust").orderBy("dt", "bout_id")
    rows = bouts(spark, sf).select("cust", F.datediff("dt", F.lag("dt").over(w)).alias("since"), F.datediff(F.lead("dt").over(w), "dt").alias("until"))
    return rows.where("since <= 2 or until <= 2").groupBy("cust").agg(F.count("*").alias("hits")).where("hits >= 2")


def partner_completion(spark: SparkSession, sf: str) -> DataFrame:
    """An award names one side; the other side is completed if that side fought once on the card."""
    rows = app(spark, sf).select("event", "entity", "opponent", "bout_id")
    single = rows.groupBy("event", "entity").agg(F.count("*").alias("n"), F.max("opponent").alias("partner"), F.max("bout_id").alias("bout_id")).where("n = 1")
    awards = bouts(spark, sf).where("total_sec < 120 and method <> 'DEC'").select("event", F.col("r_id").alias("entity"))
    return awards.distinct().join(single, ["event", "entity"], "left").select(F.date_format("event", "yyyy-MM-dd").alias("event"), "entity", "partner", "bout_id")


def group_rates_having(spark: SparkSession, sf: str) -> DataFrame:
    """Entities with eight bouts: finish rate, share of all bouts and first date."""
    out = app(spark, sf).groupBy("entity").agg(F.count("*").alias("n"), F.avg((F.col("method") != "DEC").cast("double")).alias("finish"), F.min("dt").alias("debut")).where("n >= 8")
    total = F.broadcast(out.agg(F.sum("n").alias("total")))
    return out.join(total).select("entity", "n", F.date_format("debut", "yyyy-MM-dd").alias("debut"), F.round("finish", 6).alias("finish"), F.round(F.col("n") / F.col("total"), 9).alias("share"))


def thin_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Promoters, of whom most have few bouts, with at most two before one of the last twelve months, each by its first such bout."""
    rows = bouts(spark, sf).select(F.col("cust").alias("entity"), "bout_id", "dt").withColumn("prior", F.count("*").over(career.before("entity")))
    cut = F.broadcast(rows.agg(F.add_months(F.max("dt"), -12).alias("cut")))
    out = rows.join(cut).where("dt >= cut and prior <= 2")
    return out.groupBy("entity").agg(F.min_by(F.struct("bout_id", "prior"), F.struct("dt", "bout_id")).alias("m")).select("entity", "m.bout_id", "m.prior")


# A frozen rule of eight features: mean, scale and coefficient.
RULE = {
    "d_win_pct": (0.0, 0.08, 0.31), "d_finish_rate": (0.0, 0.07, 0.12), "d_adj_slpm": (0.0, 1.1, 0.18), "d_str_def": (0.0, 0.05, 0.09),
    "d_td_def": (0.0, 0.06, 0.07), "d_kd15": (0.0, 0.2, 0.11), "d_ko_loss_rate": (0.0, 0.06, -0.13), "d_ctrl_share": (0.0, 0.05, 0.05),
}
DRIVERS = 6


def drivers_topn(spark: SparkSession, sf: str) -> DataFrame:
    """Score of a frozen rule, its six largest contributions above 0.01 per bout, and which side each favours."""
    rows = career.win_rows(strength(spark, sf)).where("orient = 0 and gate >= 2")
    parts = F.array(*[F.struct((-F.abs((F.col(k) - m) / s * c)).alias("size"), F.lit(k).alias("name"), ((F.col(k) - m) / s * c).alias("value")) for k, (m, s, c) in RULE.items()])
    rows = rows.select("bout_id", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["value"]).alias("score"), F.slice(F.array_sort(F.filter(parts, lambda x: x["size"] < -0.01)), 1, DRIVERS).alias("top"))
    return rows.select("bout_id", F.round(1 / (1 + F.exp(-F.col("score"))), 6).alias("p"), F.size("top").alias("n_top"), F.get("top", 0)["name"].alias("first_driver"),
        F.array_join(F.transform("top", lambda x: F.concat(x["name"], F.when(x["value"] > 0, "+").otherwise("-"))), " ").alias("drivers"))


def last_real_division(spark: SparkSession, sf: str) -> DataFrame:
    """The division of an entity's most recent bout that is not of the catch-all one."""
    out = app(spark, sf).where("weight_class not like '4%'").groupBy("entity").agg(F.max_by("weight_class", F.struct("dt", "bout_id")).alias("division"))
    order = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")])
    return out.select("entity", "division", F.array_position(order, F.col("division")).alias("place"))


def round_index(spark: SparkSession, sf: str) -> DataFrame:
    """The three definitions of the round a bout ends in."""
    sec = F.col("total_sec")
    return bouts(spark, sf).select("bout_id", grading.round_of_seconds(sec).alias("by_floor"), grading.round_by_ceiling(sec).alias("by_ceiling"), grading.round_of_minute(sec).alias("by_minute"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_bouts, drop_ambiguous, stat_totals, phase_sums, imputed_fit, cond_rates_quartile, decision_curve, style_imposition, style_spreads, style_who, r1_curve, r1_read, division_rates, market_bases,
        card_shape, card_size_buckets, prop_targets, grade_claims, calibration_bands, scorecard, eval_metrics, win_baselines, card_topk, topk_overlap, career_split,
        card_history, survival_intervals, survival_rollup, joint_rescale, era_gate, join_shapes, tolerance_count, partner_completion, group_rates_having, thin_entities,
        drivers_topn, last_real_division, round_index,
    )
}

CLAIMS = f"""{APP}, rate AS (SELECT bout_id, side, result, method, dt, event, (coalesce(sum(CASE WHEN result = 'W' THEN 1.0::DOUBLE ELSE 0 END) {W}, 0) + 2) / (count(*) {W} + 4) AS rate FROM app),
    claims AS (SELECT r.bout_id, r.dt, r.event, r.method, greatest(0.02::DOUBLE, least(0.98::DOUBLE, 0.5::DOUBLE + r.rate - b.rate)) AS p, CAST(r.result = 'W' AS INTEGER) AS y
    FROM rate r JOIN rate b ON r.bout_id = b.bout_id AND r.side = 'r' AND b.side = 'b' WHERE r.result <> 'D')"""
_CLASSES = " ".join(f"WHEN v >= {a} AND v < {b} THEN {i}" for i, (a, b) in enumerate(zip(rates.EDGES, rates.EDGES[1:]), 1))
_DEC = f"""{APP}, won AS (SELECT *, sum(CASE WHEN result = 'W' THEN 1.0::DOUBLE ELSE 0 END) {W} AS wins, sum(CASE WHEN result = 'W' AND method = 'DEC' THEN 1.0::DOUBLE ELSE 0 END) {W} AS decs FROM app),
    shares AS (SELECT bout_id, CASE WHEN max(method) = 'DEC' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS finish, avg(decs / wins) AS mean, min(decs / wins) AS low, max(decs / wins) AS high, min(wins) AS least
    FROM won WHERE wins >= 2 GROUP BY bout_id HAVING count(*) = 2)"""
_CARDS = f"""{B}, cards AS (SELECT event, count(*) AS size, sum(CASE WHEN method <> 'DEC' THEN 1 ELSE 0 END) AS finishes,
    least(sum(CASE WHEN method <> 'DEC' AND total_sec < 300 THEN 1 ELSE 0 END), 8) AS r1 FROM bouts GROUP BY event HAVING count(*) >= 6)"""
_HAZ = f"""{B}, h AS (SELECT bout_id, m AS minute, (0.010::DOUBLE + 0.005::DOUBLE * r_kd) * (1 + m / 50.0::DOUBLE) AS h1, (0.010::DOUBLE + 0.005::DOUBLE * b_kd) * (1 + m / 50.0::DOUBLE) AS h2,
    0.006::DOUBLE * (1 + m / 50.0::DOUBLE) AS h3, 0.005::DOUBLE * (1 + m / 50.0::DOUBLE) AS h4 FROM (SELECT *, unnest(range(1, CAST(sched_sec // 60 + 1 AS BIGINT))) AS m FROM bouts)),
    a AS (SELECT *, 1 - h1 - h2 - h3 - h4 AS stay, coalesce(exp(sum(ln(1 - (h1 + h2 + h3 + h4))) OVER (PARTITION BY bout_id ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0::DOUBLE) AS alive FROM h),
    rolled AS (SELECT bout_id, sum(alive * h1) AS a_ko, sum(alive * h2) AS b_ko, sum(alive * h3) AS a_sub, sum(alive * h4) AS b_sub, min(alive * stay) AS dec, sum(alive) AS exp_minutes FROM a GROUP BY bout_id)"""
_ONE = f"""{STRENGTH}, one AS (SELECT r.bout_id, r.dt, least(r.n_prior, b.n_prior) AS gate, CASE r.result WHEN 'W' THEN 1 ELSE 0 END AS y,
    {', '.join(f'r.{k[2:]} - b.{k[2:]} AS {k}' for k in RULE)} FROM strength r JOIN strength b ON r.bout_id = b.bout_id AND r.side = 'r' AND b.side = 'b' WHERE r.result <> 'D')"""
_DRIVES = " UNION ALL ".join(f"SELECT bout_id, '{k}' AS name, ({k} - {m}) / {s} * {c} AS v FROM one WHERE gate >= 2" for k, (m, s, c) in RULE.items())
_MIN = "least(greatest(CAST(ceil(total_sec / 60.0) AS BIGINT), 1), 25)"

ORACLES = {
    "clean_bouts": f"{B} SELECT CAST(dt AS VARCHAR) AS dt, CAST(event AS VARCHAR) AS event, {', '.join(_CORE)} FROM bouts",
    "drop_ambiguous": """SELECT p_partkey, p_name, p_brand FROM part p WHERE (SELECT count(*) FROM part q WHERE q.p_name = p.p_name AND q.p_brand = p.p_brand AND q.p_size = p.p_size) = 1
        AND p_partkey IN (SELECT l_partkey FROM lineitem)""",
    "stat_totals": f"SELECT l_orderkey, l_suppkey, count(*) AS lines, {', '.join(f'round(sum({c}), 4) AS {c}' for c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))} FROM lineitem GROUP BY 1, 2",
    "phase_sums": """SELECT l_orderkey, sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS r1_quantity, sum(CASE WHEN l_linenumber >= 3 THEN l_quantity ELSE 0 END) AS late_quantity,
        CAST(max(l_linenumber) AS BIGINT) AS n_rounds, CAST(greatest(max(l_linenumber) - 2, 0) AS BIGINT) AS deep_rounds FROM lineitem GROUP BY 1""",
    "imputed_fit": """WITH r AS (SELECT l_quantity AS q, CASE WHEN l_partkey % 10 > 0 THEN l_extendedprice END AS p FROM lineitem),
        f AS (SELECT regr_slope(p, q) AS slope, regr_intercept(p, q) AS intercept, quantile_cont(q, 0.5) AS median_quantity FROM r)
        SELECT count(*) FILTER (WHERE p IS NULL) AS imputed, round(max(slope), 4) AS slope, round(max(intercept), 4) AS intercept, round(max(median_quantity), 4) AS median_quantity,
               round(avg(coalesce(p, intercept + slope * q)), 4) AS mean_filled FROM r, f""",
    "cond_rates_quartile": f"""{PANEL}, v AS (SELECT own_finish_rate AS x, CASE WHEN method <> 'DEC' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM panel),
        e AS (SELECT quantile_cont(x, 0.25) AS e1, quantile_cont(x, 0.5) AS e2, quantile_cont(x, 0.75) AS e3, avg(y) AS base FROM v),
        t AS (SELECT CASE WHEN x <= e1 THEN 1 WHEN x <= e2 THEN 2 WHEN x <= e3 THEN 3 ELSE 4 END AS bucket, count(*) AS n, avg(y) AS rate, max(base) AS base FROM v, e GROUP BY 1)
        SELECT bucket, n, CAST(n < 200 AS INTEGER) AS thin, round(rate, 6) AS rate, round(rate - base, 6) AS lift, round(1.96::DOUBLE * sqrt(rate * (1 - rate) / n), 6) AS half_width FROM t""",
    "decision_curve": f"""{_DEC}, c AS (SELECT CASE {_CLASSES} END AS bucket, finish FROM (SELECT mean AS v, finish FROM shares))
        SELECT bucket, count(*) AS n, round(avg(finish), 6) AS rate, round((SELECT corr(mean, finish) FROM shares), 6) AS r FROM c WHERE bucket IS NOT NULL GROUP BY 1 HAVING count(*) >= 150""",
    "style_imposition": f"""{_DEC}, l AS (SELECT finish, 'mean' AS predictor, mean AS v, low, high, least FROM shares UNION ALL SELECT finish, 'low', low, low, high, least FROM shares UNION ALL SELECT finish, 'high', high, low, high, least FROM shares)
        SELECT predictor, CASE {_CLASSES} END AS bucket, count(*) AS n, round(avg(finish), 6) AS rate FROM l WHERE least >= 3 AND low <> high GROUP BY 1, 2 HAVING count(*) >= 60""",
    "style_spreads": f"""{_DEC}, l AS (SELECT finish, 'mean' AS predictor, mean AS v, low, high, least FROM shares UNION ALL SELECT finish, 'low', low, low, high, least FROM shares UNION ALL SELECT finish, 'high', high, low, high, least FROM shares),
        k AS (SELECT * FROM l WHERE least >= 3 AND low <> high), o AS (SELECT predictor, count(*) AS n, corr(v, finish) AS r FROM k GROUP BY 1),
        b AS (SELECT predictor, CASE {_CLASSES} END AS bucket, avg(finish) AS rate FROM k GROUP BY 1, 2 HAVING count(*) >= 60), s AS (SELECT predictor, count(*) AS shown, arg_min(rate, bucket) - arg_max(rate, bucket) AS spread FROM b GROUP BY 1)
        SELECT o.predictor, n, round(r, 6) AS r, round(CASE WHEN shown >= 3 THEN spread END, 6) AS spread FROM o LEFT JOIN s ON o.predictor = s.predictor""",
    "style_who": f"""{_DEC}, w AS (SELECT bout_id, arg_max(result, decs / wins) AS of_high FROM won WHERE wins >= 2 GROUP BY 1), k AS (SELECT finish, high - low AS gap, CASE of_high WHEN 'L' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ours
            FROM shares JOIN w USING (bout_id) WHERE least >= 3 AND low <> high AND of_high IN ('W', 'L'))
        SELECT count(*) FILTER (WHERE finish = 1) AS finishes, round(avg(CASE WHEN finish = 1 THEN ours END), 6) AS to_finisher, round(avg(ours), 6) AS wins_overall, count(*) FILTER (WHERE gap >= 0.2::DOUBLE) AS wide_n,
        round(CASE WHEN count(*) FILTER (WHERE gap >= 0.2::DOUBLE AND finish = 1) >= 60 THEN avg(CASE WHEN gap >= 0.2::DOUBLE AND finish = 1 THEN ours END) END, 6) AS wide_to_finisher FROM k""",
    "r1_curve": f"""{APP}, e AS (SELECT entity, avg(CASE WHEN method <> 'DEC' THEN 1.0::DOUBLE ELSE 0 END) AS v FROM app GROUP BY 1 HAVING count(*) >= 8),
        c AS (SELECT {'CASE ' + ' '.join(f'WHEN v >= {a} AND v < {b} THEN {i}' for i, (a, b) in enumerate(zip(rates.ROUND_ONE_EDGES, rates.ROUND_ONE_EDGES[1:]), 1)) + ' END'} AS bucket,
              CASE WHEN total_sec < 300 THEN 1.0::DOUBLE ELSE 0 END AS f FROM app JOIN e ON app.entity = e.entity WHERE method <> 'DEC')
        SELECT bucket, count(*) AS n, round(avg(f), 6) AS rate FROM c WHERE bucket IS NOT NULL GROUP BY 1 HAVING count(*) >= 60""",
    "r1_read": f"""{B}, app AS (SELECT cust AS entity, method, total_sec, sched_sec FROM bouts), e AS (SELECT entity, avg(CASE WHEN method <> 'DEC' THEN 1.0::DOUBLE ELSE 0 END) AS v FROM app GROUP BY 1 HAVING count(*) >= 8),
        c AS (SELECT {'CASE ' + ' '.join(f'WHEN v >= {a} AND v < {b} THEN {i}' for i, (a, b) in enumerate(zip(rates.ROUND_ONE_EDGES, rates.ROUND_ONE_EDGES[1:]), 1)) + ' END'} AS bucket,
              CASE WHEN total_sec < 300 THEN 1.0::DOUBLE ELSE 0 END AS y, sched_sec >= 1500 AS five FROM app JOIN e ON app.entity = e.entity WHERE method <> 'DEC'),
        s AS (SELECT avg(CASE WHEN five THEN y END) / avg(CASE WHEN NOT five THEN y END) AS five_round_scale, count(*) FILTER (WHERE NOT five) AS n3, count(*) FILTER (WHERE five) AS n5 FROM c),
        t AS (SELECT bucket, count(*) AS n, avg(y) AS rate FROM c WHERE NOT five AND bucket IS NOT NULL GROUP BY 1 HAVING count(*) >= 60)
        SELECT bucket, n, round(rate, 6) AS rate, round(CASE WHEN n5 >= 30 THEN five_round_scale ELSE 0.727::DOUBLE END, 6) AS five_round_scale FROM t, s
        WHERE n3 >= 100 AND (SELECT count(*) FROM t) >= 3 AND (SELECT count(*) FROM t WHERE rate NOT BETWEEN 0.15 AND 0.85) = 0""",
    "division_rates": f"""{B} SELECT weight_class, sched_sec, count(*) AS n, round(avg(CASE WHEN method <> 'DEC' THEN 1.0::DOUBLE ELSE 0 END), 6) AS finish, round(avg(CASE WHEN method = 'KO/TKO' THEN 1.0::DOUBLE ELSE 0 END), 6) AS ko,
        round(avg(CASE WHEN method = 'SUB' THEN 1.0::DOUBLE ELSE 0 END), 6) AS sub, round(CAST(quantile_cont(total_sec, 0.5) AS DOUBLE), 6) AS median_sec FROM bouts GROUP BY 1, 2 HAVING count(*) >= 50""",
    "market_bases": f"{B}, m AS (" + " UNION ALL ".join(
        f"SELECT '{k}' AS market, avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM bouts" for k, c in {
            "itd": "method <> 'DEC'", "dec": "method = 'DEC'", "over_1_5": "total_sec > 450", "over_2_5": "total_sec > 750",
            **{f"by_round_{k}": f"method <> 'DEC' AND total_sec <= {300 * k}" for k in (1, 2, 3)}}.items()
    ) + " UNION ALL " + " UNION ALL ".join(
        f"SELECT '{k}', (avg(CASE WHEN r_{c} >= 1 THEN 1.0::DOUBLE ELSE 0 END) + avg(CASE WHEN b_{c} >= 1 THEN 1.0::DOUBLE ELSE 0 END)) / 2 FROM bouts" for k, c in (("td", "td_landed"), ("kd", "kd"))
    ) + ") SELECT market, round(rate, 6) AS rate FROM m",
    "card_shape": f"""{_CARDS}, p AS (SELECT sum(finishes) / CAST(sum(size) AS DOUBLE) AS p FROM cards) SELECT count(*) AS cards, round(avg(finishes), 6) AS mean_finishes, round(quantile_cont(finishes::DOUBLE, 0.1), 6) AS p10,
        round(quantile_cont(finishes::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(finishes::DOUBLE, 0.9), 6) AS p90, round(var_samp(finishes) / avg(size * p * (1 - p)), 6) AS overdispersion FROM cards, p""",
    "card_size_buckets": f"""{_CARDS} SELECT CASE WHEN size <= 9 THEN '6-9' WHEN size <= 11 THEN '10-11' WHEN size <= 12 THEN '12' ELSE '13+' END AS bucket, count(*) AS cards,
        round(avg(finishes / CAST(size AS DOUBLE)), 6) AS finish_share, round(avg(r1), 6) AS r1 FROM cards GROUP BY 1""",
    "prop_targets": f"""{B} SELECT bout_id, CAST(method = 'KO/TKO' AS INTEGER) AS y_ko, CAST(method = 'SUB' AS INTEGER) AS y_sub, CAST(method = 'DEC' AS INTEGER) AS y_dec,
        CAST(total_sec > 750 AS INTEGER) AS y_over_2_5, CAST(total_sec > 450 AS INTEGER) AS y_over_1_5 FROM bouts""",
    "grade_claims": f"{CLAIMS} SELECT bout_id, y, CAST((p >= 0.5) = (y = 1) AS INTEGER) AS right, round(p, 6) AS p, round(pow(p - y, 2), 6) AS brier, 0.25::DOUBLE AS base FROM claims",
    "calibration_bands": f"""{CLAIMS} SELECT CASE WHEN p < 0.2 THEN 1 WHEN p < 0.4 THEN 2 WHEN p < 0.6 THEN 3 WHEN p < 0.8 THEN 4 ELSE 5 END AS band, count(*) AS n, round(avg(p), 6) AS said,
        round(avg(CAST(y AS DOUBLE)), 6) AS happened FROM claims GROUP BY 1 HAVING count(*) >= 5""",
    "scorecard": f"""{CLAIMS}, s AS (SELECT count(*) AS n, avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS accuracy, avg(pow(p - y, 2)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss, avg(CAST(y AS DOUBLE)) AS base FROM claims),
        t AS (SELECT *, base * (1 - base) AS base_brier, 1 - brier / (base * (1 - base)) AS skill FROM s) SELECT n, {sql_rounded(_SCORES)} FROM t""",
    "eval_metrics": f"""{CLAIMS}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM claims),
        u AS (SELECT (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS auc FROM k)
        SELECT count(*) AS n, round(avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)), 6) AS accuracy, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS log_loss,
               round((SELECT auc FROM u), 6) AS auc FROM claims""",
    "win_baselines": f"""{CLAIMS} SELECT 'record' AS model, round(avg(pow(p - y, 2)), 6) AS brier, round(-avg(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss FROM claims
        UNION ALL SELECT 'coin', 0.25::DOUBLE, round(-ln(0.5::DOUBLE), 6)""",
    "card_topk": f"""{CLAIMS}, k AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY p DESC, bout_id) AS k FROM claims)
        SELECT CAST(event AS VARCHAR) AS event, sum(y) AS hits, count(*) AS picks, round(avg(p), 6) AS said FROM k WHERE k <= 3 GROUP BY 1""",
    "topk_overlap": f"""{B}, k AS (SELECT event, row_number() OVER (PARTITION BY event ORDER BY r_ss_landed DESC, bout_id) AS a, row_number() OVER (PARTITION BY event ORDER BY total_sec DESC, bout_id) AS b FROM bouts)
        SELECT CAST(event AS VARCHAR) AS event, count(*) FILTER (WHERE a <= 2 AND b <= 2) AS overlap FROM k GROUP BY 1""",
    "career_split": f"""{APP}, c AS (SELECT max(dt) - INTERVAL 1 MONTH AS cut FROM app) SELECT entity, round(avg(total_sec), 4) AS mean_sec,
        {', '.join(f"count(*) FILTER (WHERE result = '{r}' AND method = '{m}') AS {n}_{k}" for n, r in (('won', 'W'), ('lost', 'L')) for m, k in (('KO/TKO', 'ko'), ('SUB', 'sub'), ('DEC', 'dec')))}
        FROM app, c WHERE dt < cut GROUP BY entity""",
    "card_history": f"""{CLAIMS} SELECT CAST(event AS VARCHAR) AS event, count(*) AS claims, sum(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS hits, round(avg(pow(p - y, 2)), 6) AS brier FROM claims GROUP BY event ORDER BY event DESC LIMIT 8""",
    "survival_intervals": f"""{B}, e AS (SELECT *, {_MIN} AS last, CASE WHEN method = 'DEC' OR winner = 'draw' THEN 0 ELSE CASE winner WHEN 'r' THEN 1 ELSE 2 END + CASE method WHEN 'SUB' THEN 2 ELSE 0 END END AS ends FROM bouts),
        m AS (SELECT *, unnest(range(1, last + 1)) AS minute FROM e), o AS (SELECT *, 0 AS orient FROM m UNION ALL SELECT *, 1 FROM m),
        c AS (SELECT minute, orient, least((minute - 1) // 5 + 1, 5) AS round, CASE WHEN minute < last OR ends = 0 THEN 0 WHEN orient = 0 THEN ends WHEN ends % 2 = 1 THEN ends + 1 ELSE ends - 1 END AS class FROM o)
        SELECT minute, orient, round, class, count(*) AS n FROM c GROUP BY 1, 2, 3, 4""",
    "survival_rollup": f"{_HAZ}, t AS (SELECT *, a_ko + b_ko + a_sub + b_sub + dec AS total FROM rolled) SELECT bout_id, {sql_rounded(_ROLLED)} FROM t",
    "joint_rescale": f"""{_HAZ}, k AS (SELECT *, least(0.55::DOUBLE / (SELECT avg(1 - dec) FROM rolled), 1 / (1 - dec)) AS k FROM rolled),
        j AS (SELECT bout_id, a_ko * k AS a_ko, b_ko * k AS b_ko, a_sub * k AS a_sub, b_sub * k AS b_sub, 1 - k * (a_ko + b_ko + a_sub + b_sub) AS dec FROM k),
        w AS (SELECT *, a_ko + a_sub + dec / 2 AS a_wins, a_ko / (a_ko + a_sub) AS a_ko_given_finish FROM j) SELECT bout_id, {sql_rounded(_JOINT)} FROM w""",
    "era_gate": f"{_ONE} SELECT bout_id, CAST(dt AS VARCHAR) AS dt, CAST(gate AS BIGINT) AS gate, y FROM one WHERE gate >= 2 AND dt >= DATE '1996-01-01'",
    "join_shapes": f"""{B}, t AS (SELECT l_orderkey, round(sum(l_quantity), 4) AS quantity FROM lineitem GROUP BY 1)
        SELECT bout_id, row_number() OVER (PARTITION BY event ORDER BY dt, bout_id) - 1 AS place, count(*) OVER (PARTITION BY event) AS card_size, quantity,
               least(r_id, b_id) AS low_id, greatest(r_id, b_id) AS high_id FROM bouts LEFT JOIN t ON bout_id = l_orderkey""",
    "tolerance_count": f"""{B} SELECT x.cust, count(DISTINCT x.bout_id) AS hits FROM bouts x JOIN bouts y ON x.cust = y.cust AND x.bout_id <> y.bout_id AND abs(date_diff('day', x.dt, y.dt)) <= 2
        GROUP BY 1 HAVING count(DISTINCT x.bout_id) >= 2""",
    "partner_completion": f"""{APP}, s AS (SELECT event, entity, max(opponent) AS partner, max(bout_id) AS bout_id FROM app GROUP BY 1, 2 HAVING count(*) = 1),
        a AS (SELECT DISTINCT event, r_id AS entity FROM bouts WHERE total_sec < 120 AND method <> 'DEC')
        SELECT CAST(a.event AS VARCHAR) AS event, a.entity, partner, bout_id FROM a LEFT JOIN s ON a.event = s.event AND a.entity = s.entity""",
    "group_rates_having": f"""{APP}, g AS (SELECT entity, count(*) AS n, avg(CASE WHEN method <> 'DEC' THEN 1.0::DOUBLE ELSE 0 END) AS finish, min(dt) AS debut FROM app GROUP BY 1 HAVING count(*) >= 8)
        SELECT entity, n, CAST(debut AS VARCHAR) AS debut, round(finish, 6) AS finish, round(n / CAST((SELECT sum(n) FROM g) AS DOUBLE), 9) AS share FROM g""",
    "thin_entities": f"""{B}, app AS (SELECT cust AS entity, bout_id, dt FROM bouts), p AS (SELECT *, count(*) {W} AS prior FROM app), k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY dt, bout_id) AS k FROM p
        WHERE dt >= (SELECT max(dt) FROM app) - INTERVAL 12 MONTH AND prior <= 2) SELECT entity, bout_id, prior FROM k WHERE k = 1""",
    "drivers_topn": f"""{_ONE}, d AS ({_DRIVES}), k AS (SELECT *, row_number() OVER (PARTITION BY bout_id ORDER BY -abs(v), name) AS k FROM d)
        SELECT bout_id, round(1 / (1 + exp(-sum(v))), 6) AS p, CAST(count(*) FILTER (WHERE k <= 6 AND abs(v) > 0.01) AS INTEGER) AS n_top, max(CASE WHEN k = 1 AND abs(v) > 0.01 THEN name END) AS first_driver,
        coalesce(string_agg(name || CASE WHEN v > 0 THEN '+' ELSE '-' END, ' ' ORDER BY k) FILTER (WHERE k <= 6 AND abs(v) > 0.01), '') AS drivers FROM k GROUP BY 1""",
    "last_real_division": f"""{APP}, k AS (SELECT entity, weight_class AS division, row_number() OVER (PARTITION BY entity ORDER BY dt DESC, bout_id DESC) AS k FROM app WHERE weight_class NOT LIKE '4%')
        SELECT entity, division, CASE division WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 ELSE 0 END AS place FROM k WHERE k = 1""",
    "round_index": f"""{B} SELECT bout_id, CAST(least(total_sec // 300 + 1, 5) AS BIGINT) AS by_floor, CAST(greatest(1, least(ceil(total_sec / 300.0), 5)) AS BIGINT) AS by_ceiling,
        CAST(least((greatest(CAST(ceil(total_sec / 60.0) AS BIGINT), 1) - 1) // 5 + 1, 5) AS BIGINT) AS by_minute FROM bouts""",
}
