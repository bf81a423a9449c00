"""Queries over the claims that bouts make and how they came out, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators import career, claims, grading, rates, survival
from boutline.plans.bout_queries import _HAZ, CLAIMS, RULE, B, app
from boutline.plans.career_queries import STRENGTH, exact, rounded, strength
from boutline.sources import files
from boutline.sources.scratch import scratch_folder
from boutline.sources.views import bouts, table


def _joint(spark: SparkSession, sf: str) -> DataFrame:
    rows = bouts(spark, sf)
    props = rows.select(
        "bout_id", *[F.least(F.lit(0.95), F.col(f"{c}_td_att") / 20).alias(f"p_takedown_{s}") for s, c in (("a", "r"), ("b", "b"))],
        *[(0.1 + F.col(f"{c}_kd") / 5).alias(f"p_knockdown_{s}") for s, c in (("a", "r"), ("b", "b"))],
    )
    return claims.joint(survival.with_hazards(rows)).join(props, "bout_id")


def outcome_long(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each of the markets came true, a row for every bout and market."""
    return claims.outcomes(bouts(spark, sf))


def bout_claims(spark: SparkSession, sf: str) -> DataFrame:
    """All claims of each bout: up to fifty-odd markets, all sums of one joint distribution."""
    return rounded(claims.claims(_joint(spark, sf)), ["bout_id", "market"], ["p"])


def claim_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Per market: how claims did against the market's own base rate."""
    out = claims.market_scores(claims.claims(_joint(spark, sf)), claims.outcomes(bouts(spark, sf)))
    return rounded(out, ["market", "n"], ["base", "brier", "brier_base", "skill"])


def market_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Per market and fifth of the probability: said against happened, of at least five claims."""
    told = claims.settled(_joint(spark, sf), bouts(spark, sf))
    band = rates.bucket_left(F.col("p"), grading.CLAIM_BANDS)
    out = told.select("market", band.alias("band"), "p", "hit").groupBy("market", "band").agg(F.count("*").alias("n"), F.avg("p").alias("said"), F.avg("hit").alias("happened"))
    return rounded(out.where("n >= 5"), ["market", "band", "n"], ["said", "happened"])


_TIMES = (0.5, 1.0, 7.5, 12.25, 14.0, 22.5)


def survival_times(spark: SparkSession, sf: str) -> DataFrame:
    """Survival at fractional minutes, and the expected length by round midpoints."""
    rows = _joint(spark, sf).select("bout_id", *[claims.survival_at(t).alias(f"s{i}") for i, t in enumerate(_TIMES)], claims.expected_minutes().alias("exp_minutes"))
    return rounded(rows, ["bout_id"], [*[f"s{i}" for i in range(len(_TIMES))], "exp_minutes"])


def conditional_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Who wins given a finish and given a decision, and each side's decision."""
    rows, m = _joint(spark, sf), claims.markets()
    rows = rows.select("bout_id", *[m[k].alias(k) for k in ("finish_a", "finish_b", "dec_a", "dec_b", "decision")])
    given = F.col("finish_a") / (F.col("finish_a") + F.col("finish_b")), F.col("dec_a") / F.col("decision")
    return rounded(rows.select("bout_id", "dec_a", "dec_b", *[c.alias(k) for k, c in zip(("a_given_finish", "a_given_decision"), given)]), ["bout_id"], ["dec_a", "dec_b", "a_given_finish", "a_given_decision"])


def likeliest_end(spark: SparkSession, sf: str) -> DataFrame:
    """How often each way to end is the likeliest of a bout, and how often it then came true."""
    told = _joint(spark, sf).select("bout_id", claims.likeliest().alias("named"))
    ended = bouts(spark, sf).select("bout_id", F.when(F.col("method") == "DEC", "decision").when(F.col("winner") == "draw", "none").otherwise(
        F.concat(F.when(F.col("winner") == "r", "a_").otherwise("b_"), F.when(F.col("method") == "SUB", "sub").otherwise("ko"))).alias("ended"))
    out = told.join(ended, "bout_id").groupBy("named").agg(F.count("*").alias("n"), F.count_if(F.col("named") == F.col("ended")).alias("right"))
    return out


def calibration_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Said against happened by right-closed cuts."""
    cuts = (0.35, 0.45, 0.55, 0.65, 0.75)
    told = grading.win_claims(app(spark, sf)).select(rates.bucket_right(F.col("p"), [F.lit(c) for c in cuts]).alias("cut"), "p", F.col("y").cast("double").alias("y"))
    return rounded(told.groupBy("cut").agg(F.count("*").alias("n"), F.avg("p").alias("said"), F.avg("y").alias("happened")), ["cut", "n"], ["said", "happened"])


def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """R2, rank correlation with average ranks on ties, and coverage of a range, for the length that a bout's joint expects."""
    told = _joint(spark, sf).select("bout_id", F.round(claims.expected_minutes(), 6).alias("x"))
    rows = told.join(bouts(spark, sf).select("bout_id", (F.col("total_sec") / 60).alias("y")), "bout_id")
    ranked = grading.average_ranks(grading.average_ranks(rows, "x", "rx"), "y", "ry")
    mean = F.broadcast(rows.agg(F.avg("y").alias("mean")))
    out = ranked.join(mean).agg(
        F.count("*").alias("n"), (1 - F.sum(F.pow(F.col("y") - F.col("x"), 2)) / F.sum(F.pow(F.col("y") - F.col("mean"), 2))).alias("r2"), F.corr("rx", "ry").alias("spearman"),
        F.avg((F.abs(F.col("y") - F.col("x")) <= 5).cast("double")).alias("coverage"),
    )
    return rounded(out, ["n"], ["r2", "spearman", "coverage"])


def multiclass_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Log loss of the three ways by division frequencies of the earlier half, against that of overall frequencies."""
    rows = bouts(spark, sf).select("bout_id", "weight_class", "method", (F.year("dt") < 1998).alias("early"))
    early = rows.where("early")
    cells = early.groupBy("weight_class", "method").agg(F.count("*").alias("k"))
    total = early.groupBy("weight_class").agg(F.count("*").alias("n"))
    prior = early.groupBy("method").agg(F.count("*").alias("c")).crossJoin(F.broadcast(early.agg(F.count("*").alias("all"))))  # three rows and one
    p = cells.join(total, "weight_class").join(F.broadcast(prior), "method").select("weight_class", "method", ((F.col("k") + 20 * F.col("c") / F.col("all")) / (F.col("n") + 20)).alias("p"), (F.col("c") / F.col("all")).alias("p0"))
    out = rows.where("not early").join(F.broadcast(p), ["weight_class", "method"]).agg(F.count("*").alias("n"), (-F.avg(F.ln("p"))).alias("log_loss"), (-F.avg(F.ln("p0"))).alias("prior_log_loss"))
    return rounded(out, ["n"], ["log_loss", "prior_log_loss"])


def false_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Benjamini-Hochberg over entities whose win share differs from one half, and the split-half reliability of that share."""
    rows = app(spark, sf).where("result <> 'D'").select("entity", "bout_id", (F.col("result") == "W").cast("double").alias("won"))
    per = rows.groupBy("entity").agg(F.count("*").alias("n"), F.sum("won").alias("wins"))
    tested = per.select("entity", grading.two_sided(F.abs(2 * F.col("wins") - F.col("n")) / F.sqrt("n")).alias("p"))
    return grading.benjamini_hochberg(tested, "p", 0.1).select("entity", F.round("p", 6).alias("p"), "passed")


def split_half(spark: SparkSession, sf: str) -> DataFrame:
    """Does an entity's finish share replicate? The correlation of its odd and even bouts, stepped up by Spearman-Brown."""
    rows = app(spark, sf).select("entity", F.col("bout_id") % 2 == 0, (F.col("method") != "DEC").cast("double")).toDF("entity", "even", "y")
    half = rows.groupBy("entity").agg(F.avg(F.when(F.col("even"), F.col("y"))).alias("a"), F.avg(F.when(~F.col("even"), F.col("y"))).alias("b"))
    out = half.agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")).select("n", "r", (2 * F.col("r") / (1 + F.col("r"))).alias("reliability"))
    return rounded(out, ["n"], ["r", "reliability"])


# Pounds of the divisions, told by what the name contains, the longest name first.
POUNDS = {"light heavy": 205, "straw": 115, "fly": 125, "bantam": 135, "feather": 145, "welter": 170, "middle": 185, "heavy": 265, "light": 155}


def division_pounds(spark: SparkSession, sf: str) -> DataFrame:
    """Division names to pounds and whether they are a women's; 155 where none is named."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("Light Heavyweight", "Strawweight", "FLYWEIGHT bout", "Women's Bantamweight", "Featherweight", "Welterweight", "Middleweight", "Heavyweight", "Lightweight", "Catch Weight")]), (F.col("c_custkey") % 10 + 1).cast("int"))
    rows = table(spark, sf, "customer").select("c_custkey", name.alias("division"))
    return rows.select("c_custkey", rates.pounds(F.col("division"), POUNDS).cast("long").alias("pounds"), F.lower("division").contains("women").cast("int").alias("women"))


def finish_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The inputs of the finish formula: sums of knockdowns, control, pace and submissions, age gap, five rounds, pounds, women's."""
    rows = career.panel(strength(spark, sf), ("sub15",))
    both = rows.groupBy("bout_id").agg(
        F.sum("own_kd15").alias("kd_sum"), F.sum("own_ctrl_share").alias("ctrl_sum"), F.sum("own_slpm").alias("pace_sum"), F.sum("own_sub15").alias("sub_sum"),
        (F.max(F.col("entity") % 20) - F.min(F.col("entity") % 20)).cast("double").alias("age_gap"), (F.max("sched_sec") > 900).cast("int").alias("five"),
        F.max(rates.pounds(F.regexp_replace(F.regexp_replace("weight_class", "1-URGENT", "heavyweight"), "2-HIGH", "women's flyweight"), POUNDS)).cast("long").alias("pounds"),
        F.max(F.col("weight_class") == "2-HIGH").cast("int").alias("women"),
    )
    return exact(both, ["bout_id", "five", "pounds", "women"], ["kd_sum", "ctrl_sum", "pace_sum", "sub_sum", "age_gap"])


def frozen_rule(spark: SparkSession, sf: str) -> DataFrame:
    """A rule written as a JSON document, read again, and applied: the score, and whether it fires against a price."""
    path = f"{scratch_folder(spark)}/rule"
    files.write_model(spark, {"features": list(RULE), "mean": [m for m, _, _ in RULE.values()], "scale": [s for _, s, _ in RULE.values()], "coef": [c for _, _, c in RULE.values()], "min_edge": 0.02}, path)
    rule = files.read_model(spark, path)
    rows = career.win_rows(strength(spark, sf)).where("orient = 0 and gate >= 2")
    z = sum(((F.col(k) - m) / s * c for k, m, s, c in zip(rule["features"], rule["mean"], rule["scale"], rule["coef"])), F.lit(0.0))
    implied = 0.5 + (F.col("bout_id") % 5) / 100
    rows = rows.select("bout_id", (1 / (1 + F.exp(-z))).alias("p"), implied.alias("implied"))
    return rounded(rows.withColumn("fires", ((F.col("p") - F.col("implied") > rule["min_edge"]) & (F.col("implied") >= 0.5)).cast("int")), ["bout_id", "fires"], ["p"])


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """A record in words, per entity."""
    rows = app(spark, sf).groupBy("entity").agg(F.count_if(F.col("result") == "W").alias("w"), F.count_if(F.col("result") == "L").alias("l"), F.count_if(F.col("result") == "D").alias("d"))
    tail = F.when(F.col("d") > 0, F.format_string("-%d", "d")).otherwise(F.lit(""))
    return rows.select("entity", F.concat(F.format_string("%d-%d", "w", "l"), tail, F.format_string(" (%d bouts)", F.col("w") + F.col("l") + F.col("d"))).alias("phrase"))


def trailing_shift(spark: SparkSession, sf: str) -> DataFrame:
    """A probability moved so that its base agrees with the last 300 bouts: a shift of the log-odds."""
    rows = bouts(spark, sf).select("bout_id", "dt", (F.col("method") == "DEC").cast("double").alias("y"))
    told = career.trailing_rate(rows, 300)
    logit = lambda p: F.ln(p / (1 - p))
    p = 0.2 + (F.col("bout_id") % 7) / 10
    base = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("anchor")))
    moved = 1 / (1 + F.exp(-(logit(p) + logit(base) - logit(F.lit(0.45)))))
    return rounded(told.select("bout_id", moved.alias("p")), ["bout_id"], ["p"])


QUERIES = {
    f.__name__: f
    for f in (
        outcome_long, bout_claims, claim_scorecard, market_bands, survival_times, conditional_lines, likeliest_end, calibration_cuts, rank_metrics, multiclass_loss, false_discovery,
        split_half, division_pounds, finish_rows, frozen_rule, phrases, trailing_shift,
    )
}

_WAYS, _R = {"a_ko": "h1", "b_ko": "h2", "a_sub": "h3", "b_sub": "h4"}, range(1, 6)
_CELLS = ", ".join(f"sum(CASE WHEN (minute - 1) // 5 + 1 = {r} THEN alive * {h} ELSE 0 END) AS {w}_r{r}" for w, h in _WAYS.items() for r in _R)
JOINT = f"""{_HAZ}, cells AS (SELECT bout_id, {_CELLS}, min(alive * stay) AS decision, list(alive * stay ORDER BY minute) AS curve FROM a GROUP BY bout_id),
    joint AS (SELECT c.*, CAST(b.sched_sec // 300 AS INTEGER) AS n, least(0.95::DOUBLE, r_td_att / 20) AS ta, least(0.95::DOUBLE, b_td_att / 20) AS tb,
    0.1::DOUBLE + r_kd / 5 AS ka, 0.1::DOUBLE + b_kd / 5 AS kb FROM cells c JOIN bouts b ON c.bout_id = b.bout_id)"""


def _way(name: str) -> str:
    return "(" + " + ".join(f"{name}_r{r}" for r in _R) + ")"


def _ends(*rounds: int) -> str:
    return "(" + " + ".join(f"{w}_r{r}" for r in rounds for w in _WAYS) + ")"


def _alive(t: float) -> str:
    i, part = int(t), t - int(t)
    at = lambda k: f"coalesce(curve[{k}], curve[-1])"  # noqa: E731  lists start at one
    return "1.0::DOUBLE" if i == 0 else at(i) if part == 0 else f"({at(i)} + ({at(i + 1)} - {at(i)}) * {part}::DOUBLE)"


_A = f"({_way('a_ko')} + {_way('a_sub')} + decision / 2)"
_P = {"winner_a": _A, "inside_distance": "1 - decision", "decision": "decision", "method_ko": f"{_way('a_ko')} + {_way('b_ko')}", "method_sub": f"{_way('a_sub')} + {_way('b_sub')}", "method_dec": "decision"}
for _s, _win in (("a", _A), ("b", f"(1 - {_A})")):
    _fin = f"({_way(_s + '_ko')} + {_way(_s + '_sub')})"
    _P |= {f"ko_{_s}": _way(f"{_s}_ko"), f"sub_{_s}": _way(f"{_s}_sub"), f"finish_{_s}": _fin, f"dec_{_s}": f"greatest(0.0::DOUBLE, {_win} - {_fin})", f"takedown_{_s}": f"t{_s}", f"knockdown_{_s}": f"k{_s}"}
for _r in _R:
    _P[f"end_r{_r}"] = f"CASE WHEN n >= {_r} THEN {_ends(_r)} END"
    if _r > 1:
        _P[f"ends_before_r{_r}"] = f"CASE WHEN n >= {_r} THEN {_ends(*range(1, _r))} END"
        _P[f"starts_r{_r}"] = f"CASE WHEN n >= {_r} THEN 1 - {_ends(*range(1, _r))} END"
        _P[f"total_over_{_r - 1}_5"] = f"CASE WHEN n >= {_r} THEN {_alive(5 * _r - 2.5)} END"
    _P |= {f"rov_{_w}_r{_r}": f"CASE WHEN n >= {_r} THEN {_w}_r{_r} END" for _w in _WAYS}
_RND, _WON = "greatest(1, least(CAST(ceil(total_sec / 300.0) AS BIGINT), 5))", {"a": "CASE WHEN winner <> 'draw' THEN winner = 'r' END", "b": "CASE WHEN winner <> 'draw' THEN winner = 'b' END"}
_HIT = {"winner_a": _WON["a"], "inside_distance": "method <> 'DEC'", "decision": "method = 'DEC'", "method_ko": "method = 'KO/TKO'", "method_sub": "method = 'SUB'", "method_dec": "method = 'DEC'"}
for _s, _c in (("a", "r"), ("b", "b")):
    _HIT |= {f"ko_{_s}": f"({_WON[_s]}) AND method = 'KO/TKO'", f"sub_{_s}": f"({_WON[_s]}) AND method = 'SUB'", f"finish_{_s}": f"({_WON[_s]}) AND method <> 'DEC'", f"dec_{_s}": f"({_WON[_s]}) AND method = 'DEC'"}
    _HIT |= {f"takedown_{_s}": f"{_c}_td_landed >= 1", f"knockdown_{_s}": f"{_c}_kd >= 1"}
    _HIT |= {f"rov_{_s}_{_k}_r{_r}": f"({_WON[_s]}) AND method = '{_m}' AND {_RND} = {_r}" for _k, _m in (("ko", "KO/TKO"), ("sub", "SUB")) for _r in _R}
for _r in _R:
    _HIT[f"end_r{_r}"] = f"method <> 'DEC' AND {_RND} = {_r}"
    if _r > 1:
        _HIT |= {f"ends_before_r{_r}": f"method <> 'DEC' AND {_RND} < {_r}", f"starts_r{_r}": f"method = 'DEC' OR {_RND} >= {_r}", f"total_over_{_r - 1}_5": f"total_sec > {300 * _r - 150}"}
_LONG_P = f"told AS (SELECT bout_id, unnest([{', '.join(repr(k) for k in _P)}]) AS market, unnest([{', '.join(_P.values())}]) AS p FROM joint)"
_LONG_Y = f"came AS (SELECT bout_id, unnest([{', '.join(repr(k) for k in _HIT)}]) AS market, unnest([{', '.join(f'CAST(({v}) AS INTEGER)' for v in _HIT.values())}]) AS hit FROM bouts)"
_GRADED = f"{JOINT}, {_LONG_P}, {_LONG_Y}, graded AS (SELECT market, p, CAST(hit AS DOUBLE) AS y FROM told JOIN came USING (bout_id, market) WHERE p IS NOT NULL AND hit IS NOT NULL)"
_NAMED = {**{k: _way(k) for k in _WAYS}, "decision": "decision"}
_MID = " + ".join(f"{_ends(r)} * {(r - 1) * 5 + 2.5}::DOUBLE" for r in _R) + " + decision * n * 5"
_LB = "CASE " + " ".join(f"WHEN contains(lower(division), '{k}') THEN {v}" for k, v in POUNDS.items()) + " ELSE 155 END"

ORACLES = {
    "outcome_long": f"{B}, {_LONG_Y} SELECT * FROM came",
    "bout_claims": f"{JOINT}, {_LONG_P} SELECT bout_id, market, round(p, 6) AS p FROM told WHERE p IS NOT NULL",
    "claim_scorecard": f"""{_GRADED}, s AS (SELECT market, count(*) AS n, avg(y) AS base, avg(pow(p - y, 2)) AS brier FROM graded GROUP BY 1)
        SELECT market, n, round(base, 6) AS base, round(brier, 6) AS brier, round(base * (1 - base), 6) AS brier_base, round(base * (1 - base) - brier, 6) AS skill FROM s""",
    "market_bands": f"""{_GRADED} SELECT market, CASE WHEN p < 0.2 THEN 1 WHEN p < 0.4 THEN 2 WHEN p < 0.6 THEN 3 WHEN p < 0.8 THEN 4 ELSE 5 END AS band, count(*) AS n, round(avg(p), 6) AS said, round(avg(y), 6) AS happened
        FROM graded GROUP BY 1, 2 HAVING count(*) >= 5""",
    "survival_times": f"{JOINT} SELECT bout_id, {', '.join(f'round({_alive(t)}, 6) AS s{i}' for i, t in enumerate(_TIMES))}, round({_MID}, 6) AS exp_minutes FROM joint",
    "conditional_lines": f"""{JOINT}, m AS (SELECT bout_id, {', '.join(f'{_P[k]} AS {k}' for k in ('finish_a', 'finish_b', 'dec_a', 'dec_b'))}, decision FROM joint)
        SELECT bout_id, round(dec_a, 6) AS dec_a, round(dec_b, 6) AS dec_b, round(finish_a / (finish_a + finish_b), 6) AS a_given_finish, round(dec_a / decision, 6) AS a_given_decision FROM m""",
    "likeliest_end": f"""{JOINT}, w AS (SELECT bout_id, unnest([{', '.join(repr(k) for k in _NAMED)}]) AS name, unnest([{', '.join(_NAMED.values())}]) AS p FROM joint),
        k AS (SELECT bout_id, name, row_number() OVER (PARTITION BY bout_id ORDER BY p DESC, name DESC) AS k FROM w)
        SELECT name AS named, count(*) AS n, count(*) FILTER (WHERE name = CASE WHEN method = 'DEC' THEN 'decision' WHEN winner = 'draw' THEN 'none' ELSE CASE winner WHEN 'r' THEN 'a_' ELSE 'b_' END || CASE method WHEN 'SUB' THEN 'sub' ELSE 'ko' END END) AS right
        FROM k JOIN bouts b ON k.bout_id = b.bout_id WHERE k = 1 GROUP BY 1""",
    "calibration_cuts": f"""{CLAIMS} SELECT CASE WHEN p <= 0.35 THEN 1 WHEN p <= 0.45 THEN 2 WHEN p <= 0.55 THEN 3 WHEN p <= 0.65 THEN 4 WHEN p <= 0.75 THEN 5 ELSE 6 END AS cut, count(*) AS n, round(avg(p), 6) AS said,
        round(avg(CAST(y AS DOUBLE)), 6) AS happened FROM claims GROUP BY 1""",
    "rank_metrics": f"""{JOINT}, x AS (SELECT j.bout_id, round({_MID}, 6) AS x, total_sec / 60.0::DOUBLE AS y FROM joint j JOIN bouts b ON j.bout_id = b.bout_id),
        k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry, avg(y) OVER () AS mean FROM x)
        SELECT count(*) AS n, round(1 - sum(pow(y - x, 2)) / sum(pow(y - mean, 2)), 6) AS r2, round(corr(rx, ry), 6) AS spearman, round(avg(CASE WHEN abs(y - x) <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage FROM k""",
    "multiclass_loss": f"""{B}, e AS (SELECT * FROM bouts WHERE year(dt) < 1998), g AS (SELECT weight_class, count(*) AS n FROM e GROUP BY 1), o AS (SELECT method, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM e) AS p0 FROM e GROUP BY 1),
        p AS (SELECT e.weight_class, e.method, (count(*) + 20 * max(p0)) / (max(n) + 20) AS p, max(p0) AS p0 FROM e JOIN g ON e.weight_class = g.weight_class JOIN o ON e.method = o.method GROUP BY 1, 2)
        SELECT count(*) AS n, round(-avg(ln(p)), 6) AS log_loss, round(-avg(ln(p0)), 6) AS prior_log_loss FROM bouts b JOIN p ON b.weight_class = p.weight_class AND b.method = p.method WHERE year(dt) >= 1998""",
    "false_discovery": """{app}, w AS (SELECT entity, count(*) AS n, count(*) FILTER (WHERE result = 'W') AS wins FROM app WHERE result <> 'D' GROUP BY 1), z AS (SELECT entity, abs(2 * wins - n) / sqrt(n) AS z FROM w),
        t AS (SELECT entity, z, 1 / (1 + 0.2316419::DOUBLE * z) AS t FROM z), p AS (SELECT entity, least(1.0::DOUBLE, 2 * exp(-z * z / 2) / 2.5066282746310002::DOUBLE
            * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))) AS p FROM t),
        r AS (SELECT *, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k, count(*) OVER () AS m FROM p), b AS (SELECT max(p) FILTER (WHERE p <= 0.1::DOUBLE * k / m) AS bound FROM r)
        SELECT entity, round(p, 6) AS p, CAST(coalesce(p <= bound, false) AS INTEGER) AS passed FROM p, b""",
    "split_half": """{app}, h AS (SELECT entity, avg(CASE WHEN bout_id % 2 = 0 THEN CASE WHEN method <> 'DEC' THEN 1.0::DOUBLE ELSE 0 END END) AS a, avg(CASE WHEN bout_id % 2 = 1 THEN CASE WHEN method <> 'DEC' THEN 1.0::DOUBLE ELSE 0 END END) AS b FROM app GROUP BY 1)
        SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(2 * corr(a, b) / (1 + corr(a, b)), 6) AS reliability FROM h""",
    "division_pounds": f"""WITH n AS (SELECT c_custkey, ['Light Heavyweight', 'Strawweight', 'FLYWEIGHT bout', 'Women''s Bantamweight', 'Featherweight', 'Welterweight', 'Middleweight', 'Heavyweight', 'Lightweight', 'Catch Weight'][c_custkey % 10 + 1] AS division FROM customer)
        SELECT c_custkey, {_LB} AS pounds, CAST(contains(lower(division), 'women') AS INTEGER) AS women FROM n""",
    "finish_rows": f"""{STRENGTH}, g AS (SELECT bout_id FROM strength GROUP BY 1 HAVING min(n_prior) >= 2) SELECT s.bout_id, CAST(max(sched_sec) > 900 AS INTEGER) AS five,
        max(CASE weight_class WHEN '1-URGENT' THEN 265 WHEN '2-HIGH' THEN 125 ELSE 155 END) AS pounds, CAST(max(weight_class) = '2-HIGH' AS INTEGER) AS women, sum(kd15) AS kd_sum, sum(ctrl_share) AS ctrl_sum, sum(slpm) AS pace_sum, sum(sub15) AS sub_sum,
        CAST(max(entity % 20) - min(entity % 20) AS DOUBLE) AS age_gap FROM strength s JOIN g ON s.bout_id = g.bout_id GROUP BY 1""",
    "frozen_rule": f"""{STRENGTH}, one AS (SELECT r.bout_id, {' + '.join(f'((r.{k[2:]} - b.{k[2:]}) - {m}) / {s} * {c}' for k, (m, s, c) in RULE.items())} AS z FROM strength r JOIN strength b ON r.bout_id = b.bout_id AND r.side = 'r' AND b.side = 'b'
        WHERE r.result <> 'D' AND least(r.n_prior, b.n_prior) >= 2), p AS (SELECT bout_id, 1 / (1 + exp(-z)) AS p, 0.5::DOUBLE + (bout_id % 5) / 100.0::DOUBLE AS implied FROM one)
        SELECT bout_id, CAST(p - implied > 0.02 AND implied >= 0.5 AS INTEGER) AS fires, round(p, 6) AS p FROM p""",
    "phrases": """{app}, g AS (SELECT entity, count(*) FILTER (WHERE result = 'W') AS w, count(*) FILTER (WHERE result = 'L') AS l, count(*) FILTER (WHERE result = 'D') AS d FROM app GROUP BY 1)
        SELECT entity, w || '-' || l || CASE WHEN d > 0 THEN '-' || d ELSE '' END || ' (' || (w + l + d) || ' bouts)' AS phrase FROM g""",
    "trailing_shift": f"""{B}, t AS (SELECT bout_id, greatest(0.01::DOUBLE, least(0.99::DOUBLE, coalesce(avg(CASE WHEN method = 'DEC' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (ORDER BY dt, bout_id ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING), 0.5::DOUBLE))) AS q,
        0.2::DOUBLE + (bout_id % 7) / 10.0::DOUBLE AS p FROM bouts) SELECT bout_id, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(q / (1 - q)) - ln(0.45::DOUBLE / 0.55::DOUBLE)))), 6) AS p FROM t""",
}
ORACLES = {k: v.replace("{app}", CLAIMS[: CLAIMS.index(", rate AS")]) for k, v in ORACLES.items()}
