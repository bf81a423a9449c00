"""Queries over as-of career features, the rating, the panel, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators import career, rating
from boutline.sources import views
from boutline.sources.views import with_views

W = "OVER (PARTITION BY entity ORDER BY dt, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_FLAGS = {
    "wins": "(result = 'W')", "losses": "(result = 'L')", "w_ko": "(result = 'W' AND method = 'KO/TKO')", "w_sub": "(result = 'W' AND method = 'SUB')",
    "l_ko": "(result = 'L' AND method = 'KO/TKO')", "decisions": "(method = 'DEC')",
}
_VALUES = {k: k for k in career.SUMS} | {k: f"CAST({v} AS DOUBLE)" for k, v in _FLAGS.items()} | {
    "survived": "CASE WHEN result = 'L' AND method = 'KO/TKO' THEN 0.0 ELSE opp_kd END", "sec": "CAST(total_sec AS DOUBLE)", "deep": "CAST(deep_rounds AS DOUBLE)"
}
P = career.PRIOR


def _acc(landed: str, tried: str, prior: float) -> str:
    return f"(s_{landed} + {25 * prior!r}::DOUBLE) / (s_{tried} + 25)"


SQL_RATES = {
    "slpm": f"(s_ss_landed + {15 * P['slpm']!r}::DOUBLE) / (s_sec / 60 + 15)", "sapm": f"(s_opp_ss_landed + {15 * P['sapm']!r}::DOUBLE) / (s_sec / 60 + 15)",
    "str_acc": _acc("ss_landed", "ss_att", P["str_acc"]), "str_def": "1 - " + _acc("opp_ss_landed", "opp_ss_att", 1 - P["str_def"]),
    "td15": f"(s_td_landed + {2 * P['td15']!r}::DOUBLE) / (s_sec / 60 / 15 + 2)", "td_acc": _acc("td_landed", "td_att", P["td_acc"]),
    "td_def": "1 - " + _acc("opp_td_landed", "opp_td_att", 1 - P["td_def"]), "sub15": f"(s_sub_att + {2 * P['sub15']!r}::DOUBLE) / (s_sec / 60 / 15 + 2)",
    "ctrl_share": f"(s_ctrl_sec + {900 * P['ctrl_share']!r}::DOUBLE) / (s_sec + 900)",
    **{f"{k}_share": f"(s_{k}_landed + {60 * P[k + '_share']!r}::DOUBLE) / (s_ss_landed + 60)" for k in ("body", "leg", "clinch", "ground")},
    "kd15": f"(s_kd + {2 * P['kd15']!r}::DOUBLE) / (s_sec / 60 / 15 + 2)", "kd_against15": f"(s_opp_kd + {2 * P['kd_against15']!r}::DOUBLE) / (s_sec / 60 / 15 + 2)",
    "finish_rate": f"(s_w_ko + s_w_sub + {4 * P['finish_rate']!r}::DOUBLE) / (n_prior + 4)", "ko_loss_rate": f"(s_l_ko + {4 * P['ko_loss_rate']!r}::DOUBLE) / (n_prior + 4)",
    "win_pct": "(s_wins + 2) / (n_prior + 4)",
}
SQL_LATE = {
    "late_acc_delta": "(s_late_ss_landed + 20.25) / (s_late_ss_att + 45) - (s_r1_ss_landed + 20.25) / (s_r1_ss_att + 45)",
    "late_volume_ret": "((s_late_ss_att + 66) / (s_deep + 3)) / ((s_r1_ss_att + 66) / (n_prior + 3))",
    "ctrl_retention": "((s_late_ctrl_sec + 120) / (s_deep + 3)) / ((s_r1_ctrl_sec + 120) / (n_prior + 3))",
    "induced_decay": "(s_opp_r1_ss_landed + 20.25) / (s_opp_r1_ss_att + 45) - (s_opp_late_ss_landed + 20.25) / (s_opp_late_ss_att + 45)",
    "deep_experience": "ln(1 + s_deep)", "kd_recovery": "(s_survived + 1.24) / (s_opp_kd + 2)",
}
_SNAPS = f"""sums AS (SELECT *, CAST(count(*) {W} AS DOUBLE) AS n_prior, max(dt) {W} AS last_dt,
    {', '.join(f'coalesce(sum({v}) {W}, 0.0::DOUBLE) AS s_{k}' for k, v in _VALUES.items())} FROM app
), snaps AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in {**SQL_RATES, **SQL_LATE}.items())},
    coalesce(CAST(greatest(0, date_diff('day', last_dt, dt)) AS DOUBLE), 365.0::DOUBLE) AS layoff FROM sums
)"""
_STRENGTH = f"""met AS (SELECT s.*, ln(1 + s.layoff) AS log_layoff, o.str_def AS o_str_def, o.td_def AS o_td_def
    FROM snaps s JOIN snaps o ON s.bout_id = o.bout_id AND s.opponent = o.entity
), sos AS (SELECT *, coalesce(avg(o_str_def) {W}, 0.55::DOUBLE) AS sos_str_def, coalesce(avg(o_td_def) {W}, 0.65::DOUBLE) AS sos_td_def FROM met
), strength AS (SELECT *, slpm * greatest(0.72::DOUBLE, least(1.38::DOUBLE, {1 - 0.55!r}::DOUBLE / greatest(1e-6::DOUBLE, 1 - sos_str_def))) AS adj_slpm,
    td15 * greatest(0.72::DOUBLE, least(1.38::DOUBLE, {1 - 0.65!r}::DOUBLE / greatest(1e-6::DOUBLE, 1 - sos_td_def))) AS adj_td15 FROM sos)"""
SNAPS = f"{with_views('bouts', 'app')}, {_SNAPS}"
STRENGTH = f"{SNAPS}, {_STRENGTH}"
LEVELS = ["slpm", "sapm", "str_acc", "str_def", "td15", "td_acc", "td_def", "ctrl_share", "kd15", "kd_against15", "finish_rate", "ko_loss_rate", "win_pct"]
_PANEL = f"""panel AS (SELECT s.bout_id, s.dt, s.event, s.side, s.entity, s.opponent, s.result, s.method, s.sched_sec, s.total_sec, s.weight_class, s.n_prior,
    {', '.join(f's.{k} AS own_{k}' for k in LEVELS)}, {', '.join(f'o.{k} AS opp_{k}' for k in LEVELS)},
    s.ss_landed / greatest(s.total_sec / 60.0::DOUBLE, 1e-9::DOUBLE) AS y_strikes_min, s.td_landed / greatest(s.total_sec / 60.0::DOUBLE, 1e-9::DOUBLE) * 15 AS y_td15,
    s.ctrl_sec / greatest(s.total_sec / 60.0::DOUBLE, 1e-9::DOUBLE) AS y_ctrl_min, s.kd AS y_kd
    FROM strength s JOIN strength o ON s.bout_id = o.bout_id AND s.opponent = o.entity WHERE least(s.n_prior, o.n_prior) >= 2)"""
PANEL = f"{STRENGTH}, {_PANEL}"


def rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(k).cast("double"), 6).alias(k) for k in names])


def sql_rounded(names: list[str]) -> str:
    return ", ".join(f"round(CAST({k} AS DOUBLE), 6) AS {k}" for k in names)


def exact(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The values as they are: a value on a tie of decimal places may round either way."""
    return df.select(*keys, *[F.col(k).cast("double").alias(k) for k in names])


def sql_exact(names: list[str]) -> str:
    return ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in names)


def strength(spark: SparkSession, sf: str) -> DataFrame:
    return career.strength(views.pairings(spark, sf), views.with_stats)


_ASOF = [*SQL_RATES, "n_prior", "layoff"]


def career_asof(spark: SparkSession, sf: str) -> DataFrame:
    return exact(career.snapshots(views.appearances(views.bouts(spark, sf))), ["bout_id", "side", "entity"], _ASOF)


def late_round_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return exact(career.snapshots(views.appearances(views.bouts(spark, sf))), ["bout_id", "side", "entity"], list(SQL_LATE))


_SOS = ["sos_str_def", "sos_td_def", "adj_slpm", "adj_td15"]


def sos_asof(spark: SparkSession, sf: str) -> DataFrame:
    return exact(strength(spark, sf), ["bout_id", "side", "entity"], _SOS)


def career_end_state(spark: SparkSession, sf: str) -> DataFrame:
    sums = career.end_sums(views.appearances(views.bouts(spark, sf)))
    rates = sums.select("entity", "n_prior", F.col("last_dt").cast("string").alias("last_dt"), *[c.alias(k) for k, c in career.rates().items()])
    return exact(rates, ["entity", "last_dt"], ["n_prior", *SQL_RATES])


def elo_asof(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rating.ratings(views.bouts(spark, sf)), ["bout_id"], ["r_elo", "b_elo"])


_X = ["x_grapple", "x_ko", "x_sub", "x_power", "x_position"]


def win_rows_mirrored(spark: SparkSession, sf: str) -> DataFrame:
    return exact(career.win_rows(strength(spark, sf)), ["bout_id", "orient", "a", "b", "y"], ["gate", *[f"d_{k}" for k in career.DIFFERENCES], *_X])


def _sql_win_rows() -> str:
    d = ", ".join(f"r.{k} - b.{k} AS d_{k}" for k in career.DIFFERENCES)
    names = ["gate", *[f"d_{k}" for k in career.DIFFERENCES], *_X]
    pos = "({0}.clinch_share + {0}.ground_share) * (1 - {1}.td_def)"
    return f"""{STRENGTH}, one AS (SELECT r.bout_id, r.entity AS a, b.entity AS b, CASE r.result WHEN 'W' THEN 1 ELSE 0 END AS y, least(r.n_prior, b.n_prior) AS gate, {d},
        r.adj_td15 * (1 - b.td_def) - b.adj_td15 * (1 - r.td_def) AS x_grapple, r.adj_slpm * b.ko_loss_rate - b.adj_slpm * r.ko_loss_rate AS x_ko,
        r.sub15 * (1 - b.td_def) - b.sub15 * (1 - r.td_def) AS x_sub, r.kd15 * b.kd_against15 - b.kd15 * r.kd_against15 AS x_power,
        {pos.format('r', 'b')} - {pos.format('b', 'r')} AS x_position
        FROM strength r JOIN strength b ON r.bout_id = b.bout_id AND r.side = 'r' AND b.side = 'b' WHERE r.result <> 'D')
        SELECT bout_id, 0 AS orient, a, b, y, {sql_exact(names)} FROM one UNION ALL
        SELECT bout_id, 1, b, a, 1 - y, {', '.join(f'CAST({"" if k == "gate" else "-"}{k} AS DOUBLE)' for k in names)} FROM one"""


_PANEL_VALUES = [f"{o}_{k}" for o in ("own", "opp") for k in LEVELS] + ["y_strikes_min", "y_td15", "y_ctrl_min", "y_kd"]


def panel_levels(spark: SparkSession, sf: str) -> DataFrame:
    return exact(career.panel(strength(spark, sf)), ["bout_id", "side", "entity", "opponent"], _PANEL_VALUES)


_SYM = ["own_finish_rate", "own_kd15", "own_ctrl_share", "own_slpm", "own_win_pct"]


def fight_sym(spark: SparkSession, sf: str) -> DataFrame:
    out = career.symmetric(career.panel(strength(spark, sf)), _SYM)
    return rounded(out, ["bout_id"], [f"{k}_{f}" for k in _SYM for f in ("sum", "gap")])


def prior_awards(spark: SparkSession, sf: str) -> DataFrame:
    """A finish in round one earns an award; what an entity had before each bout."""
    app = views.appearances(views.bouts(spark, sf))
    award = ((F.col("result") == "W") & (F.col("method") != "DEC") & (F.col("total_sec") <= 300)).cast("long")
    return app.withColumn("award", award).select("bout_id", "entity", F.coalesce(F.sum("award").over(career.before("entity")), F.lit(0)).alias("prior_awards"))


def anchor_trailing300(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.bouts(spark, sf).select("bout_id", "dt", (F.col("method") == "DEC").cast("double").alias("y"))
    return rounded(career.trailing_rate(rows, 300), ["bout_id", "n_before"], ["anchor"])


def win_rate_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    """Does the side with the higher as-of win rate win, by quartile of the difference? The flagship query."""
    rows = career.win_rows(strength(spark, sf)).where("orient = 0 and gate >= 2").select("bout_id", F.col("d_win_pct").alias("diff"), "y")
    from boutline.operators.rates import quartile_rates

    return quartile_rates(rows, "diff", "y").select("bucket", "n", F.round("rate", 6).alias("rate"), F.round("half_width", 6).alias("half_width"))


def conditions(spark: SparkSession, sf: str) -> DataFrame:
    """All conditions, every quartile of each: rate, lift, half width, and how far the quartiles are apart."""
    from boutline.operators.rates import condition_rows, quantile_rates

    kept = ["bout_id", "side", "entity", "method", "n_prior", "td_landed", "kd", "adj_td15", "adj_slpm", "td_def", "kd15", "ctrl_share", "sub15", "clinch_share", "ground_share", "kd_against15", "sapm"]
    own = strength(spark, sf).select(*kept, F.try_divide("s_decisions", "n_prior").alias("decision_share"))
    sides = career.facing(own, {"n_prior": "o_n", "td_def": "opp_td_def", "kd_against15": "opp_kd_against15", "sapm": "opp_sapm", "entity": "o_id"}).where(F.least("n_prior", "o_n") >= 2)
    # The test tables have neither reach nor age: an entity's number stands in for both.
    sides = sides.withColumns({"reach_diff": (F.col("entity") % 13 - F.col("o_id") % 13).cast("double"), "age": (F.col("entity") % 20).cast("double"), "position": F.col("clinch_share") + F.col("ground_share")})
    return rounded(quantile_rates(condition_rows(sides), ["condition"], "value", "y"), ["condition", "bucket", "n", "thin"], ["rate", "lift", "half_width", "spread"])



def _sql_conditions() -> str:
    from boutline.operators.rates import CONDITIONS

    value = {
        "adj_td15": "s.adj_td15", "opp_td_def": "o.td_def", "kd15": "s.kd15", "reach_diff": "CAST(s.entity % 13 - o.entity % 13 AS DOUBLE)", "position": "s.clinch_share + s.ground_share",
        "opp_kd_against15": "o.kd_against15", "opp_sapm": "o.sapm",
    }
    both = {"kd15": "r.kd15 + b.kd15", "ctrl_share": "r.ctrl_share + b.ctrl_share", "adj_slpm": "r.adj_slpm + b.adj_slpm", "age_gap": "CAST(abs(r.entity % 20 - b.entity % 20) AS DOUBLE)", "sub15": "r.sub15 + b.sub15",
            "decisions": "CASE WHEN least(r.n_prior, b.n_prior) >= 3 THEN (r.s_decisions / r.n_prior + b.s_decisions / b.n_prior) / 2 END"}
    fact = {"y_td": "s.td_landed > 0", "y_kd": "s.kd > 0", "itd": "r.method <> 'DEC'", "dec": "r.method = 'DEC'"}
    sides = " UNION ALL ".join(f"SELECT '{k}' AS condition, {value[c]} AS x, CASE WHEN {fact[y]} THEN 1.0::DOUBLE ELSE 0 END AS y FROM strength s JOIN strength o ON s.bout_id = o.bout_id AND s.opponent = o.entity WHERE least(s.n_prior, o.n_prior) >= 2"
                               for k, (level, c, y) in CONDITIONS.items() if level == "side")
    fights = " UNION ALL ".join(f"SELECT '{k}', {both[c]}, CASE WHEN {fact[y]} THEN 1.0::DOUBLE ELSE 0 END FROM strength r JOIN strength b ON r.bout_id = b.bout_id AND r.side = 'r' AND b.side = 'b' WHERE least(r.n_prior, b.n_prior) >= 2"
                                for k, (level, c, y) in CONDITIONS.items() if level == "bout")
    return f"""{STRENGTH}, v AS (SELECT * FROM ({sides} UNION ALL {fights}) WHERE x IS NOT NULL),
        e AS (SELECT condition, quantile_cont(x, 0.25) AS e1, quantile_cont(x, 0.5) AS e2, quantile_cont(x, 0.75) AS e3, avg(y) AS base FROM v GROUP BY 1),
        t AS (SELECT v.condition, CASE WHEN x <= e1 THEN 1 WHEN x <= e2 THEN 2 WHEN x <= e3 THEN 3 ELSE 4 END AS bucket, count(*) AS n, avg(y) AS rate, max(base) AS base FROM v JOIN e ON v.condition = e.condition GROUP BY 1, 2)
        SELECT condition, bucket, n, CAST(n < 200 AS INTEGER) AS thin, round(rate, 6) AS rate, round(rate - base, 6) AS lift, round(1.96::DOUBLE * sqrt(rate * (1 - rate) / n), 6) AS half_width,
        round(max(rate) OVER (PARTITION BY condition) - min(rate) OVER (PARTITION BY condition), 6) AS spread FROM t"""


def rating_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The rating's own probability on decided bouts, scored like any other claim."""
    rows = views.bouts(spark, sf).where("winner <> 'draw'").select("bout_id", (F.col("winner") == "r").cast("double").alias("y"))
    p = 1 / (1 + F.pow(F.lit(10.0), (F.col("b_elo") - F.col("r_elo")) / 400))
    told = rating.ratings(views.bouts(spark, sf)).join(rows, "bout_id").select(p.alias("p"), "y")
    return rounded(told.agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")), ["n"], ["accuracy", "brier"])


#: The fold of the rating, a bout at a time: lists hold each entity's rating and the day of its last bout.
_ELO = f"""WITH RECURSIVE {with_views('bouts')[5:]}, m AS MATERIALIZED (SELECT row_number() OVER (ORDER BY dt, bout_id) AS i, bout_id, date_diff('day', DATE '1970-01-01', dt) AS day, CAST(r_id + 1 AS INTEGER) AS r, CAST(b_id + 1 AS INTEGER) AS b,
        CASE winner WHEN 'r' THEN 1.0::DOUBLE WHEN 'b' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score, CASE method WHEN 'DEC' THEN 24.0::DOUBLE ELSE 31.2::DOUBLE END AS k FROM bouts),
    f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS bout_id, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, list_transform(range(s + 1), lambda z: 1500.0::DOUBLE) AS e, list_transform(range(s + 1), lambda z: NULL::BIGINT) AS d
            FROM (SELECT max(s_suppkey) AS s FROM supplier)
        UNION ALL SELECT i, bout_id, x, y, list_transform(e, lambda v, n: CASE WHEN n = r THEN v + c WHEN n = b THEN v - c ELSE v END), list_transform(d, lambda v, n: CASE WHEN n = r OR n = b THEN day ELSE v END)
        FROM (SELECT *, k * (score - 1 / (1 + pow(10.0::DOUBLE, (y - x) / 400))) AS c FROM (SELECT m.*, f.e, f.d,
            1500 + (f.e[m.r] - 1500) * exp(-0.06::DOUBLE * (m.day - coalesce(f.d[m.r], m.day)) / 365.25::DOUBLE) AS x, 1500 + (f.e[m.b] - 1500) * exp(-0.06::DOUBLE * (m.day - coalesce(f.d[m.b], m.day)) / 365.25::DOUBLE) AS y
            FROM f JOIN m ON m.i = f.i + 1)))
    SELECT bout_id, round(x, 6) AS r_elo, round(y, 6) AS b_elo FROM f WHERE i > 0"""

_END = ", ".join(f"sum({v}) AS s_{k}" for k, v in _VALUES.items())
QUERIES = {
    f.__name__: f
    for f in (conditions, rating_baseline, career_asof, late_round_cluster, sos_asof, career_end_state, elo_asof, win_rows_mirrored, panel_levels, fight_sym, prior_awards, anchor_trailing300, win_rate_quartiles)
}

ORACLES = {
    "conditions": _sql_conditions(),
    "elo_asof": _ELO,
    "rating_baseline": _ELO[: _ELO.rindex("SELECT bout_id, round(x")] + """SELECT count(*) AS n, round(avg(CASE WHEN (x >= y) = (winner = 'r') THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
        round(avg(pow(1 / (1 + pow(10.0::DOUBLE, (y - x) / 400)) - CASE winner WHEN 'r' THEN 1.0::DOUBLE ELSE 0 END, 2)), 6) AS brier FROM f JOIN bouts b ON f.bout_id = b.bout_id WHERE f.i > 0 AND winner <> 'draw'""",
    "career_asof": f"{SNAPS} SELECT bout_id, side, entity, {sql_exact(_ASOF)} FROM snaps",
    "late_round_cluster": f"{SNAPS} SELECT bout_id, side, entity, {sql_exact(list(SQL_LATE))} FROM snaps",
    "sos_asof": f"{STRENGTH} SELECT bout_id, side, entity, {sql_exact(_SOS)} FROM strength",
    "career_end_state": f"""{with_views('bouts', 'app')}, ends AS (SELECT entity, CAST(count(*) AS DOUBLE) AS n_prior, max(dt) AS last_dt, {_END} FROM app GROUP BY entity),
        rated AS (SELECT entity, CAST(last_dt AS VARCHAR) AS last_dt, n_prior, {', '.join(f'{v} AS {k}' for k, v in SQL_RATES.items())} FROM ends)
        SELECT entity, last_dt, {sql_exact(['n_prior', *SQL_RATES])} FROM rated""",
    "win_rows_mirrored": _sql_win_rows(),
    "panel_levels": f"{PANEL} SELECT bout_id, side, entity, opponent, {sql_exact(_PANEL_VALUES)} FROM panel",
    "fight_sym": f"""{PANEL} SELECT bout_id, {', '.join(f'round(sum({k}), 6) AS {k}_sum, round(max({k}) - min({k}), 6) AS {k}_gap' for k in _SYM)} FROM panel GROUP BY bout_id""",
    "prior_awards": f"""{with_views('bouts', 'app')} SELECT bout_id, entity, CAST(coalesce(sum(CASE WHEN result = 'W' AND method <> 'DEC' AND total_sec <= 300 THEN 1 ELSE 0 END) {W}, 0) AS BIGINT) AS prior_awards FROM app""",
    "anchor_trailing300": f"""{with_views('bouts')} SELECT bout_id, count(*) OVER w AS n_before, round(coalesce(avg(CASE WHEN method = 'DEC' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w, 0.5::DOUBLE), 6) AS anchor
        FROM bouts WINDOW w AS (ORDER BY dt, bout_id ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING)""",
    "win_rate_quartiles": f"""{STRENGTH}, one AS (SELECT r.win_pct - b.win_pct AS diff, CASE r.result WHEN 'W' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y
            FROM strength r JOIN strength b ON r.bout_id = b.bout_id AND r.side = 'r' AND b.side = 'b' WHERE r.result <> 'D' AND least(r.n_prior, b.n_prior) >= 2),
        e AS (SELECT quantile_cont(diff, 0.25) AS e1, quantile_cont(diff, 0.5) AS e2, quantile_cont(diff, 0.75) AS e3 FROM one),
        t AS (SELECT CASE WHEN diff <= e1 THEN 1 WHEN diff <= e2 THEN 2 WHEN diff <= e3 THEN 3 ELSE 4 END AS bucket, count(*) AS n, avg(y) AS rate FROM one, e GROUP BY 1)
        SELECT bucket, n, round(rate, 6) AS rate, round(1.96::DOUBLE * sqrt(rate * (1 - rate) / n), 6) AS half_width FROM t""",
}
