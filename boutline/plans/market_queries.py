"""Queries over quotes and the ledger, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutline.functions import odds
from boutline.operators import market
from boutline.plans.career_queries import rounded
from boutline.sources import views
from boutline.sources.views import table, with_views

Q = with_views("quotes")
LAST = f"{Q}, last AS (SELECT pair, source, arg_max(p1, (snap, quote_id)) AS p1, arg_max(o1, (snap, quote_id)) AS o1, arg_max(o2, (snap, quote_id)) AS o2 FROM quotes GROUP BY 1, 2)"
LEDGER = f"""{Q}, ledger AS (SELECT date_trunc('day', snap) AS captured, source AS venue, pair, quote_id, p1,
    row_number() OVER (PARTITION BY pair, source ORDER BY snap, quote_id) = 1 AS opening, 1 / o1 * (1 + 0.0185::DOUBLE) AS implied,
    greatest(0.02::DOUBLE, least(0.98::DOUBLE, p1 + (quote_id % 7 - 3) / 50.0::DOUBLE)) AS p_model FROM quotes),
    clean AS (SELECT captured, venue, pair, max(quote_id) AS quote_id, arg_max(p1, quote_id) AS p1, arg_max(implied, quote_id) AS implied,
    arg_max(p_model, quote_id) AS p_model, bool_or(opening) AS opening FROM ledger GROUP BY 1, 2, 3)"""


def moneyline_best(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.consensus(views.quotes(spark, sf)), ["pair", "sources"], ["best_o1", "best_o2"])


def moneyline_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.consensus(views.quotes(spark, sf)), ["pair"], ["median_p1"])


def upper_median(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.consensus(views.quotes(spark, sf)), ["pair"], ["upper_p1"])


def method_market_devig(spark: SparkSession, sf: str) -> DataFrame:
    """Six legs from the first six lines of an order, devigged together."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    legs = table(spark, sf, "lineitem").select("l_orderkey", (1 + F.col("l_quantity") / 5).alias("odds"), F.row_number().over(w).alias("leg")).where("leg <= 6")
    out = legs.groupBy("l_orderkey").agg(F.count("*").alias("legs"), F.sum(1 / F.col("odds")).alias("total"), F.max(F.when(F.col("leg") == 1, 1 / F.col("odds"))).alias("first"))
    out = out.where("legs = 6").select("l_orderkey", (F.col("first") / F.col("total")).alias("p_first"), (F.col("total") - 1).alias("overround"))
    return rounded(out, ["l_orderkey"], ["p_first", "overround"])


def line_movement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.line_movement(views.quotes(spark, sf)), ["pair", "source", "snaps"], ["open_p", "close_p", "drift", "span_days"])


def american_odds(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.quotes(spark, sf).select("quote_id", (odds.decimal_to_american(F.col("o1"))).alias("american"))
    return rounded(rows.withColumn("p", odds.american_to_prob(F.col("american"))), ["quote_id"], ["american", "p"])


def fair_odds(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.quotes(spark, sf).select("quote_id", odds.fair_decimal(F.col("p1")).alias("fair_decimal"), odds.fair_american(F.col("p1")).alias("fair_american"))
    return rounded(rows, ["quote_id"], ["fair_decimal", "fair_american"])


def ledger_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = market.dedupe(market.ledger_rows(views.quotes(spark, sf)))
    rows = rows.select(F.date_format("captured", "yyyy-MM-dd").alias("captured"), "venue", "pair", "quote_id", F.col("opening").cast("int").alias("opening"), "p1", "implied")
    return rounded(rows, ["captured", "venue", "pair", "quote_id", "opening"], ["p1", "implied"])


def ledger_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = market.report(market.dedupe(market.ledger_rows(views.quotes(spark, sf))), F.col("quote_id") % 2 == 0)
    return rounded(rows, ["venue", "bets"], ["clv", "roi", "se"])


def settle_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.bouts(spark, sf)
    claims = rows.select(F.col("bout_id").alias("claim_id"), F.date_add("dt", (F.col("bout_id") % 9 - 4).cast("int")).alias("claim_dt"), F.col("r_id").alias("a"), F.col("b_id").alias("b"))
    return market.settle(claims, rows)


def latest_prices(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(market.latest_prices(views.quotes(spark, sf), 72, 48), ["pair", "source"], ["p1"])


def json_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Two payload shapes in one column: an object with ``k``, or nothing usable."""
    k = F.from_json("props", "k double")["k"]
    rows = table(spark, sf, "events").select("event_id", "event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.round(F.avg("k"), 6).alias("mean_k"), F.round(F.max("k"), 6).alias("max_k"))


def quote_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes that pass each gate in turn: undecided, narrow spread, after the first day; fail closed on null."""
    q = views.quotes(spark, sf).withColumn("spread", odds.overround(F.col("o1"), F.col("o2")))
    first = F.broadcast(q.agg(F.min("snap").alias("first")))
    undecided, narrow = F.col("p1").between(0.02, 0.98), F.col("spread") <= 0.06
    late = F.datediff("snap", "first") >= 1
    cells = q.join(first).groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(undecided).alias("undecided"), F.count_if(undecided & narrow).alias("narrow"), F.count_if(undecided & narrow & late).alias("kept"),
        F.round(F.expr("percentile(spread, 0.5)"), 6).alias("median_overround"),
    )
    return cells


def coverage_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs priced by the first source where it covers half of all pairs, else by any source's last quote."""
    last = market.last_per_source(views.quotes(spark, sf))
    lead = last.where("source = 'purchase'").select("pair", F.col("p1").alias("lead_p"))
    anyone = last.groupBy("pair").agg(F.min_by("p1", "source").alias("any_p"))
    rows = anyone.join(lead, "pair", "left")
    share = F.broadcast(rows.agg((F.count("lead_p") / F.count("*")).alias("share")))
    chosen = F.when(F.col("share") >= 0.5, F.coalesce("lead_p", "any_p")).otherwise(F.col("any_p"))
    return rounded(rows.join(share).select("pair", "share", chosen.alias("p1")), ["pair"], ["share", "p1"])


def open_price_either_side(spark: SparkSession, sf: str) -> DataFrame:
    """The opening price of a bout's pair, or one minus that of the reversed pair."""
    opening = views.quotes(spark, sf).groupBy(F.col("pair").alias("k")).agg(F.min_by("p1", F.struct("snap", "quote_id")).alias("p"))
    rows = views.bouts(spark, sf).select("bout_id", (F.col("r_id") % 50).alias("ka"), (F.col("b_id") % 50 + 25).alias("kb"))
    direct, turned = opening.select(F.col("k").alias("ka"), F.col("p").alias("pa")), opening.select(F.col("k").alias("kb"), F.col("p").alias("pb"))
    out = rows.join(direct, "ka", "left").join(turned, "kb", "left")
    return rounded(out.select("bout_id", F.coalesce("pa", 1 - F.col("pb")).alias("p_open")), ["bout_id"], ["p_open"])


def best_market_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The best market of a pair by kind, then volume, then feed order."""
    rank = F.when(F.col("source") == "purchase", 3).when(F.col("source") == "click", 2).otherwise(1)
    rows = views.quotes(spark, sf)
    best = rows.groupBy("pair").agg(F.max_by(F.struct("quote_id", "source"), F.struct(rank, F.round(F.col("o2"), 6), -F.col("quote_id"))).alias("m"))
    return best.select("pair", "m.quote_id", "m.source")


def new_keys_only(spark: SparkSession, sf: str) -> DataFrame:
    rows = market.ledger_rows(views.quotes(spark, sf))
    known = rows.where("dayofmonth(captured) <= 15")
    out = market.new_keys(rows, known)
    return out.select(F.date_format("captured", "yyyy-MM-dd").alias("captured"), "venue", "pair", "quote_id")


def market_prob_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A market's model probability from its parts, nulls left out of the sum, and the Eastern date of its start."""
    a, b = F.when(F.col("event_id") % 3 > 0, F.col("value") / 1000), F.when(F.col("event_id") % 5 > 0, F.col("value") / 2000)
    total = F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    day = F.date_format(F.from_utc_timestamp("ts", "America/New_York"), "yyyy-MM-dd")
    return rounded(table(spark, sf, "events").select("event_id", day.alias("event_day"), total.alias("p")), ["event_id", "event_day"], ["p"])


QUERIES = {
    f.__name__: f
    for f in (
        moneyline_best, moneyline_median, upper_median, method_market_devig, line_movement, american_odds, fair_odds, ledger_dedupe, ledger_report, settle_asof,
        latest_prices, json_quotes, quote_gates, coverage_fallback, open_price_either_side, best_market_ranked, new_keys_only, market_prob_parts,
    )
}

ORACLES = {
    "moneyline_best": f"{LAST} SELECT pair, count(DISTINCT source) AS sources, round(max(o1), 6) AS best_o1, round(max(o2), 6) AS best_o2 FROM last GROUP BY pair",
    "moneyline_median": f"{LAST} SELECT pair, round(quantile_cont(p1, 0.5), 6) AS median_p1 FROM last GROUP BY pair",
    "upper_median": f"""{LAST}, r AS (SELECT pair, p1, row_number() OVER (PARTITION BY pair ORDER BY p1) - 1 AS k, count(*) OVER (PARTITION BY pair) AS n FROM last)
        SELECT pair, round(p1, 6) AS upper_p1 FROM r WHERE k = n // 2""",
    "method_market_devig": """WITH r AS (SELECT l_orderkey, 1 / (1 + l_quantity / 5) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS leg FROM lineitem),
        g AS (SELECT l_orderkey, count(*) AS legs, sum(q) AS total, max(CASE WHEN leg = 1 THEN q END) AS first FROM r WHERE leg <= 6 GROUP BY 1)
        SELECT l_orderkey, round(first / total, 6) AS p_first, round(total - 1, 6) AS overround FROM g WHERE legs = 6""",
    "line_movement": f"""{Q}, m AS (SELECT pair, source, count(DISTINCT snap) AS snaps, arg_min(p1, (snap, quote_id)) AS open_p, arg_max(p1, (snap, quote_id)) AS close_p,
        (epoch_us(max(snap)) - epoch_us(min(snap))) / 86400e6 AS span_days FROM quotes GROUP BY 1, 2)
        SELECT pair, source, snaps, round(open_p, 6) AS open_p, round(close_p, 6) AS close_p, round(close_p - open_p, 6) AS drift, round(span_days, 6) AS span_days FROM m WHERE snaps >= 3""",
    "american_odds": f"""{Q}, a AS (SELECT quote_id, CASE WHEN o1 >= 2 THEN round((o1 - 1) * 100) ELSE round(-100 / (o1 - 1)) END AS american FROM quotes)
        SELECT quote_id, round(american, 6) AS american, round(CASE WHEN american < 0 THEN -american / (100 - american) ELSE 100 / (american + 100) END, 6) AS p FROM a""",
    "fair_odds": f"""{Q} SELECT quote_id, round(CASE WHEN p1 > 0 AND p1 < 1 THEN 1 / p1 END, 6) AS fair_decimal,
        round(CASE WHEN p1 > 0 AND p1 < 0.5 THEN 100 * (1 - p1) / p1 WHEN p1 >= 0.5 AND p1 < 1 THEN -100 * p1 / (1 - p1) END, 6) AS fair_american FROM quotes""",
    "ledger_dedupe": f"""{LEDGER} SELECT strftime(captured, '%Y-%m-%d') AS captured, venue, pair, quote_id, CAST(opening AS INTEGER) AS opening, round(p1, 6) AS p1, round(implied, 6) AS implied FROM clean""",
    "ledger_report": f"""{LEDGER}, f AS (SELECT venue, pair, arg_min(implied, (captured, quote_id)) AS implied, arg_min(p1, (captured, quote_id)) AS p1,
        arg_min(p_model - implied, (captured, quote_id)) AS edge, arg_min(quote_id, (captured, quote_id)) AS qid, arg_max(p1, (captured, quote_id)) AS close FROM clean GROUP BY 1, 2),
        b AS (SELECT venue, close - p1 AS clv, CASE WHEN qid % 2 = 0 THEN 1 / implied - 1 ELSE -1.0::DOUBLE END AS gain FROM f WHERE edge > 0.02 AND implied >= 0.5)
        SELECT venue, count(*) AS bets, round(avg(clv), 6) AS clv, round(avg(gain), 6) AS roi, round(stddev_samp(gain) / sqrt(count(*)), 6) AS se FROM b GROUP BY venue""",
    "settle_asof": f"""{with_views('bouts')}, c AS (SELECT bout_id AS claim_id, dt + CAST(bout_id % 9 - 4 AS INTEGER) AS claim_dt, r_id AS a, b_id AS b FROM bouts),
        m AS (SELECT claim_id, a, o.bout_id, abs(date_diff('day', o.dt, claim_dt)) AS gap, winner, r_id,
              row_number() OVER (PARTITION BY claim_id ORDER BY abs(date_diff('day', o.dt, claim_dt)), o.dt, o.bout_id) AS k
              FROM c JOIN bouts o ON least(a, b) = least(r_id, b_id) AND greatest(a, b) = greatest(r_id, b_id) AND abs(date_diff('day', o.dt, claim_dt)) <= 4)
        SELECT c.claim_id, m.bout_id, m.gap, CASE WHEN winner IN ('r', 'b') THEN CAST((winner = 'r') = (r_id = m.a) AS INTEGER) END AS hit
        FROM c LEFT JOIN m ON c.claim_id = m.claim_id AND k = 1""",
    "latest_prices": f"""{Q}, l AS (SELECT pair, source, max(snap) AS snap, arg_max(p1, (snap, quote_id)) AS p1 FROM quotes GROUP BY 1, 2), s AS (SELECT source, max(snap) AS sweep FROM l GROUP BY 1)
        SELECT pair, l.source, round(p1, 6) AS p1 FROM l JOIN s ON l.source = s.source
        WHERE snap >= greatest((SELECT max(snap) FROM quotes) - INTERVAL 72 HOUR, sweep - INTERVAL 48 HOUR)""",
    "json_quotes": """SELECT event_type, count(*) AS n, count(k) AS with_k, round(avg(k), 6) AS mean_k, round(max(k), 6) AS max_k
        FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1""",
    "quote_gates": f"""{Q}, s AS (SELECT *, 1 / o1 + 1 / o2 - 1 AS spread, p1 BETWEEN 0.02 AND 0.98 AS u, 1 / o1 + 1 / o2 - 1 <= 0.06 AS nr,
        date_diff('day', CAST((SELECT min(snap) FROM quotes) AS DATE), CAST(snap AS DATE)) >= 1 AS late FROM quotes)
        SELECT source, count(*) AS n, count(*) FILTER (WHERE u) AS undecided, count(*) FILTER (WHERE u AND nr) AS narrow, count(*) FILTER (WHERE u AND nr AND late) AS kept,
               round(quantile_cont(spread, 0.5), 6) AS median_overround FROM s GROUP BY source""",
    "coverage_fallback": f"""{LAST}, a AS (SELECT pair, arg_min(p1, source) AS any_p, max(CASE WHEN source = 'purchase' THEN p1 END) AS lead_p FROM last GROUP BY 1),
        s AS (SELECT count(lead_p) / CAST(count(*) AS DOUBLE) AS share FROM a)
        SELECT pair, round(share, 6) AS share, round(CASE WHEN share >= 0.5 THEN coalesce(lead_p, any_p) ELSE any_p END, 6) AS p1 FROM a, s""",
    "open_price_either_side": f"""{with_views('bouts', 'quotes')}, o AS (SELECT pair, arg_min(p1, (snap, quote_id)) AS p FROM quotes GROUP BY 1)
        SELECT bout_id, round(coalesce(x.p, 1 - y.p), 6) AS p_open FROM bouts LEFT JOIN o x ON r_id % 50 = x.pair LEFT JOIN o y ON b_id % 50 + 25 = y.pair""",
    "best_market_ranked": f"""{Q}, r AS (SELECT pair, quote_id, source, row_number() OVER (PARTITION BY pair ORDER BY CASE source WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, round(o2, 6) DESC, quote_id) AS k FROM quotes)
        SELECT pair, quote_id, source FROM r WHERE k = 1""",
    "new_keys_only": f"""{LEDGER} SELECT strftime(captured, '%Y-%m-%d') AS captured, venue, pair, quote_id FROM ledger l
        WHERE NOT EXISTS (SELECT 1 FROM ledger k WHERE day(k.captured) <= 15 AND k.captured = l.captured AND k.venue = l.venue AND k.pair = l.pair)""",
    "market_prob_parts": """SELECT event_id, strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS event_day,
        round(CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN NULL ELSE CASE WHEN event_id % 3 > 0 THEN value / 1000 ELSE 0 END + CASE WHEN event_id % 5 > 0 THEN value / 2000 ELSE 0 END END, 6) AS p FROM events""",
}
