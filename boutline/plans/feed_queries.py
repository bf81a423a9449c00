"""Queries of the capture side and of text told apart by patterns, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boutline.functions import odds, text
from boutline.operators import feed, names
from boutline.plans.bout_queries import APP, B, app
from boutline.plans.career_queries import rounded
from boutline.sources import files, views
from boutline.sources.scratch import scratch_folder
from boutline.sources.views import bouts, table, with_views


def capture_gate(spark: SparkSession, sf: str) -> DataFrame:
    """For each day at midnight: is a paid call worth it? The list shows pairs that start within three days."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("pair"), F.col("ts").cast("timestamp").alias("starts"), "event_type")
    first = rows.groupBy("pair").agg(F.min("starts").alias("first_seen"))
    day = F.date_trunc("day", "starts")
    shown = rows.select("pair", "starts", F.explode(F.array(*[day - F.expr(f"interval {k} days") for k in range(3)])).alias("now")).where("starts > now")
    days = rows.select(day.alias("now")).distinct()  # a row per day
    paid = rows.where("event_type = 'purchase'").groupBy(F.date_add(F.to_date("starts"), 1).cast("timestamp").alias("after")).agg(F.max("starts").alias("paid"))
    last = days.join(F.broadcast(paid), F.col("after") <= F.col("now"), "left").groupBy("now").agg(F.max("paid").alias("last_paid"))
    out = feed.gate(shown.join(first, "pair"), last)
    return out.select(F.date_format("now", "yyyy-MM-dd").alias("day"), "paid", "reason")


def pruned_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """What a reader of the ledger leaves out, by venue and reason, outside of a broken window."""
    rows = views.quotes(spark, sf).withColumn("pair", F.when(F.col("quote_id") % 13 > 0, F.col("pair")))
    rows = feed.pruned(feed.outside_window(rows, "click", "2024-01-10", "2024-01-12"), ["pair"], 0.3)
    return rows.groupBy("source", F.coalesce("dropped", F.lit("kept")).alias("why")).agg(F.count("*").alias("n"))


def liquidity_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Markets that pass spread, depth and volume; a gate that is not known fails."""
    q = views.quotes(spark, sf)
    depth, volume = F.when(F.col("quote_id") % 6 > 0, F.col("quote_id") % 500), F.when(F.col("quote_id") % 9 > 0, F.col("pair") * 10)
    ok = feed.liquid(odds.overround(F.col("o1"), F.col("o2")), depth, volume, 0.06, 250, 100)
    return q.groupBy("source").agg(F.count("*").alias("n"), F.count_if(ok).alias("liquid"))


def payload_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Sides of markets from two payload shapes, with the validity of their quotes."""
    rows = table(spark, sf, "events").select("event_id", F.round(F.get_json_object("props", "$.k").cast("double") / 100, 2).alias("k"))
    i = F.col("event_id")
    bid, ask = F.col("k"), F.round(F.col("k") + F.when(i % 4 == 0, -0.05).otherwise(0.03), 2)
    one = F.to_json(F.struct(F.array(F.struct(F.lit("yes").alias("description"), F.struct(bid.alias("bid"), ask.alias("ask")).alias("quote"), F.lit(0.5).alias("price"))).alias("marketSides")))
    two = F.to_json(F.struct(F.lit('["yes","no"]').alias("outcomes"), F.concat(F.lit('["'), F.col("k").cast("string"), F.lit('","x"]')).alias("outcomePrices")))
    payload = F.when(i % 3 == 0, one).when(i % 3 == 1, two).otherwise(F.lit("{}"))
    told = rows.select("event_id", F.inline(feed.sides_of(payload)))
    return rounded(told, ["event_id", "name"], ["bid", "ask", "mid"])


def order_book(spark: SparkSession, sf: str) -> DataFrame:
    """Best bid and ask, spread, and depth within five cents of the best, per market, from the levels of its book."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("market"), F.when(F.col("event_type").isin("click", "view"), "bid").otherwise("ask").alias("side"), F.get_json_object("props", "$.k").cast("double").alias("k"), F.col("value").alias("size"))
    price = F.round(F.when(F.col("side") == "bid", F.col("k") / 250).otherwise(0.5 + F.col("k") / 250), 3)
    rows = rows.select("market", "side", price.alias("price"), "size")
    best = rows.groupBy("market").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"))
    near = F.when(F.col("side") == "bid", F.round(F.col("bid") - F.col("price"), 3) <= 0.05).otherwise(F.round(F.col("price") - F.col("ask"), 3) <= 0.05)
    depth = rows.join(best, "market").where(near).groupBy("market").agg(F.sum("size").alias("depth"))
    return rounded(best.join(depth, "market", "left").withColumn("spread", F.col("ask") - F.col("bid")), ["market"], ["bid", "ask", "spread", "depth"])


def feed_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """What a feed holds: rows and keys by kind and hour, the fourteen largest."""
    rows = table(spark, sf, "events").groupBy("event_type", F.hour(F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("pairs"))
    return rows.orderBy(F.col("n").desc(), "event_type", "hour").limit(14)


def label_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Labels by status: how many, and how many of them have a document."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id", "left")
    return rows.groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"))


def debut_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """By year of an entity's first bout: entities, and the share of them with ten bouts."""
    rows = app(spark, sf).groupBy("entity").agg(F.year(F.min("dt")).alias("year"), F.count("*").alias("n"))
    return rounded(rows.groupBy("year").agg(F.count("*").alias("entities"), F.avg((F.col("n") >= 10).cast("double")).alias("covered")), ["year", "entities"], ["covered"])


def used_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of either corner, each once."""
    rows = bouts(spark, sf)
    return rows.select(F.col("r_id").alias("id")).union(rows.select("b_id")).distinct()


def collection_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Whom to collect next: on the next card, then thin ones, then the busiest, then all others; within a budget, without those done."""
    rows = app(spark, sf)
    last = F.broadcast(rows.agg(F.max("event").alias("event")))
    per = rows.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("n"), F.max("dt").alias("dt"))
    groups = [rows.join(last, "event").select(F.col("entity").alias("id")), per.where("n < 200"), per.where("n % 5 = 0"), per]
    return feed.candidates(groups, per.where("id % 7 = 0"), 40).select("id", F.col("rank").cast("int").alias("rank"))


def throttle_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that a throttle of a day per kind and user lets through."""
    rows = table(spark, sf, "events").select("event_id", F.concat_ws("/", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    kept = feed.throttled(rows, "key", "event_id", "ts", 1440)
    return kept.groupBy("key").agg(F.count("*").alias("calls"), F.sum("event_id").alias("ids"))


def record_probe(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a source's pages a pattern finds: counts by pattern, and the share of pages with any."""
    html = F.coalesce("html", F.lit(""))
    hits = {"links": r"<a\s", "items": r"<li>", "numbers": r"\b\d{2,4}\b"}
    rows = table(spark, sf, "pages").select(*[F.regexp_count(html, F.lit(p)).alias(k) for k, p in hits.items()])
    out = rows.agg(F.count("*").alias("pages"), *[F.sum(k).alias(k) for k in hits], *[F.avg((F.col(k) > 0).cast("double")).alias(f"{k}_share") for k in hits])
    return rounded(out, ["pages", *hits], [f"{k}_share" for k in hits])


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The id at the end of a url, and the slug of the whole."""
    return table(spark, sf, "pages").select("page_id", text.url_tail(F.col("url")).alias("tail"), text.slug(F.col("url")).alias("slug"))


def letter_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Names in lower letters and blanks alone, and the titles a page about them may have."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" No. "), F.col("p_size").cast("string")).alias("name"))
    return rows.select("p_partkey", text.letters_only(F.col("name")).alias("key"), F.array_join(text.titles(F.col("name")), "|").alias("titles"))


def mixed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Days written in five notations and read again, with ages and layoffs."""
    formats = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "d MMMM yyyy")
    i, day = F.col("o_orderkey"), F.col("o_orderdate")
    written = F.when(i % 7 == 5, "--")
    for k, f in enumerate(formats):
        written = written.when(i % 7 == k, F.date_format(day, f))
    rows = table(spark, sf, "orders").select("o_orderkey", text.mixed_date(written).alias("day"))
    born = F.when(F.col("o_orderkey") % 4 > 0, F.date_add(F.lit("1965-01-01").cast("date"), (F.col("o_orderkey") % 3000).cast("int")))
    return rounded(rows.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), text.age_years(F.col("day"), born).alias("age")), ["o_orderkey", "day"], ["age"])


def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names without footnotes and champion's marks, shown by a preferred spelling and in a given order of corners."""
    i = F.col("s_suppkey")
    raw = F.concat(F.lit(" "), F.col("s_name"), F.when(i % 3 == 0, "[12]").when(i % 3 == 1, " (C)").otherwise(" (ic) [a]"), F.lit("  Jr. "))
    rows = table(spark, sf, "supplier").select("s_suppkey", text.clean_name(raw).alias("name"))
    display = table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lower("s_name"), F.lit(" jr")).alias("key"), F.concat(F.lit("Mr. "), "s_name").alias("shown"))
    shown = names.displayed(rows, "name", display)
    first = F.lit("Supplier#000000002")
    a, b = names.in_corner_order(F.col("shown"), first, F.array(first))
    return shown.select("s_suppkey", "name", "shown", a.alias("a"), b.alias("b"))


def methods_mentioned(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that mention two ways to end or more."""
    rows = app(spark, sf).groupBy("entity", "event").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("won by "), F.lower("method")))), "; ").alias("story"))  # three at most
    return rows.select("entity", F.date_format("event", "yyyy-MM-dd").alias("event"), text.methods_in(F.col("story")).alias("kinds"), (text.methods_in(F.col("story")) >= 2).cast("int").alias("told"))


def folded_names(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that spelling does not change: letters that do not decompose, accents, suffixes anywhere, ``St.`` for ``Saint``, marks between words."""
    i = F.col("s_suppkey")
    raw = F.when(i % 5 == 0, "Jan Błach-owicz Jr. III").when(i % 5 == 1, "Ovince St. Preux").when(i % 5 == 2, "Straße  O'Đør").when(i % 5 == 3, "Antônio Æsop II").otherwise(F.concat(F.lit("Side "), i.cast("string")))
    return table(spark, sf, "supplier").select("s_suppkey", text.folded(raw).alias("key"))


def award_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Award names held against who fought on the card: as written, without blanks, with the parts swapped, or unknown; and how many awards have two."""
    rows = app(spark, sf)
    name = lambda c: F.concat(F.lit("ann side"), F.col(c).cast("string"))
    told = rows.select("event", "bout_id", "entity", name("entity").alias("name"))
    told = told.select("event", "bout_id", F.when(F.col("entity") % 4 == 0, F.col("name")).when(F.col("entity") % 4 == 1, F.replace("name", F.lit(" "), F.lit(""))).when(F.col("entity") % 4 == 2, F.concat(F.split_part("name", F.lit(" "), F.lit(2)), F.lit(" ann"))).otherwise("nobody").alias("name"))
    card = rows.select("event", name("entity").alias("key")).distinct()
    checked = names.on_card(told, card)
    out = checked.groupBy("event", "how").agg(F.count("*").alias("n"))
    return out.select(F.date_format("event", "yyyy-MM-dd").alias("event"), "how", "n")


def page_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page is the entity's: of the days that it claims, at least two (or all, if fewer) are within two days of a bout of the entity."""
    rows = app(spark, sf).select("entity", "bout_id", "dt")
    claims = rows.select("entity", F.col("bout_id").alias("claim"), F.date_add("dt", (F.col("bout_id") % 6).cast("int")).alias("day"))
    days = claims.withColumn("near", F.explode(F.sequence(F.date_sub("day", 2), F.date_add("day", 2))))
    hits = days.join(rows.select("entity", F.col("dt").alias("near")).distinct(), ["entity", "near"]).groupBy("entity").agg(F.countDistinct("claim").alias("hits"))
    out = claims.groupBy("entity").agg(F.count("*").alias("n")).join(hits, "entity", "left").select("entity", "n", F.coalesce("hits", F.lit(0)).alias("hits"))
    return out.withColumn("accepted", (F.col("hits") >= F.least(F.lit(2), F.col("n"))).cast("int"))


def market_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of a question by the first pattern that fits, and the key of its market."""
    i = F.col("p_partkey")
    asked = F.when(i % 7 == 0, "Will Ann vs. Bea go the distance?").when(i % 7 == 1, "Ann to win by KO or TKO").when(i % 7 == 2, "Ann by submission").when(i % 7 == 3, "Over 2.5 rounds, Ann vs. Bea").when(i % 7 == 4, "Who wins Ann vs. Bea?").when(i % 7 == 5, "Fight ends before Round 3 begins").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", text.market_class(asked).alias("kind"), text.market_key(asked).alias("market"))


def quota_left(spark: SparkSession, sf: str) -> DataFrame:
    """Credits that paid calls have used by each day of a month, from the usage log, and what is left of the month's."""
    calls = table(spark, sf, "events").where("event_type = 'purchase'").select(F.to_date(F.col("ts").cast("timestamp")).alias("day"))
    days = calls.groupBy("day").agg((3 * F.count("*")).alias("cost"))  # a row per day
    w = Window.partitionBy(F.date_trunc("month", "day")).orderBy("day")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("cost").over(w).alias("used"), F.greatest(F.lit(0), 500 - F.sum("cost").over(w)).alias("left"))


def archived_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards that are over, each frozen once under the slug of its name: a second run with other rows changes none."""
    root, rows = scratch_folder(spark), bouts(spark, sf)
    now = F.broadcast(rows.agg(F.add_months(F.max("event"), -3).alias("now")))
    name = F.concat(F.lit("Night: "), F.date_format("event", "MMMM yyyy"), F.lit("!"))
    over = rows.join(now).where("event < now").groupBy("event").agg(F.count("*").alias("n")).select(text.slug(name).alias("card"), "n")
    files.archive(over, "card", f"{root}/cards")
    files.archive(over.withColumn("n", F.lit(0).cast("long")), "card", f"{root}/cards")
    return spark.read.schema("n long, card string").json(f"{root}/cards").select("card", "n")


QUERIES = {
    f.__name__: f
    for f in (
        capture_gate, pruned_ledger, liquidity_gates, payload_sides, order_book, feed_inventory, label_stats, debut_coverage, used_ids, collection_queue, throttle_calls, record_probe, url_parts,
        letter_keys, mixed_dates, clean_names, methods_mentioned, folded_names, award_validation, page_accepted, market_classes, quota_left, archived_cards,
    )
}

_Q = with_views("quotes")
ORACLES = {
    "capture_gate": """WITH e AS (SELECT user_id AS pair, ts AS starts, event_type FROM events), f AS (SELECT pair, min(starts) AS first FROM e GROUP BY 1), d AS (SELECT DISTINCT date_trunc('day', starts) AS now FROM e),
        l AS (SELECT now, (SELECT max(starts) FROM e WHERE event_type = 'purchase' AND date_trunc('day', starts) < now) AS paid FROM d),
        b AS (SELECT d.now, count(*) AS listed, count(*) FILTER (WHERE f.first > d.now) AS new, count(*) FILTER (WHERE starts <= d.now + INTERVAL 48 HOUR) AS near FROM d JOIN e ON starts > d.now AND date_trunc('day', starts) < d.now + INTERVAL 3 DAY JOIN f ON e.pair = f.pair GROUP BY 1),
        s AS (SELECT l.now, coalesce((epoch_us(l.now) - epoch_us(paid)) / 3.6e9, 1e9) AS since, coalesce(listed, 0) AS listed, new, near FROM l LEFT JOIN b ON l.now = b.now),
        r AS (SELECT now, CASE WHEN since * 60 < 60 THEN 'throttled' WHEN listed = 0 THEN 'nothing listed' WHEN new > 0 THEN 'new' WHEN near > 0 THEN 'near' WHEN since >= 20 THEN 'baseline' ELSE 'unchanged' END AS reason FROM s)
        SELECT strftime(now, '%Y-%m-%d') AS day, CAST(reason IN ('new', 'near', 'baseline') AS INTEGER) AS paid, reason FROM r""",
    "pruned_ledger": f"""{_Q} SELECT source, CASE WHEN quote_id % 13 = 0 THEN 'no key' WHEN p1 < 0.3 OR p1 > 0.7 THEN 'certain' ELSE 'kept' END AS why, count(*) AS n FROM quotes
        WHERE NOT (source = 'click' AND snap >= TIMESTAMP '2024-01-10' AND snap < TIMESTAMP '2024-01-12') GROUP BY 1, 2""",
    "liquidity_gates": f"{_Q} SELECT source, count(*) AS n, count(*) FILTER (WHERE 1 / o1 + 1 / o2 - 1 <= 0.06 AND quote_id % 6 > 0 AND quote_id % 500 >= 250 AND quote_id % 9 > 0 AND pair * 10 >= 100) AS liquid FROM quotes GROUP BY 1",
    "payload_sides": """WITH k AS (SELECT event_id, round(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100, 2) AS k FROM events), q AS (SELECT *, round(k + CASE WHEN event_id % 4 = 0 THEN -0.05 ELSE 0.03 END, 2) AS ask FROM k)
        SELECT event_id, 'yes' AS name, k AS bid, ask, round(CASE WHEN k <= ask AND ask <= 1 THEN (k + ask) / 2 ELSE 0.5 END, 6) AS mid FROM q WHERE event_id % 3 = 0
        UNION ALL SELECT event_id, 'yes', NULL, NULL, k FROM q WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'no', NULL, NULL, NULL FROM q WHERE event_id % 3 = 1""",
    "order_book": """WITH r AS (SELECT user_id AS market, event_type IN ('click', 'view') AS bids, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value AS size FROM events),
        p AS (SELECT market, bids, size, round(CASE WHEN bids THEN k / 250 ELSE 0.5::DOUBLE + k / 250 END, 3) AS price FROM r), b AS (SELECT market, max(CASE WHEN bids THEN price END) AS bid, min(CASE WHEN NOT bids THEN price END) AS ask FROM p GROUP BY 1),
        d AS (SELECT p.market, sum(size) AS depth FROM p JOIN b ON p.market = b.market WHERE CASE WHEN bids THEN round(bid - price, 3) <= 0.05 ELSE round(price - ask, 3) <= 0.05 END GROUP BY 1)
        SELECT b.market, round(bid, 6) AS bid, round(ask, 6) AS ask, round(ask - bid, 6) AS spread, round(depth, 6) AS depth FROM b LEFT JOIN d ON b.market = d.market""",
    "feed_inventory": "SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, count(DISTINCT user_id) AS pairs FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, hour LIMIT 14",
    "label_stats": "SELECT quality, toxic, lang, count(*) AS n FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2, 3",
    "debut_coverage": f"{APP}, f AS (SELECT entity, CAST(year(min(dt)) AS INTEGER) AS year, count(*) AS n FROM app GROUP BY 1) SELECT year, count(*) AS entities, round(avg(CASE WHEN n >= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS covered FROM f GROUP BY 1",
    "used_ids": f"{B} SELECT r_id AS id FROM bouts UNION SELECT b_id FROM bouts",
    "collection_queue": f"""{APP}, per AS (SELECT entity AS id, count(*) AS n FROM app GROUP BY 1), g AS (SELECT entity AS id, 0 AS rank FROM app WHERE event = (SELECT max(event) FROM app) UNION ALL SELECT id, 1 FROM per WHERE n < 200
        UNION ALL SELECT id, 2 FROM per WHERE n % 5 = 0 UNION ALL SELECT id, 3 FROM per) SELECT id, min(rank) AS rank FROM g WHERE id % 7 > 0 GROUP BY 1 ORDER BY 2, 1 LIMIT 40""",
    "throttle_calls": """WITH RECURSIVE k AS (SELECT user_id || '/' || event_type AS key, ts, event_id FROM events), p AS (SELECT key, min(ts) AS ts FROM k GROUP BY 1
            UNION ALL SELECT k.key, min(k.ts) FROM p JOIN k ON p.key = k.key AND epoch_us(k.ts) - epoch_us(p.ts) >= 86400000000 GROUP BY 1)
        SELECT key, count(*) AS calls, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT p.key, p.ts, min(event_id) AS id FROM p JOIN k ON p.key = k.key AND p.ts = k.ts GROUP BY 1, 2) GROUP BY 1""",
    "record_probe": r"""WITH c AS (SELECT len(regexp_extract_all(coalesce(html, ''), '<a\s')) AS links, len(regexp_extract_all(coalesce(html, ''), '<li>')) AS items, len(regexp_extract_all(coalesce(html, ''), '\b\d{2,4}\b')) AS numbers FROM pages)
        SELECT count(*) AS pages, CAST(sum(links) AS BIGINT) AS links, CAST(sum(items) AS BIGINT) AS items, CAST(sum(numbers) AS BIGINT) AS numbers, round(avg(CAST(links > 0 AS DOUBLE)), 6) AS links_share, round(avg(CAST(items > 0 AS DOUBLE)), 6) AS items_share,
        round(avg(CAST(numbers > 0 AS DOUBLE)), 6) AS numbers_share FROM c""",
    "url_parts": "SELECT page_id, string_split(url, '/')[-1] AS tail, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM pages",
    "letter_keys": r"""WITH n AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' No. ' || p_size AS name FROM part)
        SELECT p_partkey, regexp_replace(lower(name), '[^a-z ]', '', 'g') AS key, replace(name, ' ', '_') || '|' || replace(name, ' ', '_') || '_(fighter)|' || replace(regexp_replace(name, ' No\. .*$', ''), ' ', '_') AS titles FROM n""",
    "mixed_dates": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
        round(CASE WHEN o_orderkey % 7 < 5 AND o_orderkey % 4 > 0 THEN date_diff('day', DATE '1965-01-01' + CAST(o_orderkey % 3000 AS INTEGER), CAST(o_orderdate AS DATE)) / 365.25::DOUBLE ELSE 30.0::DOUBLE END, 6) AS age FROM orders""",
    "clean_names": """WITH s AS (SELECT s_suppkey, s_name || ' Jr' AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'Mr. ' || s_name ELSE s_name || ' Jr' END AS shown FROM supplier)
        SELECT s_suppkey, name, shown, CASE WHEN true THEN 'Supplier#000000002' END AS a, shown AS b FROM s""",
    "methods_mentioned": f"""{APP}, g AS (SELECT entity, event, count(DISTINCT method) AS kinds FROM app GROUP BY 1, 2) SELECT entity, CAST(event AS VARCHAR) AS event, CAST(kinds AS INTEGER) AS kinds, CAST(kinds >= 2 AS INTEGER) AS told FROM g""",
    "folded_names": "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'jan blach owicz' WHEN 1 THEN 'ovince saint preux' WHEN 2 THEN 'strasse o dor' WHEN 3 THEN 'antonio aesop' ELSE 'side' END AS key FROM supplier",
    "award_validation": f"""{APP}, t AS (SELECT event, CASE entity % 4 WHEN 0 THEN 'as written' WHEN 1 THEN 'without blanks' WHEN 2 THEN 'swapped' ELSE 'unknown' END AS how FROM app) SELECT CAST(event AS VARCHAR) AS event, how, count(*) AS n FROM t GROUP BY 1, 2""",
    "page_accepted": f"""{APP}, c AS (SELECT entity, bout_id AS claim, dt + CAST(bout_id % 6 AS INTEGER) AS day FROM app),
        h AS (SELECT c.entity, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM app a WHERE a.entity = c.entity AND abs(date_diff('day', a.dt, c.day)) <= 2)) AS hits FROM c GROUP BY 1)
        SELECT entity, n, hits, CAST(hits >= least(2, n) AS INTEGER) AS accepted FROM h""",
    "market_classes": """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'distance' WHEN 1 THEN 'method' WHEN 2 THEN 'method' WHEN 3 THEN 'total' WHEN 4 THEN 'winner' WHEN 5 THEN 'round' ELSE 'other' END AS kind,
        CASE p_partkey % 7 WHEN 0 THEN 'decision' WHEN 1 THEN 'method_ko' WHEN 2 THEN 'method_sub' WHEN 3 THEN 'total_over_2_5' WHEN 4 THEN 'winner_a' WHEN 5 THEN 'ends_before_r3' END AS market FROM part""",
    "quota_left": """WITH d AS (SELECT CAST(ts AS DATE) AS day, 3 * count(*) AS cost FROM events WHERE event_type = 'purchase' GROUP BY 1), u AS (SELECT day, CAST(sum(cost) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS BIGINT) AS used FROM d)
        SELECT CAST(day AS VARCHAR) AS day, used, greatest(0, 500 - used) AS left FROM u""",
    "archived_cards": f"""{B} SELECT 'night-' || lower(strftime(event, '%B')) || '-' || year(event) AS card, count(*) AS n FROM bouts WHERE event < (SELECT max(event) FROM bouts) - INTERVAL 3 MONTH GROUP BY event""",
}
