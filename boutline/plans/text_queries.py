"""Queries over text, names, files and streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boutline.functions import text
from boutline.operators import names, parse, wiki
from boutline.sources import files
from boutline.sources.scratch import scratch_folder
from boutline.sources.views import bouts, table, with_views
from boutline.streaming import ledger

#: Bouts of a part of a page, at most.
PART = 5000


def name_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of part names: collapsed, letters alone, surname, slug."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.upper("p_name"), F.lit("  Jr")).alias("name"))
    key = text.without_suffix(text.collapsed(F.col("name")))
    return rows.select("p_partkey", text.collapsed(F.col("name")).alias("collapsed"), key.alias("key"), text.surname(key).alias("surname"), text.slug(F.col("name")).alias("slug"))


def accent_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Accents stripped by decomposition, over the whole text of every document."""
    return table(spark, sf, "documents").select("doc_id", text.name_key("text").alias("key"))


def _roster(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lower(F.regexp_replace("s_name", "[#0]+", " ")).alias("key"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat(F.lit("supplier "), (F.col("c_custkey") % 40).cast("string"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("ask_id"), F.when(F.col("c_custkey") % 3 == 0, F.regexp_replace(key, " ", "")).otherwise(key).alias("key"))


def alias_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Asked names resolved by exact key, without blanks, then by surname; a key that two roster rows share is nobody's."""
    return names.resolve(_asked(spark, sf), _roster(spark, sf).withColumn("nickname", F.lit("")))


def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    asked = _asked(spark, sf).select("ask_id", F.regexp_replace("key", "pp", "p").alias("key"))
    return names.fuzzy(asked, _roster(spark, sf)).select("ask_id", "id", F.round("score", 6).alias("score"))


def card_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Cards written from conversations: a header, a segment, and a bout per turn."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("card"), (F.col("turn") + 2).alias("n"), F.concat(F.lit("Name "), F.col("role"), F.lit(" vs. Other | "), (F.col("turn") % 2 * 2 + 3).cast("string")).alias("line"))
    heads = turns.select("card").distinct().select("card", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit("# Card | 2024-01-06 | Hall").alias("line")), F.struct(F.lit(1).cast("long").alias("n"), F.lit("## main").alias("line")))).alias("x")).select("card", "x.n", "x.line")
    return parse.card_lines(turns.unionByName(heads))


def page_items(spark: SparkSession, sf: str) -> DataFrame:
    """The list items of each page."""
    items = lambda html: [(i, " ".join(re.sub(r"<[^<>]*>", "", x).split())) for i, x in enumerate(re.findall(r"<li\b[^>]*>(.*?)</li\s*>", html, re.S | re.I))]
    return wiki.parsed(table(spark, sf, "pages"), "page_id", "html", items, "place long, item string")


def _pages(spark: SparkSession, sf: str, line: Column, head: str, foot: str) -> DataFrame:
    """A text for each card: ``head``, a ``line`` for each of its bouts in their order, ``foot``."""
    rows = bouts(spark, sf).withColumn("line", line)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dt", "bout_id", "line"))), lambda x: x["line"]), "")  # a card's bouts
    return rows.groupBy(F.date_format("event", "yyyy-MM-dd").alias("event")).agg(F.concat(F.lit(head), body, F.lit(foot)).alias("body"))


def _parts(spark: SparkSession, sf: str, line: Column, head: str, foot: str) -> DataFrame:
    """The texts of ``_pages`` in parts ``(event, day, n, body)`` of a day and at most ``PART`` bouts, each with head and foot."""
    place = F.row_number().over(Window.partitionBy("dt").orderBy("bout_id")) - 1
    rows = bouts(spark, sf).withColumn("line", line).select("event", "dt", "bout_id", "line", F.floor(place / PART).alias("n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bout_id", "line"))), lambda x: x["line"]), "")  # a part's bouts
    return rows.groupBy(F.date_format("event", "yyyy-MM-dd").alias("event"), F.col("dt").alias("day"), "n").agg(F.concat(F.lit(head), body, F.lit(foot)).alias("body"))


def _side(c: str) -> Column:
    return F.concat(F.lit("Ann Side"), F.col(c).cast("string"))


def card_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages in parts with a table of bouts in segments, parsed to bouts; a pair that a page names twice counts once."""
    i = F.col("bout_id")
    turn = F.when(i % 10 == 0, "<tr><th colspan=8>Preliminary card (TV)</th></tr>").when(i % 10 == 5, "<tr><th>Early Prelims</th></tr>").otherwise(F.lit(""))
    row = F.concat(
        turn, F.lit("<tr><td>"), F.when(i % 2 == 0, "Light&shy;weight").otherwise("Catch"), F.lit("</td><td> <a href='x'>"), _side("r_id"), F.lit("</a> (c)</td><td>"),
        F.when(i % 3 == 0, "vs.").otherwise("VS"), F.lit("</td><td>"), _side("b_id"), F.lit("[<b>3</b>]</td><td>x</td></tr>\n"),
    )
    return wiki.cards(_parts(spark, sf, row, "<html><table><tr><td>a</td><td>no bout</td><td>here</td></tr>", "</table></html>"))


def record_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Wikitext of records in parts, columns told by the header, days in four notations, links and templates in cells; parsed to rows."""
    i, day = F.col("bout_id"), F.col("dt")
    when = (
        F.when(i % 4 == 0, F.date_format(day, "'{{dts|'yyyy|M|d'}}'")).when(i % 4 == 1, F.date_format(day, "'{{start date|'yyyy'|'MMM'|'d'|df=y}}'"))
        .when(i % 4 == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "d MMMM yyyy"))
    )
    result = F.when(F.col("winner") == "r", 'style="x" | Win').when(F.col("winner") == "b", "Loss").otherwise("Draw")
    method = F.when(F.col("method") == "KO/TKO", "TKO (punches)").when(F.col("method") == "SUB", "Submission ([[choke|rear-naked {{abbr|choke|c}}]])").otherwise("Decision (split)<ref name='a'/>")
    row = F.concat(
        F.lit("|-\n| "), result, F.lit(" || 1–0 || [[B Side ("), F.col("b_id").cast("string"), F.lit(")|'''"), _side("b_id"), F.lit("''']]\n| "), method, F.lit(" || Night "), i.cast("string"), F.lit(" || "), when, F.lit(" || 3\n")
    )
    head = (
        "Lead\n==Kickboxing record==\n{|\n! Res. !! Record !! Date\n|-\n| Win || 9 || 2001-01-01\n|}\n== Mixed martial arts record ==\n{| class='w'\n|+ cap\n"
        "! Res. !! Record !! Opponent !! Method !! Event !! Date !! Round\n"
    )
    told = wiki.parsed(_parts(spark, sf, row, head, "|}\n== Notes ==\nend"), "event", "body", lambda t: [r[:4] for r in wiki.record(t) or []], "day date, result string, opponent string, method string")
    return told.select("event", F.date_format("day", "yyyy-MM-dd").alias("day"), "result", "opponent", "method")


def award_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Award sections of cards, with money, notes, links and explicit nobodies; parsed to a row per award and name."""
    i = F.col("bout_id")
    money, note = F.lit(" ($50,000 each)"), F.lit("{{efn|Despite all, awarded, and more}}")
    both = F.concat(F.lit("* '''Fight of the Night:''' [["), _side("r_id"), F.lit("]] vs. [[x|"), _side("b_id"), F.lit("]]"), money, F.lit("\n"))
    one = F.concat(F.lit("* Performance of the Night: "), _side("r_id"), note, F.lit(" and "), _side("b_id"), money, F.lit("\n"))
    row = F.when(i % 7 == 0, both).when(i % 7 == 1, one).when(i % 7 == 2, "* Fight of the Night: No bonus awarded.\n").otherwise("plain: text, and more\n")
    pages = _pages(spark, sf, row, "Lead: Fight of the Night: [[Nobody Real]]\n== Bonus awards ==\n", "== References ==\n* Performance of the Night: [[Nobody Too]]")
    told = lambda t: [(k, n) for k, names in (wiki.awards(t) or {}).items() for n in names]
    return wiki.parsed(pages, "event", "body", told, "award string, name string")


def prose_bouts(spark: SparkSession, sf: str) -> DataFrame:
    """Bouts that prose states, titles before the names left out, among the sentences of a document."""
    i = F.col("doc_id")
    told = F.concat(F.lit(" A welterweight bout between former UFC Welterweight Championship challenger Ann Lee-"), F.chr(65 + i % 26), F.lit("ox and Bea O'Neil is scheduled. "))
    rows = table(spark, sf, "documents").select("doc_id", F.when(i % 3 == 0, F.concat(F.coalesce("text", F.lit("")), told, told)).otherwise(F.col("text")).alias("body"))
    return wiki.parsed(rows, "doc_id", "body", wiki.prose, "a string, b string")


def card_files(spark: SparkSession, sf: str) -> DataFrame:
    """Card files written from bouts, read and parsed: a header, a segment, and bouts with rounds and division."""
    root, i = scratch_folder(spark), F.col("bout_id")
    line = F.concat(
        F.when(i % 10 == 0, "## Prelims\n").otherwise(F.lit("")), _side("r_id"), F.lit(" vs. "), _side("b_id"), F.when(F.col("sched_sec") > 900, " | 5").otherwise(F.lit("")),
        F.when(i % 2 == 0, " | Flyweight").otherwise(F.lit("")), F.lit("\n"),
    )
    _pages(spark, sf, line, "# Card | 2024-01-06 | Hall\n\n", "").write.partitionBy("event").text(f"{root}/cards")
    return parse.read_cards(spark, f"{root}/cards").select("card", "event", "date", "segment", "a", "b", "rounds", "division")


def card_udtf(spark: SparkSession, sf: str) -> DataFrame:
    """The bouts of card pages by the table function ``card_rows``, as SQL would call it."""
    wiki.register(spark)
    i = F.col("bout_id")
    row = F.concat(F.lit("<tr><td>"), F.when(i % 2 == 0, "Lightweight").otherwise("Catch"), F.lit("</td><td>"), _side("r_id"), F.lit("</td><td>vs.</td><td>"), _side("b_id"), F.lit("</td></tr>"))
    _pages(spark, sf, row, "<table>", "</table>").createOrReplaceTempView("card_pages_")
    return spark.sql("SELECT event, a, b, segment, division FROM card_pages_, LATERAL card_rows(body)")


def text_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Names mapped by a file of ``key = value`` lines with comments and blank lines; keys in any case."""
    path = f"{scratch_folder(spark)}/map.txt"
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("# "), "n_name")).when(F.col("n_nationkey") % 5 == 1, "").otherwise(F.concat(F.lower("n_name"), F.lit("  =  The "), "n_name", F.lit(" = x")))
    rows.select(line.alias("value")).write.text(path)
    return names.displayed(rows, "n_name", files.read_map(spark, path).withColumnRenamed("value", "shown")).select("n_nationkey", "shown")


def write_guards(spark: SparkSession, sf: str) -> DataFrame:
    """An archive that is written once, a table that never shrinks, and a result kept until the corpus has grown."""
    root, rows = scratch_folder(spark), table(spark, sf, "orders").select("o_orderkey")
    half, told = rows.where("o_orderkey % 2 = 0"), []
    told += [("once", files.write_once(half, f"{root}/once")), ("once again", files.write_once(rows, f"{root}/once"))]
    told += [("first", files.write_unless_smaller(half, f"{root}/kept")), ("larger", files.write_unless_smaller(rows, f"{root}/kept")), ("smaller", files.write_unless_smaller(half, f"{root}/kept"))]
    built: list[str] = []
    for step, size in (("built", 10), ("kept", 30), ("grown", 60)):
        before = len(built)
        files.cached(lambda: built.append("x") or half, spark, f"{root}/cache", size)
        told.append((step, len(built) > before))
    sizes = spark.read.json(f"{root}/once").agg(F.count("*").alias("once")).join(spark.read.parquet(f"{root}/kept").agg(F.count("*").alias("kept"))).join(spark.read.parquet(f"{root}/cache").agg(F.count("*").alias("cache")))
    return spark.createDataFrame([(k, int(v)) for k, v in told], "step string, wrote int").join(F.broadcast(sizes))


def raw_text_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Raw strings made from numbers and parsed again: pairs, clocks, heights, round lengths, elapsed seconds."""
    q, d = F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(" of ", q, q + d).alias("pair"), F.when(d == 0, "--").otherwise(F.format_string("%d:%02d", q % 5, q)).alias("clock"),
        F.format_string("%d' %d\"", 5 + q % 2, q % 12).alias("height"), F.when(q % 7 == 0, "5 Rnd (5-5-5-5-5)").when(q % 2 == 0, "3 Rnd (5-5-5)").when(q % 5 == 0, "No Time Limit").otherwise("1 Rnd + OT (12-3)").alias("format"), (q % 3 + 1).alias("round"),
    )
    landed, tried = text.of_pair(F.col("pair"))
    lengths, clock = text.round_lengths(F.col("format")), text.clock_seconds(F.col("clock"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", landed.alias("landed"), tried.alias("tried"), clock.alias("clock_sec"), text.height_inches(F.col("height")).alias("height_in"),
        text.elapsed_seconds(F.col("round"), clock, lengths).alias("elapsed"), F.coalesce(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), F.lit(900)).alias("sched"),
    )


def market_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The kind of a market by the first token that tells it, in order of priority."""
    words = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")
    has = lambda *w: F.arrays_overlap(words, F.array(*[F.lit(x) for x in w]))
    kind = F.when(has("promo", "economy"), "winner").when(has("steel", "tin"), "method").when(has("brass", "nickel", "copper"), "total").otherwise("other")
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"))


def market_map(spark: SparkSession, sf: str) -> DataFrame:
    """Questions mapped to brands whose name they contain; what no brand matches is listed with a null."""
    brands = table(spark, sf, "part").select(F.lower("p_brand").alias("brand")).distinct()  # at most 25
    asked = table(spark, sf, "part").select("p_partkey", F.lower(F.concat_ws(" ", F.lit("will"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_brand")), F.col("p_name"))).alias("question"))
    token = asked.select("p_partkey", F.explode(F.split("question", " ")).alias("brand")).join(F.broadcast(brands), "brand")
    return asked.select("p_partkey").join(token.groupBy("p_partkey").agg(F.min("brand").alias("brand")), "p_partkey", "left")


def files_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV, JSON lines by month and Parquet months, and read back."""
    root = scratch_folder(spark)
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_day"), F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority")
    rows.write.csv(f"{root}/csv", header=True)
    files.append_by_month(rows, "o_day", f"{root}/json")
    files.replace_months(rows.withColumn("month", F.date_format("o_day", "yyyy-MM")), f"{root}/months")
    schema = "o_orderkey long, o_day date, o_totalprice double, o_orderpriority string"
    csv = spark.read.schema(schema).csv(f"{root}/csv", header=True)
    lines = spark.read.schema(schema + ", month string").json(f"{root}/json").select("o_orderkey", F.col("o_totalprice").alias("json_price"), "month")
    months = spark.read.parquet(f"{root}/months").select("o_orderkey", F.col("o_orderpriority").alias("pq_priority"))
    out = csv.join(lines, "o_orderkey").join(months, "o_orderkey")
    return out.groupBy(F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.round(F.sum("json_price"), 2).alias("json_price"), F.countDistinct("pq_priority").alias("priorities"))


def events_stream_open_close(spark: SparkSession, sf: str) -> DataFrame:
    """Open and close per user and type, from a stream over the events."""
    root = scratch_folder(spark)
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(6).write.parquet(f"{root}/in")
    stream = ledger.quote_stream(spark, f"{root}/in", events.schema)
    ledger.append_available(ledger.idempotent(stream, ["event_id"], delay="60 days"), f"{root}/unique", f"{root}/c1")
    told = ledger.open_close(ledger.quote_stream(spark, f"{root}/unique", events.schema, most_bytes=ledger.HOP), ["user_id", "event_type"], "ts", "value")
    rows = ledger.run_available(told, f"{root}/told", f"{root}/c2")
    return rows.select("user_id", "event_type", "n", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"))


QUERIES = {
    f.__name__: f
    for f in (
        name_keys, accent_keys, alias_cascade, fuzzy_match, card_parse, page_items, card_pages, record_pages, award_pages, prose_bouts, card_files, card_udtf, text_maps, write_guards, raw_text_clean, market_kind, market_map, files_roundtrip, events_stream_open_close,
    )
}

B = with_views("bouts")
_CARD = f"""{B}, o AS (SELECT *, CAST(event AS VARCHAR) AS card, 'Ann Side' || r_id AS a, 'Ann Side' || b_id AS b FROM bouts),
    s AS (SELECT *, last_value(CASE bout_id % 10 WHEN 0 THEN 'Prelims' WHEN 5 THEN 'Early prelims' END IGNORE NULLS) OVER (PARTITION BY card ORDER BY dt, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg,
          row_number() OVER (PARTITION BY card, least(r_id, b_id), greatest(r_id, b_id) ORDER BY dt, bout_id) AS k,
          last_value(CASE bout_id % 10 WHEN 0 THEN 'Prelims' END IGNORE NULLS) OVER (PARTITION BY card ORDER BY dt, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM o)"""

ORACLES = {
    "card_pages": f"{_CARD} SELECT card AS event, a, b, coalesce(seg, 'Main card') AS segment, CASE WHEN bout_id % 2 = 0 THEN 'Light' || chr(173) || 'weight' ELSE '' END AS division FROM s WHERE k = 1",
    "card_udtf": f"{_CARD} SELECT card AS event, a, b, 'Main card' AS segment, CASE WHEN bout_id % 2 = 0 THEN 'Lightweight' ELSE '' END AS division FROM s WHERE k = 1",
    "text_maps": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 > 1 THEN 'The ' || n_name || ' = x' ELSE n_name END AS shown FROM nation",
    "write_guards": """WITH c AS (SELECT count(*) FILTER (WHERE o_orderkey % 2 = 0) AS half, count(*) AS whole FROM orders), t(step, wrote) AS (VALUES ('once', 1), ('once again', 0), ('first', 1), ('larger', 1), ('smaller', 0), ('built', 1), ('kept', 0), ('grown', 1))
        SELECT step, wrote, half AS once, whole AS kept, half AS cache FROM t, c""",
    "card_files": f"{_CARD} SELECT card, 'Card' AS event, '2024-01-06' AS date, coalesce(part, 'Main card') AS segment, a, b, CASE WHEN sched_sec > 900 THEN 5 ELSE 3 END AS rounds, CASE WHEN bout_id % 2 = 0 THEN 'Flyweight' END AS division FROM s",
    "record_pages": f"""{_CARD} SELECT card AS event, CAST(dt AS VARCHAR) AS day, CASE winner WHEN 'r' THEN 'W' WHEN 'b' THEN 'L' ELSE 'D' END AS result, b AS opponent, CASE method WHEN 'KO/TKO' THEN 'KO' ELSE method END AS method FROM s""",
    "award_pages": f"""{_CARD}, w AS (SELECT card AS event, CASE bout_id % 7 WHEN 0 THEN 'fotn' ELSE 'potn' END AS award, a, b FROM s WHERE bout_id % 7 < 2) SELECT event, award, a AS name FROM w UNION ALL SELECT event, award, b FROM w""",
    "prose_bouts": "SELECT doc_id, 'Ann Lee-' || chr(CAST(65 + doc_id % 26 AS INTEGER)) || 'ox' AS a, 'Bea O''Neil' AS b FROM documents WHERE doc_id % 3 = 0",
    "page_items": r"""SELECT page_id, i - 1 AS place, trim(regexp_replace(regexp_replace(items[i], '<[^<>]*>', '', 'g'), '\s+', ' ', 'g')) AS item FROM (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i
        FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<li\b[^>]*>(.*?)</li\s*>', 1) AS items FROM pages))""",
    "accent_keys": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z ]', '', 'g'), ' +', ' ', 'g')) AS key FROM documents""",
    "alias_cascade": r"""WITH r AS (SELECT s_suppkey AS id, lower(regexp_replace(s_name, '[#0]+', ' ', 'g')) AS key FROM supplier), a AS (SELECT c_custkey AS ask_id, CASE WHEN c_custkey % 3 = 0 THEN 'supplier' || c_custkey % 40 ELSE 'supplier ' || c_custkey % 40 END AS key FROM customer),
        s AS (SELECT id, unnest([0, 1, 4]) AS rank, unnest([key, replace(key, ' ', ''), list_filter(string_split(key, ' '), lambda t: length(t) > 1)[-1]]) AS variant FROM r),
        v AS (SELECT rank, variant, min(id) AS id FROM s WHERE length(variant) >= 4 GROUP BY 1, 2 HAVING min(id) = max(id)),
        h AS (SELECT ask_id, id, rank, row_number() OVER (PARTITION BY ask_id ORDER BY rank, id) AS k FROM a JOIN v ON v.variant IN (a.key, replace(a.key, ' ', ''), list_filter(string_split(a.key, ' '), lambda t: length(t) > 1)[-1]))
        SELECT a.ask_id, h.id, h.rank AS how FROM a LEFT JOIN h ON a.ask_id = h.ask_id AND k = 1""",
    "name_keys": r"""WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(upper(p_name) || '  Jr'), '\s+', ' ', 'g')) AS collapsed, lower(upper(p_name) || '  Jr') AS raw FROM part),
        k AS (SELECT *, trim(regexp_replace(collapsed, '\s(jr|sr|ii|iii|iv)$', '')) AS key FROM n)
        SELECT p_partkey, collapsed, key, list_filter(string_split(key, ' '), lambda t: length(t) > 1)[-1] AS surname, regexp_replace(regexp_replace(raw, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM k""",
    "raw_text_clean": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_discount * 100) AS INTEGER) AS d FROM lineitem),
        c AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (q % 5) * 60 + q END AS clock FROM r)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(q AS DOUBLE) AS landed, CAST(q + d AS DOUBLE) AS tried, CAST(clock AS DOUBLE) AS clock_sec, CAST((5 + q % 2) * 12 + q % 12 AS DOUBLE) AS height_in,
        CAST(clock + CASE WHEN q % 7 = 0 OR q % 2 = 0 THEN (q % 3) * 300 WHEN q % 5 = 0 THEN (q % 3) * 300 ELSE CASE q % 3 WHEN 0 THEN 0 WHEN 1 THEN 720 ELSE 900 END END AS DOUBLE) AS elapsed, CASE WHEN q % 7 = 0 THEN 1500 ELSE 900 END AS sched FROM c""",
    "market_kind": """WITH w AS (SELECT p_partkey, string_split(lower(p_type || ' ' || p_name), ' ') AS w FROM part)
        SELECT p_partkey, CASE WHEN list_has_any(w, ['promo', 'economy']) THEN 'winner' WHEN list_has_any(w, ['steel', 'tin']) THEN 'method' WHEN list_has_any(w, ['brass', 'nickel', 'copper']) THEN 'total' ELSE 'other' END AS kind FROM w""",
    "market_map": """SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN lower(p_brand) END AS brand FROM part""",
    "files_roundtrip": """SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month, count(*) AS n, round(sum(round(o_totalprice, 2)), 2) AS price, round(sum(round(o_totalprice, 2)), 2) AS json_price,
        count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1""",
    "events_stream_open_close": """SELECT user_id, event_type, count(*) AS n, round(arg_min(value, (ts, event_id)), 6) AS open, round(arg_max(value, (ts, event_id)), 6) AS close FROM events GROUP BY 1, 2""",
    "card_parse": """SELECT conv_id AS card, turn + 2 AS n, 'Card' AS event, '2024-01-06' AS date, 'main' AS segment, 'Name ' || role AS a, 'Other' AS b, CAST(turn % 2 * 2 + 3 AS INTEGER) AS rounds, CAST(NULL AS VARCHAR) AS division FROM conversations""",
}
