"""Queries of names in text and of market questions, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.operators import automaton, names, questions
from boutline.sources.scratch import staged
from boutline.sources.views import bouts, table, with_views


def _people(spark: SparkSession, sf: str) -> DataFrame:
    """Names of suppliers and customers, and each without its last letter, which many others begin with."""
    both = table(spark, sf, "supplier").select(F.col("s_name").alias("name")).union(table(spark, sf, "customer").select("c_name"))
    return both.union(both.selectExpr("left(name, length(name) - 1)")).distinct()


def _told(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's whole text between names that its number picks."""
    texts = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    number = lambda kind, n: F.format_string(f"{kind}#%09d", n)
    i = F.col("doc_id")
    parts = [number("Supplier", i % 23), F.col("text"), number("Customer", i % 97), number("Customer", i % 31), F.lit("Customer#00000001"), number("Supplier", i % 7)]
    return texts.select("doc_id", F.concat_ws(" ", *parts).alias("text"))


def names_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """How often each name stands in a text, and how often no longer name covers it there."""
    hits = automaton.occurrences(_told(spark, sf), _people(spark, sf), "doc_id", "text")
    outer = automaton.outermost(hits, "doc_id").groupBy("doc_id", "name").agg(F.count("*").alias("longest"))
    every = hits.groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    return every.join(outer, ["doc_id", "name"], "left").select("doc_id", "name", "n", F.coalesce("longest", F.lit(0)).alias("longest"))


def text_in_question(spark: SparkSession, sf: str) -> DataFrame:
    """Questions matched to the brands whose name they contain as a substring; several matches are all kept."""
    brands = table(spark, sf, "part").select(F.lower("p_brand").alias("name")).distinct()
    asked = table(spark, sf, "part").select("p_partkey", F.lower(F.concat_ws(" ", F.lit("will"), F.concat(F.lit("the"), "p_brand", F.lit("s")), "p_name")).alias("question"))
    found = automaton.occurrences(asked, brands, "p_partkey", "question").groupBy("p_partkey")
    return found.agg(F.countDistinct("name").alias("n"), F.max("name").alias("brand"))


#: A claim about ``{a}`` and ``{b}``, and whether the market's event is told, by the rest of the bout's number by their number.
CLAIMS = (
    ("Will {a} win by submission in {a} vs {b}?", True),
    ("{b} wins by KO in {a} vs. {b}?", False),
    ("Will {a} vs {b} go the distance?", False),
    ("Fight ends before round 3 begins?", True),
    ("Will {a} win in round 2 in {a} vs {b}?", True),
    ("{B} by decision?", True),
    ("Somebody wins by submission?", True),
    ("Nobody is told here", False),
    ("{A} or {B}: over 2.5 rounds?", False),
    ("{a} by TKO?", False),
    ("Ends in round 4, {B} and {A}?", False),
    ("Inside the distance?", True),
)


def market_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Claims told before whole texts of documents, placed on a bout, a side and a market, or nowhere."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("bout_id"), "text")
    pairs = staged(bouts(spark, sf).select("bout_id", "r_id", "b_id").join(texts, "bout_id", "left_semi"), "pairs")
    rows = pairs.join(texts, "bout_id")
    full = lambda side: F.format_string("Supplier#%09d", f"{side}_id")
    last = lambda side: F.format_string("%09d", f"{side}_id")
    claim, event = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (text, known) in enumerate(CLAIMS):
        told = F.lit(text)
        for mark, value in (("{a}", full("r")), ("{b}", full("b")), ("{A}", last("r")), ("{B}", last("b"))):
            told = F.replace(told, F.lit(mark), value)
        here = F.col("bout_id") % len(CLAIMS) == i
        claim = F.when(here, told).otherwise(claim)
        event = F.when(here & F.lit(known), F.concat(F.lit("event-"), "bout_id")).otherwise(event)
    asked = rows.select(F.col("bout_id").alias("question_id"), event.alias("event"), F.concat_ws(" ", claim, "text").alias("question"))
    known = pairs.join(texts.select("bout_id"), "bout_id")
    outcomes = known.select(F.concat(F.lit("event-"), "bout_id").alias("event"), F.explode(F.array(full("r"), last("b"))).alias("name"))
    board = known.select("bout_id", F.col("r_id").alias("a_id"), F.col("b_id").alias("b_id"))
    roster = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lower(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("key"), F.lit("").alias("nickname"))
    return questions.placed(asked, board, roster, outcomes)


def resolved_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts resolved by aliases, exact keys, keys without blanks, nicknames, surnames, and at last by likeness; shared keys belong to nobody."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("key"), F.col("p_brand").alias("nickname"))
    roster = parts.where("id % 2 = 0")
    i, first, last = F.col("id"), F.split_part("key", F.lit(" "), F.lit(1)), F.element_at(F.split("key", " "), -1)
    forms = F.when(i % 12 == 0, F.replace("key", F.lit(" "), F.lit(""))).when(i % 12 == 2, F.concat_ws(" ", first, F.lower("nickname"))).when(i % 12 == 4, F.concat_ws(" ", F.lower("nickname"), last))
    forms = forms.when(i % 12 == 6, F.concat(F.lit("alias "), i.cast("string"))).when(i % 12 == 8, last).otherwise(F.col("key"))
    aliases = roster.where("id % 12 = 6").select(F.concat(F.lit("alias "), F.col("id").cast("string")).alias("key"), F.col("key").alias("other"))
    return names.resolve(parts.select(i.alias("ask_id"), forms.alias("key")), roster, aliases)


QUERIES = {f.__name__: f for f in (names_in_text, text_in_question, market_mapping, resolved_names)}


def _claim_sql() -> str:
    def told(text: str) -> str:
        out = "'" + text + "'"
        for mark, value in (("{a}", "a"), ("{b}", "b"), ("{A}", "right(a, 9)"), ("{B}", "right(b, 9)")):
            out = f"replace({out}, '{mark}', {value})"
        return out

    whens = " ".join(f"WHEN {i} THEN {told(text)}" for i, (text, _) in enumerate(CLAIMS))
    known = ", ".join(str(i) for i, (_, k) in enumerate(CLAIMS) if k)
    return f"CASE bout_id % {len(CLAIMS)} {whens} END AS claim, bout_id % {len(CLAIMS)} IN ({known}) AND met = 1 AS known"


_WAY = r"CASE WHEN regexp_matches(told, '\b(?:submission|tap)\b') THEN 'sub' WHEN regexp_matches(told, '\b(?:ko|tko|knockout)\b') THEN 'ko' WHEN regexp_matches(told, '\bdecision\b') THEN 'dec' END"
ORACLES = {
    "names_in_text": """WITH s AS (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer), names AS (SELECT name FROM s UNION SELECT left(name, length(name) - 1) FROM s),
        t AS (SELECT doc_id, printf('Supplier#%09d', doc_id % 23) || ' ' || coalesce(text, '') || ' ' || printf('Customer#%09d', doc_id % 97) || ' ' || printf('Customer#%09d', doc_id % 31) || ' Customer#00000001 ' || printf('Supplier#%09d', doc_id % 7) AS text FROM documents),
        h AS (SELECT doc_id, name, CAST((strlen(text) - strlen(replace(text, name, ''))) // strlen(name) AS BIGINT) AS n FROM t JOIN names ON contains(text, name))
        SELECT h.doc_id, h.name, any_value(h.n) AS n, CAST(any_value(h.n) - coalesce(sum(o.n), 0) AS BIGINT) AS longest FROM h LEFT JOIN h o ON h.doc_id = o.doc_id AND starts_with(o.name, h.name) AND o.name <> h.name GROUP BY 1, 2""",
    "text_in_question": """WITH b AS (SELECT DISTINCT lower(p_brand) AS brand FROM part), q AS (SELECT p_partkey, lower('will the' || p_brand || 's ' || p_name) AS question FROM part)
        SELECT p_partkey, count(*) AS n, max(brand) AS brand FROM q JOIN b ON contains(question, brand) GROUP BY 1""",
    "market_mapping": rf"""{with_views('bouts')}, r AS (SELECT bout_id, r_id, b_id, printf('Supplier#%09d', r_id) AS a, printf('Supplier#%09d', b_id) AS b, text, count(*) OVER (PARTITION BY least(r_id, b_id), greatest(r_id, b_id)) AS met FROM bouts JOIN documents ON bout_id = doc_id),
        q AS (SELECT bout_id, {_claim_sql()}, text FROM r), p AS (SELECT bout_id AS question_id, known, ' ' || regexp_replace(regexp_replace(regexp_replace(lower(concat_ws(' ', claim, text)) || ' ', '[''’]s([^a-z])', ' s\1', 'g'), '[''’]', '', 'g'), '[^a-z0-9.?]+', ' ', 'g') AS told FROM q),
        w AS (SELECT *, regexp_replace(regexp_replace(told, '\bin [^?]*?\bvs\b[^?]*', ' ', 'g'), '[^a-z0-9]+', ' ', 'g') AS subject, regexp_replace(told, '[^a-z0-9]+', ' ', 'g') AS whole FROM p),
        f AS (SELECT s_suppkey AS id, unnest([' ' || printf('%09d', s_suppkey) || ' ', ' supplier' || printf('%09d', s_suppkey) || ' ']) AS form FROM supplier),
        h AS (SELECT question_id, id, bool_or(contains(subject, form)) AS inside FROM w JOIN f ON contains(whole, form) GROUP BY 1, 2),
        c AS (SELECT h.question_id, r.bout_id, bool_or(inside AND id = r_id) AS a_in, bool_or(inside AND id = b_id) AS b_in, count(DISTINCT id) AS sides FROM h JOIN r ON id IN (r_id, b_id) GROUP BY 1, 2),
        k AS (SELECT c.*, w.known, CASE WHEN a_in AND b_in THEN 1 WHEN (a_in OR b_in) AND sides = 2 THEN 2 WHEN sides = 2 THEN 3 WHEN a_in OR b_in THEN 4 END AS rank,
            CASE WHEN a_in AND NOT b_in THEN 'a' WHEN b_in AND NOT a_in THEN 'b' END AS side FROM c JOIN w USING (question_id)),
        g AS (SELECT * FROM k WHERE rank IS NOT NULL AND (NOT known OR bout_id = question_id)),
        m AS (SELECT question_id, min(bout_id) AS bout_id, min(side) AS side FROM (SELECT *, min(rank) OVER (PARTITION BY question_id) AS best FROM g) WHERE rank = best GROUP BY 1 HAVING count(*) = 1),
        o AS (SELECT w.question_id, told, side, CASE WHEN known THEN w.question_id ELSE bout_id END AS bout_id, {_WAY} AS way, regexp_matches(told, '\bround [1-5]\b') AS rnd, regexp_matches(told, '\bby\b') AS by_,
            regexp_matches(told, '\bwins? by\b') AS wins FROM w LEFT JOIN m USING (question_id)),
        e AS (SELECT *, CASE WHEN regexp_matches(told, '\bends? before round [2-5]\b') THEN 'ends_before_r' || regexp_extract(told, '\bends? before round ([2-5])\b', 1)
            WHEN regexp_matches(told, '\bover [0-9]\.5\b') THEN 'total_over_' || regexp_extract(told, '\bover ([0-9])\.5\b', 1) || '_5' WHEN regexp_matches(told, '\bgo(?:es)? (?:the distance|to a decision)\b') THEN 'decision'
            WHEN regexp_matches(told, '\binside the distance\b') THEN 'inside_distance' WHEN side IS NOT NULL OR wins THEN CASE WHEN side IS NOT NULL AND NOT rnd AND way IS NOT NULL AND (by_ OR way <> 'dec') THEN way || '_' || side END
            WHEN rnd THEN 'end_r' || regexp_extract(told, '\bround ([1-5])\b', 1) WHEN NOT by_ AND way IS NOT NULL THEN 'method_' || way END AS market FROM o)
        SELECT question_id, CASE WHEN market IS NOT NULL THEN bout_id END AS bout_id, CASE WHEN bout_id IS NOT NULL AND market IS NOT NULL THEN side END AS side, CASE WHEN bout_id IS NOT NULL THEN market END AS market FROM e""",
    "resolved_names": """WITH p AS (SELECT p_partkey AS id, lower(p_name) AS key, lower(p_brand) AS nick, string_split(lower(p_name), ' ')[1] AS first, list_filter(string_split(lower(p_name), ' '), lambda t: length(t) > 1)[-1] AS last FROM part),
        q AS (SELECT id AS ask_id, CASE id % 12 WHEN 0 THEN replace(key, ' ', '') WHEN 2 THEN first || ' ' || nick WHEN 4 THEN nick || ' ' || last WHEN 8 THEN last ELSE key END AS key FROM p),
        v AS (SELECT id, unnest([0, 1, 2, 3, 4]) AS rank, unnest([key, replace(key, ' ', ''), first || ' ' || nick, nick || ' ' || last, last]) AS variant FROM p WHERE id % 2 = 0),
        o AS (SELECT rank, variant, min(id) AS id FROM v WHERE length(variant) >= 4 GROUP BY 1, 2 HAVING count(DISTINCT id) = 1),
        h AS (SELECT ask_id, id, rank, row_number() OVER (PARTITION BY ask_id ORDER BY rank, id) AS k FROM q JOIN o ON variant IN (key, replace(key, ' ', ''), list_filter(string_split(key, ' '), lambda t: length(t) > 1)[-1]))
        SELECT q.ask_id, h.id, h.rank AS how FROM q LEFT JOIN h ON q.ask_id = h.ask_id AND k = 1""",
}
