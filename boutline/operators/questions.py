"""Market questions placed on a bout, a side and a market.

Names are looked for by automata over all their forms, as whole words. A question's subject is what is left of it without a tail such as
``in A vs. B``. A question belongs to the bout of its event where another market of the event names both sides; else to the one bout that it
names best. What fits several bouts, or a claim about a fighter who is not told, is left out rather than guessed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators import automaton
from boutline.operators.names import variants
from boutline.sources.scratch import staged

#: Stands between subject and whole question where names are looked for; no letter of a name.
BAR = "|"


def plain(question: Column) -> Column:
    """Lower ASCII letters, digits, full stops and question marks; an apostrophe is left out, but ends a word before an ``s``; anything else is one blank."""
    owned = F.regexp_replace(F.concat(F.lower(question), F.lit(" ")), "['\u2019]s([^a-z])", " s$1")
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(owned, "['\u2019]", ""), "[^a-z0-9.?]+", " "))


def subject(told: Column) -> Column:
    """The plain question without the tail that repeats the bout, up to a question mark.

    Between two question marks that is all from the first ``in``, if a ``vs`` follows it. Each is looked for once, so a long text costs no more than its letters.
    """

    def kept(part: Column) -> Column:
        at = F.regexp_instr(part, F.lit(r"\bin "))
        return F.when((at > 0) & F.substring(part, at, F.length(part)).rlike(r"\bvs\b"), F.concat(F.left(part, at - 1), F.lit(" "))).otherwise(part)

    return F.when(told.contains("vs"), F.array_join(F.transform(F.split(told, r"\?"), kept), "?")).otherwise(told)


def words(told: Column) -> Column:
    return F.regexp_replace(told, "[^a-z0-9]+", " ")


def said(told: Column) -> list[Column]:
    """What a plain question says of a market, by the names that ``market_of`` takes; a number is empty where none is told."""
    has = lambda words, pattern: reduce(or_, map(told.contains, words)) & told.rlike(pattern)
    number = lambda word, pattern: F.when(told.contains(word), F.regexp_extract(told, pattern, 1)).otherwise("")
    way = F.when(has(["submission", "tap"], r"\b(?:submission|tap)\b"), "sub").when(has(["ko", "knockout"], r"\b(?:ko|tko|knockout)\b"), "ko").when(has(["decision"], r"\bdecision\b"), "dec")
    told_of = {
        "before": number("before round ", r"\bends? before round ([2-5])\b"), "total": number("over ", r"\bover ([0-9])\.5\b"), "rnd": number("round ", r"\bround ([1-5])\b"),
        "distance": has(["the distance", "to a decision"], r"\bgo(?:es)? (?:the distance|to a decision)\b"), "inside_distance": has(["inside the distance"], r"\binside the distance\b"),
        "way": way, "by": has(["by"], r"\bby\b"), "wins": has([" by"], r"\bwins? by\b"),
    }
    return [c.alias(k) for k, c in told_of.items()]


def market_of(side: Column) -> Column:
    """The market that a question is about by what is ``said``, null where there is none for it.

    A bout that ends before a round, a total and the distance are told first. Else a claim is of a fighter where a side is known or somebody
    wins by something; it needs both the side and the way, and in which round has no market. All else is of the bout.
    """
    before, total, rnd, way, by = map(F.col, ("before", "total", "rnd", "way", "by"))
    of_fighter = F.when(side.isNotNull() & (rnd == "") & (by | (way != "dec")), F.concat_ws("_", way, side))
    of_bout = F.when(rnd != "", F.concat(F.lit("end_r"), rnd)).when(~by & way.isNotNull(), F.concat(F.lit("method_"), way))
    return (
        F.when(before != "", F.concat(F.lit("ends_before_r"), before)).when(total != "", F.concat(F.lit("total_over_"), total, F.lit("_5")))
        .when(F.col("distance"), "decision").when(F.col("inside_distance"), "inside_distance")
        .when(side.isNotNull() | F.col("wins"), F.when(way.isNotNull(), of_fighter)).otherwise(of_bout)
    )


def _sides(board: DataFrame) -> DataFrame:
    """``(id, bout_id, side)``: a fighter's bouts on the board."""
    return board.select("bout_id", F.inline(F.array(F.struct(F.col("a_id").alias("id"), F.lit("a").alias("side")), F.struct(F.col("b_id").alias("id"), F.lit("b").alias("side")))))


def handles(outcomes: DataFrame, board: DataFrame, roster: DataFrame) -> DataFrame:
    """``(event, bout_id)``: the bout whose two sides the outcomes ``(event, name)`` of an event's markets name, if it is one."""
    forms = variants(roster).groupBy("variant").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").select("variant", "id")
    named = outcomes.select("event", F.trim(words(plain(F.col("name")))).alias("variant")).distinct().join(forms, "variant").select("event", "id").distinct()
    both = named.join(_sides(board), "id").groupBy("event", "bout_id").agg(F.countDistinct("side").alias("n")).where("n = 2")
    return both.groupBy("event").agg(F.min("bout_id").alias("bout_id"), F.count("*").alias("n")).where("n = 1").select("event", "bout_id")


def named_in(asked: DataFrame, roster: DataFrame) -> DataFrame:
    """``(question_id, id, inside)``: who is named in a question's ``lane``, and whether in its subject; a form that a longer one covers does not count."""
    forms = variants(roster).groupBy("variant").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    forms = staged(forms.select(F.concat(F.lit(" "), "variant", F.lit(" ")).alias("name"), "id"), "forms")
    hits = automaton.outermost(automaton.occurrences(asked, forms.select("name"), "question_id", "lane"), "question_id")
    rows = hits.join(asked.select("question_id", "border").distinct(), "question_id").join(forms, "name")
    return rows.groupBy("question_id", "id").agg(F.bool_or((F.col("border") == 0) | (F.col("start") < F.col("border"))).alias("inside"))


def read(asked: DataFrame) -> DataFrame:
    """``asked`` with what its questions say, and the ``lane`` where names are looked for, written once: what follows needs no text but that.

    A lane is the subject and the whole question with a bar at ``border`` between them, or the question alone, border 0, where nothing is cut off it.
    """
    told = asked.select("question_id", "event", plain(F.col("question")).alias("told")).select("*", subject(F.col("told")).alias("subject"))
    lane = F.when(F.col("subject") == F.col("told"), words(F.col("told"))).otherwise(F.concat(words(F.col("subject")), F.lit(BAR), words(F.col("told"))))
    return staged(told.select("question_id", "event", *said(F.col("told")), lane.alias("lane")).select("*", F.instr("lane", BAR).alias("border")), "questions")


def placed(asked: DataFrame, board: DataFrame, roster: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``asked(question_id, event, question)`` with ``bout_id``, ``side`` and ``market``; nulls where it has no place.

    ``board(bout_id, a_id, b_id)`` has the open bouts, of which a fighter has few; ``roster(id, key, nickname)`` the names, and
    ``outcomes(event, name)`` those of markets between two fighters. Texts are read once; board and outcomes are read more often.
    """
    asked = read(asked)
    told = named_in(asked, roster).join(_sides(board), "id").groupBy("question_id", "bout_id").agg(
        F.bool_or(F.col("inside") & (F.col("side") == "a")).alias("a_in"), F.bool_or(F.col("inside") & (F.col("side") == "b")).alias("b_in"), F.countDistinct("side").alias("sides")
    )
    asked = asked.drop("lane", "border")
    found = asked.where("event is not null").join(handles(outcomes, board, roster).withColumnRenamed("bout_id", "known"), "event").select("question_id", "known").distinct()
    known = asked.join(found, "question_id", "left")
    rank = F.when(F.col("a_in") & F.col("b_in"), 1).when((F.col("a_in") | F.col("b_in")) & (F.col("sides") == 2), 2).when(F.col("sides") == 2, 3).when(F.col("a_in") | F.col("b_in"), 4)
    ranked = told.join(known.select("question_id", "known"), "question_id").where("known is null or known = bout_id").withColumn("rank", rank).where("rank is not null or known is not null")
    side = F.when(F.col("a_in") & ~F.col("b_in"), "a").when(F.col("b_in") & ~F.col("a_in"), "b")
    best = ranked.groupBy("question_id", "rank").agg(F.count("*").alias("n"), F.min("bout_id").alias("bout_id"), F.min(side).alias("side"))
    best = best.groupBy("question_id").agg(F.min_by(F.struct("n", "bout_id", "side"), F.coalesce("rank", F.lit(9))).alias("m"))
    out = known.join(best.where("m.n = 1").select("question_id", "m.bout_id", "m.side"), "question_id", "left")
    out = out.select("question_id", F.coalesce("known", "bout_id").alias("bout_id"), "side", market_of(F.col("side")).alias("market"))
    fits = F.col("bout_id").isNotNull() & F.col("market").isNotNull()
    return out.select("question_id", *[F.when(fits, F.col(c)).alias(c) for c in ("bout_id", "side", "market")])
