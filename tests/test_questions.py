"""Names in texts against brute force, and questions placed or left out."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boutline.operators import automaton, questions
from boutline.sources.views import on_workers

LETTERS = st.text(st.sampled_from("abé# "), min_size=1, max_size=6)


@given(st.sets(LETTERS, min_size=1, max_size=12), st.lists(st.text(st.sampled_from("abé# x"), max_size=60), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_every_place_of_every_name(found, texts):
    names = sorted(found)
    lane, lanes = automaton.LANE, automaton.LANES
    automaton.LANE, automaton.LANES = 7, 3
    try:
        text, name, start = automaton._places(automaton.build(names), texts)
    finally:
        automaton.LANE, automaton.LANES = lane, lanes
    got = sorted((int(t), names[n], int(s)) for t, n, s in zip(text, name, start))
    assert got == sorted((t, n, s) for t, x in enumerate(texts) for n in names for s in range(len(x)) if x.startswith(n, s))


def test_shards_find_what_one_automaton_finds(spark):
    on_workers(spark)
    rng = random.Random(5)
    names = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 5))),) for _ in range(60)] + [("",), (None,)]
    texts = [(i, "".join(rng.choice("abcx") for _ in range(200))) for i in range(20)] + [(20, None), (21, "")]
    names, asked = spark.createDataFrame(names, "name string"), spark.createDataFrame(texts, "id long, body string")
    small = automaton.occurrences(asked, names, "id", "body", states=20)
    assert automaton.shards(names, 20).count() > 3
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, automaton.occurrences(asked, names, "id", "body").collect()))
    assert {(i, x[s - 1 : s - 1 + len(n)]) for i, n, s in small.collect() for x in [dict(texts)[i]]} == {(i, n) for i, n, _ in small.collect()}


def test_a_hundred_thousand_names(spark):
    on_workers(spark)
    names = spark.range(100_000).selectExpr("format_string('customer#%09d', id) AS name")
    texts = spark.range(200).selectExpr("id", "concat('asks customer#', lpad(id * 499, 9, '0'), ' and customer#', lpad(id + 100000, 9, '0')) AS body")
    rows = automaton.occurrences(texts, names, "id", "body").collect()
    assert sorted((r.id, r.name, r.start) for r in rows) == [(i, f"customer#{i * 499:09d}", 6) for i in range(200)]


def test_outermost_hits(spark):
    rows = [(1, "ab", 1), (1, "abc", 1), (1, "bcd", 2), (1, "c", 3), (1, "c", 9), (2, "c", 3), (3, "xyz", 1), (3, "yz", 2), (3, "z", 3)]
    got = automaton.outermost(spark.createDataFrame(rows, "id long, name string, start long"), "id").collect()
    assert sorted(map(tuple, got)) == [(1, "abc", 1), (1, "bcd", 2), (1, "c", 9), (2, "c", 3), (3, "xyz", 1)]


BOARD = [(1, 10, 11), (2, 12, 13), (3, 14, 15), (4, 16, 17)]
ROSTER = [(10, "ann vieira", ""), (11, "bob bryczek", ""), (12, "cal garry", "the hammer"), (13, "dan oneil", ""), (14, "eve stone", ""), (15, "fay rivers", ""), (16, "gus stone", ""), (17, "hal woods", "")]
CASES = {
    "Will Vieira win by submission in Vieira vs. Bryczek?": (1, "a", "sub_a"),
    "Bob Bryczek by KO in Vieira vs Bryczek?": (1, "b", "ko_b"),
    "Will Vieira vs. Bryczek go the distance?": (1, None, "decision"),
    "Vieira by decision?": (1, "a", "dec_a"),
    "Cal The Hammer Garry by TKO": (2, "a", "ko_a"),
    "Will Vieira win in round 2 in Vieira vs Bryczek?": (None, None, None),
    "Fight wins by submission": (None, None, None),
    "Somebody wins by decision in Vieira vs. Bryczek?": (None, None, None),
    "Stone by submission": (None, None, None),
    "Eve Stone by submission": (3, "a", "sub_a"),
    "Garry vs. O'Neil: over 2.5 rounds": (2, None, "total_over_2_5"),
    "Garry's coach says O’Neil's distance": (None, None, None),
    "Garry and Vieira inside the distance": (None, None, None),
    "Bryczek and Vieira: ends in round 3": (1, None, "end_r3"),
    "Nothing here": (None, None, None),
}
#: Questions whose event is the bout of Vieira and Bryczek.
KNOWN = {
    "Fight ends before Round 4 begins": (1, None, "ends_before_r4"), "Method of finish: submission": (1, None, "method_sub"), "Decision": (1, None, "method_dec"), "Bryczek by submission": (1, "b", "sub_b"),
    "Ends in round 1": (1, None, "end_r1"), "Wins by submission": (None, None, None), "Garry by KO": (None, None, None),
}


@pytest.fixture(scope="module")
def placed(spark):
    on_workers(spark)
    texts = [(q, None) for q in CASES] + [(q, "vieira-bryczek") for q in KNOWN] + [("Decision", "both garrys")]
    asked = spark.createDataFrame([(i, e, q) for i, (q, e) in enumerate(texts)], "question_id long, event string, question string")
    board = spark.createDataFrame(BOARD, "bout_id long, a_id long, b_id long")
    roster = spark.createDataFrame([*ROSTER, (18, "cal garry", "")], "id long, key string, nickname string").where("id < 18")
    outcomes = [("vieira-bryczek", "Ann Vieira"), ("vieira-bryczek", "Bryczek"), ("vieira-bryczek", "Yes"), ("both garrys", "Garry"), ("both garrys", "Vieira")]
    rows = questions.placed(asked, board, roster, spark.createDataFrame(outcomes, "event string, name string")).collect()
    return {(texts[r.question_id]): (r.bout_id, r.side, r.market) for r in rows}


@pytest.mark.parametrize("question", CASES)
def test_question_without_an_event(placed, question):
    assert placed[(question, None)] == CASES[question]


@pytest.mark.parametrize("question", KNOWN)
def test_question_of_a_known_event(placed, question):
    assert placed[(question, "vieira-bryczek")] == KNOWN[question]


def test_event_that_names_no_bout(placed):
    assert placed[("Decision", "both garrys")] == (None, None, None)
