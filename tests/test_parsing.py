"""Parsers, loader, identities, capture rules and quantiles against cases written out and against brute force."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from boutline.operators import feed, loader, market, names, rates, wiki
from boutline.sources import files
from boutline.sources.scratch import scratch_folder

day = datetime.date
RECORD = """Lead.
== Amateur record ==
{| class="wikitable"
! Res. !! Record !! Opponent !! Date
|-
| Win || 1-0 || Al || 2001-01-01
|-
| Win || 2-0 || Bo || 2001-02-01
|-
| Win || 3-0 || Cy || 2001-03-01
|-
| Win || 4-0 || Di || 2001-04-01
|}
== Mixed martial arts record ==
{| class="wikitable"
|+ caption
! Res. !! Record !! Opponent !! Method !! Event !! Date !! Round
|-
| Win || 2–0 || [[Ann Example (fighter)|Ann E.]] || TKO ({{abbr|punches|p}}) || rowspan=2 | {{ev|Night 2}} || {{dts|2020|Feb|1}} || 1
|-
| style="x=y" | Loss || 1–1 || Bea Sample<ref name="x"/> || Decision (split) || {{dts|May 4, 2019}}<ref>a | b</ref> || 3
|-
| Draw || 1–1–1 || '''Cal''' || Submission<br/>(choke) || Night 1
| 4 March 2018 || 2
|-
| NC || 1–1–1 || Dee || DQ || Night 0 || not a day || 2
|}
== Notes ==
"""


def test_wikitext_records():
    assert wiki.record(RECORD) == [
        (day(2018, 3, 4), "D", "Cal", "SUB", "Night 1"), (day(2019, 5, 4), "L", "Bea Sample", "DEC", "Night 2"), (day(2020, 2, 1), "W", "Ann E.", "KO", "Night 2"),
    ]
    assert wiki.record("no table") is None and wiki.record("") is None and wiki.record(None) is None
    assert wiki.day_of("{{start date|2024|4|13|df=y}}") == wiki.day_of("April 13, 2024") == wiki.day_of("13 April 2024") == wiki.day_of("{{dts|April 13, 2024}}") == day(2024, 4, 13)
    assert wiki.day_of("{{dts|2024|13|40}}") is None and wiki.day_of("") is None
    assert wiki.split_plain("a|[[b|c]]|{{d|[[e|f]]}}|g {{h", "|") == ["a", "[[b|c]]", "{{d|[[e|f]]}}", "g {{h}}"]


def test_awards():
    section = """== Bonus awards ==
* '''Fight of the Night:''' [[Ann Example]] vs. [[x|Bea Sample]] ($75,000 each)
* Performance of the Night: Geo Neal{{efn|Despite all, awarded, and more}} and Cal Unique
; Fight of the Night: None
plain Performance of the Night: No One
== References =="""
    assert wiki.awards(section) == {"fotn": ["Ann Example", "Bea Sample"], "potn": ["Geo Neal", "Cal Unique"]}
    assert wiki.awards("== Bonus awards ==\n* Fight of the Night: No bonus awarded.") == {"fotn": [], "potn": []}
    assert wiki.awards("no section") is None and wiki.awards(None) is None


def test_cards_and_prose():
    html = """<table><tr><th colspan=7>Main card (TV)</th></tr><tr><td>Lightweight</td><td>Ann E. (c)</td><td>vs.</td><td>Bea S.[1]</td></tr>
        <tr><td>Preliminary card</td></tr><tr><td>Catch</td><td>Cal One</td><td>VS</td><td>Dee Two</td></tr><tr><td>Catch</td><td>Dee Two</td><td>vs</td><td>Cal One</td></tr></table>"""
    assert wiki.card(html) == [("Ann E", "Bea S", "Main card", "Lightweight"), ("Cal One", "Dee Two", "Prelims", "")]
    assert wiki.card("") == [] and wiki.card(None) == []
    told = "A bantamweight bout between former UFC Bantamweight Championship challenger Marlon Vera and Cory Example is scheduled. A rematch between Ann One and Bea O'Two took place."
    assert wiki.prose(told) == [("Marlon Vera", "Cory Example"), ("Ann One", "Bea O'Two")]
    assert wiki.prose(None) == []


def test_names(spark):
    roster = spark.createDataFrame([(1, "ann example", ""), (2, "bea example", "the rock"), (3, "cal unique", None), (4, "ann example", "")], "id long, key string, nickname string")
    asked = spark.createDataFrame([(1, "annexample"), (2, "bea the rock"), (3, "the rock example"), (4, "mr smith"), (5, "cal uniqeu"), (6, "al")], "ask_id long, key string")
    aliases = spark.createDataFrame([("mr smith", "cal unique")], "key string, other string")
    got = {r.ask_id: (r.id, r.how) for r in names.resolve(asked, roster, aliases, names.CUTOFF).collect()}
    assert got == {1: (None, None), 2: (2, 2), 3: (2, 3), 4: (3, 0), 5: (3, 9), 6: (None, None)}  # ids 1 and 4 share a name
    close = spark.createDataFrame([(1, "ann exampel"), (2, "zzz")], "ask_id long, key string")
    assert [(r.ask_id, r.id) for r in names.fuzzy(close, roster.select("id", "key")).collect()] == [(1, 1)]
    by_surname = spark.createDataFrame([(1, "someone unique"), (2, "example")], "ask_id long, key string")
    assert {r.ask_id: (r.id, r.how) for r in names.resolve(by_surname, roster).collect()} == {1: (3, 4), 2: (None, None)}


def test_quantiles_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(k, v) for k in range(3) for v in [rng.choice([0.0, 0.25, 1e6, rng.gauss(0, 1)]) for _ in range(rng.randint(1, 400))]] + [(9, 5.0), (8, None)]
    shares = [0.1, 0.25, 0.5, 0.75, 0.99]
    got = {r.k: r.edges for r in rates.quantiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", shares).collect()}
    for k in (0, 1, 2, 9):
        assert np.allclose(got[k], np.quantile([v for i, v in rows if i == k], shares), rtol=1e-12, atol=1e-12)
    assert set(got) == {0, 1, 2, 9}


def test_settlement_by_id_falls_back_to_names(spark):
    bouts = spark.createDataFrame([(1, day(2020, 1, 1), 7, 8, "r"), (2, day(2020, 1, 3), 8, 7, "b"), (3, day(2020, 5, 1), 5, 6, "draw")], "bout_id long, dt date, r_id long, b_id long, winner string")
    claims = [("x", 1, 1, day(2020, 9, 9), 7, 8, 0.5), ("x", 2, None, day(2020, 1, 4), 7, 8, 0.5), ("x", 3, 99, day(2020, 5, 2), 5, 6, 0.5), ("x", 4, None, day(2020, 9, 1), 7, 8, 0.5)]
    told = market.settle_by_id(spark.createDataFrame(claims, "event string, claim long, known_id long, claim_dt date, a long, b long, p double"), bouts)
    assert {r.claim: (r.hit, r.how) for r in told.collect()} == {1: (1, "id"), 2: (1, "name"), 3: (None, "name"), 4: (None, None)}


def test_gate(spark):
    now = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    days = spark.createDataFrame([(now(0), now(-0.5)), (now(1), None), (now(2), now(-3)), (now(3), now(0)), (now(4), now(-30)), (now(5), now(0))], "now timestamp, last_paid timestamp")
    board = [(now(0), 1, now(9), None), (now(2), 1, now(90), None), (now(3), 1, now(30), now(-9)), (now(4), 1, now(90), now(-9)), (now(5), 1, now(90), now(-9))]
    got = {r.now: r.reason for r in feed.gate(spark.createDataFrame(board, "now timestamp, pair long, starts timestamp, first_seen timestamp"), days).collect()}
    assert [got[now(h)] for h in range(6)] == ["throttled", "nothing listed", "new", "near", "baseline", "unchanged"]


def test_payloads_and_gates(spark):
    one = '{"marketSides":[{"description":"a","quote":{"bid":0.4,"ask":0.5},"price":0.9},{"description":"b","quote":{"bid":0.6,"ask":0.5},"price":0.3}]}'
    two = r'{"outcomes":"[\"y\",\"n\"]","outcomePrices":"[\"0.25\",\"?\"]"}'
    payloads = [one, two, "{}", None, "no json"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i long, p string").select("i", F.inline(feed.sides_of(F.col("p")))).collect()
    assert [(r.i, r.name, r.mid) for r in rows] == [(0, "a", 0.45), (0, "b", 0.3), (1, "y", 0.25), (1, "n", None)]
    gates = spark.sql("select 0.05D s, 300 d, 200 v union all select null, 300, 200 union all select 0.05D, null, 200").select(feed.liquid(F.col("s"), F.col("d"), F.col("v"), 0.06, 250, 100).alias("ok"))
    assert sorted(r.ok for r in gates.collect()) == [False, False, True]


def test_synthetic_corpus_is_the_same_at_any_partitions(spark):
    one, many = feed.synthetic(spark, 50, 40, 10).coalesce(1), feed.synthetic(spark, 50, 40, 10).repartition(7)
    assert one.exceptAll(many).count() == 0 and one.where("r_id = b_id").count() == 0
    assert abs(one.agg(F.avg(F.when(F.col("winner") == "r", 1.0).otherwise(0.0) - F.col("p_true"))).first()[0]) < 0.06


def test_loader_counts_every_reason(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, files.RAW[kind])
    events = frame([("Night 1 ", "May 4, 2019"), ("Night 2", "2019-06-01")], "events")
    result = lambda event, bout, outcome, method, rnd, clock, form, n: (event, bout, outcome, "Light", method, rnd, clock, form, f"http://x/{n}")
    results = frame([
        result("NIGHT  1", "Ann A vs. Bea B", "W/L", "KO/TKO", "2", "1:30", "3 Rnd (5-5-5)", "f1"), result("Night 1", "Cal C vs. Ann A", "L/W", "DQ", "1", "0:10", "No Time Limit", "f2"),
        result("Night 9", "Ann A vs. Bea B", "W/L", "Decision - Split", "3", "5:00", "3 Rnd (5-5-5)", "f3"), result("Night 2", "Twin T vs. Ann A", "W/L", "Submission", "1", "1:00", "3 Rnd (5-5-5)", "f4"),
        result("Night 2", "Who W vs. Ann A", "W/L", "Submission", "1", "1:00", "3 Rnd (5-5-5)", "f5"), result("Night 2", "Ann A vs. Bea B", "D/D", "Decision", "1", "--", "3 Rnd (5-5-5)", "f6"),
        result("Night 2", "Bea B vs. Cal C", "D/D", "Decision", "2", "3:00", "1 Rnd + OT (12-3)", "f7"),
    ], "results")
    none = ("0 of 0",) * 6
    line = lambda event, bout, rnd, who, kd, ss, ctrl: (event, bout, rnd, who, kd, ss, "1 of 2", "x", "", ctrl, *none)
    stats = frame(
        [line("Night 1", "Ann A vs. Bea B", f"Round {r}", who, "1", f"{r} of 9", "1:05") for r in (1, 2, 3, 1) for who in ("Ann A", "Bea B")]
        + [line("Night 1", "Cal C vs. Ann A", "Round 1", who, "", "2 of 3", "--") for who in ("Cal C", "Ann A")], "stats",
    )
    who = lambda name, height, reach, n: (name, height, reach, "", "Jan 1, 1990", f"http://x/{n}")
    tott = frame([who("Ann A", "5' 10\"", '70"', "a"), who("Bea B", "6' 0\"", "--", "b"), who("Cal C", "--", '74"', "c"), who("Twin T", "5' 8\"", '68"', "t"), who("twin  t", "5' 6\"", '66"', "u")], "tott")
    raw = (events, results, stats, tott, frame([("Rock", "http://x/a")], "details"))
    kept, sides = loader.load(*raw)
    path = scratch_folder(spark, "loaded")
    spark.sparkContext.setJobGroup("loader", "")
    assert loader.write_bouts(path, *raw) == {"kept": 1, "kept as no contest": 1, "no date": 1, "ambiguous name": 1, "not on the roster": 1, "no duration": 1, "no statistics": 1}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("loader"))
    spark.sparkContext.setJobGroup("write", "")
    kept.write.parquet(f"{path}-again")
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("write"))  # counting took no job of its own
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, kept.collect()))
    rows = {r.fight_id: r for r in kept.collect()}
    assert (rows["f1"].total_sec, rows["f1"].r_ss_landed, rows["f1"].r_r1_ss_landed, rows["f1"].r_late_ss_landed, rows["f1"].r_ctrl_sec, rows["f1"].r_kd) == (390.0, 6.0, 1.0, 3.0, 195.0, 3.0)
    assert (rows["f2"].winner, rows["f2"].method, rows["f2"].sched_sec, rows["f2"].r_n_rounds) == ("nc", "DEC", 900.0, 1)
    got = {r.fighter_id: r for r in sides.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].nickname == "Rock" and got["b"].reach_imputed == 1 and abs(got["b"].reach_in - 72) < 1e-9 and got["c"].height_in == 69.0


def test_months_are_written_anew_only_where_rows_changed(spark, tmp_path):
    path = f"file://{tmp_path}/months"
    rows = spark.createDataFrame([(1, "2024-01", False), (2, "2024-01", False), (3, "2024-02", False)], "k long, month string, settled boolean")
    files.replace_months(rows, path)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "months" / "month=2024-01").iterdir()}
    later = spark.read.parquet(path).withColumn("settled", F.col("k") == 3)
    assert [r.month for r in files.rewrite_changed(later, path, ["k"]).collect()] == ["2024-02"]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "months" / "month=2024-01").iterdir()} == before
    assert {(r.k, r.settled) for r in spark.read.parquet(path).collect()} == {(1, False), (2, False), (3, True)}
