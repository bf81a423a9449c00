"""Semantics that SQL does not show: folds, leakage, symmetry, parsers, sources and streams."""

import datetime
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from boutline.functions import odds, text
from boutline.operators import career, market, names, rating, survival
from boutline.plans import text_queries
from boutline.sources import files, views


@pytest.fixture(scope="module")
def bouts(spark, sf):
    rows = views.bouts(spark, sf).persist()
    yield rows
    rows.unpersist()


def test_running_sums_equal_a_fold(bouts):
    app = views.appearances(bouts)
    got = {(r.bout_id, r.side): (r.n_prior, r.s_wins, r.s_ss_landed, r.s_w_ko) for r in career.running_sums(app).collect()}
    state = {}
    for r in sorted(app.collect(), key=lambda r: (r.dt, r.bout_id)):
        n, wins, landed, ko = state.get(r.entity, (0, 0.0, 0.0, 0.0))
        assert got[r.bout_id, r.side] == (n, wins, landed, ko)
        won = r.result == "W"
        state[r.entity] = (n + 1, wins + won, landed + r.ss_landed, ko + (won and r.method == "KO/TKO"))


def test_no_later_bout_changes_a_feature(bouts):
    cut = datetime.date(1997, 1, 1)
    whole = career.snapshots(views.appearances(bouts)).where(F.col("dt") <= F.lit(cut)).select("bout_id", "side", "slpm", "win_pct", "td_def")
    short = career.snapshots(views.appearances(bouts.where(F.col("dt") <= F.lit(cut)))).select("bout_id", "side", "slpm", "win_pct", "td_def")
    assert whole.exceptAll(short).count() == 0 and short.count() == whole.count() > 0


def test_mirrored_rows_are_negations(bouts):
    rows = career.win_rows(career.schedule_strength(career.snapshots(views.appearances(bouts))))
    sums = rows.groupBy("bout_id").agg(F.max(F.abs(F.lit(0.0))).alias("z"), F.sum("d_win_pct").alias("d"), F.sum("x_ko").alias("x"), F.sum("y").alias("y"))
    worst = sums.agg(F.max(F.abs("d")), F.max(F.abs("x")), F.min("y"), F.max("y")).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 and worst[2] == worst[3] == 1


def test_rating_equals_a_fold(bouts):
    """Against the formulas written out here, bout by bout."""
    value, last, want = {}, {}, {}
    for r in sorted(bouts.collect(), key=lambda r: (r.dt, r.bout_id)):
        told = []
        for who in (r.r_id, r.b_id):
            days = (r.dt - last.get(who, r.dt)).days
            told.append(1500 + (value.get(who, 1500.0) - 1500) * math.exp(-0.06 * days / 365.25))
        want[r.bout_id] = told
        expected = 1 / (1 + 10 ** ((told[1] - told[0]) / 400))
        change = 24 * (1.0 if r.method == "DEC" else 1.3) * ({"r": 1.0, "b": 0.0, "draw": 0.5}[r.winner] - expected)
        for who, sign in ((r.r_id, 1), (r.b_id, -1)):
            value[who], last[who] = value.get(who, 1500.0) + sign * change, r.dt
    got = {r.bout_id: (r.r_elo, r.b_elo) for r in rating.ratings(bouts).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for i in got for a, b in zip(got[i], want[i]))


def test_joint_sums_to_one(bouts):
    out = survival.roll_up(survival.with_hazards(bouts)).agg(F.max(F.abs(F.col("total") - 1))).first()[0]
    assert out < 1e-9


def test_settlement_takes_the_nearest_then_the_earliest(spark):
    day = datetime.date
    bouts = spark.createDataFrame([(1, day(2020, 1, 1), 7, 8, "r"), (2, day(2020, 1, 5), 8, 7, "r"), (3, day(2021, 1, 1), 7, 8, "b"), (4, day(2021, 1, 1), 7, 8, "draw")], "bout_id long, dt date, r_id long, b_id long, winner string")
    claims = spark.createDataFrame([(1, day(2020, 1, 3), 7, 8), (2, day(2020, 1, 4), 7, 8), (3, day(2020, 6, 1), 7, 8), (4, day(2021, 1, 2), 8, 7)], "claim_id long, claim_dt date, a long, b long")
    got = {r.claim_id: (r.bout_id, r.gap, r.hit) for r in market.settle(claims, bouts).collect()}
    assert got == {1: (1, 2, 1), 2: (2, 1, 0), 3: (None, None, None), 4: (3, 1, 1)}


def test_opening_mark_survives_dedupe(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(now, "v", 1, 10, 0.4, True), (now, "v", 1, 11, 0.5, False)], "captured timestamp, venue string, pair long, quote_id long, p1 double, opening boolean")
    out = market.dedupe(rows).collect()
    assert len(out) == 1 and out[0].opening and out[0].p1 == 0.5 and out[0].quote_id == 11


def test_older_rows_get_defaults(spark):
    rows = market.migrate(spark.createDataFrame([(1,)], "pair long"), {"venue": "legacy", "settled": False})
    assert rows.first() == (1, "legacy", False)


def test_text_functions(spark):
    row = spark.sql("select '34 of 78' a, '4:31' c, '5'' 11\"' h, '1 Rnd + OT (12-3)' f, 'May 4, 2019' d, '--' bad").select(
        *text.of_pair(F.col("a")), text.clock_seconds(F.col("c")), text.height_inches(F.col("h")), text.round_lengths(F.col("f")), text.mixed_date(F.col("d")),
        text.clock_seconds(F.col("bad")), text.elapsed_seconds(F.lit(2), F.lit(60.0), text.round_lengths(F.col("f"))), text.surname(F.lit("ann b example")),
    ).first()
    assert list(row) == [34.0, 78.0, 271.0, 71.0, [720, 180], datetime.date(2019, 5, 4), 0.0, 780.0, "example"]


def test_accent_keys_take_whole_texts(spark, tmp_path):
    rows = [(1, "Émile Zöla was the first of names, ÀND Ñandu 7 the\nlast"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.key for r in text_queries.accent_keys(spark, str(tmp_path)).collect()}
    assert got == {1: "emile zola was the first of names and nandu thelast", 2: "", 3: None}


def test_odds(spark):
    row = spark.range(1).select(odds.american_to_prob(F.lit(-150.0)), odds.american_to_prob(F.lit(0.0)), odds.fair_american(F.lit(0.6)), odds.devig(F.lit(2.0), F.lit(2.0))).first()
    assert [round(x, 6) for x in row] == [0.6, 1.0, -150.0, 0.5]


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 34))) for _ in range(60)]
    roster = [(i, k) for i, k in enumerate(base + base[:3])]
    asked = []
    for k in base * 3:
        for _ in range(rng.randint(0, 5)):
            at = rng.choice([0, rng.randint(0, len(k)), len(k)])
            k = k[:at] + rng.choice(["", "x", "a"]) + k[at + rng.randint(0, 1) :]
        asked.append((len(asked), k))
    want = {}
    for n, a in asked:
        scores = [(-SequenceMatcher(None, a, k).ratio(), i) for i, k in roster]
        if -min(scores)[0] >= names.CUTOFF:
            want[n] = min(scores)[1]
    got = names.fuzzy(spark.createDataFrame(asked, "ask_id long, key string"), spark.createDataFrame(roster, "id long, key string"))
    assert {r.ask_id: r.id for r in got.collect()} == want


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([(1, datetime.date(2024, 1, 3)), (2, datetime.date(2024, 2, 3))], "k long, day date")
    files.append_by_month(rows, "day", f"{root}/ledger")
    files.append_by_month(rows, "day", f"{root}/ledger")
    assert {r.month: r["count"] for r in spark.read.schema("k long, month string").json(f"{root}/ledger").groupBy("month").count().collect()} == {"2024-01": 2, "2024-02": 2}
    assert files.write_once(rows, f"{root}/once") and not files.write_once(rows.limit(1), f"{root}/once")
    assert files.write_unless_smaller(rows, f"{root}/big") and not files.write_unless_smaller(rows.limit(1), f"{root}/big")
    built = []
    make = lambda: built.append(1) or rows
    files.cached(make, spark, f"{root}/cache", 10)
    files.cached(make, spark, f"{root}/cache", 20)
    files.cached(make, spark, f"{root}/cache", 60)
    assert len(built) == 2
    (tmp_path / "map.txt").write_text("# note\nAnn E = Ann Example\n\n")
    assert files.read_map(spark, f"{root}/map.txt").collect() == [("ann e", "Ann Example")]
    assert files.read_raw(spark, f"{root}/none.csv", "details").count() == 0
    nan = spark.createDataFrame([(1, float("nan"))], "k long, v double")
    assert files.json_documents(nan, "k").first().json == '{"k":1,"v":null}'


def test_trailing_rate_equals_a_fold(spark):
    rng = random.Random(3)
    rows = [(i, datetime.date(2020, 1, 1) + datetime.timedelta(days=rng.randrange(40)), float(rng.random() < 0.4)) for i in range(300)]
    got = {r.bout_id: (r.n_before, r.anchor) for r in career.trailing_rate(spark.createDataFrame(rows, "bout_id long, dt date, y double"), 25).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for k, (i, _, _) in enumerate(order):
        past = [y for _, _, y in order[max(0, k - 25) : k]]
        assert got[i][0] == len(past) and abs(got[i][1] - (sum(past) / len(past) if past else 0.5)) < 1e-12
