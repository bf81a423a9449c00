"""What keeps work in bounds as tables grow: what is shuffled, and what is computed once for many rows."""

import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from boutline.llm import simhash
from boutline.operators import career, questions, rates
from boutline.plans import claim_queries, fit_queries, model_queries, models, question_queries, source_queries, text_queries
from boutline.sources import offline, views


def test_strength_is_that_of_snapshots_and_leaves_out_what_nobody_asks_for(spark, sf):
    rows = views.bouts(spark, sf)
    got = career.strength(rows).select("bout_id", "side", "adj_slpm", "adj_td15", "n_prior")
    want = career.schedule_strength(career.snapshots(views.appearances(rows))).select(*got.columns)
    assert sorted(got.collect()) == sorted(want.collect())
    plan = career.win_rows(career.strength(rows)).select("bout_id", "y", "d_win_pct")._jdf.queryExecution().optimizedPlan().toString()
    assert "late_volume_ret" not in plan and "body_share" not in plan  # both sides met in structs of all columns before


def test_lines_are_shuffled_before_their_statistics_are_made(spark, sf):
    plan = views.bouts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_late_ctrl_sec") < plan.index("Window")  # plans are printed from the top


def test_quantiles_of_a_crowded_part_take_a_second_level(spark, monkeypatch):
    monkeypatch.setattr(rates, "CROWD", 10)
    values = [1e9, *[i / 1000 for i in range(200)]]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert np.allclose(rates.quantiles(rows, [], "v", [0.1, 0.5, 0.77]).first()["edges"], np.quantile(values, [0.1, 0.5, 0.77]))


def test_ranges_read_their_rows_from_what_was_written_once(spark, sf, monkeypatch):
    names, whole = [], model_queries.staged
    monkeypatch.setattr(model_queries, "staged", lambda df, name: names.append(name) or whole(df, name))
    model_queries.conformal_range(spark, sf)
    assert names[0] == "panel"
    rows = spark.createDataFrame([(float(i % 97), float(i)) for i in range(1000)], "x double, y double")
    at, table = models.bin_table(rows, "x", "y", 4)
    told = rows.withColumn("bin", at).toPandas()
    for r in table.collect():
        assert np.allclose([r.low, r.mid, r.high], np.quantile(told[told.bin == r.bin].y, [0.1, 0.5, 0.9]))


def test_bouts_alike_share_a_curve(spark, sf, monkeypatch):
    sizes, whole = {}, model_queries.staged
    monkeypatch.setattr(model_queries, "staged", lambda df, name: sizes.setdefault(name, whole(df, name)))
    model_queries.hazard_calibrate(spark, sf)
    assert sizes["curves"].count() == views.bouts(spark, sf).select("sched_sec", "r_kd", "b_kd").distinct().count()


def test_a_logistic_score_is_an_expression(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 5 > 1)) for i in range(60)], "a double, b double, y int")
    model = models.logistic(rows, ["a", "b"], c=1.0, intercept=True)
    told = models.scored(model, rows, ["a", "b"])
    assert "UDF" not in told._jdf.queryExecution().optimizedPlan().toString()
    z = np.array([[r.a, r.b] for r in told.collect()]) @ model.coefficients.toArray() + model.intercept
    assert np.allclose([r.p for r in told.collect()], 1 / (1 + np.exp(-z)))


def test_standardized_features_join_nothing(spark, sf):
    assert "Join" not in fit_queries.standardized_features(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_of_the_pipeline_are_told_by_fingerprints_too(spark):
    body, tails = "x y z " * 1000, [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    rows = [(1, body + tails[0]), (2, body + tails[1]), (3, " ".join(tails))]
    assert simhash.fingerprint(rows[0][1].encode()) == simhash.fingerprint(rows[1][1].encode())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]  # sets of shingles alone kept 2


def test_claims_meet_outcomes_before_there_is_a_row_for_each_market(spark, sf):
    plan = claim_queries.market_bands(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join")  # plans are printed from the top


def test_a_saved_response_is_a_batch_of_its_own(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text("x" * i)
    reader = offline.SavedReader({"path": f"file://{tmp_path}", "tasks": "1"})
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1] * 5


def test_boards_have_pages_and_raw_files_are_compressed(spark, sf, monkeypatch):
    want = sorted(source_queries.odds_responses(spark, sf).collect(), key=str)
    monkeypatch.setattr(source_queries, "PAGE", 3)
    got = sorted(source_queries.odds_responses(spark, sf).collect(), key=str)
    assert [(r.book, r.day, r.n, r.upper) for r in got] == [(r.book, r.day, r.n, r.upper) for r in want]
    root = source_queries._write_raw(spark, sf).removeprefix("file://")
    names = [n for n in os.listdir(f"{root}/stats.csv") if n.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)


def test_what_a_stream_has_written_is_read_by_bytes(spark, sf, monkeypatch):
    taken, whole = [], text_queries.ledger.quote_stream
    monkeypatch.setattr(text_queries.ledger, "quote_stream", lambda *a, **k: taken.append(k) or whole(*a, **k))
    text_queries.events_stream_open_close(spark, sf)
    assert taken == [{}, {"most_bytes": text_queries.ledger.HOP}]


def test_questions_are_read_once_and_a_subject_is_that_of_its_pattern(spark, sf):
    assert not [f for f in question_queries.market_mapping(spark, sf).inputFiles() if "lineitem" in f]  # bouts were made anew for each use
    rng = random.Random(3)
    told = [" " + " ".join(rng.choice(["in", "vs", "vs.", "ann", "in?", "?", "bin", "vsx"]) for _ in range(rng.randint(1, 9))) + " " for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in told], "told string").select("told", questions.subject(F.col("told")).alias("subject")).collect()
    assert [r.subject for r in rows] == [re.sub(r"\bin [^?]*?\bvs\b[^?]*", " ", r.told) for r in rows]


def test_bouts_are_dealt_to_entities_before_their_statistics_are_made(spark, sf, monkeypatch):
    names, whole = [], fit_queries.staged
    monkeypatch.setattr(career, "staged", lambda df, name: names.append(name) or whole(df, name))
    limit = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "1000")
    try:
        plan = career.strength(views.pairings(spark, sf), views.with_stats)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(limit, before)
    made, dealt = plan.index("late_ctrl_sec"), plan.index("RepartitionByExpression")
    assert made < dealt and "late_ctrl_sec" not in plan[dealt:]  # plans are printed from the top
    assert names == ["bouts", "defences"]  # lines were read and shuffled twice


def test_cornered_rows_are_appearances(spark, sf):
    rows = views.bouts(spark, sf)
    got = career.dealt(views.pairings(spark, sf), views.with_stats)
    assert sorted(got.collect()) == sorted(views.appearances(rows).select(*got.columns).collect())


def test_fits_write_their_rows_once(spark, sf, monkeypatch):
    names, whole = [], fit_queries.staged
    monkeypatch.setattr(fit_queries, "staged", lambda df, name: names.append(name) or whole(df, name))
    monkeypatch.setattr(fit_queries, "DRAWS", 5)
    fit_queries.coefficient_bootstrap(spark, sf)
    fit_queries.ablation_arms(spark, sf)
    assert names == ["one", "one", "gains"]  # rows over their deviations were written beside the rows


def test_pages_come_in_parts_and_are_parsed_as_a_whole(spark, sf, monkeypatch):
    sizes, whole = [], text_queries.wiki.parsed
    monkeypatch.setattr(text_queries.wiki, "parsed", lambda rows, key, text, *more: sizes.append(rows.agg(F.max(F.length(text))).first()[0]) or whole(rows, key, text, *more))
    want = {q: sorted(getattr(text_queries, q)(spark, sf).collect()) for q in ("card_pages", "record_pages")}
    monkeypatch.setattr(text_queries, "PART", 1)
    assert all(sorted(getattr(text_queries, q)(spark, sf).collect()) == rows for q, rows in want.items())
    assert sizes[0] > sizes[2] and sizes[1] > sizes[3] and max(sizes) < 5000  # a page was one text of a month


def test_correlations_are_one_product_of_matrices(spark, sf):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4)) * [1, 1e-3, 10, 1] + [0, 1e4, 0, 0]
    x[:, 2] += 8 * x[:, 0]
    x[:, 3] = 0.1
    names = list("abcd")
    rows = spark.createDataFrame(x.tolist(), ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.a, r.b): r.r for r in models.correlations(rows, names).collect()}
    want = np.corrcoef(x[:, :3].T)
    assert len(got) == 6 and all(got["d", n] is None for n in "abc")
    assert np.allclose([got["b", "a"], got["c", "a"], got["c", "b"]], [want[1, 0], want[2, 0], want[2, 1]], atol=1e-9)
    assert models.correlations(rows.where("a is null"), names).count() == 0
    plan = model_queries.corr_matrix(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "corr(" not in plan  # three hundred aggregates of six numbers each
