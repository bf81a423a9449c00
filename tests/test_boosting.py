"""Boosted trees against a plain version of the same trees, and on rows with a signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutline.plans import boosting, models
from boutline.sources.views import on_workers


def plain_quantile_round(bins, y, pred, share, least, low, high, depth):
    """One tree by loops over rows; returns what it adds to each row."""
    groups = [np.arange(len(y))]
    for _ in range(depth):
        after = []
        for rows in groups:
            above = y[rows] > pred[rows]
            slope = lambda r: share * (y[r] > pred[r]).sum() - (1 - share) * (y[r] <= pred[r]).sum()
            strength = lambda r: slope(r) ** 2 / max(len(r), 1)
            best, found = 0.0, None
            for f in range(bins.shape[1]):
                for last in range(boosting.BINS):
                    left, right = rows[bins[rows, f] <= last], rows[bins[rows, f] > last]
                    if min(len(left), len(right)) >= least:
                        gain = round(strength(left) + strength(right) - strength(rows), 8)
                        if gain > best:
                            best, found = gain, (left, right)
            assert len(above) == len(rows)
            after += found or (rows, rows[:0])
        groups = after
    out, width = np.zeros(len(y)), (high - low) / boosting.CELLS
    for rows in groups:
        if len(rows):
            cells = np.sort(np.clip(np.floor((y[rows] - pred[rows] - low) / (high - low) * boosting.CELLS), 0, boosting.CELLS - 1))
            wanted = share * len(rows)
            cell = next(c for i, c in enumerate(cells, 1) if i >= wanted)
            before, inside = (cells < cell).sum(), (cells == cell).sum()
            out[rows] = low + (cell + (wanted - before) / inside) * width
    return out


@pytest.fixture(scope="module")
def signal():
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (3000, 4))
    noise = rng.normal(size=3000) * (0.2 + np.abs(x[:, 1]))
    score = np.stack([2 * (x[:, 0] * x[:, 1] > 0), 2 * (np.abs(x[:, 2]) > 0.5), np.ones(3000)], axis=1)
    p = boosting.softmax(score)
    return x, 3 * (x[:, 0] > 0) + x[:, 2] ** 2 + noise, (rng.random(3000)[:, None] > p.cumsum(axis=1)).sum(axis=1)


def frame(spark, x, y, parts=5):
    on_workers(spark)
    names = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(parts), names


def test_quantile_trees_equal_plain_ones(spark, signal):
    x, y = signal[0][:400], signal[1][:400]
    rows, names = frame(spark, x, y)
    edges = boosting.feature_edges(rows, names)
    for f in range(4):
        np.testing.assert_allclose(edges[f], np.quantile(x[:, f], np.arange(1, 16) / 16), rtol=1e-12)
    objective, base, rate = boosting.Quantiles((0.1, 0.5, 0.9), 20), np.array([0.0, 1.0, 2.0]), 0.3
    table = rows.select("id", "y", boosting.binned(names, edges).alias("bins"))
    model = boosting.boost(table, objective, base, 3, 2, rate)
    got = np.array([r.pred for r in boosting.predicted(table, model).orderBy("id").collect()])
    bins = np.array([r.bins for r in table.orderBy("id").collect()])
    for k, share in enumerate(objective.shares):
        pred, least, most = np.full(400, base[k]), base[k], base[k]
        for tree in model.rounds:
            added = plain_quantile_round(bins, y, pred, share, 20, y.min() - most, y.max() - least, 2)
            pred, least, most = pred + rate * added, least + rate * tree.value[k].min(), most + rate * tree.value[k].max()
        np.testing.assert_allclose(got[:, k], pred, atol=1e-9)


def test_ranges_hold_what_they_claim(spark, signal):
    x, y, _ = signal
    rows, names = frame(spark, x, y)
    table = rows.select("id", "y", boosting.binned(names, boosting.feature_edges(rows.where("id < 1500"), names)).alias("bins"))
    model = boosting.boost(table.where("id < 1500"), boosting.Quantiles((0.1, 0.5, 0.9)), np.quantile(y[:1500], [0.1, 0.5, 0.9]), 20, 3, 0.3)
    assert boosting.KEPT < 20  # predictions were written on the way
    told = np.array([r.pred for r in boosting.predicted(table.where("id >= 1500"), model).orderBy("id").collect()])
    low, mid, high = np.minimum(told[:, 0], told[:, 1]), told[:, 1], np.maximum(told[:, 1], told[:, 2])
    later = y[1500:]
    shift = np.quantile(np.maximum(low - later, later - high)[:750], 0.8)
    inside = ((later >= low - shift) & (later <= high + shift))[750:]
    assert abs(inside.mean() - 0.8) <= 0.045  # two points, and what chance does to 750 rows
    assert np.abs(later - mid).mean() < 0.6 * np.abs(later - np.median(y[:1500])).mean()


def test_classes_beat_priors_and_a_linear_fit(spark, signal):
    x, _, way = signal
    rows, names = frame(spark, x, way)
    table = rows.select("id", "y", *names, boosting.binned(names, boosting.feature_edges(rows.where("id < 2000"), names)).alias("bins"))
    prior = np.bincount(way[:2000], minlength=3) / 2000
    model = boosting.boost(table.where("id < 2000"), boosting.Classes(3), np.log(prior), 12, 3, 0.4)
    told = np.array([r.pred for r in boosting.predicted(table.where("id >= 2000"), model).orderBy("id").collect()])
    p = boosting.softmax(told)
    np.testing.assert_allclose(p.sum(axis=1), 1, atol=1e-12)
    loss = lambda q: -np.log(q[np.arange(1000), way[2000:]]).mean()
    linear = models.multinomial(rows.where("id < 2000"), names).transform(models.assembled(rows.where("id >= 2000"), names)).orderBy("id").select("probability").collect()
    assert loss(p) < loss(np.array([r.probability.toArray() for r in linear])) - 0.03 < loss(np.tile(prior, (1000, 1)))
    # In one round from the priors the first tree is that of a plain Newton step.
    one = boosting.boost(table.where("id < 2000"), boosting.Classes(3), np.log(prior), 1, 1, 1.0).rounds[0]
    bins = np.array([r.bins for r in table.where("id < 2000").orderBy("id").collect()])
    for k in range(3):
        g, h = (way[:2000] == k) - prior[k], np.full(2000, prior[k] * (1 - prior[k]))
        right = bins[:, one.feature[k][0]] > one.last[k][0]
        np.testing.assert_allclose(one.value[k], [g[~right].sum() / (h[~right].sum() + 1), g[right].sum() / (h[right].sum() + 1)], rtol=1e-9)
        strength = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        gains = [strength(bins[:, f] <= b) + strength(bins[:, f] > b) for f in range(4) for b in range(15)]
        assert abs(max(gains) - strength(right) - strength(~right)) < 1e-7


def test_no_split_where_rows_are_few(spark):
    rows, names = frame(spark, np.array([[0.0], [1.0], [2.0]]), np.array([1.0, 2.0, 3.0]))
    table = rows.select("id", "y", boosting.binned(names, boosting.feature_edges(rows, names)).alias("bins"))
    model = boosting.boost(table, boosting.Quantiles((0.5,)), np.array([2.0]), 2, 2, 0.5)
    assert all((t.feature == -1).all() for t in model.rounds)
    assert boosting.predicted(table, model).agg(F.countDistinct("pred")).first()[0] == 1
