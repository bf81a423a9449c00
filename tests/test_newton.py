"""Fits of any width against a plain solution, by weights, offsets and allowed features."""

import numpy as np
import pytest

from boutline.plans import newton
from boutline.sources.views import on_workers


def plain(x, y, w, o, ridge, allowed):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(o + x @ beta)))
        g = x.T @ (w * (y - p)) - ridge * beta
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        at = np.flatnonzero(allowed)
        beta[at] += np.linalg.solve(h[np.ix_(at, at)], g[at])
    return beta


@pytest.mark.parametrize("parts", [1, 13])
def test_thirty_features_in_folds_draws_and_arms(spark, parts):
    on_workers(spark)
    rng = np.random.default_rng(0)
    n, d = 900, 30
    x = rng.normal(size=(n, d))
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(size=d) / 4)))).astype(int)
    names = [f"f{i}" for i in range(d)]
    rows = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "id long, y int, " + ", ".join(f"{c} double" for c in names)).repartition(parts)
    fits = 140
    allowed = np.ones((fits, d), bool)
    allowed[1, 10:], allowed[2, ::2] = False, False
    weigh = lambda ids: np.where(np.arange(fits) < 3, 1.0, (ids[:, None] * 31 + np.arange(fits) * 7) % 5)
    shift = lambda ids: np.where(np.arange(fits) == 4, (ids[:, None] % 3 - 1) / 2, 0.0)
    ridge = 1.0 + np.arange(fits) % 4
    got = newton.newton_fits(rows, names, fits, uses=["id"], weights=lambda c: weigh(c["id"]), offsets=lambda c: shift(c["id"]), allowed=allowed, ridge=ridge)
    w, o = weigh(np.arange(n)), shift(np.arange(n))
    for k in (0, 1, 2, 3, 4, 77, 139):
        np.testing.assert_allclose(got[k], plain(x, y, w[:, k], o[:, k], ridge[k], allowed[k]), atol=1e-6)


def test_no_rows(spark):
    rows = spark.createDataFrame([], "y int, a double, b double")
    assert newton.newton_fits(rows, ["a", "b"], 2, ridge=1.0).tolist() == [[0.0, 0.0], [0.0, 0.0]]


def test_hazards_are_those_of_a_row_for_each_minute_and_none_is_made(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from boutline.operators import survival
    from boutline.plans import model_queries, models
    from boutline.plans.career_queries import strength
    from boutline.sources.views import bouts

    got = model_queries.hazard_multinomial(spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan and "Window" not in plan  # the bouts were broadcast to their minutes
    known = strength(spark, sf).groupBy("bout_id").agg(*[F.max(F.when(F.col("side") == s, F.col("kd15"))).alias(s) for s in "rb"])
    base = bouts(spark, sf).join(known, "bout_id").withColumns({"gap": F.col("r") - F.col("b"), "level": F.col("r") + F.col("b")}).select("bout_id", "sched_sec", "gap", "level").cache()
    names = ["minute", "gap", "level"]
    train = survival.intervals(bouts(spark, sf)).join(base, "bout_id").withColumn("gap", F.when(F.col("orient") == 0, F.col("gap")).otherwise(-F.col("gap")))
    model = LogisticRegression(labelCol="class", family="multinomial", regParam=1e-4, maxIter=1000, tol=1e-13).fit(models.assembled(train.select(*names, "class"), names))
    grid = base.withColumn("minute", F.explode(F.sequence(F.lit(1), (F.col("sched_sec") / 60).cast("int"))))
    p = model.transform(models.assembled(grid, names)).withColumn("p", vector_to_array("probability"))
    want = survival.roll_up(p.select("bout_id", "minute", *[F.get("p", k).alias(f"h{k}") for k in range(1, 5)])).select(*got.columns)
    got, want = (np.array(sorted(map(tuple, x.collect()))) for x in (got, want))
    assert got.shape == want.shape and np.abs(got - want).max() < 1e-4
