"""Probability models: standardizing, logistic with and without intercept or offset, boosting, conformal ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.functions.odds import clipped_logit, sigmoid
from boutline.operators import rates


def moments(rows: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one pass."""
    out = rows.agg(*[F.avg(k).alias(f"m_{k}") for k in names], *[F.stddev_pop(k).alias(f"s_{k}") for k in names]).first()
    return {k: (out[f"m_{k}"] or 0.0, out[f"s_{k}"] or 1.0) for k in names}


def standardized(rows: DataFrame, scale: dict[str, tuple[float, float]], centre: bool = True) -> DataFrame:
    values = {k: ((F.col(k) - (m if centre else 0.0)) / (s or 1.0)).alias(k) for k, (m, s) in scale.items()}
    return rows.select(*[values.get(c, F.col(c)) for c in rows.columns])


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows)


def logistic(rows: DataFrame, names: list[str], label: str = "y", c: float = 0.5, intercept: bool = False):
    """An L2 logistic fit whose penalty is that of inverse strength ``c`` on summed loss."""
    n = rows.count()
    fit = LogisticRegression(labelCol=label, fitIntercept=intercept, standardization=False, regParam=1 / (c * n), maxIter=200, tol=1e-10)
    return fit.fit(assembled(rows, names))


def offset_logistic(rows: DataFrame, names: list[str], offset: str, label: str = "y", l2: float = 5.0):
    """A logistic fit on top of a given log-odds: that column's coefficient is bound to one."""
    n, k = rows.count(), len(names)
    low, high = [[-1e6] * k + [1.0]], [[1e6] * k + [1.0]]
    fit = LogisticRegression(
        labelCol=label, fitIntercept=False, standardization=False, regParam=l2 / n, maxIter=300, tol=1e-10,
        lowerBoundsOnCoefficients=Matrices.dense(1, k + 1, low[0]), upperBoundsOnCoefficients=Matrices.dense(1, k + 1, high[0]),
    )
    return fit.fit(assembled(rows, [*names, offset]))


def boosted(rows: DataFrame, names: list[str], label: str = "y", depth: int = 3, rounds: int = 20):
    return GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, seed=7).fit(assembled(rows, names))


def scored(model, rows: DataFrame, names: list[str], column: str = "p") -> DataFrame:
    """``rows`` with the probability of class one. Of a logistic fit it is an expression of its coefficients, so no task is sent the model."""
    if isinstance(model, LogisticRegressionModel):
        z = sum((F.lit(float(b)) * F.col(k) for b, k in zip(model.coefficients, names)), F.lit(float(model.intercept)))
        return rows.select("*", sigmoid(z).alias(column))
    out = model.transform(assembled(rows, names))
    return out.select(*rows.columns, F.get(vector_to_array("probability"), 1).alias(column))


def symmetrised(model, rows: DataFrame, names: list[str]) -> DataFrame:
    """The mean of a model's view of a bout from both sides; ``names`` change sign when the sides do."""
    turned = rows.select(*[(-F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])
    there = scored(model, rows, names).withColumnRenamed("p", "p_there")
    back = scored(model, turned, names).select("bout_id", F.col("p").alias("p_back"))
    return there.join(back, "bout_id").withColumn("p", (F.col("p_there") + 1 - F.col("p_back")) / 2).drop("p_there", "p_back")


def platt(rows: DataFrame, p: str = "p", label: str = "y") -> tuple[float, float]:
    """Intercept and slope that turn a model's log-odds into calibrated ones."""
    told = rows.select(clipped_logit(F.col(p)).alias("logit"), F.lit(1.0).alias("one"), F.col(label).alias("y"))
    start, slope = newton_logit(told, ["one", "logit"], ridge=[0.0, 1.0])[()]
    return float(start), float(slope)


def calibrated(rows: DataFrame, by: tuple[float, float], p: str = "p") -> DataFrame:
    """``rows`` with the probability moved by ``platt``'s intercept and slope."""
    return rows.withColumn(p, sigmoid(F.lit(by[0]) + F.lit(by[1]) * clipped_logit(F.col(p))))


def conformal_shift(rows: DataFrame, low: str, high: str, y: str, coverage: float = 0.8) -> float:
    """How far a range must widen to hold that share of a calibration set."""
    miss = rows.select(F.greatest(F.col(low) - F.col(y), F.col(y) - F.col(high)).alias("miss"))
    found = rates.quantiles(miss, [], "miss", [coverage]).first()
    return found["edges"][0] if found else None


def binned_quantiles(rows: DataFrame, x: str, y: str, bins: int = 10, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Conditional quantiles of ``y`` by quantile bins of ``x``: ``(bin, low, mid, high)``, joined to the rows."""
    at, table = bin_table(rows, x, y, bins, shares)
    return rows.withColumn("bin", at).join(F.broadcast(table), "bin")


def bin_table(rows: DataFrame, x: str, y: str, bins: int = 10, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> tuple[Column, DataFrame]:
    """The bin of a value of ``x``, and a row for each bin with its quantiles of ``y``; exact, and no task holds all values."""
    found = rates.quantiles(rows, [], x, [k / bins for k in range(1, bins)]).first()
    at = sum((F.when(F.col(x) > c, 1).otherwise(0) for c in (found["edges"] if found else [])), F.lit(0))
    told = rates.quantiles(rows.select(at.alias("bin"), y), ["bin"], y, list(shares))
    return at, told.select("bin", *[F.get("edges", F.lit(i)).alias(n) for i, n in enumerate(("low", "mid", "high"))])


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(a, b, r)`` of each pair of columns, ``a`` the later named; null where a column does not vary.

    One pass, in which a task multiplies its Arrow batches as matrices and tells one row: count, means, and sums of products about them.
    Values are taken from the first of their batch, so that a column of one value has no spread by rounding.
    """
    width, fields = len(names), ["n", "mean", "products"]

    def met(one: tuple | None, other: tuple) -> tuple:
        if one is None:
            return other
        (n, mean, products), (more, its, apart) = one, other
        gap = its - mean
        return n + more, mean + gap * (more / (n + more)), products + apart + np.outer(gap, gap) * (n * more / (n + more))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
                first = x[0].copy()
                x -= first
                mean = x.mean(axis=0)
                total = met(total, (len(x), first + mean, (x - mean).T @ (x - mean)))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[0]], pa.int64()), pa.array([total[1].tobytes()], pa.binary()), pa.array([total[2].tobytes()], pa.binary())], names=fields)

    def paired(group: pa.Table) -> pa.Table:
        total = None
        for n, mean, products in sorted(zip(*[group.column(f).to_pylist() for f in fields])):  # a row a task
            total = met(total, (n, np.frombuffer(mean), np.frombuffer(products).reshape(width, width)))
        i, j = np.tril_indices(width, -1)
        spread = np.sqrt(np.diag(total[2]))
        both = spread[i] * spread[j]
        r = np.divide(total[2][i, j], both, out=np.full(len(i), np.nan), where=both > 0)
        return pa.table({"a": pa.array([names[k] for k in i]), "b": pa.array([names[k] for k in j]), "r": pa.array(r, pa.float64(), from_pandas=True)})

    sums = rows.select(*names).mapInArrow(told, "n long, mean binary, products binary")
    return sums.groupBy().applyInArrow(paired, "a string, b string, r double")


def date_cut(rows: DataFrame, share: float, day: str = "dt") -> int:
    """The day number below which a share of the rows lies."""
    return int(rows.agg(F.percentile(F.unix_date(day), share)).first()[0])


def split(rows: DataFrame, share: float, day: str = "dt") -> tuple[DataFrame, DataFrame]:
    """Earlier and later rows; never a random split."""
    cut = date_cut(rows, share, day)
    return rows.where(F.unix_date(day) <= cut), rows.where(F.unix_date(day) > cut)


# The distribution function of a Poisson variable of mean one.
POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)


def poisson(u: Column) -> Column:
    """A Poisson weight of mean one from a number between 0 and 1."""
    return sum((F.when(u >= s, 1).otherwise(0) for s in POISSON), F.lit(0))


def newton_logit(rows: DataFrame, names: list[str], y: str = "y", keys: list[str] = (), ridge: list[float] | None = None, offset: str | None = None, weight: str | None = None, steps: int = 10) -> dict[tuple, np.ndarray]:
    """Logistic fits of every key at once, by Newton steps on penalised loss: the coefficients by key.

    A step is one aggregation for all keys: gradient and curvature, as many numbers as names squared for each key, are all that
    comes to the driver. ``ridge`` is the penalty of each coefficient on the summed loss; for an intercept, name a column of ones and
    give it none.
    """
    k, ridge = len(names), np.array(ridge or [0.0] * len(names))
    found = {tuple(r): np.zeros(k) for r in rows.select(*keys).distinct().collect()} if keys else {(): np.zeros(k)}
    w = F.col(weight) if weight else F.lit(1.0)
    for _ in range(steps):
        told = rows
        if keys:
            schema = ", ".join([*[f"{n} {t}" for n, t in rows.select(*keys).dtypes], "beta_ array<double>"])
            told = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(*key, c.tolist()) for key, c in found.items()], schema)), list(keys))
            beta = [F.get("beta_", F.lit(i)) for i in range(k)]
        else:
            beta = [F.lit(float(c)) for c in found[()]]
        z = sum((b * F.col(n) for b, n in zip(beta, names)), F.col(offset) if offset else F.lit(0.0))
        told = told.select(*keys, *names, F.col(y).cast("double").alias("y_"), w.alias("w_"), (1 / (1 + F.exp(-z))).alias("p_"))
        slope = [F.sum(F.col("w_") * F.col(a) * (F.col("y_") - F.col("p_"))).alias(f"g{i}") for i, a in enumerate(names)]
        curve = [F.sum(F.col("w_") * F.col("p_") * (1 - F.col("p_")) * F.col(names[i]) * F.col(names[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i + 1)]
        for r in (told.groupBy(*keys) if keys else told.groupBy()).agg(*slope, *curve).collect():
            key = tuple(r[n] for n in keys)
            h = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) + np.diag(ridge + 1e-12)
            found[key] = found[key] + np.linalg.solve(h, np.array([r[f"g{i}"] or 0.0 for i in range(k)]) - ridge * found[key])
    return found


def quantile_fit(rows: DataFrame, names: list[str], y: str, shares: list[float], steps: int = 30, eps: float = 1e-3) -> np.ndarray:
    """Linear quantile regressions, a row of coefficients for each share, by the majorising quadratic of the pinball loss.

    A step is one aggregation for all shares. For an intercept, name a column of ones.
    """
    k = len(names)
    first = rows.agg(F.percentile(y, shares)).first()[0]
    beta = np.zeros((len(shares), k))
    beta[:, 0] = first if names[0] == "one" else 0.0
    for _ in range(steps):
        told = rows
        for s in range(len(shares)):
            gap = F.col(y) - sum((F.lit(float(b)) * F.col(n) for b, n in zip(beta[s], names)), F.lit(0.0))
            told = told.withColumn(f"w{s}", 1 / (eps + F.abs(gap)))
        sums = [F.sum(F.col(n)).alias(f"s_{i}") for i, n in enumerate(names)]
        sums += [F.sum(F.col(f"w{s}") * F.col(a) * F.col(y)).alias(f"b{s}_{i}") for s in range(len(shares)) for i, a in enumerate(names)]
        sums += [F.sum(F.col(f"w{s}") * F.col(names[i]) * F.col(names[j])).alias(f"a{s}_{i}_{j}") for s in range(len(shares)) for i in range(k) for j in range(i + 1)]
        r = told.agg(*sums).first()
        for s, q in enumerate(shares):
            a = np.array([[r[f"a{s}_{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) + 1e-9 * np.eye(k)
            beta[s] = np.linalg.solve(a, np.array([r[f"b{s}_{i}"] + (2 * q - 1) * r[f"s_{i}"] for i in range(k)]))
    return beta


def boosted_regression(rows: DataFrame, names: list[str], label: str, depth: int = 3, rounds: int = 20):
    return GBTRegressor(labelCol=label, maxDepth=depth, maxIter=rounds, seed=7).fit(assembled(rows, names))


def multinomial(rows: DataFrame, names: list[str], label: str = "y", c: float = 1.0):
    """Several classes by one logistic fit; its probabilities sum to one."""
    return LogisticRegression(labelCol=label, family="multinomial", standardization=False, regParam=1 / (c * rows.count()), maxIter=100).fit(assembled(rows, names))
