"""Boosted trees from histograms: several outputs at once, a tree for each and round.

Features are binned once by quantiles. A level of all trees of a round is one pass: tasks sum what the objective needs by output, node, feature
and bin, and the sums meet in a tree, so what comes to the driver is bounded by these numbers and never by rows. Predictions are kept with
the rows and written again every ``KEPT`` rounds; trees since then are applied as the rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.operators import rates
from boutline.plans.newton import partitions_of, tree_sum
from boutline.sources.scratch import staged

BINS, KEPT = 16, 8
#: Cells of equal width in which the residuals of a leaf are counted to find its quantile.
CELLS = 2048
ROWS = 8192


class Quantiles(NamedTuple):
    """The pinball loss: splits by its gradient, leaves at the share's quantile of what is left."""

    shares: tuple[float, ...]
    least: int = 40

    @property
    def outputs(self) -> int:
        return len(self.shares)

    def channels(self, pred: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        return [(y[:, None] > pred).astype(float)]

    def strength(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How much a node gains by a leaf of its own; sums have the outputs first and the channels last."""
        share = np.array(self.shares).reshape(-1, *[1] * (n.ndim - 1))
        slope = share * sums[..., 0] - (1 - share) * (n - sums[..., 0])
        return slope * slope / np.maximum(n, 1)


class Classes(NamedTuple):
    """The loss of a softmax over ``outputs`` classes; leaves are Newton steps."""

    outputs: int
    least: int = 40
    ridge: float = 1.0

    def channels(self, pred: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        p = softmax(pred)
        return [(y[:, None] == np.arange(self.outputs)) - p, p * (1 - p)]

    def strength(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        return sums[..., 0] ** 2 / (sums[..., 1] + self.ridge)


def softmax(pred: np.ndarray) -> np.ndarray:
    e = np.exp(pred - pred.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Round(NamedTuple):
    """A tree for each output: nodes in heap order with feature (-1: none, all go left) and last bin that goes left, and the leaves' values."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray


class Model(NamedTuple):
    base: np.ndarray
    rounds: list[Round]
    rate: float


def nodes(tree: Round, output: int, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row ``depth`` levels down, from 0."""
    at, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = tree.feature[output][at]
        right = (f >= 0) & (bins[row, np.maximum(f, 0)] > tree.last[output][at])
        at = 2 * at + 1 + right
    return at - (2**depth - 1)


def moved(pred: np.ndarray, rounds: list[Round], rate: float, bins: np.ndarray) -> np.ndarray:
    for tree in rounds:
        depth = tree.value.shape[1].bit_length() - 1
        pred = pred + rate * np.stack([tree.value[k][nodes(tree, k, bins, depth)] for k in range(pred.shape[1])], axis=1)
    return pred


def binned(names: list[str], edges: list[list[float]]) -> Column:
    """The bins of a row's features: how many edges each is above."""
    return F.array(*[sum(((F.col(n) > float(e)).cast("int") for e in own), F.lit(0)).cast("tinyint") for n, own in zip(names, edges)])


def feature_edges(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Edges of each feature at equal shares of ``rows``, all features at once."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])))
    found = {r["i"]: list(r["edges"]) for r in rates.quantiles(long, ["i"], "v", [k / bins for k in range(1, bins)]).collect()}  # a row a feature
    return [found.get(i, []) for i in range(len(names))]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return bins, batch.column(1).to_numpy(zero_copy_only=False).astype(float), batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _read(batches: Iterator[pa.RecordBatch], recent: list[Round], rate: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            bins, y, pred = _arrays(batch.slice(start, ROWS))
            yield bins, y, moved(pred, recent, rate, bins)


def histogram(objective, tree: Round, level: int, bins: np.ndarray, y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """Sums by output, node, feature and bin of the objective's channels, and counts last."""
    d, width = bins.shape[1], 2**level
    channels = [*objective.channels(pred, y), np.ones_like(pred)]
    out = np.zeros((objective.outputs, width, d, BINS, len(channels)))
    cell = np.arange(d) * BINS + bins
    for k in range(objective.outputs):
        flat = (nodes(tree, k, bins, level)[:, None] * (d * BINS) + cell).ravel()
        for c, values in enumerate(channels):
            out[k, ..., c] = np.bincount(flat, np.repeat(values[:, k], d), width * d * BINS).reshape(width, d, BINS)
    return out


def split(objective, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature and last left bin of each output's nodes; -1 where nothing is gained. Of equal gains the first feature and bin."""
    left, total = sums.cumsum(axis=3), sums.sum(axis=3, keepdims=True)
    right = total - left
    n = [s[..., -1] for s in (left, right, total)]
    gain = objective.strength(left, n[0]) + objective.strength(right, n[1]) - objective.strength(total, n[2])
    gain = np.where((n[0] >= objective.least) & (n[1] >= objective.least), np.round(gain, 8), 0.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=2)
    found = flat.max(axis=2) > 0
    return np.where(found, best // BINS, -1), np.where(found, best % BINS, 0)


def leaf_cells(objective: Quantiles, tree: Round, depth: int, low: np.ndarray, high: np.ndarray, bins: np.ndarray, y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    """How many residuals of each output and leaf lie in each cell between ``low`` and ``high``."""
    out = np.zeros((objective.outputs, 2**depth, CELLS))
    for k in range(objective.outputs):
        cell = np.clip(np.floor((y - pred[:, k] - low[k]) / (high[k] - low[k]) * CELLS), 0, CELLS - 1).astype(np.int64)
        out[k] = np.bincount(nodes(tree, k, bins, depth) * CELLS + cell, minlength=2**depth * CELLS).reshape(-1, CELLS)
    return out


def cell_quantiles(shares: tuple[float, ...], counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The shares' quantiles of each leaf, residuals evenly spread in their cell; 0 for an empty leaf."""
    upto = counts.cumsum(axis=2)
    wanted = np.array(shares)[:, None] * upto[..., -1]
    cell = (upto >= wanted[..., None]).argmax(axis=2)
    inside = np.take_along_axis(counts, cell[..., None], 2)[..., 0]
    above = np.take_along_axis(upto, cell[..., None], 2)[..., 0] - inside
    at = cell + np.divide(wanted - above, inside, out=np.zeros_like(wanted), where=inside > 0)
    return np.where(upto[..., -1] > 0, low[:, None] + at * ((high - low) / CELLS)[:, None], 0.0)


def boost(rows: DataFrame, objective: Quantiles | Classes, base: np.ndarray, rounds: int, depth: int, rate: float, label: str = "y") -> Model:
    """Fits ``rounds`` of trees to ``rows(bins, label)``, all outputs of a level in one pass."""
    k, d = objective.outputs, len((rows.select("bins").first() or [[0]])[0])
    start = F.array(*[F.lit(float(b)) for b in base])
    table = staged(rows.select("bins", F.col(label).cast("double").alias("y"), start.alias("pred")), "boosted")
    tasks, done, recent = partitions_of(table), [], []
    span = table.agg(F.min("y").alias("low"), F.max("y").alias("high")).first()
    bounds = np.array([base, base], float)
    for _ in range(rounds):
        tree = Round(np.full((k, 2**depth - 1), -1), np.zeros((k, 2**depth - 1), int), np.zeros((k, 2**depth)))
        for level in range(depth):
            sums = _sums(table, tasks, recent, rate, lambda *row, level=level, tree=tree: histogram(objective, tree, level, *row), (k, 2**level, d, BINS, -1))
            feature, last = split(objective, sums)
            first = 2**level - 1
            tree.feature[:, first : first + 2**level], tree.last[:, first : first + 2**level] = feature, last
        if isinstance(objective, Quantiles):
            low, high = span["low"] - bounds[1], span["high"] - bounds[0]
            high = np.where(high > low, high, low + 1)
            counts = _sums(table, tasks, recent, rate, lambda *row, tree=tree, low=low, high=high: leaf_cells(objective, tree, depth, low, high, *row), (k, 2**depth, CELLS))
            tree.value[:] = cell_quantiles(objective.shares, counts, low, high)
        else:
            tree.value[:] = _newton_leaves(objective, tree, sums)
        bounds = bounds + rate * np.array([tree.value.min(axis=1), tree.value.max(axis=1)])
        done.append(tree)
        recent = [*recent, tree]
        if len(recent) == KEPT:
            table, recent = staged(_written(table, recent, rate), "boosted"), []
    return Model(np.asarray(base, float), done, rate)


def _sums(table: DataFrame, tasks: int, recent: list[Round], rate: float, told, shape: tuple[int, ...]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = None
        for row in _read(batches, recent, rate):
            part = told(*row)
            total = part if total is None else total + part
        return {} if total is None else {0: total}

    return tree_sum(table, run, tasks)[0].reshape(shape)


def _newton_leaves(objective: Classes, tree: Round, sums: np.ndarray) -> np.ndarray:
    """The leaves' values from the sums of the last level: what goes left and right of its splits."""
    k, width = sums.shape[:2]
    first = width - 1
    out = np.zeros((k, 2 * width))
    for o in range(k):
        for node in range(width):
            feature, last = tree.feature[o, first + node], tree.last[o, first + node]
            total = sums[o, node, 0].sum(axis=0)
            left = sums[o, node, feature, : last + 1].sum(axis=0) if feature >= 0 else total
            for side, s in ((0, left), (1, total - left)):
                out[o, 2 * node + side] = s[0] / (s[1] + objective.ridge)
    return out


def _written(table: DataFrame, recent: list[Round], rate: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, pred = _arrays(batch)
            after = moved(pred, recent, rate, bins)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(after) + 1, dtype=np.int32) * after.shape[1]), pa.array(after.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["bins", "y", "pred"])

    return table.mapInArrow(run, "bins array<tinyint>, y double, pred array<double>")


def predicted(rows: DataFrame, model: Model, column: str = "pred") -> DataFrame:
    """``rows(bins, ...)`` with the outputs of the model as an array."""

    @F.pandas_udf("array<double>")
    def apply(bins):
        import pandas as pd

        if not len(bins):
            return pd.Series([], dtype=object)
        matrix = np.stack(bins.to_numpy())
        start = np.tile(model.base, (len(matrix), 1))
        return pd.Series(list(moved(start, model.rounds, model.rate, matrix)))

    return rows.withColumn(column, apply("bins"))


# --- the same rounds in DuckDB SQL, for the oracles ---


def sql_boost(source: str, names: list[str], objective: Quantiles | Classes, base: list[str], rounds: int, depth: int, rate: float, bins: int = BINS) -> str:
    """CTEs of all rounds over ``source(id, fit, y, names ...)``, where ``fit`` tells the rows to learn from; the last, ``boosted``, has ``(id, k, pred)``."""
    quantile = isinstance(objective, Quantiles)
    cuts = ", ".join(f"quantile_cont({n}, {j / bins}) AS e{i}_{j}" for i, n in enumerate(names) for j in range(1, bins))
    bin_of = lambda i, n: " + ".join(f"CAST({n} > e{i}_{j} AS INTEGER)" for j in range(1, bins))
    out = [
        f"edges AS MATERIALIZED (SELECT {cuts} FROM {source} WHERE fit)",
        f"bins AS MATERIALIZED (SELECT id, unnest(range(0, {len(names)})) AS f, unnest([{', '.join(bin_of(i, n) for i, n in enumerate(names))}]) AS bin FROM {source}, edges)",
        f"span AS (SELECT min(y) AS ymin, max(y) AS ymax FROM {source} WHERE fit)",
        f"base AS MATERIALIZED (SELECT unnest(range(0, {objective.outputs})) AS k, unnest(told) AS pred FROM (SELECT [{', '.join(base)}] AS told FROM {source} WHERE fit))",
        f"s0 AS MATERIALIZED (SELECT id, fit, y, k, pred FROM {source}, base)",
        "b0 AS (SELECT k, pred AS least, pred AS most FROM base)",
    ]
    share = "(CASE k " + " ".join(f"WHEN {k} THEN {q}::DOUBLE" for k, q in enumerate(objective.shares)) + " END)" if quantile else ""
    if quantile:
        channels, slope = "CAST(y > pred AS DOUBLE) AS c1, 0.0::DOUBLE AS c2", lambda c, n: f"({share} * {c}1 - (1 - {share}) * ({n} - {c}1))"
        strength = lambda c, n: f"pow({slope(c, n)}, 2) / greatest({n}, 1)"
    else:
        p = "exp(pred - top) / sum(exp(pred - top)) OVER w"
        channels = f"CAST(y = k AS DOUBLE) - {p} AS c1, {p} * (1 - {p}) AS c2"
        strength = lambda c, n: f"pow({c}1, 2) / ({c}2 + {objective.ridge}::DOUBLE)"
    for r in range(1, rounds + 1):
        last = f"s{r - 1}"
        inner = last if quantile else f"(SELECT *, max(pred) OVER (PARTITION BY id) AS top FROM {last})"
        window = "" if quantile else " WINDOW w AS (PARTITION BY id)"
        out.append(f"n{r}_0 AS MATERIALIZED (SELECT id, fit, y, k, pred, 0 AS node, {channels} FROM {inner}{window})")
        for level in range(depth):
            t = f"{r}_{level}"
            out.append(f"h{t} AS (SELECT k, node, f, bin, sum(c1) AS s1, sum(c2) AS s2, count(*) AS n FROM n{t} JOIN bins USING (id) WHERE fit GROUP BY ALL)")
            out.append(f"""q{t} AS (SELECT *, t1 - l1 AS r1, t2 - l2 AS r2, tn - ln AS rn FROM (SELECT k, node, f, bin, sum(s1) OVER v AS l1, sum(s2) OVER v AS l2, sum(n) OVER v AS ln,
                sum(s1) OVER u AS t1, sum(s2) OVER u AS t2, sum(n) OVER u AS tn FROM h{t} WINDOW v AS (PARTITION BY k, node, f ORDER BY bin), u AS (PARTITION BY k, node, f)))""")
            gain = f"round({strength('l', 'ln')} + {strength('r', 'rn')} - {strength('t', 'tn')}, 8)"
            out.append(f"""x{t} AS MATERIALIZED (SELECT k, node, f, bin FROM (SELECT *, row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, bin) AS place FROM
                (SELECT *, {gain} AS gain FROM q{t} WHERE ln >= {objective.least} AND rn >= {objective.least})) WHERE place = 1 AND gain > 0)""")
            out.append(f"""n{r}_{level + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), 2 * n.node + CAST(coalesce(b.bin > x.bin, false) AS INTEGER) AS node
                FROM n{t} n LEFT JOIN x{t} x ON n.k = x.k AND n.node = x.node LEFT JOIN bins b ON b.id = n.id AND b.f = x.f)""")
        leaves = f"n{r}_{depth}"
        if quantile:
            out.append(f"g{r} AS MATERIALIZED (SELECT k, ymin - most AS low, CASE WHEN ymax - least > ymin - most THEN ymax - least ELSE ymin - most + 1 END AS high, least, most FROM b{r - 1}, span)")
            cell = f"CAST(least(greatest(floor((y - pred - low) / (high - low) * {CELLS}), 0), {CELLS - 1}) AS INTEGER)"
            out.append(f"cells{r} AS (SELECT k, node, {cell} AS cell, count(*) AS n, any_value(low) AS low, any_value(high) AS high FROM {leaves} JOIN g{r} USING (k) WHERE fit GROUP BY ALL)")
            out.append(f"""v{r} AS MATERIALIZED (SELECT k, node, arg_min(low + (cell + ({share} * total - (upto - n)) / n) * ((high - low) / {CELLS}), cell) AS value FROM
                (SELECT *, sum(n) OVER (PARTITION BY k, node ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY k, node) AS total FROM cells{r}) WHERE upto >= {share} * total GROUP BY k, node)""")
        else:
            out.append(f"v{r} AS MATERIALIZED (SELECT k, node, sum(c1) / (sum(c2) + {objective.ridge}::DOUBLE) AS value FROM {leaves} WHERE fit GROUP BY ALL)")
        out.append(f"s{r} AS MATERIALIZED (SELECT id, fit, y, k, pred + {rate}::DOUBLE * coalesce(value, 0) AS pred FROM {leaves} LEFT JOIN v{r} USING (k, node))")
        # Leaves without rows are zero, and a tree has 2 ** depth of them.
        out.append(f"b{r} AS MATERIALIZED (SELECT k, any_value(least) + {rate}::DOUBLE * least(min(value), CASE WHEN count(*) < {2**depth} THEN 0 ELSE min(value) END) AS least, any_value(most) + {rate}::DOUBLE * greatest(max(value), CASE WHEN count(*) < {2**depth} THEN 0 ELSE max(value) END) AS most FROM v{r} JOIN b{r - 1} USING (k) GROUP BY k)")
    return ", ".join(out) + f", boosted AS (SELECT id, fit, y, k, pred FROM s{rounds})"
