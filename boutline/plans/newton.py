"""Many logistic fits over the same rows at once, by Newton steps of any width.

A step is one pass: a task sums gradients and curvatures of all fits over its Arrow batches as products of matrices, and the sums
of the tasks meet in a tree. What comes to the driver are a few numbers for each fit and pair of features, never rows. Fits differ
by weights (folds, draws, parts of the rows), by offsets, and by which features they may use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sums that meet in one task of the tree, fits whose sums are one row, and rows that are multiplied at a time.
FAN, BLOCK, ROWS = 8, 128, 2048
Columns = dict[str, np.ndarray]


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)


def partitions_of(rows: DataFrame) -> int:
    last = rows.select(F.spark_partition_id().alias("n")).agg(F.max("n").alias("n")).first()["n"]
    return (last or 0) + 1


def tree_sum(rows: DataFrame, told: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], tasks: int) -> dict[int, np.ndarray]:
    """The sums over all ``tasks`` partitions of what ``told`` makes of each: arrays by block."""
    schema = "task long, block int, total binary"
    fields = ["task", "block", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in told(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([block], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=fields)

    def add(group: pa.Table) -> pa.Table:
        ordered = sorted(zip(group.column("task").to_pylist(), group.column("total").to_pylist()))
        total = sum(np.frombuffer(t) for _, t in ordered)
        return pa.table({"task": pa.array([ordered[0][0] // FAN]), "block": group.column("block")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(run, schema)
    while tasks > 1:
        sums, tasks = sums.groupBy(F.floor(F.col("task") / FAN), "block").applyInArrow(add, schema), -(-tasks // FAN)
    return {r["block"]: np.frombuffer(r["total"]) for r in sums.collect()}


def newton_fits(
    rows: DataFrame, names: list[str], fits: int = 1, y: str = "y", uses: list[str] = (), weights: Callable[[Columns], np.ndarray] | None = None,
    offsets: Callable[[Columns], np.ndarray] | None = None, allowed: np.ndarray | None = None, ridge: float | np.ndarray = 0.0, start: np.ndarray | None = None, steps: int = 8,
) -> np.ndarray:
    """The coefficients, a row for each fit.

    ``weights`` and ``offsets`` give a column for each fit from the columns ``uses``; ``allowed`` tells which features a fit may use (all
    others stay at zero), ``ridge`` is the penalty on the summed loss, a number for each fit or one; all fits begin at ``start``, or at zero.
    """
    width, upper = len(names), np.triu_indices(len(names))
    allowed = np.ones((fits, width), bool) if allowed is None else allowed
    penalty = np.broadcast_to(np.asarray(ridge, float).reshape(-1, 1), (fits, width))
    beta = np.where(allowed, 0.0 if start is None else start, 0.0)
    needed = rows.select(*dict.fromkeys([*names, y, *uses]))
    tasks = partitions_of(needed)
    for _ in range(steps):
        sums = tree_sum(needed, _step(beta, names, y, list(uses), weights, offsets), tasks)
        total = np.concatenate([sums[b].reshape(-1, width + len(upper[0])) for b in sorted(sums)]) if sums else np.zeros((fits, width + len(upper[0])))
        slope, curve = total[:, :width] - penalty * beta, np.zeros((fits, width, width))
        curve[:, upper[0], upper[1]] = total[:, width:]
        curve[:, upper[1], upper[0]] = total[:, width:]
        curve += (penalty + 1e-12)[:, :, None] * np.eye(width)
        both = allowed[:, :, None] & allowed[:, None, :]
        curve = np.where(both, curve, np.eye(width))
        beta = beta + np.linalg.solve(curve, np.where(allowed, slope, 0.0)[:, :, None])[:, :, 0]
    return beta


def _step(beta: np.ndarray, names: list[str], y: str, uses: list[str], weights, offsets) -> Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]:
    def told(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        first, second = np.triu_indices(len(names))
        total = np.zeros((len(beta), len(names) + len(first)))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x, target = _matrix(part, names), part.column(y).to_numpy(zero_copy_only=False).astype(float)
                columns = {c: part.column(c).to_numpy(zero_copy_only=False) for c in uses}
                z = x @ beta.T
                if offsets:
                    z = z + offsets(columns)
                p = 1 / (1 + np.exp(-z))
                w = weights(columns) if weights else np.ones_like(p)
                total[:, : len(names)] += (w * (target[:, None] - p)).T @ x
                total[:, len(names) :] += (w * p * (1 - p)).T @ (x[:, first] * x[:, second])
        return {b: total[b * BLOCK : (b + 1) * BLOCK] for b in range(-(-len(beta) // BLOCK))}

    return told


# --- the same steps in DuckDB SQL, for the oracles ---


def sql_newton(name: str, source: str, width: int, ridge: str, steps: int, allowed: dict[int, int] | None = None, start: str = "") -> str:
    """CTEs of Newton steps over ``source(k, x1 .. , y, o, w)``, a fit for each ``k``; the last, ``name``, has ``(k, beta)``.

    Each step solves its equations by eliminating one feature after another. ``ridge`` may depend on ``k``; ``allowed`` tells how many of the
    first features a fit may use, and ``start`` names a row with the ``beta`` to begin at.
    """
    n = range(1, width + 1)
    may = f"list_transform(range(1, {width + 1}), lambda i: " + ("1.0::DOUBLE" if allowed is None else "CAST(i <= CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in allowed.items()) + " END AS DOUBLE)") + ")"
    dot = " + ".join(f"beta[{i}] * x{i}" for i in n)
    cells = ", ".join(f"sum(v * x{i} * x{j}) AS h{i}_{j}" for i in n for j in range(i, width + 1))
    slopes = ", ".join(f"sum(u * x{i}) AS g{i}" for i in n)
    plain = "[" + ", ".join("[" + ", ".join(f"h{min(i, j)}_{max(i, j)}" for j in n) + "]" for i in n) + "]"
    first = f"(SELECT any_value(beta) FROM {start})" if start else f"[{', '.join(['0.0::DOUBLE'] * width)}]"
    out = [f"{name}_0 AS (SELECT k, {first} AS beta, {may} AS a FROM (SELECT DISTINCT k FROM {source}))"]
    for s in range(1, steps + 1):
        last = f"{name}_{s - 1}"
        out.append(f"{name}_{s}s AS MATERIALIZED (SELECT k, beta, a, [{', '.join(f'g{i}' for i in n)}] AS g, {plain} AS h FROM (SELECT k, any_value(beta) AS beta, any_value(a) AS a, {slopes}, {cells} FROM (SELECT *, w * (y - p) AS u, w * p * (1 - p) AS v FROM (SELECT s.*, beta, a, 1 / (1 + exp(-(o + {dot}))) AS p FROM {source} s JOIN {last} USING (k))) GROUP BY k))")
        table = f"list_transform(h, lambda r, i: list_append(list_transform(r, lambda v, j: a[i] * a[j] * v + CASE WHEN i = j THEN a[i] * ({ridge} + 1e-12) + 1 - a[i] ELSE 0 END), a[i] * (g[i] - {ridge} * beta[i])))"
        out.append(f"""{name}_{s}e AS (SELECT k, 0 AS pos, {table} AS m FROM {name}_{s}s UNION ALL
            SELECT k, pos + 1, list_transform(m, lambda r, i: CASE WHEN i = pos + 1 THEN list_transform(r, lambda v: v / r[pos + 1]) ELSE list_transform(r, lambda v, j: v - r[pos + 1] / m[pos + 1][pos + 1] * m[pos + 1][j]) END)
            FROM {name}_{s}e WHERE pos < {width})""")
        final = name if s == steps else f"{name}_{s}"
        out.append(f"{final} AS MATERIALIZED (SELECT k, list_transform(beta, lambda b, i: b + m[i][{width + 1}]) AS beta, a FROM {name}_{s}s JOIN {name}_{s}e USING (k) WHERE pos = {width})")
    return ", ".join(out)
