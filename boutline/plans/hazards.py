"""Competing risks by the minute: a multinomial fit over the minutes of bouts, and what rolls up from it.

Minutes are gone through where a bout lies, many bouts at a time, so there is never a row for each minute: what is written and read is a
row a bout, and what comes to the driver are the sums of a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutline.plans.newton import partitions_of, tree_sum

#: Bouts that are multiplied at a time.
ROWS = 4096
#: Each class as the other side sees it, and the sign that each feature then has.
OTHER, TURN = np.array([0, 2, 1, 4, 3]), np.array([1.0, 1.0, -1.0, 1.0])
CLASSES, WIDTH = len(OTHER), len(TURN)
ENDS = ("a_ko", "b_ko", "a_sub", "b_sub")


class Fit(NamedTuple):
    """A row of coefficients for each class, of one, minute, gap and level less ``mean`` and over ``scale``."""

    beta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _probabilities(fit: Fit, minute: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and probabilities of a minute of bouts whose gap and level are ``known``."""
    x = np.empty((len(known), WIDTH))
    x[:, 0], x[:, 1], x[:, 2:] = 1.0, minute, known
    x = (x - fit.mean) / fit.scale
    z = x @ fit.beta.T
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return x, e / e.sum(axis=1, keepdims=True)


def _parts(batch: pa.RecordBatch, names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns named of some bouts at a time, those of most minutes (the first column named) first, and gap and level last."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        columns = [part.column(n).to_numpy(zero_copy_only=False) for n in names]
        order = np.argsort(-columns[0].astype(np.int64), kind="stable")
        yield [*[c[order] for c in columns], np.stack([part.column(n).to_numpy(zero_copy_only=False).astype(float)[order] for n in ("gap", "level")], axis=1)]


def _sums(fit: Fit, batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """Gradient, curvature and loss of bouts as their first sides see them."""
    k, i = np.triu_indices(CLASSES), np.triu_indices(WIDTH)
    slope, own, both, loss = np.zeros((CLASSES, WIDTH)), np.zeros((CLASSES, len(i[0]))), np.zeros((len(k[0]), len(i[0]))), 0.0
    for batch in batches:
        for last, ends, known in _parts(batch, ["last", "ends"]):
            for minute in range(1, int(last[0]) + 1):
                n = int(np.count_nonzero(last >= minute))
                x, p = _probabilities(fit, minute, known[:n])
                true = np.where(last[:n] == minute, ends[:n], 0)
                xx = x[:, i[0]] * x[:, i[1]]
                own += p.T @ xx
                both += (p[:, k[0]] * p[:, k[1]]).T @ xx
                loss -= np.log(np.maximum(p[np.arange(n), true], 1e-300)).sum()
                p[np.arange(n), true] -= 1
                slope += p.T @ x
    curve = -_filled(_filled(both, i, WIDTH).transpose(1, 2, 0), k, CLASSES).transpose(2, 0, 3, 1)
    curve[np.arange(CLASSES), :, np.arange(CLASSES)] += _filled(own, i, WIDTH)
    return {0: np.concatenate([slope.ravel(), curve.ravel(), [loss]])}


def _filled(cells: np.ndarray, at: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """Symmetric matrices of the last axis's upper triangles."""
    out = np.zeros((*cells.shape[:-1], width, width))
    out[..., at[0], at[1]] = cells
    out[..., at[1], at[0]] = cells
    return out


def fitted(rows: DataFrame, penalty: float = 1e-4, steps: int = 40) -> Fit:
    """The fit over each minute of ``rows(last, ends, gap, level)`` in both orientations, by Newton steps.

    ``penalty`` is on the squares of coefficients of features over their deviation, against the mean loss. The other side of a bout
    sees classes and gap turned, and so do the coefficients, so sums over the first sides tell those over the others.
    """
    m = F.col("last").cast("double")
    sums = [F.sum(c) for c in (m, m * (m + 1) / 2, m * (m + 1) * (2 * m + 1) / 6, m * F.col("level"), m * F.col("level") * F.col("level"), m * F.col("gap") * F.col("gap"))]
    n, minute, minutes, level, levels, gaps = (float(v or 0.0) for v in rows.agg(*sums).first())
    mean = np.array([0.0, minute, 0.0, level]) / max(n, 1)
    spread = (np.array([0.0, minutes, gaps, levels]) / max(n, 1) - mean**2) * (2 * n) / max(2 * n - 1, 1)
    scale = np.where(spread > 1e-15, np.sqrt(np.maximum(spread, 0)), 1.0)
    beta, ridge = np.zeros((CLASSES, WIDTH)), np.tile([0.0, *[penalty * 2 * n] * (WIDTH - 1)], CLASSES)
    if not n:
        return Fit(beta, mean, scale)
    needed = rows.select("last", "ends", "gap", "level")
    tasks, best = partitions_of(needed), None
    turn = lambda v: (v.reshape(CLASSES, WIDTH, -1)[OTHER] * TURN[:, None]).reshape(v.shape)
    for _ in range(steps):
        total = tree_sum(needed, lambda batches, fit=Fit(beta, mean, scale): _sums(fit, batches), tasks)[0]
        size = CLASSES * WIDTH
        slope, curve, loss = total[:size], total[size:-1].reshape(size, size), 2 * total[-1] + (ridge * beta.ravel() ** 2).sum() / 2
        if best is not None and loss > best[1] * (1 + 1e-12):
            beta = (beta + best[0]) / 2
            continue
        slope = slope + turn(slope) + ridge * beta.ravel()
        curve = curve + turn(turn(curve).T).T + np.diag(ridge)
        best, step = (beta, loss), np.linalg.pinv(curve, rcond=1e-13, hermitian=True) @ slope
        beta = beta - step.reshape(beta.shape)
        if slope @ step <= 1e-14 * n:
            break
    return Fit(beta, mean, scale)


def rolled(rows: DataFrame, fit: Fit) -> DataFrame:
    """Of ``rows(bout_id, minutes, gap, level)`` the probability of each way to end within the minutes scheduled, of none, the expected minutes, and the sum of all ways."""
    names = [*ENDS, "dec", "exp_minutes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for minutes, bout, known in _parts(batch, ["minutes", "bout_id"]):
                ways, alive, lasted = np.zeros((len(bout), CLASSES - 1)), np.ones(len(bout)), np.zeros(len(bout))
                for minute in range(1, int(minutes[0]) + 1):
                    n = int(np.count_nonzero(minutes >= minute))
                    p = _probabilities(fit, minute, known[:n])[1]
                    lasted[:n] += alive[:n]
                    ways[:n] += alive[:n, None] * p[:, 1:]
                    alive[:n] *= p[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(bout), *[pa.array(c) for c in (*ways.T, alive, lasted)]], names=["bout_id", *names])

    out = rows.select("bout_id", "minutes", "gap", "level").mapInArrow(run, "bout_id long, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("total", sum((F.col(n) for n in (*ENDS[1:], "dec")), F.col(ENDS[0])))
