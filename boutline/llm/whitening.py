"""Whitening of embeddings by a singular value decomposition without a covariance matrix.

Entries become whole numbers first, so counts, sums and deviations are exact. The distinct vectors, centred, are
compressed block by block to triangular factors (TSQR), which meet in a tree; one-sided Jacobi rotations make the columns
of the last factor orthogonal. The accumulated rotations are the components, the lengths of the columns the standard deviations
times the root of the number of rows. What a task or the driver holds is bounded by the dimension, never by the rows.

Edge cases: rows whose vector is null or empty, or has an entry that is null, NaN or infinite, are dropped; so are vectors of another
length than most have (of equal numbers the greater length). Repeated rows are fitted once and returned each; a row without ``vec_id``
keeps its null. Directions without variance have no component, so one distinct vector, or an empty table, gives no rows. A
deviation beyond a long is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutline.llm.common import discard, slices, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Factors that meet in one task of the tree.
FAN = 8
#: Rows that are turned into an array of doubles at a time.
ROWS = 2048


class Whitening(NamedTuple):
    """``center`` is ``sums / n``; ``components`` has a unit column for each, ``variances`` falls, ``trace`` is of the whole covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def whole_numbers(vectors: DataFrame, entries: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: the usable vectors, of the length that most have, as whole numbers."""
    c = F.col(entries).cast("array<double>")
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(c, lambda v: F.floor(v * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    rows = vectors.where(F.col(entries).isNotNull() & (F.size(entries) > 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d"))["d"].alias("d")).first()["d"]
    return rows.where(F.size("x") == F.lit(most or 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums``, exact."""
    return n * x - sums


def _sums(fit: DataFrame, dimension: int) -> tuple[int, np.ndarray]:
    """Rows and sums of each dimension, exact: each task gives one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for batch in batches:
            x = _matrix(batch.column(0), dimension)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0, dtype=np.int64))]
        if n:
            columns = [pa.array(range(dimension), pa.int32()), pa.array([n] * dimension, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s"])

    rows = fit.mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not rows:
        return 0, np.zeros(dimension, np.int64)
    return rows[0]["n"], np.array([int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])], np.int64)


def _triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def _factor(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The triangular factor of the centred rows: one of each task, then of ``FAN`` factors at a time."""
    dimension = len(sums)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dimension))
        for batch in slices(batches, ROWS):
            r = _triangle([r, _deviations(_matrix(batch.column(0), dimension), n, sums) / n])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["block", "r"])

    def merge(rows: pa.Table) -> pa.Table:
        ordered = sorted(zip(rows.column("block").to_pylist(), rows.column("r").to_pylist()))
        r = _triangle([np.frombuffer(r).reshape(-1, dimension) for _, r in ordered])
        return pa.table({"block": pa.array([ordered[0][0] // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    factors = stored(fit.mapInArrow(compress, "block long, r binary"), "factors")
    while factors.count() > 1:
        merged = stored(factors.groupBy(F.floor(F.col("block") / FAN)).applyInArrow(merge, "block long, r binary"), "factors")
        discard(factors)
        factors = merged
    out = np.frombuffer(factors.first()["r"]).reshape(-1, dimension)
    discard(factors)
    return out


def _rounds(dimension: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of disjoint ones."""
    ring = list(range(dimension + dimension % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]) if max(a, b) < dimension]
        out.append((np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as columns, by one-sided rotations."""
    a, v = np.array(r, float), np.eye(r.shape[1])
    rounds = _rounds(r.shape[1])
    for _ in range(sweeps):
        worst = 0.0
        for p, q in rounds:
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx) * np.sqrt(yy)
            away = np.divide(np.abs(xy), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, away.max(initial=0.0))
            turn = away > tolerance
            with np.errstate(over="ignore"):
                zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
                t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            for m in (a, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = cos * x - sin * y, sin * x + cos * y
        if worst <= tolerance:
            break
    sizes = np.sqrt((a * a).sum(0))
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order]


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of the distinct vectors of ``rows(x)``, and the table of these."""
    fit = stored(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    first = fit.first()
    dimension = len(first["x"]) if first else 0
    n, sums = _sums(fit, dimension)
    if n == 0:
        return Whitening(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0), fit
    sizes, vectors = jacobi(_factor(fit, n, sums))
    variances = sizes * sizes / n
    kept = int((sizes[:components] > sizes[0] * dimension * np.finfo(float).eps).sum()) if sizes[0] > 0 else 0
    return Whitening(n, sums, vectors[:, :kept], variances[:kept], float(variances.sum())), fit


def _whiten(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    scaled = model.components / np.sqrt(model.variances)
    return lambda x: (_deviations(x, model.n, model.sums) / model.n) @ scaled


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry, in size, of the covariance of the whitened fit list minus the identity.

    The rows are centred before they are projected, so the products are of centred values.
    """
    k, dimension, whiten = len(model.variances), len(model.sums), _whiten(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in slices(batches, ROWS):
            w = whiten(_matrix(batch.column(0), dimension))
            total += w.T @ w
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    sums = fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    off = F.abs(F.col("s") / F.lit(float(model.n)) - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return sums.agg(F.max(off).alias("e")).first()["e"]


def _squares(d: np.ndarray) -> pa.Array:
    """The sums of squares of the rows of ``d``, exact; null beyond a long."""
    if float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0**62:
        return pa.array((d * d).sum(axis=1))
    exact = [sum(v * v for v in row) for row in d.tolist()]
    return pa.array([s if s < 1 << 63 else None for s in exact], pa.int64())


def whiten(vectors: DataFrame, entries: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row of each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    rows = whole_numbers(vectors, entries)
    model, fit = fit_whitening(rows, components)
    k, dimension = len(model.variances), len(model.sums)
    error = identity_error(fit, model) if k else 0.0
    discard(fit)
    schema = "vec_id long, deviation long, component int, whitened double, explained double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = _whiten(model)
        for batch in slices(batches, ROWS):
            x = _matrix(batch.column(1), dimension)
            row, component = np.divmod(np.arange(len(x) * k), k)
            columns = [
                batch.column(0).take(pa.array(row)), _squares(_deviations(x, model.n, model.sums)).take(pa.array(row)), pa.array((component + 1).astype(np.int32)),
                pa.array(project(x).ravel()), pa.array((model.variances / model.trace)[component]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "deviation", "component", "whitened", "explained"])

    out = rows.mapInArrow(run, schema) if k else rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("deviation", "long"), ("component", "int"), ("whitened", "double"), ("explained", "double"))]).limit(0)
    fixed: list[Column] = [F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error")]
    return out.select("vec_id", "component", *fixed)
