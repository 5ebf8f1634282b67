"""Embedding whitening: blockwise QR of the centred rows, bidiagonalisation, dqds, twisted factorisations.

Rows are scaled to integers x = floor(64 c) + 1000000.  Sums are exact integers, so a centred entry is
one rounded quotient, (n x - S) / n.  Every task reduces its rows to one upper triangle R by QR of
blocks; triangles are stacked by ``FAN`` and reduced again until one is left (R'R is n times the
covariance, which is never formed).  On that small matrix, whose size is the dimension alone,
Householder reflections give a bidiagonal matrix, dqds its singular values to high relative accuracy,
and twisted factorisations of the shifted tridiagonal their vectors; values too close to tell their
vectors apart share a space that inverse iteration and orthogonalisation fill.  Projection, whitening
and the covariance of the result are distributed again.

Rows take part if their vector is not null and all its entries are finite and have an x that fits a
long.  Vectors of another length than the most frequent take no part, since there is no covariance
with them; repeated rows count as often as they occur, a null vec_id stays null.  Directions without
spread (an eigenvalue of no more than ``NO_SPREAD`` of the trace) are no components: they cannot be
scaled to one.  An empty table, or one vector repeated, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SCALE, SHIFT = 64, 1_000_000
#: Rows of a QR block, and triangles that one reduction stacks.
BLOCK, FAN = 4_096, 16
#: Share of the trace from which on an eigenvalue is one of a component.
NO_SPREAD = 1e-24
#: Values closer than this, relative to the larger, share a space.
CLUSTER = 1e-3
#: Entries whose scaled value would not fit a long.
_MOST = 2.0**56


# --- the small matrix ---------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): U'RV is upper bidiagonal, by Householder reflections from both sides."""
    a = np.array(r, np.float64)
    n = a.shape[1]
    v = np.eye(n)
    for k in range(n):
        for side in ("left", "right"):
            x = a[k:, k] if side == "left" else a[k, k + 1 :]
            if len(x) < 2 or not np.any(x[1:]):
                continue
            w = x / np.abs(x).max()
            w[0] += np.copysign(np.linalg.norm(w), w[0])
            w /= np.linalg.norm(w)
            if side == "left":
                a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
            else:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One differential qd step: (q, e, d) of the shifted array; None if the shift was too large."""
    n = len(q)
    to_q, to_e, ds = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        ds[i] = d
        to_q[i] = d + e[i]
        ratio = q[i + 1] / to_q[i] if to_q[i] else 0.0
        to_e[i] = e[i] * ratio
        d = d * ratio - shift if to_q[i] else q[i + 1] - shift
    if d < 0:
        return None
    to_q[-1] = ds[-1] = d
    return to_q, to_e, ds


def singular_values_squared(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The eigenvalues of B'B of a bidiagonal B, falling, by dqds with shifts from below.

    After a step without shift, 1/d are the diagonal of the inverse: the inverse of their sum is a lower
    bound of the smallest eigenvalue and so a shift that cannot overshoot; it closes in quadratically.
    """
    found: list[float] = []
    blocks = [(np.square(diagonal), np.square(above), 0.0)]
    tiny = np.finfo(float).eps ** 2
    while blocks:
        q, e, total = blocks.pop()
        while True:
            if len(q) == 1:
                found.append(total + q[0])
                break
            small = np.flatnonzero(e <= tiny * (total + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = small[-1] + 1
                blocks.append((q[:cut], e[: cut - 1], total))
                q, e = q[cut:], e[cut:]
                continue
            step = _dqds(q, e, 0.0)
            q, e, d = step
            if q[-1] <= tiny * total or d.min() <= 0.0:  # the smallest has been shifted to nothing
                if q[-1] <= tiny * total or q[-1] == 0.0:
                    found.append(total)
                    q, e = q[:-1], e[:-1]
                continue
            bound = 1.0 / np.sum(1.0 / d)
            guess = d[-1] * (1.0 - e[-1] / (e[-1] + q[-2])) if e[-1] < 1e-3 * q[-2] else 0.0
            for shift in (guess if guess > bound else bound, bound * (1 - 1e-12)):
                step = _dqds(q, e, shift)
                if step is not None:
                    q, e, _ = step
                    total += shift
                    break
    return np.sort(np.array(found))[::-1]


def _twisted(q: np.ndarray, e: np.ndarray, cross: np.ndarray, value: float, right: np.ndarray | None = None) -> np.ndarray:
    """A vector of B'B - value, from its twisted factorisation where the middle pivot is least.

    ``q`` and ``e`` are the squares of B's diagonal and superdiagonal, ``cross`` their products.  The
    pivots come by differential qd steps from above (stationary) and below (progressive).  With
    ``right`` the factorisation solves (B'B - value) z = right instead, for inverse iteration.
    """
    n = len(q)
    least = np.finfo(float).tiny / np.finfo(float).eps if right is None else np.finfo(float).eps ** 2 * (q.max() + e.max(initial=0.0))
    whole = lambda x: x if abs(x) > least else np.copysign(least, x)
    s, p, down, up = np.empty(n), np.empty(n), np.empty(n), np.empty(n)
    s[0], p[-1] = -value, q[-1] - value
    with np.errstate(over="ignore"):  # a pivot of nothing is followed by one without bound
        for i in range(n - 1):
            down[i] = whole(q[i] + s[i])
            s[i + 1] = s[i] * (e[i] / down[i]) - value
            j = n - 1 - i
            up[j] = whole(e[j - 1] + p[j])
            p[j - 1] = (p[j] / up[j] if e[j - 1] else 1.0) * q[j - 1] - value
    middle = s + p + value
    k = int(np.argmin(np.where(np.isfinite(middle), np.abs(middle), np.inf)))
    z, b = np.zeros(n), np.zeros(n) if right is None else right.copy()
    for i in range(1, k + 1):
        b[i] -= cross[i - 1] / down[i - 1] * b[i - 1]
    for i in range(n - 2, k - 1, -1):
        b[i] -= cross[i] / up[i + 1] * b[i + 1]
    z[k] = 1.0 if right is None else b[k] / whole(middle[k])
    for i in range(k - 1, -1, -1):
        z[i] = (b[i] - cross[i] * z[i + 1]) / down[i]
    for i in range(k + 1, n):
        z[i] = (b[i] - cross[i - 1] * z[i - 1]) / up[i]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors (columns) of B'B for ``values``, falling."""
    n = len(diagonal)
    q, e, cross = np.square(diagonal), np.square(above), diagonal[:-1] * above
    alpha = q + np.r_[0.0, e]
    rng = np.random.default_rng(0)
    out = np.zeros((n, len(values)))
    first = 0  # of the values that are too close to each other
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * values[j - 1]:
            first = j
        near = out[:, first:j]
        z = _twisted(q, e, cross, value)
        if near.shape[1]:
            for attempt in range(6):
                z -= near @ (near.T @ z)
                z -= near @ (near.T @ z)
                size = np.linalg.norm(z)
                if size < 1e-8:
                    z = rng.standard_normal(n)
                    continue
                z /= size
                residual = np.linalg.norm(alpha * z + np.r_[cross * z[1:], 0.0] + np.r_[0.0, cross * z[:-1]] - value * z)
                if residual <= 1e-14 * values[0] and attempt:
                    break
                z = _twisted(q, e, cross, value, z)
        z -= out[:, :j] @ (out[:, :j].T @ z)
        out[:, j] = z / np.linalg.norm(z)
    return out


@dataclass
class Whitening:
    """``directions`` (dimension, components) by falling eigenvalue, of n rows with the sums ``sums``."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S as exact integers, x - S/n as the nearest doubles)."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        steps = x - whole
        most = int(np.abs(steps).max(initial=0)) + 1
        exact = steps * self.n - rest if most * self.n < 2**62 else steps.astype(object) * self.n - rest.astype(object)
        return exact, (exact / self.n).astype(np.float64)


def solve(r: np.ndarray, n: int, sums: list[int], most: int) -> Whitening:
    """Components of the covariance R'R / n."""
    trace = float(np.sum(np.square(r))) / n
    if not trace:
        return Whitening(n, sums, np.zeros(0), np.zeros((r.shape[1], 0)), 0.0)
    diagonal, above, v = bidiagonal(r)
    values = singular_values_squared(diagonal, above) / n
    values = values[: min(most, int(np.sum(values > NO_SPREAD * trace)))]
    directions = v @ right_vectors(diagonal, above, values * n)
    return Whitening(n, sums, values, directions, trace)


# --- the rows -----------------------------------------------------------------------------------------------------


def scaled(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``vectors`` that take part, with ``x``: their entries as longs."""
    c = F.col(embedding).cast("array<double>")
    usable = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < _MOST)
    rows = vectors.where(F.col(embedding).isNotNull() & F.forall(c, usable) & (F.size(c) > 0))
    return rows.withColumn("x", F.transform(c, lambda v: F.floor(v * SCALE) + SHIFT))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, position, sum, n) of a task's vectors; sums as decimal strings."""
    totals: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        column = batch.column(0)
        widths = np.array(column.value_lengths())
        for width in np.unique(widths):
            x = _matrix(column.filter(pa.array(widths == width)), int(width))
            safe = int(np.abs(x).max(initial=0)) * len(x) < 2**62
            added = (x if safe else x.astype(object)).sum(axis=0).tolist()
            n, before = totals.get(int(width), (0, [0] * int(width)))
            totals[int(width)] = n + len(x), [a + b for a, b in zip(before, added, strict=True)]
    for width, (n, sums) in totals.items():
        yield pa.RecordBatch.from_pydict({"width": pa.array([width] * width, pa.int32()), "position": pa.array(range(width), pa.int32()), "s": [str(s) for s in sums], "n": pa.array([n] * width, pa.int64())})


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def fit(rows: DataFrame, most: int = 32) -> Whitening | None:
    """Components of the rows ``x`` (arrays of longs); None without rows.

    What comes to the driver is one row for each dimension, then one triangle.
    """
    parts = rows.select("x").mapInArrow(_sums, "width int, position int, s string, n long")
    totals = checkpointed(parts.groupBy("width", "position").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")))
    best = totals.where("position = 0").orderBy(F.desc("n"), "width").first()
    if best is None:
        return None
    width, n = best.width, best.n
    sums = [int(r.s) for r in totals.where(F.col("width") == width).orderBy("position").collect()]
    frame = rows.sparkSession.sparkContext.broadcast(Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0))

    def triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, y = frame.value.centred(_matrix(batch.column(0).slice(at, BLOCK), width))
                r = _triangle(y if r is None else np.vstack([r, y]))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    def stacked(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist(), strict=True))
        r = _triangle(np.vstack([np.array(x).reshape(-1, width) for _, x in rows]))
        return pa.table({"part": pa.array([rows[0][0] // FAN], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    schema = "part long, r array<double>"
    left = checkpointed(rows.where(F.size("x") == width).select("x").mapInArrow(triangles, schema))
    last = left.agg(F.max("part")).first()[0]
    while last > 0:  # a tree over the tasks: each round leaves a FANth of the triangles
        left = checkpointed(left.groupBy((F.col("part") / FAN).cast("long").alias("g")).applyInArrow(stacked, schema))
        last //= FAN
    return solve(np.array(left.first().r).reshape(-1, width), n, sums, most)


def _whitened(model: Whitening, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    exact, y = model.centred(_matrix(column, len(model.sums)))
    small = exact.dtype != object and int(np.abs(exact).max(initial=0)) ** 2 * exact.shape[1] < 2**62
    exact = exact if small else exact.astype(object)
    return (exact * exact).sum(axis=1), y @ model.directions / np.sqrt(model.values)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity, from all rows."""
    k = len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                _, w = _whitened(shared.value, batch.column(0).slice(at, BLOCK))
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})

    summed = rows.where(F.size("x") == len(model.sums)).select("x").mapInArrow(products, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1) * k)
    for i, v in summed.collect():  # k * (k + 1) rows
        total[i] = v
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whitened(vectors: DataFrame, most: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    ``deviation`` is decimal(38,0), the exact sum of (n x - S)^2.
    """
    rows = checkpointed(scaled(vectors, embedding).select(F.col(vec_id).alias("vec_id"), "x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, most)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)
    k = len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                deviation, w = _whitened(shared.value, part.column(1))
                each = np.repeat(np.arange(len(w)), k)
                text = pa.array([str(d) for d in deviation.tolist()], pa.string()).take(pa.array(each))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))), text, pa.array(w.ravel())], ["vec_id", "component", "deviation", "whitened"])

    out = rows.where(F.size("x") == len(model.sums)).mapInArrow(run, f"vec_id {kind}, component int, deviation string, whitened double")
    explained = F.element_at(F.array(*(F.lit(float(v / model.trace)) for v in model.values)), F.col("component"))
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def query(vectors: DataFrame) -> DataFrame:
    """As the digest asks for it: ``deviation`` as long, null where the exact sum is larger than any long."""
    return whitened(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))
