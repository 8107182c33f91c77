"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations.

Entries become integers, x = floor(64 c) + 1,000,000, and every different x counts once: its number n and the sums S
are exact. Rows (n x - S) / n are centred without a rounded mean. Each task reduces its rows to a triangle R by QR,
batch after batch; triangles are merged by further QRs in a tree, so one d by d matrix is all that the driver sees,
whatever the number of rows. R is never squared: Householder reflections from both sides make it bidiagonal, the
differential qd algorithm with shifts (dqds) finds the squared singular values, each to high relative accuracy, and a
twisted factorisation at each of them gives its vector without an iteration. The reflections carry the vectors back.

Defined results: rows whose vector is null or empty, or holds a null or non-finite entry, or an entry whose integer
does not fit a long, are left out, and so are vectors of another length than the commonest one (the longer of equally
common ones), which share no space with it. Repeated rows are all returned. A null id stays null. A direction without
variance to working precision can't be whitened: ``whitened`` is null there and ``explained`` 0. ``deviation`` is null
where it does not fit a long; ``explained`` and ``identity_error`` are null without any variance. An empty table gives
no rows. Other columns are ignored. Fewer dimensions than components: as many components as dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow, dropped, written
from .vectors import lists, longs, matrices

EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)
HUGE = 1e100
SCALE, OFFSET = 64.0, 1_000_000
FAN = 32


# -- the d by d part, on small matrices -------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta and alpha such that (I - beta v v') x = alpha e1."""
    norm = float(np.linalg.norm(x))
    if norm == 0 or np.linalg.norm(x[1:]) == 0:
        return np.zeros_like(x), 0.0, float(x[0])
    alpha = -np.copysign(norm, x[0])
    v = x.copy()
    v[0] -= alpha
    return v, 2.0 / float(v @ v), float(alpha)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal and superdiagonal of Q' r P, and the reflections that make up P."""
    a, d = r.copy(), r.shape[0]
    diagonal, above, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, beta, diagonal[k] = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k + 1 < d:
            v, beta, above[k] = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            right.append((v, beta))
    return diagonal, above, right


def reflected(z: np.ndarray, right: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """P z."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        v, beta = right[k]
        z[k + 1 :] -= beta * (v @ z[k + 1 :]) * v
    return z


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform: new q and e, and the d of every step. None if the shift was above the smallest value."""
    d = q[0] - shift
    new_q, new_e, ds = [], [], [d]
    for i in range(len(e)):
        if d < 0:
            return None
        s = d + e[i]
        s = s if s > TINY else TINY
        t = q[i + 1] / s
        new_q.append(s)
        new_e.append(e[i] * t)
        d = d * t - shift
        ds.append(d)
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, ds


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of the tridiagonal with the qd array (q, e): squared singular values of the bidiagonal (sqrt q, sqrt e).

    A sweep without shift yields d, and 1 / sum(1 / d) never exceeds the smallest value: that is the next shift.
    """
    found: list[float] = []
    parts = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while parts:
        q, e, moved = parts.pop()
        while q:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] <= TINY), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # values converge at the end, the small ones first
                q, e = q[::-1], e[::-1]
            q, e, d = _sweep(q, e, 0.0)
            least = 1.0 / sum(1.0 / max(x, TINY) for x in d)
            shift = least * (1 - 8 * len(q) * EPS)
            while shift > EPS * moved * 0.5:
                after = _sweep(q, e, shift)
                if after is not None:
                    q, e, moved = after[0], after[1], moved + shift
                    break
                shift /= 2
    return sorted(found, reverse=True)


def _twisted(q: np.ndarray, l: np.ndarray, value: float, among: list[np.ndarray]) -> np.ndarray:
    """Unit vector of the eigenvalue of L diag(q) L', by the twist with the smallest pivot; orthogonal to ``among``."""
    n = len(q)
    down, s = np.zeros(n), np.zeros(n)
    s[0] = -value
    lower = np.zeros(n)
    for i in range(n):
        down[i] = s[i] + q[i]
        if abs(down[i]) < TINY:
            down[i] = TINY
        if i + 1 < n:
            lower[i] = q[i] * l[i] / down[i]
            s[i + 1] = lower[i] * l[i] * s[i] - value
    p, upper = np.zeros(n), np.zeros(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        up = q[i] * l[i] * l[i] + p[i + 1]
        up = up if abs(up) >= TINY else TINY
        t = q[i] / up
        upper[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    pivots = np.abs(s + p + value)
    best = None
    for r in np.argsort(pivots, kind="stable"):
        z = np.zeros(n)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
            if abs(z[i]) > HUGE:
                z[i:] /= HUGE
        for i in range(r, n - 1):
            z[i + 1] = -upper[i] * z[i]
            if abs(z[i + 1]) > HUGE:
                z[: i + 2] /= HUGE
        z /= np.linalg.norm(z)
        for _ in range(2):
            for other in among:
                z -= (other @ z) * other
        size = np.linalg.norm(z)
        if best is None or size > best[0]:
            best = (size, z / size if size > 0 else z)
        if size > 0.5:
            break
    return best[1]


def _together(q: np.ndarray, l: np.ndarray, values: list[float], among: list[np.ndarray]) -> list[np.ndarray]:
    """Unit vectors of values so close that no factorisation tells them apart: any base of their common space, by
    inverse iteration on all at once and a Ritz step; orthogonal to ``among``."""
    n, m = len(q), len(values)
    whole = np.diag(np.sqrt(q)) + np.diag(l * np.sqrt(q[:-1]), 1)
    square = whole.T @ whole
    shifted = square - (values[0] * (1 + 4 * EPS)) * np.eye(n)
    z = np.linalg.qr(np.random.default_rng(n).normal(size=(n, m)))[0]
    others = np.array(among).reshape(len(among), n)
    for _ in range(3):
        z = np.linalg.qr(np.linalg.solve(shifted, z))[0]
        z = np.linalg.qr(z - others.T @ (others @ z))[0]
    z = z @ np.linalg.eigh(z.T @ square @ z)[1][:, ::-1]
    return list(z.T)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of r'r, at most ``most``, falling, and their unit vectors as columns.

    Eigenvalues that are zero to working precision are given as 0, with a zero vector.
    """
    d = r.shape[0]
    diagonal, above, right = bidiagonal(r)
    size = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if size == 0:
        return np.zeros(min(most, d)), np.zeros((d, min(most, d)))
    a, b = diagonal / size, above / size
    ends = [*(int(i) + 1 for i in np.flatnonzero(np.abs(b) <= d * EPS)), d]  # a coupling of rounding size is none
    solved, start = [], 0
    for end in ends:
        q = np.maximum(a[start:end] ** 2, EPS**2)
        e = b[start : end - 1] ** 2
        solved += [(value, start, end) for value in dqds(list(q), list(e))]
        start = end
    solved.sort(key=lambda found: -found[0])
    zero = (d * EPS) ** 2 * solved[0][0]
    solved = solved[:most]
    vectors = [np.zeros(d) for _ in solved]
    for start, end in {(start, end) for _, start, end in solved}:
        q = np.maximum(a[start:end] ** 2, EPS**2)
        l = b[start : end - 1] * np.where(a[start : end - 1] < 0, -1.0, 1.0) / np.sqrt(q[:-1])
        own = [i for i, (value, s, _) in enumerate(solved) if s == start and value > zero]
        near: list[tuple[float, np.ndarray]] = []
        while own:
            same = 1
            while same < len(own) and solved[own[same - 1]][0] - solved[own[same]][0] <= 1e-11 * solved[own[0]][0]:
                same += 1
            values = [solved[i][0] for i in own[:same]]
            near = [(v, z) for v, z in near if v - values[0] <= 1e-3 * v]  # only close values need be set apart
            among = [z for _, z in near]
            new = _together(q, l, values, among) if same > 1 else [_twisted(q, l, values[0], among)]
            near += zip(values, new)
            for i, z in zip(own, new):
                whole = np.zeros(d)
                whole[start:end] = z
                vectors[i] = reflected(whole, right)
            own = own[same:]
    values = [value * size * size if value > zero else 0.0 for value, _, _ in solved]
    return np.array(values), np.array(vectors).T


# -- the rows, on Spark -------------------------------------------------------------------


def _integers(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have integers that fit a long, and those."""
    scaled = np.floor(SCALE * rows)
    fits = (np.abs(scaled) < 2.0**62).all(axis=1)
    return fits, scaled[fits].astype(np.int64) + OFFSET


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, rows in matrices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([lists(_integers(rows)[1], pa.int64())], ["x"])


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S as int64, or as Python integers where int64 is too small."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of rows at place -1, sums by dimension; each task sums its rows first."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = longs(batch.column(0))
            exact = x if int(np.abs(x).max()) < 2**40 else x.astype(object)
            part = exact.sum(axis=0).astype(object)
            n, total = n + len(x), part if total is None else total + part
    if n:
        values = pa.array([Decimal(int(v)) for v in [n, *total]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), values], ["place", "total"])


def _stacked(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def _triangles(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = None
        for batch in batches:
            if batch.num_rows:
                triangle = _stacked(triangle, (_exact(longs(batch.column(0)), n, sums) / n).astype(float))
        if triangle is not None:
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([triangle.ravel()])], ["slot", "r"])

    return run


def _merged(d: int):
    def run(table: pa.Table) -> pa.Table:
        triangle = None
        for r in table.column("r").to_pylist():
            triangle = _stacked(triangle, np.array(r).reshape(-1, d))
        slot = pa.array([table.column("slot")[0].as_py() // FAN], pa.int32())
        return pa.Table.from_arrays([slot, pa.array([triangle.ravel()])], ["slot", "r"])

    return run


def triangle(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The d by d factor R of the centred rows: one a task, then merged ``FAN`` at a time."""
    now = written(arrow(fit, _triangles(n, sums), "slot int, r array<double>"), "triangles")
    while now.agg(F.max("slot")).first()[0] >= FAN:
        step = written(now.groupBy(F.floor(F.col("slot") / FAN)).applyInArrow(_merged(d), now.schema), "triangles")
        dropped(now)
        now = step
    whole = None
    for row in now.orderBy("slot").collect():  # FAN triangles at most
        whole = _stacked(whole, np.array(row["r"]).reshape(-1, d))
    dropped(now)
    return np.vstack([whole, np.zeros((d - len(whole), d))])


@dataclass(frozen=True)
class Whitening:
    """``n`` and ``sums`` of the fit list; per component its eigenvalue, unit vector (a column) and share of the variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        return self.values > 0

    @property
    def map(self) -> np.ndarray:
        return np.divide(self.vectors, np.sqrt(self.values), out=np.zeros_like(self.vectors), where=self.usable)


def _moments(model: Whitening):
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                w = (_exact(longs(batch.column(0)), model.n, model.sums) / model.n).astype(float) @ model.map
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total)], ["place", "total"])

    return run


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on the rows."""
    k, use = len(model.values), model.usable
    if not use.any():
        return None
    sums = arrow(fit, _moments(model), "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
    total = np.array([r["total"] for r in sums.orderBy("place").collect()])  # k + k * k rows
    mean, second = total[:k] / model.n, total[k:].reshape(k, k) / model.n
    return float(np.abs((second - np.outer(mean, mean) - np.eye(k))[np.ix_(use, use)]).max())


def fitted(vectors: DataFrame, column: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening of a column of vectors; None if no vector is usable."""
    different = written(arrow(vectors.select(column), _fit_rows, "x array<bigint>").distinct(), "fit-list")
    common = different.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return None
    d, fit = common["d"], different.where(F.size("x") == common["d"])
    sums = arrow(fit, _sums, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total"))
    n, *sums = [int(r["total"]) for r in sums.orderBy("place").collect()]  # d + 1 rows
    r = triangle(fit, d, n, sums)
    values, directed = directions(r, components)
    model = Whitening(n, sums, values / n, directed, float((r**2).sum()) / n)
    model = Whitening(n, sums, model.values, directed, model.trace, _identity_error(fit, model))
    dropped(different)
    return model


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _applied(model: Whitening):
    k = len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in matrices(batch.column(1)):
                if rows.shape[1] != len(model.sums):
                    continue
                fits, x = _integers(rows)
                apart = _exact(x, model.n, model.sums)
                small = apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < 2**63
                squares = (apart**2 if small else apart.astype(object) ** 2).sum(axis=1)
                deviation = pa.array([int(s) if s < 2**63 else None for s in squares], pa.int64())
                w = (apart / model.n).astype(float) @ model.map
                m, each = len(x), np.repeat(np.arange(len(x)), k)
                known = np.tile(~model.usable, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[fits][each])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        deviation.take(pa.array(each)),
                        pa.array(w.ravel(), mask=known),
                        pa.array(np.tile(explained, m), mask=np.tile(np.isnan(explained), m)),
                        pa.array([model.identity_error] * (m * k), pa.float64()),
                    ],
                    [f.split()[0] for f in OUT.split(", ")],
                )

    return run


def whitened(vectors: DataFrame, model: Whitening | None, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Every usable vector in the whitened space: one row per vector and component."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), column)
    if model is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    return arrow(rows, _applied(model), OUT)
