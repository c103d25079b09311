"""Whitening of embeddings: blockwise QR of the centred rows, Householder bidiagonalisation, dqds for the values, twisted factorisations for the directions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.scratch import bounded, drop, write

SCALE, SHIFT = 1024, 100_000
#: Larger entries count as this, so that every one is a long (a float32 may be far beyond).
MOST = 1 << 50
#: Triangles that one task puts together, and that the driver gets at most.
FAN = 32
#: Rows that one QR step takes.
ROWS = 4096
EPS = float(np.finfo(float).eps)


@dataclass
class Whitener:
    n: int
    #: Exact sum of each dimension.
    sums: list[int]
    #: One column for each component, of unit length.
    directions: np.ndarray
    #: Eigenvalues of the covariance, falling, and the sum of all.
    values: np.ndarray
    trace: float


# --- the bidiagonal solver: numpy on one matrix as wide as a vector -------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V of r = U B V', by Householder reflections from both sides; U is not kept."""
    d = r.shape[1]
    m = np.zeros((d, d))
    m[: len(r)] = r
    v = np.eye(d)
    for k in range(d):
        _reflect(m[k:, k:])
        if k < d - 2:
            u = _reflect(m[k:, k + 1 :].T)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflect(m: np.ndarray) -> np.ndarray:
    """Clear the first column of m below its first entry, in place; returns the reflection's unit vector (zeros if none is needed)."""
    u = m[:, 0].copy()
    scale = np.abs(u).max()
    if scale == 0:
        return u
    u /= scale
    u[0] += math.copysign(np.linalg.norm(u), u[0])
    u /= np.linalg.norm(u)
    m -= 2 * np.outer(u, u @ m)
    m[1:, 0] = 0
    return u


def blocks_of(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that negligible superdiagonal entries leave unconnected."""
    cut = np.flatnonzero(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:]))) + 1
    at = [0, *cut.tolist(), len(a)]
    return list(zip(at, at[1:]))


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the bidiagonal (a, b), falling, by differential qd steps with shifts.

    Each step's shift is one over the sum of 1/d of an unshifted step, that is one over the trace of the inverse: never beyond
    the smallest value that is left, so no step fails but for rounding; then a smaller shift is tried.
    """
    scale = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if scale == 0:
        return np.zeros(len(a))
    q0, e0 = np.maximum((a / scale) ** 2, 1e-60), (b / scale) ** 2
    found, todo = [], [(q0.tolist(), e0.tolist(), 0.0)]
    limit = (16 * EPS) ** 2
    steps = 200 * len(a) + 1000
    while todo:
        q, e, sigma = todo.pop()
        while len(q) > 1:
            if e[-1] <= limit * (sigma + q[-1]):
                found.append(q.pop() + sigma)
                e.pop()
                continue
            split = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= limit * (sigma + min(q[i], q[i + 1]))), None)
            if split is not None:
                todo.append((q[: split + 1], e[:split], sigma))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if q[0] * 1.5 < q[-1]:  # the smallest value is to come out at the end
                q, e = q[::-1], e[::-1]
                q, e, _ = _qd(q, e, 0.0)
            q, e, inverse = _qd(q, e, 0.0)
            shift = (1 - 8 * EPS) / inverse
            for _ in range(60):
                moved = _qd(q, e, shift)
                if moved[2] is not None:
                    q, e, sigma = moved[0], moved[1], sigma + shift
                    break
                shift /= 4
            steps -= 1
            if steps < 0:
                raise ArithmeticError("the qd steps do not converge")
        found += [x + sigma for x in q]
    return np.sort(np.maximum(found, 0))[::-1] * scale * scale


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float | None]:
    """One step: new q and e, and the sum of 1/d; that is None if the shift was too large."""
    d = q[0] - shift
    new_q, new_e, inverse = [], [], 0.0
    for i, x in enumerate(e):
        if d < 0:
            return q, e, None
        inverse += 1 / max(d, 1e-300)
        top = d + x
        ratio = q[i + 1] / max(top, 1e-300)
        new_q.append(top)
        new_e.append(x * ratio)
        d = d * ratio - shift
    if d < 0:
        return q, e, None
    new_q.append(d)
    return new_q, new_e, inverse + 1 / max(d, 1e-300)


class Twisted:
    """B'B - value, factored from both ends; they meet where the rest is smallest."""

    def __init__(self, a: np.ndarray, b: np.ndarray, value: float) -> None:
        n, tiny = len(a), EPS * EPS * max(value, 1e-300)
        d = np.maximum(a * a, 1e-300)
        low = (a[:-1] * b) / d[:-1]
        s, self.plus, self.down = np.zeros(n), np.zeros(n), np.zeros(n - 1)
        s[0] = -value
        for i in range(n):
            self.plus[i] = s[i] + d[i] or tiny
            if i < n - 1:
                self.down[i] = d[i] * low[i] / self.plus[i]
                s[i + 1] = self.down[i] * low[i] * s[i] - value
        p, self.minus, self.up = np.zeros(n), np.zeros(n), np.zeros(n - 1)
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            self.minus[i + 1] = d[i] * low[i] ** 2 + p[i + 1] or tiny
            ratio = d[i] / self.minus[i + 1]
            self.up[i] = low[i] * ratio
            p[i] = p[i + 1] * ratio - value
        rest = s + p + value
        rest = np.where(np.isfinite(rest), rest, np.inf)
        self.at = int(np.argmin(np.abs(rest)))
        self.rest = rest[self.at] or tiny

    def vector(self) -> np.ndarray:
        n, k = len(self.plus), self.at
        z = np.zeros(n)
        z[k] = 1
        for i in range(k - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z

    def solve(self, x: np.ndarray) -> np.ndarray:
        n, k, y = len(self.plus), self.at, x.copy()
        for i in range(k):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        y[:k] /= self.plus[:k]
        y[k] /= self.rest
        y[k + 1 :] /= self.minus[k + 1 :]
        for i in range(k - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(k, n - 1):
            y[i + 1] -= self.up[i] * y[i]
        return y


def _direction(a: np.ndarray, b: np.ndarray, value: float, near: list[np.ndarray], seed: int) -> np.ndarray:
    """Unit eigenvector of B'B; `near` are those found before of values so close that rounding could mix them."""
    factors = Twisted(a, b, value)
    z = factors.vector()
    for _ in range(2):  # the rest over the squared length is the value's error
        better = value + factors.rest / (z @ z)
        if not near and 0 < better and abs(better - value) <= 1e-8 * value:
            value, factors = better, Twisted(a, b, better)
            z = factors.vector()
    z /= np.linalg.norm(z)
    if not near:
        return z
    # Some start from the factors themselves; what rounding mixed in is taken off, and the solver brings back what belongs there.
    own = z - sum((v @ z) * v for v in near)
    z = own if np.linalg.norm(own) > 0.5 else np.random.default_rng(seed).normal(size=len(a))
    for _ in range(6):
        for _ in range(2):
            for v in near:
                z = z - (v @ z) * v
            z /= np.linalg.norm(z)
        z = factors.solve(z)
        z /= np.abs(z).max()
    for _ in range(2):
        for v in near:
            z = z - (v @ z) * v
        z /= np.linalg.norm(z)
    return z


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of r, falling, and its right singular vectors as columns: the first `most` beyond rounding."""
    a, b, v = bidiagonal(r)
    found = []
    for low, high in blocks_of(a, b):
        found += [(x, low, high) for x in squared_values(a[low:high], b[low : high - 1])]
    found.sort(key=lambda f: (-f[0], f[1]))
    least = (found[0][0] if found else 0) * (8 * len(a) * EPS) ** 2
    found = [f for f in found if f[0] > least][:most]
    columns, seen = [], []
    for k, (value, low, high) in enumerate(found):
        near = [z for x, at, z in seen if at == low and x - value <= 1e-3 * x]
        z = _direction(a[low:high], b[low : high - 1], value, near, k)
        seen.append((value, low, z))
        columns.append(v[:, low:high] @ z)
    return np.array([f[0] for f in found]), np.array(columns).reshape(len(found), len(a)).T


# --- over Spark -----------------------------------------------------------------------------------------------------


def vectors(embeddings: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that count, and their width.

    Left out are vectors that are null or hold a null, NaN or infinity, and those of another length than the commonest (of
    lengths equally common, the longest).
    """
    v = F.col(column).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(math.inf)))  # NaN is above all
    rows = embeddings.select(F.col(id_column).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))
    width = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    return rows.filter(F.size("v") == (width[0] if width else 0)), width[0] if width else 0


def entries(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 * c) + 100000 of every entry, a row for each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs where they fit, else as Python integers."""
    high = n * (int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    return x * n - np.array(sums, np.int64) if high < 1 << 62 else x.astype(object) * n - np.array(sums, object)


def totals(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and each dimension's exact sum."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = entries(batch.column(0), width)
            parts = [(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]  # neither sum leaves a long
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *map(pa.array, parts), pa.array(np.full(width, len(x)))], ["i", "high", "low", "n"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    found = rows.select("v").mapInArrow(gather, "i long, high long, low long, n long").groupBy("i").agg(exact("high"), exact("low"), exact("n")).collect()  # one for each dimension
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in found}
    return (int(found[0]["n"]) if found else 0), [sums.get(i, 0) for i in range(width)]


def triangle(rows: DataFrame, width: int, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR of all centred rows. Tasks reduce their rows block by block, their triangles are put together FAN at a time."""

    def joined(r: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, more]), mode="r")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = entries(batch.column(0).slice(at, ROWS), width)
                r = joined(r, offsets(x, n, sums).astype(float) / n)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for batch in batches:
            for x in batch.column(0):
                r = joined(r, np.frombuffer(x.as_py()).reshape(-1, width))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    found, folder = write(rows.select("v").mapInArrow(reduce, "r binary"), "triangles")
    while (count := found.count()) > FAN:
        merged, next_folder = write(found.repartition(-(-count // FAN)).mapInArrow(merge, "r binary"), "triangles")
        drop(rows.sparkSession, folder)
        found, folder = merged, next_folder
    r = np.zeros((0, width))
    for x in found.collect():  # FAN at most, as wide and high as a vector
        r = joined(r, np.frombuffer(x["r"]).reshape(-1, width))
    drop(rows.sparkSession, folder)
    return r


def fit(rows: DataFrame, width: int, components: int) -> Whitener:
    """Components whose variance is beyond rounding, `components` at most."""
    n, sums = totals(rows, width) if width else (0, [])
    if not n:
        return Whitener(0, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    r = triangle(rows, width, n, sums)
    squares, directions = principal(r, components)
    return Whitener(n, sums, directions, squares / n, float((r * r).sum()) / n)


def projected(x: np.ndarray, w: Whitener) -> np.ndarray:
    return (offsets(x, w.n, w.sums).astype(float) / w.n) @ (w.directions / np.sqrt(w.values))


def identity_error(rows: DataFrame, width: int, w: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from one more pass over the rows."""
    k = len(w.values)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = projected(entries(batch.column(0), width), w)
            parts = np.concatenate([z.sum(0), (z.T @ z).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts)], ["i", "x"])

    total = np.zeros(k + k * k)
    for r in rows.select("v").mapInArrow(gather, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():  # k + k * k rows
        total[r["i"]] = r["x"]
    mean, second = total[:k] / w.n, total[k:].reshape(k, k) / w.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(embeddings: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each vector that counts and each component.

    Which vectors count: see `vectors`. Rows are taken as they come: equal vectors and repeated or null ids give rows each.
    Components are numbered from 1 by falling variance; those without variance beyond rounding are left out, so fewer rows than
    dimensions, or vectors that are all alike, give fewer components, at last none and no rows. `deviation` is a decimal, null
    beyond 38 digits. Entries beyond 2**50 / 1024 count as that. Other columns are not looked at.
    """
    bounded(embeddings.sparkSession)
    rows, width = vectors(embeddings, id_column, column)
    w = fit(rows, width, components)
    k = len(w.values)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    error, explained = identity_error(rows, width, w), w.values / w.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, rows = entries(part.column(1), width), part.num_rows
                z = projected(x, w)
                times = pa.array(np.repeat(np.arange(rows), k))
                columns = [part.column(0).take(times), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, w.n))]
                columns += [deviations(offsets(x, w.n, w.sums)).take(times), pa.array(z.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "v").mapInArrow(project, schema).withColumnRenamed("id", id_column)


def deviations(off: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exactly."""
    kind = pa.decimal128(38, 0)
    if off.dtype != object and off.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < 1 << 63:
        return pc.cast(pa.array((off * off).sum(1)), kind)
    exact = (off.astype(object) ** 2).sum(1)
    return pa.array([Decimal(int(x)) if x < 10**38 else None for x in exact], kind)
