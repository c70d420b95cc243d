"""Embedding whitening by QR, bidiagonal qd and twisted factorisations.

Entries are scaled to integers, so that the sums of every dimension are exact. Then:

1. Blockwise QR. Every task keeps one triangular factor R of the centred rows it has seen; the factors of tasks are
   stacked and reduced again, FAN at a time, until one is left. R'R is n times the covariance, which is never formed.
2. Householder reflections make R upper bidiagonal, B = U'RV.
3. dqds, the shifted quotient-difference algorithm, finds the squared singular values of B, each to high relative accuracy.
4. Of the leading ones, the twisted factorisation of B'B - s I gives the vector, at the twist where its pivot is least.
   Vectors of close values are made orthogonal. V takes them back to the dimensions of the rows.

Rows are whitened by these few components in a second pass, and the covariance of what came out is measured in a third.
Only sums of dimensions and one D x D factor go through the driver, whatever the number of rows.

Defined cases: rows without a vector, or whose vector has null or non-finite entries or another length than most, are
dropped; a null id stays; repeated rows count, and come out, as often as they are there; entries beyond 2^40 count as that;
components without variance (at most D roundings of the largest) cannot be whitened and are left out, so equal rows, or one row
alone, give no rows; a deviation that no long holds is null; no rows give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, staged
from tidemark.llm.vectors import ID, VECTOR, matrix, sound_vectors

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
LARGEST = 2.0**40
#: Factors that one task reduces to one.
FAN = 32
#: Rows of a block of the QR, as a multiple of the dimensions.
BLOCK = 8
EPS = 2.0**-52
#: Squared singular values nearer than this, relatively, are a cluster.
CLOSE = 1e-3


def scaled(rows):
    """floor(1024 c) + 100000 as integers."""
    import numpy as np

    return np.floor(SCALE * np.clip(rows, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def centred(x, sums: list[int], n: int):
    """x - sums / n, subtracted from integers before anything is rounded."""
    import numpy as np

    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def exact_sums(vectors: DataFrame, d: int) -> list[int]:
    """Sums of the scaled entries of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x = scaled(matrix(batch.column(0), d))
            high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
            total = [t + (int(h) << 26) + int(r) for t, h, r in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total))], names=["j", "total"])

    sums = vectors.select("v").mapInArrow(run, "j int, total string").groupBy("j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s"))
    found = {r.j: int(r.s) for r in sums.collect()}
    return [found[j] for j in range(d)]


class Triangle:
    """The triangular factor of all rows added so far, at most D x D."""

    def __init__(self, d: int) -> None:
        import numpy as np

        self.d, self.r = d, np.zeros((0, d))

    def add(self, rows) -> None:
        import numpy as np

        for at in range(0, len(rows), BLOCK * self.d):
            self.r = np.linalg.qr(np.concatenate((self.r, rows[at : at + BLOCK * self.d])), mode="r")

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([self.r.tobytes()], pa.binary())], names=["part", "r"])


def triangular(vectors: DataFrame, d: int, sums: list[int], n: int):
    """R of the QR factorisation of all centred rows."""
    import numpy as np

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Triangle(d)
        for batch in batches:
            t.add(centred(scaled(matrix(batch.column(0), d)), sums, n))
        if len(t.r):
            yield t.row()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Triangle(d)
        for batch in batches:
            for r in batch.column(1):
                t.add(np.frombuffer(r.as_buffer(), np.float64).reshape(-1, d))
        if len(t.r):
            yield t.row()

    factors = staged(vectors.select("v").mapInArrow(first, "part int, r binary"), "factors")
    while (k := factors.count()) > 1:
        groups = -(-k // FAN)
        before, factors = factors, staged(factors.repartition(groups, F.col("part") % groups).mapInArrow(again, "part int, r binary"), "factors")
        discard(before)
    r = np.frombuffer(bytes(factors.first().r), np.float64).reshape(-1, d)
    discard(factors)
    return np.concatenate((r, np.zeros((d - len(r), d))))


def bidiagonal(r):
    """Diagonal, upper diagonal and V of R = U B V'."""
    import numpy as np

    a, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflector(x):
        u = x.copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        u[0] += np.copysign(norm, u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        if (u := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2.0 * np.outer(u, u @ a[k:, k:])
        if k < d - 2 and (u := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2.0 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2.0 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _transform(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float]] | None:
    """One dqds step with shift ``s``; None where the shift is too large."""
    d, out_q, out_e = q[0] - s, [], []
    for i in range(len(e)):
        if d < 0 or d != d:
            return None
        p = d + e[i]
        t = q[i + 1] / p if p > 0 else 0.0
        out_q.append(p)
        out_e.append(e[i] * t)
        d = d * t - s
    return None if d < 0 or d != d else ([*out_q, d], out_e)


def _last_pair(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows and columns."""
    a = q[-2] + (e[-2] if len(e) > 1 else 0.0)
    trace, det = a + q[-1] + e[-1], a * (q[-1] + e[-1]) - q[-2] * e[-1]
    root = (max(0.0, trace * trace / 4 - det)) ** 0.5
    large = trace / 2 + root
    return max(0.0, det / large) if large > 0 else 0.0


def squared_singular_values(diagonal, upper) -> list[float]:
    """Of an upper bidiagonal matrix, by dqds with deflation and splitting, largest first."""
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    found: list[float] = []
    steps = 0
    while blocks:
        q, e, sigma = blocks.pop()
        while q:
            if len(q) == 1 or e[-1] <= EPS * EPS * (sigma + q[-1]) or e[-1] < 1e-300:
                found.append(sigma + q.pop())
                if e:
                    e.pop()
                continue
            split = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= EPS * EPS * (sigma + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if split is not None:
                blocks.append((q[: split + 1], e[:split], sigma))
                q, e = q[split + 1 :], e[split + 1 :]
                continue
            if q[0] < q[-1]:  # turned round, so that small values sink to the end
                q, e = _turned(q, e)
            s = _last_pair(q, e)
            for shift in (s * (1 - 8 * EPS), s * 0.9, s * 0.25, 0.0):
                if (new := _transform(q, e, shift)) is not None:
                    (q, e), sigma = new, sigma + shift
                    break
            steps += 1
            if steps > 100 * (len(diagonal) + 10):
                raise ArithmeticError("dqds did not converge")
    return sorted(found, reverse=True)


def _turned(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The qd arrays of the matrix with rows and columns in reverse, with the same singular values."""
    return q[::-1], e[::-1]


class Twisted:
    """Twisted factorisations of B'B - s I = L D L' - s I."""

    def __init__(self, diagonal, upper) -> None:
        import numpy as np

        largest = max(np.abs(diagonal).max(), np.abs(upper).max() if len(upper) else 0.0)
        a = np.where(np.abs(diagonal) < EPS * largest, EPS * largest, diagonal)
        self.d = (a * a).tolist()
        self.l = (upper / a[:-1]).tolist()
        self.tiny = 1e-280 * max(1.0, largest * largest)

    def factors(self, s: float):
        """Multipliers from above, from below, and the pivot at every twist."""
        d, n, safe = self.d, len(self.d), lambda x: x if abs(x) > self.tiny else self.tiny
        above, below, up, down = [0.0] * n, [0.0] * n, [0.0] * (n - 1), [0.0] * (n - 1)
        above[0], below[-1] = -s, d[-1] - s
        for i in range(n - 1):
            up[i] = self.l[i] * d[i] / safe(d[i] + above[i])
            above[i + 1] = up[i] * self.l[i] * above[i] - s
        for i in range(n - 2, -1, -1):
            t = d[i] / safe(d[i] * self.l[i] * self.l[i] + below[i + 1])
            down[i] = self.l[i] * t
            below[i] = below[i + 1] * t - s
        return up, down, [x + y + s for x, y in zip(above, below, strict=True)]

    def vector(self, up: list[float], down: list[float], twist: int):
        import numpy as np

        z = np.zeros(len(self.d))
        z[twist] = 1.0
        for i in range(twist - 1, -1, -1):
            z[i] = -up[i] * z[i + 1]
        for i in range(twist, len(z) - 1):
            z[i + 1] = -down[i] * z[i]
        return z / np.linalg.norm(z)


def right_vectors(diagonal, upper, squares: list[float], k: int):
    """Right singular vectors (columns) of the ``k`` largest of ``squares``, which are in falling order."""
    import numpy as np

    twisted = Twisted(diagonal, upper)
    n = len(diagonal)
    b = np.diag(diagonal) + (np.diag(upper, 1) if n > 1 else 0.0)
    out, cluster = np.zeros((n, k)), 0
    for j in range(k):
        s = squares[j]
        if j and squares[j - 1] - s > CLOSE * squares[j - 1]:
            cluster = j
        near = out[:, cluster:j]
        up, down, pivots = twisted.factors(s)
        best, kept = None, -1.0
        for twist in np.argsort(np.abs(pivots), kind="stable")[: 2 * (j - cluster) + 1].tolist():
            z = twisted.vector(up, down, twist)
            z = z - near @ (near.T @ z)
            if np.isfinite(z).all() and np.linalg.norm(z) > max(kept, 0.0):
                best, kept = z / np.linalg.norm(z), float(np.linalg.norm(z))
            if kept > 0.7:
                break
        if best is None or (j > cluster and kept < 0.7):  # too close to tell apart by twists: inverse iteration beside the others
            t = b.T @ b - (s + EPS * squares[0]) * np.eye(n)
            best = np.random.default_rng(j).standard_normal(n) if best is None else best
            for _ in range(4):
                best = best - near @ (near.T @ best)
                best = np.linalg.solve(t, best / np.linalg.norm(best))
        for _ in range(2):
            best = best - near @ (near.T @ best)
            best = best / np.linalg.norm(best)
        out[:, j] = best
    return out


def components(r, k: int):
    """(directions as columns, squared singular values, their total) of the leading components of R."""
    import numpy as np

    diagonal, upper, v = bidiagonal(r)
    squares = squared_singular_values(diagonal, upper)
    total = float(np.sum(squares))
    k = sum(s > len(r) * EPS * squares[0] for s in squares[:k])
    directions = v @ right_vectors(diagonal, upper, squares, k) if k else np.zeros((len(r), 0))
    signs = [1.0 if c[np.argmax(np.abs(c))] >= 0 else -1.0 for c in directions.T]
    return directions * np.array(signs), squares[:k], total


def _deviations(x, sums: list[int], n: int) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exactly."""
    import numpy as np

    if not len(x):
        return []
    ends = [(n * int(f(c)), t) for c, t in zip(x.T, sums, strict=True) for f in (np.min, np.max)]
    furthest = max(abs(v - t) for v, t in ends)
    if max(abs(y) for pair in ends for y in pair) < 1 << 62 and furthest * furthest * x.shape[1] < 1 << 63:
        off = x * n - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    exact = [int(sum((n * int(c) - t) ** 2 for c, t in zip(row, sums, strict=True))) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def _identity_error(rows: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of the column ``w`` minus the identity."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = matrix(batch.column(0), k)
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], names=["at", "total"])

    sums = dict(rows.select("w").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total")).collect())
    total = np.array([sums[i] for i in range(k * (k + 1))]).reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(table: DataFrame, components_at_most: int = COMPONENTS, id: str = ID, vector: str = VECTOR) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every sound row and leading component."""
    import numpy as np

    vectors, d, n = sound_vectors(table, id, vector)
    kind = dict(table.dtypes)[id]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = table.sparkSession.createDataFrame([], schema)
    if not n:
        return nothing
    sums = exact_sums(vectors, d)
    directions, squares, total = components(triangular(vectors, d, sums, n), components_at_most)
    k = len(squares)
    if not k:
        return nothing
    scale = directions / np.sqrt(np.array(squares) / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = scaled(matrix(batch.column(1), d))
            w = (centred(x, sums, n) @ scale).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(w) + 1, k), pa.int32()), pa.array(w))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(x, sums, n), pa.int64()), lists], names=["id", "deviation", "w"])

    rows = staged(vectors.mapInArrow(run, f"id {kind}, deviation long, w array<double>"), "whitened")
    error = _identity_error(rows, k, n)
    explained = F.array(*[F.lit(s / total) for s in squares])
    out = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("w").alias("j", "whitened"))
    return out.select("vec_id", (F.col("j") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("j")).alias("explained"), F.lit(error).alias("identity_error"))
