"""Whitening of embeddings by spectrum slicing (operator 12).

Entries are put on a grid, ``x = floor(64 c) + 1000000``, so sums are exact and equal vectors
are equal integers.  Spark makes the vectors distinct, sums them, and then sums the products
of the centred vectors: two passes over the distinct list, in which a task hands on one matrix.

The leading eigenpairs of that matrix (dimension squared, on the driver) are found one by one.
The LDL' factorisation of the covariance less a shift has as many negative pivots as there are
eigenvalues below the shift.  Such counts slice the spectrum until an interval holds only the
wanted eigenvalue; Rayleigh quotient iteration, kept orthogonal to the vectors found before,
then converges in a few steps, and counts on both sides of the result certify its number.
Where it leaves its interval, the interval is cut further and it starts again.

Special cases.  Vectors that are null or hold null or non-finite entries are left out, as are
entries of 2**40 and more, and vectors whose length is not the most frequent one (the longest
of those; empty vectors have none).  Equal eigenvalues get orthogonal vectors in any order.
Directions without variance cannot be whitened, so there are at most as many components as
the covariance has rank: none for an empty table or a single distinct vector.  Repeated rows
count once for the fit and are whitened each; null ids stay.  A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, staged
from .tasks import task

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Pivots of one row are taken while no entry beside them is larger by more than this.
_PIVOT = (1 + 17 ** 0.5) / 8
_EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Grid:
    """Size and sums of the distinct vectors: the sum of a place is ``n * whole + rest``."""

    n: int
    whole: list[int]
    rest: list[int]


@dataclass(frozen=True)
class Whitening:
    """``vectors`` has a unit eigenvector in each column, by falling ``values``."""

    grid: Grid
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []


def eigenvalues_below(matrix: np.ndarray, shift: float) -> int:
    """Negative pivots of the LDL' factorisation of ``matrix - shift``, with pivots of one or
    two rows chosen over the whole rest, so no zero or tiny pivot is ever divided by."""
    a = matrix - shift * np.eye(len(matrix))
    negative = 0
    while len(a):
        size = np.abs(a)
        k = int(np.argmax(size.diagonal()))
        pivot = size[k, k]
        np.fill_diagonal(size, 0)
        r, s = divmod(int(np.argmax(size)), len(a))
        if pivot == 0 and size[r, s] == 0:
            break
        rows = [k] if pivot >= _PIVOT * size[r, s] else [r, s]
        rest = np.delete(np.arange(len(a)), rows)
        side, block = a[np.ix_(rest, rows)], a[np.ix_(rows, rows)]
        negative += int(block[0, 0] < 0) if len(rows) == 1 else 1  # a block of two has one of each sign
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return negative


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` leading eigenvalues above rounding, falling, and their unit vectors."""
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if norm == 0:
        return np.zeros(0), np.zeros((d, 0))
    floor = d * _EPS * norm
    known = {-floor: d, norm * (1 + 1e-12) + floor: 0}  # eigenvalues not below a shift
    random = np.random.default_rng(12)

    def above(x: float) -> int:
        if x not in known:
            known[x] = d - eigenvalues_below(matrix, x)
        return known[x]

    def cut(lo: float, hi: float, j: int) -> tuple[float, float]:
        mid = (lo + hi) / 2
        return (mid, hi) if above(mid) >= j else (lo, mid)

    def iterate(lo: float, hi: float, found: np.ndarray, tol: float):
        """Rayleigh quotient iteration from the middle; None where it ends elsewhere."""
        v, at = random.standard_normal(d), (lo + hi) / 2
        for step in range(30):
            v -= found @ (found.T @ v)
            try:
                v = np.linalg.solve(matrix - at * np.eye(d), v / np.linalg.norm(v))
            except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
                at += floor
                continue
            v /= np.linalg.norm(v)
            v -= found @ (found.T @ v)
            v /= np.linalg.norm(v)
            value = float(v @ matrix @ v)
            if np.linalg.norm(matrix @ v - value * v) <= tol:
                return (value, v) if lo - tol <= value <= hi + tol else None
            at = value if step else at  # a second step from the middle, then quotients
        return None

    values, found = [], np.zeros((d, 0))
    for j in range(1, min(most, d) + 1):
        if above(floor) < j:
            break
        lo = max(x for x, c in known.items() if c >= j)
        hi = min(x for x, c in known.items() if c < j)
        while (above(lo) > j or above(hi) < j - 1) and hi - lo > floor:
            lo, hi = cut(lo, hi, j)
        tol = floor
        while True:
            got = iterate(lo, hi, found, tol)
            if got and above(got[0] - 2 * tol) >= j and above(got[0] + 2 * tol) < j:
                break
            if hi - lo > floor:
                lo, hi = cut(lo, hi, j)
            elif tol < 1e-9 * norm:  # eigenvalues so close that only their common space is known
                tol *= 4
            else:
                raise ArithmeticError(f"no vector for eigenvalue {j} near {lo}")
        values.append(got[0])
        found = np.column_stack([found, got[1]])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], found[:, order]


def grid_vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column of length ``dims`` as integers on the grid."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _distinct(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.ascontiguousarray(grid_vectors(batch.column("vec"), dims).astype("<i8"))
            at = np.arange(len(x) + 1, dtype=np.int32) * (8 * dims)
            yield pa.RecordBatch.from_arrays(
                [pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])], names=["x"])

    return run


def _stored(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype="<i8").reshape(-1, dims)


def _sums(dims: int):
    """One row per place, and one of place -1 with the number of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _stored(batch, dims)
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(dims)], pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))],
            names=["place", "s"])

    return run


def scaled_offset(x: np.ndarray, grid: Grid) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where they hold it, else Python's."""
    off = x - np.array(grid.whole, dtype=np.int64)
    if int(np.abs(off).max(initial=0) + 1) * grid.n >= 1 << 62:
        off = off.astype(object)
    return off * grid.n - np.array(grid.rest, dtype=off.dtype)


def centred(x: np.ndarray, grid: Grid) -> np.ndarray:
    return scaled_offset(x, grid).astype(np.float64) / grid.n


def _products(dims: int, grid: Grid, values: np.ndarray | None = None, vectors: np.ndarray | None = None):
    """Sums of the centred vectors' products (row <= column), and of themselves (row -1); with
    eigenpairs, those of the whitened vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = dims if values is None else len(values)
        product, total = np.zeros((wide, wide)), np.zeros(wide)
        for batch in batches:
            z = centred(_stored(batch, dims), grid)
            if values is not None:
                z = z @ vectors / np.sqrt(values)
            product += z.T @ z
            total += z.sum(axis=0)
        i, j = np.triu_indices(wide)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([i, np.full(wide, -1)]), pa.int32()),
             pa.array(np.concatenate([j, np.arange(wide)]), pa.int32()),
             pa.array(np.concatenate([product[i, j], total]))], names=["i", "j", "s"])

    return run


def _covariance(fit: DataFrame, made: Callable, wide: int, n: int) -> np.ndarray:
    sums = fit.mapInArrow(made, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out, mean = np.zeros((wide, wide)), np.zeros(wide)
    for i, j, s in sums.collect():  # bounded: about half the dimension squared
        if i < 0:
            mean[j] = s / n
        else:
            out[i, j] = out[j, i] = s / n
    return out - np.outer(mean, mean)  # the means are nothing but rounding


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, vec`` of the rows that can be whitened by their entries."""
    rows = pick(embeddings, vec_id=id_col, vec=vector_col)
    good = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) &
                    (F.abs(c.cast("double")) < F.lit(float(1 << 40))))
    return rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & good)


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fits on the distinct vectors of ``usable`` rows; None if there are none."""
    lengths = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if first is None:
        return None
    dims = first["dims"]
    same = rows.filter(F.size("vec") == dims).select("vec")
    fit = staged(same.mapInArrow(task(_distinct, dims), "x binary").distinct(), "whitening-fit")
    sums = dict(map(tuple, fit.mapInArrow(task(_sums, dims), "place int, s decimal(38,0)").groupBy("place").agg(
        F.sum("s").alias("s")).collect()))  # bounded: one row per place of a vector
    n = int(sums[-1])
    whole, rest = zip(*[divmod(int(sums[i]), n) for i in range(dims)])
    grid = Grid(n, list(whole), list(rest))
    covariance = _covariance(fit, task(_products, dims, grid), dims, n)
    values, vectors = leading_eigenpairs(covariance, components)
    error = 0.0
    if len(values):
        back = _covariance(fit, task(_products, dims, grid, values, vectors), len(values), n)
        error = float(np.abs(back - np.eye(len(values))).max())
    return Whitening(grid, values, vectors, float(np.trace(covariance)), error)


def deviations(x: np.ndarray, grid: Grid) -> list[int | None]:
    """Sum over the places of ``(n * x - S)**2``; null where 64 bits do not hold it."""
    off = scaled_offset(x, grid)
    if off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
        return (off * off).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in off]
    return [v if v < 1 << 63 else None for v in exact]


def _whiten(grid: Grid, values: np.ndarray, vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            x = grid_vectors(batch.column("vec"), len(grid.whole))
            w = centred(x, grid) @ vectors / np.sqrt(values)
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviations(x, grid), pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` (one entry per component) of ``usable`` rows."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    same = rows.filter(F.size("vec") == len(model.grid.whole))
    return same.mapInArrow(task(_whiten, model.grid, model.values, model.vectors),
                           f"vec_id {kind}, deviation long, whitened array<double>")
