"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become whole numbers; distinct vectors are the fit list. Tasks add up exact sums a dimension, then the scatter of
the vectors less their mean, a matrix a task; the matrices are added by cell in a shuffle. The driver holds one matrix of
d x d numbers for each vector length and turns it by symmetric Jacobi rotations, cycle by cycle, until what is off the
diagonal vanishes; small eigenvalues keep their relative accuracy, as each rotation is orthogonal to rounding. The
components, sorted by eigenvalue and scaled, go to the tasks (d x k numbers), which project every row.

Defined results: rows without a vector, or with a null, NaN or infinite entry, are dropped; null vec_ids are kept; repeated
rows are projected one by one and count once in the fit; vectors of different lengths are fitted apart; a component whose
eigenvalue is zero to rounding (repeated vectors only, dependent dimensions) has no scale and is left out, so such input
gives fewer rows or none; an empty table or empty vectors give no rows. Equal eigenvalues leave the choice of components
within their space open, which is made once, on the driver. Entries beyond 2^63 / 256 are taken as the largest long;
a deviation beyond a long is null. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.storage import written

LEVELS, COMPONENTS = 256, 4
#: An off-diagonal entry has vanished below the first share of the geometric mean of its two diagonal entries, or below
#: the second of the largest entry (null spaces have diagonal entries of rounding size).
VANISHED, NOTHING = 1e-15, 1e-22
#: Most sums, and most cells of matrices, of all lengths of vectors together that the driver holds; beyond, an error.
MOST_SUMS, MOST_CELLS = 1 << 20, 1 << 25
WIDEST = 2**63 - 1


def whole(vectors: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(vec_id, x): entries times `levels`, rounded down, of the rows with finite entries only."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * levels))
    return vectors.where(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long"), x.alias("x"))


def _by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a batch."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(at)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, values[at[rows][:, None] + np.arange(d)[None, :]]


def _exact(v: np.ndarray, times: int, squares: bool = False) -> np.ndarray:
    """v as it is where `times` of it (or of its square) fits a long, else as Python integers."""
    most = max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0
    return v if times * most ** (2 if squares else 1) < WIDEST else v.astype(object)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sum a dimension, for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for rows, x in _by_length(b.column("x")):
                total = found.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                total[0] += len(rows)
                total[1] = [a + int(s) for a, s in zip(total[1], _exact(x, len(x)).sum(axis=0).tolist(), strict=True)]
        cells = [(d, -1, str(n)) for d, (n, _) in found.items()] + [(d, i, str(s)) for d, (_, t) in found.items() for i, s in enumerate(t)]
        yield _table(cells, {"d": pa.int32(), "i": pa.int32(), "s": pa.string()})

    cells = fit.mapInArrow(run, "d int, i int, s string").groupBy("d", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    told = cells.limit(MOST_SUMS + 1).collect()
    if len(told) > MOST_SUMS:
        raise ValueError("too many lengths of vectors for their sums to go to the driver")
    found: dict[int, dict[int, int]] = {}
    for r in told:
        found.setdefault(r["d"], {})[r["i"]] = int(r["s"])
    return {d: (t[-1], [t[i] for i in range(d)]) for d, t in found.items()}


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def scatter(fit: DataFrame, centred: dict[int, tuple[np.ndarray, np.ndarray | None]]) -> dict[int, np.ndarray]:
    """Sum of outer products of the vectors less their mean, projected if a projection is given, for each length.

    centred: mean and projection (d x k, or None for all dimensions as they are) of each length.
    """
    if sum((len(m) if p is None else p.shape[1]) ** 2 for m, p in centred.values()) > MOST_CELLS:
        raise ValueError("vectors too long for a matrix on the driver")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _by_length(b.column("x")):
                mean, onto = centred[x.shape[1]]
                y = x - mean if onto is None else (x - mean) @ onto
                found[x.shape[1]] = found.get(x.shape[1], 0) + y.T @ y
        d = np.concatenate([np.full(m.size, k, np.int32) for k, m in found.items()] or [np.zeros(0, np.int32)])
        at = [np.indices(m.shape, np.int32).reshape(2, -1) for m in found.values()]
        i, j = np.concatenate(at, axis=1) if at else np.zeros((2, 0), np.int32)
        v = np.concatenate([m.ravel() for m in found.values()] or [np.zeros(0)])
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(i), pa.array(j), pa.array(v, pa.float64())], names=["d", "i", "j", "v"])

    cells = fit.mapInArrow(run, "d int, i int, j int, v double").where("i <= j").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    out = {d: np.zeros((len(m) if p is None else p.shape[1],) * 2) for d, (m, p) in centred.items()}
    for r in cells.collect():
        out[r["d"]][r["i"], r["j"]] = out[r["d"]][r["j"], r["i"]] = r["v"]
    return out


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations."""
    a = a.copy()
    d, vectors, least = len(a), np.eye(len(a)), NOTHING * np.abs(a).max(initial=0.0)
    turned = True
    while turned:
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off, app, aqq = a[p, q], a[p, p], a[q, q]
                if abs(off) <= max(least, VANISHED * np.sqrt(abs(app * aqq))):
                    continue
                turned = True
                theta = (aqq - app) / (2 * off)
                t = (1 if theta >= 0 else -1) / (abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [p, q]] = a[:, [p, q]] @ turn
                a[[p, q], :] = turn.T @ a[[p, q], :]
                a[p, q] = a[q, p] = 0.0
                vectors[:, [p, q]] = vectors[:, [p, q]] @ turn
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = vectors[:, order]
    return np.diag(a)[order], vectors / np.sqrt((vectors * vectors).sum(axis=0))


class Fit:
    """What one length's rows are projected with."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, components: int):
        values, vectors = jacobi(scatter / n)
        kept = values[:components] > len(values) * np.finfo(float).eps * max(values[0], 0.0)
        self.n, self.sums, self.mean = n, sums, np.array([s / n for s in sums])
        self.onto = vectors[:, :components][:, kept] / np.sqrt(values[:components][kept])
        self.number = 1 + np.flatnonzero(kept)
        self.explained = values[:components][kept] / np.trace(scatter / n)
        self.identity_error = 0.0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact."""
        reach = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        if x.shape[1] * reach**2 < WIDEST:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(axis=1).tolist()
        found = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()
        return [f if f <= WIDEST else None for f in found]


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length from the list of distinct vectors, which is read three times."""
    totals = sums(fit)
    means = {d: (np.array([v / n for v in s]), None) for d, (n, s) in totals.items()}
    found = {d: Fit(*totals[d], m, components) for d, m in scatter(fit, means).items()}
    held = scatter(fit, {d: (f.mean, f.onto) for d, f in found.items()})
    for d, f in found.items():
        if len(f.number):
            f.identity_error = float(np.abs(held[d] / f.n - np.eye(len(f.number))).max())
    return found


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    rows = whole(vectors)
    fits = fitted(written(rows.select("x").distinct()), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column("x")):
                f, ids = fits[x.shape[1]], b.column("vec_id").take(pa.array(at))
                k, m = len(f.number), len(at)
                each = np.repeat(np.arange(m), k)
                columns = {
                    "vec_id": ids.take(pa.array(each)), "component": pa.array(np.tile(f.number, m), pa.int32()), "n": pa.array(np.full(m * k, f.n), pa.int64()),
                    "deviation": pa.array(f.deviations(x), pa.int64()).take(pa.array(each)), "whitened": pa.array(((x - f.mean) @ f.onto).ravel(), pa.float64()),
                    "explained": pa.array(np.tile(f.explained, m), pa.float64()), "identity_error": pa.array(np.full(m * k, f.identity_error), pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
