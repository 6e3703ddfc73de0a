"""Whitening of embeddings by the eigenvectors of their covariance.

Rows are counted once where their vectors are equal (the fit list). Sums per
dimension are exact integers; the covariance is summed in tasks over vectors
that are centred first, one d by d matrix a task, and added up by entry. The
driver holds only such matrices of d * d numbers, never rows.

Eigenvectors start in float32 and are refined by matrix multiplications
in extended precision after Ogita and Aishima: with R = I - X'X and S = X'VX, X becomes
X + XE, where E corrects each pair of vectors by its gap of eigenvalues. Pairs
whose gap does not exceed the error of the present vectors are a cluster: float32
cannot tell them apart, so X'(V - mu I)X of the cluster alone, with mu its
mean, is scaled up and solved by itself, which turns the cluster's vectors
into place before the refinement goes on.

Defined cases: rows whose vector is null or holds a null, NaN or infinity are
left out; an empty vector has no components and gives no rows; vectors of
different lengths raise ValueError; a null id is an ordinary value; repeated rows are returned one by one; an
empty table gives an empty result. A component whose eigenvalue is zero to
rounding (constant or dependent dimensions) can't be whitened: `whitened` is null
there, and the identity is checked on the others. Eigenvalues that are equal
keep some orthonormal basis. Entries beyond 2**57 overflow a long and raise.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import vec
from .common import keep

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Eigenvalues nearer than this, beside the matrix's norm, always go through their cluster's own problem.
CLOSE = 1e-10
ROWS = 4096


def matrix_rows(column: pa.Array, d: int) -> np.ndarray:
    """A batch's lists of d longs as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Centre:
    """The mean S / n as whole part and rest, so that x - S / n loses nothing to the size of x."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        whole, rest = zip(*(divmod(s, n) for s in sums), strict=True)
        self.whole, self.rest = np.array(whole, np.int64), np.array(rest, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S)**2, exact."""
        off = x - self.whole
        if len(off) and float(((off.astype(np.float64) * self.n - self.rest) ** 2).sum(axis=1).max()) >= 2.0**63:
            raise OverflowError("a deviation does not fit a long")
        off = self.n * off - self.rest
        return (off * off).sum(axis=1)


def _per_task(add: Callable[[np.ndarray], np.ndarray], d: int):
    """A task's sum of what `add` makes of its matrices, as rows (place, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = add(matrix_rows(batch.column(0).slice(at, ROWS), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])
        vec.tidy()

    return run


def _summed(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray], d: int, kind: str) -> dict[int, float]:
    """Sums by place over all tasks; there are as many places as `add` returns numbers, d or d * d."""
    parts = rows.select("x").mapInArrow(_per_task(add, d), f"place long, value {kind}")
    return {r["place"]: r["value"] for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}


def covariance(fit: DataFrame, centre: Centre, d: int) -> np.ndarray:
    upper = np.triu_indices(d)

    def add(x: np.ndarray) -> np.ndarray:
        c = centre.centred(x)
        return (c.T @ c)[upper]

    sums = _summed(fit, add, d, "double")
    out = np.zeros((d, d))
    out[upper] = [sums[i] / centre.n for i in range(len(upper[0]))]
    return out + np.triu(out, 1).T


def _norm(m: np.ndarray) -> np.longdouble:
    return np.sqrt((m * m).sum())


def correction(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, list[np.ndarray]]:
    """(E, eigenvalues, largest error, clusters) of one refinement step.

    The error is that of R and of S outside its diagonal. E is such that its pairs add up to R, which keeps X orthonormal.
    """
    r = np.eye(len(v), dtype=x.dtype) - x.T @ x
    s = x.T @ v @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    bound = max(2 * (_norm(s - np.diag(values)) + _norm(v) * _norm(r)), CLOSE * _norm(v))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= bound
    e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(~near[order[:-1], order[1:]]) + 1
    error = max(np.abs(r).max(), np.abs(off).max() / _norm(v))
    return e, values, float(error), [c for c in np.split(order, cuts) if len(c) > 1]


def refine(v: np.ndarray, x: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of the symmetric `v` to double precision, from approximate vectors `x`, in falling order."""
    v, x = v.astype(np.longdouble), x.astype(np.longdouble)
    for _ in range(steps):
        e, values, error, clusters = correction(v, x)
        if error <= np.finfo(np.float64).eps / 8:
            break
        x = x + x @ e
        if np.abs(e).max() <= 1e-4:
            x = _sub_solve(v, x, clusters)
    values = np.diag(x.T @ v @ x) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order] / np.sqrt((x * x).sum(axis=0))[order]


def _sub_solve(v: np.ndarray, x: np.ndarray, clusters: list[np.ndarray]) -> np.ndarray:
    """Turn each cluster's vectors by the eigenvectors of its own, shifted and scaled problem."""
    x = x.copy()
    for c in clusters:
        own = x[:, c]
        t = own.T @ v @ own
        t -= np.eye(len(c)) * np.trace(t) / len(c)
        size = np.abs(t).max()
        if size > 0:
            _, turn = np.linalg.eigh(((t + t.T) / (2 * size)).astype(np.float64))
            x[:, c] = own @ turn.astype(np.longdouble)
    return x


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues and unit eigenvectors (columns) of `v`, by falling eigenvalue, in double precision."""
    size = np.abs(v).max(initial=0)
    if size == 0:
        return np.zeros(len(v)), np.eye(len(v))
    scaled = v.astype(np.longdouble) / size
    _, rough = np.linalg.eigh(scaled.astype(np.float32))
    values, x = refine(scaled, rough[:, ::-1])
    return (values * size).astype(np.float64), x.astype(np.float64)


def _shape(fit: DataFrame) -> tuple[int, int]:
    """(distinct vectors, their length)."""
    x = fit.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if x["least"] != x["most"]:
        raise ValueError(f"vectors of {x['least']} to {x['most']} entries; all must have the same length")
    return x["n"], x["most"] or 0


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a sound vector."""
    kind = rows.schema[key].dataType
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + F.lit(SHIFT))
    sound = rows.filter(good).select(F.col(key).alias("key"), x.alias("x"))
    fit = keep(sound.select("x").distinct(), "fit")
    n, d = _shape(fit)
    output = f"{key} {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], output)
    sums = _summed(fit, lambda m: (m - SHIFT).sum(axis=0), d, "long")
    centre = Centre(n, [sums[i] + n * SHIFT for i in range(d)])
    v = covariance(fit, centre, d)
    values, vectors = eigen(v)
    some = min(components, d)
    trace = float(np.trace(v))
    live = values[:some] > max(trace, 0.0) * d * np.finfo(np.float64).eps
    project = np.where(live, vectors[:, :some] / np.sqrt(np.where(live, values[:some], 1)), np.nan)
    ready = project[:, live]

    def squares(m: np.ndarray) -> np.ndarray:
        w = centre.centred(m) @ ready
        return w.T @ w

    k = int(live.sum())
    found = _summed(fit, squares, d, "double") if k else {}
    error = float(np.abs(np.array([found[i] for i in range(k * k)]).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0
    explained = values[:some] / trace if trace > 0 else np.zeros(some)
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                m = matrix_rows(part.column(1), d)
                w = (centre.centred(m) @ project).ravel()
                rows_n, size = len(m), len(m) * some
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(rows_n), some))).cast(arrow_kind), pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), rows_n)), pa.array(np.full(size, n)), pa.array(np.repeat(centre.deviation(m), some)), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, rows_n)), pa.array(np.full(size, error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        vec.tidy()

    return sound.mapInArrow(run, output)
