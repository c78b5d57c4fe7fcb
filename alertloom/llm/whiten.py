"""Whitening components of embeddings by shifted Cholesky QR passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.session import stored

#: Entries become floor(64 * c) + 1000000, held between these bounds before the addition.
SCALE, ORIGIN, BOUND = 64, 1_000_000, 2**60
#: Factors at most; two are enough unless columns nearly depend on each other.
FACTORS = 6
_EPS = float(np.finfo(np.float64).eps)
#: Entries of the stretch of a batch that is worked on at a time.
_BLOCK = 1 << 16


def grid_entries(vector: Column) -> Column:
    """Each entry c as the long floor(64 * c) + 1000000; what a long can't hold stays at ``BOUND``."""
    def entry(c: Column) -> Column:
        scaled = c.cast("double") * SCALE
        return F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), scaled))).cast("long") + F.lit(ORIGIN)

    return F.transform(vector, entry)


def usable(vector: Column) -> Column:
    """The vector is there and all its entries are finite numbers."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))


def _blocks(batch: pa.RecordBatch, column: int, d: int) -> Iterator[np.ndarray]:
    """Matrices of stretches of a batch's vectors."""
    step = max(1, _BLOCK // d)
    for at in range(0, batch.num_rows, step):
        part = batch.column(column).slice(at, step)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def centred_exactly(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: longs where they fit, else Python's own."""
    x, rest = x - ORIGIN, [s - n * ORIGIN for s in sums]
    most = max(int(np.abs(x).max(initial=0)), *(abs(s) // n + 1 for s in rest))
    if 2 * most * n < 2**62:
        return n * x - np.array(rest, np.int64)
    return n * x.astype(object) - np.array(rest, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in doubles, from the exact difference."""
    return (centred_exactly(x, n, sums) / n).astype(np.float64)


def solved(columns: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Rows times the inverse of an upper triangular factor, by substitution; a line of the array is a column."""
    out = np.empty_like(columns)
    for j in range(len(factor)):
        out[j] = (columns[j] - factor[:j, j] @ out[:j]) / factor[j, j]
    return out


def _gram(fit: DataFrame, n: int, sums: list[int], factors: list[np.ndarray], ends: np.ndarray | None = None) -> np.ndarray:
    """The Gram matrix of the centred rows after the solves by ``factors`` (or of their product with ``ends``).

    A task gives the lines of its matrix's upper triangle; Spark adds them up, and d * d / 2 numbers reach the driver.
    """
    d = len(sums)

    def partial(batches):
        total = None
        for batch in batches:
            for x in _blocks(batch, 0, d):
                columns = np.ascontiguousarray(centred(x, n, sums).T)
                for factor in factors:
                    columns = solved(columns, factor)
                if ends is not None:
                    columns = ends.T @ columns
                own = columns @ columns.T
                total = own if total is None else total + own
        if total is not None:
            size = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array([total[i, i:] for i in range(size)], pa.list_(pa.float64()))], ["i", "line"])

    lines = fit.select("x").mapInArrow(partial, "i long, line array<double>")
    size = d if ends is None else ends.shape[1]
    gram = np.zeros((size, size))
    for r in lines.select("i", F.posexplode("line").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        gram[r.i, r.i + r.j] = gram[r.i + r.j, r.i] = r.v
    return gram


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension."""
    def partial(batches):
        count, total = 0, np.zeros(d, object)
        for batch in batches:
            for x in _blocks(batch, 0, d):
                safe = len(x) * int(np.abs(x).max(initial=0)) < 2**62
                count, total = count + len(x), total + (x if safe else x.astype(object)).sum(axis=0).astype(object)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1)), pa.array([str(v) for v in [*total, count]])], ["j", "v"])

    parts = fit.select("x").mapInArrow(partial, "j long, v string")
    found = {r.j: int(r.v) for r in parts.groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return found.get(d, 0), [found.get(j, 0) for j in range(d)]


def shifted_cholesky(gram: np.ndarray, n: int) -> np.ndarray:
    """Upper triangular R with R'R = gram, or gram plus a small multiple of the identity where it is
    nearly singular: the shift of shifted CholeskyQR, raised until the factorisation succeeds."""
    d, values = len(gram), np.linalg.eigvalsh(gram)
    shift = 0.0
    if values[0] < 1e-3 * values[-1]:
        shift = min(11 * (n * d + d * (d + 1)) * _EPS / 2, 1e-3) * values[-1]
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, d * _EPS * values[-1])


def one_sided_svd(r: np.ndarray, sweeps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, by Jacobi rotations of the columns.

    Small values and their vectors come out to their own precision also beside columns of another
    scale. Each round rotates disjoint pairs at once, every pair once a sweep.
    """
    d = r.shape[1]
    size = d + d % 2
    left, right = np.zeros((r.shape[0], size)), np.eye(size)
    left[:, :d] = r
    places = np.arange(size)
    for _ in range(sweeps):
        largest = 0.0
        for _ in range(size - 1):
            i, j = places[:size // 2], places[size // 2:][::-1]
            a, b, c = (left[:, i]**2).sum(axis=0), (left[:, j]**2).sum(axis=0), (left[:, i] * left[:, j]).sum(axis=0)
            scale = np.sqrt(a) * np.sqrt(b)
            turn = np.abs(c) > _EPS * scale
            largest = max(largest, float(np.max(np.abs(c[turn]) / np.maximum(scale[turn], np.finfo(float).tiny), initial=0.0)))
            zeta = np.where(turn, b - a, 0.0) / np.where(turn, 2 * c, 1.0)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            for m in (left, right):
                m[:, i], m[:, j] = cos * m[:, i] - sin * m[:, j], sin * m[:, i] + cos * m[:, j]
            places = np.concatenate([places[:1], places[-1:], places[1:-1]])
        if largest < d * _EPS:
            break
    values = np.sqrt((left**2).sum(axis=0))[:d]
    order = np.argsort(-values, kind="stable")
    return values[order], right[:d, order]


class Whitening:
    """What was fitted: rows ``n``, ``sums``, unit eigenvectors as columns, eigenvalues, their shares of the trace, and
    the largest entry by which the whitened rows' covariance misses the identity."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, values: np.ndarray, shares: np.ndarray):
        self.n, self.sums, self.vectors, self.values, self.shares = n, sums, vectors, values, shares
        self.error = 0.0

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of the squares of n * x - S; null where a long can't hold one."""
        exact = centred_exactly(x, self.n, self.sums)
        most = max(abs(int(exact.max(initial=0))), abs(int(exact.min(initial=0))))
        if exact.dtype == np.int64 and x.shape[1] * most * most < 2**63:
            return (exact * exact).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in (exact.astype(object)**2).sum(axis=1).tolist()]


def fit_whitening(fit: DataFrame, d: int, components: int = 16) -> Whitening | None:
    """The first components of the vectors ``x``, of ``d`` entries each, of a stored table; None if they do not vary.

    Passes over the rows make the Gram matrix of what the triangular solves by all factors so far leave
    of the centred rows; its Cholesky factor, shifted while it is nearly singular, is the next. The
    first one takes the columns' lengths in, so that columns of any scale are alike. The last Gram
    matrix is near the identity and is put into the product R of the factors, whose singular values and right
    vectors are those of the centred rows: eigenvalues are their squares over n. Directions in which the
    scaled rows vanish to rounding are none. On the driver: matrices of d * d only.
    """
    n, sums = _sums(fit, d)
    if not n:
        return None
    gram = _gram(fit, n, sums, [])
    lengths = np.sqrt(np.diag(gram))
    if not lengths.any():
        return None
    lengths[lengths == 0] = 1
    gram = gram / lengths[:, None] / lengths[None, :]
    factors, scaled = [], np.eye(d)
    while len(factors) < FACTORS and np.abs(gram - np.eye(d)).max() > 100 * d * _EPS:
        factor = shifted_cholesky(gram, n)
        scaled = factor @ scaled
        factors.append(factor if factors else factor * lengths)
        gram = _gram(fit, n, sums, factors)
    if not factors:
        factors = [np.diag(lengths)]
    # What the last pass found: rows' = Q sqrt(gram) with orthonormal Q, up to directions that vanish.
    rest, turn = np.linalg.eigh(gram)
    scaled = np.sqrt(np.maximum(rest, 0))[:, None] * turn.T @ scaled
    spread = np.linalg.svd(scaled, compute_uv=False)
    rank = int((spread > 16 * d * _EPS * spread[0]).sum())
    sizes, vectors = one_sided_svd(scaled * lengths)
    count = min(components, rank)
    vectors = vectors[:, :count]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)] < 0, -1.0, 1.0)
    values = sizes**2 / n
    found = Whitening(n, sums, vectors, values[:count], values[:count] / values.sum())
    found.error = float(np.abs(_gram(fit, n, sums, [], found.matrix) / n - np.eye(count)).max())
    return found


def whitened(rows: DataFrame, components: int = 16) -> DataFrame:
    """Whitened coordinates of embeddings, a row for each vector and component.

    ``rows``: ``vec_id``, ``embedding`` (an array of numbers) and any other columns, which are not read. Rows whose vector is
    null, empty, or holds null or non-finite entries are left out, as are vectors of another length than most
    have (of equally frequent lengths the longest counts). An entry c becomes x = floor(64 * c) + 1000000, held
    within 2 ** 60. Components are fitted to each distinct vector x once: copies, however many, weigh as one.

    Returns ``vec_id`` (which may be null or repeat), ``component`` from 1, ``n`` (distinct vectors), ``deviation`` (sum over
    dimensions of (n * x - S) ** 2, exact; null where it exceeds a long), ``whitened`` (x - S / n on the component, over
    the root of its eigenvalue), ``explained`` (share of the trace), ``identity_error``. There are as many components as
    directions of positive variance, ``components`` at most; none, and no rows, where all vectors are equal.
    """
    spark = rows.sparkSession
    vector = F.col("embedding")
    good = rows.where(usable(vector) & (F.size(vector) > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), grid_entries(vector).alias("x"))
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    good = good.where(F.size("x") == d)
    fit = stored(good.select("x").distinct())
    model = fit_whitening(fit, d, components)
    if model is None:
        return spark.createDataFrame([], schema)

    def scored(batches):
        k = len(model.values)
        for batch in batches:
            at = 0
            for x in _blocks(batch, 1, d):
                m, ids = len(x), batch.column(0).slice(at, len(x))
                at += m
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.shares, m)), pa.array(np.full(m * k, model.error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.select("vec_id", "x").mapInArrow(scored, schema)
