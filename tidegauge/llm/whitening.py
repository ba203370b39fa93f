"""Whitening of embeddings by their leading principal components.

Spark sums the centred products of all different vectors; the covariance has as many rows as a vector has components, so
it is small however many vectors there are. On the driver it is brought to tridiagonal form by Householder reflections,
Sturm counts bisect the leading eigenvalues, inverse iteration gives the components, made orthogonal again within
clusters of close eigenvalues. The components go to all tasks, which project their rows.
"""

from __future__ import annotations

import sys
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidegauge.llm.texts import bound_batches, written
from tidegauge.llm.vectors import ID, X, matrix, whole_vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The contract's fixed values: scale and offset of components, components returned.
FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 16
# Scaled components from this size on are left out: sums of squares of their differences would leave a double's whole numbers.
LIMIT = 1 << 50
# Share of the trace below which an eigenvalue is rounding error: there is no variance to divide by.
LEAST = 1e-10
# Eigenvalues closer than this share of the matrix's size form a cluster.
_CLUSTER = 1e-3
_EPS = float(np.finfo(np.float64).eps)


def tridiagonal(matrix_: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit reflection vectors: H...H A H...H with H = I - 2 v v', v from row k + 1 on."""
    a, d, turns = matrix_.copy(), len(matrix_), []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) <= _EPS * size * 1e-3:
            turns.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        turns.append(v)
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
        inner = a[k + 1:, k + 1:]
        p = 2 * (inner @ v)
        q = p - v * (v @ p)
        inner -= np.outer(v, q) + np.outer(q, v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), turns


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each of the places `at`."""
    tiny = _EPS * max(1e-300, float(np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0)))
    squares = off * off
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        q = diagonal[i] - at - squares[i - 1] / np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The greatest eigenvalues, falling, by bisection of an interval that holds all of them."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    low = np.full(wanted, (diagonal - reach).min())
    high = np.full(wanted, (diagonal + reach).max())
    size = max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0)), 1e-300)
    low, high = low - _EPS * d * size, high + _EPS * d * size
    rank = d - 1 - np.arange(wanted)
    while ((high - low) > _EPS * size / 8).any():
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        left = below(diagonal, off, middle) <= rank
        low, high = np.where(left, middle, low), np.where(left, high, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with row exchange; pivots near zero become `tiny`."""
    d = len(diagonal)
    main, over, far, x = diagonal - shift, np.append(off, 0.0), np.zeros(d), right.copy()
    under = off.copy()
    for i in range(d - 1):
        if abs(under[i]) > abs(main[i]):
            pivot = under[i], main[i + 1], over[i + 1]
            factor = main[i] / pivot[0]
            main[i + 1], over[i + 1] = over[i] - factor * pivot[1], -factor * pivot[2]
            main[i], over[i], far[i] = pivot
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(main[i]) < tiny:
                main[i] = tiny
            factor = under[i] / main[i]
            main[i + 1] -= factor * over[i]
            x[i + 1] -= factor * x[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in range(d - 1, -1, -1):
        rest = x[i]
        if i + 1 < d:
            rest -= over[i] * x[i + 1]
        if i + 2 < d:
            rest -= far[i] * x[i + 2]
        x[i] = rest / main[i]
    return x


def components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors as columns."""
    d = len(covariance)
    wanted = min(wanted, d)
    scale = float(np.abs(covariance).max(initial=0)) or 1.0
    diagonal, off, turns = tridiagonal(covariance / scale)
    values = leading(diagonal, off, wanted)
    size = float(np.abs(diagonal).max(initial=0) + 2 * np.abs(off).max(initial=0)) or 1.0
    rng, vectors, cluster, before = np.random.default_rng(0), np.zeros((d, wanted)), 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > _CLUSTER * size:
            cluster = j
        # Equal eigenvalues get shifts of their own, so that the iterations differ.
        shift = before = min(value, before - 4 * _EPS * size) if j > cluster else value
        x = rng.normal(size=d)
        x /= np.linalg.norm(x)
        for _ in range(6):
            x = _solve(diagonal, off, shift, x, _EPS * size)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[:, cluster:j] @ (vectors[:, cluster:j].T @ x)
            x /= np.linalg.norm(x)
        vectors[:, j] = x
    for k in range(len(turns) - 1, -1, -1):
        v = turns[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * scale, vectors


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each component, exactly."""
    schema = pa.schema([("at", pa.int32()), ("total", pa.decimal128(38, 0))])

    def run(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = matrix(batch.column(0))
                n += len(part)
                own = [int(v) for v in part.sum(axis=0)]
                total = own if total is None else [a + b for a, b in zip(total, own)]
        if n:
            values = [Decimal(v) for v in (n, *total)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()),
                                              pa.array(values, pa.decimal128(38, 0))], schema=schema)

    # A row per component from each task, and as many rows as a vector has components to the driver.
    rows = fit.select(X).mapInArrow(run, from_arrow_schema(schema)).groupBy("at").agg(F.sum("total").alias("total")).collect()
    found = {r["at"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def _products(fit: DataFrame, centre: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Sum over all vectors of the products of centred components, or of the columns that `turn` makes of them."""
    d = len(centre) if turn is None else turn.shape[1]
    schema = pa.schema([("cell", pa.int64()), ("total", pa.float64())])
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                part = matrix(batch.column(0)) - centre
                if turn is not None:
                    part = part @ turn
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * d + upper[1]), pa.array(total[upper])], schema=schema)

    rows = fit.select(X).mapInArrow(run, from_arrow_schema(schema)).groupBy("cell").agg(F.sum("total").alias("total"))
    sums = rows.toArrow()
    cells = sums.column("cell").to_numpy()
    out = np.zeros((d, d))
    out[cells // d, cells % d] = out[cells % d, cells // d] = sums.column("total").to_numpy()
    return out


_RESULT = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
    ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of squares of n x - S; null where one is no long."""
    apart = max(abs(int(x.min()) * n - min(sums)), abs(int(x.max()) * n - max(sums)),
                abs(int(x.max()) * n - min(sums)), abs(int(x.min()) * n - max(sums)))
    if apart * apart * x.shape[1] < 1 << 62 and n * int(np.abs(x).max()) < 1 << 62:
        gaps = x * n - np.array(sums, np.int64)
        return (gaps * gaps).sum(axis=1).tolist()
    found = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """For each remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows without a usable vector are left out (see `whole_vectors`); of the others every row stays, repeated ids and
    vectors as well, and an id may be null. The fit takes each different vector once. A component whose eigenvalue is
    below 1e-10 of the trace has no variance to divide by and is left out: so fewer different vectors than
    components give fewer components, and none (one vector, or an empty table) gives no rows. A deviation that is no long is null.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    whole = whole_vectors(rows, FACTOR, OFFSET, LIMIT, key, vector)
    fit = written(whole.select(X).distinct(), "vectors")
    empty = spark.createDataFrame([], from_arrow_schema(_RESULT))
    n, sums = _sums(fit)
    if not n:
        return empty
    # The offset cancels; whole numbers keep the centre as exact as a double is.
    centre = np.array([s // n for s in sums], np.float64) + np.array([(s % n) / n for s in sums])
    covariance = _products(fit, centre) / n
    values, vectors = components(covariance, wanted)
    trace = float(np.trace(covariance))
    kept = int((values > LEAST * trace).sum()) if trace > 0 else 0
    if not kept:
        return empty
    turn = vectors[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(_products(fit, centre, turn) / n - np.eye(kept)).max())
    explained = values[:kept] / trace

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                m = len(x)
                made = ((x - centre) @ turn).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)),
                    pa.array([v for v in _deviations(x, n, sums) for _ in range(kept)], pa.int64()), pa.array(made),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))], schema=_RESULT)

    return whole.select(ID, X).mapInArrow(project, from_arrow_schema(_RESULT))
