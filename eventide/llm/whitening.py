"""Whitening of embeddings: components of a distributed covariance, refined to double precision.

Vectors become integers, so that equal ones, counts and sums are exact.  Tasks add up centred
products of the distinct vectors; only matrices of the vectors' dimension reach the driver, never
rows.  There, eigenvectors in single precision are corrected by the Ogita-Aishima iteration,
which takes matrix products alone; eigenvalues too close for it are solved as small problems of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import Scratch, small_batches, table

#: An entry is counted in units of one in so many.
SCALE = 256
#: Components that the query returns.
COMPONENTS = 4
#: Columns of one row of the tables in which tasks hand on their part of a matrix.
WIDTH = 64
#: Corrections of the eigenvectors at most; three or four are usual.
ROUNDS = 30

PRODUCTS = pa.schema([("i", pa.int32()), ("j", pa.int32()), *((f"c{k}", pa.float64()) for k in range(WIDTH))])
SUMS = pa.schema([("i", pa.int32()), ("rows", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])


# ---- eigenvectors ----------------------------------------------------------------------------


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of eigenvalues of which each is within ``apart`` of the next one, in groups of two or more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined_once(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One correction of approximate eigenvectors ``x`` (columns) of the symmetric ``a``, and its largest entry.

    Ogita and Aishima: with R = I - X'X and S = X'AX, the correction is X E, where E takes (S + value
    R) over the difference of two eigenvalues.  Pairs closer than the error of S and R can't be told
    apart that way: they only get orthogonal (R / 2), and their subspace is solved by itself.
    """
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    apart = 2 * (np.linalg.norm(off) + np.linalg.norm(a) * np.linalg.norm(r))
    gaps = values[None, :] - values[:, None]
    far = np.abs(gaps) > apart
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gaps, 1.0), r / 2)
    x = x + x @ e
    for group in _clusters(values, apart):
        x[:, group] = _subspace(a, x[:, group])
    return x, float(np.max(np.abs(e), initial=0.0))


def _subspace(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Eigenvectors within the span of ``y``: of the small matrix, less its mean eigenvalue, so that near values keep their digits."""
    q, _ = np.linalg.qr(y)
    middle = np.trace(q.T @ (a @ q)) / q.shape[1]
    small = q.T @ (a @ q - middle * q)
    _, turn = np.linalg.eigh((small + small.T) / 2)
    return q @ turn


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix of doubles.

    The start is in single precision; corrections in double precision go on until they are as small as rounding
    or no longer get smaller.
    """
    size = float(np.max(np.abs(a), initial=0.0))
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    _, start = np.linalg.eigh(a.astype(np.float32))
    x, last, best, kept = start.astype(np.float64), np.inf, np.inf, None
    for _ in range(ROUNDS):
        x, last = refined_once(a, x)
        error = float(np.max(np.abs(a @ x - x * np.sum(x * (a @ x), axis=0) / np.sum(x * x, axis=0)))) + float(np.max(np.abs(x.T @ x - np.eye(len(a)))))
        if kept is not None and error >= best / 2:
            kept = x if error < best else kept
            break
        best, kept = error, x
    x = kept / np.linalg.norm(kept, axis=0)
    values = np.sum(x * (a @ x), axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


# ---- rows ------------------------------------------------------------------------------------


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): entries times SCALE, rounded down, of the vectors without null or non-finite entries.

    An entry beyond the range of long is taken as its end.  Vectors of another dimension than most rows have (of
    equally frequent ones, than the largest), and empty ones, can't be in one covariance and are left out.
    """
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & good & (F.size("embedding") > 0))
    dims = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    floor = F.transform("embedding", lambda c: F.floor(c.cast("double") * float(SCALE)).cast("long"))
    return rows.where(F.size("embedding") == (dims[0]["d"] if dims else 0)).select("vec_id", floor.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension, exact: tasks add the high and the low halves apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), d)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([len(x)] * d), pa.array((x >> 32).sum(0)), pa.array((x & 0xFFFFFFFF).sum(0))], schema=SUMS)

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = small_batches(fit).select("x").mapInArrow(run, from_arrow_schema(SUMS)).groupBy("i").agg(F.sum("rows").alias("rows"), whole("high"), whole("low")).collect()
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return rows[0]["rows"] if rows else 0, [sums.get(i, 0) for i in range(d)]


def covariance(vectors: DataFrame, column: str, d: int, n: int, values: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum of products of centred rows over n; ``values`` makes a batch's column into centred rows of doubles.

    A task gives its matrix in rows of WIDTH columns, which Spark adds up by place.
    """
    width = -(-d // WIDTH) * WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = values(batch.column(0))
            total += x.T @ x
        for j in range(0, width, WIDTH):
            part = np.zeros((d, WIDTH))
            part[:, : min(WIDTH, d - j)] = total[:, j : j + WIDTH]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, j), pa.int32()), *(pa.array(part[:, k]) for k in range(WIDTH))], schema=PRODUCTS)

    parts = small_batches(vectors).select(column).mapInArrow(run, from_arrow_schema(PRODUCTS))
    rows = parts.groupBy("i", "j").agg(*(F.sum(f"c{k}").alias(f"c{k}") for k in range(WIDTH))).toArrow()
    out = np.zeros((d, width))
    i, j = (rows.column(c).to_numpy() for c in ("i", "j"))
    for k in range(WIDTH):
        out[i, j + k] = rows.column(f"c{k}").to_numpy()
    return out[:, :d] / max(n, 1)


class Whitening:
    """What is fitted: the exact count and sums, the components with their values, and the covariance's trace."""

    def __init__(self, n: int, sums: list[int], cov: np.ndarray, components: int):
        values, vectors = eigenvectors(cov)
        self.n, self.sums, self.trace = n, sums, float(np.trace(cov))
        #: A value that is nothing but rounding has no direction of its own.
        least = len(cov) * np.finfo(float).eps * max(float(values[0]) if len(values) else 0.0, 0.0)
        self.values = [float(e) if e > least else 0.0 for e in values[:components]]
        self.mean = np.array([s / n for s in sums]) if n else np.zeros(len(sums))
        self.axes = np.stack([vectors[:, k] / np.sqrt(e) if e else np.zeros(len(cov)) for k, e in enumerate(self.values)], axis=1) if len(cov) else np.zeros((0, 0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; null if it is beyond long."""
        top = max([abs(s) for s in self.sums] + [0])
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if len(self.sums) * (self.n * largest + top) ** 2 < 1 << 63:
            return (((self.n * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(1)).tolist()
        exact = (sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x)
        return [v if v < 1 << 63 else None for v in exact]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float]:
    """The model of the distinct vectors (column x), and the largest entry by which the whitened ones' covariance differs from the identity."""
    scratch = Scratch()
    fit = scratch.written(vectors.select("x").distinct(), "whitening")
    one = fit.select(F.size("x").alias("d")).head(1)
    d = one[0]["d"] if one else 0
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums]) if n else np.zeros(d)
    model = Whitening(n, sums, covariance(fit, "x", d, n, lambda c: _matrix(c, d) - mean), components)
    k = len(model.values)
    found = [i for i, e in enumerate(model.values) if e]
    white = covariance(fit, "x", k, n, lambda c: model.whitened(_matrix(c, d))) if k else np.zeros((0, 0))
    error = float(np.max(np.abs(white[np.ix_(found, found)] - np.eye(len(found))), initial=0.0))
    scratch.drop()
    return model, error


SCORES = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each valid vector and component.

    Vectors that are null, or hold null or non-finite entries, have no rows, nor have those that
    ``integer_vectors`` leaves out.  A repeated vector counts once in the fit and has rows of its own;
    a null vec_id stays null.  Vectors of fewer dimensions have as many components.  A component without
    variance has a null ``whitened`` and 0 ``explained`` (null if nothing varies).  An empty table gives no rows;
    columns besides vec_id and embedding are not read.
    """
    rows = integer_vectors(embeddings)
    model, error = fit_whitening(rows, components)
    k, d = len(model.values), len(model.sums)
    explained = [e / model.trace if model.trace else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (k and len(batch)):
                continue
            x = _matrix(batch.column(1), d)
            white, ids = model.whitened(x), batch.column(0).to_pylist()
            each = [v if model.values[i % k] else None for i, v in enumerate(white.reshape(-1).tolist())]
            out = [[v for v in ids for _ in range(k)], list(range(1, k + 1)) * len(x), [model.n] * (k * len(x)), [v for v in model.deviations(x) for _ in range(k)], each, explained * len(x), [error] * (k * len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SCORES)], schema=SCORES)

    return small_batches(rows).mapInArrow(run, from_arrow_schema(SCORES))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
