"""Whitening of embeddings; the covariance is diagonalised by QDWH spectral divide and conquer.

The polar factor of a shifted symmetric matrix is its matrix sign: +1 on the invariant subspace of the eigenvalues above
the shift, -1 on that of the others. It is found by the dynamically weighted Halley iteration, which needs only QR and
Cholesky factorisations. Its projector splits the space in two, each part is split again, until single components are left.

Tasks hand on partial sums of their rows (an exact integer sum, then products of centred rows), which are added up in a
tree of bounded fan-in, in a fixed order, so reruns agree to the bit. The driver sees a matrix of d x d numbers, never rows;
the components that are broadcast are d x COMPONENTS numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import quoted, read, small_batches, tree_sum

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that are centred together; integers beyond this are no exact doubles.
ROWS, EXACT = 4096, 1 << 53
EPS = float(np.finfo(float).eps)


# --- the eigenvalue problem, on d x d numbers ---


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without zero eigenvalues: its matrix sign."""
    one = np.eye(len(a))
    x, low = a / np.linalg.norm(a), EPS
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square / square)
        root = np.sqrt(1 + d)
        u = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * root)))
        v = (u - 1) ** 2 / 4
        w = u + v - 1
        low = min(1.0, low * (u + v * square) / (1 + w * square))
        if w > 100:  # ill conditioned: by QR
            q = np.linalg.qr(np.vstack([np.sqrt(w) * x, one]))[0]
            y = v / w * x + (u - v / w) / np.sqrt(w) * q[: len(a)] @ q[len(a) :].T
        else:
            half = np.linalg.inv(np.linalg.cholesky(one + w * x.T @ x))
            y = v / w * x + (u - v / w) * (x @ half.T) @ half
        y = (y + y.T) / 2
        step, x = np.linalg.norm(y - x), y
        if step <= np.cbrt(5 * EPS) and abs(1 - low) < 10 * EPS:
            break
    return x


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """(an orthogonal basis whose first k columns span the eigenvectors of the eigenvalues above a shift, k)."""
    n, diagonal = len(a), np.diag(a)
    chance = np.random.default_rng(n)  # fixed: reruns agree
    # The mean lies strictly between the eigenvalues; the median halves the work. Others help where a shift hits one.
    shifts = [np.median(diagonal), diagonal.mean(), *(diagonal.mean() + np.linalg.norm(a - diagonal.mean() * np.eye(n)) / n * chance.uniform(-0.5, 0.5, 8))]
    best = None
    for shift in shifts:
        try:
            sign = polar(a - shift * np.eye(n))
        except np.linalg.LinAlgError:
            continue
        k = round((n + float(np.trace(sign))) / 2)
        if not 0 < k < n:
            continue
        projector = (sign + np.eye(n)) / 2
        basis = chance.standard_normal((n, k))
        for _ in range(3):
            basis = np.linalg.qr(projector @ basis[:, :k], mode="complete")[0]
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = left, basis, k
        if left <= 8 * n * EPS * scale:
            break
    return None if best is None or best[0] > 1e-10 * scale else best[1:]


def components_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns, the largest entry of each positive) of a symmetric matrix."""
    scale, n = float(np.linalg.norm(v)), len(v)
    vectors, waiting = [], [(v, np.eye(n))]
    while waiting:
        a, basis = waiting.pop()
        apart = np.linalg.norm(a - np.diag(np.diag(a)))
        found = split(a, scale) if len(a) > 1 and apart > EPS * scale else None
        if found is None:  # one component, or a multiple of the identity to double precision
            vectors.append(basis)
            continue
        q, k = found
        for part in (q[:, :k], q[:, k:]):
            inner = part.T @ a @ part
            waiting.append(((inner + inner.T) / 2, basis @ part))
    u = np.linalg.qr(np.hstack(vectors))[0] if vectors else np.empty((0, 0))
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0) if n else u
    values = np.einsum("ij,ij->j", u, v @ u)  # Rayleigh quotients
    order = np.argsort(-values, kind="stable")
    return values[order], u[:, order]


# --- sums over all rows ---


def rows_of(batch: pa.RecordBatch, d: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """(the rows whose vector takes part, without it; their x)."""
    column = batch.column(batch.num_columns - 1)
    batch = batch.filter(pa.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d))
    c = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(SCALE * c) + OFFSET
    fits = (np.abs(x) < EXACT).all(axis=1)  # false for null and for what isn't finite
    return batch.filter(pa.array(fits)).drop_columns(batch.schema.names[-1]), x[fits].astype(np.int64)


def over_rows(frame: DataFrame, d: int, start: Callable[[], tuple[Callable[[np.ndarray], None], Callable[[], dict[int, np.ndarray]]]], kind: T.DataType) -> dict[int, list]:
    """The tree-summed results of all tasks: start() gives (a function that takes up rows, one that gives arrays by number)."""
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("values", T.ArrayType(kind))])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, give = start()
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                x = rows_of(batch.slice(at, ROWS), d)[1]
                if len(x):
                    take(x)
        part, number = TaskContext.get().partitionId(), pa.int64() if isinstance(kind, T.LongType) else pa.float64()
        for i, values in give().items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([i]), pa.array([values], pa.list_(number))], names=schema.names)

    return tree_sum(frame.mapInArrow(work, schema))


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray  # falling
    vectors: np.ndarray  # d x components
    trace: float

    def __post_init__(self):
        self.mean = np.array([s / self.n for s in self.sums])
        able = self.values > len(self.sums) * EPS * self.values[0] if self.trace > 0 else np.zeros(len(self.values), bool)
        self.able = able[: self.vectors.shape[1]]
        self.weights = self.vectors / np.sqrt(np.where(self.able, self.values[: len(self.able)], np.nan))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.weights

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact; None beyond a long."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        off = x.astype(object if largest >> 62 else np.int64) * self.n - np.array(self.sums, dtype=object if largest >> 62 else np.int64)
        if int(abs(off).max(initial=0)) ** 2 * off.shape[1] >> 63:
            off = off.astype(object)
        return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def fit(frame: DataFrame, d: int, components: int) -> Fit | None:
    """frame: one column, vectors. None if no row takes part."""

    def totals():
        state = np.zeros((2, d), np.int64), [0]

        def take(x: np.ndarray) -> None:
            state[0][0] += (x >> 26).sum(axis=0)  # two halves, so that 2^36 rows can't overflow
            state[0][1] += (x & ((1 << 26) - 1)).sum(axis=0)
            state[1][0] += len(x)

        return take, lambda: {0: np.array(state[1]), 1: state[0].ravel()}

    found = over_rows(frame, d, totals, T.LongType())
    if not found or not found[0][0]:
        return None
    n, halves = int(found[0][0]), found[1].tolist()
    sums = [(halves[i] << 26) + halves[d + i] for i in range(d)]
    mean = np.array([s / n for s in sums])

    def products():
        total = np.zeros((d, d))

        def take(x: np.ndarray) -> None:
            off = x - mean
            total[:] += off.T @ off

        return take, lambda: dict(enumerate(total))

    rows = over_rows(frame, d, products, T.DoubleType())
    v = np.array([rows[i] for i in range(d)]) / n
    v = (v + v.T) / 2
    values, vectors = components_of(v)
    return Fit(n, sums, np.maximum(values, 0), vectors[:, :components], float(np.trace(v)))


def identity_error(frame: DataFrame, fitted: Fit) -> float | None:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured on the rows."""
    k, shared = int(fitted.able.sum()), frame.sparkSession.sparkContext.broadcast(fitted)
    if not k:
        return None

    def moments():
        one = shared.value
        total, sums = np.zeros((k, k)), np.zeros(k)

        def take(x: np.ndarray) -> None:
            w = one.whitened(x)[:, :k]
            middle = w.mean(axis=0)
            off = w - middle
            total[:] += off.T @ off + len(w) * np.outer(middle, middle)
            sums[:] += len(w) * middle

        return take, lambda: {**dict(enumerate(total)), k: sums}

    found = over_rows(frame, len(fitted.sums), moments, T.DoubleType())
    middle = np.array(found[k]) / fitted.n  # nearly zero, so nothing cancels
    return float(np.abs(np.array([found[i] for i in range(k)]) / fitted.n - np.outer(middle, middle) - np.eye(k)).max())


RESULTS = T.StructType([T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and component.

    Vectors take part that are not null, hold only finite numbers with |x| under 2^53, and have the most frequent length
    (of several the largest). Equal rows and rows without a key take part each. A component without variance has no
    whitened value (null) and no part in identity_error; without any variance explained is null. A deviation beyond a
    long is null. An empty table gives an empty result. Other columns are ignored.
    """
    spark: SparkSession = vectors.sparkSession
    small_batches(spark)
    element = vectors.schema[vector].dataType.elementType
    entries = F.col(quoted(vector)) if isinstance(element, (T.FloatType, T.DoubleType)) else F.col(quoted(vector)).cast("array<double>")
    source = vectors.select(F.col(quoted(key)), entries.alias("__vector")).filter("size(__vector) > 0")
    length = source.groupBy(F.size("__vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = T.StructType([vectors.schema[key], *RESULTS])
    fitted = None if length is None else fit(source.select("__vector"), length.d, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    error, shared = identity_error(source.select("__vector"), fitted), spark.sparkContext.broadcast(fitted)
    explained = [float(v) / fitted.trace if fitted.trace > 0 else None for v in fitted.values[: len(fitted.able)]]

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        k = len(explained)
        for batch in stream:
            for at in range(0, batch.num_rows, ROWS):
                ids, x = rows_of(batch.slice(at, ROWS), len(one.sums))
                n, white = len(x), one.whitened(x).ravel()
                columns = [
                    ids.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, one.n)),
                    pa.array(one.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array(white, mask=np.isnan(white)), pa.array(explained * n, pa.float64()), pa.array([error] * (n * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(work, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
