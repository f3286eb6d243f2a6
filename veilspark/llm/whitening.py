"""Whitening of embeddings by eigenvectors of their covariance, refined in mixed precision.

Entries become whole numbers first, so sums are exact and every task that runs again gives the
same ones. Tasks centre their vectors and multiply; Spark adds the products up, and the driver
gets one number for each pair of dimensions, however many vectors there are. Eigenvectors of that
matrix are worked out in 32 bits and then corrected by the iteration of Ogita and Aishima, which
needs only matrix products, in higher precision. Eigenvalues too close for it to tell apart
form a cluster; each cluster is a small problem of its own, shifted to its middle, and solved alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: whole numbers of an entry: floor(SCALE * entry) + OFFSET
SCALE, OFFSET = 64, 1_000_000
#: entries from here on can't be told apart as whole numbers and count as not finite
LARGEST = float(1 << 40)
#: vectors worked on at once
AT_ONCE = 2048
#: a component with less than this share of the largest variance has none
NO_VARIANCE = 1e-12
#: corrections at most; each doubles the right digits, so three or four are usual
ROUNDS = 12
#: clusters inside clusters
DEPTH = 4
HIGHER = np.longdouble


class Model(NamedTuple):
    """Mean and axes of the fitted vectors; ``axes`` holds a component per column, ``variances`` fall."""
    n: int
    sums: list[int]
    variances: np.ndarray
    axes: np.ndarray
    total: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.total) for v in self.variances]


# -- eigenvectors

def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Runs of sorted values of which neighbours are no more than ``apart`` from each other."""
    order = np.argsort(-values, kind="stable")
    breaks = np.flatnonzero(-np.diff(values[order]) > apart) + 1
    return [c for c in np.split(order, breaks) if len(c) > 1]


def _correct(a: np.ndarray, x: np.ndarray, size: float, equal: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step of the iteration: eigenvalues, better vectors, the largest correction, and what is too close to tell apart."""
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64)))
    off = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(off))
    noise = max(equal, 2 * (norm(s - np.diag(np.diag(s))) + size * norm(off)))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= noise  # these are only made orthogonal
    step = np.where(close, off / 2, (s + off * values[None, :]) / np.where(close, 1, gap))
    return values, x + x @ step, float(np.abs(step).max(initial=0)), noise


def refine(matrix: np.ndarray, vectors: np.ndarray, higher=HIGHER, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix from approximate ones, in precision ``higher``.

    Vectors of a cluster come out as some basis of what the cluster spans; then the matrix, less the cluster's mean
    value, is restricted to that basis. There only the differences are left, so the small problem has a precision of its own.
    """
    a, x = matrix.astype(higher), vectors.astype(higher)
    n, size, eps = len(a), float(np.linalg.norm(matrix.astype(np.float64))), float(np.finfo(higher).eps)
    equal = n * size * eps ** 0.6

    def settle(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        before = np.inf
        for _ in range(ROUNDS):
            values, x, moved, noise = _correct(a, x, size, equal)
            if moved <= n * eps or moved >= before / 2 and moved < 1e-6:
                break
            before = moved
        # what rounding did to vectors of nearby values
        return values, x + x @ (np.eye(n, dtype=higher) - x.T @ x) / 2, noise

    values, x, noise = settle(x)
    clusters = _clusters(values, noise) if depth < DEPTH else []
    for c in clusters:
        basis, middle = x[:, c], values[c].mean()
        part = basis.T @ (a @ basis - middle * basis)
        part = (part + part.T) / 2
        if float(np.abs(part).max()) > n * eps * size:  # else they are equal, and any basis will do
            x[:, c] = basis @ refine(part, np.linalg.eigh(part.astype(np.float64))[1], higher, depth + 1)[1]
    if clusters:
        values, x, _ = settle(x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(matrix: np.ndarray, higher=HIGHER) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(matrix).max()) or 1.0  # keeps 32 bits from overflowing
    rough = np.linalg.eigh((matrix / scale).astype(np.float32))[1]
    values, vectors = refine(matrix, rough, higher)
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(matrix))])
    return values.astype(np.float64), (vectors * np.where(signs == 0, 1, signs)).astype(np.float64)


# -- vectors of a table

def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): rows whose vector has entries, all of them finite."""
    return (vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & (F.size("v") > 0))
            .where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and whole-number vectors, some rows of one length at a time."""
    for batch in batches:
        lengths = np.diff(batch.column("v").offsets.to_numpy())
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            for some in np.split(at, range(AT_ONCE, len(at), AT_ONCE)):
                part = batch.take(pa.array(some))
                entries = part.column("v").flatten().to_numpy(zero_copy_only=False)
                yield part.column("key"), np.floor(entries * SCALE).astype(np.int64).reshape(-1, d) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[int]] = {}  # the number of vectors, then their sums
    for _, x in _whole(batches):
        mine = found.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
        for i, s in enumerate([len(x), *x.sum(axis=0).tolist()]):
            mine[i] += s
    for d, sums in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(sums), pa.int32()), pa.array(range(-1, d), pa.int32()),
                                          pa.array(map(str, sums), pa.string())], ["d", "i", "s"])


class _Centre:
    """Exact whole-number vectors to centred ones: the whole part of the mean goes first, the fraction after."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for keys, x in _whole(batches):
            if x.shape[1] == self.d:
                y = x - self.whole
                yield keys, y, y - self.fraction

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) squared, exact; None where a long can't hold one."""
        largest = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if self.d * largest * largest < 1 << 63:
            away = self.n * y - np.array(self.rest, np.int64)
            return (away * away).sum(axis=1).tolist()
        away = self.n * y.astype(object) - np.array(self.rest, object)
        return [s if s < 1 << 63 else None for s in (away * away).sum(axis=1)]


def _products(centre: _Centre, axes: np.ndarray | None = None):
    """Sums of products of centred vectors, or of their components: a row for each pair i <= j and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centre.d if axes is None else axes.shape[1]
        total = np.zeros((width, width))
        for _, _, z in centre(batches):
            z = z if axes is None else z @ axes
            total += z.T @ z
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "s"])
    return run


def _covariance(good: DataFrame, centre: _Centre, axes: np.ndarray | None = None) -> np.ndarray:
    """The matrix, one number for each pair of dimensions; Spark has summed them over all tasks."""
    width = centre.d if axes is None else axes.shape[1]
    summed = good.mapInArrow(_products(centre, axes), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((width, width))
    out[summed["i"], summed["j"]] = out[summed["j"], summed["i"]] = summed["s"] / centre.n
    return out


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
        higher=HIGHER) -> Model | None:
    """Mean and axes of all usable vectors of the commonest length (of equally common ones the longest); None without any.

    Two readings: exact sums, then products of centred vectors. ``higher`` is the precision of the correction;
    its matrix products aren't those of a fast library, so for thousands of dimensions float64 may be wanted.
    """
    good = usable(vectors, key, vector)
    per_length = (good.select("v").withColumn("key", F.lit(0)).mapInArrow(_sums, "d int, i int, s string").groupBy("d", "i")
                  .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("i").alias("last")))
    most = per_length.where("i = -1").orderBy(F.desc("s"), F.desc("d")).first()
    if most is None:
        return None
    sums = [int(r["s"]) for r in per_length.where((F.col("d") == most["d"]) & (F.col("i") >= 0)).orderBy("i").collect()]
    n = int(most["s"])
    matrix = _covariance(good, _Centre(n, sums))
    values, axes = eigen(matrix, higher)
    kept = np.flatnonzero(values > max(NO_VARIANCE * values[0], 0))[:components]
    return Model(n, sums, values[kept], axes[:, kept], float(np.trace(matrix)))


def apply(model: Model, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, deviation, whitened): of usable vectors of the model's length, the components over the root of their variance."""
    centre, scaled = _Centre(model.n, model.sums), model.axes / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, y, z in centre(batches):
            w = z @ scaled
            ends = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([keys, pa.array(centre.deviations(y), pa.int64()),
                                              pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], [key, "deviation", "whitened"])
    kind = vectors.schema[key].dataType.simpleString()
    return usable(vectors, key, vector).mapInArrow(run, f"`{key}` {kind}, deviation bigint, whitened array<double>")


def identity_error(model: Model, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> float:
    """How far the covariance of the whitened vectors is from the identity, as its largest absolute difference."""
    scaled = model.axes / np.sqrt(model.variances)
    found = _covariance(usable(vectors, key, vector), _Centre(model.n, model.sums), scaled)
    return float(np.abs(found - np.eye(len(found))).max(initial=0.0))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    A vector that is NULL, empty, or holds NULL, NaN, an infinity or an entry of 2^40 or more has no rows and takes no
    part in the fit, nor has one of another length than most. Repeated rows count and come out as often as they occur; a NULL key stays
    NULL; other columns are not read. Components without variance are left out, so vectors that
    are all equal, a single vector and an empty table give no rows. ``deviation`` is NULL where a long can't hold it.
    """
    model = fit(vectors, key, vector, components)
    kind = vectors.schema[key].dataType.simpleString()
    names = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], names)
    error = identity_error(model, vectors, key, vector)
    return (apply(model, vectors, key, vector)
            .select(F.col(f"`{key}`"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(F.col(f"`{key}`"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.get(F.array(*map(F.lit, model.explained)), F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
