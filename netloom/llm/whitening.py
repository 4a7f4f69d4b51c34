"""Embedding whitening with eigenvectors refined from single to double precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import free_name, written

SCALE = 256
COMPONENTS = 4
ROUNDS = 30  # refinements; a handful is needed, since each squares the error
_WIDE = np.longdouble  # the precision of the last refinement
_LOW = np.int64(0xFFFFFFFF)


# --- eigenvectors


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of neighbouring eigenvalues that lie within `gap` of each other, groups of two and more."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def _refinement(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One Ogita-Aishima step in the precision of `a`: better vectors, and the error of those given.

    The correction of a pair of columns divides by the gap of their values. Where
    the gap is within the present uncertainty the columns are only made orthogonal,
    and the small problem inside their common space is solved by itself, shifted
    to the middle of the cluster so that its gaps count fully.
    """
    eye = np.eye(len(a), dtype=a.dtype)
    lack = eye - x.T @ x
    image = x.T @ a @ x
    values = np.diag(image) / (1 - np.diag(lack))
    narrow = lambda m: np.linalg.norm(m.astype(np.float64), 2)
    off = narrow(image - np.diag(values))
    scale = narrow(np.diag(values))
    unsure = 2 * (off + scale * narrow(lack))
    gaps = values[None, :] - values[:, None]
    far = np.abs(gaps) > unsure
    step = np.where(far, (image + values[None, :] * lack) / np.where(far, gaps, 1), lack / 2)
    x = x + x @ step
    for part in _clusters(values, unsure):
        own = x[:, part]
        own = own + own @ (np.eye(len(part), dtype=a.dtype) - own.T @ own) / 2
        middle = values[part].mean()
        inner = own.T @ (a @ own - middle * own)
        x[:, part] = own @ np.linalg.eigh((inner + inner.T).astype(np.float64) / 2)[1].astype(a.dtype)
    return x, narrow(lack) + (off / scale if scale else 0.0)


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Single precision gives the start; matrix products in double precision square
    its error each round until rounding stops them, and the same rounds in a wider
    type remove the rounding.
    """
    trace = float(np.trace(a))
    unit = a / trace
    x = np.linalg.eigh(unit.astype(np.float32))[1]
    for kind in (np.float64, _WIDE):
        at, x, before, last = unit.astype(kind), x.astype(kind), None, np.inf
        for _ in range(ROUNDS):
            better, error = _refinement(at, x)
            if error > last / 2:
                x = x if error < last else before
                break
            before, x, last = x, better, error
    wide, eye = unit.astype(_WIDE), np.eye(len(a), dtype=_WIDE)
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = ((wide @ x) * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * trace).astype(np.float64), x[:, order].astype(np.float64)


# --- distributed sums


def scaled(column: str, scale: int = SCALE) -> Column:
    """floor(scale * c) of every entry as long; past the longs the nearest long."""
    return F.transform(F.col(column), lambda c: F.floor(c.cast("double") * scale))


def usable(column: str) -> Column:
    """The vector is there and all its entries are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return F.coalesce(F.forall(F.col(column), finite), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(fit: DataFrame, width: int, cells: int, start, add) -> np.ndarray:
    """Sum over all fit vectors of what `add` makes of a batch: `cells` numbers.

    A task sends one row per cell; Spark adds the cells, so neither the driver
    nor a task holds more than one set of them, however many tasks there are.
    """
    kind = "bigint" if start.dtype == np.int64 else "double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start.copy()
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                total += add(_matrix(batch.column(0), width))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "part"])

    parts = fit.mapInArrow(partial, f"cell bigint, part {kind}")
    rows = parts.groupBy("cell").agg(F.sum("part").alias("part")).toArrow()
    out = np.zeros(cells, start.dtype)
    out[rows["cell"].to_numpy()] = rows["part"].to_numpy()
    return out


@dataclass(frozen=True)
class Whitening:
    """A fitted transform: `n` distinct vectors, their sums, and the leading components."""

    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    scale: int

    @property
    def width(self) -> int:
        return len(self.sums)


def _empty(scale: int) -> Whitening:
    nothing = np.zeros(0)
    return Whitening(0, [], nothing, np.zeros((0, 0)), nothing, nothing, 0.0, scale)


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """Fit on every distinct scaled vector once.

    Vectors that are null or hold null or non-finite entries are left out. The
    dimension is the length that most vectors have (of equally common ones the
    greatest); other lengths are left out too. Components whose share of the
    variance is below rounding do not exist, so a table without rows, or of one
    vector, has none. The driver holds the covariance, dimension squared.
    """
    name = "x"
    vectors = df.where(usable(column)).select(scaled(column, scale).alias(name)).distinct()
    vectors = written(vectors, "white-fit")
    common = (
        vectors.groupBy(F.size(name).alias("width")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    )
    if not common or not common[0]["width"]:
        return _empty(scale)
    width, n = common[0]["width"], common[0]["n"]
    vectors = vectors.where(F.size(name) == width)

    # High and low halves add up apart, so that the sums are exact.
    def halves(x: np.ndarray) -> np.ndarray:
        return np.concatenate(((x >> 32).sum(axis=0), (x & _LOW).sum(axis=0)))

    both = _summed(vectors, width, 2 * width, np.zeros(2 * width, np.int64), halves)
    sums = [(int(h) << 32) + int(low) for h, low in zip(both[:width], both[width:])]
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> np.ndarray:
        y = x - mean
        return (y.T @ y).ravel()

    covariance = _summed(vectors, width, width * width, np.zeros(width * width), products).reshape(width, width) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    if not trace > 0:
        return _empty(scale)
    values, basis = eigenvectors(covariance)
    count = int((values[:components] > width * np.finfo(np.float64).eps * trace).sum())
    values, basis = values[:count], basis[:, :count]
    turn = basis / np.sqrt(values)

    def whitened(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ turn
        return (z.T @ z).ravel()

    seen = _summed(vectors, width, count * count, np.zeros(count * count), whitened).reshape(count, count) / n
    error = float(np.abs(seen - np.eye(count)).max())
    return Whitening(n, sums, mean, basis, values, values / trace, error, scale)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum)^2 for each row, exact; null past the longs."""
    bound = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(s) for s in sums) if len(x) else 0
    if bound * bound * len(sums) < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = x.astype(object) * n - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def transform(df: DataFrame, model: Whitening, column: str = "embedding", into: str = "white") -> DataFrame:
    """Add the struct `into` (whitened: array of one number per component, deviation).

    It is null for vectors that `fit` leaves out. All other columns and rows stay.
    """
    turn = model.vectors / np.sqrt(model.values) if len(model.values) else np.zeros((model.width, 0))

    @F.arrow_udf("struct<whitened: array<double>, deviation: bigint>")
    def project(vectors: pa.Array) -> pa.Array:
        good = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        x = _matrix(vectors.drop_null(), model.width)
        z = (x - model.mean) @ turn
        sizes = np.zeros(len(vectors), np.int64)
        sizes[good] = turn.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(z.ravel()))
        apart: list[int | None] = [None] * len(vectors)
        for row, value in zip(good.tolist(), deviations(x, model.n, model.sums)):
            apart[row] = value
        lost = np.ones(len(vectors), bool)
        lost[good] = False
        return pa.StructArray.from_arrays(
            [lists, pa.array(apart, pa.int64())], names=["whitened", "deviation"], mask=pa.array(lost)
        )

    fits = usable(column) & (F.size(column) == model.width)
    if not model.n:
        return df.withColumn(into, F.lit(None).cast("struct<whitened: array<double>, deviation: bigint>"))
    return df.withColumn(into, project(F.when(fits, scaled(column, model.scale))))


def whitening_report(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector `fit` leaves out have no row here; repeated rows and null
    keys each have their own. Without any component there are no rows.
    """
    model = fit(df, column, components)
    into = free_name(df, "white")
    done = transform(df.select(key, column), model, column, into).where(F.col(into).isNotNull())
    each = done.select(key, F.col(f"{into}.deviation").alias("deviation"), F.posexplode(f"{into}.whitened").alias("k", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    return each.select(
        key, (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
