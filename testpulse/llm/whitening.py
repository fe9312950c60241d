r"""Embedding whitening: leading eigenvectors of the covariance by block Jacobi-Davidson.

The covariance is never formed.  What the iteration needs is its product with a block of a
few dozen columns, and that is one Spark job: each task centres its rows, multiplies
them with the block and back, and hands on one partial sum a dimension, which Spark adds
up.  Only blocks of (dimensions x columns) numbers reach the driver.

1. *Rayleigh-Ritz*: the block products of an orthonormal search basis give a small
   symmetric matrix; its eigenvectors are the Ritz vectors, falling by value.
2. *Locking*: a leading Ritz pair whose residual, relative to the largest value, is below
   ``TOLERANCE`` is locked; the basis stays orthogonal to it.
3. *Correction*: for the next pairs (``GUARD`` more than are wanted, so that close values do not
   hinder) the projected equations (I - QQ') (V - e) (I - QQ') t = -r, Q being the locked and
   the current Ritz vectors, are solved approximately by MINRES.  All equations advance
   together, so that an inner step is one distributed product.
4. The corrections extend the basis; at ``BASES`` blocks it is started anew with the best
   Ritz vectors.  It ends when all residuals have reached double precision, or when the basis
   spans everything there is, where Rayleigh-Ritz is exact.

Products are of centred rows: an entry c is the long x = floor(64 c) + 1000000, and n x - S is
computed in whole numbers before it is divided by n.

Defined results: rows whose vector is null or empty or holds a null or non-finite entry, or
one whose x is no long, take no part; of vectors of several lengths those of the commonest
(then the greatest) length take part; repeated rows count each and are returned each; a
direction without variance beyond rounding is no component, so equal vectors, a single
vector or an empty table give an empty result; ``deviation`` is null where it is no long.
Columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testpulse.llm.columns import table
from testpulse.session import stage

COMPONENTS = 32
GUARD = 8
#: Blocks of corrections that a search basis holds.
BASES = 4
INNER_STEPS = 10
OUTER_STEPS = 300
#: Residual over largest eigenvalue: a few roundings of sums in double precision.
TOLERANCE = 1e-14
#: Residuals are taken as of double precision, too, if they no longer shrink below this.
ROUNDING = 1e-13
SCALE, SHIFT = 64, 1_000_000
#: Entries whose x would reach this are no longs that sums can be made of.
LARGEST = 2.0**62


@dataclass(frozen=True)
class Fit:
    """Vectors to be whitened with their statistics."""

    vectors: DataFrame  # _id long, x array<long>
    n: int
    sums: list[int]

    @property
    def dims(self) -> int:
        return len(self.sums)


def prepare(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Fit:
    """The whole-number vectors (written once) and their exact sums."""
    entry = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    usable = F.forall(
        F.col(vector_col),
        # false for a null entry, too
        lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False)) & ~F.isnan(c),
    )
    vectors = stage(
        rows.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & usable).select(
            F.col(id_col).cast("long").alias("_id"), entry.alias("x")
        ),
        "whole-vectors",
    )
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return Fit(vectors, 0, [])
    if lengths.count() > 1:
        vectors = vectors.filter(F.size("x") == most["d"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(most["d"], dtype=np.int64), np.zeros(most["d"], dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), most["d"])
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        low_high, low = low >> 32, low & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(most["d"])), pa.array(high + low_high), pa.array(low)], ["dim", "high", "low"]
        )

    halves = (
        vectors.select("x")
        .mapInArrow(add, "dim long, high long, low long")
        .groupBy("dim")
        .agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
        .orderBy("dim")
        .collect()  # a row a dimension
    )
    return Fit(vectors, most["n"], [(r["high"] << 32) + r["low"] for r in halves])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S in whole numbers; Python's own where they do not fit."""
    reach = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums))
    kind = np.int64 if reach < 2**62 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _added(fit: Fit, name: str, rows: int, columns: int, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of ``partial(centred rows)``, a (rows x columns) matrix."""
    n, sums, dims = fit.n, fit.sums, fit.dims

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            if batch.num_rows:
                total += partial(_centred(_matrix(batch.column(0), dims), n, sums))
        line = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), columns).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), line], ["row", name])

    parts = fit.vectors.select("x").mapInArrow(work, f"row long, {name} array<double>")
    whole = parts.groupBy("row").agg(*[F.sum(F.col(name)[i]).alias(f"_{i}") for i in range(columns)]).toArrow()
    order = np.argsort(whole["row"].to_numpy())
    return np.column_stack([whole[f"_{i}"].to_numpy()[order] for i in range(columns)])


def covariance_product(fit: Fit, block: np.ndarray) -> np.ndarray:
    """The covariance times a (dimensions x columns) block, by one job and without the covariance."""
    return _added(fit, "product", fit.dims, block.shape[1], lambda y: y.T @ (y @ block)) / fit.n


def _total_variance(fit: Fit) -> float:
    squares = _added(fit, "squares", 1, fit.dims, lambda y: (y * y).sum(axis=0, keepdims=True))
    return float(squares.sum()) / fit.n


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to the given orthonormal columns."""
    for _ in range(3):
        for basis in against:
            block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 1e-10] / size[size > 1e-10]
        if not block.shape[1]:
            return block
        left, weight, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, weight > 1e-8 * weight[0]]
    return block


def minres(
    product: Callable[[np.ndarray], np.ndarray],
    values: np.ndarray,
    known: np.ndarray,
    right: np.ndarray,
    steps: int,
    enough: float = 1e-2,
) -> np.ndarray:
    """Approximate solutions t of (I - QQ') (V - e) (I - QQ') t = right, a column for each e.

    One recurrence a column (Lanczos vectors, Givens rotations), all advanced by one
    product a step; it ends when every residual has shrunk by ``enough``.
    """

    def projected(block: np.ndarray) -> np.ndarray:
        return block - known @ (known.T @ block)

    vector = projected(right)
    beta = np.linalg.norm(vector, axis=0)
    start = beta.copy()
    vector = vector / np.where(beta > 0, beta, 1)
    before, shape = np.zeros_like(vector), vector.shape
    far, near, solution = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    cosine, sine = (np.ones(shape[1]), np.ones(shape[1])), (np.zeros(shape[1]), np.zeros(shape[1]))
    rest = start.copy()
    last_beta = np.zeros(shape[1])
    for _ in range(steps):
        image = projected(product(vector) - vector * values) - last_beta * before
        alpha = (vector * image).sum(axis=0)
        image = image - alpha * vector
        beta = np.linalg.norm(image, axis=0)
        # The new column of the tridiagonal matrix under the two last rotations.
        third = sine[0] * last_beta
        second = cosine[1] * cosine[0] * last_beta + sine[1] * alpha
        lead = cosine[1] * alpha - sine[1] * cosine[0] * last_beta
        length = np.hypot(lead, beta)
        length = np.where(length > 0, length, 1)
        cosine, sine = (cosine[1], lead / length), (sine[1], beta / length)
        way = (vector - third * far - second * near) / length
        solution += cosine[1] * rest * way
        rest = -sine[1] * rest
        far, near = near, way
        before, vector = vector, image / np.where(beta > 1e-14 * start.max(), beta, np.inf)
        last_beta = beta
        if not (np.abs(rest) > enough * start).any():
            break
    return projected(solution)


def eigenpairs(
    product: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues, falling, and their unit eigenvectors as columns."""
    wanted = min(wanted, dims)
    block = min(dims, wanted + GUARD)
    draw = np.random.default_rng(seed)
    basis = _orthonormal(draw.standard_normal((dims, block)))
    image = product(basis)
    locked, locked_image, locked_values = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros(0)
    last, stalled = np.inf, 0
    for _ in range(OUTER_STEPS):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        top = max([*locked_values[:1], *values[:1], 1e-300])
        residual = image - basis * values
        residual = residual - locked @ (locked.T @ residual)
        open_ = min(wanted - len(locked_values), basis.shape[1])
        size = np.linalg.norm(residual[:, :open_], axis=0) / top
        everything = locked.shape[1] + basis.shape[1] >= dims
        stalled = stalled + 1 if size.max(initial=0) > 0.5 * last else 0
        last = min(last, size.max(initial=0))
        rounded = everything or (stalled >= 3 and size.max(initial=0) <= ROUNDING)
        done = int(np.argmin(np.append(size <= TOLERANCE, False))) if not rounded else open_
        if done:
            locked = np.column_stack([locked, basis[:, :done]])
            locked_image = np.column_stack([locked_image, image[:, :done]])
            locked_values = np.append(locked_values, values[:done])
            basis, image, values, residual = basis[:, done:], image[:, done:], values[done:], residual[:, done:]
            last, stalled = np.inf, 0
        if len(locked_values) >= wanted:
            break
        ahead = min(block - done, wanted - len(locked_values) + GUARD, basis.shape[1])
        near = basis[:, :ahead]
        known = np.column_stack([locked, near])
        step = minres(product, values[:ahead], known, -residual[:, :ahead], INNER_STEPS)
        if basis.shape[1] + ahead > BASES * block:  # start anew with the best
            basis = _orthonormal(basis[:, : 2 * ahead], locked)
            image = product(basis)  # anew, as turns add up their rounding
        fresh = _orthonormal(step, locked, basis)
        if not fresh.shape[1]:  # nothing new: look in another direction
            fresh = _orthonormal(draw.standard_normal((dims, ahead)), locked, basis)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
    else:
        raise RuntimeError(f"{len(locked_values)} of {wanted} eigenpairs after {OUTER_STEPS} steps")
    # Pairs are locked in falling order but for rounding; a last turn among them sorts them.
    small = locked.T @ locked_image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return values[::-1], locked @ turn[:, ::-1]


def whiten(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(_id, n, deviation, whitened: array of a value a component, explained: array,
    identity_error) of every row that takes part."""
    fit = prepare(rows, id_col, vector_col)
    schema = "_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    spark = rows.sparkSession
    total = _total_variance(fit) if fit.n else 0.0
    if not total > 0:
        return spark.createDataFrame([], schema)
    values, vectors = eigenpairs(lambda block: covariance_product(fit, block), fit.dims, components)
    real = values > values[0] * fit.dims * 1e-14
    values, vectors = values[real], vectors[:, real]
    maps = vectors / np.sqrt(values)
    width = len(values)

    def moments(y: np.ndarray) -> np.ndarray:
        z = y @ maps
        return np.vstack([z.T @ z, z.sum(axis=0, keepdims=True)])

    sums = _added(fit, "moments", width + 1, width, moments) / fit.n
    covariance = sums[:-1] - np.outer(sums[-1], sums[-1])
    error = float(np.abs(covariance - np.eye(width)).max())
    explained = (values / total).tolist()
    n, all_sums, dims = fit.n, fit.sums, fit.dims

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _deviations(_matrix(batch.column(1), dims), n, all_sums)
            z = (apart / n).astype(np.float64) @ maps
            most = int(np.abs(apart).max())
            if most * most * dims < 2**63:
                deviation = pa.array((apart * apart).sum(axis=1).astype(np.int64))
            else:
                exact = (sum(int(a) ** 2 for a in row) for row in apart)
                deviation = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["_id", "deviation", "whitened"])

    done = fit.vectors.select("_id", "x").mapInArrow(project, "_id long, deviation long, whitened array<double>")
    return done.select(
        "_id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(e) for e in explained]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whiten(table(spark, folder, "embeddings"))
    return found.select(
        "_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("_at", "whitened")
    ).select(
        F.col("_id").alias("vec_id"),
        (F.col("_at") + 1).alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("_at")).alias("explained"),
        "identity_error",
    )
