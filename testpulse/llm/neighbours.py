"""Approximate nearest neighbours by shifted space-filling curves.

1. Equal vectors become one point that keeps its ``K + 1`` least ids; no other id of such
   a group can be among the ``K`` nearest of any query.
2. The space is rotated at random a few times.  Each rotation is cut into groups of
   ``DIMENSIONS`` coordinates, and every group, shifted at random, orders all points along
   a Hilbert curve.  The groups of one rotation share nothing, so a near point that is
   far along one curve tends to be close along another.
3. Spark range-partitions and sorts the keys of each curve and numbers them in order.
4. How wide a window must be is measured, not assumed: for a fixed number of sample
   queries the true neighbours are found by comparison with all points, and the least
   window is taken in which ``TARGET`` of them lie along at least one curve.
5. Along each curve the points are cut into blocks of that width (``BLOCK`` rows at most).  A
   query goes to its own block and the neighbours that its window reaches; the block's
   distances are computed (double precision, original vectors) and the nearest kept.
6. What the curves found for a query is merged and ranked.

Every vector is in every curve's order; nothing is dropped but vectors that are null or
zero or hold a null or non-finite component, which take no part.  Vectors of another
length than most are points of their own space: only vectors of equal length are compared.

Defined results: repeated rows (equal id and vector) count once; an id with several
vectors is a point at each of them, and a query is the least of them; rows without an id
take no part; fewer points than ``K`` give as many neighbours as there are; an empty
table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from testpulse.llm.columns import table
from testpulse.session import stage

K = 10
DIMENSIONS = 8
CURVES = 24
BITS = 7
#: Share of the sample queries' true neighbours that must lie within the windows.
TARGET = 0.95
SAMPLE = 128
SEED = 7
LEAST_WINDOW = 64
#: Rows of a block at most; a wider window is several blocks on either side.
BLOCK = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows) along the Hilbert curve of as many dimensions.

    Gray-code walk from the coarsest to the finest bit: at each level the corner that a
    cell lies in is ranked, and the frame of the finer levels is exchanged and reflected.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for axis in range(n):
            set_here = (x[axis] & bit) != 0
            swapped = np.where(set_here, 0, (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(set_here, below, swapped)
            x[axis] ^= swapped
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flips
    keys = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            keys = keys << 1 | (x[axis] >> level) & 1
    return keys


def rotations(width: int, curves: int, dimensions: int, seed: int = SEED) -> list[np.ndarray]:
    """For each curve the directions (columns) of its coordinates."""
    chance = np.random.default_rng(seed)
    made: list[np.ndarray] = []
    dimensions = min(dimensions, width)
    while len(made) < curves:
        turned, _ = np.linalg.qr(chance.normal(size=(width, width)))
        for at in range(0, width - dimensions + 1, dimensions):
            made.append(turned[:, at : at + dimensions])
    return made[:curves]


def points(vectors: DataFrame, id_col: str, vector_col: str, k: int = K) -> DataFrame:
    """(vector, ids: up to k + 1 least ids, point: the least, width) of distinct vectors."""
    vector = F.col(vector_col)
    sound = (
        ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(vector, lambda v: v != 0)
    )
    rows = vectors.filter(F.col(id_col).isNotNull() & vector.isNotNull() & sound).select(
        F.col(id_col).cast("long").alias("id"),
        # One zero only: -0.0 and 0.0 are equal components.
        F.transform(vector, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double"))).alias("vector"),
    )
    least = Window.partitionBy("vector").orderBy("id")
    rows = rows.distinct()  # repeated rows go before any is ranked
    ranked = rows.withColumn("_rank", F.dense_rank().over(least)).filter(F.col("_rank") <= k + 1)
    return ranked.groupBy("vector").agg(
        F.array_sort(F.collect_set("id")).alias("ids"),
        F.min("id").alias("point"),
        F.size("vector").alias("width"),
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _distances(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances, for choosing, in a unit of their own, and how far rounding can have
    moved each.

    Both sides are taken from a centre among them first and scaled by a power of two, so that
    neither a common offset nor large components matter.  Those that are kept are computed
    anew, see :func:`_exact`."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows))), np.zeros((len(queries), len(rows)))
    centre = rows[0]
    reach = max(np.abs(queries / 2 - centre / 2).max(), np.abs(rows / 2 - centre / 2).max())
    shrink = 2.0 ** -(np.frexp(reach)[1] + 1)
    a = queries * shrink - centre * shrink
    b = rows * shrink - centre * shrink
    sizes = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :]
    return sizes - 2 * (a @ b.T), (4 * a.shape[1] + 16) * np.finfo(float).eps * sizes


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of rows from a query, in double precision."""
    apart = rows - query
    most = np.abs(apart).max(axis=1, initial=0)
    if most.size and (most.max() > 1e150 or (0 < most[most > 0].min(initial=1) < 1e-150)):
        unit = np.where(most > 0, most, 1)
        return np.sqrt(((apart / unit[:, None]) ** 2).sum(axis=1)) * unit
    return np.sqrt((apart**2).sum(axis=1))


def _spread(found: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the components, over all points."""
    sums = found.select(F.posexplode("vector").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.max(F.abs("v")).alias("most")
    )
    mean, deviation = np.zeros(width), np.ones(width)
    for r in sums.collect():  # one row a component
        sound = np.isfinite(r["mean"]) and np.isfinite(r["deviation"])  # squares can be too large
        mean[r["i"]] = r["mean"] if sound else 0.0
        deviation[r["i"]] = max(r["deviation"] if sound else min(r["most"], 1e150), 1e-9)
    return mean, deviation


def ordered(found: DataFrame, width: int, curves: int, dimensions: int, partitions: int) -> DataFrame:
    """(curve, part, at, point, vector, ids): all points along each curve, range-partitioned;
    ``part`` is the partition and ``at`` the row in it."""
    mean, deviation = _spread(found, width)
    turns = rotations(width, curves, dimensions)
    reach = float(np.sqrt((deviation**2).mean())) * 4
    shifts = np.random.default_rng(SEED + 1).uniform(-0.1, 0.1, size=(curves, turns[0].shape[1])) * reach

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), width) - mean
            for curve, (turn, shift) in enumerate(zip(turns, shifts, strict=True)):
                share = np.clip(((x @ turn + shift) / reach + 1) / 2, 0, 1)
                cells = np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
                keys = hilbert_keys(cells, BITS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), curve), pa.int32()), pa.array(keys), *batch.columns],
                    ["curve", "key", *batch.schema.names],
                )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at, at + n)), *batch.columns],
                ["part", "at", *batch.schema.names],
            )
            at += n

    kinds = "point long, vector array<double>, ids array<long>"
    keys = found.select("point", "vector", "ids").mapInArrow(keyed, f"curve int, key long, {kinds}")
    # Equal keys are told apart by their points, so no key is too large for a partition.
    sorted_keys = keys.repartitionByRange(partitions, "curve", "key", "point").sortWithinPartitions(
        "curve", "key", "point"
    )
    return sorted_keys.mapInArrow(number, f"part int, at long, curve int, key long, {kinds}")


def _global(rows: DataFrame) -> DataFrame:
    """Adds ``row``: the number along all curves, one after the other."""
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(starts), "part").withColumn("row", F.col("_before") + F.col("at"))


def window_for(found: DataFrame, rows: DataFrame, width: int, k: int, sample: int, target: float) -> int:
    """The least window along the curves that holds ``target`` of the true neighbours of
    the sample (the points of least hash), which is compared with all points."""
    chosen = found.orderBy(F.xxhash64("point"), "point").limit(sample).select("point", "vector").collect()
    ids = np.array([r["point"] for r in chosen])
    queries = np.array([r["vector"] for r in chosen])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d = np.full((len(ids), 0), np.inf)
        best_p = np.zeros((len(ids), 0), dtype=np.int64)
        for batch in batches:
            names = batch.column("point").to_numpy(zero_copy_only=False)
            vectors = _matrix(batch.column("vector"), width)
            far = np.stack([_exact(q, vectors) for q in queries])
            far[ids[:, None] == names[None, :]] = np.inf
            best_d = np.hstack([best_d, far])
            best_p = np.hstack([best_p, np.broadcast_to(names, far.shape)])
            kept = np.argsort(best_d, axis=1, kind="stable")[:, :k]
            best_d = np.take_along_axis(best_d, kept, axis=1)
            best_p = np.take_along_axis(best_p, kept, axis=1)
        q = np.repeat(ids, best_d.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(best_p.ravel()), pa.array(best_d.ravel())], ["q", "p", "d"]
        )

    near = found.select("point", "vector").mapInArrow(nearest, "q long, p long, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "p"))
    true = stage(near.withColumn("_rank", rank).filter(F.col("_rank") <= k).select("q", "p"), "true-neighbours")
    wanted = true.select(F.col("q").alias("point")).union(true.select("p")).distinct()
    places = stage(
        rows.select("curve", "point", "row").join(F.broadcast(wanted), "point"), "places"
    )  # at most sample x (k + 1) points
    mine = places.select("curve", F.col("point").alias("q"), F.col("row").alias("_mine"))
    theirs = places.select("curve", F.col("point").alias("p"), F.col("row").alias("_theirs"))
    apart = (
        true.join(mine, "q")
        .join(theirs, ["curve", "p"])
        .groupBy("q", "p")
        .agg(F.min(F.abs(F.col("_mine") - F.col("_theirs"))).alias("apart"))
    )
    gaps = np.sort(apart.toPandas()["apart"].to_numpy())  # at most sample x k numbers
    if not len(gaps):
        return LEAST_WINDOW
    return max(LEAST_WINDOW, int(gaps[min(len(gaps) - 1, int(np.ceil(target * len(gaps))))]))


def _searched(k: int, width: int):
    def search(group: pa.Table) -> pa.Table:
        """Nearest rows of one block for each query that was sent to it."""
        asked = group.column("asked").to_numpy().astype(bool)
        # A query sent here is a row too, if this is its own block.
        queries = group.filter(pa.array(asked))
        rows = group.filter(pa.array(~asked))
        empty = pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not rows.num_rows:
            return empty
        x = _matrix(rows.column("vector").combine_chunks(), width)
        out_q, out_id, out_d = [], [], []
        names = rows.column("ids").to_pylist()
        curves = rows.column("curve").to_numpy()
        asked_curves = queries.column("curve").to_numpy()
        everyone = _matrix(queries.column("vector").combine_chunks(), width)
        for at in range(0, queries.num_rows, 256):
            part = everyone[at : at + 256]
            far, error = _distances(part, x)
            error[asked_curves[at : at + 256][:, None] != curves[None, :]] = 0
            far[asked_curves[at : at + 256][:, None] != curves[None, :]] = np.inf
            few = min(k + 1, x.shape[0])
            close = np.argpartition(far, few - 1, axis=1)[:, :few]
            limit = np.take_along_axis(far + error, close, axis=1).max(axis=1)
            for i in range(len(part)):
                # All that rounding could have put behind the limit.
                near = np.flatnonzero((far[i] - error[i] <= limit[i]) & np.isfinite(far[i]))
                exact = _exact(part[i], x[near])
                q = queries.column("point")[at + i].as_py()
                # What rounding let in goes again: nothing behind the few that are nearest.
                last = np.sort(exact)[min(few, len(exact)) - 1] if len(exact) else 0.0
                for j, d in zip(near.tolist(), exact.tolist(), strict=True):
                    if d <= last:
                        for name in names[j]:
                            out_q.append(q)
                            out_id.append(name)
                            out_d.append(d)
        return pa.table({"q": pa.array(out_q, pa.int64()), "id": pa.array(out_id, pa.int64()), "score": pa.array(out_d, pa.float64())})

    return search


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    curves: int = CURVES,
    dimensions: int = DIMENSIONS,
    target: float = TARGET,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query (a condition on ``id``)."""
    spark = vectors.sparkSession
    everyone = stage(points(vectors, id_col, vector_col, k), "points")
    asked = stage(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"))
        .filter(is_query)
        .select("id", F.transform("_v", lambda v: F.when(v == 0, F.lit(0.0)).otherwise(v.cast("double"))).alias("vector"))
        .join(everyone.select("vector", "point", "width"), "vector")
        .groupBy("id")
        .agg(F.min_by("point", "point").alias("point"), F.min_by("width", "point").alias("width")),
        "queries",
    )
    schema = "query_id long, rank int, vec_id long, score double"
    answers = None
    for row in everyone.groupBy("width").count().orderBy("width").collect():
        width, n_points = row["width"], row["count"]
        part = _search_width(
            spark, everyone.filter(F.col("width") == width), asked.filter(F.col("width") == width),
            width, n_points, k, curves, dimensions, target, sample,
        )
        answers = part if answers is None else answers.union(part)
    return answers if answers is not None else spark.createDataFrame([], schema)


def _search_width(spark, found, asked, width, n_points, k, curves, dimensions, target, sample) -> DataFrame:
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _global(stage(ordered(found, width, curves, dimensions, shuffles), "curves"))
    window = window_for(found, rows, width, k, sample, target)
    block = min(window, BLOCK)
    reach = -(-window // block)
    number = F.floor(F.col("row") / block)
    query_points = asked.select("point").distinct()
    filed = rows.select(number.alias("block"), "curve", "point", "vector", "ids", F.lit(False).alias("asked"))
    around = F.explode(F.sequence(number - reach, number + reach)).alias("block")
    sent = rows.join(query_points, "point").select(
        around, "curve", "point", "vector", "ids", F.lit(True).alias("asked")
    )
    blocks = filed.union(sent).groupBy("block")
    found_rows = blocks.applyInArrow(_searched(k, width), "q long, id long, score double")
    merged = found_rows.groupBy("q", "id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("q").orderBy("score", "id")
    # One more than k, as a query may find itself; then one copy for each id at the point.
    few = stage(
        merged.withColumn("_rank", F.row_number().over(nearest)).filter(F.col("_rank") <= k + 1), "nearest"
    )
    matched = (
        asked.select(F.col("id").alias("query_id"), F.col("point").alias("q"))
        .join(few.drop("_rank"), "q")
        .filter("id <> query_id")
    )
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        matched.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
    )


def op1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)
