"""Whitening against dense eigenvectors."""

import pathlib

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from testpulse.llm import whitening as W
from testpulse.llm.catalog import QUERIES

FOLDER = f"{compare.DATA}/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def plain(vectors, components=32):
    """(n, deviations, whitened up to sign, explained) of a list of vectors, by a dense method."""
    x = np.floor(np.array(vectors) * 64).astype(np.int64) + 1_000_000
    n = len(x)
    apart = n * x - x.sum(axis=0)
    y = apart / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    return n, (apart**2).sum(axis=1), y @ turn / np.sqrt(values), values / (y * y).sum() * n


def compared(found, ids, vectors):
    n, deviations, whitened, explained = plain(vectors)
    by_id = {r._id: r for r in found.collect()}
    assert sorted(by_id) == sorted(ids)
    mine = np.array([by_id[i].whitened for i in ids])
    assert [by_id[i].deviation for i in ids] == deviations.tolist() and by_id[ids[0]].n == n
    width = mine.shape[1]
    sign = np.sign((mine * whitened[:, :width]).sum(axis=0))
    assert np.abs(mine - whitened[:, :width] * sign).max() < 1e-9
    assert np.allclose(by_id[ids[0]].explained, explained[:width], rtol=1e-10)
    assert by_id[ids[0]].identity_error < 1e-10
    return width


@pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="no test data")
def test_op13(spark):
    found = QUERIES["op13_whitening"][0](spark, FOLDER).toPandas()
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    n, deviations, whitened, explained = plain(rows.embedding.tolist())
    table = found.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert table.shape == whitened.shape and found.n.unique().tolist() == [n]
    sign = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table - whitened * sign).max() < 1e-9
    assert found.groupby("vec_id").deviation.first().loc[rows.vec_id].tolist() == deviations.tolist()
    assert np.allclose(found.groupby("component").explained.first(), explained, rtol=1e-10)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-10


@pytest.mark.parametrize(("dims", "wanted", "shape"), [
    (64, 32, "flat"), (300, 32, "flat"), (300, 20, "falling"), (100, 32, "equal"), (90, 32, "low rank"), (1, 32, "flat"),
])
def test_eigenpairs(dims, wanted, shape):
    """More dimensions than a basis holds, close, equal and vanishing values."""
    values = {
        "flat": np.linspace(76, 53, dims), "falling": 1 / np.arange(1, dims + 1),
        "equal": np.ones(dims), "low rank": (np.arange(dims) < 5).astype(float),
    }[shape]
    turn, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((dims, dims)))
    matrix = (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = W.eigenpairs(lambda block: matrix @ block, dims, wanted)
    true = np.linalg.eigvalsh(matrix)[::-1][:wanted]
    assert np.abs(found - true).max() < 1e-13 * max(true[0], 1)
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.linalg.norm(matrix @ vectors - vectors * found, axis=0).max() < 2e-13 * true[0]


def test_minres_solves_projected_equations():
    draw = np.random.default_rng(5)
    matrix = draw.standard_normal((30, 30))
    matrix = matrix + matrix.T
    values, turn = np.linalg.eigh(matrix)
    known, right = turn[:, -3:], draw.standard_normal((30, 3))
    right = right - known @ (known.T @ right)
    found = W.minres(lambda b: matrix @ b, values[-3:], known, right, 30, 1e-13)
    for i in range(3):
        rest = (matrix - values[-3 + i] * np.eye(30)) @ found[:, i]
        rest = rest - known @ (known.T @ rest)
        assert np.linalg.norm(rest - right[:, i]) < 1e-10 * np.linalg.norm(right[:, i])
    assert np.abs(known.T @ found).max() < 1e-12


def test_odd_rows(spark):
    draw = np.random.default_rng(6)
    good = [(int(i), draw.normal(3, 2, 5).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]),
           (104, [1.0, float("inf"), 2.0, 3.0, 4.0]), (105, [1e300, 0.0, 0.0, 0.0, 0.0]), (106, [1.0, 2.0])]
    made = spark.createDataFrame(good + odd, SCHEMA)
    for name in ("_id", "x", "n", "whitened", "dim"):
        made = made.withColumn(name, F.lit("y"))
    ids, vectors = [i for i, _ in good], [v for _, v in good]
    assert compared(W.whiten(made), ids, vectors) == 5
    assert W.whiten(made.limit(0)).count() == 0
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    assert W.whiten(equal).count() == 0
    twice = W.whiten(spark.createDataFrame(good + good, SCHEMA)).collect()
    assert len(twice) == 80 and {r.n for r in twice} == {80}


def test_low_rank_and_floats(spark):
    draw = np.random.default_rng(7)
    flat = draw.normal(0, 1, (60, 2)).round(0)
    vectors = [[float(a), float(b), float(a + b), 7.0] for a, b in flat]
    made = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = W.whiten(made)
    n, deviations, whitened, _ = plain(vectors, 2)
    rows = {r._id: r for r in found.collect()}
    assert {len(r.whitened) for r in rows.values()} == {2}
    assert [rows[i].deviation for i in range(60)] == deviations.tolist()
    mine = np.array([rows[i].whitened for i in range(60)])
    assert np.abs(np.abs(mine) - np.abs(whitened)).max() < 1e-9


def test_large_offsets_are_exact(spark):
    """Entries far from zero: n x - S is exact, and centring loses nothing."""
    draw = np.random.default_rng(8)
    vectors = (1e9 + draw.integers(-5, 6, (50, 3))).tolist()
    made = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], SCHEMA)
    assert compared(W.whiten(made), list(range(50)), vectors) == 3
    wide = spark.createDataFrame([(0, [4e16]), (1, [0.0]), (2, [-4e16])], SCHEMA)
    rows = W.whiten(wide).collect()
    assert len(rows) == 3 and {r.deviation for r in rows if r._id != 1} == {None}
