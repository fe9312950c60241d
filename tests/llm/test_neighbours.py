"""Neighbours of vectors far from zero, of huge and of tiny components, and of hot points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from testpulse.llm import neighbours as N


@pytest.mark.parametrize(("unit", "offset"), [(1.0, 1e8), (1e200, 0.0), (1e-200, 0.0)])
def test_any_offset_and_scale(spark, unit, offset):
    x = np.random.default_rng(1).standard_normal((400, 16)) * unit + offset
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in N.search(made, F.col("id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {0, 100, 200, 300}
    for q, rows in found.items():
        far = np.sqrt((((x - x[q]) / unit) ** 2).sum(axis=1)) * unit
        true = [int(i) for i in np.lexsort((np.arange(400), far)) if i != q][:10]
        rows.sort()
        assert [v for _, v, _ in rows] == true
        assert np.allclose([s for *_, s in rows], far[true], rtol=1e-12)


def test_rounding_is_bounded():
    """Whatever is nearest lies within the bound that rounding is given."""
    draw = np.random.default_rng(2)
    for unit, offset in ((1, 0), (1, 1e8), (1e200, 0), (1e-200, 0), (1, 1e15), (1e300, 1e300)):
        x = draw.standard_normal((300, 16)) * unit + offset
        far, error = N._distances(x[:5], x)
        for i in range(5):
            nearest = np.argsort(N._exact(x[i], x), kind="stable")[:10]
            limit = np.sort(far[i] + error[i])[9]
            assert (far[i][nearest] - error[i][nearest] <= limit).all()


def test_one_row_over_and_over(spark):
    """Most rows are one (id, vector); another vector has very many ids."""
    made = [(7, [1.0, 2.0])] * 3000 + [(100 + i, [5.0, 5.0]) for i in range(500)] + [(0, [1.0, 2.5]), (9, [4.0, 4.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(4)
    rows = N.search(df, F.col("id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [7, 9, *range(100, 108)]
