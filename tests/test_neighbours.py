"""Neighbours over slabs against all distances, and the exponent against a whole series in memory."""

import numpy as np
import pytest

from galena.operators import dynamics, neighbours
from galena.operators.lowering import Series


def _brute(points, apart):
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    n = np.arange(len(points))
    d[np.abs(n[:, None] - n[None]) <= apart] = np.inf
    return d.min(1)


@pytest.mark.parametrize("slab, apart", [(50, 0), (50, 12), (2000, 3)])
def test_neighbours_equal_all_distances(spark, slab, apart):
    rng = np.random.default_rng(slab + apart)
    cloud = np.concatenate([rng.normal(size=(700, 3)), rng.normal(size=(20, 3)) * 50, np.round(rng.normal(size=(80, 3)))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(cloud)], "i long, p array<double>").repartition(5)
    got = {r["i"]: r for r in neighbours.nearest_neighbours_apart(df, apart, slab).collect()}
    want = _brute(cloud, apart)
    assert len(got) == 800
    for i, r in got.items():
        assert abs(r["d"] - want[i]) < 1e-9 and abs(r["j"] - i) > apart and abs(((cloud[i] - cloud[r["j"]]) ** 2).sum() - want[i]) < 1e-9


def test_a_value_of_a_third_of_all_points_is_cut_by_number(spark):
    rows = [(i, [1.0, 2.0]) for i in range(600)] + [(600 + i, [float(i), 0.5]) for i in range(1200)]
    df = spark.createDataFrame(rows, "i long, p array<double>").repartition(4)
    got = {r["i"]: r["d"] for r in neighbours.nearest_neighbours_apart(df, 5, 100).collect()}
    want = _brute(np.array([p for _, p in rows]), 5)
    assert len(got) == 1800 and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_odd_points(spark):
    rows = [(0, [1.0]), (1, None), (2, [float("nan")]), (3, [None]), (4, []), (5, [2.5]), (6, [float("inf")])]
    df = spark.createDataFrame(rows, "i long, p array<double>")
    assert sorted(map(tuple, neighbours.nearest_neighbours_apart(df, 1).collect())) == [(0, 5, 2.25), (5, 0, 2.25)]
    assert neighbours.nearest_neighbours_apart(df, 10).count() == 0 and neighbours.nearest_neighbours_apart(df.limit(0)).count() == 0


def test_exponent_equals_that_of_the_whole_series(spark):
    x = [0.3]
    for _ in range(2499):
        x.append(3.9 * x[-1] * (1 - x[-1]))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i long, x double").repartition(4)
    got = neighbours.lyapunov_by_data(df, "x", Series(["i"]), slab=300)
    want = dynamics.lyapunov(np.array(x), 1.0)["exponent"]
    assert abs(got - want) < 1e-9 and got > 0.05
    assert neighbours.lyapunov_by_data(df.where("i < 60"), "x", Series(["i"])) is None
    assert neighbours.lyapunov_by_data(df.limit(0), "x", Series(["i"])) is None
