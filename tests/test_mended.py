"""Cases that failed at size or by an error before they were mended."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from galena.operators import combinatorics, dynamics, neighbours
from galena.operators.lowering import Series


@pytest.mark.parametrize("n, boards", [(0, 1), (1, 1), (3, 0), (5, 10), (8, 92)])
def test_queens_on_boards_of_each_size(spark, n, boards):
    got = [r["files"] for r in combinatorics.queens(spark, n).collect()]
    assert len(got) == len({tuple(f) for f in got}) == boards
    for files in got:
        assert len(set(files)) == len({f - r for r, f in enumerate(files)}) == len({f + r for r, f in enumerate(files)}) == n


def test_queens_as_the_first_query_of_a_session():
    code = "import sys; from pyspark.sql import SparkSession; spark = SparkSession.builder.master('local[6]').config('spark.ui.enabled', 'false').getOrCreate(); from galena.plans import registry; print(registry.queries()['queens_eight'](spark, '').collect().__len__())"
    root = str(Path(__file__).resolve().parent.parent)
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, env={k: v for k, v in os.environ.items() if k != "PYSPARK_GATEWAY_PORT"}, capture_output=True, text=True, timeout=200)
    assert ran.returncode == 0 and ran.stdout.split()[-1] == "92", ran.stderr[-2000:]


def test_few_points_ask_a_second_box():
    rng = np.random.default_rng(4)
    points, numbers = np.round(rng.exponential(47, size=(20_000, 3)), 2), np.arange(20_000)
    boxes = neighbours.Boxes(points[::64], numbers[::64], 16)
    home = boxes.place(points, numbers)
    assert len(boxes) > 10 and np.bincount(home).max() < 4096
    asks = 0
    for k in range(len(boxes)):
        at = np.flatnonzero(home == k)
        _, d = neighbours._nearest(points[at], numbers[at], points[at], numbers[at], 10)
        asks += sum(len(who) for box, who in boxes.met(points[at], d) if box != k)
    # slabs of the first coordinate asked several dozen rows a point
    assert asks < len(points)


def test_neighbours_of_a_series_with_many_copies(spark):
    x = np.repeat(np.round(np.random.default_rng(5).exponential(47, 300), 1), 9)
    x[900:1700] = 3.5
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(3)
    points = neighbours.embedded(df, "x", Series(["i"]))
    cloud = np.stack([x[:-2], x[1:-1], x[2:]], 1)
    assert [r["p"] for r in points.orderBy("i").collect()] == cloud.tolist()
    got = {r["i"]: (r["j"], r["d"]) for r in neighbours.nearest_neighbours_apart(points, 10, 100).collect()}
    d = ((cloud[:, None] - cloud[None]) ** 2).sum(2)
    n = np.arange(len(cloud))
    d[np.abs(n[:, None] - n[None]) <= 10] = np.inf
    assert len(got) == len(cloud)
    for i, (j, far) in got.items():
        assert abs(i - j) > 10 and abs(far - d[i].min()) < 1e-9 and (far == 0 or j == d[i].argmin())


@pytest.mark.parametrize("digits", [1, 12])
def test_exponent_over_ranges_and_packs(spark, monkeypatch, digits):
    monkeypatch.setattr(neighbours, "PATHS", 256)
    monkeypatch.setattr(neighbours, "PACK", 100)
    x = [0.3]
    for _ in range(1999):
        x.append(3.9 * x[-1] * (1 - x[-1]))
    x = np.round(x, digits) if digits > 1 else np.round(np.array(x) * 40)
    x = x + np.linspace(0, 1e-3, len(x)) if digits > 1 else x
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(3)
    points = neighbours.embedded(rows, "x", Series(["i"]))
    pairs = np.random.default_rng(6).integers(0, len(x) - 30, (1500, 2))
    got = neighbours._logs_of_parting(points, spark.createDataFrame([tuple(map(int, p)) for p in pairs], "i long, j long"), 3, 15)
    cloud = np.stack([x[:-2], x[1:-1], x[2:]], 1)
    for s in range(15):
        d = np.sqrt(((cloud[pairs[:, 0] + s] - cloud[pairs[:, 1] + s]) ** 2).sum(1))
        assert got[s][1] == (d > 1e-12).sum() and abs(got[s][0] - np.log(d[d > 1e-12]).sum()) < 1e-6


def test_only_signatures_of_the_class_are_computed(spark):
    rng = np.random.default_rng(7)
    traj = spark.createDataFrame([(k, i, float(i), [float(v)]) for k in "ab" for i, v in enumerate(rng.exponential(47, 70))], dynamics.TRAJECTORY)
    classes = spark.createDataFrame([("a", "algebraic"), ("b", "map")], "traj_id string, class string")
    got = {(r["traj_id"], r["signature"]) for r in dynamics.series_signatures(traj, classes).collect()}
    assert got == {("a", "modes"), ("b", "modes"), ("b", "spectral"), ("b", "conservation")}
    every = {(r["traj_id"], r["signature"], r["key"]): r["value"] for r in dynamics.series_signatures(traj).collect()}
    assert ("a", "spectral", "peak") in every and every["a", "modes", "modes"] >= 1


@pytest.mark.parametrize("d", [2, 3])
def test_modes_are_counted(d):
    rng = np.random.default_rng(8)
    states = np.concatenate([rng.normal(0, 1, (200, d)), rng.normal(40, 1, (200, d))])
    assert dynamics.mode_count(rng.permutation(states)) == {"modes": 2.0}
