"""Long kernels, averages and mixed trees over sorted rows."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galena.operators import lowering as L
from galena.operators import measures
from galena.operators import scoring
from galena.operators import tree as T
from galena.operators.measures import Linear, SeparableBilinear
from galena.operators.streams import Averages, OverlapSave
from galena.operators.tree import BinOp, Const, FunctionalOp, UnOp, Var


def linear(mu, arg=Var("x")):
    return FunctionalOp(Linear(mu), (arg,))


@pytest.mark.parametrize("k", [1, 2, 65, 720, 3000])
def test_overlap_save_equals_direct_sums_however_rows_are_cut(k):
    rng = np.random.default_rng(k)
    kernel, x = rng.normal(size=k) * (rng.random(k) < 0.8), 1e6 + rng.normal(size=9000)
    want = np.convolve(x, kernel)[: len(x)]
    for cuts in ([], [1, 2, 5000], sorted(rng.integers(0, 9000, 20))):
        state = OverlapSave(kernel)
        got = np.concatenate([state.push(p) for p in np.split(x, cuts)])
        assert np.allclose(got[k:], want[k:], rtol=1e-9, atol=1e-6)
        assert len(state.before) == k - 1


def test_overlap_save_keeps_missing_and_endless_values_where_they_belong():
    rng = np.random.default_rng(1)
    kernel = rng.normal(size=200)
    kernel[50:90] = 0
    x = rng.normal(size=5000)
    clean = OverlapSave(kernel).push(x)
    x[[1000, 2500]], x[3000] = np.nan, np.inf
    got = OverlapSave(kernel).push(x)
    lags = np.flatnonzero(kernel)
    missing = {1000 + k for k in lags} | {2500 + k for k in lags}
    endless = {3000 + k for k in lags}
    for i in range(200, 5000):
        assert np.isnan(got[i]) if i in missing else np.isinf(got[i]) if i in endless else abs(got[i] - clean[i]) < 1e-9


def test_long_kernels_cost_n_log_k():
    """Ten times the weights: no more than a few times the time, and the transforms that the sizes ask for."""
    x = np.random.default_rng(2).normal(size=400_000)
    took, counted = {}, {}
    for k in (1000, 10_000, 100_000):
        state = OverlapSave(np.ones(k) / k)
        state.push(x[:10])
        began = time.process_time()
        state.push(x)
        took[k], counted[k] = time.process_time() - began, state.transforms * state.size
    assert took[100_000] < 12 * took[1000] + 0.05  # a hundred times by sums
    assert all(v < 3 * (400_000 + 4 * k) for k, v in counted.items())


def test_averages_equal_the_recurrence_however_rows_are_cut():
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    x[1700] = np.nan
    first = np.zeros(4000, bool)
    first[[0, 1, 2, 900, 1500, 2000, 3999]] = True
    for a in (0.2, 1e-4, 1.0):
        want, held = [], 0.0
        for v, f in zip(x, first, strict=True):
            held = v if f else a * v + (1 - a) * held
            want.append(held)
        for cuts in ([], [1, 1600, 1701, 2000], list(range(7, 4000, 7))):
            state = Averages(a)
            got = np.concatenate([state.push(p, f) for p, f in zip(np.split(x, cuts), np.split(first, cuts), strict=True)])
            assert np.allclose(got, want, atol=1e-12, equal_nan=True)
    x[100] = np.inf
    got = Averages(0.2).push(x, first)
    assert np.isinf(got[100]) and np.isfinite(got[900])


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"s": np.repeat(np.arange(5), [3000, 200, 64, 1, 735]), "x": rng.normal(size=4000) + 50})
    pdf["i"] = pdf.groupby("s").cumcount()
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_long_kernels_of_many_series(many):
    """Series shorter and longer than the kernel, side by side in one task, with two kernels and an average in one pass."""
    pdf, df = many
    slow, bell = measures.power_law(24, 1.5, 720), measures.Measure((measures.Atom(0.5, 3),), measures.Density("gaussian_half", (("sigma", 40.0),), 150))
    trees = {"a": linear(slow), "b": linear(bell), "e": linear(measures.ema(5)), "n": linear(bell, linear(measures.ema(5)))}
    made = L.evaluate(df, trees, L.Series(["i"], ["s"]))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "collect_list" not in plan  # a level of nesting each
    for s, g in made.orderBy("s", "i").toPandas().groupby("s"):
        x = pdf[pdf.s == s]["x"].to_numpy()
        for name, t in trees.items():
            assert np.allclose(g[name].to_numpy(float), T.evaluate(t, {"x": x}), equal_nan=True), (s, name)


def test_warmup_of_a_long_kernel_is_filled(many):
    pdf, df = many
    got = L.evaluate(df, {"a": linear(measures.power_law(24, 1.5, 720))}, L.Series(["i"], ["s"]), fill=0.0).where("i < 720").agg(F.min("a"), F.max("a"), F.count("a")).first()
    assert tuple(got) == (0.0, 0.0, (pdf["i"] < 720).sum())


def test_mixed_trees_along_one_series_run_in_ranges(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=2500) + 3
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(5)
    average, top = linear(measures.ema(4)), UnOp("reduce_max", Var("x"))
    trees = {
        "sum": BinOp("add", linear(measures.diff(2)), average),
        "late": linear(measures.lag(5), average),
        "twice": linear(measures.ema(2), linear(measures.lag(1), average)),
        "off": BinOp("sub", UnOp("reduce_mean", linear(measures.lag(70))), top),
        "long": linear(measures.power_law(9, 1.5, 300), BinOp("div", Var("x"), top)),
        "both": FunctionalOp(SeparableBilinear(measures.ema(3), measures.diff(1)), (Var("x"), Var("x"))),
    }
    for fill in (None, 0.0):
        made = L.evaluate(df, trees, L.Series(["i"]), fill, keep=["i"])
        got = made.orderBy("i").toPandas()
        assert len(got) == 2500
        for name, t in trees.items():
            want = np.broadcast_to(T.evaluate(t, {"x": x}, np.nan if fill is None else fill), x.shape)
            assert np.allclose(got[name].to_numpy(float), want, equal_nan=True, atol=1e-9), (name, fill)
    losses = scoring.losses_by_data(df.withColumn("y", F.col("x") * 2), list(trees.values()), "y", L.Series(["i"]))
    assert np.allclose(losses, [scoring.score_arrays(t, {"x": x}, 2 * x) for t in trees.values()])


def test_no_window_over_all_rows_in_mixed_trees(spark):
    df = spark.range(3000).selectExpr("id i", "cast(id % 7 as double) x")
    trees = {"a": BinOp("add", linear(measures.lag(3)), linear(measures.ema(3))), "b": BinOp("sub", linear(measures.lag(2)), UnOp("reduce_mean", Var("x")))}
    plan = L.evaluate(df, trees, L.Series(["i"]), keep=["i"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__block" in line for line in windows)
