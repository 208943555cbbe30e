"""The engine against pandas, numpy, closed forms, and itself."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galena.functions import pointwise as P
from galena.operators import axes, combinatorics, dynamics, enumeration, fitness, intervals, ising, koopman, measures, networks, programs, regression, scoring, search
from galena.operators import lowering as L
from galena.operators import tree as T
from galena.operators.measures import Linear, SeparableBilinear, Volterra2
from galena.operators.simplify import canonical, fold, simplify
from galena.operators.tree import BinOp, Const, FunctionalOp, FunctionalOp2D, UnOp, Var

EDGES = [0.0, -0.0, 1.0, -1.5, 2.0, 1e-13, 1e300, -1e300, 700.0, float("nan"), float("inf"), float("-inf")]


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)))


def test_binary_operators_equal_numpy_on_every_edge(spark):
    pairs = list(itertools.product(EDGES, EDGES))
    df = spark.createDataFrame(pairs, "a double, b double")
    rows = df.select("a", "b", *[f(F.col("a"), F.col("b")).alias(op) for op, f in P.BINARY.items()]).collect()
    for r in rows:
        for op in P.BINARY:
            with np.errstate(all="ignore"):
                want = float(P.NP_BINARY[op](np.float64(r["a"]), np.float64(r["b"])))
            assert same(r[op], want), (op, r["a"], r["b"], r[op], want)


def test_unary_operators_equal_numpy_on_every_edge(spark):
    df = spark.createDataFrame([(x,) for x in EDGES], "a double")
    for r in df.select("a", *[f(F.col("a")).alias(op) for op, f in P.UNARY.items()]).collect():
        for op in P.UNARY:
            with np.errstate(all="ignore"):
                want = float(P.NP_UNARY[op](np.float64(r["a"])))
            assert same(r[op], want) or op in ("sin", "cos") and abs(r["a"]) > 1e9, (op, r["a"], r[op], want)


def test_nulls_stay_missing_and_indicators_are_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (None, None)], "a double, b double")
    for r in df.select(*[f(F.col("a"), F.col("b")).alias(op) for op, f in P.BINARY.items()]).collect():
        assert all(r[op] == 0.0 if op in ("gt", "lt", "ge", "le") else r[op] is None for op in P.BINARY)
    r = df.select(*[f(F.col("a")).alias(op) for op, f in P.UNARY.items()]).first()
    assert all(r[op] == 0.0 if op == "step" else r[op] is None for op in P.UNARY)


def test_reductions_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    r = df.agg(*[f(F.col("x")).alias(op) for op, f in P.REDUCE.items()]).first()
    assert (r["reduce_mean"], r["reduce_max"], r["reduce_sum"], r["reduce_std"]) == (2.0, 3.0, 4.0, 1.0)
    none = df.where("x is null").agg(*[f(F.col("x")).alias(op) for op, f in P.REDUCE.items()]).first()
    assert all(math.isnan(v) for v in none)


# --- measures


def test_measures_equal_pandas():
    x = np.random.default_rng(0).standard_normal(300)
    s = pd.Series(x)
    for k in (1, 3, 24):
        assert np.allclose(measures.lag(k).apply(x), s.shift(k), equal_nan=True)
        assert np.allclose(measures.diff(k).apply(x), s.diff(k), equal_nan=True)
    for h in (3, 24):
        assert np.allclose(measures.ema(h).apply(x), s.ewm(halflife=h, adjust=False).mean())
    for w in (3, 12, 100):
        assert np.allclose(measures.roll_mean(w).apply(x), s.rolling(w).mean(), equal_nan=True)


def test_measure_algebra():
    m = measures.signed_sum([(1.0, 2), (2.0, 0), (-1.0, 2), (0.5, 1)])
    assert [(a.lag, a.weight) for a in m.atoms] == [(0, 2.0), (1, 0.5)] and m.warmup == 1 and m.total_atomic_mass == 2.5
    x = np.random.default_rng(1).standard_normal(80)
    inner = measures.diff(2).apply(x)
    assert np.allclose(measures.lag(1).compose(measures.diff(2)).apply(x)[3:], measures.lag(1).apply(inner)[3:])
    assert np.allclose(measures.power_law(5, 1.5, 100).apply(x), np.where(np.arange(80) < 100, np.nan, 0), equal_nan=True)
    for bad in (lambda: measures.Atom(1.0, -1), lambda: measures.Atom(float("nan"), 1), lambda: measures.power_law(3, 0.5), lambda: measures.ema(-1)):
        with pytest.raises(ValueError):
            bad()
    k = measures.power_law(8, 1.5, 100).kernel()
    assert np.allclose(measures.convolve_causal(x, k), np.convolve(x, k)[:80]) and abs(k.sum() - 1) < 1e-12


def test_own_density():
    @measures.register_density("test_ramp")
    def ramp(params, last):
        return np.arange(last + 1, dtype=float)

    assert measures.Measure((), measures.Density("test_ramp", (), 3)).kernel().tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("mu", [measures.lag(2), measures.diff(1), measures.roll_mean(4), measures.ema(3), measures.power_law(5, 1.5, 20), measures.power_law(5, 1.5, 90), measures.Measure((measures.Atom(1.0, 0),), measures.Density("exponential", (("halflife", 3.0),), 9))])
def test_lowered_measures_equal_memory(spark, mu):
    rng = np.random.default_rng(2)
    rows = [(s, i, float(v)) for s in range(4) for i, v in enumerate(rng.standard_normal(120))]
    df = spark.createDataFrame(rows, "s int, i int, x double").repartition(5)
    got = L.evaluate(df, {"y": FunctionalOp(Linear(mu), (Var("x"),))}, L.Series(["i"], ["s"])).orderBy("s", "i").toPandas()
    for s, g in got.groupby("s"):
        assert np.allclose(g["y"].to_numpy(float), mu.apply(g["x"].to_numpy()), equal_nan=True)


def test_functionals_and_warmup_fill(spark):
    x = np.random.default_rng(3).standard_normal(50)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").withColumn("s", F.lit(1))
    trees = {"v": FunctionalOp(Volterra2(measures.diff(1), measures.lag(2)), (Var("x"),)), "b": FunctionalOp(SeparableBilinear(measures.lag(1), measures.diff(3)), (Var("x"), UnOp("sin", Var("x"))))}
    got = L.evaluate(df, trees, L.Series(["i"], ["s"]), fill=0.0).orderBy("i").toPandas()
    for name, t in trees.items():
        assert np.allclose(got[name], T.evaluate(t, {"x": x}, 0.0))


def test_lags_share_one_window(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(9)], "s int, i int, x double")
    trees = {f"l{k}": FunctionalOp(Linear(measures.lag(k)), (Var("x"),)) for k in range(1, 8)}
    plan = L.evaluate(df, trees, L.Series(["i"], ["s"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 1


def test_blocked_average_over_one_long_series(spark):
    x = np.random.default_rng(4).standard_normal(3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(7)
    for blocks in (1, 5):
        got = L.blocked_ema(df, "x", "y", 0.1, L.Series(["i"]), blocks).orderBy("i").toPandas()["y"]
        assert np.allclose(got, pd.Series(x).ewm(alpha=0.1, adjust=False).mean())


def test_one_series_in_ranges_equals_one_window(spark):
    """Ranges shorter than the halo too, nested measures, and a fill for the warmup."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=400)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(5)
    inner = FunctionalOp(Linear(measures.roll_mean(7)), (Var("x"),))
    tree = FunctionalOp(Linear(measures.lag(70)), (BinOp("mul", inner, Var("x")),))
    want = (pd.Series(x).rolling(7).mean() * x).shift(70).to_numpy()
    for blocks in (1, 3, 40):
        cut, series, own = L.in_ranges(rows, L.Series(["i"]), 76, blocks)
        got = {r["i"]: r["v"] for r in L.evaluate(cut, {"v": tree}, series, keep=["i", own]).where(own).collect()}
        assert len(got) == 400 and L.halo([tree]) == 76
        assert all((got[i] is None) == (i < 76) and (i < 76 or abs(got[i] - want[i]) < 1e-12) for i in range(400))
    got = {r["i"]: r["v"] for r in L.evaluate(rows, {"v": tree}, L.Series(["i"]), keep=["i"]).collect()}
    assert all(i < 76 or abs(got[i] - want[i]) < 1e-12 for i in range(400)) and len(got) == 400


def test_exponential_average_is_one_pass(spark):
    """Series longer than a batch, one with a gap that stays NaN, and no collected window in the plan."""
    rng = np.random.default_rng(6)
    rows = [(k, i, float(v)) for k in ("a", "b") for i, v in enumerate(rng.normal(size=12_000))] + [("c", 0, 1.0), ("c", 1, None), ("c", 2, 2.0), (None, 0, 4.0), (None, 1, 8.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double").repartition(4)
    made = L.evaluate(df, {"v": FunctionalOp(Linear(measures.ema(3)), (Var("x"),))}, L.Series(["i"], ["k"]))
    assert "collect_list" not in made._jdf.queryExecution().toString()
    got = {(r["k"], r["i"]): r["v"] for r in made.collect()}
    for k in ("a", "b"):
        want = measures.ema(3).apply(np.array([x for q, _, x in rows if q == k]))
        assert np.allclose([got[k, i] for i in range(12_000)], want)
    assert got["c", 0] == 1 and np.isnan(got["c", 1]) and np.isnan(got["c", 2])
    assert got[None, 0] == 4 and abs(got[None, 1] - (4 + 4 * measures.smoothing(3))) < 1e-12


def test_reductions_read_the_rows_once_a_level(spark, tmp_path):
    spark.range(100).selectExpr("CAST(id AS DOUBLE) AS x").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    x, reduce = Var("x"), lambda op, a: UnOp(f"reduce_{op}", a)
    flat = {f"v{i}": BinOp("sub", x, reduce(op, x)) for i, op in enumerate(("mean", "max", "sum", "std"))}
    plan = L.evaluate(rows, flat)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2
    nested = {"a": reduce("std", BinOp("sub", x, reduce("mean", x))), "b": reduce("max", BinOp("div", x, reduce("sum", x))), **flat}
    plan = L.evaluate(rows, nested)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 4
    got = L.evaluate(rows, nested).first()
    assert abs(got["a"] - np.std(np.arange(100))) < 1e-9 and abs(got["b"] - 99 / 4950) < 1e-12


@pytest.mark.parametrize("m", [measures.laplacian(), measures.diff_t(2), measures.grad_x(), measures.sobel_x(), measures.sobel_y(), measures.separable_2d(measures.diff(1), measures.signed_sum([(0.5, 0), (0.5, 1)])), measures.atomic_2d([(1.0, 1, 1), (2.0, 0, -1)])])
def test_fields_long_and_dense_equal_memory(spark, m):
    u = np.random.default_rng(5).standard_normal((9, 11))
    want = m.apply(u)
    rows = [(t, x, float(u[t, x])) for t in range(9) for x in range(11)]
    df = spark.createDataFrame(rows, "t int, x int, u double").repartition(3)
    got = L.evaluate(df, {"v": FunctionalOp2D(m, Var("u"))}, L.Series(["t"], [], "x")).orderBy("t", "x").toPandas()["v"].to_numpy(float).reshape(9, 11)
    assert np.allclose(got, want, equal_nan=True)
    wide = spark.createDataFrame([(t, [float(v) for v in u[t]]) for t in range(9)], "t int, u array<double>")
    dense = L.dense_measure(wide, "u", "v", m, ["t"]).orderBy("t").collect()
    assert np.allclose(np.array([[math.nan if v is None else v for v in r["v"]] for r in dense]), want, equal_nan=True)


def test_stencils_of_known_fields():
    x = np.arange(12.0)
    assert np.allclose(measures.laplacian().apply(np.tile(x * x, (4, 1)))[:, 1:-1], 2)
    assert np.allclose(measures.laplacian().apply(np.tile(2 * x + 3, (4, 1)))[:, 1:-1], 0)
    assert np.allclose(measures.grad_x().apply(np.tile(x, (3, 1)))[:, 1:-1], 1)
    u = fitness.heat_field(0.05, 30, 20)
    rule = BinOp("mul", Const(0.05), FunctionalOp2D(measures.laplacian(), Var("U")))
    got = T.evaluate(rule, {"U": u[:-1]})[:, 1:-1]
    assert np.allclose(got, np.diff(u, axis=0)[:, 1:-1], atol=1e-12)


def test_wrong_trees_are_refused(spark):
    df = spark.createDataFrame([(1, 2.0)], "i int, x double")
    with pytest.raises(KeyError):
        L.evaluate(df, {"v": Var("nothing")})
    with pytest.raises(ValueError):
        L.evaluate(df, {"v": FunctionalOp(Linear(measures.lag(1)), (Var("x"),))})
    with pytest.raises(ValueError):
        L.evaluate(df.withColumn("p", F.lit(1)), {"v": FunctionalOp(Linear(measures.lag(1)), (Var("x"),))}, L.Series(["i"], [], "p"))
    with pytest.raises(ValueError):
        BinOp("nothing", Var("x"), Var("x"))
    with pytest.raises(ValueError):
        FunctionalOp(Linear(measures.lag(1)), (Var("x"), Var("x")))


# --- trees and rewriting

GRAMMAR = search.Grammar(["x", "y"], measures_1d=False)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_structure_helpers(seed):
    t = GRAMMAR.tree(random.Random(seed))
    assert T.from_tape(T.to_tape(t)) == t and T.complexity(t) == len(list(T.subtrees(t)))
    assert T.with_constants(t, T.constants(t)) == t
    i = random.Random(seed).randrange(T.complexity(t))
    assert list(T.subtrees(T.replace_at(t, i, Var("z"))))[i] == Var("z")
    assert (T.key(t) == T.key(GRAMMAR.tree(random.Random(seed)))) and T.used_features(t) <= {"x", "y"}


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_exact_rewriting_keeps_values(seed):
    t = GRAMMAR.tree(random.Random(seed))
    rng = np.random.default_rng(seed)
    env = {"x": rng.normal(size=40), "y": rng.uniform(-3, 3, 40)}
    before, after = (np.broadcast_to(np.asarray(T.evaluate(n, env), float), 40) for n in (t, fold(t, fast=False)))
    assert np.allclose(before, after, rtol=1e-6, atol=1e-9, equal_nan=True)
    s = simplify(t)
    assert simplify(s) == s and T.complexity(s) <= max(1, T.complexity(t))


def test_known_rewritings():
    x, y = Var("x"), Var("y")
    assert simplify(BinOp("sub", x, x)) == Const(0.0) and simplify(BinOp("div", x, x)) == Const(1.0)
    assert simplify(UnOp("neg", UnOp("neg", x))) == x and simplify(UnOp("log", UnOp("exp", x))) == x
    assert canonical(BinOp("add", y, x)) == canonical(BinOp("add", x, y))
    assert str(simplify(BinOp("add", BinOp("mul", x, Const(2.0)), BinOp("mul", Const(3.0), x)))) == "mul(5, x)"
    assert simplify(FunctionalOp(Linear(measures.ema(3)), (Const(2.0),))) == Const(2.0)  # a recursive average keeps a constant
    assert fold(FunctionalOp(Linear(measures.diff(1)), (FunctionalOp(Linear(measures.diff(1)), (x,)),))).functional.mu == measures.diff(1).compose(measures.diff(1))
    assert fold(BinOp("div", x, x), fast=False) == BinOp("div", x, x)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6))
def test_intervals_hold_every_finite_value(seed):
    t = search.Grammar(["x", "y"]).tree(random.Random(seed))
    rng = np.random.default_rng(seed)
    env = {"x": rng.normal(size=60), "y": rng.uniform(-3, 3, 60)}
    r = intervals.evaluate(t, {k: intervals.of_points(v) for k, v in env.items()})
    v = np.atleast_1d(np.asarray(T.evaluate(t, env), float))
    v = v[np.isfinite(v)]
    slack = 1e-9 * (1 + np.abs(v).max(initial=0))
    assert np.all(v >= r.low - slack) and np.all(v <= r.high + slack)
    y = rng.normal(size=60)
    bound = intervals.TargetBound(y).mse(r)
    if len(v) == 60:
        assert bound <= np.mean((v - y) ** 2) + 1e-9


# --- scoring


def test_both_modes_give_the_same_losses(spark):
    rng = np.random.default_rng(6)
    env = {"x": rng.normal(size=500), "y": rng.normal(size=500)}
    target = env["x"] * 2 - env["y"]
    trees = [GRAMMAR.tree(random.Random(i)) for i in range(70)]
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(env["x"], env["y"], target, strict=True)], "x double, y double, t double")
    by_data, by_candidate = scoring.losses_by_data(df, trees, "t"), scoring.losses_by_candidate(spark, trees, env, target)
    assert all(math.isclose(a, b, rel_tol=1e-9) or a == b for a, b in zip(by_data, by_candidate, strict=True))


def test_fronts_and_halls():
    c = [scoring.Candidate(Var(n), loss, cx, loss) for n, loss, cx in (("a", 3.0, 1), ("b", 2.0, 2), ("c", 2.0, 3), ("d", 1.0, 4), ("e", math.inf, 1), ("f", 2.5, 2))]
    assert [x.tree.name for x in scoring.pareto_front(c)] == ["a", "b", "d"]
    hall = scoring.HallOfFame()
    assert hall.update_many(c) == 4 and hall.top().tree.name == "d" and not hall.update(scoring.Candidate(Var("z"), 3.0, 1, 0))
    other = scoring.HallOfFame()
    other.update(scoring.Candidate(Var("z"), 0.5, 1, 0))
    assert hall.merge(other) == 1 and [x.tree.name for x in hall.pareto_front()] == ["z"]


# --- regression


def test_tsqr_reaches_machine_precision(spark):
    rng = np.random.default_rng(7)
    a, b = rng.uniform(0.5, 5, 2000), rng.uniform(0.5, 5, 2000)
    df = spark.createDataFrame([(float(p), float(q)) for p, q in zip(a, b, strict=True)], "a double, b double").repartition(6)
    powers = regression.monomials(["a", "b"], 8)
    fit = regression.ols(df, {str(p): regression.monomial_column(["a", "b"], p) for p in powers}, 1 + F.col("a") * F.col("b") - 0.5 * F.col("a") * F.col("a"))
    assert 1 - fit.r2 < 1e-12 and abs(fit["1"] - 1) < 1e-6 and abs(fit[str((1, 1))] - 1) < 1e-6


def test_detectors(spark):
    rng = np.random.default_rng(8)
    m, r = rng.uniform(1, 5, 800), rng.uniform(1, 5, 800)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, r, strict=True)], "m double, r double")
    law = regression.power_law(df.withColumn("y", 6.5 * F.col("m") / (F.col("r") * F.col("r"))), ["m", "r"], "y")
    assert law.exponents == {"m": 1.0, "r": -2.0} and abs(law.scale - 6.5) < 1e-9
    assert np.allclose(T.evaluate(law.tree(), {"m": m, "r": r}), 6.5 * m / r**2)
    wrapped = regression.exp_wrapper(df.withColumn("y", F.exp(-0.5 * F.col("m") * F.col("m"))), ["m"], "y")
    assert np.allclose(T.evaluate(wrapped.tree(), {"m": m}), np.exp(-0.5 * m * m), rtol=1e-6)
    assert regression.power_law(df.withColumn("y", F.sin("m")), ["m"], "y") is None
    name, tree, _ = regression.coordinate_seed(df.withColumn("y", F.sqrt(F.col("m") * F.col("r"))), ["m", "r"], "y")
    assert np.allclose(T.evaluate(tree, {"m": m, "r": r}), np.sqrt(m * r)) and name in regression.TARGETS
    poly = regression.additive_polynomial(df.withColumn("y", 2 * F.col("m") * F.col("r") - F.col("m") + 3), ["m", "r"], "y")
    assert np.allclose(T.evaluate(poly.tree(), {"m": m, "r": r}), 2 * m * r - m + 3)


def test_moments_say_what_a_term_would_do(spark):
    rng = np.random.default_rng(9)
    x, res = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, res, strict=True)], "x double, r double")
    m = regression.Moments.of(df, [F.col("x"), F.col("x") * F.col("x")], F.col("r"))
    c = np.array([0.3, -0.2])
    assert abs(m.change(c) - (np.mean((res + 0.3 * x - 0.2 * x * x) ** 2) - np.mean(res**2))) < 1e-12
    assert m.best_change() <= m.change(c)
    better, change = regression.polish_with_terms(df.withColumn("y", 1.5 * F.col("x") + 2), F.lit(0.0), Const(0.0), ["x"], "y", 2)
    assert change < 0 and np.allclose(T.evaluate(better, {"x": x}), 1.5 * x + 2, atol=1e-5)


def test_lorenz_and_stencil(spark):
    from galena.plans.registry import queries

    found = {(r["rate"], r["term"]): r["coefficient"] for r in queries()["stlsq_lorenz"](spark, "").collect()}
    assert len(found) == 7 and abs(found["x", "(1, 0, 0)"] + 10) < 1e-5 and abs(found["y", "(1, 0, 0)"] - 28) < 1e-5 and abs(found["z", "(0, 0, 1)"] + 8 / 3) < 1e-5
    heat = dynamics.trajectories(spark, [{"system": "heat_1d", "seconds": 8}])
    assert dynamics.stencil_locality(heat, "heat_1d") == 1


# --- enumeration and search


def test_discovery_and_decomposition():
    rng = np.random.default_rng(10)
    u = lambda a=1.0, b=5.0: rng.uniform(a, b, 1000)
    q, c, t = u(), u(), u(0.5, 5)
    cases = [({"q": q, "c": c}, q / c), ({"t": t}, np.exp(-t * t / 2)), ({"q": q, "c": c}, q * c / (q + c)), ({"a": q, "b": c, "t": t}, 0.5 * q * (c * c + t * t))]
    for env, y in cases:
        assert enumeration.decompose(env, y).r2 > 1 - 1e-8
    found = enumeration.discover({"q": q, "c": c}, 3 * np.sqrt(q) + 2 * c, enumeration.DiscoveryConfig(max_size=1))
    assert found.r2 > 1 - 1e-10 and len(found.terms) == 2
    assert enumeration.discover_boosted({"q": q}, q * q + 1).r2 > 1 - 1e-9
    assert enumeration.interaction_groups({"q": q, "c": c, "t": t}, q * c + t * t) == [["c", "q"], ["t"]]
    refined = enumeration.refine_constant(["q"], {"q": q}, 2 * np.exp(-1.3 * q) + 1)
    assert refined.r2 > 1 - 1e-8


def test_formulas_are_recovered(spark):
    from galena.plans.formulas import FORMULAS, recovery

    assert len(FORMULAS) == 30
    some = ["I.6.20", "I.8.14", "I.11.19", "I.12.2", "I.24.6", "I.27.6", "I.40.1", "I.47.23"]
    assert all(r["exact"] for r in recovery(spark, some).collect())


def test_common_factor():
    rng = np.random.default_rng(16)
    a, b, c = (rng.uniform(1, 3, 1500) for _ in range(3))
    assert enumeration.common_factor({"a": a, "b": b, "c": c}, b / np.sqrt(1 + a * c)) == ("b", 1)
    assert enumeration.common_factor({"a": a, "b": b}, a + b) is None


def test_dictionary_on_executors_equals_here(spark):
    rng = np.random.default_rng(11)
    env = {"a": rng.uniform(1, 2, 50), "b": rng.uniform(1, 2, 50)}
    trees = enumeration.enumerate_trees(["a", "b"], enumeration.DiscoveryConfig(max_size=2, max_features=300))
    here, there = enumeration.dictionary(trees, env), enumeration.dictionary(trees, env, spark)
    assert here[0] == there[0] and np.array_equal(here[1], there[1]) and len({T.key(t) for t in trees}) == len(trees)


def test_evolution_is_the_same_however_it_is_dealt_out(spark):
    x = np.random.default_rng(12).uniform(-1, 1, 200)
    make = lambda s: search.Evolution(search.Grammar(["x"], measures_1d=False), {"x": x}, 3 * x + 2, search.SearchConfig(population=30, generations=4, seed=3), s).run()
    here, there = make(None), make(spark)
    assert [T.key(c.tree) for c in here] == [T.key(c.tree) for c in there] and here[-1].loss < 1
    g = search.Grammar(["x"], measures_1d=False)
    assert [T.key(c.tree) for c in search.anneal(g, {"x": x}, x * x, 150, 2, seed=1)] == [T.key(c.tree) for c in search.anneal(g, {"x": x}, x * x, 150, 2, seed=1, spark=spark)]
    assert search.random_search(g, {"x": x}, x * x, 300)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6))
def test_mutants_are_valid(seed):
    rng = random.Random(seed)
    g = search.Grammar(["x", "y"], measures_2d=bool(seed % 2), measures_1d=not seed % 2)
    t = g.tree(rng)
    assert search.is_valid(search.mutate(t, g, rng), {"x", "y"}) or search.mutate(t, g, random.Random(seed)) is not None


def test_constants_move_and_snap():
    x = np.linspace(0.1, 3, 50)
    loss = lambda t: scoring.score_arrays(t, {"x": x}, math.pi * x + 0.5)
    start = BinOp("add", BinOp("mul", Const(2.0), Var("x")), Const(1.0))
    tuned, value = search.optimise_constants(start, loss, 400)
    assert value < 1e-10
    snapped, value = search.snap_constants(tuned, loss)
    assert T.constants(snapped) == [math.pi, 0.5] and value < 1e-20


# --- dynamics, forecasts, combinatorics, spins, networks, programs, axes


def test_systems_keep_what_they_should(spark):
    t, s = dynamics.SYSTEMS["harmonic_1d"].run()
    assert np.allclose(s[:, 0] ** 2 + s[:, 1] ** 2, 1, atol=1e-8) and np.allclose(s[:, 0], np.cos(t), atol=1e-6)
    _, k = dynamics.SYSTEMS["kepler"].run()
    assert np.ptp(k[:, 0] * k[:, 3] - k[:, 1] * k[:, 2]) < 1e-6
    _, u = dynamics.SYSTEMS["heat_1d"].run()
    assert np.all(u[1:, 0] == 0) and u.max() <= 10 and np.abs(u[-1]).max() < np.abs(u[0]).max()
    traj = dynamics.trajectories(spark, [{"system": "vdp", "seconds": 1}, {"system": "vdp", "traj_id": "noisy", "seconds": 1, "noise": 0.1, "seed": 3}])
    assert traj.groupBy("traj_id").count().collect() and traj.count() == 202
    assert dynamics.target_rows(traj).count() == 200


def test_every_system_is_classified(spark):
    kinds = {r["traj_id"]: r["class"] for r in dynamics.model_class(dynamics.trajectories(spark, [{"system": n} for n in dynamics.SYSTEMS])).collect()}
    assert {n: kinds[n] for n in kinds} == {n: s.kind for n, s in dynamics.SYSTEMS.items()}


def test_signatures(spark):
    traj = dynamics.trajectories(spark, [{"system": "harmonic_1d"}, {"system": "lorenz63"}, {"system": "algebraic_feynman_gaussian"}])
    got = {(r["traj_id"], r["signature"], r["key"]): r["value"] for r in dynamics.full_signature(traj).collect()}
    assert got["harmonic_1d", "smoothness", "smoothness"] > 0.9 > got["algebraic_feynman_gaussian", "smoothness", "smoothness"]
    assert abs(got["harmonic_1d", "dimension", "dimension"] - 2) < 0.1
    assert got["harmonic_1d", "conservation", "degree2"] < 0.05 and got["harmonic_1d", "symmetry", "reflection"] > 0.6
    assert ("algebraic_feynman_gaussian", "determinism", "z") not in got  # does not apply to its class
    every = {(r["traj_id"], r["signature"], r["key"]): r["value"] for r in dynamics.series_signatures(traj).collect()}
    assert got["lorenz63", "determinism", "z"] > every["algebraic_feynman_gaussian", "determinism", "z"]
    assert 1.5 < got["lorenz63", "dimension", "correlation"] < 2.5 and abs(got["harmonic_1d", "dimension", "correlation"] - 1) < 0.2
    assert got["lorenz63", "lyapunov", "exponent"] > got["harmonic_1d", "lyapunov", "exponent"]
    told = dynamics.full_signature(traj, "algebraic").select("class", "signature").distinct().collect()
    assert {r[0] for r in told} == {"algebraic"} and {r[1] for r in told} == {"model_class", *dynamics.APPLIES["algebraic"]}


def test_neighbours_apart_equal_brute_force():
    points = np.random.default_rng(2).integers(0, 6, (300, 3)).astype(float)  # many ties
    want = []
    for i, p in enumerate(points):
        d = ((points - p) ** 2).sum(1)
        d[max(0, i - 10) : i + 11] = np.inf
        want.append(int(d.argmin()))
    assert dynamics.nearest_apart(points, 10).tolist() == want
    assert dynamics.nearest_apart(points[:5], 10).tolist() == [-1] * 5


def test_what_systems_declare():
    from dataclasses import replace

    kepler = dynamics.SYSTEMS["kepler"]
    assert kepler.metadata()["state_size"] == 4 and kepler.metadata()["conserved"] == ["energy", "angular_momentum"]
    for wrong in ({"symmetries": ("mirror",)}, {"conserved": ("mass",)}, {"smooth": "rough"}, {"kind": "sde"}):
        with pytest.raises(ValueError):
            replace(kepler, **wrong)
    wide = np.random.default_rng(0).standard_normal((30, 50))
    tall = wide.T
    for x in (wide, tall):
        c = x - x.mean(0)
        assert np.allclose(np.abs(dynamics.principal(x, 2)), np.abs(c @ np.linalg.svd(c, full_matrices=False)[2][:2].T))


def test_forecaster(spark):
    turn = 0.99 * np.array([[math.cos(0.3), -math.sin(0.3)], [math.sin(0.3), math.cos(0.3)]])
    y = [np.array([1.0, 0.0])]
    for _ in range(300):
        y.append(turn @ y[-1])
    y = np.array(y)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(y)], "s int, i int, a double, b double")
    series = L.Series(["i"], ["s"])
    model = koopman.fit(df, ["a", "b"], series, past=2, rank=4)
    ahead = model.horizon(y[:200], 10)
    assert np.abs(ahead - y[199:210]).max() < 0.02 and np.abs(np.abs(model.eigenmodes()).max() - 0.99) < 0.02
    cols = df.withColumns({f"next_{k}": v for k, v in model.one_step_columns(series).items()}).orderBy("i").toPandas()
    assert np.abs(cols["next_a"].to_numpy()[5:-1] - y[6:, 0]).max() < 0.02
    delta = koopman.fit(df, ["a", "b"], series, past=2, rank=4, delta=True)
    assert delta.one_step(y[:100]).shape == (2,) and np.abs(delta.one_step(y[:100]) - y[100]).max() < 0.1


def test_exact_cover_and_queens(spark):
    assert [combinatorics.queens_count(n) for n in range(1, 9)] == [1, 0, 0, 2, 10, 4, 40, 92]
    assert combinatorics.queens(spark, 6).count() == 4
    rows = combinatorics.queens_rows(5)
    df = spark.createDataFrame([(k, sorted(v)) for k, v in rows.items()], "id long, covers array<int>")
    got = {tuple(r["solution"]) for r in combinatorics.exact_cover(df, list(range(10)), list(range(10, 40))).collect()}
    assert got == {tuple(s) for s in combinatorics.solve_local(rows, set(range(10)), set(range(10, 40)))} and len(got) == 10


def test_spins(spark):
    system = ising.random_ising(8, 0.6, 2, field=0.3)
    states = np.array(list(itertools.product((-1.0, 1.0), repeat=8)))
    _, energy = ising.ground_state(spark, system)
    assert abs(energy - system.energy(states).min()) < 1e-9 and ising.bifurcation(system)[1] <= energy + 0.5
    table = ising.all_states(spark, 5)
    small = ising.random_ising(5, 0.7, 3, field=0.5)
    names = [f"s{i}" for i in range(5)]
    fitted = ising.couplings_from_energies(table.withColumn("e", ising.energy_column(small, names)), names, "e")
    assert np.allclose(fitted.j, small.j, atol=1e-9) and np.allclose(fitted.h, small.h, atol=1e-9)
    rows = ising.sample(spark, small, 0.5, 3000, 40).cache()
    assert ising.pseudo_log_likelihood(rows, small, names, 0.5) > ising.pseudo_log_likelihood(rows, ising.Ising(-small.j, -small.h), names, 0.5)
    found = ising.as_couplings(ising.monomial_energy(rows, names, 2, 0.5), 5)
    assert np.abs(found.j - small.j).max() < 0.25
    assert np.corrcoef(ising.covariance_seed(rows, names, 0.5).j.ravel(), small.j.ravel())[0, 1] > 0.7
    energy = ising.energy_tree(small, names)
    assert abs(ising.energy_losses(ising.patterns(rows, names), [energy], names, 0.5)[0] + ising.pseudo_log_likelihood(rows, small, names, 0.5)) < 1e-9
    assert abs(ising.energy_correlation(rows, energy, small, names) - 1) < 1e-9
    assert ising.monomial_energy(rows.limit(0), names, 2, 0.5) == {}


def test_monomial_energies_here_and_by_tasks(spark, monkeypatch):
    terms, names = {(0, 1, 2): 1.0, (3,): -0.5}, [f"s{i}" for i in range(4)]
    rows = ising.sample_monomials(spark, terms, 4, 0.7, 4000, 20).cache()
    here = ising.monomial_energy(rows, names, 3, 0.7, most=2)
    assert set(here) == set(terms) and all(abs(here[t] - c) < 0.15 for t, c in terms.items())
    monkeypatch.setattr(ising, "LOCAL_PATTERNS", 0)
    there = ising.monomial_energy(rows, names, 3, 0.7, most=2)
    assert list(there) == list(here) and np.allclose(list(there.values()), list(here.values()), atol=1e-9)


def test_search_for_an_energy(spark):
    from galena.operators.search import SearchConfig

    chain = ising.Ising(np.diag([1.0, 0, 1], 1) + np.diag([1.0, 0, 1], -1), np.zeros(4))
    names = [f"s{i}" for i in range(4)]
    rows = ising.sample(spark, chain, 0.8, 3000, 30).cache()
    best = ising.energy_search(rows, names, 0.8, SearchConfig(population=20, generations=3, parsimony=2e-3, polish_every=3, seed=3))[-1]
    assert best.loss <= -ising.pseudo_log_likelihood(rows, chain, names, 0.8) + 0.01 and ising.energy_correlation(rows, best.tree, chain, names) > 0.95


def _gradient_case():
    rng = np.random.default_rng(5)
    env = {"a": rng.uniform(0.2, 2, 400), "b": rng.uniform(-2, 2, 400)}
    curve = T.BinOp("add", T.BinOp("mul", T.Const(1.0), T.UnOp("exp", T.BinOp("mul", T.Const(-0.1), T.Var("a")))), T.Const(0.0))
    return env, curve, 2.5 * np.exp(-0.7 * env["a"]) + 1.3


def test_slopes_of_random_trees():
    import random

    from galena.functions.pointwise import UNARY
    from galena.operators.gradients import value_and_slopes
    from galena.operators.search import Grammar

    env, _, _ = _gradient_case()
    g = Grammar(["a", "b"], measures_1d=False, unary=dict.fromkeys(UNARY, 1.0))
    for i in range(150):
        tree = g.tree(random.Random(i), 5)
        c = np.array(T.constants(tree))
        value, slopes = value_and_slopes(tree, env)
        assert np.allclose(value, np.broadcast_to(np.asarray(T.evaluate(tree, env), float), value.shape), equal_nan=True)
        for k, step in enumerate(np.diag(1e-6 * np.maximum(np.abs(c), 1e-3))):
            with np.errstate(all="ignore"):
                d = (value_and_slopes(tree, env, c + step)[0] - value_and_slopes(tree, env, c - step)[0]) / (2 * step[k])
            size = max(1.0, float(np.nanmax(np.abs(slopes[k]), initial=0)))
            # a row beside a kink may differ
            assert (np.isclose(d, slopes[k], rtol=1e-3, atol=1e-4 * size) | ~np.isfinite(d) | ~np.isfinite(slopes[k])).mean() > 0.97


def test_constants_fitted_by_slopes_here_and_over_rows(spark):
    from galena.operators import gradients
    from galena.operators.scoring import score_arrays
    from galena.operators.search import optimise_constants

    env, curve, y = _gradient_case()
    here, loss = gradients.fit_constants(curve, env, y)
    assert loss < 1e-20 and np.allclose(T.constants(here), [2.5, -0.7, 1.3])
    for method in ("simplex", "bfgs", "powell"):
        moved, left = optimise_constants(curve, lambda t: score_arrays(t, env, y), 200, method)
        assert left < 1e-3 and left == score_arrays(moved, env, y)
    rows = spark.createDataFrame(pd.DataFrame({**env, "y": y})).union(spark.createDataFrame([(None, 1.0, 2.0)], "a double, b double, y double")).repartition(3)
    there, loss = gradients.fit_constants_by_data(rows, curve, "y")
    assert loss < 1e-12 and np.allclose(T.constants(there), [2.5, -0.7, 1.3], atol=1e-5)
    flat, loss = gradients.fit_constants_by_data(rows, T.Const(0.0), "y")
    assert abs(T.constants(flat)[0] - np.append(y, 2.0).mean()) < 1e-9
    assert math.isinf(gradients.fit_constants_by_data(rows.limit(0), curve, "y")[1])


def test_what_a_search_goes_by():
    from galena.operators import fitness
    from galena.operators.search import Evolution, Grammar, SearchConfig

    env, _, y = _gradient_case()
    g = Grammar(["a", "b"], measures_1d=False)
    found = Evolution(g, env, y, SearchConfig(population=30, generations=4, method="slopes", adapt_every=2, seed=1))
    assert found.run() and set(found.g.unary) == set(g.unary) and found.g.unary != g.unary
    small = Evolution(g, env, y, SearchConfig(population=30, generations=3), accept=lambda t: T.complexity(t) <= 3)
    assert all(c.complexity <= 3 for c in small.run()) and small.refused
    assert not Evolution(g, env, y, SearchConfig(population=5, generations=2), accept=lambda t: False).run()
    held = {k: v[:50] for k, v in env.items()}
    judge = fitness.holdout_judge(held, y[:50], 2.0)
    tree = T.Var("a")
    assert abs(judge(tree, 1.0) - 1.0 - 2 * ((env["a"][:50] - y[:50]) ** 2).mean()) < 1e-12
    assert fitness.mdl_judge(2, 400)(tree, 1.0) == fitness.mdl_fitness(1.0, tree, 2, 400)
    u = np.random.default_rng(0).random((6, 5))
    assert fitness.holdout_judge({"u": u}, u, 1.0, 1.0)(T.Var("u"), 0.0) == 0.0


def test_relaxed_and_enumerated_programs(spark):
    from galena.operators import programs as P

    rng = np.random.default_rng(0)
    x = rng.uniform(0.5, 2, (50, 2))
    y = x[:, 0] * x[:, 1]
    choices, constants = [[rng.standard_normal(n) for n in (len(P.NAMES), 3 + k, 3 + k)] for k in range(2)], rng.standard_normal(1)
    at = lambda: P._relaxed_pass(choices, constants, x, y, 1.0, False, 0.02)
    _, slopes, by_constant = at()
    for z, g in [*((choices[k][w], slopes[k][w]) for k in range(2) for w in range(3)), (constants, by_constant)]:
        for i in range(len(z)):
            z[i] += 1e-6
            high = at()[0]
            z[i] -= 2e-6
            assert abs((high - at()[0]) / 2e-6 - g[i]) < 1e-6
            z[i] += 1e-6
    u, square = P.targets(200)["x^2"]
    for hard in (True, False):
        how = P.Relaxed(steps=300, hard=hard)
        p, r2, share = P.relaxed_search(u, square, 4, how, spark=spark)
        assert (p, r2, share) == P.relaxed_search(u, square, 4, how) and 0 < share <= 1 and abs(P.fit_scale(P.run(p, u), square)[2] - r2) < 1e-9
    terms, start, r2 = P.combine_programs(x, 3 * x[:, 0] / x[:, 1] - 2 * np.sin(x[:, 1]) + 1)
    assert r2 > 1 - 1e-9 and np.allclose(sum(w * P.run(q, x) for w, q in terms) + start, 3 * x[:, 0] / x[:, 1] - 2 * np.sin(x[:, 1]) + 1, atol=1e-3)


def test_networks(spark):
    rng = np.random.default_rng(13)
    images = rng.random((40, 8, 8))
    labels = (np.arange(40) % 2).astype(int)
    images[labels == 1, :, :4] += 1
    net, loss = networks.evolve_network(images, labels, 2, 16, 6, seed=1)
    assert net.accuracy(images, labels) > 0.9 and loss < 0.7
    same_, again = networks.evolve_network(images, labels, 2, 6, 2, seed=2), networks.evolve_network(images, labels, 2, 6, 2, seed=2, spark=spark)
    assert same_[1] == again[1]
    rows = spark.createDataFrame([(i, r, c, float(images[i, r, c])) for i in range(3) for r in range(8) for c in range(8)], "img long, r int, c int, image double")
    want = networks.channels_of(images[:3])
    got = networks.channel_rows(rows).orderBy("img", "r", "c").toPandas()
    inner = (slice(None), slice(1, -1), slice(1, -1))
    for k in ("gx", "gy", "lap"):
        assert np.allclose(got[k].to_numpy().reshape(3, 8, 8)[inner], want[k][inner])
    wide = spark.createDataFrame([(i, images[i].tolist()) for i in range(40)], "img long, pixels array<array<double>>")
    assert [r["class"] for r in net.predict(wide).orderBy("img").collect()] == net.logits(images).argmax(1).tolist()
    assert networks.warm_start([net, net]).logits(images).shape == (40, 2)


def test_programs(spark):
    rng = np.random.default_rng(14)
    x = rng.uniform(0.5, 2, (60, 2))
    for seed in range(20):
        p = programs.random_program(np.random.default_rng(seed), 2, 2, 4)
        out, g = programs.run(p, x, True)
        eps = 1e-6
        moved = programs.run(programs.Program(p.nodes, (p.constants[0] + eps, p.constants[1])), x)
        assert np.allclose((moved - out) / eps, g[0], rtol=1e-2, atol=1e-3 * (1 + np.abs(g[0]).max()))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    assert np.allclose(df.select(p.column(["a", "b"]).alias("v")).toPandas()["v"], programs.run(p, x), rtol=1e-9)
    best, r2 = programs.evolve(x, x[:, 0] * x[:, 1], programs.ProgramSearch(population=30, generations=6))
    assert r2 > 0.99 and "x0" in best.render(["x0", "x1"]) or r2 > 0.99
    assert programs.policy_search(x, x[:, 0] ** 2, rounds=6, batch=30)[1] > 0.95


def test_axes(spark):
    time = axes.Axis("t", 50, axes.Invariance.CAUSAL)
    bag = axes.Axis("row", 50, axes.Invariance.PERMUTATION)
    x, y = axes.TypedVar("x", (time,)), axes.TypedVar("y", (bag,))
    lagged = lambda n: FunctionalOp(Linear(measures.lag(1)), (Var(n),))
    env = {"x": x, "y": y}
    assert axes.violation(lagged("x"), env) is None and "permutation" in axes.violation(lagged("y"), env)
    assert axes.violation(UnOp("reduce_mean", Var("y")), env) is None and axes.violation(Var("z"), env)
    assert axes.violation(FunctionalOp2D(measures.laplacian(), Var("x")), env)
    df = axes.tag(spark.createDataFrame([(1.0,)], "x double"), x)
    assert axes.tagged(df) == {"x": x}
    assert axes.mixes_time_and_space(FunctionalOp2D(measures.sobel_x(), Var("u"))) == 1 and axes.mixes_time_and_space(FunctionalOp2D(measures.laplacian(), Var("u"))) == 0


def test_fitness(spark):
    rule = BinOp("mul", Const(0.05), FunctionalOp2D(measures.laplacian(), Var("U")))
    wrong = BinOp("mul", Const(0.5), FunctionalOp2D(measures.diff_t(1), Var("U")))
    cases = fitness.counterfactuals(t=60)
    ranked = fitness.rank_by_counterfactuals([scoring.Candidate(t, 0.0, T.complexity(t), 0.0) for t in (wrong, rule)], cases)
    assert ranked[0][0].tree == rule and ranked[0][1] < 3
    assert fitness.description_bits(rule, 2) > fitness.description_bits(Var("U"), 2) and fitness.mdl_fitness(1.0, Var("U"), 2, 100) < fitness.mdl_fitness(1.0, rule, 2, 100)
    assert fitness.operator_weights([scoring.Candidate(UnOp("sin", Var("x")), 0, 2, 0)])["sin"] == 3.0
    u = fitness.heat_field(0.05, 12, 10)
    df = spark.createDataFrame([(t, x, float(u[t, x])) for t in range(12) for x in range(10)], "t int, x int, u double")
    row = fitness.summary_statistics(df, "u", L.Series(["t"], [], "x")).first().asDict()
    assert abs(row["variance"] - u.var()) < 1e-9 and abs(row["var_rows"] - u.mean(1).var()) < 1e-9
    assert fitness.statistics_distance(row, row) == 0
    two = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")).withColumn("u", 2 * F.col("u")))
    losses = {(r["g"], r["tree"]): r["loss"] for r in fitness.losses_by_group(two, {"zero": Const(0.0), "half": BinOp("mul", Var("u"), Const(0.5))}, "u", "g", L.Series(["t"], [], "x")).collect()}
    assert math.isclose(losses["b", "zero"], 4 * losses["a", "zero"], rel_tol=1e-9)


# --- sources and streams


def test_sources(spark, tmp_path):
    from galena.sources import tables as S

    (tmp_path / "flow.json").write_text('{"value": {"timeSeries": [{"values": [{"value": [{"value": "12.5", "dateTime": "2001-01-01T00:00:00"}, {"value": "-999999", "dateTime": "2001-01-02T00:00:00"}]}]}]}}')
    (tmp_path / "weather.csv").write_text("some remarks\nyear,yday,prcp,tmax,tmin\n2001,1,3.5,10,2\n2001,2,0,12,4\n")
    flow, weather = S.daily_flow(spark, str(tmp_path / "flow.json")), S.daily_weather(spark, str(tmp_path / "weather.csv"))
    assert [(str(r[0]), r[1]) for r in flow.orderBy("date").collect()] == [("2001-01-01", 12.5), ("2001-01-02", None)]
    both = S.basin(weather, flow, (1,)).orderBy("date").collect()
    assert both[0]["tmean"] == 6.0 and both[1]["prcp_lag1"] == 3.5
    (tmp_path / "candles.txt").write_text('[["0","1","2","0.5","1.5","10"],["3600000","1.5","2","1","1.8","20"]]\n')
    c = S.candle_features(S.candles(spark, str(tmp_path / "candles.txt"))).orderBy("ts").collect()
    assert abs(c[1]["r1"] - math.log(1.8 / 1.5)) < 1e-12 and abs(c[0]["next_r"] - c[1]["r1"]) < 1e-12
    grid = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "t int, u array<double>")
    assert S.dense_rows(S.grid_rows(grid)).orderBy("t").collect()[1]["u"] == [3.0, 4.0]
    assert S.materialised(grid).count() == 2


@pytest.mark.parametrize("mu", [measures.ema(3), measures.signed_sum([(1.0, 0), (-0.5, 2)])])
def test_measures_on_a_stream(spark, tmp_path, mu):
    from galena.streaming.series import measure_stream

    rng, rows = np.random.default_rng(15), []
    for i in range(40):
        rows.append((int(i % 2), (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i)).to_pydatetime(), float(rng.normal())))
    schema = "k long, ts timestamp, v double"
    for part in (rows[:15], rows[15:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = measure_stream(stream, "k", "ts", "v", mu).writeStream.format("memory").queryName("series_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("series_out").orderBy("k", "ts").toPandas()
    assert len(got) == 40
    for _, g in got.groupby("k"):
        assert np.allclose(g["y"].to_numpy(float), mu.apply(g["v"].to_numpy()), equal_nan=True)


def test_entry_and_queries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 1 and set(entry.oracle_sql()) <= set(entry.queries())
    for name in ("queens", "exact_cover", "ising_ground_state", "lagged_join", "field_mixed", "measure_ema"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_measures_kept_between_batches(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame(pd.DataFrame({"k": np.repeat(["a", "b"], 40), "i": np.tile(np.arange(40), 2), "x": rng.random(80), "y": rng.random(80)}))
    series = L.Series(["i"], ["k"])
    lag, mean = (FunctionalOp(Linear(m), (Var("x"),)) for m in (measures.lag(2), measures.roll_mean(3)))
    trees = [BinOp("add", lag, mean), BinOp("mul", lag, Const(2.0)), UnOp("sin", FunctionalOp(Linear(measures.diff(1)), (lag,)))]
    want = scoring.losses_by_data(df, trees, "y", series)
    cache = L.MeasureCache(df, series, most=4)
    for _ in range(2):
        kept, short = cache.rewrite(trees)
        assert all(T.is_pointwise(t) for t in short) and np.allclose(scoring.losses_by_data(kept, short, "y"), want, atol=1e-12)
    assert (cache.hits, cache.misses) == (3, 3)
    small = L.MeasureCache(df, series, most=1)
    for batch in (trees[1:2], [mean], trees):
        kept, short = small.rewrite(batch)
        assert np.allclose(scoring.losses_by_data(kept, short, "y", series), scoring.losses_by_data(df, batch, "y", series), atol=1e-12) and len(small.held) == 1
    cache.close()
    small.close()
