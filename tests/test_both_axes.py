"""Trees over fields in which measures name their axis, beside stencils."""

import random

import numpy as np
import pytest

from galena.operators import axes, measures, simplify
from galena.operators import lowering as L
from galena.operators import tree as T
from galena.operators.measures import Linear, SeparableBilinear, Volterra2
from galena.operators.search import Grammar, mutate
from galena.operators.tree import BinOp, FunctionalOp, FunctionalOp2D, UnOp, Var

U = Var("u")


@pytest.fixture(scope="module")
def grid(spark):
    u = np.random.default_rng(1).normal(size=(120, 9))
    return u, spark.createDataFrame([(t, x, float(u[t, x])) for t in range(120) for x in range(9)], "t long, x long, u double").repartition(5)


def _along(mu, axis, arg=U):
    return FunctionalOp(Linear(mu, axis), (arg,))


TREES = {
    "lags": BinOp("add", _along(measures.lag(2), "time"), _along(measures.diff(1), "space")),
    "nested": _along(measures.roll_mean(3), "time", FunctionalOp2D(measures.laplacian(), U)),
    "average": _along(measures.ema(4), "time", _along(measures.lag(1), "space")),
    "long": _along(measures.power_law(5, 1.5, 80), "time"),
    "pair": FunctionalOp(SeparableBilinear(measures.lag(1), measures.diff(2), "time"), (U, UnOp("sin", U))),
    "square": FunctionalOp(Volterra2(measures.diff(1), measures.lag(1), "space"), (U,)),
    "stencil": FunctionalOp2D(measures.diff_t(1), _along(measures.ema(2), "time")),
}


def test_lowered_trees_equal_memory(grid):
    u, df = grid
    got = L.evaluate(df, TREES, L.Series(["t"], [], "x"), fill=0.0, keep=["t", "x"]).toPandas().sort_values(["t", "x"])
    for name, tree in TREES.items():
        assert np.allclose(got[name].to_numpy(float).reshape(u.shape), T.evaluate(tree, {"u": u}, 0.0)), name


def test_axes_are_checked_before_a_plan(grid, spark):
    _, df = grid
    field = L.Series(["t"], [], "x")
    with pytest.raises(ValueError, match="needs an axis"):
        L.evaluate(df, {"v": _along(measures.lag(1), None)}, field)
    with pytest.raises(ValueError, match="no axis of space"):
        L.evaluate(df, {"v": _along(measures.lag(1), "space")}, L.Series(["t"], ["x"]))
    typed = {"u": axes.TypedVar("u", (axes.Axis("t", 9, axes.Invariance("causal_translation")), axes.Axis("x", 5, axes.Invariance("permutation"))))}
    assert axes.violation(_along(measures.lag(1), "time"), typed) is None
    assert "permutation" in axes.violation(_along(measures.lag(1), "space"), typed)
    assert axes.violation(_along(measures.lag(1), None), typed) == "a one-dimensional measure on 2 axes"


def test_only_measures_of_one_axis_become_one():
    same = _along(measures.lag(1), "time", _along(measures.diff(1), "time"))
    other = _along(measures.lag(1), "time", _along(measures.diff(1), "space"))
    made = simplify.fold(same)
    assert made.functional.axis == "time" and made.args == (U,) and simplify.fold(other) == other


def test_the_grammar_mixes_both_and_mutation_keeps_axes():
    g = Grammar(["u"], measures_1d=True, measures_2d=True)
    trees = [g.tree(random.Random(i)) for i in range(400)]
    kinds = [n for t in trees for n in T.subtrees(t)]
    along = [n.functional.axis for n in kinds if isinstance(n, FunctionalOp)]
    assert any(isinstance(n, FunctionalOp2D) for n in kinds) and set(along) == {"time", "space"}
    assert any({type(n) for n in T.subtrees(t)} >= {FunctionalOp, FunctionalOp2D} for t in trees)
    for i, t in enumerate(trees[:150]):
        assert all(n.functional.axis for n in T.subtrees(mutate(t, g, random.Random(i))) if isinstance(n, FunctionalOp))
    only = [n for i in range(100) for n in T.subtrees(Grammar(["u"]).tree(random.Random(i))) if isinstance(n, FunctionalOp)]
    assert {n.functional.axis for n in only} == {None}
