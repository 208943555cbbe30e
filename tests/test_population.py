"""Populations as one program: canonical order, interned nodes, stacked constants, scorers over tables, searches that hold no rows."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from galena.operators import intervals, measures, scoring
from galena.operators import lowering as L
from galena.operators import tree as T
from galena.operators.measures import Linear
from galena.operators.population import Dag, Population, canonical_key, ordered, topology_key
from galena.operators.search import Evolution, Grammar, SearchConfig
from galena.operators.tree import BinOp, Const, FunctionalOp, UnOp, Var


def _shuffled(node, rng):
    """The tree with operands of commutative operators either way."""
    node = T.with_children(node, tuple(_shuffled(c, rng) for c in T.children(node)))
    return BinOp(node.op, node.b, node.a) if isinstance(node, BinOp) and node.op in ("add", "mul", "min", "max") and rng.random() < 0.5 else node


def _trees(n, seed=0, names=("a", "b")):
    return [Grammar(list(names), measures_1d=False).tree(random.Random(f"{seed}/{i}")) for i in range(n)]


def _pointwise(n, seed=0):
    return [t for t in _trees(3 * n, seed) if T.is_pointwise(t)][:n]


def test_canonical_keys_are_equal_up_to_order_alone():
    rng = random.Random(1)
    trees = _trees(300)
    for t in trees:
        other = _shuffled(t, rng)
        assert canonical_key(t) == canonical_key(other) and ordered(t) == ordered(other) and topology_key(t) == topology_key(other)
        assert ordered(ordered(t)) == ordered(t) and T.complexity(ordered(t)) == T.complexity(t)
        moved = T.with_constants(t, [c + 1 for c in T.constants(t)])
        assert topology_key(moved) == topology_key(t) and (canonical_key(moved) == canonical_key(t)) == (not T.constants(t))
    a, b = Var("a"), Var("b")
    assert canonical_key(BinOp("sub", a, b)) != canonical_key(BinOp("sub", b, a)) and canonical_key(BinOp("div", a, b)) != canonical_key(BinOp("div", b, a))
    mu = FunctionalOp(Linear(measures.lag(2)), (BinOp("add", b, a),))
    assert canonical_key(mu) == canonical_key(FunctionalOp(Linear(measures.lag(2)), (BinOp("add", a, b),)))


def test_interned_nodes_count_their_uses():
    a, b = Var("a"), Var("b")
    s = BinOp("add", a, b)
    dag = Dag()
    roots = [dag.add(ordered(t)) for t in (BinOp("mul", s, UnOp("sin", BinOp("add", b, a))), UnOp("cos", BinOp("add", b, a)), UnOp("sin", s))]
    assert len(dag.nodes) == 6 and len(set(roots)) == 3  # a, b, a + b, sin, product, cos
    (total,) = [i for i, (k, op, _) in enumerate(dag.nodes) if (k, op) == ("bin", "add")]
    assert dag.uses[total] == 3 and total in dag.shared() and all(max(args, default=-1) < i for i, (_, _, args) in enumerate(dag.nodes))


@pytest.mark.parametrize("stack", [True, False])
def test_population_equals_tree_by_tree(stack):
    rng = np.random.default_rng(2)
    env = {"a": rng.normal(size=700), "b": np.where(rng.random(700) < 0.05, np.nan, rng.normal(size=700))}
    trees = _pointwise(150) + [BinOp("add", BinOp("mul", Const(float(c)), Var("a")), Const(float(d))) for c, d in itertools.product(range(7), range(5))] + [Const(2.0), Var("b")]
    trees += [_shuffled(t, random.Random(3)) for t in trees[:40]]
    made = Population(trees, stack)
    got = made.predictions(env)
    for row, t in zip(got, trees, strict=True):
        assert np.allclose(row, np.broadcast_to(np.asarray(T.evaluate(t, env), float), 700), rtol=1e-12, equal_nan=True)
    assert made.distinct < len(trees) and made.topologies < made.distinct


def test_a_topology_is_evaluated_together_and_what_has_no_constant_once():
    inner = UnOp("sin", BinOp("mul", Var("a"), Var("b")))
    trees = [BinOp("add", inner, BinOp("mul", Const(float(c)), UnOp("cos", Var("a")))) for c in range(16)]
    made = Population(trees)
    kinds = [(k, w) for k, w, _ in made.dag.nodes]
    assert made.topologies == 1 and len(made.roots) == 2 and kinds.count(("un", "sin")) == kinds.count(("un", "cos")) == 1 and kinds.count(("bin", "add")) == 2
    assert len([k for k, _ in kinds if k == "const"]) == 0


def test_values_are_given_back_after_their_last_use():
    trees = [UnOp("sin", UnOp("cos", BinOp("add", Var("a"), Const(float(i))))) for i in range(200)]
    assert Population(trees, stack=False)._most_held() <= 4


def test_losses_by_topology_equal_losses_tree_by_tree(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.normal(size=5000), "b": rng.normal(size=5000)})
    pdf["y"] = np.where(rng.random(5000) < 0.01, np.nan, pdf["a"] * 2)
    pdf.loc[7, "a"] = np.inf
    trees = _trees(60, 5) + [BinOp("mul", Const(float(c)), Var("a")) for c in range(9)] + [UnOp("reduce_mean", Var("b")), BinOp("div", Var("a"), UnOp("reduce_std", Var("b")))]
    df = spark.createDataFrame(pdf).repartition(3)
    got = scoring.losses_by_data(df, trees, "y")
    want = [scoring.score_arrays(t, {k: pdf[k].to_numpy() for k in "ab"}, pdf["y"].to_numpy()) for t in trees]
    assert np.allclose(got, want, rtol=1e-9)


def test_scorer_over_a_table_makes_columns_once(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 200), "i": np.tile(np.arange(200), 2), "x": rng.random(400)})
    pdf["y"] = pdf["x"] * 3
    df, series = spark.createDataFrame(pdf), L.Series(["i"], ["k"])
    lag = FunctionalOp(Linear(measures.lag(2)), (BinOp("add", Var("x"), Var("y")),))
    turned = FunctionalOp(Linear(measures.lag(2)), (BinOp("add", Var("y"), Var("x")),))
    scorer = scoring.DataScorer(df, "y", series)
    first = [BinOp("add", lag, Var("x")), BinOp("mul", turned, Const(2.0)), BinOp("add", Var("x"), turned)]
    assert np.allclose(scorer(first), scoring.losses_by_data(df, first, "y", series))
    assert (scorer.asked, scorer.scored, scorer.columns) == (3, 2, 1)  # the third is the first, both measures are one column
    second = [UnOp("sin", lag), first[1]]
    assert np.allclose(scorer(second), scoring.losses_by_data(df, second, "y", series))
    assert (scorer.asked, scorer.scored, scorer.columns, scorer.cache.hits) == (5, 3, 1, 1)
    scorer.close()


def test_table_bounds_never_pass_the_exact_ones(spark):
    rng = np.random.default_rng(9)
    y = np.concatenate([rng.normal(size=3000) * 5, np.full(500, 2.0), [np.nan, np.inf]])
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    exact, table = intervals.TargetBound(y), intervals.TableBound(df, "y", 64)
    close = 0
    for _ in range(300):
        low, high = sorted(rng.normal(size=2) * 8)
        r = intervals.Interval(low, high)
        assert table.mse(r) <= exact.mse(r) + 1e-9
        close += table.mse(r) > 0.9 * exact.mse(r) > 0
    assert close > 100
    assert table.mse(intervals.EVERYTHING) == 0 and intervals.TableBound(df.limit(0), "y").mse(intervals.Interval(0, 1)) == 0


def test_search_on_a_table_holds_no_rows_and_prunes_rightly(spark):
    """The target lies outside what a sample of the first rows shows: bounds from all rows keep the tree that reaches it."""
    x = np.concatenate([np.linspace(0, 1, 400), np.linspace(50, 60, 40)])
    df = spark.createDataFrame([(float(v), float(3 * v + 1)) for v in x], "x double, y double").repartition(3)
    start = BinOp("add", BinOp("mul", Const(2.0), Var("x")), Const(0.5))
    search = Evolution.on_table(Grammar(["x"], measures_1d=False), df, "y", SearchConfig(population=12, generations=2, seeds=[start, Const(5.0)], seed=3))
    front = search.run()
    assert front[-1].loss < 1e-12 and search.env == {} and search.y.size == 0
    assert search.score.scored <= search.score.asked
    free = Evolution.on_table(Grammar(["x"], measures_1d=False), df, "y", SearchConfig(population=12, generations=2, seeds=[start, Const(5.0)], seed=3, prune=False))
    assert [c.loss for c in free.run()] == pytest.approx([c.loss for c in front], abs=1e-9)
    search.score.close()
    free.score.close()


def test_terms_from_sums_over_all_rows_extend_the_best(spark):
    """Sums of powers over all rows know what would help; the longer tree is scored like any other."""
    x = np.linspace(-1, 2, 500)
    df = spark.createDataFrame([(float(v), float(np.sin(3 * v) + 0.5 * v**3 - 2)) for v in x], "x double, y double").repartition(3)
    config = SearchConfig(population=4, generations=1, polish_every=1, snap=False, seeds=[UnOp("sin", BinOp("mul", Const(3.0), Var("x")))], seed=2)
    plain = Evolution.on_table(Grammar(["x"], measures_1d=False), df, "y", config)
    longer = Evolution.on_table(Grammar(["x"], measures_1d=False), df, "y", config, terms=2)
    without, found = plain.run()[-1], longer.run()[-1]
    assert found.loss < 0.9 * without.loss and found.complexity > without.complexity
    assert abs(found.loss - scoring.score_arrays(found.tree, {"x": x}, np.sin(3 * x) + 0.5 * x**3 - 2)) < 1e-9
    plain.score.close()
    longer.score.close()
