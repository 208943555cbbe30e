"""Terms chosen over all rows against least squares on arrays."""

import itertools

import numpy as np
import pandas as pd
import pytest

from galena.operators import enumeration, selection
from galena.operators import tree as T
from galena.operators.enumeration import DiscoveryConfig
from galena.operators.tree import BinOp, UnOp, Var


def _table(spark, rng, n=4000, parts=5):
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.random(n) + 0.5, "c": rng.normal(size=n) * 3})
    pdf["y"] = 2.5 * pdf.a * pdf.b - 0.75 * np.sin(pdf.c) + 4
    return pdf, spark.createDataFrame(pdf).repartition(parts)


def _gram(spark, rng, trees, noise=0.3):
    pdf, _ = _table(spark, rng)
    pdf["y"] += noise * rng.normal(size=len(pdf))
    df = spark.createDataFrame(pdf).repartition(4)
    rows = selection._rows(df, ["a", "b", "c"], "y")
    columns = selection.survey(rows, ["a", "b", "c"], trees)
    return pdf, selection.Gram(rows, ["a", "b", "c"], columns)


def test_survey_keeps_what_is_finite_varies_and_differs(spark):
    rng = np.random.default_rng(1)
    pdf, df = _table(spark, rng)
    a, b = Var("a"), Var("b")
    trees = [a, b, BinOp("add", a, b), BinOp("add", b, a), BinOp("sub", BinOp("add", a, b), b), UnOp("sin", a), BinOp("div", b, b), BinOp("sub", a, a), UnOp("sqrt", BinOp("mul", b, b)), BinOp("mul", BinOp("mul", UnOp("exp", UnOp("exp", BinOp("mul", a, a))), UnOp("exp", UnOp("exp", b))), b), UnOp("neg", a)]
    kept = selection.survey(selection._rows(df, ["a", "b", "c"], "y"), ["a", "b", "c"], trees)
    want, _ = enumeration.dictionary(trees, {k: pdf[k].to_numpy() for k in "abc"})
    assert kept.trees == want and kept.n == len(pdf) and abs(kept.y_mean - pdf.y.mean()) < 1e-9
    # level within every part, but not over them
    stairs = spark.createDataFrame([(float(i // 100), float(i)) for i in range(400)], "a double, y double").repartitionByRange(4, "a")
    assert selection.survey(selection._rows(stairs, ["a"], "y"), ["a"], [a]).trees == [a]


def test_gains_factors_and_downdates_equal_least_squares(spark):
    rng = np.random.default_rng(2)
    trees = enumeration.enumerate_trees(["a", "b", "c"], DiscoveryConfig(max_size=1))
    pdf, gram = _gram(spark, rng, trees)
    phi = np.array([np.broadcast_to(T.evaluate(t, {k: pdf[k].to_numpy() for k in "abc"}), len(pdf)) for t in gram.columns.trees])
    y = pdf.y.to_numpy()
    total = ((y - y.mean()) ** 2).sum()

    def r2(chosen):
        design = np.column_stack([np.ones(len(y)), *(phi[i] for i in chosen)])
        rest = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return 1 - (rest @ rest) / total

    chosen = [4, 0, 11, 7]
    gram.need(chosen)
    s = selection.Subset(gram)
    for i in chosen:
        gains = s.gains() / gram.total
        for j in (1, 5, 9, 13):
            if j not in s.chosen:
                assert abs(s.explained / gram.total + gains[j] - r2([*s.chosen, j])) < 1e-9
        s = s.plus(i)
        assert abs(s.explained / gram.total - r2(s.chosen)) < 1e-9
    for k in range(4):
        less = s.minus(k)
        assert abs(less.explained / gram.total - r2(less.chosen)) < 1e-9
        assert np.allclose(less.gains() / gram.total + less.explained / gram.total, [r2([*less.chosen, j]) if j not in less.chosen else less.explained / gram.total for j in range(len(phi))], atol=1e-8)
        low = less.u[:, list(less.chosen)]
        assert np.allclose(low, np.triu(low), atol=1e-9)


def test_no_more_passes_than_terms_ask_for(spark):
    rng = np.random.default_rng(3)
    trees = enumeration.enumerate_trees(["a", "b", "c"], DiscoveryConfig(max_size=1))
    _, gram = _gram(spark, rng, trees)
    best = selection.choose(gram, DiscoveryConfig(max_terms=3, beam=6))
    assert gram.passes <= 1 + 3 and len(best.chosen) <= 3


def test_a_needless_term_is_dropped_again(spark):
    """b + c goes best with y alone, but b and c leave nothing for it."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"b": rng.normal(size=3000), "c": rng.normal(size=3000)})
    pdf["y"] = 2 * pdf.b + 3 * pdf.c
    df = spark.createDataFrame(pdf)
    found = selection.discover_by_data(df, ["b", "c"], "y", DiscoveryConfig(max_size=1, max_terms=3, greedy=True, unary=(), binary=("add",)))
    assert found.r2 > 1 - 1e-12 and len(found.terms) <= 2


@pytest.mark.parametrize("greedy", [True, False])
def test_the_law_is_found_over_all_rows_as_on_arrays(spark, greedy):
    rng = np.random.default_rng(5)
    pdf, df = _table(spark, rng)
    config = DiscoveryConfig(max_size=1, max_terms=3, greedy=greedy)
    got = selection.discover_by_data(df, ["a", "b", "c"], "y", config)
    want = enumeration.discover({k: pdf[k].to_numpy() for k in "abc"}, pdf.y.to_numpy(), config)
    assert got.r2 > 1 - 1e-12 and abs(got.constant - 4) < 1e-9
    assert {str(t): round(w, 9) for w, t in got.terms} == {str(t): round(w, 9) for w, t in want.terms} == {"mul(a, b)": 2.5, "sin(c)": -0.75}


def test_rows_that_are_not_finite_and_tables_without_rows(spark):
    rng = np.random.default_rng(6)
    pdf, _ = _table(spark, rng, 500)
    odd = pd.concat([pdf, pd.DataFrame({"a": [np.nan, 1.0, np.inf], "b": [1.0, 1.0, 1.0], "c": [0.0, 0.0, 0.0], "y": [1e6, np.nan, 5.0]})])
    df = spark.createDataFrame(odd)
    assert selection.discover_by_data(df, ["a", "b", "c"], "y", DiscoveryConfig(max_size=1, max_terms=3)).r2 > 1 - 1e-12
    assert selection.discover_by_data(df.limit(0), ["a"], "y").terms == []
    level = spark.createDataFrame([(float(i), 3.0) for i in range(20)], "a double, y double")
    assert selection.discover_by_data(level, ["a"], "y").constant == 3.0


def test_many_columns_in_tiles(spark):
    rng = np.random.default_rng(7)
    trees = enumeration.enumerate_trees(["a", "b", "c"], DiscoveryConfig(max_size=2, max_features=400))
    pdf, gram = _gram(spark, rng, trees)
    wanted = list(range(0, 40))
    before = gram.passes
    gram.need(wanted)
    assert gram.passes - before == -(-40 // selection.TILE)
    env = {k: pdf[k].to_numpy() for k in "abc"}
    for i, j in itertools.product((0, 17, 39), (1, 100, 200)):
        z = [(np.broadcast_to(T.evaluate(gram.columns.trees[k], env), len(pdf)) - gram.columns.means[k]) / gram.columns.peaks[k] for k in (i, j)]
        assert abs(gram.made[i][j] - z[0] @ z[1]) < 1e-8 * len(pdf)
