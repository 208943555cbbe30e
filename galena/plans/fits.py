"""Queries of fitted constants, spin energies, smooth operators, and trajectories, each with SQL for the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galena.operators.tree import BinOp, Const, UnOp, Var, constants
from galena.plans.algebra import BASE, rows_of
from galena.plans.registry import _USERS, FIELD_SQL, W, field, query, user_trajectories
from galena.sources.tables import table

# --- constants over all rows


@query("constants_by_data", "SELECT round(regr_slope(l_extendedprice / 1000, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) AS intercept, round((1 - regr_r2(l_extendedprice / 1000, l_quantity)) * var_pop(l_extendedprice / 1000), 4) AS loss FROM lineitem")
def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.gradients import fit_constants_by_data

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"), (F.col("l_extendedprice") / 1000).alias("y"))
    tree, loss = fit_constants_by_data(rows, BinOp("add", BinOp("mul", Const(1.0), Var("q")), Const(0.0)), "y")
    return spark.createDataFrame([(*(round(c, 4) for c in constants(tree)), round(loss, 4))], "slope double, intercept double, loss double")


@query("constants_curve", "SELECT * FROM (VALUES ('scale', 2.5::DOUBLE), ('rate', -0.7::DOUBLE), ('start', 1.3::DOUBLE)) t(name, value)")
def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exponential law read back from its values on all rows."""
    from galena.operators.gradients import fit_constants_by_data

    rows = rows_of(spark, sf_dir).withColumn("y", 2.5 * F.exp(-0.7 * F.col("q")) + 1.3)
    tree = BinOp("add", BinOp("mul", Const(1.0), UnOp("exp", BinOp("mul", Const(-0.1), Var("q")))), Const(0.0))
    fitted, _ = fit_constants_by_data(rows, tree, "y", 30)
    return spark.createDataFrame([(n, round(c, 5)) for n, c in zip(("scale", "rate", "start"), constants(fitted), strict=True)], "name string, value double")


# --- energies of spins made from lineitem

SPINS_SQL = "SELECT CASE WHEN l_quantity > 25 THEN 1.0 ELSE -1.0 END AS s0, CASE WHEN l_discount > 0.045 THEN 1.0 ELSE -1.0 END AS s1, CASE WHEN l_tax > 0.035 THEN 1.0 ELSE -1.0 END AS s2, CASE WHEN l_linenumber % 2 = 1 THEN 1.0 ELSE -1.0 END AS s3 FROM lineitem"
SPINS = ["s0", "s1", "s2", "s3"]


def _spins(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = {"s0": F.col("l_quantity") > 25, "s1": F.col("l_discount") > 0.045, "s2": F.col("l_tax") > 0.035, "s3": F.col("l_linenumber") % 2 == 1}
    return table(spark, sf_dir, "lineitem").select(*[F.when(v, 1.0).otherwise(-1.0).alias(k) for k, v in up.items()])


def _system():
    from galena.operators.ising import Ising

    j = np.zeros((4, 4))
    j[0, 1] = j[1, 0] = 0.5
    j[1, 2] = j[2, 1] = -0.25
    return Ising(j, np.array([0.0, 0.0, 0.0, 0.1]))


@query("pseudo_likelihood", f"WITH s AS ({SPINS_SQL}), z AS (SELECT 1.4 * s0 * 0.5 * s1 AS a, 1.4 * s1 * (0.5 * s0 - 0.25 * s2) AS b, 1.4 * s2 * -0.25 * s1 AS c, 1.4 * s3 * 0.1 AS d FROM s) SELECT 'columns' AS way, round(-avg(ln(1 + exp(-a)) + ln(1 + exp(-b)) + ln(1 + exp(-c)) + ln(1 + exp(-d))) / 4, 8) AS value FROM z UNION ALL SELECT 'tree', round(-avg(ln(1 + exp(-a)) + ln(1 + exp(-b)) + ln(1 + exp(-c)) + ln(1 + exp(-d))) / 4, 8) FROM z")
def _pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of couplings as one expression, and of the same energy as a tree on patterns of spins."""
    from galena.operators import ising

    rows, system = _spins(spark, sf_dir), _system()
    by_tree = -ising.energy_losses(ising.patterns(rows, SPINS), [ising.energy_tree(system, SPINS)], SPINS, 0.7)[0]
    return spark.createDataFrame([("columns", round(ising.pseudo_log_likelihood(rows, system, SPINS, 0.7), 8)), ("tree", round(by_tree, 8))], "way string, value double")


@query("energy_correlation", f"SELECT round(corr(s0 * s1 + s3, -0.5 * s0 * s1 + 0.25 * s1 * s2 - 0.1 * s3), 8) AS corr FROM ({SPINS_SQL})")
def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.ising import energy_correlation

    tree = BinOp("add", BinOp("mul", Var("s0"), Var("s1")), Var("s3"))
    return spark.createDataFrame([(round(energy_correlation(_spins(spark, sf_dir), tree, _system(), SPINS), 8),)], "corr double")


@query("couplings_from_energies", "SELECT * FROM (VALUES ('h3', 0.1::DOUBLE), ('j01', 0.5::DOUBLE), ('j12', -0.25::DOUBLE)) t(name, value)")
def _couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.ising import couplings_from_energies, energy_column

    found = couplings_from_energies(_spins(spark, sf_dir).withColumn("e", energy_column(_system(), SPINS)), SPINS, "e")
    rows = [(f"h{i}", round(float(v), 6)) for i, v in enumerate(found.h)] + [(f"j{a}{b}", round(float(found.j[a, b]), 6)) for a in range(4) for b in range(a + 1, 4)]
    return spark.createDataFrame([r for r in rows if r[1]], "name string, value double")


@query("covariance_seed", f"WITH c AS (SELECT var_samp(s0) + 1e-3 AS a, covar_samp(s0, s1) AS b, var_samp(s1) + 1e-3 AS d FROM ({SPINS_SQL})) SELECT round(b / (a * d - b * b) / 0.7, 6) AS coupling FROM c")
def _covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.ising import covariance_seed

    return spark.createDataFrame([(round(float(covariance_seed(_spins(spark, sf_dir), ["s0", "s1"], 0.7).j[0, 1]), 6),)], "coupling double")


# --- the smooth operator table

_SMOOTH = {
    "add": "a + b", "sub": "a - b", "mul": "a * b", "div": "a * b / (b * b + 1e-6)", "id": "a", "neg": "-a", "square": "a * a", "inv": "a / (a * a + 1e-6)", "sqrt": "sqrt(abs(a) + 1e-6)",
    "log": "ln(abs(a) + 1e-6)", "exp": "exp(greatest(-30.0, least(30.0, a)))", "sin": "sin(a)", "cos": "cos(a)", "tanh": "tanh(a)",
}


@query("programs_smooth", f"WITH v AS (SELECT d AS a, x AS b FROM ({BASE})) " + " UNION ALL ".join(f"SELECT '{k}' AS op, round(avg(tanh(greatest(-1e6, least(1e6, {v})))), 8) + 0.0 AS mean FROM v" for k, v in _SMOOTH.items()))
def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each smooth operator as a program of one node on two columns, all in one aggregate."""
    from galena.operators.programs import NAMES, Program

    made = {op: Program(((op, 0, 1),), ()).column(["d", "x"]) for op in NAMES}
    one = rows_of(spark, sf_dir).agg(*[(F.round(F.avg(F.tanh(c)), 8) + 0.0).alias(op) for op, c in made.items()])
    return one.selectExpr(f"stack({len(made)}, {', '.join(f"'{op}', `{op}`" for op in made)}) as (op, mean)")


@query("programs_enumerated", "SELECT * FROM (VALUES ('div(q, x)', 3.0::DOUBLE), ('q', 2.0::DOUBLE), ('start', 1.0::DOUBLE)) t(term, weight)")
def _enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of a formula from a bounded sample, their weights over all rows."""
    from galena.operators.enumeration import sample_rows
    from galena.operators.programs import combine_programs
    from galena.operators.regression import ols

    q, x = F.col("q"), F.col("x")
    rows = rows_of(spark, sf_dir).withColumn("y", 3 * q * x / (x * x + 1e-6) + 2 * q + 1)
    data = sample_rows(rows, ["q", "x", "y"], 2000)
    terms, _, _ = combine_programs(np.stack([data["q"], data["x"]], 1), data["y"], depth=1, most=3)
    named = {("q" if p.nodes[0][0] == "id" else p.render(["q", "x"])): p for _, p in terms}
    fit = ols(rows, {k: p.column(["q", "x"]) for k, p in named.items()}, F.col("y"))
    return spark.createDataFrame([*((k, round(float(fit[k]), 5)) for k in named if abs(fit[k]) > 1e-6), ("start", round(float(fit["1"]), 5))], "term string, weight double")


# --- trajectories


_MONTHS = f"{FIELD_SQL}, k AS (SELECT t, x, u, dense_rank() OVER (ORDER BY t) - 1 AS i, dense_rank() OVER (ORDER BY x) - 1 AS p FROM g)"
_ACFS = "SELECT traj_id, avg(top) AS t_acf FROM (SELECT traj_id, p, max(abs(acf)) AS top FROM (SELECT a.traj_id, a.p, b.i - a.i AS lag, CASE WHEN any_value(a.s) > 1e-300 THEN avg(a.c * b.c) / any_value(a.s) ELSE 0 END AS acf FROM z a JOIN z b ON a.traj_id = b.traj_id AND a.p = b.p AND b.i - a.i BETWEEN 1 AND 20 WHERE b.i - a.i < a.n / 2.0 GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"


@query(
    "model_class",
    f"""WITH {_MONTHS}, u AS (SELECT 'field' AS traj_id, p, i, u AS v FROM k UNION ALL SELECT CAST(user_id AS VARCHAR), 0, row_number() OVER {W} - 1, value FROM events),
    m AS (SELECT traj_id, p, avg(v) AS m, var_pop(v) AS s, count(*) AS n FROM u GROUP BY 1, 2), z AS (SELECT u.traj_id, p, i, v - m AS c, s, n FROM u JOIN m USING (traj_id, p)),
    r AS (SELECT i, p, u - avg(u) OVER (PARTITION BY i) AS c FROM k WHERE i % greatest(1, (SELECT max(i) FROM k) // 20) = 0), q AS (SELECT i, c, lead(c) OVER (PARTITION BY i ORDER BY p) AS d FROM r),
    x AS (SELECT avg(cov / v) AS x_acf FROM (SELECT i, avg(c * d) AS cov, avg(c * c) AS v FROM q GROUP BY i) WHERE v > 1e-300)
    SELECT t.traj_id, round(t_acf, 7) AS t_acf, CASE WHEN traj_id = 'field' THEN round(x_acf, 7) END AS x_acf, traj_id = 'field' AND x_acf >= 0.3 AS is_field FROM ({_ACFS}) t, x""",
)
def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as series, and the sums of orders by month and nation as a field: how neighbours in time and in space go together, and whether that makes a field."""
    from galena.operators.dynamics import model_class

    f = field(spark, sf_dir)
    months = f.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "u"))), lambda c: c["u"]).alias("state"))
    one = months.withColumn("i", (F.row_number().over(Window.orderBy("t")) - 1).cast("long"))  # a row a month
    both = user_trajectories(spark, sf_dir).unionByName(one.select(F.lit("field").alias("traj_id"), "i", F.col("i").cast("double").alias("t"), "state"))
    return model_class(both).select("traj_id", F.round("t_acf", 7).alias("t_acf"), F.round("x_acf", 7).alias("x_acf"), (F.col("class") == "pde").alias("is_field"))


@query("target_rates", f"WITH {_USERS}, n AS (SELECT traj_id, i, v, lead(v) OVER (PARTITION BY traj_id ORDER BY i) AS n FROM e) SELECT traj_id, i, round(v, 8) AS x, round(n - v, 8) + 0.0 AS rate FROM n WHERE n IS NOT NULL")
def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.dynamics import target_rows

    first = lambda c: F.get(c, F.lit(0))
    return target_rows(user_trajectories(spark, sf_dir)).select("traj_id", "i", F.round(first("x"), 8).alias("x"), (F.round(first("y"), 8) + 0.0).alias("rate"))


@query("target_next", f"WITH {_USERS}, n AS (SELECT traj_id, i, lead(v) OVER (PARTITION BY traj_id ORDER BY i) AS n FROM e) SELECT traj_id, i, round(n, 8) AS next FROM n WHERE n IS NOT NULL")
def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.dynamics import target_rows

    return target_rows(user_trajectories(spark, sf_dir), "map").select("traj_id", "i", F.round(F.get("y", F.lit(0)), 8).alias("next"))


@query("effective_dimension", f"WITH g AS (SELECT CAST(l_linenumber AS VARCHAR) AS traj_id, var_pop(q) AS a, var_pop(d) AS b, var_pop(x) AS c, covar_pop(q, d) AS ab, covar_pop(q, x) AS ac, covar_pop(d, x) AS bc FROM ({BASE}) GROUP BY 1) SELECT traj_id, round((a + b + c) * (a + b + c) / (a * a + b * b + c * c + 2 * (ab * ab + ac * ac + bc * bc)), 7) AS dimension FROM g")
def _dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    from galena.operators.dynamics import effective_dimension

    rows = rows_of(spark, sf_dir).select(F.col("l_linenumber").cast("string").alias("traj_id"), F.col("l_orderkey").cast("long").alias("i"), F.col("l_orderkey").cast("double").alias("t"), F.array("q", "d", "x").alias("state"))
    return effective_dimension(rows).select("traj_id", F.round("dimension", 7).alias("dimension"))


@query("stencil_locality", "SELECT * FROM (VALUES ('heat_1d', 1)) t(traj_id, reach)")
def _stencil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heat equation looks at its nearest neighbours."""
    from galena.operators.dynamics import stencil_locality, trajectories

    return spark.createDataFrame([("heat_1d", stencil_locality(trajectories(spark, [{"system": "heat_1d"}]), "heat_1d"))], "traj_id string, reach int")
